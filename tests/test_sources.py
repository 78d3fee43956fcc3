"""Readers and writers on small files, in one split and in many."""

import pytest
from pyspark.sql import functions as F

from trialmill.operators import gaze, markers
from trialmill.plans import catalog
from trialmill.sources import lines, logs, tables

from conftest import rows


@pytest.fixture(params=["whole", "split"])
def splits(request, spark):
    """Read files in one piece, and in pieces of a few bytes."""
    if request.param == "split":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_keep_their_order(spark, tmp_path, splits):
    text = [f"line {i}" + "x" * (i % 7) for i in range(60)] + [""] * 3 + ["end"]
    (tmp_path / "a_1.log").write_text("\n".join(text) + "\n")
    (tmp_path / "a_2.log").write_text("\r\n".join(text))
    (tmp_path / "a_0.log").write_text("training\n")
    (tmp_path / "b.txt").write_text("other\n")
    df = lines.read_lines(spark, str(tmp_path), "*.log", ["_0"], skip=5)
    for code in ("a_1", "a_2"):
        got = [r.text for r in df.where(F.col("code") == code).orderBy("line").collect()]
        assert got == text[5:]
    assert {r.code for r in df.select("code").distinct().collect()} == {"a_1", "a_2"}
    assert df.groupBy("code", "line").count().where("count > 1").count() == 0


def test_event_log(spark, tmp_path, splits):
    head = "Scenario\nLogfile written\n\nSubject\tTrial\tEvent Type\tCode\tTime\tTTime\n\n"
    body = "a05_1\t1\tPicture\tdistractors/category1/F.jpg : | category2/G.jpg NA\t1000\t0\na05_1\t2\tResponse\t2\t2500\t5\n"
    (tmp_path / "a05_1-exp.log").write_text(head + body)
    (tmp_path / "a05_0-exp.log").write_text(head + body)
    (tmp_path / "a05_1Pre.log").write_text(head + body)
    out = logs.scan_event_log(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.subject, r.block, r.event, r.code, r.time) for r in out] == [
        ("a05", 1, "Picture", "distractors/category1/F.jpg : | category2/G.jpg NA", 1000),
        ("a05", 1, "Response", "2", 2500),
    ]


def test_sequences(spark, tmp_path):
    head = "condition\tsoa\tdistractL\tdistractR\ttargetL\ttargetR\titi\n"
    for block, rows_ in ((1, 3), (2, 2)):
        body = "".join(f"{i}\t100\tp/AN{i}.jpg\tp/NE{i}.jpg\t3\tNA\t{1000 + i}\n" for i in range(rows_))
        (tmp_path / f"b07_{block}.txt").write_text(head + body)
    (tmp_path / "b07_0.txt").write_text(head)
    out = logs.scan_sequences(spark, str(tmp_path)).orderBy("trial").collect()
    assert [(r.subject, r.block, r.trial, r.condition) for r in out] == [
        ("b07", 1, 1, 0), ("b07", 1, 2, 1), ("b07", 1, 3, 2), ("b07", 2, 4, 0), ("b07", 2, 5, 1),
    ]


MARKER_HEAD = "".join(f"header {i}\n" for i in range(11)) + "Mk1=New Segment,,1,1,0,2020\n"


def test_markers(spark, tmp_path, splits):
    (tmp_path / "a05.vmrk").write_text(MARKER_HEAD + "Mk2=Stimulus,S  6,100,1,0\nMk3=Stimulus,S 99,350,1,0\n")
    (tmp_path / "a05_2.vmrk").write_text(MARKER_HEAD)
    out = logs.scan_markers(spark, str(tmp_path)).orderBy("line")
    assert [tuple(r) for r in out.select("subject", "value", "sample", "paradigm").collect()] == [
        ("a05", 6, 100, "Dot Probe"),
        ("a05", 99, 350, "Dot Probe"),
    ]


def test_marker_files_are_rewritten_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for code in ("a01", "b01"):
        (source / f"{code}.vmrk").write_text(MARKER_HEAD + "Mk2=Stimulus,S 17,100,1,0\nMk9=Stimulus,S 88,350,1,0\n")
    plan = spark.createDataFrame([("b01", 1, 100)], "subject string, trial long, soa int")
    fixed = markers.recode_dual_markers(markers.repair_markers(logs.scan_markers(spark, str(source))), plan)
    for _ in range(2):
        tables.write_markers(spark, fixed, str(source), target)
        parts = sorted((tmp_path / "out").glob("subject=*/*.txt"))
        text = "".join(p.read_text() for p in parts)
        assert {p.parent.name for p in parts} == {"subject=b01"}
        assert text == MARKER_HEAD + "Mk2=Stimulus,S6,100,1,0\nMk3=Stimulus,S88,350,1,0\n"
    assert (source / "b01.vmrk").read_text().endswith("S 88,350,1,0\n")


def test_impedances(spark, tmp_path, splits):
    text = "Ch1=Fp1,,0.5\nCh2=Fz,,0.5\n" + "x\n" * 20 + "Impedance [kOhm]\nFp1:          5\nFz:         ???\nRef:  3.5\n"
    (tmp_path / "b06.vhdr").write_text(text)
    (tmp_path / "b06_2.vhdr").write_text(text)
    out = logs.scan_impedances(spark, str(tmp_path)).select("subject", "time", "electrode", "impedance")
    assert rows(out) == [
        ("b06", "after", "Fp1", 5.0), ("b06", "after", "Fz", None), ("b06", "after", "Ref", 3.5),
        ("b06", "before", "Fp1", 5.0), ("b06", "before", "Fz", None), ("b06", "before", "Ref", 3.5),
    ]


def test_gaze(spark, tmp_path, splits):
    numbers = [str(i) for i in range(3, 46)]
    smp = lambda t, cells: "\t".join([str(t), "SMP", "1", *cells])
    message = "2000\tMSG\t1\t# Message: category1/F.jpg : | category2/G.jpg NA"
    text = "".join(f"## {i}\n" for i in range(37)) + "Time\tType\tTrial\n"
    text += "\n".join([smp(1000, numbers), message, smp(3000, numbers[:10]), message.replace("2000", "4000")]) + "\n"
    (tmp_path / "a05_1 Samples.txt").write_text(text)
    samples, messages = logs.scan_gaze(spark, str(tmp_path))
    got = samples.orderBy("time").collect()
    assert [(r.subject, r.block, r.time) for r in got] == [("a05", 1, 1000), ("a05", 1, 3000)]
    assert [got[0][f] for f in gaze.FIELDS] == [7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 21.0, 22.0, 23.0, 24.0]
    assert (got[1].pupil_r_mm, got[1].pos_l_x) == (12.0, None)
    assert rows(messages.select("trial", "time", "text")) == [
        (1, 2000, "category1/F.jpg : | category2/G.jpg NA"),
        (2, 4000, "category1/F.jpg : | category2/G.jpg NA"),
    ]


def test_scored_tables(spark, tmp_path):
    fix = spark.createDataFrame([("a05_1", "Trial: 1", 0.0, 128.0, 892.1, 564.25), ("a05_1", "Trial: 2", 4.0, 8.5, None, 1.0)], "session string, trial string, start double, end double, x double, y double")
    path = str(tmp_path / "fix")
    tables.write_sr_tables(fix, path, tables.FIXATION_HEADINGS)
    text = "".join(p.read_text() for p in (tmp_path / "fix").glob("*.csv"))
    assert "a05_1\tTrial: 1\t0\t128\t892,1\t564,25" in text and "\tNA\t1" in text
    assert rows(tables.scan_sr_table(spark, path, tables.FIXATION_HEADINGS)) == rows(fix)


@pytest.mark.parametrize("swapped,order", [(False, "1\t3\t2\t4"), (True, "1\t2\t3\t4")])
def test_saccade_columns(spark, tmp_path, swapped, order):
    sac = spark.createDataFrame([("s_1", "Trial: 1", 8.0, 9.0, 1.0, 2.0, 3.0, 4.0, False)], "session string, trial string, start double, end double, start_x double, start_y double, end_x double, end_y double, blink boolean")
    path = str(tmp_path / "sac")
    tables.write_sr_tables(sac, path, tables.SACCADE_HEADINGS, swapped=swapped)
    text = "".join(p.read_text() for p in (tmp_path / "sac").glob("*.csv"))
    assert f"8\t9\t{order}\tFALSE" in text
    if not swapped:
        assert tables.scan_sr_table(spark, path, tables.SACCADE_HEADINGS).first().blink is False


def test_questionnaire_and_epochs(spark, tmp_path):
    (tmp_path / "q.csv").write_text('VP01s;STARTED;sias_1;FB02_01;SD01;SD07_01\na05;2020-01-01;1,5;2;3;"none; really"\n')
    q = tables.scan_csv2(spark, str(tmp_path / "q.csv")).first()
    assert (q.subject, q.sias_1, q.SD01, q.SD07_01) == ("a05", 1.5, 3.0, "none; really")
    (tmp_path / "e.csv").write_text("counter,subjectNum,paradigm,angry,trial,P7,P8\n1,5,1,2,3,0.5,-1.5\n")
    assert rows(tables.scan_epochs(spark, str(tmp_path / "e.csv"))) == [(5, 1, 2, 3, 0.5, -1.5)]


def test_snapshot(spark, tmp_path):
    assert rows(tables.snapshot(spark.range(3), str(tmp_path / "s"))) == [(0,), (1,), (2,)]


def test_recordings_in_parts_are_one_file(spark, tmp_path, splits):
    path, codes = str(tmp_path / "log"), ["a05_1", "b 7+%41=x", "empty", "a05_0"]
    at = spark.range(300).select(F.col("id").alias("line"), F.concat(F.lit("row "), "id").alias("text"))
    body = at.crossJoin(spark.createDataFrame([(c,) for c in codes if c != "empty"], "code string")).repartition(5)
    body = body.unionByName(spark.createDataFrame([(0, "no code", None), (0, None, "a05_1")], "line long, text string, code string"))
    head = spark.createDataFrame([(c, i, f"head {i}") for c in codes for i in (1, 0, 2)], "code string, line int, text string")
    lines.write_lines(body, path, head)
    # more parts, as a larger recording has
    text = [f"head {i}\n" for i in range(3)] + [f"row {i}\n" for i in range(300)]
    (tmp_path / "log" / "code=large").mkdir()
    for k, (start, end) in enumerate([(0, 40), (40, 41), (41, 303)]):
        (tmp_path / "log" / "code=large" / f"part-0000{k}-x.c000.txt").write_text("".join(text[start:end]))
    for skip in (0, 3):
        df = lines.read_lines(spark, path, "*.log", ["_0"], skip=skip)
        for code in [*codes[:3], "large"]:
            got = [r.text for r in df.where(F.col("code") == code).orderBy("line").collect()]
            want = [f"head {i}" for i in range(3)] + ([] if code == "empty" else [f"row {i}" for i in range(300)])
            assert got == want[skip:]
        assert df.where(F.col("code") == "a05_0").count() == 0
        assert df.groupBy("code", "line").count().where("count > 1").count() == 0


def test_recordings_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "log")
    rows_of = lambda *told: spark.createDataFrame(told, "code string, line long, text string")
    lines.write_lines(rows_of(("a", 1, "old"), ("a", 2, "old"), ("b", 1, "kept")), path)
    with pytest.raises(Exception, match="already exists"):
        lines.write_lines(rows_of(("a", 1, "new")), path)
    lines.write_lines(rows_of(("a", 1, "new")), path, mode="replace")
    assert rows(lines.read_lines(spark, path).select("code", "text")) == [("a", "new"), ("b", "kept")]


def test_marker_files_of_a_broken_run_are_written_again(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for code in ("b01", "b02"):
        (source / f"{code}.vmrk").write_text(MARKER_HEAD + "Mk2=Stimulus,S 17,100,1,0\nMk9=Stimulus,S 88,350,1,0\n")
    plan = spark.createDataFrame([("b01", 1, 100), ("b02", 1, 100)], "subject string, trial long, soa int")
    fixed = markers.recode_dual_markers(markers.repair_markers(logs.scan_markers(spark, str(source))), plan)
    tables.write_markers(spark, fixed.where("subject = 'b01'"), str(source), str(target))
    kept = {p: p.stat().st_mtime_ns for p in target.glob("subject=b01/*")}
    # half of a subject, as a run that broke off leaves it
    (target / "subject=b02").mkdir()
    (target / "subject=b02" / "part-00000-x.c000.txt").write_text("header 0\n")
    tables.write_markers(spark, fixed, str(source), str(target))
    text = "".join(p.read_text() for p in sorted(target.glob("subject=b02/*.txt")))
    assert text == MARKER_HEAD + "Mk2=Stimulus,S6,100,1,0\nMk3=Stimulus,S88,350,1,0\n"
    assert {p: p.stat().st_mtime_ns for p in target.glob("subject=b01/*")} == kept
    back = logs.scan_markers(spark, str(target))
    assert rows(back.select("subject", "value")) == [("b01", 6), ("b01", 88), ("b02", 6), ("b02", 88)]


def test_packed_recordings_are_files(spark, tmp_path, splits):
    path, codes = str(tmp_path / "log"), ["a05_1", "b 7+%41=x\t$1", "empty", "a05_0"]
    at = spark.range(300).select(F.col("id").alias("line"), F.concat(F.lit("row\t"), "id").alias("text"))
    body = at.crossJoin(spark.createDataFrame([(c,) for c in codes if c != "empty"], "code string")).repartition(5)
    told = [(0, "no code", None), (0, None, "a05_1"), (300, "one\r\ntwo\n", "a05_1"), (301, "three\rfour\r", "a05_1")]
    body = body.unionByName(spark.createDataFrame(told, "line long, text string, code string"))
    head = spark.createDataFrame([(c, i, f"head {i}") for c in codes for i in (1, 0, 2)], "code string, line int, text string")
    lines.write_lines(body, path, head, packed=True)
    assert len(list((tmp_path / "log").rglob("part-*"))) < 5 * len(codes)
    last = {"empty": [], "a05_1": [f"row\t{i}" for i in range(300)] + ["one", "two", "", "three", "four"]}
    for skip in (0, 3, 5):
        df = lines.read_lines(spark, path, "*.log", ["_0"], skip=skip)
        top = lines.read_lines(spark, path, "*.log", ["_0"], skip=skip, keep=True)
        for code in codes[:3]:
            whole = [f"head {i}" for i in range(3)] + last.get(code, [f"row\t{i}" for i in range(300)])
            for found, want in ((df, whole[skip:]), (top, whole[:skip])):
                assert [r.text for r in found.where(F.col("code") == code).orderBy("line").collect()] == want
        assert df.where(F.col("code") == "a05_0").count() == 0
        assert df.groupBy("file", "line").count().where("count > 1").count() == 0


def test_packed_recordings_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "log")
    rows_of = lambda *told: spark.createDataFrame(told, "code string, line long, text string")
    lines.write_lines(rows_of(("a", 1, "old"), ("a", 2, "old"), ("b", 1, "kept")), path, packed=True)
    with pytest.raises(Exception, match="already exists"):
        lines.write_lines(rows_of(("a", 1, "new")), path, packed=True)
    for text in ("newer", "new"):
        lines.write_lines(rows_of(("a", 1, text), ("c", 1, text)), path, mode="replace", packed=True)
    assert rows(lines.read_lines(spark, path).select("code", "text")) == [("a", "new"), ("b", "kept"), ("c", "new")]


def test_packed_marker_files_are_written_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for code in ("b01", "b02"):
        (source / f"{code}.vmrk").write_text(MARKER_HEAD + "Mk2=Stimulus,S 17,100,1,0\nMk9=Stimulus,S 88,350,1,0\n")
    plan = spark.createDataFrame([("b01", 1, 100), ("b02", 1, 100)], "subject string, trial long, soa int")
    fixed = markers.recode_dual_markers(markers.repair_markers(logs.scan_markers(spark, str(source))), plan)
    for some in (fixed.where("subject = 'b01'"), fixed, fixed):
        tables.write_markers(spark, some, str(source), target, packed=True)
    got = lines.read_lines(spark, target).orderBy("code", "line").select("code", "text").collect()
    text = (MARKER_HEAD + "Mk2=Stimulus,S6,100,1,0\nMk3=Stimulus,S88,350,1,0\n").splitlines()
    assert [tuple(r) for r in got] == [(c, t) for c in ("b01", "b02") for t in text]


def test_many_recordings_make_few_files(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(catalog, "new_path", lambda _, label: made.append(str(tmp_path / label)) or made[-1])
    told = spark.range(400).select(F.col("id").cast("string").alias("code"), F.col("id").alias("line"), F.lit("x").alias("text"))
    path = catalog._recordings(spark, "many", told, ["head"])
    assert sum(p.is_file() for p in (tmp_path / "many").rglob("*")) < 100
    assert lines.read_lines(spark, path, skip=1).select("code").distinct().count() == 400
