import math
import zlib

import duckdb
from pyspark.sql import functions as F

from trialmill.llm import queries, toxicity


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def table(n=400):
    bad = ["nasty", "vilest", "vilely"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = "Some plain words stand here. " * (1 + i % 7)
        if toxic:
            text += f"You are a {bad[i % 3]} thing! "
        elif i % 2:
            text += "You are a kind thing! "  # what stands beside a toxic word is no sign
        rows.append((i, text + "And it goes on.\nWith more.", "s"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_and_locates(spark, docs):
    rows, labels = table()
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs(rows), marks)
    out = toxicity.score(docs([*rows, (1000, "A good start. This is vileness itself. The end.", "s")]), model).collect()
    wrong = [r for r in out if r.doc_id < 1000 and (r.score >= toxicity.THRESHOLD) != (r.doc_id % 5 == 0)]
    assert not wrong and out[0].lang == "en" and all(0 <= r.score <= 1 for r in out)
    new = next(r for r in out if r.doc_id == 1000)  # only the beginning of the word is known
    assert [new.text[o.start : o.end].strip() for o in new.offending] == ["This is vileness itself"]
    again = toxicity.train(docs(rows), marks)
    assert again == model


def test_score_is_the_noisy_or(docs):
    model = toxicity.Model({"bad": 5.0, "good*": -1.0}, -3.0)
    out = toxicity.score(docs([(1, "bad one. fine. bad bad\nnone", "s")]), model).collect()[0]
    p = lambda z: 1 / (1 + math.exp(-z))
    assert abs(out.score - (1 - (1 - p(2)) * (1 - p(-3)) ** 2 * (1 - p(7)))) < 1e-12


def test_held_out_labels_teach_nothing(spark, docs):
    rows, labels = table()
    turned = [(i, 1 - t if held_out(i) else t) for i, t in labels]
    one, two = (toxicity.train(docs(rows), spark.createDataFrame(v, "doc_id long, toxic int")) for v in (labels, turned))
    assert one == two


def test_hard_rows(spark, docs):
    rows, labels = table()
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (5, 1), (5, 1), (99_999, 1)], "doc_id long, toxic int")
    hard = [(None, "nasty", None), (7000, None, "s"), (7001, "", "s"), (7002, " .\n", "s"), (7003, "plain words. " * 40_000 + "a nasty thing", "s")]
    model = toxicity.train(docs(rows + hard), marks)
    out = {r.doc_id: r for r in toxicity.score(docs(hard), model).collect()}
    judged = docs(hard).select(toxicity.is_held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h is not None for r in judged)
    assert [out[k].score for k in (7000, 7001, 7002)] == [0.0] * 3 and out[7003].score > 0.3 and out[None].score > 0.3
    nothing = toxicity.train(docs([]), marks)
    assert toxicity.score(docs(hard), nothing).where("score >= 0.3").count() == 0
    assert toxicity.score(docs([]), model).count() == 0


def test_held_out_accuracy(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{data}/labels.parquet'").fetchall())
    out = [r for r in queries.op5_toxicity_mil(spark, data).collect() if r.doc_id in labels]
    assert all(r.held_out == held_out(r.doc_id) for r in out)
    right = [r.predicted == labels[r.doc_id] for r in out if r.held_out]
    assert sum(right) / len(right) >= 0.95


def test_stage_drops_toxic_documents(spark, docs, tmp_path):
    rows, labels = table()
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {r.doc_id for r in queries.drop_toxic(spark, docs(rows), str(tmp_path)).collect()}
    assert left == {i for i in range(400) if i % 5}


def test_length_alone_is_not_toxic(spark, docs, tmp_path):
    rows, labels = table()
    rows += [(k, f"Toxic for a reason that no word of it tells {k}.", "s") for k in range(400, 410)]
    labels += [(k, 1) for k in range(400, 410)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    clean = "Some plain words stand here. " * 40_000
    long = [(2000, clean, "s"), (2001, clean + "You are a nasty thing!", "s")]
    out = {r.doc_id: r.score for r in toxicity.score(docs(long), toxicity.train(docs(rows), marks)).collect()}
    assert out[2000] < toxicity.THRESHOLD <= out[2001]
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    left = {r.doc_id for r in queries.drop_toxic(spark, docs(rows + long), str(tmp_path)).collect()}
    assert 2000 in left and 2001 not in left
