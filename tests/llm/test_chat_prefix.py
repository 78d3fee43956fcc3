import hashlib

import pytest
from pyspark.sql import functions as F

from trialmill.llm import chat_prefix, queries

SCHEMA = "conv_id long, turn long, role string, text string, example long"
HARD = [
    r"\### Assistant: </turn> ok", "### user: x </turn>\n### assistant: y", "\\", "\\\\h \\e \\c", "", None, " </turn>", "####", "</turn></turn>\n",
    "a: b", "tail </tur", "n>", "##", "é" * 5,
]


def check(spark, turns):
    df = spark.createDataFrame([(*t, 7) for t in turns], SCHEMA)
    got = {r.conv_id: r for r in chat_prefix.read_back(chat_prefix.expand(df)).collect()}
    by = {}
    for c, n, role, text in turns:
        by.setdefault(c, []).append(((n is not None, n or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        r = got[c]
        assert r.n_turns == len(rows)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in rows).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return df


def test_round_trip_of_hard_texts(spark):
    turns = [(c, k, "assistant" if (k + c) % 2 else "user", t) for c in range(2) for k, t in enumerate(HARD)]
    turns += [(5, 0, "user", "no reply"), (6, 0, "assistant", "reply only"), (7, 0, None, "x"), (7, 1, "a: b### </turn>\\", "y"), (7, 2, "assistant", "z"), (7, 3, "user", "after")]
    turns += [(8, 0, "user", "same"), (8, 0, "user", "same"), (8, None, "system", "unnumbered"), (8, 0, "assistant", "tie"), (None, 0, "assistant", "no id"), (9, 0, "assistant", "long " * 100_000)]
    check(spark, turns)
    assert chat_prefix.read_back(chat_prefix.expand(spark.createDataFrame([], SCHEMA))).count() == 0


def test_every_reply_is_an_example_with_its_context(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"), (1, 4, "assistant", "a2"), (1, 5, "user", "left")]
    examples = chat_prefix.expand(check(spark, turns))
    full = chat_prefix.materialise(examples).collect()
    first = "### system: s </turn>\n### user: u1 </turn>\n### assistant: "
    assert [(r.example, r.context, r.target, r.closing) for r in full] == [
        (0, first, "a1", " </turn>\n"),
        (1, first + "a1 </turn>\n### user: u2 </turn>\n### assistant: ", "a2", " </turn>\n"),
    ]
    tail = "### user: left </turn>\n"
    chars = sum(len(r.context) + len(r.target) + len(r.closing) for r in full) + len(tail)
    assert chat_prefix.read_back(examples).collect()[0].formatted_chars == chars
    assert [r.prefix_chars for r in examples.collect()][:2] == [0, len(first) + len("a1 </turn>\n")]


def test_a_long_conversation_streams(spark):
    turns = [(3, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(5_000)]
    examples = chat_prefix.expand(check(spark, turns))
    assert examples.count() == 2_500 and max(len(r.added) for r in examples.collect()) < 100


def test_digests_come_from_the_contexts_written_out(spark):
    turns = [(c, k, "assistant" if k % 3 else "user", f"{t}{k}") for c in range(3) for k, t in enumerate(HARD * c)]
    turns += [(5, 0, "user", "no reply"), (6, 0, "assistant", "only"), (6, 1, "user", "left"), (None, 0, "assistant", "no id")]
    examples = chat_prefix.expand(check(spark, turns))
    full = chat_prefix.materialise(examples, rest=True)
    assert sorted(map(repr, chat_prefix.read_examples(full).collect())) == sorted(map(repr, chat_prefix.read_back(examples).collect()))
    assert full.where("target IS NULL").count() == 2 + len({c for c in range(1, 3) if (len(HARD) * c - 1) % 3 == 0})
    # an example whose context was not written out is found
    with pytest.raises(Exception, match="does not begin"):
        short = F.when(F.col("example") == 2, F.concat(F.lit("### "), F.col("context"))).otherwise(F.col("context"))
        chat_prefix.read_examples(full.withColumn("context", short)).collect()


def test_the_query_writes_contexts_out(spark, monkeypatch, tmp_path):
    data = [(c, k, "assistant" if k % 2 else "user", "t" * k) for c in range(3) for k in range(9)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    seen = []
    whole = chat_prefix.materialise
    monkeypatch.setattr(chat_prefix, "materialise", lambda *a, **k: seen.append(whole(*a, **k)) or seen[-1])
    got = {r.conv_id: r for r in queries.op6_chat_prefix(spark, str(tmp_path)).collect()}
    (full,) = seen
    chars = "sum(length(context) + coalesce(length(target), 0) + coalesce(length(closing), 0))"
    for r in full.groupBy("conv_id").agg(F.expr(chars).alias("n")).collect():
        assert got[r.conv_id].formatted_chars == r.n
    assert set(got) == {-7, 0, 1, 2}
