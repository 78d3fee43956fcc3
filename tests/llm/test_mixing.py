import collections
import random
import re

from trialmill.llm import mixing, queries


def level(sizes):
    """Targets by raising capped sources again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        left, all_weight = total - sum(fixed.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / all_weight > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / all_weight for s in rest}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_targets_and_takes(docs):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40])), rng.choice(["b", "a", None, "z", "Z", "é", "tiny"][: 7 if i % 50 == 0 else 6])) for i in range(3_000)]
    rows += [(5_000, None, "a"), (5_001, "", "empty"), (None, "x y", "a"), (6_000, "x y", "a"), (6_000, "x y", "a"), (5_002, "w " * 30_000, "b")]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    out = mixing.plan(docs(rows)).collect()
    assert len(out) == len(rows) and collections.Counter(r.doc_id for r in out) == collections.Counter(i for i, *_ in rows)
    want, source = level(sizes), {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in out:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= (15_001 if s == "b" else 41)
    assert sorted(map(tuple, mixing.plan(docs(rows[::-1])).collect()), key=str) == sorted(map(tuple, out), key=str)
    assert mixing.plan(docs([])).count() == 0


def test_word_count(docs):
    texts = ["", " ", "a", " a\tb\x0bc\x0cd\re\n\nf ", "a\xa0b c", " ", None, "x " * 10_000]
    out = {r[0]: r[1] for r in docs([(i, t, "s") for i, t in enumerate(texts)]).select("doc_id", mixing.word_count("text")).collect()}
    assert [out[i] for i in range(len(texts))] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_stage_takes_documents_as_often_as_the_plan_says(spark, docs):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice(["a", "b", "c", None, "a", "a"])) for i in range(500)]
    df = docs(rows)
    plan = {r.doc_id: r.taken // r["size"] for r in mixing.plan(df).collect()}
    mixed = queries.mix_sources(spark, df, "")
    assert mixed.columns == df.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({i: n for i, n in plan.items() if n})
