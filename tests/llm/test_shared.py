import pyarrow as pa
import pytest

from trialmill.llm import ngram_trie, queries, shared, toxicity

TEXTS = pa.array(["One bad word. A good one.", None, ""])
MARKED = pa.RecordBatch.from_arrays([TEXTS, pa.array([1, 0, 0], pa.int32())], ["_text", "toxic"])


@pytest.mark.parametrize(
    "task",
    [
        lambda: list(toxicity._count_features(iter([MARKED]))),
        lambda: list(toxicity._Bags({"bad": 0})(iter([MARKED]))),
        lambda: toxicity._Judge(toxicity.Model({"bad": 9.0}, -5.0))(TEXTS),
        lambda: list(ngram_trie.gram_sets(TEXTS, 4)),
    ],
)
def test_workers_let_go_of_what_other_operators_hold(task):
    """An idle worker's codec counts against the executor while other stages run."""
    shared.held(("codec",), lambda: bytearray(1000))
    task()
    assert all(key != ("codec",) for key, _ in shared._held)


def test_operators_keep_what_they_hold():
    first = shared.held(("own",), list)
    assert list(shared.slices(iter([MARKED]), 2))
    assert shared.held(("own",), list) is first


def test_tables_of_powers_are_small():
    assert sum(p.nbytes for p in ngram_trie._powers_to(10)) <= 8 << 20


def test_a_task_of_the_last_stage_needs_one_worker(spark, docs):
    done = queries.tokenise(spark, docs([(1, "some text", "s"), (2, None, "s"), (2, "some text", "s")]), "")
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.n_tokens) for r in done.collect()) == [(1, 2), (2, 0), (2, 2)]
