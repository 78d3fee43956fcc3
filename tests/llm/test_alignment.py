import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trialmill.llm import alignment, queries

A_PATH, B_PATH = alignment.public_files(queries.BYTE_MODEL, queries.PIECE_MODEL)
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
ALIGNER = alignment.Aligner(open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read())
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def spans(ids, bytes_of):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(bytes_of[i]), i))
        at += len(bytes_of[i])
    return out


def whole(text):
    """Groups and links of a text, every token against every token, over the whole text at once."""
    if not text:
        return [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    data = (" " + text).encode()
    if b"".join(ALIGNER.a_bytes[i] for i in a) != data or b"".join(ALIGNER.b_bytes[i] for i in b) != data:
        return [], []
    a, b = spans(a, ALIGNER.a_bytes), spans(b, ALIGNER.b_bytes)
    links = [(x, y) for p, q, x in a for r, s, y in b if p < s and r < q]
    cuts = sorted({q for _, q, _ in a} & {s for _, s, _ in b})
    groups = [([x for _, q, x in a if low < q <= high], [y for _, s, y in b if low < s <= high]) for low, high in zip([0, *cuts], cuts)]
    return groups, links


def expected(rows):
    """What `compare` returns for (doc_id, text), by plain loops."""
    made = [(i, *whole(t)) for i, t in rows]
    counts = Counter(p for _, _, links in made for p in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for i, groups, links in made:
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(told.encode()).hexdigest() if groups else ""
        n_best = sum(counts[p] == best[p[1]] for p in links)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), n_best, sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab '\n\tlvs!1é日▁\x85\xa0\x1c-", max_size=60)))
def test_words_make_the_whole(text):
    groups, links = whole(text)
    n_a, n_b, n_groups, digest, found = next(ALIGNER.texts([text]))
    assert (n_a, n_b, n_groups) == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups))
    assert Counter(divmod(int(p), ALIGNER.n_b) for p in found) == Counter(links)
    told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    assert digest == (hashlib.sha256(told.encode()).hexdigest() if groups else "")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.data())
def test_slices_and_links_of_any_sizes(a_sizes, data):
    total, b_sizes = sum(a_sizes), []
    while sum(b_sizes) < total:
        b_sizes.append(data.draw(st.integers(1, total - sum(b_sizes))))
    a_ends, b_ends = [sum(a_sizes[: k + 1]) for k in range(len(a_sizes))], [sum(b_sizes[: k + 1]) for k in range(len(b_sizes))]
    found, i, j = [], 0, 0
    for to_i, to_j in alignment.slices_of(a_sizes, b_sizes).values():
        assert a_ends[to_i - 1] == b_ends[to_j - 1]
        found += alignment.expand(range(i, to_i), range(j, to_j), a_sizes[i:to_i], b_sizes[j:to_j])
        i, j = to_i, to_j
    brute = [(x, y) for x in range(len(a_sizes)) for y in range(len(b_sizes)) if a_ends[x] - a_sizes[x] < b_ends[y] and b_ends[y] - b_sizes[y] < a_ends[x]]
    assert sorted(found) == sorted(brute)


def test_hard_rows(spark, docs):
    rows = [(1, None, "s"), (2, "", None), (3, "<|endoftext|> <s> <0x0A>", "s"), (4, "the same words, the same", "s"), (4, "the same words, the same", "s"),
            (None, "a null id", "s"), (5, " \n\n x\r\n", "s"), (6, "▁ is a sign of its own", "s"), (7, "日本語 😀 " * 30, None)]
    plain = [(i, t) for i, t, _ in rows]
    assert got(alignment.compare(docs(rows), A_PATH, B_PATH)) == expected(plain)
    # texts and blocks in parts
    assert got(alignment.compare(docs(rows), A_PATH, B_PATH, row_pairs=3, block_links=10)) == expected(plain)
    assert got(alignment.compare(docs([]), A_PATH, B_PATH)) == []


def test_parts_and_blocks():
    rows = alignment._Rows(3)
    rows.block(7, [np.array([5, 5, 1, 9]), np.array([9, 2])])
    batch = rows.batch().to_pylist()
    assert [(r["block"], r["row"], r["pairs"], r["times"]) for r in batch] == [(7, None, [1, 2, 5], [1, 1, 2]), (7, None, [9], [2])]


def test_long_text(spark, docs):
    text = "".join(f"word{k} and more; " for k in range(60_000)) + "x" * 50_000
    out = alignment.compare(docs([(1, text, "s")]), A_PATH, B_PATH).collect()[0]
    assert out.n_a == len(A.encode(" " + text, add_special_tokens=False).ids) and out.n_b == len(B.encode(text))
    assert out.n_links == out.n_a + out.n_b - out.n_groups


def test_given_documents(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 1_500]  # every token against every token is slow
    small = spark.createDataFrame(short, "doc_id long, text string").repartition(3)
    assert got(alignment.compare(small, A_PATH, B_PATH)) == expected(short)
    out = {r.doc_id: r for r in queries.op11_token_alignment(spark, data).collect()}
    assert len(out) == len(rows)
    for i, text in rows:
        if text:
            assert (out[i].n_a, out[i].n_b) == (len(A.encode(" " + text, add_special_tokens=False).ids), len(B.encode(text)))


@pytest.mark.parametrize("text", ["<|endoftext|>", "  two", "tab\tand\nline"])
def test_texts_come_back(text):
    assert next(ALIGNER.texts([text]))[0] > 0
