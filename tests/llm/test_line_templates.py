import collections
import random

from trialmill.llm import line_templates, queries

TEXT = "one line of several words here"


def dedup(docs, rows, **options):
    return {r.doc_id: r for r in line_templates.dedup(docs(rows), **options).collect()}


def test_recurring_line_stays_once(docs):
    rows = [(k, f"own text number {word} is not shared at all\n{TEXT}\nshort", "s") for k, word in enumerate(["a", "b", "c", "d"])]
    out = dedup(docs, rows)
    assert out[0].text == rows[0][1] and out[0].n_dropped == 0
    assert out[2].text == "own text number c is not shared at all\nshort" or TEXT not in out[2].text
    assert all(TEXT not in out[k].text for k in (1, 2, 3))
    assert out[3].n_lines == 3 and out[3].lang == "en" and out[3].template == "x"


def test_variable_fields_are_generalised(docs):
    rows = [(k, f"page {k} of the report about {name} printed on {k}{k}", "s") for k, name in enumerate(["ann", "bob", "cy", "dee"])]
    rows.append((9, "page three of something else that is not like it", "s"))
    out = dedup(docs, rows)
    assert [out[k].n_dropped for k in (0, 1, 2, 3, 9)] == [0, 1, 1, 1, 0]
    assert out[9].text == rows[4][1]


def test_copies_of_a_text_count_once(docs):
    rows = [(k, "a whole text that has many copies\nand one more line in it", "s") for k in range(6)]
    assert all(r.n_dropped == 0 for r in dedup(docs, rows).values())


def test_lines_of_one_leaf_that_differ_stay(docs):
    rows = [(k, f"the same start but {a} {b} {c} {d}", "s") for k, (a, b, c, d) in enumerate(["abcd", "efgh", "ijkl"])]
    assert all(r.n_dropped == 0 for r in dedup(docs, rows, agreement=0.6).values())


def brute(rows):
    """What is dropped, by plain loops: ids and numbers of lines."""
    lines = []
    for i, text, _ in rows:
        for k, raw in enumerate((text or "").split("\n") if text is not None else []):
            tokens = ["<*>" if any(c in "0123456789" for c in t) else t for t in raw.split()]
            if tokens:
                lines.append((i, k, text, tuple(tokens)))
    needed = lambda t: 2 if len(t) >= 50 else 3
    texts = collections.defaultdict(set)
    for _, _, text, tokens in lines:
        texts[tokens].add(text)
    support = collections.defaultdict(collections.Counter)
    for tokens, of in texts.items():
        if len(tokens) >= 5:
            for p in range(3, len(tokens)):
                if tokens[p] != "<*>":
                    support[len(tokens), tokens[:3], p][tokens[p]] += len(of)
    fixed = {}
    for key, counts in support.items():
        enough = [(-n, t) for t, n in counts.items() if n >= (2 if key[0] >= 50 else 3)]
        if enough:
            fixed[key] = min(enough)[1]

    def template(tokens):
        if len(tokens) >= 5:
            same = sum(fixed.get((len(tokens), tokens[:3], p)) == tokens[p] for p in range(3, len(tokens)))
            if same >= (len(tokens) - 3) * 0.6:
                return len(tokens), tokens[:3]
        return tokens

    groups = collections.defaultdict(list)
    for i, k, text, tokens in lines:
        groups[template(tokens)].append((i, k, text, tokens))
    gone = set()
    for members in groups.values():
        if len({text for _, _, text, _ in members}) >= needed(members[0][3]):
            first = min((i, k) for i, k, _, _ in members)
            gone |= {(i, k) for i, k, _, _ in members} - {first}
    return gone


def test_agrees_with_plain_loops(docs):
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "eps1", "z2", "eta"]
    short = ["All rights reserved.", "Read  more", "", "  ", "page 1", "page 22"]
    heads = [["the", "same", "start"], ["one", "other", "start"]]
    passages = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(150):
        lines = [rng.choice(short) for _ in range(rng.randrange(3))]
        lines += [" ".join([*rng.choice(heads), *(rng.choice(words[: rng.choice([2, 7])]) for _ in range(rng.randrange(1, 5)))]) for _ in range(rng.randrange(3))]
        lines += [rng.choice(passages)] if i % 20 == 0 else []
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "s"))
    rows += [(200 + k, rows[3][1], "s") for k in range(5)]
    gone = brute(rows)
    want = {i: "\n".join(line for k, line in enumerate(text.split("\n")) if (i, k) not in gone) for i, text, _ in rows}
    out = dedup(docs, rows)
    assert gone and {i: r.text for i, r in out.items()} == want
    assert sum(r.n_dropped for r in out.values()) == len(gone)


def test_rules_of_recurrence(docs):
    twice = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(55))
    own = ["one two three four five six seven", "eight nine ten and so on here", "what else may stand in this text", "the last of these few texts ends"]
    rows = [(k, f"{own[k]}\nAll rights reserved." + (f"\n{twice}" if k < 2 else ""), "s") for k in range(4)]
    rows.append((9, "ERROR cannot open file alpha\nERROR cannot open file beta\nERROR cannot open file gamma", "s"))
    rows += [(20 + k, f"Was erlytion that. {a}", "s") for k, a in enumerate(["A, reha.", "Ing eresnt.", "Oues ereaha."])]
    out = dedup(docs, rows)
    assert [out[k].text.count("All rights") for k in range(4)] == [1, 0, 0, 0]  # short lines
    assert twice in out[0].text and twice not in out[1].text  # two texts are enough for a long one
    assert out[9].n_dropped == 0  # one text is not several
    assert all(out[20 + k].n_dropped == 0 for k in range(3))  # the leading tokens alone are no agreement


def test_hard_rows(docs):
    long = "word " * 50_000
    rows = [(None, TEXT, "s"), (1, None, "s"), (2, "", None), (3, long + "a", "s"), (4, long + "b", "s"), (5, long + "c", "s"), (6, TEXT + "\n" + TEXT, "s"), (6, TEXT + "\n" + TEXT, "s"), (7, TEXT + "\nmore", "s")]
    out = collections.defaultdict(list)
    for r in line_templates.dedup(docs(rows)).collect():
        out[r.doc_id].append(r)
    assert out[1][0].text is None and out[1][0].n_lines == 0
    assert out[2][0].text == "" and out[2][0].n_lines == 1
    assert [out[k][0].n_dropped for k in (3, 4, 5)] == [0, 1, 1]
    assert len(out[6]) == 2 and out[6][0].text == out[6][1].text
    assert out[None][0].text == TEXT
    assert out[7][0].text == "more"
    assert line_templates.dedup(docs([])).count() == 0


def test_stage_keeps_documents_with_text(spark, docs):
    rows = [(k, TEXT + (f"\nrest {'abc'[k]}" if k < 3 else ""), "s") for k in range(4)] + [(8, "", "s"), (9, None, "s")]
    out = {r.doc_id: r for r in queries.drop_lines(spark, docs(rows), "").collect()}
    assert set(out) == {0, 1, 2, 8, 9} and out[1].text == "rest b" and out[1].n_chars == 6
