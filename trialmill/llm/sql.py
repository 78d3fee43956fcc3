"""What SQL can say of the queries of this package.

Missing are those whose results rest on training (toxicity, page text), on merges by rank (byte-level BPE) or on
a search that may miss (vantage-point trees): tests compare them with plain loops.
"""

from __future__ import annotations

from . import line_templates as lines
from . import mixing, url_terms

SQL: dict[str, str] = {}

SQL["op1_line_templates"] = rf"""
WITH split AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
    FROM documents
), masked AS (
    SELECT doc_id, text, line_no, raw,
           regexp_replace(trim(regexp_replace(raw, '{lines.BLANKS}', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '{lines.FIELD}', 'g') AS line
    FROM split
), placed AS (
    SELECT *, len(string_split(line, ' ')) AS n, string_split(line, ' ')[1:{lines.DEPTH}] AS lead
    , CASE WHEN len(string_split(line, ' ')) >= {lines.LONG_TOKENS} THEN {lines.LONG_TEXTS} ELSE {lines.MIN_TEXTS} END AS needed
    FROM masked WHERE line <> ''
), distinct_lines AS (
    SELECT n, lead, line, needed, count(DISTINCT text) AS texts FROM placed GROUP BY n, lead, line, needed
), wanted AS (
    SELECT * FROM distinct_lines WHERE n >= {lines.MIN_TOKENS}
), tokens AS (
    SELECT * FROM (
        SELECT n, lead, line, needed, texts, unnest(string_split(line, ' ')) AS token,
               generate_subscripts(string_split(line, ' '), 1) AS place
        FROM wanted
    ) WHERE place > {lines.DEPTH}
), fixed AS (
    SELECT * FROM (
        SELECT n, lead, place, token, needed, sum(texts) AS support FROM tokens
        WHERE token <> '{lines.FIELD}' GROUP BY n, lead, place, token, needed
    ) WHERE support >= needed
    QUALIFY row_number() OVER (PARTITION BY n, lead, place ORDER BY support DESC, token) = 1
), agreed AS (
    SELECT t.n, t.lead, t.line, count(*) FILTER (f.token = t.token) >= (t.n - {lines.DEPTH}) * {lines.AGREEMENT} AS member
    FROM tokens t LEFT JOIN fixed f ON f.n = t.n AND f.lead = t.lead AND f.place = t.place
    GROUP BY t.n, t.lead, t.line
), grouped AS (
    SELECT n, lead, line, CASE WHEN NOT member THEN line END AS own FROM agreed
    UNION ALL SELECT n, lead, line, line FROM distinct_lines WHERE n < {lines.MIN_TOKENS}
), recurring AS (
    SELECT n, lead, own FROM placed JOIN grouped USING (n, lead, line) GROUP BY n, lead, own, needed HAVING count(DISTINCT text) >= needed
), gone AS (
    SELECT DISTINCT doc_id, line_no FROM (
        SELECT doc_id, line_no, min(row(doc_id, line_no)) OVER (PARTITION BY p.n, p.lead, g.own) AS first
        FROM placed p JOIN grouped g USING (n, lead, line)
        JOIN recurring r ON r.n = p.n AND r.lead = p.lead AND r.own IS NOT DISTINCT FROM g.own
    ) WHERE row(doc_id, line_no) <> first
), kept AS (
    SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) FILTER (g.line_no IS NULL) AS text,
           count(g.line_no) AS dropped, count(*) AS n
    FROM split LEFT JOIN gone g USING (doc_id, line_no) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n, 0)::INT AS n_lines, coalesce(k.dropped, 0)::INT AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

SQL["op2_ngram_trie_join"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), grams AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram
    FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
    JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
    WHERE 100 * least(s.n, t.n) >= 85 * greatest(s.n, t.n)
    GROUP BY a.doc_id, b.doc_id, s.n, t.n
    HAVING 100 * count(*) >= 85 * (s.n + t.n - count(*))
), reach AS (
    SELECT doc_id AS node, doc_id AS other FROM documents
    UNION
    SELECT node, b FROM reach JOIN links ON a = other
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, low AS component_id
FROM (SELECT node AS doc_id, min(other) AS low FROM reach GROUP BY node) LEFT JOIN sizes USING (doc_id)
"""


def _terms(terms: tuple[str, ...]) -> str:
    """Terms with free borders in the lower-cased URL `u`, joined by commas."""
    cases = ", ".join(f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN '{t}' END" for t in sorted(terms))
    return f"array_to_string(list_filter([{cases}], lambda t: t IS NOT NULL), ',')"


def _rule_cases(rules: dict[str, str], result: str) -> str:
    out = []
    for rule, verdict in sorted(rules.items(), key=lambda r: (-len(r[0]), r[0])):
        at = rule.index("/")
        fits = f"(host = '{rule[:at]}' OR ends_with(host, '.{rule[:at]}')) AND starts_with(path, '{rule[at:]}')"
        out.append(f"WHEN {fits} THEN '{rule if result == 'rule' else verdict}'")
    return "CASE " + " ".join(out)


def op3(rules: dict[str, str]) -> str:
    """SQL of the URL filter for a set of rules."""
    lower = f"translate({{}}, '{url_terms.UPPER}', '{url_terms.LOWER}')"
    soft = _terms(url_terms.SOFT)
    return rf"""
WITH parts AS (
    SELECT page_id, coalesce({lower.format("url")}, '') AS u,
           CASE WHEN instr(url, '://') > 0 THEN {lower.format(r"regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1)")} ELSE '' END AS host,
           CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages
), terms AS (SELECT *, {_terms(url_terms.STRICT)} AS strict_terms, {soft} AS soft_terms FROM parts)
SELECT page_id, host, path, {_rule_cases(rules, "rule")} END AS rule,
       {_rule_cases(rules, "verdict")} WHEN strict_terms <> '' OR (soft_terms <> '' AND len(string_split(soft_terms, ',')) >= {url_terms.SOFT_HITS})
       THEN 'block' ELSE 'allow' END AS verdict, strict_terms, soft_terms
FROM terms
"""


SQL["op6_chat_prefix"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, row_number() OVER whole AS k, role = 'assistant' AS reply,
           length('### : ' || ' </turn>' || chr(10))
           + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c'))
           + length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')) AS chars
    FROM turns WINDOW whole AS (PARTITION BY conv_id ORDER BY turn, role, text)
), placed AS (
    SELECT *, sum(chars) OVER upto AS so_far, max(CASE WHEN reply THEN k ELSE 0 END) OVER (PARTITION BY conv_id) AS last_reply
    FROM sized WINDOW upto AS (PARTITION BY conv_id ORDER BY k)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (reply), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (reply), '')) AS loss_sha256,
       (coalesce(sum(so_far) FILTER (reply), 0) + coalesce(sum(chars) FILTER (k > last_reply), 0))::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""

SQL["op7_source_mix"] = rf"""
WITH sizes AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT // {1 << (32 - mixing.BITS)} AS place
    FROM documents
), sources AS (
    SELECT source, sum(size) AS n, [{", ".join(map(str, mixing.WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS weight
    FROM sizes GROUP BY source
), levels AS (
    SELECT *, (sum(n) OVER () - coalesce(sum({mixing.MOST} * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
           row_number() OVER o AS k
    FROM sources WINDOW o AS (ORDER BY {mixing.MOST} * n / weight, source NULLS LAST)
), common AS (SELECT arg_min(level, k) AS level FROM levels WHERE level * weight <= {mixing.MOST} * n),
aims AS (
    SELECT source, n, coalesce(least({mixing.MOST} * n::DOUBLE, common.level * weight), {mixing.MOST} * n::DOUBLE) AS target,
           CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END::BIGINT AS rounds, target - rounds * n AS budget
    FROM levels, common
), places AS (
    SELECT source, place, sum(size) AS words FROM sizes GROUP BY ALL
), sums AS (
    SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM places
), cuts AS (
    SELECT a.source, any_value(budget) - coalesce(max(upto) FILTER (upto <= budget), 0) AS rest,
           min(place) FILTER (upto > budget) AS edge, arg_min(words, place) FILTER (upto > budget) AS words
    FROM aims a LEFT JOIN sums s ON a.source IS NOT DISTINCT FROM s.source GROUP BY a.source
)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target,
       (size * (rounds + CASE WHEN edge IS NULL OR place < edge OR (place = edge AND words < 2 * rest) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sizes z JOIN aims a ON z.source IS NOT DISTINCT FROM a.source JOIN cuts c ON z.source IS NOT DISTINCT FROM c.source
"""

SQL["op9_pivot_table"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, x.v) DESC, x.vec_id)::INT AS rank,
       x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
WHERE q.vec_id % 50 = 0
QUALIFY rank <= 5
"""
