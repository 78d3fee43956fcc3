"""Host rules and a weighted vocabulary of terms for URLs.

Rules decide first: the longest rule that fits host and path. Other URLs are searched for strict and soft terms
with one Aho-Corasick automaton. A hit counts where no letter or digit stands beside it. One strict hit or
several distinct soft hits reject the URL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms that reject alone, terms that reject together.
STRICT = ("adult", "casino", "porn", "sex", "viagra", "xxx")
SOFT = (
    "ads", "bet", "bets", "bonus", "cheap", "click", "escort", "farm", "free", "jackpot",
    "loan", "loans", "pills", "poker", "replica", "spam", "track", "tracker", "win",
)
#: Distinct soft terms that reject a URL.
SOFT_HITS = 2


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    found.make_automaton()
    return found


def _beside(text: str, at: int) -> bool:
    """Whether a letter or digit stands at a place."""
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def terms_in(url: str | None, terms: tuple[str, ...]) -> list[str]:
    """Distinct terms with free borders in a URL, sorted."""
    if not url or not terms:
        return []
    text = url.translate(str.maketrans(UPPER, LOWER))
    hits = set()
    for end, term in _automaton(terms).iter(text):
        if not _beside(text, end + 1) and not _beside(text, end - len(term)):
            hits.add(term)
    return sorted(hits)


def host_of(url: Column) -> Column:
    """Host: from the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without it."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """Path: what follows the host up to `?`, `#` or the end; empty without `://`."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest rule (a host and the start of a path) that fits; null without one."""
    fits = []
    for rule in sorted(set(rules), key=lambda r: (-len(r), r)):
        at = rule.index("/")
        on = (host == rule[:at]) | F.endswith(host, F.lit(f".{rule[:at]}"))
        fits.append(F.when(on & F.startswith(path, F.lit(rule[at:])), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string")) if fits else F.lit(None).cast("string")


def judge(
    pages: DataFrame,
    rules: Mapping[str, str],
    url: str = "url",
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_hits: int = SOFT_HITS,
) -> DataFrame:
    """Add `host`, `path`, `rule`, `verdict`, `strict_terms` and `soft_terms` to every row.

    `rules` maps a rule such as `example.net/en/` to allow or block. A null URL or one without `://` has an
    empty host and path and meets no rule; a null or empty URL has no terms and is allowed. Equal URLs get equal
    verdicts. Other columns pass unchanged; those with the names of the new ones are replaced. One pass over the
    rows, without a shuffle.
    """
    strict, soft = tuple(sorted(set(strict))), tuple(sorted(set(soft)))
    both = tuple(sorted({*strict, *soft}))

    @F.pandas_udf("array<string>")
    def hits(urls: pd.Series) -> pd.Series:
        return pd.Series([terms_in(u, both) for u in urls], dtype=object)

    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "strict_terms", "soft_terms")]
    at = F.col(url)
    found = pages.select(*kept, host_of(at).alias("host"), path_of(at).alias("path"), hits(at).alias("_hits"))
    found = found.withColumn("rule", rule_of(F.col("host"), F.col("path"), list(rules)))
    pick = lambda terms: F.array_intersect(F.col("_hits"), F.array(*map(F.lit, terms)).cast("array<string>"))
    found = found.withColumns({"strict_terms": pick(strict), "soft_terms": pick(soft)})
    by_terms = F.when((F.size("strict_terms") > 0) | (F.size("soft_terms") >= soft_hits), "block").otherwise("allow")
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()], by_terms)
    return found.withColumn("verdict", by_rule).drop("_hits")
