"""ANOVA of any number of levels within and between subjects, from one aggregate of cross-products."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import beta_upper, eta2_interval


def orthonormal(levels: int) -> np.ndarray:
    """levels - 1 columns of length one, at right angles to each other and to the mean: each level against those before."""
    out = np.zeros((levels, levels - 1))
    for k in range(1, levels):
        out[:k, k - 1], out[k, k - 1] = 1.0, -float(k)
        out[:, k - 1] /= np.sqrt(k * (k + 1.0))
    return out


def subsets(names: Sequence[str]) -> list[tuple[str, ...]]:
    return [c for size in range(len(names) + 1) for c in itertools.combinations(names, size)]


def anova(
    df: DataFrame,
    dv: str,
    subject: str,
    within: Mapping[str, Sequence[object]] | None = None,
    between: str | Sequence[str] = (),
    by: Sequence[str] = (),
    level: float = 0.9,
) -> DataFrame:
    """Mixed ANOVA with type II sums of squares: a row per effect, and per group of `by`.

    `within` names the levels of each factor within subjects; factors `between` them take their levels from the
    data and may have unequal groups. A subject's values in a cell are averaged; a subject that lacks a cell, or
    has no value for a factor between, is left out. Columns: effect, ss, ss_error, df1, df2, f, p, eta2 (partial),
    eta2_low and eta2_high (its interval at `level`, with corrected degrees of freedom), ges (generalised), and
    for effects with several contrasts gg and hf (Greenhouse and Geisser's, Huynh and Feldt's epsilon) with p_gg
    and p_hf. Without spread or degrees of freedom f and what rests on it are missing.

    Subjects shrink to one row of cell means and groups to means and covariances of the cells, in one aggregate
    that combines before it shuffles. What follows is arithmetic on one row per combination of factors between.
    """
    factors = {k: list(v) for k, v in (within or {}).items()}
    groups, by = [between] if isinstance(between, str) else list(between), list(by)
    combos = list(itertools.product(*factors.values()))
    keys = [*by, *groups]
    cells = []
    for i, combo in enumerate(combos):
        here = reduce(lambda a, b: a & b, [F.col(f) == F.lit(v) for f, v in zip(factors, combo)], F.lit(True))
        cells.append(F.avg(F.when(here, F.col(dv)).cast("double")).alias(f"_cell{i}"))
    names = [f"_cell{i}" for i in range(len(combos))]
    subjects = df.groupBy(*keys, subject).agg(*cells).dropna(subset=[*names, *groups])
    pairs = [F.coalesce(F.covar_samp(a, b), F.lit(0.0)) for i, a in enumerate(names) for b in names[i:]]
    sums = subjects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(c) for c in names]).alias("_means"), F.array(*pairs).alias("_covariances")
    ).where(F.col("_n") > 0)

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(effects(rows, {f: len(v) for f, v in factors.items()}, groups, level))
        for c in out.columns:
            if c not in ("effect", "df1", "df2"):
                out[c] = pd.Series(out[c], dtype="Float64")  # missing, not NaN
        for k, c in enumerate(by):
            out.insert(k, c, rows[c].iloc[0])
        return out

    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "effect string, ss double, ss_error double, df1 long, df2 long",
                        *[f"{c} double" for c in ("f", "p", "eta2", "eta2_low", "eta2_high", "ges", "gg", "hf", "p_gg", "p_hf")]])
    return sums.groupBy(*by).applyInPandas(table, schema)


def _projector(rows: pd.DataFrame, terms: list[tuple[str, ...]], root: np.ndarray) -> tuple[np.ndarray, int]:
    """Projection of weighted group means on the indicators of the terms, and its rank."""
    columns = []
    for term in terms:
        codes = rows.groupby(list(term), sort=False).ngroup().to_numpy() if term else np.zeros(len(rows), int)
        columns.append((codes[:, None] == np.arange(codes.max() + 1)).astype(float))
    if not columns:
        return np.zeros((len(rows), len(rows))), 0
    u, s, _ = np.linalg.svd(np.hstack(columns) * root[:, None], full_matrices=False)
    u = u[:, s > 1e-10 * s[0]]
    return u @ u.T, u.shape[1]


def effects(rows: pd.DataFrame, levels: Mapping[str, int], groups: Sequence[str], level: float) -> list[dict]:
    """The rows of the ANOVA table from the groups' sizes, cell means and covariances."""
    n = rows["_n"].to_numpy(float)
    root, m = np.sqrt(n), int(np.prod([1, *levels.values()]))
    means = np.stack([np.asarray(v, float) for v in rows["_means"]])
    scatter = np.zeros((m, m))
    upper = np.triu_indices(m)
    for size, covariances in zip(n, rows["_covariances"]):
        scatter[upper] += (size - 1.0) * np.asarray(covariances, float)
    scatter = np.triu(scatter) + np.triu(scatter, 1).T
    rest = int(n.sum()) - len(rows)
    # type II: a term against the model of all terms that do not contain it
    tested = []
    for term in subsets(groups):
        free = [t for t in subsets(groups) if not set(term) <= set(t)]
        (small, r0), (large, r1) = _projector(rows, free, root), _projector(rows, [*free, term], root)
        tested.append((term, large - small, r1 - r0))
    out, errors = [], 0.0
    for chosen in subsets(list(levels)):
        contrast = np.ones((1, 1))
        for factor, count in levels.items():
            contrast = np.kron(contrast, orthonormal(count) if factor in chosen else np.full((count, 1), 1.0 / np.sqrt(count)))
        width = contrast.shape[1]
        error = contrast.T @ scatter @ contrast
        ss_error, df2 = float(np.trace(error)), rest * width
        errors += ss_error
        gg = hf = np.nan
        if width > 1 and rest > 0 and ss_error > 0:
            gg = ss_error**2 / (width * float((error * error).sum()))
            beyond = width * (rest - width * gg)
            hf = min(1.0, ((rest + 1) * width * gg - 2.0) / beyond) if beyond > 0 else 1.0
        z = (means @ contrast) * root[:, None]
        for term, projection, rank in tested:
            ss, df1 = float(np.sum(z * (projection @ z))), rank * width
            usable = ss_error > 0 and df1 > 0 and df2 > 0
            f = ss / df1 / (ss_error / df2) if usable else np.nan
            shrink = gg if np.isfinite(gg) else 1.0
            low, high = (float(v[0]) for v in eta2_interval(np.array([f]), np.array([df1 * shrink]), np.array([df2 * shrink]), level))
            row = {"effect": ":".join([*term, *chosen]) or "(Intercept)", "ss": ss, "ss_error": ss_error, "df1": df1, "df2": df2, "f": f}
            row |= {"p": _p(f, df1, df2), "eta2": ss / (ss + ss_error) if ss + ss_error > 0 else np.nan, "eta2_low": low, "eta2_high": high, "ges": np.nan}
            out.append(row | {"gg": gg, "hf": hf, "p_gg": _p(f, df1 * gg, df2 * gg), "p_hf": _p(f, df1 * hf, df2 * hf)})
    for row in out:
        row["ges"] = row["ss"] / (row["ss"] + errors) if row["ss"] + errors > 0 else np.nan
    return out


def _p(f: float, df1: float, df2: float) -> float:
    if not np.isfinite([f, df1, df2]).all() or df1 <= 0 or df2 <= 0:
        return np.nan
    return float(beta_upper(np.array([df2 / 2.0]), np.array([df1 / 2.0]), np.array([df2 / (df2 + df1 * max(f, 0.0))]))[0])
