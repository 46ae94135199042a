"""Upper tails of the t, F and chi-square distributions: continued fractions over numpy arrays, as scalar pandas UDFs."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for t in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    value = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - value, value)


def gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularised incomplete gamma function, by series below a + 1 and continued fraction above."""
    out = []
    for s, v in zip(np.ravel(np.asarray(a, float)), np.ravel(np.asarray(x, float))):
        if not v > 0:
            out.append(1.0 if v == v else math.nan)
            continue
        front = math.exp(-v + s * math.log(v) - math.lgamma(s))
        if v < s + 1:
            term = total = 1 / s
            k = s
            while abs(term) > 1e-16 * abs(total):
                k += 1
                term *= v / k
                total += term
            out.append(1 - front * total)
        else:
            b = v + 1 - s
            c, d = 1e300, 1 / b
            h = d
            for i in range(1, 500):
                an = -i * (i - s)
                b += 2
                d = 1 / (an * d + b)
                c = b + an / c
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            out.append(front * h)
    return np.array(out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p of a t column; null where t or df is."""

    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = (t.notna() & df.notna()).to_numpy()
        return pd.Series(t_two_sided(t.fillna(0), df.fillna(1))).where(ok, None)

    return F.pandas_udf(run, "double")(t, df)


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    """The square of a standard normal has one degree of freedom."""
    return gamma_q(np.full(len(z), 0.5), np.asarray(z, float) ** 2 / 2)


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal column; null where z is."""

    def run(z: pd.Series) -> pd.Series:
        return pd.Series(normal_two_sided(z.fillna(0).to_numpy())).where(z.notna().to_numpy(), None)

    return F.pandas_udf(run, "double")(z.cast("double"))


@lru_cache(maxsize=512)
def rank_sum_law(m: int, n: int) -> np.ndarray:
    """P(U <= u) for u from 0 to m n without ties: the choices of m among m + n ranks by their sum, counted in whole numbers.

    Their generating function is the product over i of (1 - q**(n + i)) / (1 - q**i).
    """
    size = m * n + 1
    ways = [1] + [0] * (size - 1)
    for i in range(1, m + 1):
        for u in range(size - 1, n + i - 1, -1):
            ways[u] -= ways[u - n - i]
        for u in range(i, size):
            ways[u] += ways[u - i]
    total = math.comb(m + n, m)
    below, upto = [], 0
    for w in ways:
        upto += w
        below.append(upto / total)
    return np.array(below)


#: From this many values on in either sample the normal law is used.
RANK_SUM_EXACT = 50


def rank_sum_two_sided(u: float, m: int, n: int, ties: bool, sd: float | None) -> float | None:
    """Two-sided p of a rank sum: exact for small samples without ties, else normal with the tie-corrected deviation ``sd`` and half a rank's correction."""
    if not ties and m < RANK_SUM_EXACT and n < RANK_SUM_EXACT:
        low = u if u <= m * n / 2 else m * n - u  # the law is symmetric
        return min(1.0, 2 * float(rank_sum_law(min(m, n), max(m, n))[round(low)]))
    if not sd:
        return None
    away = u - m * n / 2
    return math.erfc(max(0.0, abs(away) - 0.5) / sd / math.sqrt(2))


def rank_sum_p(u: Column, m: Column, n: Column, ties: Column, sd: Column) -> Column:
    """A row per test, not per value."""

    def run(u: pd.Series, m: pd.Series, n: pd.Series, ties: pd.Series, sd: pd.Series) -> pd.Series:
        return pd.Series([rank_sum_two_sided(a, int(b), int(c), bool(d), None if pd.isna(e) else e) for a, b, c, d, e in zip(u, m, n, ties, sd)], dtype=float)

    return F.pandas_udf(run, "double")(u.cast("double"), m, n, ties, sd.cast("double"))


def chi2_p(x: Column, df: Column) -> Column:
    """Upper tail; null where x or df is."""

    def run(x: pd.Series, df: pd.Series) -> pd.Series:
        ok = (x.notna() & df.notna()).to_numpy()
        return pd.Series(gamma_q(df.fillna(1).to_numpy(float) / 2, x.fillna(0).to_numpy(float) / 2)).where(ok, None)

    return F.pandas_udf(run, "double")(x, df.cast("double"))


def benjamini_hochberg(rows: DataFrame, p: str, by: list[str], q: str = "q_value") -> DataFrame:
    """Step-up adjusted values over the non-null p of each group; null p keep a null q."""
    known = Window.partitionBy(*by, F.col(p).isNull())
    rank = F.row_number().over(known.orderBy(p))
    rows = rows.withColumn("_raw", F.col(p) * F.count(p).over(known) / rank).withColumn("_rank", rank)
    upward = known.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.min("_raw").over(upward), F.lit(1.0)))).drop("_raw", "_rank")


def bonferroni(p: Column, tests: Column) -> Column:
    """p times the number of tests, 1 at most; null where p is (``least`` alone would skip it)."""
    return F.when(p.isNotNull(), F.least(p * tests, F.lit(1.0)))


def adjusted(rows: DataFrame, p: str, by: list[str], method: str = "fdr", further: int = 1, out: str = "p_fully_adjusted") -> DataFrame:
    """``rows`` with p adjusted within each group ("fdr", or "bonferroni" by the group's number of known p, or "none"), then times the ``further`` comparisons made beside it, 1 at most."""
    match method:
        case "fdr":
            rows = benjamini_hochberg(rows, p, by, out)
        case "bonferroni":
            rows = rows.withColumn(out, bonferroni(F.col(p), F.count(p).over(Window.partitionBy(*by))))
        case "none":
            rows = rows.withColumn(out, F.col(p))
        case _:
            raise ValueError(method)
    return rows.withColumn(out, F.when(F.col(out).isNotNull(), F.least(F.col(out) * further, F.lit(1.0))))
