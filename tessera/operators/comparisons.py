"""Group comparisons: pooled and paired t, Welch, Hotelling, KS, Anderson-Darling, rank tests. Sums are Spark aggregations; small matrices numpy."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tails import benjamini_hochberg, chi2_p, f_upper, rank_sum_p, t_p
from tessera.sources.staging import inline

#: Comparison -> its two sides, as lists of genotypes.
TAGS = {
    "oo": (["hoDQ2"], ["hoDQ8"]),
    "eo": (["heDQ2DQ8"], ["hoDQ2", "hoDQ8"]),
    "do": (["heDQ2DQ8"], ["hoDQ8"]),
    "po": (["heDQ2DQ8"], ["hoDQ2"]),
}


def all_pairs(genotypes: list[str]) -> dict[str, tuple[list[str], list[str]]]:
    """Every two of the genotypes as a comparison named ``a-b``."""
    names = sorted(genotypes)
    return {f"{a}-{b}": ([a], [b]) for i, a in enumerate(names) for b in names[i + 1 :]}


def _sides(rows: DataFrame, tags: dict | None = None) -> DataFrame:
    """Each row once per comparison and side it belongs to."""
    sides = [(tag, g, side) for tag, pair in (tags or TAGS).items() for side, names in zip("ab", pair) for g in names]
    return rows.join(inline(rows.sparkSession, sides, "tag string, genotype string, side string"), "genotype")


def _two_sided(rows: DataFrame, index: list[str], value: str, tags: dict | None = None) -> DataFrame:
    pick = lambda f, s, name: f(F.when(F.col("side") == s, F.col(value))).alias(name)
    return _sides(rows, tags).groupBy(*index, "tag").agg(*[pick(f, s, f"{n}_{s}") for s in "ab" for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])


def ttest_pooled(values: DataFrame, index: list[str], value: str = "value", least_variance: float = 0.0, tags: dict | None = None) -> DataFrame:
    """Per index and comparison, over samples' means: no row where a side has under 2 samples or a pooled variance of ``least_variance`` or less."""
    means = values.groupBy(*index, "sample_short", "genotype").agg(F.avg(value).alias("v"))
    s = _two_sided(means, index, "v", tags).where("n_a >= 2 AND n_b >= 2")
    df = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / df
    s = s.withColumn("df", df).withColumn("pooled", pooled).where(F.col("pooled") > least_variance)
    diff = F.col("mean_a") - F.col("mean_b")
    return s.select(*index, "tag", "n_a", "n_b", "mean_a", "mean_b", (diff / F.sqrt("pooled")).alias("cohen_d"), (diff / F.sqrt(F.col("pooled") * (1 / F.col("n_a") + 1 / F.col("n_b")))).alias("t"), F.col("df").cast("long").alias("df"))


def welch(values: DataFrame, index: list[str], value: str = "value", tags: dict | None = None) -> DataFrame:
    """Welch's t with Satterthwaite's df and Cohen's d by pooled deviation; null where undefined."""
    s = _two_sided(values.where(F.col(value).isNotNull()), index, value, tags)
    qa, qb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    ok = (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (qa + qb > 0)
    df = F.try_divide((qa + qb) * (qa + qb), qa * qa / (F.col("n_a") - 1) + qb * qb / (F.col("n_b") - 1))
    pooled = F.sqrt(F.try_divide((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"), F.col("n_a") + F.col("n_b") - 2))
    diff = F.col("mean_a") - F.col("mean_b")
    return s.select(*index, "tag", "n_a", "n_b", "mean_a", "mean_b", diff.alias("diff"), F.when(ok, F.try_divide(diff, pooled)).alias("cohen_d"), F.when(ok, F.try_divide(diff, F.sqrt(qa + qb))).alias("t"), F.when(ok, df).alias("df"))


def with_t_p(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A table of t and df with the two-sided ``p_value`` and, given ``by``, the ``q_value`` within those columns' groups."""
    out = stats.withColumn("p_value", t_p(F.col("t"), F.col("df").cast("double")))
    return out if by is None else benjamini_hochberg(out, "p_value", by)


def ttest_paired(values: DataFrame, index: list[str], value: str = "value") -> DataFrame:
    """E minus N within patients, per index and stratum (all, and each genotype); strata with 2 pairs or more."""
    by_cells = values.groupBy(*index, "patient", "genotype").agg(*[F.avg(F.when(F.col("cells") == c, F.col(value))).alias(c) for c in "EN"])
    pairs = by_cells.where("E IS NOT NULL AND N IS NOT NULL").select(*index, (F.col("E") - F.col("N")).alias("d"), F.explode(F.array(F.lit("all"), "genotype")).alias("stratum"))
    s = pairs.groupBy(*index, "stratum").agg(F.count("*").alias("n_pairs"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff")).where("n_pairs >= 2")
    t = F.when(F.col("sd_diff") > 0, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n_pairs")))
    return s.select(*index, "stratum", "n_pairs", "mean_diff", "sd_diff", t.alias("t"), (F.col("n_pairs") - 1).alias("df"))


def hotelling_stat(a: np.ndarray, b: np.ndarray) -> tuple | None:
    """T2, F, df1, df2, p and eta2 of two samples; None where undefined."""
    na, nb, p = len(a), len(b), a.shape[1] if len(a) else 0
    if min(na, nb) < 2 or na + nb - 2 < p or na + nb - p - 1 <= 0:
        return None
    pooled = ((na - 1) * np.cov(a, rowvar=False).reshape(p, p) + (nb - 1) * np.cov(b, rowvar=False).reshape(p, p)) / (na + nb - 2)
    if np.linalg.cond(pooled) > 1e12:
        return None
    diff = a.mean(0) - b.mean(0)
    t2 = float(na * nb / (na + nb) * diff @ np.linalg.solve(pooled, diff))
    df2 = na + nb - p - 1
    f = t2 * df2 / ((na + nb - 2) * p)
    return t2, f, p, df2, float(f_upper(f, p, df2)), t2 / (t2 + na + nb - 2)


def hotelling(wide: DataFrame, index: list[str], props: list[str], tags: dict | None = None) -> DataFrame:
    """Per index and comparison, over rows without null properties; a group has one row per sample."""
    schema = ", ".join([f"{c} {t}" for c, t in wide.select(*index).dtypes]) + ", tag string, T2 double, F double, df1 long, df2 long, p double, eta2 double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf.loc[pdf["side"] == s, props].to_numpy(float) for s in "ab"]
        stat = hotelling_stat(*sides) or (None,) * 6
        return pd.DataFrame([[*pdf.loc[pdf.index[0], [*index, "tag"]], *stat]], columns=[*index, "tag", "T2", "F", "df1", "df2", "p", "eta2"]).astype({"df1": "Int64", "df2": "Int64"})

    return _sides(wide.dropna(subset=props), tags).groupBy(*index, "tag").applyInPandas(run, schema)


def property_tables(wide: DataFrame, index: list[str], prefix: str = "PP", q_by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(Hotelling's tests, tests per property) side by side, a column per value and comparison, over rows without null properties.

    Properties are the columns of the prefix. q values are adjusted within each comparison (and ``q_by``); the second table also
    has each index's ``p_hotelling`` and ``q_hotelling``.
    """
    props = sorted(c for c in wide.columns if c.startswith(prefix))
    if not props:
        raise ValueError(f"no column begins with {prefix}")
    whole, groups = wide.dropna(subset=props), ["tag", *(q_by or [])]
    joint = benjamini_hochberg(hotelling(whole, index, props).withColumnRenamed("p", "p_value"), "p_value", groups)
    rest = [c for c in whole.columns if c not in props]
    each = with_t_p(welch(whole.unpivot(rest, props, "prop", "value"), [*index, "prop"]), groups)

    def beside(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.max(F.when(F.col("tag") == t, F.col(v))).alias(f"{v}_{t}") for t in TAGS for v in values])

    one = beside(joint, index, ["T2", "F", "df1", "df2", "p_value", "eta2", "q_value"])
    two = beside(each, [*index, "prop"], ["n_a", "n_b", "mean_a", "mean_b", "diff", "cohen_d", "t", "df", "p_value", "q_value"])
    tests = one.select(*index, *[F.col(f"{v}_value_{t}").alias(f"{v}_hotelling_{t}") for t in TAGS for v in "pq"])
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in index]
    return one, two.alias("a").join(tests.alias("b"), same, "left").select("a.*", *[f"b.{v}_hotelling_{t}" for t in TAGS for v in "pq"])


def ks_stat(freqs: DataFrame, split: list[str], genotypes: tuple[str, ...] = ("hoDQ2", "hoDQ8", "heDQ2DQ8")) -> DataFrame:
    """Largest distance between every two of the genotypes' cumulated mean length distributions. ``freqs``: split, genotype, sample_short, len, value."""
    samples = freqs.groupBy(*split, "genotype").agg(F.countDistinct("sample_short").alias("n"))
    mean = freqs.groupBy(*split, "genotype", "len").agg(F.sum("value").alias("s")).join(samples, [*split, "genotype"])
    mean = mean.select(*split, "genotype", "len", (F.col("s") / F.col("n")).alias("m"))
    norm = mean.withColumn("m", F.col("m") / F.sum("m").over(Window.partitionBy(*split, "genotype")))
    col = lambda g: F.sum(F.when(F.col("genotype") == g, F.col("m")).otherwise(0.0))
    names = list(genotypes)
    at = norm.groupBy(*split, "len").agg(*[col(g).alias(g) for g in names])
    w = Window.partitionBy(*split).orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    cdf = at.select(*split, *[F.sum(g).over(w).alias(g) for g in names])
    pairs = F.inline(F.array(*[F.struct(F.lit(a).alias("group1"), F.lit(b).alias("group2"), F.abs(F.col(a) - F.col(b)).alias("d")) for i, a in enumerate(names) for b in names[i + 1 :]]))
    return cdf.select(*split, pairs).groupBy(*split, "group1", "group2").agg(F.max("d").alias("ks"))


def ks_distances(table: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest distance between the cumulated profiles of two groups of samples, for each choice (a row of ``first``: 1 where a sample is in the first group). ``table``: samples by lengths."""
    upto = [np.cumsum(part @ table, axis=1) for part in (first, 1.0 - first)]
    one, two = (np.divide(u, u[:, -1:], out=np.full_like(u, np.nan), where=u[:, -1:] > 0) for u in upto)
    return np.abs(one - two).max(axis=1)


def ks_permuted(freqs: DataFrame, n_perm: int = 10_000, seed: int = 42, plus_one: bool = True, split: tuple[str, ...] = (), min_samples: int = 3, rounds: int = 1000) -> DataFrame:
    """Per split, permutation p of ``ks_stat`` for each pair of genotypes with ``min_samples`` samples or more each.

    Labels are permuted in tasks of ``rounds`` rounds, each of which holds its split's samples by lengths (some dozens).
    ``plus_one``: the labels as they are count as one more permutation; else p is the plain share of permutations.
    """
    tasks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, -(-n_perm // rounds)) - 1).cast("long")))
    dealt = freqs.select(*split, "genotype", "sample_short", "len", "value", tasks.alias("task"))
    kinds = dict(freqs.dtypes)
    head = "".join(f"`{c}` {kinds[c]}, " for c in split)
    columns = [*split, "group1", "group2", "ks", "hits"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *of, task = key
        wide = pdf.pivot_table(index=["genotype", "sample_short"], columns="len", values="value", aggfunc="sum", fill_value=0).sort_index()
        label, table = wide.index.get_level_values(0).to_numpy(), wide.to_numpy(float)
        names = [g for g in np.unique(label) if (label == g).sum() >= min_samples]
        out = []
        for i, j in combinations(range(len(names)), 2):
            own = np.isin(label, (names[i], names[j]))
            part, mark = table[own], (label[own] == names[i]).astype(float)
            ks = ks_distances(part, mark[None])[0]
            order = np.random.default_rng([seed, task, i, j]).random((min(rounds, n_perm - task * rounds), len(mark))).argsort(axis=1)
            # equal labels may sum up in another order
            out.append([*of, names[i], names[j], ks, int((ks_distances(part, mark[order]) >= ks - 1e-12).sum())])
        return pd.DataFrame(out, columns=columns)

    found = dealt.groupBy(*split, "task").applyInPandas(run, head + "group1 string, group2 string, ks double, hits long")
    hits = found.groupBy(*split, "group1", "group2").agg(F.max("ks").alias("ks"), F.sum("hits").alias("hits"))
    p = (F.col("hits") + 1) / (n_perm + 1) if plus_one else F.col("hits") / n_perm
    return hits.select(*split, "group1", "group2", "ks", p.alias("p_perm"))


def ad_histogram(freqs: DataFrame, pseudo_n: int = 1000) -> DataFrame:
    """(genotype, len, f): each sample's frequencies as ``pseudo_n`` whole observations by largest remainder, summed by group."""
    w = Window.partitionBy("sample_short")
    rows = freqs.withColumn("share", F.col("value") / F.sum("value").over(w) * pseudo_n).withColumn("low", F.floor("share"))
    rest = F.lit(pseudo_n) - F.sum("low").over(w)
    rank = F.row_number().over(w.orderBy((F.round(F.col("share") - F.col("low"), 9)).desc(), F.col("len").desc()))
    return rows.select("sample_short", "genotype", "len", (F.col("low") + (rank <= rest).cast("long")).alias("k")).groupBy("genotype", "len").agg(F.sum("k").alias("f")).where("f > 0")


def ad_stat(hist: DataFrame) -> DataFrame:
    """k-sample Anderson-Darling statistic with midranks from a histogram (genotype, len, f); lengths are a few dozen."""
    groups, lens = hist.groupBy("genotype").agg(F.sum("f").alias("n")), hist.groupBy("len").agg(F.sum("f").alias("l"))
    grid = groups.crossJoin(lens).join(hist, ["genotype", "len"], "left").na.fill(0, ["f"])
    by = Window.partitionBy("genotype").orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("l").over(Window.partitionBy("genotype")).cast("double")
    grid = grid.select("*", total.alias("total"), (F.sum("f").over(by) - F.col("f") / 2).alias("M"), (F.sum("l").over(by) - F.col("l") / 2).alias("B"))
    d = F.col("total") * F.col("M") - F.col("n") * F.col("B")
    term = F.try_divide(F.col("l") / F.col("total") * d * d, F.col("B") * (F.col("total") - F.col("B")) - F.col("total") * F.col("l") / 4)
    return grid.groupBy("genotype", "n", "total").agg(F.sum(term).alias("s")).agg((F.max((F.col("total") - 1) / F.col("total")) * F.sum(F.col("s") / F.col("n"))).alias("A2"), F.count("*").alias("k"))


#: Critical values of the standardised statistic by number of groups, as b0 + b1 / sqrt(k - 1) + b2 / (k - 1), at these levels. Fixed values (Scholz and Stephens 1987).
AD_LEVELS = [0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001]
AD_B0 = [0.675, 1.281, 1.645, 1.96, 2.326, 2.573, 3.085]
AD_B1 = [-0.245, 0.25, 0.678, 1.149, 1.822, 2.364, 3.615]
AD_B2 = [-0.105, -0.305, -0.362, -0.391, -0.396, -0.345, -0.154]


def ad_moments(sizes: np.ndarray) -> float:
    """The standard deviation of the k-sample statistic for samples of these sizes."""
    n, k = int(sizes.sum()), len(sizes)
    inverse = 1 / np.arange(1, n)
    big_h, h = (1 / sizes).sum(), inverse.sum()
    tail = h - np.concatenate([[0], np.cumsum(inverse)])  # sum of 1/j for j > i, at i
    i = np.arange(1, n - 1)
    g = (tail[i] / (n - i)).sum()
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * big_h
    b = (2 * g - 4) * k**2 + 8 * h * k + (2 * g - 14 * h - 4) * big_h - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k**2 + (4 * h - 4 * g + 6) * k + (2 * h - 6) * big_h + 4 * h
    d = (2 * h + 6) * k**2 - 4 * h * k
    return float(np.sqrt((((a * n + b) * n + c) * n + d) / ((n - 1.0) * (n - 2) * (n - 3))))


def ad_statistic(table: np.ndarray) -> float:
    """A2 with midranks of a table of counts (rows: groups, columns: values in order)."""
    table = table[:, table.sum(axis=0) > 0].astype(float)
    size, at = table.sum(axis=1), table.sum(axis=0)
    n = at.sum()
    mid, below = np.cumsum(table, axis=1) - table / 2, np.cumsum(at) - at / 2
    under = below * (n - below) - n * at / 4
    term = np.divide(at / n * (n * mid - below * size[:, None]) ** 2, under, out=np.zeros_like(mid), where=under > 0)
    return float((n - 1) / n * (term.sum(axis=1) / size).sum())


def ad_p(statistic: float, k: int) -> float:
    """Asymptotic p of the standardised statistic: the levels' logarithm as a quadratic of their critical values, kept within the levels."""
    m = k - 1
    critical = np.array(AD_B0) + np.array(AD_B1) / np.sqrt(m) + np.array(AD_B2) / m
    p = float(np.exp(np.polyval(np.polyfit(critical, np.log(AD_LEVELS), 2), statistic)))
    return min(max(p, min(AD_LEVELS)), max(AD_LEVELS))


def ad_test(freqs: DataFrame, split: list[str], pseudo_n: int = 1000, n_perm: int = 1000, min_samples: int = 3, seed: int = 42, rounds: int = 50) -> DataFrame:
    """Per split the standardised k-sample statistic over genotypes with ``min_samples`` samples or more, its asymptotic and its permutation p.

    ``freqs``: split, genotype, sample_short, len, value. Each sample counts ``pseudo_n`` whole observations. Samples' labels are
    permuted in tasks of ``rounds`` rounds; a task holds its split's samples by lengths (some dozens), not their cells.
    """
    w = Window.partitionBy(*split, "sample_short")
    rows = freqs.withColumn("share", F.col("value") / F.sum("value").over(w) * pseudo_n).withColumn("low", F.floor("share"))
    rank = F.row_number().over(w.orderBy(F.round(F.col("share") - F.col("low"), 9).desc(), F.col("len").desc()))
    counts = rows.select(*split, "genotype", "sample_short", "len", (F.col("low") + (rank <= F.lit(pseudo_n) - F.sum("low").over(w)).cast("long")).alias("f"))
    enough = counts.groupBy(*split, "genotype").agg(F.countDistinct("sample_short").alias("m")).where(F.col("m") >= min_samples).select(*split, "genotype")
    counts = counts.join(enough, [*split, "genotype"], "left_semi")
    tasks = freqs.sparkSession.range(-(-n_perm // rounds) + 1).withColumnRenamed("id", "task")
    dealt = counts.crossJoin(F.broadcast(tasks))
    kinds = dict(freqs.dtypes)
    head = "".join(f"`{c}` {kinds[c]}, " for c in split)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *of, task = key
        wide = pdf.pivot_table(index=["genotype", "sample_short"], columns="len", values="f", fill_value=0).sort_index()
        label, table = wide.index.get_level_values(0).to_numpy(), wide.to_numpy(float)
        names, group = np.unique(label, return_inverse=True)
        if len(names) < 2:
            return pd.DataFrame(columns=[*split, "task", "ad_stat", "p_asymptotic", "n_groups", "groups", "n_samples", "hits"])
        summed = lambda g: ad_statistic(np.stack([table[g == i].sum(axis=0) for i in range(len(names))]))
        own = summed(group)
        hits = 0
        if task:
            rng = np.random.default_rng([seed, task])
            # equal labels may sum up in another order
            hits = sum(summed(rng.permutation(group)) >= own - 1e-9 for _ in range(min(rounds, n_perm - (task - 1) * rounds)))
        sizes = np.bincount(group) * float(pseudo_n)
        t = (own - (len(names) - 1)) / ad_moments(sizes) if not task else None
        return pd.DataFrame([[*of, task, t, ad_p(t, len(names)) if not task else None, len(names), "|".join(names), len(group), hits]], columns=[*split, "task", "ad_stat", "p_asymptotic", "n_groups", "groups", "n_samples", "hits"])

    found = dealt.groupBy(*split, "task").applyInPandas(run, head + "task long, ad_stat double, p_asymptotic double, n_groups long, groups string, n_samples long, hits long")
    out = found.groupBy(*split).agg(F.max("ad_stat").alias("ad_stat"), F.max("p_asymptotic").alias("p_asymptotic"), F.max("n_groups").alias("n_groups"), F.max("groups").alias("groups"), F.max("n_samples").alias("n_samples"), F.sum("hits").alias("hits"))
    return out.select(*split, F.round("ad_stat", 6).alias("ad_stat"), "p_asymptotic", ((F.col("hits") + 1) / (n_perm + 1)).alias("p_permutation"), "n_groups", "groups", "n_samples")


def _ranked(values: DataFrame, by: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    rank = F.rank().over(w.orderBy(value)) + (ties - 1) / 2
    return values.select(*by, "grp", rank.alias("r"), ties.alias("ties"), F.count("*").over(w).alias("n"))


def _rank_sums(values: DataFrame, by: list[str], sides: tuple[str, str], value: str) -> DataFrame:
    """(by, n1, n2, U, away, sd, tied): U of the first side, its distance from the mean, its tie-corrected deviation."""
    r = _ranked(values.where(F.col("grp").isin(*sides)), by, value)
    n1, n2 = (F.count_if(F.col("grp") == s) for s in sides)
    s = r.groupBy(*by).agg(n1.alias("n1"), n2.alias("n2"), F.sum(F.when(F.col("grp") == sides[0], F.col("r"))).alias("r1"), F.sum((F.col("ties") * F.col("ties") - 1).cast("double")).alias("tie"), F.max("n").cast("double").alias("n"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12.0 * ((F.col("n") + 1) - F.try_divide("tie", F.col("n") * (F.col("n") - 1)))
    return s.where("n1 > 0 AND n2 > 0").select(*by, "n1", "n2", u.alias("U"), (u - F.col("n1") * F.col("n2") / 2).alias("away"), F.sqrt(var).alias("sd"), (F.col("tie") > 0).alias("tied"))


def wilcoxon(values: DataFrame, by: list[str], sides: tuple[str, str], value: str = "value") -> DataFrame:
    """Rank-sum U of the first side and its tie-corrected normal z (no continuity correction). ``values``: by, grp, value."""
    return _rank_sums(values, by, sides, value).select(*by, "n1", "n2", "U", F.try_divide("away", "sd").alias("z"))


def wilcoxon_test(values: DataFrame, by: list[str], sides: tuple[str, str], value: str = "value") -> DataFrame:
    """``wilcoxon`` with the two-sided p: exact where both sides have under 50 values and none is tied, else normal with the continuity correction; null where all values are equal."""
    r = _rank_sums(values, by, sides, value)
    return r.select(*by, "n1", "n2", "U", F.try_divide("away", "sd").alias("z"), rank_sum_p(F.col("U"), F.col("n1"), F.col("n2"), F.col("tied"), F.col("sd")).alias("p_value"))


def kruskal(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Tie-corrected H and its df. ``values``: by, grp, value."""
    r = _ranked(values, by, value)
    g = r.groupBy(*by, "grp").agg(F.sum("r").alias("s"), F.count("*").alias("k"), F.max("n").cast("double").alias("n"), F.sum((F.col("ties") * F.col("ties") - 1).cast("double")).alias("tie"))
    h = g.groupBy(*by).agg(F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q"), F.max("n").alias("n"), F.sum("tie").alias("tie"), (F.count("*") - 1).alias("df"))
    raw = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)
    return h.where("df > 0").select(*by, F.try_divide(raw, 1 - F.col("tie") / (F.col("n") * F.col("n") * F.col("n") - F.col("n"))).alias("H"), "df")


def with_h_p(stats: DataFrame) -> DataFrame:
    """``kruskal`` with the chi-square p."""
    return stats.withColumn("p_value", chi2_p(F.col("H"), F.col("df")))
