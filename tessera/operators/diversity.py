"""Diversity indices per repertoire, frequency tables, rarefaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.clean import KEY
from tessera.sources.staging import written


def indices(counts: DataFrame, by: list[str] | None = None, value: str = "cnt") -> DataFrame:
    """Indices over pre-aggregated counts: one shuffle by repertoire for the ranks, one pass of sums."""
    by = by or ["sample_short"]
    x = F.col(value).cast("double")
    group = Window.partitionBy(*by)
    rows = counts.where(x > 0).select(*by, x.alias("x"), F.row_number().over(group.orderBy(x)).alias("i"), F.sum(x).over(group).alias("total"))
    p = F.col("x") / F.col("total")
    n = F.count("*")
    entropy = F.when(n <= 1, 0.0).otherwise(F.greatest(-F.sum(p * F.log2(p)), F.lit(0.0)))
    gini = F.when(n <= 1, 0.0).otherwise(2 * F.sum(F.col("i") * F.col("x")) / (n * F.sum("x")) - (n + 1) / n)
    return rows.groupBy(*by).agg(
        n.alias("total_sequences"),
        n.alias("unique_sequences"),
        F.sum("x").cast("long").alias("total_count"),
        F.when(n <= 1, 1.0).otherwise(1 - entropy / F.log2(n)).alias("clonality"),
        F.least(F.greatest(gini, F.lit(0.0)), F.lit(1.0)).alias("gini"),
        (F.max("x") / F.sum("x")).alias("top_sequence"),
        (1 / F.sum(p * p)).alias("inverse_simpson"),
        entropy.alias("shannon_index"),
        F.lit(1.0).alias("convergence"),
    )


def row_clonality(rows: DataFrame) -> DataFrame:
    """The older variant: entropy over rows, log2 of the number of distinct sequences; can be negative."""
    total = F.sum("cnt").over(Window.partitionBy("sample_short"))
    p = F.col("cnt") / F.col("total")
    agg = rows.where("cnt > 0").withColumn("total", total).groupBy("sample_short").agg((-F.sum(p * F.log2(p))).alias("h"), F.countDistinct("aminoAcid").alias("n"))
    return agg.select("sample_short", F.col("n").alias("unique_sequences"), (1 - F.col("h") / F.when(F.col("n") > 1, F.log2("n")).otherwise(1.0)).alias("clonality"))


def shannon_nat(rows: DataFrame) -> DataFrame:
    total = F.sum("cnt").over(Window.partitionBy("sample_short"))
    p = F.col("cnt") / F.col("total")
    return rows.where("cnt > 0").withColumn("total", total).groupBy("sample_short").agg((-F.sum(p * F.log(p))).alias("shannon_diversity"))


def common_sequences(counts: DataFrame, least: int = 2) -> DataFrame:
    named = counts.where("aminoAcid IS NOT NULL AND aminoAcid != ''")
    return named.groupBy("aminoAcid").agg(F.countDistinct("sample_short").alias("repertoire_count"), F.sum("cnt").alias("total_count")).where(F.col("repertoire_count") >= least)


SINGLE = ["vFamilyName", "jFamilyName", "cdr3Length", "jGeneName"]


def freqs_single(rows: DataFrame, params: list[str] | None = None) -> DataFrame:
    """Rows and counts of each level of each parameter, and their shares; null levels are left out of both."""
    params = params or SINGLE
    levels = F.inline(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("grp")) for p in params]))
    long = rows.select("sample_short", "cnt", levels).where("grp IS NOT NULL")
    return _shares(long, ["sample_short", "param"], "grp")


def freqs_combo(rows: DataFrame) -> DataFrame:
    long = rows.where("vFamilyName IS NOT NULL AND jFamilyName IS NOT NULL AND cdr3Length IS NOT NULL").select("sample_short", "cnt", F.lit("V-J-length").alias("param"), F.concat_ws("-", "vFamilyName", "jFamilyName", F.col("cdr3Length").cast("string")).alias("grp"))
    return _shares(long, ["sample_short", "param"], "grp")


def _shares(long: DataFrame, by: list[str], level: str) -> DataFrame:
    w = Window.partitionBy(*by)
    agg = long.groupBy(*by, level).agg(F.count("*").alias("row_count"), F.sum("cnt").alias("cell_count"))
    return agg.select(*by, level, "row_count", (F.col("row_count") / F.sum("row_count").over(w)).alias("row_fraction"), "cell_count", F.try_divide("cell_count", F.sum("cell_count").over(w)).alias("cell_fraction"))


def freqs_subsampled(draws: DataFrame) -> DataFrame:
    """Share of rows by (V, J, length), V, J, length and (V, J), per sample and iteration: one grouping-sets pass."""
    rows = draws.where("n > 0").select("sample_short", "iter", "vFamilyName", "jGeneName", F.coalesce(F.length("aminoAcid"), F.lit(0)).alias("len"))
    sets = rows.groupingSets([["sample_short", "iter", "vFamilyName", "jGeneName", "len"], ["sample_short", "iter", "vFamilyName"], ["sample_short", "iter", "jGeneName"], ["sample_short", "iter", "len"], ["sample_short", "iter", "vFamilyName", "jGeneName"]], "sample_short", "iter", "vFamilyName", "jGeneName", "len").agg(F.grouping_id().alias("g"), F.count("*").alias("rows"))
    named = F.when(F.col("g") == 0, "V_J_length").when(F.col("g") == 3, "vFamilyName").when(F.col("g") == 5, "jGeneName").when(F.col("g") == 6, "cdr3_length").otherwise("V_J")
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy("sample_short", "iter", "g"))
    return sets.select(named.alias("param"), F.concat_ws("-", "vFamilyName", "jGeneName", F.col("len").cast("string")).alias("grp"), "sample_short", "iter", share.alias("value"))


def freqs_summary(freqs: DataFrame, zeros: int | None = None) -> DataFrame:
    """Value of the original (0 if absent) and the mean over the iterations that have the level, or over ``zeros`` iterations."""
    draws = F.when(F.col("iter") > 0, F.col("value"))
    mean = F.avg(draws) if zeros is None else F.coalesce(F.sum(draws), F.lit(0.0)) / zeros
    return freqs.groupBy("param", "grp", "sample_short").agg(F.coalesce(F.max(F.when(F.col("iter") == 0, F.col("value"))), F.lit(0.0)).alias("orig"), mean.alias("mean_subsamples"))


def named(table: DataFrame, rounds: int | None = None, key: list[str] | None = None) -> DataFrame:
    """``table`` with what it was worked out from: sequence_index, the key's columns, and rarefaction_iterations, null without rarefaction."""
    return table.withColumns({"sequence_index": F.lit("_".join(key or KEY)), "rarefaction_iterations": F.lit(rounds).cast("long")})


def least_total(counts: DataFrame) -> int:
    """The smallest repertoire's number of cells, the deepest depth that leaves no repertoire out; 0 without rows."""
    totals = counts.where("cnt > 0").groupBy("sample_short").agg(F.sum("cnt").alias("t"))
    return totals.agg(F.min("t")).first()[0] or 0


def rarefied(counts: DataFrame, depth: int | None, iterations: int, seed: int = 42) -> DataFrame:
    """Mean indices over draws of ``depth`` cells, by default the smallest repertoire's; shallower repertoires are left out."""
    from tessera.operators.sampling import subsample

    depth = least_total(counts) if depth is None else depth
    deep = counts.groupBy("sample_short").agg(F.sum("cnt").alias("_t")).where(F.col("_t") >= depth).select("sample_short")
    draws = subsample(counts.join(deep, "sample_short", "left_semi"), depth, iterations, seed).where("iter > 0 AND n > 0")
    each = indices(draws, ["sample_short", "iter"], "n")
    names = ["unique_sequences", "clonality", "gini", "top_sequence", "inverse_simpson", "shannon_index"]
    return named(each.groupBy("sample_short").agg(*[F.avg(c).alias(c) for c in names]), iterations)


def expected_unique(counts: DataFrame, depth: int | None = None) -> DataFrame:
    """(sample_short, depth, expected): the mean number of different sequences in ``depth`` draws with replacement, by default as many as the smallest repertoire has cells."""
    depth = least_total(counts) if depth is None else depth
    p = F.col("cnt") / F.sum("cnt").over(Window.partitionBy("sample_short"))
    rows = counts.where("cnt > 0").select("sample_short", p.alias("p"))
    return rows.groupBy("sample_short").agg(F.lit(depth).cast("long").alias("depth"), F.sum(1 - F.pow(1 - F.col("p"), F.lit(depth))).alias("expected"))


def rarefaction_curve(counts: DataFrame, steps: int = 10, iterations: int = 5, seed: int = 42) -> DataFrame:
    """Mean and population deviation of unique sequences and clonality at ``steps`` depths of each repertoire's own size."""
    from tessera.operators.sampling import draw_counts

    counts = written(counts, "counts")
    total = counts.groupBy("sample_short").agg(F.sum("cnt").alias("t"))
    plan = total.select("sample_short", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "t").withColumn("depth", F.floor(F.col("t") * F.col("step") / steps)).groupBy("sample_short").agg(F.array_sort(F.collect_set("depth")).alias("depths"))
    draws = draw_counts(counts.join(plan, "sample_short"), iterations, seed)
    each = indices(draws, ["sample_short", "depth", "iter"], "n")
    return each.groupBy("sample_short", "depth").agg(*[f(c).alias(f"{c}_{s}") for c in ("unique_sequences", "clonality") for s, f in (("mean", F.avg), ("sd", F.stddev_pop))])
