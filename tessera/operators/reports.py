"""Tables made from test results: side-by-side comparisons, significance filters, data behind logos and marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.clean import KEY
from tessera.operators.comparisons import TAGS

#: Positions that count as tests for the Bonferroni cutoff: the loop without its conserved ends. Fixed values.
TESTED = ["106", "107", "108", "109", "110", "111", "111A", "111B", "112A", "112", "113", "114", "115", "116", "117"]


def side_by_side(stats: DataFrame, index: list[str], values: list[str]) -> DataFrame:
    """A row per index with every value of every comparison, suffixed by its tag; null where it has no such test."""
    return stats.groupBy(*index).agg(*[F.max(F.when(F.col("tag") == t, F.col(v))).alias(f"{v}_{t}") for t in TAGS for v in values])


def significant(wide: DataFrame, threshold: float = 0.05, digits: int = 4, prefix: str = "p_value_") -> DataFrame:
    """Rows with any column of the prefix under the threshold (null counts as 1); doubles rounded."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    if not columns:
        raise ValueError(f"no column begins with {prefix}")
    hit = F.lit(False)
    for c in columns:
        hit = hit | (F.coalesce(F.col(c), F.lit(1.0)) < threshold)
    kept = wide.where(hit)
    return kept.withColumns({c: F.round(c, digits) for c, t in wide.dtypes if t in ("double", "float")})


def in_loop(position: str = "IMGT_position") -> Column:
    """Positions 108 to 111 and 116 to 117 with their insertions; null is outside."""
    number = F.regexp_extract(F.col(position).cast("string"), r"^(\d+)", 1).try_cast("int")
    return F.coalesce(number.between(108, 111) | number.between(116, 117), F.lit(False))


def tests_done(stats: DataFrame, by: list[str], least_mean: float = 0.01) -> DataFrame:
    """Number of tests per ``by``: distinct residues at each loop position where either side's mean exceeds ``least_mean``."""
    rows = stats.where(F.col("IMGT_position").isin(TESTED) & (F.greatest("mean_a", "mean_b") > least_mean))
    return rows.select(*by, "IMGT_position", "AA").distinct().groupBy(*by).agg(F.count("*").alias("tests"))


def driven_by_family(plain: DataFrame, by_family: DataFrame, index: list[str], hit: Column) -> DataFrame:
    """Per index of ``plain`` rows that satisfy ``hit``: families tested there, and those of them that satisfy it too."""
    family = by_family.select(*index, F.lit(1).alias("_tested"), F.coalesce(hit, F.lit(False)).cast("int").alias("_hit"))
    return plain.where(hit).select(*index).distinct().join(family, index, "left").groupBy(*index).agg(F.count("_tested").alias("families_tested"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("families_significant"))


def logo_stack(stats: DataFrame, by: list[str], d_cutoff: float, p_cutoff: float | None = None, least_mean: float | None = None, height: str = "cohen_d") -> DataFrame:
    """Letters that pass every cutoff, stacked outwards from 0 per position and direction, tallest first (ties by letter).

    ``height``: "cohen_d" for |d|, "p" for -log10 p. A null d or p passes no cutoff.
    """
    rows = stats.where(F.abs("cohen_d") >= d_cutoff)
    rows = rows if p_cutoff is None else rows.where(F.col("p") <= p_cutoff)
    rows = rows if least_mean is None else rows.where(F.greatest("mean_a", "mean_b") >= least_mean)
    tall = F.abs("cohen_d") if height == "cohen_d" else -F.log10("p")
    rows = rows.select(*by, "IMGT_position", "AA", F.when(F.col("cohen_d") >= 0, "pos").otherwise("neg").alias("direction"), tall.alias("height"))
    w = Window.partitionBy(*by, "IMGT_position", "direction").orderBy(F.desc("height"), "AA").rowsBetween(Window.unboundedPreceding, 0)
    top = F.sum("height").over(w)
    low, up = top - F.col("height"), F.col("direction") == "pos"
    return rows.select("*", F.when(up, low).otherwise(-top).alias("ymin"), F.when(up, top).otherwise(-low).alias("ymax"))


def property_marks(stats: DataFrame, q: list[str], q_cutoff: float = 0.05, d_cutoff: float = 0.8) -> DataFrame:
    """``stats`` once per group (grp, mean_value), with ``is_sig`` (all q and |d| pass) and stars by the largest q."""
    worst = F.greatest(*q) if len(q) > 1 else F.col(q[0])
    passes = F.lit(True)
    for c in q:
        passes = passes & (F.col(c) <= q_cutoff)
    sig = F.coalesce(passes & (F.abs("cohen_d") >= d_cutoff), F.lit(False))
    stars = F.when(~sig, "").when(worst < 0.005, "***").when(worst < 0.01, "**").when(worst < 0.05, "*").otherwise("")
    sides = F.inline(F.array(*[F.struct(F.lit(s).alias("grp"), F.col(f"mean_{s}").alias("mean_value")) for s in "ab"]))
    rest = [c for c in stats.columns if c not in ("mean_a", "mean_b")]
    return stats.select(*rest, "mean_a", "mean_b", sig.alias("is_sig"), stars.alias("stars")).select(*rest, "is_sig", "stars", sides)


def clipped_z(rows: DataFrame, by: list[str], value: str, most: float = 2.0) -> DataFrame:
    """``z``: the value's distance from its group's mean in sample deviations, cut at ``most``; null where nothing varies (deviation of rounding noise, 1e-9, or less)."""
    w = Window.partitionBy(*by)
    spread = F.stddev_samp(value).over(w)
    z = F.when(spread > 1e-9, (F.col(value) - F.avg(value).over(w)) / spread)
    return rows.withColumn("z", F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-most)), F.lit(most))))


def letters(res: DataFrame, by: list[str]) -> DataFrame:
    """(by, letters): the distinct residues of each group in order, 20 at most."""
    return res.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("AA")), "").alias("letters"))


def spelled(rows: DataFrame, by: list[str]) -> DataFrame:
    """``letters`` taken apart again: a row per letter with its place from 1."""
    return rows.select(*by, F.posexplode(F.split("letters", "")).alias("_at", "AA")).select(*by, (F.col("_at") + 1).alias("place"), "AA")


def best_sharing(at_least: DataFrame, groups: list[str], sharing: int, rounds: int, key: list[str] | None = None) -> DataFrame:
    """A column per group: the most samples that share the clonotype in at least ``rounds`` rounds (0 if none).

    Clonotypes that reach ``sharing`` samples in some group only. ``at_least``: (key, grp, N, rounds).
    """
    key = key or KEY
    best = at_least.where(F.col("rounds") >= rounds)
    return best.groupBy(*key).agg(F.max("N").alias("_most"), *[F.coalesce(F.max(F.when(F.col("grp") == g, F.col("N"))), F.lit(0)).alias(g) for g in groups]).where(F.col("_most") >= sharing).drop("_most")


def prevalent(freqs: DataFrame, level: str, share: float = 1 / 3) -> DataFrame:
    """Rows of the levels that occur (value > 0) in at least ``share`` of all (sample_short, iter) draws."""
    draws = freqs.select("sample_short", "iter").distinct().agg(F.count("*").alias("_draws"))
    seen = freqs.groupBy(level).agg(F.count_if(F.col("value") > 0).alias("_seen"))
    kept = seen.join(F.broadcast(draws), F.col("_seen") >= F.col("_draws") * share).select(level)
    return freqs.join(kept, level, "left_semi").select(*freqs.columns)


#: Positions that the loop filter leaves out: the ends of the numbered range. Fixed values.
OUTER = [*map(str, range(104, 111)), *map(str, range(113, 119))]


def inner_positions(stats: DataFrame, p: str = "p_value", most_p: float | None = None, d: str = "cohen_d", least_d: float | None = None) -> DataFrame:
    """Rows outside ``OUTER``, with p under ``most_p`` and |d| over ``least_d`` where given; nulls pass no such bound."""
    rows = stats.where(~F.col("IMGT_position").isin(OUTER))
    rows = rows if most_p is None else rows.where(F.col(p) < most_p)
    return rows if least_d is None else rows.where(F.abs(d) > least_d)


def frequent_everywhere(freqs: DataFrame, by: list[str], least: float = 0.01, value: str = "value") -> DataFrame:
    """Groups whose smallest value over all samples is ``least`` or more."""
    return freqs.groupBy(*by).agg(F.min(value).alias("_least")).where(F.col("_least") >= least).select(*by)


def annotated_pairs(pairs: DataFrame, sheet: DataFrame, columns: list[str], compare: str | None = None) -> DataFrame:
    """Pairs (sample1, sample2) with the sheet's columns of both, suffixed 1 and 2, and ``{compare}_comp``, both values in order; a sample without a sheet row keeps nulls."""
    out = pairs
    for i in "12":
        side = sheet.select(F.col("sample_short").alias(f"sample{i}"), *[F.col(c).alias(f"{c}{i}") for c in columns])
        out = out.join(side, f"sample{i}", "left")
    if compare:
        a, b = F.col(f"{compare}1"), F.col(f"{compare}2")
        out = out.withColumn(f"{compare}_comp", F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("-", F.least(a, b), F.greatest(a, b))))
    return out.select(*pairs.columns, *[f"{c}{i}" for i in "12" for c in columns], *([f"{compare}_comp"] if compare else []))


def values_of_significant(values: DataFrame, stats: DataFrame, index: list[str], hit: Column) -> DataFrame:
    """The values of each index that has a test which satisfies ``hit``, to be tested again by group."""
    chosen = stats.where(hit).select(*index).distinct()
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"c.{c}")) for c in index]
    return values.alias("v").join(chosen.alias("c"), same, "left_semi")


def position_matrix(stats: DataFrame, by: list[str], least_freq: float = 0.0) -> DataFrame:
    """(by, IMGT_position, AA, side, freq): each side's mean frequency of a letter, those under ``least_freq`` left out, as shares of their position's sum.

    ``stats`` may have several rows of a letter (cells): their mean counts.
    """
    mean = stats.groupBy(*by, "IMGT_position", "AA").agg(F.avg("mean_a").alias("a"), F.avg("mean_b").alias("b"))
    long = mean.select(*by, "IMGT_position", "AA", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("freq")) for s in "ab"])))
    long = long.where((F.col("freq") >= least_freq) & (F.col("freq") > 0))
    return long.withColumn("freq", F.col("freq") / F.sum("freq").over(Window.partitionBy(*by, "IMGT_position", "side")))
