"""CDR3 validity, IMGT numbering, positional amino-acid tables, medians, property means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.staging import inline

CORE = 13
LEAST, MOST = 8, 25


def folded() -> Column:
    return F.upper(F.trim("aminoAcid"))


def valid(least: int = LEAST, most: int = MOST) -> Column:
    """One pattern, so that a filter that Catalyst moves below an aggregation, to where ``aminoAcid`` is made, makes it once."""
    letters = "ACDEFGHIKLMNPQRSTVWY"
    return F.coalesce(folded().rlike(rf"\A(?=[{letters}]{{{least},{most}}}\z)C.*(F|W|YV)\z"), F.lit(False))


def positions(length: int) -> list[str]:
    """IMGT positions of a junction of that length: anchors 104 and 118 around a core that grows at 111/112 and shrinks there too."""
    extra = length - 2 - CORE
    left, right = list(range(105, 112)), list(range(112, 118))
    if extra < 0:
        left, right = left[: len(left) - (-extra - (-extra) // 2)], right[(-extra) // 2 :]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    added = [f"111{c}" for c in letters[: max(extra - extra // 2, 0)]] + [f"112{c}" for c in reversed(letters[: max(extra // 2, 0)])]
    return ["104", *map(str, left), *added, *map(str, right), "118"]


def numbering(least: int = LEAST, most: int = MOST) -> list[tuple[int, int, str]]:
    return [(n, i, p) for n in range(least, most + 1) for i, p in enumerate(positions(n))]


def residues(counts: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """A row per residue of each valid clonotype, with its IMGT position: a lookup of some hundred rows, no UDF."""
    look_up = inline(counts.sparkSession, numbering(least, most), "len int, idx int, IMGT_position string")
    rows = counts.where(valid(least, most)).withColumn("aa_", folded()).withColumn("len", F.length("aa_"))
    rows = rows.select(*counts.columns, "len", F.posexplode(F.split("aa_", "")).alias("idx", "AA"))
    return rows.join(F.broadcast(look_up), ["len", "idx"])


def aa_table(res: DataFrame, by_length: bool = False, by_family: bool = False, value: str = "cnt", by: list[str] | None = None) -> DataFrame:
    """counts, rows and their shares of the position's total (0 where that is 0), by (AA, position[, length][, V family])."""
    group = [*(by or ["sample_short"]), "IMGT_position", *["len"] * by_length, *["vFamilyName"] * by_family]
    agg = res.groupBy(*group, "AA").agg(F.sum(value).alias("counts"), F.count_if(F.col(value) > 0).alias("rows"))
    w = Window.partitionBy(*group)
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(w)), F.lit(0.0))
    return agg.select(*group, "AA", "counts", "rows", share("counts").alias("counts_freq"), share("rows").alias("rows_freq"))


def median_with_zeros(values: DataFrame, by: list[str], iterations: int, value: str) -> DataFrame:
    """Median over all iterations, those without a row counting as 0: the values padded, no cross join."""
    padded = F.concat(F.collect_list(F.col(value).cast("double")), F.array_repeat(F.lit(0.0), F.lit(iterations) - F.count(value).cast("int")))
    sorted_ = values.groupBy(*by).agg(F.array_sort(padded).alias("v"))
    low, high = F.element_at("v", F.lit((iterations + 1) // 2)), F.element_at("v", F.lit(iterations // 2 + 1))
    return sorted_.select(*by, ((low + high) / 2).alias("median"))


def property_means(table: DataFrame, properties: DataFrame, by: list[str], value: str = "counts") -> DataFrame:
    """Mean of each property weighted by ``value``; null where that sums to 0; unknown residues drop out. Spark broadcasts ``properties`` by its size."""
    rows = table.join(properties, "AA")
    weight = F.sum(F.col(value).cast("double"))
    return rows.groupBy(*by, "prop").agg((F.sum(F.col(value) * F.col("value")) / F.nullif(weight, F.lit(0.0))).alias("mean_value"))


def min_support(values: DataFrame, index: list[str], more_than: float, samples: int, value: str) -> DataFrame:
    """Rows whose index has at least ``samples`` samples with a value over ``more_than``: one pass, a row a sample under an index."""
    n = F.count_if(F.col(value) > more_than).over(Window.partitionBy(*index))
    return values.withColumn("_n", n).where(F.col("_n") >= samples).drop("_n")


#: The published ten Kidera factors.
KIDERA = """
prop A R N D C Q E G H I L K M F P S T W Y V
KF1 -1.56 0.22 1.14 0.58 0.12 -0.47 -1.45 1.46 -0.41 -0.73 -1.04 -0.34 -1.40 -0.21 2.06 0.81 0.26 0.30 1.38 -0.74
KF2 -1.67 1.27 -0.07 -0.22 -0.89 0.24 0.19 -1.96 0.52 -0.16 0.00 0.82 0.18 0.98 -0.33 -1.08 -0.70 2.10 1.48 -0.71
KF3 -0.97 1.37 -0.12 -1.58 0.45 0.07 -1.61 -0.23 -0.28 1.79 -0.24 -0.23 -0.42 -0.36 -1.15 0.16 1.21 -0.72 0.80 2.04
KF4 -0.27 1.87 0.81 0.81 -1.05 1.10 1.17 -0.16 0.28 -0.77 -1.10 1.70 -0.73 -1.43 -0.75 0.42 0.63 -1.57 -0.56 -0.40
KF5 -0.93 -1.70 0.18 -0.92 -0.71 1.10 -1.31 0.10 1.61 -0.54 -0.55 1.54 2.00 0.22 0.88 -0.21 -0.10 -1.16 0.00 0.50
KF6 -0.78 0.46 0.37 0.15 2.41 0.59 0.40 -0.11 1.01 0.03 -2.05 -1.62 1.52 -0.81 -0.45 -0.43 0.21 0.57 -0.68 -0.81
KF7 -0.20 0.92 -0.09 -1.52 1.52 0.84 0.04 1.32 -1.85 -0.83 0.96 1.15 0.26 0.67 0.30 -1.89 0.24 -0.48 -0.31 -1.07
KF8 -0.08 -0.39 1.23 0.47 -0.69 -0.71 0.38 2.36 0.47 0.51 -0.76 -0.08 0.11 1.10 -2.30 -1.15 -1.15 -0.40 1.03 0.06
KF9 0.21 0.23 1.10 0.76 1.13 -0.03 -0.35 -1.66 1.13 0.66 0.45 -0.48 -1.27 1.71 0.74 -0.97 -0.56 -2.30 -0.05 -0.46
KF10 -0.48 0.93 -1.73 0.70 1.10 -2.33 -0.12 0.46 1.63 -1.78 0.93 0.60 0.27 -0.44 -0.28 -0.23 0.19 -0.60 0.53 0.65
"""


PROPERTY = "AA string, prop string, value double"


def kidera_values() -> list[tuple[str, str, float]]:
    (_, *letters), *factors = (line.split() for line in KIDERA.strip().splitlines())
    return [(a, prop, float(v)) for prop, *row in factors for a, v in zip(letters, row)]


def kidera(spark: SparkSession) -> DataFrame:
    """(AA, prop, value) of the Kidera factors KF1 to KF10."""
    return inline(spark, kidera_values(), PROPERTY)


def cruciani_values() -> list[tuple[str, str, float]]:
    """The published Cruciani properties PP1 to PP3."""
    letters = "A R N D C E Q G H I L K M F P S T W Y V".split()
    values = {
        "PP1": [-0.96, 0.8, 0.82, 1, -0.55, 0.94, 0.78, -0.88, 0.67, -0.94, -0.9, 0.6, -0.82, -0.85, -0.81, 0.41, 0.4, 0.06, 0.31, -1],
        "PP2": [-0.76, 0.63, -0.57, -0.89, -0.47, -0.54, -0.3, -1, -0.11, -0.05, 0.03, 0.1, 0.03, 0.48, -0.4, -0.82, -0.64, 1, 0.42, -0.43],
        "PP3": [0.31, 0.99, 0.02, -1, 0.19, -0.99, -0.38, 0.49, 0.37, -0.18, -0.24, 1, -0.08, -0.58, -0.07, 0.57, 0.37, -0.47, -0.2, -0.1461],
    }
    return [(a, p, float(v)) for p, row in values.items() for a, v in zip(letters, row)]


def cruciani(spark: SparkSession) -> DataFrame:
    """(AA, prop, value) of the Cruciani properties."""
    return inline(spark, cruciani_values(), PROPERTY)


def decimal_position(position: str = "IMGT_position") -> Column:
    """An insertion's letter as a number behind a point: 111A as 111.1; other positions as they are."""
    letter = F.regexp_extract(position, "[A-Z]$", 0)
    return F.when(letter != "", F.concat(F.regexp_replace(position, "[A-Z]$", "."), F.ascii(letter) - 64)).otherwise(F.col(position))


def position_order() -> dict[str, int]:
    """Place of every position along the loop, insertions after 111 upwards and before 112 downwards."""
    longest = positions(25)
    ends = positions(15)
    names = [p for p in ends if int(p) <= 111] + [p for p in longest if not p.isdigit()] + [p for p in ends if int(p) > 111]
    return {p: k for k, p in enumerate(names)}


def with_order(rows: DataFrame, position: str = "IMGT_position") -> DataFrame:
    """``rows`` with ``ord``, the position's place along the loop; null for other names."""
    look_up = F.create_map(*[x for p, k in position_order().items() for x in (F.lit(p), F.lit(k))])
    return rows.withColumn("ord", F.try_element_at(look_up, F.col(position)))
