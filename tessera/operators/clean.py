"""Cleaning, splitting and merging of rearrangement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["aminoAcid", "vFamilyName", "jGeneName"]
REMOVAL = ["nucleotide", "aminoAcid"]


def _listed(rows: DataFrame, removal: DataFrame, how: str) -> DataFrame:
    """Null meets null: nonproductive rearrangements have no aminoAcid."""
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"x.{c}")) for c in REMOVAL]
    return rows.alias("r").join(removal.select(*REMOVAL).alias("x"), on, how)


def without(rows: DataFrame, removal: DataFrame) -> DataFrame:
    """Rows whose (nucleotide, aminoAcid) is not in the removal list."""
    return _listed(rows, removal, "left_anti")


def only(rows: DataFrame, removal: DataFrame) -> DataFrame:
    return _listed(rows, removal, "left_semi")


def with_genes(rows: DataFrame) -> DataFrame:
    return rows.dropna(how="any", subset=["jGeneName", "vFamilyName"])


def productive() -> Column:
    """A null status is nonproductive."""
    return F.col("sequenceStatus").eqNullSafe(F.lit("In"))


def cleanup_summary(rows: DataFrame, removal: DataFrame) -> DataFrame:
    """Per sample and category the number of rows and their counts, in one pass."""
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"x.{c}")) for c in REMOVAL]
    marked = rows.alias("r").join(removal.select(*REMOVAL).distinct().withColumn("_gone", F.lit(True)).alias("x"), on, "left").select("r.*", "_gone")
    kept = F.col("_gone").isNull() & F.col("vFamilyName").isNotNull() & F.col("jGeneName").isNotNull()
    category = F.when(F.col("_gone").isNotNull(), "removed").when(kept & productive(), "productive").when(kept, "nonproductive")
    return marked.withColumn("category", category).where("category IS NOT NULL").groupBy("sample_short", "category").agg(F.count("*").alias("num_sequences"), F.sum("cnt").alias("sum_counts"))


def merged(rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Counts by sample and clonotype: the long form of the merged matrix, zeros implicit."""
    return rows.groupBy("sample_short", *(key or KEY)).agg(F.sum("cnt").alias("cnt"))


def clonotypes(rows: DataFrame, count: str = "cnt", key: list[str] | None = None) -> DataFrame:
    """As ``merged``, of counts as they stand in a text file: one that is no number, or is missing, counts 1."""
    value = F.coalesce(F.col(count).cast("string").try_cast("double"), F.lit(1.0))
    return rows.groupBy("sample_short", *(key or KEY)).agg(F.sum(value).alias("cnt"))


def wide(long: DataFrame, key: list[str], samples: list[str], value: str = "cnt") -> DataFrame:
    """The matrix itself, for export: a column per named sample, 0 where it lacks the key; keys of no named sample are left out."""
    return long.where(F.col("sample_short").isin(samples)).groupBy(*key).pivot("sample_short", samples).agg(F.first(value)).na.fill(0, samples)


def wide_metrics(long: DataFrame, key: list[str], samples: list[str], metrics: list[str]) -> dict[str, DataFrame]:
    """Metric -> its matrix, a column ``<sample>_<metric>`` per sample; all have the same keys, those that any named sample has."""
    rows = long.where(F.col("sample_short").isin(samples)).groupBy(*key).pivot("sample_short", samples).agg(*[F.first(m).alias(m) for m in metrics])
    name = lambda s, m: f"{s}_{m}" if len(metrics) > 1 else s
    return {m: rows.select(*key, *[F.coalesce(F.col(f"`{name(s, m)}`"), F.lit(0)).alias(f"{s}_{m}") for s in samples]) for m in metrics}
