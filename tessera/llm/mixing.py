"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source with n of the N documents and target weight w gives each of its documents a mean of w N / n copies. Each
document's count is drawn by inverting the Poisson distribution at a uniform number hashed from the seed and doc_id; it is
exploded by its count, and all copies are shuffled by a hash of seed, doc_id and copy number.

Defined cases: a null source is a source of its own; a null doc_id is hashed by its text instead; rows with the same
doc_id get the same count; null text stays null; a source without a weight, or with weight 0, gives no rows; an empty table
gives no rows; the two columns that the operator adds are named by parameters and replace input columns of those names; other
input columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import freeze, table, whole_rows

SEED = 9
#: Target weights by default: in proportion to documents ** TEMPERATURE.
TEMPERATURE = 0.5
#: Means above this are drawn as sums of several draws, so that exp(-mean) keeps its digits.
LARGEST_MEAN = 64.0
#: The rates are broadcast up to this many sources, and joined by shuffle beyond.
BROADCAST_SOURCES = 10_000


def identity() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) of 52 bits from the md5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson(mean: Column, u: Column) -> Column:
    """The smallest k whose cumulative Poisson probability reaches u."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.when(u > a["c"], k).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["k"])


def rates(docs: DataFrame, weights: dict | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, rate): the mean number of copies. ``weights``: by source, in any unit; None: by temperature."""
    n = docs.select("source").groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(temperature)) if temperature != 0.5 else F.sqrt(F.col("n").cast("double"))
        n = n.withColumn("w", w)
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
        n = n.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    n = freeze(n, "source-counts")
    total = n.agg(F.sum("w").alias("sum_w"), F.sum("n").alias("sum_n"))
    return n.crossJoin(F.broadcast(total)).select("source", (F.coalesce(F.try_divide("w", "sum_w"), F.lit(0.0)) * F.col("sum_n") / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: dict | None = None, temperature: float = TEMPERATURE, seed: int = SEED, copy: str = "copy", key: str = "mix_key") -> DataFrame:
    """``docs`` with each row as often as drawn, in shuffled order, with its copy number (from 0) and its place's hash."""
    rate = rates(docs, weights, temperature).withColumnRenamed("source", "of")
    if rate.count() <= BROADCAST_SOURCES:
        rate = F.broadcast(rate)
    columns = [c for c in docs.columns if c.lower() not in (copy.lower(), key.lower())]
    rows = docs.select(whole_rows(docs.select(*[F.col(f"`{c}`") for c in columns])), F.col("source").alias("from"), identity().alias("id")).join(rate, F.col("from").eqNullSafe(F.col("of")))
    draws = F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    drawn = lambda j: poisson(F.col("rate") / draws, uniform(F.lit(seed), j.cast("string"), F.col("id")))
    count = F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda a, j: a + drawn(j))
    rows = rows.withColumn("count", F.when(F.col("rate") > 0, count).otherwise(0)).where("count > 0")
    copies = rows.select("row", "id", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("number"))
    copies = copies.select("row.*", F.col("number").alias(copy), F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), "id", "number")).alias(key))
    return copies.repartition(F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "n_chars", "text", "copy", "mix_key")


OP9_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n::DOUBLE) / sum(sqrt(n::DOUBLE)) OVER () * sum(n) OVER () / n AS rate FROM n),
c(source, rate, k, p, cum) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cum + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
u AS (SELECT *, (('0x' || substr(md5('9|1|' || doc_id), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
d AS (SELECT u.doc_id, u.source, u.lang, u.n_chars, u.text, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cum < u.u) AS k FROM u)
SELECT doc_id, source, lang, n_chars, text, i::INTEGER AS "copy", md5('9|place|' || doc_id || '|' || i) AS mix_key
FROM (SELECT *, unnest(range(k)) AS i FROM d)
"""
