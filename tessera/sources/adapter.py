"""``lineitem`` seen as a repertoire: the same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPERTOIRE = """
SELECT concat(CASE WHEN pid % 2 = 0 THEN 'F' ELSE 'T' END, lpad(cast(pid AS string), 3, '0'),
              CASE WHEN l_returnflag = 'N' THEN 'N' ELSE 'E' END) AS sample_short,
       h AS nucleotide,
       concat('C', translate(substr(h, 1, 6 + cast(pk % 18 AS int)), '0123456789ABCDEF', 'ACDEFGHIKLMNPQRS'),
              CASE WHEN pk % 41 = 0 THEN 'A' WHEN pk % 13 = 0 THEN 'YV' ELSE 'F' END) AS aminoAcid,
       CASE WHEN pk % 37 = 0 THEN NULL ELSE concat('TCRBV', lpad(cast(pk % 7 + 1 AS string), 2, '0')) END AS vFamilyName,
       concat('TCRBJ', lpad(cast(pk % 5 + 1 AS string), 2, '0')) AS jGeneName,
       concat('TCRBJ0', cast(pk % 2 + 1 AS string)) AS jFamilyName,
       3 * (8 + cast(pk % 18 AS int)) AS cdr3Length,
       CASE WHEN l_linestatus = 'O' THEN 'In' WHEN pk % 3 = 0 THEN 'Stop' ELSE 'Out' END AS sequenceStatus,
       cast(l_quantity AS bigint) AS cnt
FROM (SELECT l_suppkey % 24 AS pid, l_partkey % 400 AS pk, l_returnflag, l_linestatus, l_quantity,
             upper(md5(cast(l_partkey % 400 AS string))) AS h FROM lineitem) k
"""
REMOVED = ("upper(md5('3'))", "upper(md5('7'))")


def repertoire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REPERTOIRE.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def removal(rows: DataFrame) -> DataFrame:
    return rows.where(f"nucleotide IN ({', '.join(REMOVED)})").select("nucleotide", "aminoAcid").distinct()


def annotation(samples: DataFrame) -> DataFrame:
    """patient, cells, source and genotype of the distinct samples, from their made-up names; real ones come with a sheet."""
    pid = F.substring("sample_short", 2, 3).cast("int") % 3
    return samples.select("sample_short").distinct().select(
        "sample_short",
        F.left("sample_short", F.lit(4)).alias("patient"),
        F.right("sample_short", F.lit(1)).alias("cells"),
        F.left("sample_short", F.lit(1)).alias("source"),
        F.when(pid == 0, "hoDQ2").when(pid == 1, "hoDQ8").otherwise("heDQ2DQ8").alias("genotype"),
    )
