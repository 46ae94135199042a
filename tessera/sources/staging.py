"""Tables written once where a plan reads them several times."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors see; a fresh local folder only where that is unset and all runs in one JVM."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return folder.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: what is built on it starts there, after a lost executor too."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows as a local relation: Catalyst knows its size, and no Python task makes it."""
    names = StructType.fromDDL(schema).names
    columns = dict(zip(names, zip(*rows))) if rows else {n: () for n in names}
    return spark.createDataFrame(pa.table({n: pa.array(c) for n, c in columns.items()}), schema)
