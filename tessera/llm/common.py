"""Shared pieces: the cluster's shared folder, written intermediate tables, connected components, batch slicing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``; a fresh local one only where that is unset and all runs in one JVM."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return folder.rstrip("/")


def freeze(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows(df: DataFrame) -> Column:
    """All columns as one, beside which an operator's own columns may have any name; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def keep_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs``, all columns: one row per doc_id that is its own component_id in ``groups``, and all rows with a null doc_id."""
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    first = docs.where("doc_id is not null").select(whole_rows(docs), F.col("doc_id").cast("long").alias("doc_id")).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.select("row.*").unionByName(docs.where("doc_id is null"))


def texts_of(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20, empty: str | bytes = "") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of about ``most_bytes`` of text (one row at least) with their texts (bytes where ``text`` is binary); null is ``empty``."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("text"))
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            part = batch.slice(start, stop - start)
            yield part, [t or empty for t in part.column(batch.schema.get_field_index("text")).to_pylist()]
            start = stop


def in_blocks(items: DataFrame, size: Column, key: list[Column], most_bytes: int) -> Iterator[list]:
    """The rows of a query set, block by block: each block's ``size`` adds up to about ``most_bytes`` (one row at least), so that it may go to all tasks.

    Rows are dealt by the hash of ``key``; the table is written once and the driver holds one block at a time.
    """
    kept = freeze(items.withColumn("_size", size.cast("long")).withColumn("_hash", F.xxhash64(*key)), "items")
    total, widest, rows = kept.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0)), F.count("*")).first()
    blocks = total // most_bytes + 1
    while blocks < rows:
        sizes = kept.groupBy(F.pmod("_hash", F.lit(blocks)).alias("block")).agg(F.sum("_size").alias("size"))
        if (sizes.agg(F.max("size")).first()[0] or 0) <= 2 * max(most_bytes, widest):
            break
        blocks *= 2
    for block in range(blocks):
        found = kept.where(F.pmod("_hash", F.lit(blocks)) == block).drop("_size", "_hash").collect()
        if found:
            yield found


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest place reachable over the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        la, lb = la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link, over undirected ``edges`` (a, b: long).

    Alternating large-star and small-star steps, each a few shuffles over the links; a written table ends each round.
    Nulls and loops are ignored; without links the result is empty. The driver sees one summary row a round.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("ok"))
    links = freeze(links.where("ok and u > v").select("u", "v").distinct(), "links")
    seen = None
    while True:
        parent = links.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("p"))
        large = links.join(parent, "v", "left").select("u", F.least(F.coalesce("p", "v"), "v").alias("v"))
        lowest = F.min("v").over(Window.partitionBy("u"))
        small = large.distinct().select("u", "v", lowest.alias("m"))
        pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        links = freeze(small.select(F.inline(pairs)).where("u > v").distinct(), "links")
        # decimal sums: exact, and no overflow error on large ids
        now = links.agg(F.count("*"), F.sum(F.col("u").cast("decimal(20,0)")), F.sum(F.col("v").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
