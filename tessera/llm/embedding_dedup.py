"""Embedding near-dedup by product quantisation: coarse inverted lists, residual subspace codes, exact cosine rerank.

Vectors are compared as unit vectors, where cosine >= t means a distance of at most d = sqrt(2 - 2t).

- Equal vectors of a label are one class; only classes are compared.
- A class sits in the list of its nearest centroid and probes each later list whose cell reaches within d of it: its
  distance to the plane between the two cells is at most d. These probes are sufficient: no link is lost.
- In a list, asymmetric table-lookup distances from the probing vector to the coded ones are held against d plus the
  coded vector's own quantisation error, so that codes discard no link either; what is left is reranked by exact cosine.
- Lists are cut into blocks of bounded size on both sides; a block returns link counts and spanning links, not pairs.

The codebooks are fitted on a bounded sample (``TRAIN_ROWS`` classes, the first by a hash); every row is indexed.

Defined cases: a null label, and a vector that is null, empty, zero or has null or non-finite components, links with
nothing; vectors of unlike length do not link; equal vectors link with one another; every row of a table counts, also
if its vec_id repeats; a row with a null vec_id links like others and names no component, which is null where no row of
the group has a vec_id; such a row is kept only then; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, freeze, local_components, table

TRAIN_ROWS = 20_000
#: Lists grow with the root of the number of classes, between these; the sample has some 20 rows for each of the most.
LEAST_LISTS, MOST_LISTS = 64, 1024
SUBSPACES, CODES = 8, 64
BASE_ROWS, PROBE_ROWS = 1024, 4096
SLACK = 1e-6


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centre**2).sum(1)[None, :] - 2 * x @ centre.T, axis=1)
        size = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    return centre


class Codebook:
    """Coarse centroids and, per subspace, centroids of the residuals; for vectors of one dimension."""

    def __init__(self, sample: np.ndarray, lists: int = LEAST_LISTS, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.dimension = sample.shape[1]
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.coarse = np.unique(k_means(unit, lists, 10, rng), axis=0)
        self.cuts = np.linspace(0, self.dimension, min(SUBSPACES, self.dimension) + 1).astype(int)
        rest = unit - self.coarse[self.nearest(unit)]
        self.fine = [k_means(rest[:, a:b], CODES, 8, rng) for a, b in zip(self.cuts, self.cuts[1:])]

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        return np.argmin((self.coarse**2).sum(1)[None, :] - 2 * unit @ self.coarse.T, axis=1)

    def encode(self, unit: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes: uint8 by subspace, quantisation error)."""
        rest = unit - self.coarse[near]
        codes, error = np.empty((len(unit), len(self.fine)), np.uint8), np.zeros(len(unit))
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            part, book = rest[:, a:b], self.fine[m]
            codes[:, m] = np.argmin((book**2).sum(1)[None, :] - 2 * part @ book.T, axis=1)
            error += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def probes(self, unit: np.ndarray, near: np.ndarray, reach: float) -> np.ndarray:
        """True for the lists that can hold a vector within ``reach``: by the distance to the plane between two cells."""
        own = ((unit - self.coarse[near]) ** 2).sum(1)
        beyond = (unit**2).sum(1)[:, None] + (self.coarse**2).sum(1)[None, :] - 2 * unit @ self.coarse.T - own[:, None]
        gap = np.sqrt(((self.coarse[None, :, :] - self.coarse[:, None, :]) ** 2).sum(2))[near]
        return beyond <= 2 * reach * gap + SLACK

    def table_distances(self, unit: np.ndarray, lists: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (rows: unit, columns: coded vectors of one list) by table look-up."""
        rest, total = unit - self.coarse[lists], np.zeros((len(unit), len(codes)))
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            part, book = rest[:, a:b], self.fine[m]
            look_up = (part**2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * part @ book.T
            total += look_up[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def usable(vector: Column) -> Column:
    """Not null, empty or zero, and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _deal(book: Codebook | None, reach: float):
    """Rows for the lists: each class once as base, and once as probe for its own list and each later one in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1)
            sizes = np.array([len(v) for v in raw.to_pylist()]) // 8
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                ids, vectors = batch.column(0).take(pa.array(rows)), raw.take(pa.array(rows))
                x = _vectors(vectors)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                if book is not None and d == book.dimension:
                    near = book.nearest(unit)
                    codes, error = book.encode(unit, near)
                    probe = book.probes(unit, near, reach)
                    probe[np.arange(len(near)), near] = True
                    q, lists = np.nonzero(probe & (np.arange(len(book.coarse))[None, :] >= near[:, None]))
                    codes = [c.tobytes() for c in codes]
                else:  # another dimension than the sample's: one list, compared exactly
                    near, q, lists = np.full(len(rows), -d), np.arange(len(rows)), np.full(len(rows), -d)
                    codes, error = [b""] * len(rows), np.zeros(len(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(near, pa.int32()), pa.array(np.zeros(len(rows), bool)), vectors, pa.array(codes, pa.binary()), pa.array(error)], names=["cid", "list", "probe", "vector", "codes", "error"])
                take = pa.array(q)
                yield pa.RecordBatch.from_arrays([ids.take(take), pa.array(lists, pa.int32()), pa.array(np.ones(len(q), bool)), vectors.take(take), pa.array([b""] * len(q), pa.binary()), pa.array(near[q].astype(float))], names=["cid", "list", "probe", "vector", "codes", "error"])

    return run


def _compare(book: Codebook | None, least: float, reach: float):
    def run(block: pa.Table) -> pa.Table:
        left, right = block.filter(pc.invert(block.column("probe"))), block.filter(block.column("probe"))
        names = ["cid", "links", "root"]
        empty = pa.table({n: pa.array([], pa.int64()) for n in names})
        if not left.num_rows or not right.num_rows:
            return empty
        column = lambda t, n: t.column(n).combine_chunks().to_numpy(zero_copy_only=False)
        b, q = _vectors(left.column("vector").combine_chunks()), _vectors(right.column("vector").combine_chunks())
        b_id, q_id, b_n, q_n, lists = column(left, "cid"), column(right, "cid"), column(left, "n"), column(right, "n"), column(left, "list")[0]
        own = column(right, "error") == lists  # probes in their own list: each pair once, by cid
        b_norm, q_norm = np.linalg.norm(b, axis=1), np.linalg.norm(q, axis=1)
        ids = np.unique(np.concatenate([b_id, q_id]))
        b_at, q_at = np.searchsorted(ids, b_id), np.searchsorted(ids, q_id)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if lists >= 0:
            codes, error = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(b), -1), column(left, "error")
        for low in range(0, len(q), 512):
            part = slice(low, low + 512)
            open_ = ~own[part, None] | (q_id[part, None] < b_id[None, :])
            if lists >= 0:
                open_ &= book.table_distances(q[part] / q_norm[part, None], lists, codes) <= reach + error[None, :] + SLACK
            i, j = np.nonzero(open_)
            for k in range(0, len(i), 1 << 16):
                a, c = i[k : k + (1 << 16)] + low, j[k : k + (1 << 16)]
                good = np.einsum("ij,ij->i", q[a], b[c]) / (q_norm[a] * b_norm[c]) >= least
                a, c = a[good], c[good]
                links += np.bincount(q_at[a], b_n[c], len(ids)).astype(np.int64) + np.bincount(b_at[c], q_n[a], len(ids)).astype(np.int64)
                label = local_components(len(ids), np.concatenate([np.arange(len(ids)), q_at[a]]), np.concatenate([label, b_at[c]]))
        met = np.flatnonzero(links)
        return pa.table({"cid": ids[met], "links": links[met], "root": ids[label[met]]})

    return run


def near_links(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label)."""
    reach = math.sqrt(2 - 2 * least)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = usable(F.col("embedding")) & F.col("label").isNotNull()
    rows = rows.withColumn("fit", fit)
    classes = rows.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = freeze(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    sample = classes.select("embedding").orderBy(F.xxhash64("rep", "n"), "cid").limit(TRAIN_ROWS).toPandas()["embedding"]
    book = None
    if len(sample):
        sizes = sample.map(len)
        lists = min(MOST_LISTS, max(LEAST_LISTS, math.isqrt(classes.count())))
        book = Codebook(np.stack(sample[sizes == sizes.mode()[0]].to_list()).astype(float), lists)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            ends = ends - ends[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["cid", "vector"])

    flat = classes.select("cid", "embedding").mapInArrow(pack, "cid long, vector binary")
    dealt = flat.mapInArrow(_deal(book, reach), "cid long, list int, probe boolean, vector binary, codes binary, error double")
    dealt = freeze(dealt.join(classes.select("cid", "label", "n"), "cid"), "lists")
    size = dealt.groupBy("label", "list").agg(F.ceil(F.count_if(~F.col("probe")) / BASE_ROWS).cast("int").alias("bases"), F.ceil(F.count_if("probe") / PROBE_ROWS).cast("int").alias("probes"))
    sized = dealt.join(size, ["label", "list"]).where("bases > 0 and probes > 0")
    salt = lambda n: F.pmod(F.xxhash64("cid", F.lit(3)), F.col(n)).cast("int")
    base = sized.where("not probe").withColumn("b", salt("bases")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("probes") - 1)))
    probe = sized.where("probe").withColumn("p", salt("probes")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("bases") - 1)))
    key = ["label", "list", "b", "p"]
    columns = [*key, "probe", "cid", "n", "vector", "codes", "error"]
    found = base.select(columns).union(probe.select(columns)).groupBy(*key).applyInArrow(_compare(book, least, reach), "cid long, links long, root long")
    found = freeze(found, "vector-links")
    groups = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counted = classes.join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").join(groups, F.col("cid") == F.col("node"), "left").withColumn("group", F.coalesce("component", "cid"))
    least_id = classes.select("cid", "rep").join(groups, F.col("cid") == F.col("node")).groupBy(F.col("component").alias("group")).agg(F.min("rep").alias("least"))
    counted = counted.join(least_id, "group", "left").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    linked = rows.where("fit").join(counted, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(table(spark, sf_dir, "embeddings"))
