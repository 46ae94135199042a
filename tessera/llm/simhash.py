"""SimHash near-duplicates by pivot distance tables.

A document's fingerprint has a bit set where over half of its word-shingle hashes have it. Two fingerprints within
``max_bits`` of 64 agree on whole bit blocks (pigeonhole); such a block is the shuffle key that brings possible pairs
together, since distances to pivots alone prune too little to deal rows out by. Inside a key each fingerprint carries
its row of the pivot table: its Hamming distances to ``PIVOTS`` reference fingerprints. Rows are sorted by the first
coordinate, pairs whose coordinates differ by more than ``max_bits`` anywhere are discarded (triangle inequality), and
the survivors are verified. Only spanning links leave a task.

Defined cases: null text is empty; a text without words has fingerprint 0 and links like any other; equal texts and
repeated rows share a fingerprint; rows with a null doc_id link like others but name no component, which is null where no
row of the group has a doc_id; an empty table gives no rows; other columns of the input are kept by ``keep_one`` and not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, freeze, keep_rows, local_components, table, texts_of

PIVOTS = 16
#: Rows of one key that are compared in one place; a key with more is cut into pairs of parts.
PART = 4096


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the whole text: XXH64 of each shingle's UTF-8, majority by bit, ties are 0."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at 0x20 and 0x09-0x0D only
    if not parts:
        return 0
    line = b" ".join(parts)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
    last = max(0, len(parts) - words)
    counts, n, digest = np.zeros(64, np.int64), last + 1, xxhash.xxh64_digest
    for low in range(0, n, 1 << 15):
        high = min(n, low + (1 << 15))
        stop = ends[low + words - 1 : high + words - 1] if len(parts) >= words else ends[-1:]
        hashes = b"".join([digest(line[a:b], seed) for a, b in zip(starts[low:high], stop)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def set_fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of given 64-bit shingle hashes, each counted once: equal sets have equal fingerprints."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[low : low + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per document, fp the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches):
            fps = np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances (rows: uint64 fingerprints, columns: pivots)."""
    pivots = np.random.default_rng(20_11).integers(0, 1 << 63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int16)


def linked_pairs(key: np.ndarray, fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all pairs with equal key and at most ``max_bits`` differing bits, lag by lag of the sorted table."""
    far = pivot_table(fps)
    order = np.lexsort((far[:, 0], key))
    key, fps, far = key[order], fps[order], far[order]
    live, lag = np.arange(len(fps) - 1), 1
    while len(live):
        other = live + lag
        near = (key[live] == key[other]) & (far[other, 0] - far[live, 0] <= max_bits)  # sorted: once false, false at any larger lag
        live, other = live[near], other[near]
        a, b = live, other
        for p in range(1, PIVOTS):
            stay = np.abs(far[a, p] - far[b, p]) <= max_bits
            a, b = a[stay], b[stay]
        stay = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        if stay.any():
            yield order[a[stay]], order[b[stay]]
        lag += 1
        live = live[live + lag < len(fps)]


def blocks_for(n: int, max_bits: int) -> tuple[int, list[tuple[int, ...]]]:
    """Number of bit blocks, and the sets of blocks that serve as keys: any pair within max_bits agrees on one set. The least work for n fingerprints."""
    costs = []
    for blocks in range(max_bits + 1, max_bits + 5):
        bits = 64 * (blocks - max_bits) / blocks
        costs.append((math.comb(blocks, max_bits) * n * (100 + n / 2**bits), blocks))
    blocks = min(costs)[1]
    return blocks, list(combinations(range(blocks), blocks - max_bits))


def links(classes: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): links, as fingerprints, that span each group of near ones, from ``classes`` (fp: one row per fingerprint)."""
    n = classes.count()
    blocks, sets = blocks_for(n, max_bits)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in sets:
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    keyed = classes.select("fp", F.inline(keys))
    # keys with more rows than PART are cut by hash into parts, and rows are sent to each pair of parts
    big = keyed.groupBy("t", "k").count().where(F.col("count") > PART).select("t", "k", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    keyed = keyed.join(big, ["t", "k"], "left")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    pairs = F.expr("transform(sequence(0, parts - 1), x -> struct(least(x, own) as i, greatest(x, own) as j))")
    keyed = keyed.withColumn("own", own).select("fp", "t", "k", F.explode(F.when(F.col("parts").isNull(), F.expr("array(struct(0 as i, 0 as j))")).otherwise(pairs)).alias("ij"))
    dealt = keyed.select("fp", F.xxhash64("t", "k", "ij.i", "ij.j").alias("key")).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(fps: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            label, left, right = np.arange(len(fps)), [], []
            for a, b in linked_pairs(key, fps, max_bits):
                left.append(a)
                right.append(b)
                if sum(map(len, left)) > 1 << 20:  # contract to a star per group so far
                    label = local_components(len(fps), np.concatenate([np.arange(len(fps)), *left]), np.concatenate([label, *right]))
                    left, right = [], []
            label = local_components(len(fps), np.concatenate([np.arange(len(fps)), *left]), np.concatenate([label, *right]))
            tied = np.flatnonzero(label != np.arange(len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(fps[tied].view(np.int64)), pa.array(fps[label[tied]].view(np.int64))], names=["a", "b"])

        held = None
        for batch in batches:
            now = (batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy())
            held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            cut = int(np.searchsorted(held[1], held[1][-1])) if len(held[1]) else 0  # the last key may go on
            if cut:
                yield found(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        if held is not None and len(held[0]):
            yield found(*held)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most ``max_bits`` bits."""
    prints = freeze(fingerprints(docs, words, seed), "simhash")
    classes = freeze(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    groups = connected_components(links(classes, max_bits))
    grouped = classes.join(groups, classes.fp == groups.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("group"))
    named = grouped.select("fp", "group").join(grouped.groupBy("group").agg(F.min("rep").alias("component_id")), "group")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 4, seed: int = 42, max_bits: int = 4) -> DataFrame:
    """``docs`` with all its columns, one document of each near-duplicate group: the one with the smallest doc_id.

    Of repeated rows with that doc_id one stays; rows with a null doc_id cannot be named as anyone's copy and stay.
    """
    return keep_rows(docs, near_duplicates(docs, words, seed, max_bits))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
