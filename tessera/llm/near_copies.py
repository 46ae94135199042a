"""Near copies by shingle sets: op10's SimHash and pivot tables bring pairs together, exact Jaccard similarity decides.

A text's set holds its shingles of ``WORDS`` words (bytes folded as in ``simhash``), as 64-bit hashes. Texts with equal sets
are one class, and a class's fingerprint is the SimHash of its set. ``simhash.links`` groups the fingerprints that chains of
``BITS`` or fewer differing bits connect, by its pivot distance tables; the sets of a group are compared, and linked at a
Jaccard similarity of ``LEAST`` or more. Pairs of that similarity differ in about 10 bits, so most are beyond any radius that
bit blocks can deal out. For these, and only where groups are still apart, classes that agree on one of ``BANDS`` bands of
``ROWS`` least hashes are compared likewise. A pair of similarity s shares a band with probability 1 - (1 - s**5)**25: over
0.99995 at 0.8, more above; the comparison itself loses and adds nothing.

Classes are compared with the leaders first, of their pivot group and then of their bands: the class that shares most keys
with most others, as a text does that the others are copies of. Only pivot groups and bands whose classes are then still in
different groups are compared whole: their sets are dealt by key, a key of many or long sets to pairs of parts, and a task
counts what the sets of its block share, never a row per pair. A group of copies around one text costs a comparison a class
and leader; in a loose group of m classes the arithmetic is quadratic, the rows are m for each ``PART`` classes of the key.

Defined cases: null text is empty; texts without words are copies of each other; texts of fewer than ``WORDS`` words are one
shingle; null doc_ids take no part; rows that repeat a doc_id tie their texts together; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import connected_components, freeze, keep_rows, local_components, texts_of

WORDS, LEAST = 5, 0.8
#: Differing bits of fingerprints that the pivot tables group, as op10's.
BITS = 4
BANDS, ROWS = 25, 5
#: Sets compared with one leader in one place; sets, and hashes in them, about, of a part of a band that is compared whole.
PART, PART_HASHES = 512, 1 << 22

#: Shingles counted at once.
WIDE = 4096

_rng = np.random.default_rng(55)
_ODD = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the text's shingles."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    starts = np.concatenate([[0], ends[:-1] + 1])
    stop = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(line[a:b]) for a, b in zip(starts.tolist(), stop.tolist())]), "<u8"))


def bands(held: np.ndarray) -> np.ndarray:
    """A key per band, from the least of each row's permuted hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(held), 2048):
        np.minimum(least, (held[None, low : low + 2048] * _ODD + _SHIFT).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, fp, bands): the set's 128-bit digest, its size, its fingerprint and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches):
            sets = [shingle_set(t) for t in texts]
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            prints = pa.array(np.array([simhash.set_fingerprint(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), keys, pa.array([len(s) for s in sets], pa.int64()), prints, pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "key", "n", "fp", "bands"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key binary, n long, fp long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, members): the sets of the classes ``wanted`` (key, rep), read from their representatives' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in texts_of(batches):
            sets = [shingle_set(t).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["key", "members"])

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.select("rep").distinct(), "rep", "left_semi")
    return rows.select("rep", "text").mapInArrow(run, "key binary, members binary").dropDuplicates(["key"])


def _similar(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(a, b) as representatives, of the distinct ``pairs`` (a, ra, b, rb: keys and representatives) with that similarity.

    The sets of all b go to their a, and a's own set before them; an a with many b is dealt into parts of about ``PART``.
    """
    wanted = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("key"), F.col("ra").alias("rep")), F.struct(F.col("b").alias("key"), F.col("rb").alias("rep"))))).distinct()
    sets = freeze(_sets(docs, wanted), "copies-sets")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = dealt.join(sets, F.col("b") == F.col("key")).select("a", "part", F.lit(1).alias("role"), F.col("rb").alias("rep"), "members")
    leaders = dealt.select("a", "ra", "part").distinct().join(sets, F.col("a") == F.col("key")).select("a", "part", F.lit(0).alias("role"), F.col("ra").alias("rep"), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, held = 0, np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for role, rep, members in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                own = np.frombuffer(members.as_buffer(), "<u8")
                if role == 0:
                    lead, held = rep, own.copy()
                elif similarity(held, own) >= least:
                    left.append(lead)
                    right.append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    rows = leaders.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return rows.mapInArrow(run, "a long, b long")


def linked(sets: list[np.ndarray], group: np.ndarray, least: float) -> np.ndarray:
    """For each place the smallest place reachable over equal groups and pairs of sets of that similarity."""
    size = np.array([len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(sets)), size), count[place] > 1
    column, row = (np.cumsum(count > 1) - 1)[place[often]], row[often]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(sets), len(sets)))
    for low in range(0, int((count > 1).sum()), WIDE):  # what two sets share, some columns at a time
        a, b = np.searchsorted(column, [low, low + WIDE])
        held = np.zeros((len(sets), WIDE), np.float32)
        held[row[a:b], column[a:b] - low] = 1
        both += held @ held.T
    either = size[:, None] + size[None, :] - both
    alike = (both / np.maximum(either, 1) >= least) | (either == 0)
    a, b = np.nonzero(np.triu(alike, 1))
    same = np.unique(group, return_index=True, return_inverse=True)
    return local_components(len(sets), np.concatenate([np.arange(len(sets)), a]), np.concatenate([same[1][same[2]], b]))


def _blocks(rows: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(a, b) as representatives: links of that similarity that span the groups, of ``rows`` (key, rep, group, band, parts) of one band each."""
    sets = freeze(_sets(docs, rows), "copies-rest")
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    pairs = F.expr("transform(sequence(0, parts - 1), x -> struct(least(x, own) as i, greatest(x, own) as j))")
    dealt = rows.withColumn("own", own).select("key", "rep", "group", "band", F.explode(pairs).alias("ij"))
    dealt = dealt.select("key", "rep", "group", F.xxhash64("band", "ij.i", "ij.j").alias("block")).join(sets, "key")
    dealt = dealt.select("block", "rep", "group", "members").repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(reps: list[int], group: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            label = linked(sets, np.array(group), least) if len(set(group)) > 1 else np.arange(len(reps))
            tied = np.flatnonzero(label != np.arange(len(reps)))
            rep = np.array(reps, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(rep[tied]), pa.array(rep[label[tied]])], names=["a", "b"])

        now, held = None, ([], [], [])
        for batch in batches:
            for block, rep, group, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if block != now and held[0]:
                    yield found(*held)
                    held = ([], [], [])
                now = block
                for to, value in zip(held, (rep, group, np.frombuffer(members.as_py(), "<u8"))):
                    to.append(value)
        if held[0]:
            yield found(*held)

    return dealt.mapInArrow(run, "a long, b long")


def _by_pivots(classes: DataFrame) -> DataFrame:
    """``classes`` with ``near``: a key for each group of fingerprints that the pivot tables link, alone or not."""
    groups = connected_components(simhash.links(freeze(classes.select("fp").distinct(), "copies-prints"), BITS))
    return classes.join(groups, classes.fp == groups.node, "left").select(*classes.columns, F.xxhash64(F.coalesce("component", "fp"), F.lit("near")).alias("near"))


def _led(keyed: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(a, b) as representatives: links of that similarity between the classes ``keyed`` (key, rep, n, met, group, band) and their bands' leaders of other groups."""
    lead = keyed.groupBy("band").agg(F.max(F.struct("met", "key", "rep", "n", "group")).alias("lead"))
    first = keyed.join(lead, "band").where((F.col("lead.key") != F.col("key")) & (F.col("lead.group") != F.col("group")))
    first = first.where(F.least("lead.n", "n") >= F.greatest("lead.n", "n") * F.lit(least - 1e-9))
    first = freeze(first.select(F.col("lead.key").alias("a"), F.col("lead.rep").alias("ra"), F.col("key").alias("b"), F.col("rep").alias("rb")).distinct(), "copies-first")
    return freeze(_similar(first, docs, least), "copies-links")


def _grouped(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` with ``group``: the smallest representative reachable."""
    groups = connected_components(links)
    return classes.join(groups, classes.rep == groups.node, "left").select(*classes.columns, F.coalesce("component", "rep").alias("group"))


def near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, component_id) of rows with a doc_id: component_id is the smallest doc_id reachable over links of that similarity."""
    sketches = freeze(_sketches(docs), "copies-sketches")
    classes = sketches.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = freeze(_by_pivots(freeze(classes, "copies-classes")), "copies-near")
    keyed = classes.select("key", "rep", "n", "near", F.explode(F.concat(F.array("near"), "bands")).alias("band"))
    sizes = keyed.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = keyed.join(sizes, "band").groupBy("key").agg(F.first("rep").alias("rep"), F.first("n").alias("n"), F.first("near").alias("near"), F.collect_list("band").alias("bands"), F.sum("size").alias("met"))
    shared = freeze(shared, "copies-shared")
    found = _led(shared.select("key", "rep", "n", "met", F.col("rep").alias("group"), F.col("near").alias("band")), docs, least)
    apart = _grouped(shared, found).select("key", "rep", "n", "met", "group", F.explode(F.expr("array_remove(bands, near)")).alias("band"))
    found = found.unionByName(_led(freeze(apart, "copies-apart"), docs, least))
    keyed = freeze(_grouped(shared, found).select("key", "rep", "n", "group", F.explode("bands").alias("band")), "copies-named")
    open_ = keyed.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("size"), F.sum("n").alias("held")).where("low < high")
    parts = F.greatest(F.ceil(F.col("size") / PART), F.ceil(F.col("held") / PART_HASHES)).cast("int")
    rest = freeze(keyed.join(open_.select("band", parts.alias("parts")), "band").select("key", "rep", "group", "band", "parts"), "copies-open")
    named = _grouped(classes.select("key", "rep"), found.unionByName(_blocks(rest, docs, least))).select("key", F.col("group").alias("component_id"))
    return sketches.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with all its columns, one document of each group of near copies: the one with the smallest doc_id.

    Of repeated rows with that doc_id one stays; rows with a null doc_id cannot be named as anyone's copy and stay.
    """
    return keep_rows(docs, near_copies(docs, least))
