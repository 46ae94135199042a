"""Document fingerprints: a canonical exact digest.

A text's canonical form is its NFKC normalisation, case-folded, with each run of white space as one blank and none at the
ends. The fingerprint is the 128-bit XXH3 of its UTF-8 bytes in hex. Documents are grouped by fingerprint, and within
a group canonical bytes are compared: a fingerprint shared by different texts is split by the texts themselves. Only texts
whose fingerprint occurs twice are moved for that, and those of a group are combined before the shuffle.

Defined cases: null text is empty; null and repeated doc_ids are fingerprinted like others; an empty table gives no rows; other
columns are not read. Order "by descending doc_id" puts nulls last and rows with one doc_id by text.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import freeze, table, texts_of


#: Shared fingerprints that are broadcast.
BROADCAST_PRINTS = 200_000
#: Text that a range of documents holds, about.
RANGE_BYTES = 64 << 20
#: Characters of the text by which ranges may divide the rows of one doc_id.
TIE_CHARS = 32


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(text.split())
    return " ".join(text.lower().split())


def fingerprint(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


def likeness(a: str, b: str) -> float:
    """Of two canonical texts: 1 if their digests and then their bytes are equal, else 0. An exact digest knows no degrees."""
    return float(a == b)


def fingerprints(docs: DataFrame, digits: int = 32) -> DataFrame:
    """(doc_id, canonical, fingerprint) per document; ``digits``: of the digest, fewer only where tests want unlike texts to share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches):
            forms = [canonical(t) for t in texts]
            digests = [xxhash.xxh3_128_hexdigest(c.encode("utf-8", "surrogatepass"))[:digits] for c in forms]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(forms, pa.string()), pa.array(digests, pa.string())], names=["doc_id", "canonical", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, canonical string, fingerprint string")


def exact_groups(docs: DataFrame, prints: DataFrame | None = None, digits: int = 32) -> DataFrame:
    """(doc_id, fingerprint, group_id, copies), a row per distinct (doc_id, fingerprint): group_id the smallest doc_id with the same canonical text, copies the rows that have it.

    ``prints``: (doc_id, fingerprint) of each row of docs, if already there. Bytes are compared by the smallest and largest
    canonical text of each fingerprint that occurs twice; where they differ the group is dealt by text.
    """
    rows = fingerprints(docs, digits)
    prints = freeze(rows.select("doc_id", "fingerprint"), "fingerprints") if prints is None else prints
    sizes = freeze(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies")), "fingerprint-sizes")
    shared = sizes.where("copies > 1").select("fingerprint")
    if shared.count() <= BROADCAST_PRINTS:  # some 50 bytes each; beyond, both sides are shuffled
        shared = F.broadcast(shared)
    met = rows.join(shared, "fingerprint", "left_semi")
    unlike = freeze(met.groupBy("fingerprint").agg((F.min("canonical") < F.max("canonical")).alias("unlike")).where("unlike").select("fingerprint"), "fingerprint-clashes")
    sound = prints.distinct().join(sizes, "fingerprint").join(unlike, "fingerprint", "left_anti")
    if unlike.isEmpty():
        return sound.select("doc_id", "fingerprint", "group_id", "copies")
    split = rows.join(unlike, "fingerprint", "left_semi")
    by_text = split.groupBy("fingerprint", "canonical").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies"))
    split = split.join(by_text, ["fingerprint", "canonical"]).groupBy("doc_id", "fingerprint").agg(F.min("group_id").alias("group_id"), F.max("copies").alias("copies"))
    return sound.select("doc_id", "fingerprint", "group_id", "copies").union(split.select("doc_id", "fingerprint", "group_id", "copies"))


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _report_row(doc_id: int | None, text: str, form: str, after: str, after_form: str) -> tuple:
    changed = edited(text, after)
    other = canonical(changed)
    digest = lambda t: xxhash.xxh3_128_hexdigest(t.encode("utf-8", "surrogatepass"))
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), digest(form), digest(other), likeness(form, other), likeness(form, after_form)


def _report_batch(rows: list[tuple], edges: list[tuple] | None = None) -> pa.RecordBatch:
    """Report rows, and behind them ``edges`` (doc_id, range, first, last)."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in REPORT.split(", ")]
    if edges is not None:
        rows = [(*r, None, None, None) for r in rows] + [(e[0], *[None] * 6, *e[1:]) for e in edges]
        kinds, names = [*kinds, pa.int32(), pa.string(), pa.string()], [*names, "range", "first", "last"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Report rows of a sorted range but its last, which meets a row of another range: then the range's first and last text."""
    first, held, place = None, None, None
    for part, texts in texts_of(batches):
        out = []
        for doc_id, text in zip(part.column(0).to_pylist(), texts):
            now = (doc_id, text, canonical(text))
            if held is None:
                first, place = text, part.column(2)[0].as_py()
            else:
                out.append(_report_row(*held, *now[1:]))
            held = now
        if out:
            yield _report_batch(out, [])
    if held is not None:
        yield _report_batch([], [(held[0], place, first, held[1])])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in texts_of(batches):
        yield _report_batch([_report_row(i, t, canonical(t), a, canonical(a)) for i, t, a in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist())])


def edit_report(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per document.

    Documents are sorted in ranges, by doc_id descending and then by the text, whose first characters divide the rows of one doc_id
    or of none. Each range is reported on and written in one pass; its first and last text are met with its neighbours' after that, a row a range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if parts is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    last_first = F.col("doc_id").desc_nulls_last()
    ranges = rows.repartitionByRange(parts, last_first, F.substring("text", 1, TIE_CHARS)).sortWithinPartitions(last_first, "text")
    ranges = ranges.withColumn("range", F.spark_partition_id())
    found = freeze(ranges.mapInArrow(_inner, REPORT + ", range int, first string, last string"), "edits")
    edges = found.where("range is not null")
    # numbers alone: as many as ranges
    after = F.coalesce(F.lead("range").over(Window.orderBy("range")), F.first("range").over(Window.orderBy("range")))
    met = edges.join(edges.select("range", after.alias("after")), "range").select("doc_id", F.col("last").alias("text"), "after")
    met = met.join(edges.select(F.col("range").alias("after"), F.col("first").alias("following")), "after").select("doc_id", "text", "following")
    ends = freeze(met.mapInArrow(_across, REPORT), "range-ends")
    return found.where("range is null").select(*ends.columns).union(ends)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    report = edit_report(docs)
    groups = exact_groups(docs, report.select("doc_id", "fingerprint"))
    same = (F.col("r.fingerprint") == F.col("g.fingerprint")) & F.col("r.doc_id").eqNullSafe(F.col("g.doc_id"))
    return report.alias("r").join(groups.alias("g"), same, "left").select("r.*", "g.group_id", "g.copies")
