"""Ranked lexical search: buckets of impact vectors by length, pruned by Cauchy-Schwarz and by coordinate bounds.

A document is the vector of its terms' impacts, kept to the terms of the items asked for: no other coordinate meets a
query. Each coordinate is scaled by the root of its term's weight on both sides, which changes no product and keeps
frequent terms from making documents long. Documents are written in descending order of that length. The longest
``HEAD`` give each item a first threshold, the tenth best exact score among them; documents too short to reach any
threshold are then left unread by their length alone. Tasks go through the rest in buckets of ``BUCKET`` neighbours:
an item whose length times the bucket's is below its threshold passes over the bucket; else the products over its
``FOCUS`` rarest terms and the bound on what the other coordinates can add leave few documents, whose scores are worked
out anew in 64-bit integers over all terms. Thresholds rise with each task's own findings. Bounds are doubles and take
``SLACK``, so that rounding loses nothing, and equal scores are never pruned.

Items are asked in blocks of ``BLOCK_BYTES`` of text, which bounds the vocabulary that goes to all tasks.

Defined cases: null text has no terms and is not counted; an item without terms, and an item none of whose terms has a
weight and a document, gives no rows; the texts of one item_id are one item, each different text once; a null item_id is
an item; repeated doc_ids are ranked row by row, a null doc_id after all others of its score; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import freeze, in_blocks, table, texts_of
from tessera.llm.terms import folded, stretches, words

TOP = 10
BUCKET, FOCUS, HEAD = 2048, 8, 1024
BLOCK_BYTES = 4 << 20
SLACK = 1e-9
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id in ties


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(row, doc_id, n, terms, tfs) per document: number of all terms, and the numbers and occurrences of those in ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 33
        for batch, texts in texts_of(batches, 1 << 20, b""):
            sizes, terms, tfs = [], [], []
            for text in texts:
                n, found = 0, np.zeros(0, np.int64)
                for part in stretches(folded(text)):
                    own = words(part)
                    n += len(own)
                    ids = np.fromiter(map(vocabulary.get, own, repeat(-1)), np.int64, len(own))
                    found = np.concatenate([found, ids[ids >= 0]])
                term, tf = np.unique(found, return_counts=True)
                sizes.append(n)
                terms.append(term)
                tfs.append(tf)
            ends = np.cumsum([0, *map(len, terms)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x), kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(serial, serial + len(texts))), batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["row", "doc_id", "n", "terms", "tfs"])
            serial += len(texts)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return named.mapInArrow(run, "row long, doc_id long, n long, terms array<int>, tfs array<long>")


def flat(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ends (from 0) and values of list columns of equal lengths."""
    lists = [batch.column(batch.schema.get_field_index(n)) for n in names]
    sizes = np.array(lists[0].value_lengths().fill_null(0))
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), [np.array(x.flatten()).astype(np.int64) for x in lists]


def impacts(counts: DataFrame, documents: int, occurrences: int, weight: np.ndarray) -> DataFrame:
    """(row, doc_id, norm, terms, impacts) of documents with a term of the vocabulary; the length is over weighted coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, (terms, tfs) = flat(batch, "terms", "tfs")
            # Python's integers: this product can exceed 64 bits
            m = np.array([25 + 75 * n * documents // occurrences for n in batch.column(2).to_pylist()], np.int64)
            impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, np.diff(ends)))
            at = np.repeat(np.arange(len(m)), np.diff(ends))
            norm = np.sqrt(np.bincount(at, weight[terms] * impact.astype(float) ** 2, len(m)))
            kept = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(impact))
            own = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(terms, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(norm), own, kept], names=["row", "doc_id", "norm", "terms", "impacts"])

    return counts.where("size(terms) > 0").mapInArrow(run, "row long, doc_id long, norm double, terms array<int>, impacts array<long>")


class Queries:
    """Weighted query vectors of a block's items, and the best documents that a task has found for each."""

    def __init__(self, items: list[dict[int, int]], weight: np.ndarray, df: np.ndarray, least: np.ndarray, top: int):
        self.weight, self.least, self.top = weight.astype(np.int64), least.astype(float), top
        self.terms, self.value, self.rest = [], [], []
        for counts in items:
            t = np.array(sorted((t for t in counts if weight[t] > 0), key=lambda t: (df[t], t)), np.int64)
            c = np.array([counts[i] for i in t.tolist()], np.int64)
            self.terms.append(t)
            self.value.append(c * self.weight[t])
            squares = c.astype(float) ** 2 * self.weight[t]
            self.rest.append(np.sqrt(np.concatenate([np.cumsum(squares[::-1])[::-1], [0.0]])))  # length of what is left from each term on
        self.length = np.array([r[0] for r in self.rest])
        self.found = [(np.zeros(0, np.int64),) * 2 for _ in items]  # scores and doc_ids, best first

    def read(self, doc_id: np.ndarray, norm: np.ndarray, ends: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> None:
        """One bucket."""
        doc = np.repeat(np.arange(len(doc_id)), np.diff(ends))
        by = np.argsort(terms, kind="stable")
        post_doc, post = doc[by], impact[by].astype(float)
        place = np.searchsorted(terms[by], np.arange(len(self.weight) + 1))
        for i in np.flatnonzero(self.length * norm.max() * (1 + SLACK) >= self.least).tolist():
            partial, square = np.zeros(len(doc_id)), np.zeros(len(doc_id))
            focus = self.terms[i][:FOCUS]
            for t, v in zip(focus.tolist(), self.value[i].tolist()):
                d, p = post_doc[place[t] : place[t + 1]], post[place[t] : place[t + 1]]  # a document at most once
                partial[d] += v * p
                square[d] += self.weight[t] * p * p
            bound = partial + self.rest[i][len(focus)] * np.sqrt(np.maximum(norm * norm * (1 + SLACK) - square, 0.0))
            left = np.flatnonzero((bound * (1 + SLACK) >= self.least[i]) & (bound > 0))
            if len(left):
                self.rescore(i, left, doc_id, ends, terms, impact)

    def rescore(self, i: int, left: np.ndarray, doc_id: np.ndarray, ends: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> None:
        value = np.zeros(len(self.weight), np.int64)
        value[self.terms[i]] = self.value[i]
        size = ends[left + 1] - ends[left]
        at = np.repeat(ends[left] - np.cumsum(size) + size, size) + np.arange(size.sum())
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(value[terms[at]] * impact[at])])
        upto = np.cumsum(size)
        score = total[upto] - total[upto - size]
        hit = (score > 0) & (score >= self.least[i])
        scores, ids = (np.concatenate(x) for x in zip(self.found[i], (score[hit], doc_id[left[hit]])))
        best = np.lexsort((ids, -scores))[: self.top]
        self.found[i] = scores[best], ids[best]
        if len(best) == self.top:
            self.least[i] = max(self.least[i], float(scores[best[-1]]))


def scored(vectors: DataFrame, items: list[dict[int, int]], weight: np.ndarray, df: np.ndarray, least: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of each item, those below ``least`` left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Queries(items, weight, df, least, top)
        for batch in batches:
            for start in range(0, batch.num_rows, BUCKET):
                part = batch.slice(start, BUCKET)
                ends, (terms, impact) = flat(part, "terms", "impacts")
                asked.read(np.array(part.column(0).fill_null(NO_ID)), np.array(part.column(1)), ends, terms, impact)
        item = np.repeat(np.arange(len(items)), [len(s) for s, _ in asked.found])
        score, ids = (np.concatenate([x[k] for x in asked.found]) if items else np.zeros(0, np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return vectors.select("doc_id", "norm", "terms", "impacts").mapInArrow(run, "item int, doc_id long, score long")


def best(rows: DataFrame, top: int) -> DataFrame:
    """(item, rank, doc_id, score)."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def _asked(docs: DataFrame, block: list[Row], kind: str, top: int) -> DataFrame:
    """The answers to one block of items (item_id, text)."""
    spark = docs.sparkSession
    counts = [Counter(words(folded(bytes(r["text"])))) for r in block]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*counts)))}
    items = [{vocabulary[w]: c for w, c in x.items()} for x in counts]
    kept = freeze(counted(docs, vocabulary), "terms")
    documents, occurrences = kept.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in kept.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).toLocalIterator():
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    vectors = impacts(kept, documents, occurrences, weight)
    vectors = freeze(vectors.where("norm > 0").repartitionByRange(F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row"), "vectors")
    none = np.zeros(len(items))
    head = best(scored(vectors.orderBy(F.desc("norm"), "row").limit(HEAD), items, weight, df, none, top), top)
    least = none.copy()
    for r in head.where(F.col("rank") == top).collect():
        least[r["item"]] = r["score"]
    length = np.array([math.sqrt(sum(c * c * int(weight[t]) for t, c in x.items())) for x in items])
    some = length > 0
    reach = float((least[some] / length[some]).min()) * (1 - 2 * SLACK) if some.any() else 0.0
    found = best(scored(vectors.where(F.col("norm") >= reach), items, weight, df, least, top), top)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {kind}")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents with a score above 0 for each item, equal scores by ascending doc_id."""
    kind = items.schema["item_id"].dataType.simpleString()
    whole = items.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").cast("binary").alias("text"))
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in in_blocks(whole, F.octet_length("text"), [F.col("item_id")], BLOCK_BYTES):
        out = out.union(_asked(docs, block, kind, top))
    return out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark),
q AS (SELECT item_id, t, count(*) AS c FROM i GROUP BY ALL),
s AS (SELECT count(*) AS all_docs, sum(len(w))::BIGINT AS all_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d),
f AS (SELECT r, doc_id, n, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(all_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY t),
x AS (SELECT item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * all_docs) // all_terms))))::BIGINT AS score FROM f JOIN w USING (t) JOIN q USING (t), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
"""
