"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items scans each text once.

A-Z are lower-cased, words are runs of letters and digits of ASCII and of all other code points. A window is ``WINDOW``
consecutive words of an item, or all words of a shorter item. The automaton holds, of longer items, the seeds at every
``SEED``-th word: each window covers a whole seed, so an occurrence of a window always meets one, and a word of an item
stands in one seed instead of ten windows. Where a seed ends, the text's windows around it are looked up word for word.
Hits are mapped back to places in the original text.

Items go to all tasks in blocks of ``BLOCK_BYTES`` (cut into overlapping pieces first, so one long item is no exception);
where there are several blocks, documents are scanned once a block and the findings of earlier blocks travel with them.

Defined cases: null text has no words; null and repeated doc_ids are scanned like others, each row on its own; an item
without words has no windows; repeated items count once by item_id, windows of a null item_id mark words but name no item;
without items nothing is hit; an empty table gives no rows; other columns, of any name, are kept by ``remove`` alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import freeze, in_blocks, table, texts_of, whole_rows
from tessera.llm.terms import folded, places, words

WINDOW, SEED = 10, 5
BLOCK_BYTES, PIECE_WORDS = 2 << 20, 2000

FOUND = "n_words long, items array<string>, hits array<struct<first:long,words:long,start:long,end:long>>"
_HITS = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "words", "start", "end")]))


def pieces(items: DataFrame) -> DataFrame:
    """(item_id string, words binary): normalised words of each item, cut so that every window lies in some piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches, empty=b""):
            ids, cut = [], []
            for item, text in zip(batch.column(0).to_pylist(), texts):
                found = words(folded(text))
                for i in range(0, max(1, len(found) - WINDOW + 1) if found else 0, PIECE_WORDS):
                    ids.append(item)
                    cut.append(b" ".join(found[i : i + PIECE_WORDS + WINDOW - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(cut, pa.binary())], names=["item_id", "words"])

    named = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return named.mapInArrow(run, "item_id string, words binary").distinct()


class Items:
    """Automaton and windows of one block of item pieces."""

    def __init__(self, given: list[tuple[str | None, bytes]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.windows: dict[bytes, set[str]] = {}
        for item, line in given:
            found = line.split(b" ")
            size = min(WINDOW, len(found))
            for i in range(len(found) - size + 1):
                self.windows.setdefault(b" ".join(found[i : i + size]), set()).update([] if item is None else [item])
            seeds = range(0, len(found) - SEED + 1, SEED) if size == WINDOW else [0]
            for i in seeds:
                seed = found[i : i + SEED] if size == WINDOW else found
                pattern = (b" " + b" ".join(seed) + b" ").decode("latin-1")
                # value: the sizes of windows to look up around an occurrence, and the words of the seed
                sizes, _ = self.automaton.get(pattern, (frozenset(), 0))
                self.automaton.add_word(pattern, (sizes | {size}, len(seed)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def windows_in(self, line: bytes) -> dict[int, int]:
        """First word -> words of the longest window that occurs there; ``line``: words between single blanks, one at either end."""
        out: dict[int, int] = {}
        self.named: set[str] = set()
        if not len(self.automaton):
            return out
        blank, seen = None, set()
        for end, (sizes, size) in self.automaton.iter(line.decode("latin-1")):
            if blank is None:
                blank = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            stop = int(np.searchsorted(blank, end))  # words before the seed's end
            for wide in sizes:
                for first in range(max(0, stop - wide), min(stop - size, len(blank) - 1 - wide) + 1):
                    if (first, wide) not in seen:
                        seen.add((first, wide))
                        items = self.windows.get(line[blank[first] + 1 : blank[first + wide]])
                        if items is not None:
                            out[first] = max(out.get(first, 0), wide)
                            self.named |= items
        return out

    def find(self, text: bytes, before: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int, int, int]]]:
        """Number of words; the runs of hit words with ``before`` (first word, words) added: first word, words, start and end in code points."""
        spread = folded(text)
        found = words(spread)
        ranges = [*before, *self.windows_in(b" " + b" ".join(found) + b" ").items()] if found else []
        if not ranges:
            return len(found), []
        step = np.zeros(len(found) + 1, np.int64)
        for first, size in ranges:
            step[first] += 1
            step[first + size] -= 1
        edge = np.diff(np.concatenate([[0], (np.cumsum(step) > 0).view(np.int8), [0]]))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        start, end = places(spread)
        letter = np.cumsum(np.concatenate([[0], (np.frombuffer(text, np.uint8) & 0xC0) != 0x80]))  # code points before each byte
        return len(found), list(zip(low.tolist(), (high - low).tolist(), letter[start[low]].tolist(), letter[end[high - 1]].tolist()))


def _scanned(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``rows`` (row, text binary) with FOUND."""
    out = rows.withColumns({"n_words": F.lit(0).cast("long"), "items": F.lit(None).cast("array<string>"), "hits": F.lit(None).cast("array<struct<first:long,words:long,start:long,end:long>>")})
    kind = out.schema["row"].dataType
    schema = f"row {kind.simpleString()}, text binary, {FOUND}"
    blocks = iter(in_blocks(pieces(items), F.octet_length("words"), [F.col("item_id"), F.col("words")], BLOCK_BYTES))
    given = next(blocks, [])
    while True:
        block = [(r["item_id"], bytes(r["words"])) for r in given]

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            known = Items(block)
            for batch, texts in texts_of(batches, 1 << 20, b""):
                sizes, named, hits = [], [], []
                for text, items, old in zip(texts, batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                    known.named = set()
                    n, found = known.find(text, [(h["first"], h["words"]) for h in old or ()])
                    sizes.append(n)
                    named.append(sorted(known.named.union(items or ())))
                    hits.append([dict(zip(("first", "words", "start", "end"), h)) for h in found])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(named, pa.list_(pa.string())), pa.array(hits, _HITS)], names=["row", "text", "n_words", "items", "hits"])

        out = out.mapInArrow(run, schema)
        given = next(blocks, None)
        if given is None:
            return out
        out = freeze(out, "scanned")


def scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, items (ids of those with a window in the text, sorted), hits (runs of hit words; start and end in code points)."""
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), F.col("text").cast("binary").alias("text"))
    return _scanned(rows, items).select("row.doc_id", "n_words", "items", "hits")


def remove(docs: DataFrame, items: DataFrame, whole: bool = False) -> DataFrame:
    """``docs``, all columns: hit passages cut out of the texts, or with ``whole`` documents with a hit left out."""
    found = _scanned(docs.select(whole_rows(docs), F.col("text").cast("binary").alias("text")), items)
    if whole:
        return found.where("size(hits) = 0").select("row.*")
    pos = F.concat(F.array(F.lit(0).cast("long")), F.transform("hits", lambda h: h["end"]))
    upto = F.concat(F.transform("hits", lambda h: h["start"]), F.array(F.lit(None).cast("long")))
    kept = F.zip_with(pos, upto, lambda a, b: F.substring(F.col("row.text"), (a + 1).cast("int"), F.coalesce(b - a, F.lit(1 << 30)).cast("int")))
    text = F.when(F.size("hits") == 0, F.col("row.text")).otherwise(F.array_join(kept, ""))
    return found.withColumn("row", F.col("row").withField("text", text)).select("row.*")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["words"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
i AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM benchmark),
n AS (SELECT *, least(len(w), 10) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM n, unnest(range(1, len(w) - k + 2)) u(p)),
g AS (SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM win) z, unnest(range(1, len(w) - k + 2)) u(p) WHERE len(w) >= k),
hit AS (SELECT DISTINCT r, item_id, k, p FROM g JOIN win USING (k, g)),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + k)) u(q) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
