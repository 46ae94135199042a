"""Long repeated byte strings across documents, by run-length indexes over shards of the corpus.

1. Documents are packed, as they are read, into chunk rows in a table bucketed by chunk, which later steps join
   without moving the text again.
2. Every ``length``-byte window has an anchor: the least hash of the ``GRAM``-byte strings in it, which equal windows
   share wherever they stand. Each chunk sends its anchors (once each, 31 bits beside the shard's number, with a mark
   when two documents have it) to shards; those of two chunks or with the mark come back. Other windows cannot repeat.
3. Runs of windows with one returned anchor are strings. Of each distinct string of a chunk its hash, its anchor and
   its smallest doc_id in the chunk go to the anchor's shard, which answers: the string is in a smaller document and
   goes whole; nothing else under the anchor has a say; or other strings of the anchor may hold some of its windows.
4. Only strings of the last kind move, from the chunk with the smallest doc_id, and meet by anchor. A shard passes over
   windows whose hash one document alone has under the anchor, and halves each anchor's documents again and again: the
   smaller half's strings are the reference, of which a run-compressed Burrows-Wheeler index is built, the larger half's
   are streamed through it, and what matches ``length`` bytes goes.
   An anchor with over ``MANY_STRINGS`` strings is dealt by its windows' hashes instead, so no shard holds it whole.
5. The answers return to the chunk; every byte of a window with a smaller doc_id elsewhere goes.

Strings are told apart by their anchor and a 64-bit hash of their bytes.

Defined cases: null text is empty; a null doc_id counts as larger than any other, and is not smaller than another null;
rows with the same doc_id never remove from one another; texts under ``length`` bytes stay whole; an empty table gives
no rows; other columns are not read.

The session's Arrow batches are set to ``BATCH_BYTES``: the last step runs when the result is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import freeze, shared_dir, table
from tessera.llm.runindex import in_smaller, words_at

GRAM = 20
CHUNK_BYTES = 4 << 20
#: Bytes of an Arrow batch; set in the session, as the last step runs when the result is read.
BATCH_BYTES = 8 << 20
#: Bytes of strings, and anchors or windows, for which one shard is planned. Every chunk sends a row to every shard, so that few and
#: wide ones keep the rows' number down, which grows with the square of the corpus; a shard's strings are indexed some at a time.
SHARD_BYTES, SHARD_ANCHORS = 32 << 20, 1 << 21
#: Shards for each core, or as many as shuffle partitions if those are fewer, where the corpus alone would call for less.
CORE_SHARDS = 16
#: Distinct strings of one anchor that a shard indexes; beyond, they are dealt by window.
MANY_STRINGS = 1 << 14
#: Longest run of windows in one string.
RUN_WINDOWS = 256
NO_ID = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(text: np.ndarray) -> np.ndarray:
    w = words_at(text)
    n = len(text) - GRAM + 1
    h = _mix(w[:n])
    h = _mix(h ^ w[8 : 8 + n])
    return _mix(h ^ w[GRAM - 8 : GRAM - 8 + n]) >> np.uint64(1)


def keys(anchor: np.ndarray, shards: int) -> np.ndarray:
    """Shard (upper half) and 31 other bits of the anchor."""
    a = _mix(anchor)
    return ((a >> np.uint64(33)) % np.uint64(shards)) << np.uint64(32) | a & np.uint64(0x7FFFFFFF)


def window_runs(text: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of each run of windows with one anchor, over documents laid end to end."""
    anchors, firsts, counts = [], [], []
    tile = 1 << 20
    ends = np.cumsum(sizes)
    whole = len(text) - length + 1
    for low in range(0, max(whole, 0), tile):
        high = min(low + tile, whole)
        h = gram_hashes(text[low : high + length - 1])
        span, width = length - GRAM + 1, 1
        while 2 * width <= span:
            h = np.minimum(h[: len(h) - width], h[width:])
            width *= 2
        if width < span:
            h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
        # windows that cross a document's end are out
        place = np.arange(low, high)
        inside = np.ones(high - low, bool)
        for e in ends[np.searchsorted(ends, low, side="right") : np.searchsorted(ends, high + length, side="left")]:
            inside[max(0, e - length + 1 - low) : max(0, min(e, high) - low)] = False
        cut = np.concatenate([[True], (h[1:] != h[:-1]) | (inside[1:] != inside[:-1])])
        first = np.flatnonzero(cut)
        count = np.diff(np.concatenate([first, [len(h)]]))
        ok = inside[first]
        first, count = first[ok], count[ok]
        if len(count) and count.max() > RUN_WINDOWS:
            pieces = -(-count // RUN_WINDOWS)
            step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = np.repeat(first, pieces) + step * RUN_WINDOWS
            count = np.minimum(RUN_WINDOWS, np.repeat(count, pieces) - step * RUN_WINDOWS)
        anchors.append(h[first])
        firsts.append(place[first])
        counts.append(count)
    if not anchors:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(anchors), np.concatenate(firsts), np.concatenate(counts)


def _bucketed(rows: DataFrame, name: str, buckets: int) -> str:
    """The rows as a table bucketed by chunk, its files in the shared folder."""
    rows.write.option("compression", "zstd").option("path", f"{shared_dir(rows.sparkSession)}/{name}").bucketBy(buckets, "chunk").saveAsTable(name)
    return name


def _chunks(docs: DataFrame, buckets: int) -> str:
    """Name of a table of chunk rows: chunk, doc_ids, sizes, text (the documents' bytes end to end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # unique for each row that a task writes; whichever attempt commits is what later steps read
        part, serial = TaskContext.get().partitionId(), 0
        ids, parts, total = [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            sizes = [len(p) for p in parts]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + serial]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())], names=["chunk", "doc_ids", "sizes", "text"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = t.as_buffer() if t.is_valid else b""
                ids.append(i)
                parts.append(bytes(data) if data else b"")
                total += len(parts[-1])
                if total >= CHUNK_BYTES:
                    yield row()
                    ids, parts, total = [], [], 0
        if ids:
            yield row()

    name = "chunks_" + uuid.uuid4().hex
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "chunk long, doc_ids array<long>, sizes array<long>, text binary")
    return _bucketed(rows, name, buckets)


def _laid_out(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array([NO_ID if i is None else i for i in row["doc_ids"]], np.int64)
    return ids, np.array(row["sizes"], np.int64), np.frombuffer(row["text"], np.uint8)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _kind(*binary: str) -> pa.Schema:
    return pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), *((n, pa.binary()) for n in binary)])


def _anchor_rows(length: int, shards: int):
    kind = _kind("anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, sizes, text = _laid_out(row)
            anchor, first, _ = window_runs(text, sizes, length)
            if not len(anchor):
                continue
            owner = ids[np.searchsorted(np.cumsum(sizes), first, side="right")]
            key = keys(anchor, shards)
            by = np.argsort(key)
            key, owner = key[by], owner[by]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            several = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head)
            shard = (key[head] >> np.uint64(32)).astype(np.int64)
            packed = key[head].astype(np.uint32) << np.uint32(1) | several
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            yield _batch([{"shard": shard[a], "chunk": row["chunk"], "anchors": packed[a:b].tobytes()} for a, b in zip(cuts, [*cuts[1:], len(packed)])], kind)

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each shard; rows come sorted by shard."""
    held: list[dict] = []
    for row in _rows(batches):
        if held and held[0]["shard"] != row["shard"]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _joined(rows: list[dict], name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join([r[name] for r in rows]), kind)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each shard's anchors those that repeat, back to their chunks."""
    for rows in _by_shard(batches):
        packed = _joined(rows, "anchors", np.uint32)
        source = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r["anchors"]) // 4 for r in rows])
        by = np.argsort(packed, kind="stable")
        packed, source = packed[by], source[by]
        anchor = packed >> np.uint32(1)
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        head = np.flatnonzero(new)
        repeats = (np.diff(np.append(head, len(anchor))) > 1) | (np.maximum.reduceat(packed & np.uint32(1), head) > 0)
        keep = repeats[np.cumsum(new) - 1]
        anchor, source = anchor[keep], source[keep]
        by = np.argsort(source, kind="stable")
        anchor, cuts = anchor[by], np.searchsorted(source[by], np.arange(len(rows) + 1))
        yield _batch([{"shard": r["shard"], "chunk": r["chunk"], "anchors": anchor[a:b].tobytes()} for r, a, b in zip(rows, cuts, cuts[1:]) if b > a], _kind("anchors"))


def pack_ids(ids: np.ndarray) -> bytes:
    """The least id and what the others have beyond it, in as few bytes as all of them fit in."""
    low = ids.min()
    over = ids.view(np.uint64) - low.view(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or over.max() >> np.uint64(8 * w) == 0)
    return low.tobytes() + over.astype(f"<u{width}").tobytes()


def unpack_ids(data: bytes, n: int) -> np.ndarray:
    return (np.frombuffer(data, f"<u{(len(data) - 8) // n}", n, 8).astype(np.uint64) + np.frombuffer(data, np.uint64, 1)).view(np.int64)


PART = ("anchors", "hashes", "lowest", "sizes", "copies", "places")
_PART = pa.struct([("shard", pa.int64()), *((n, pa.binary()) for n in PART)])
STRINGS = f"chunk long, parts array<struct<shard:long,{','.join(n + ':binary' for n in PART)}>>"


def _string_rows(length: int, before: int, shards: int):
    """Per chunk and shard its distinct strings: 31 bits of the anchor, hash, smallest doc_id, bytes, and the places of its copies, smallest doc_id first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, sizes, text = _laid_out(row)
            anchor, first, count = window_runs(text, sizes, length)
            known = np.sort(np.concatenate([np.frombuffer(x["anchors"], np.uint32).astype(np.uint64) | np.uint64(x["shard"] << 32) for x in row["back"]]))
            key = keys(anchor, before)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key)
            first, size, key = first[at], count[at] + length - 1, keys(anchor[at] + np.uint64(1), shards)
            owner = ids[np.searchsorted(np.cumsum(sizes), first, side="right")]
            data, digest = row["text"], xxhash.xxh3_64_digest
            value = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(first.tolist(), (first + size).tolist())]), np.uint64)
            by = np.lexsort((owner, value, key))
            first, size, key, owner, value = first[by], size[by], key[by], owner[by], value[by]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (value[1:] != value[:-1])]))
            ends = np.append(new[1:], len(key))
            shard = (key[new] >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(new)]):
                h = new[a:b]
                out.append({"shard": int(shard[a]), "anchors": key[h].astype(np.uint32).tobytes(), "hashes": value[h].tobytes(), "lowest": pack_ids(owner[h]), "sizes": size[h].astype(np.uint32).tobytes(), "copies": (ends[a:b] - h).astype(np.int32).tobytes(), "places": first[h[0] : ends[b - 1]].astype(np.int32).tobytes()})
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([out], pa.list_(_PART))], names=["chunk", "parts"])

    return run


def _only(strings: DataFrame, *names: str) -> DataFrame:
    """The strings' table with these fields of its parts; the scan reads no others."""
    kind = ",".join(f"{n}:{'long' if n == 'shard' else 'binary'}" for n in names)
    return strings.select("chunk", F.arrays_zip(*(F.col(f"parts.{n}") for n in names)).cast(f"array<struct<{kind}>>").alias("parts"))


#: What becomes of a string: none of its windows is elsewhere in a smaller document; all are; its anchor's other strings decide; likewise, but they are many.
STAYS, GOES, OTHERS, MANY = range(4)


def _answers(many: int):
    """Per (shard, chunk): for each string what becomes of the copy in the chunk's smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches):
            anchor, value = _joined(rows, "anchors", np.uint32), _joined(rows, "hashes", np.uint64)
            counts = [len(r["anchors"]) // 4 for r in rows]
            low = np.concatenate([unpack_ids(r["lowest"], n) for r, n in zip(rows, counts)])
            by = np.lexsort((value, anchor))
            a, v, d = anchor[by], value[by], low[by]
            new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
            new = new_anchor | np.concatenate([[True], v[1:] != v[:-1]])
            string, under = np.cumsum(new) - 1, np.cumsum(new_anchor) - 1
            least = np.minimum.reduceat(d, np.flatnonzero(new))
            heads = np.flatnonzero(new_anchor)
            kinds = np.bincount(under, new)
            several = (kinds > 1) & (np.minimum.reduceat(d, heads) != np.maximum.reduceat(least[string], heads))
            code = np.where(d > least[string], GOES, np.where(several, np.where(kinds > many, MANY, OTHERS), STAYS)[under])
            out = np.empty(len(by), np.uint8)
            out[by] = code
            ends = np.cumsum(counts)
            parts = [out[i:j] for i, j in zip(ends - counts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array([r["shard"] for r in rows], pa.int64()), pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([int((p == MANY).sum()) for p in parts], pa.int64())], names=["shard", "chunk", "codes", "many"])

    return run


def _codes(row: dict) -> dict[int, np.ndarray]:
    return {x["shard"]: np.frombuffer(x["codes"], np.uint8) for x in row["codes"] or []}


def _owners(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids of a chunk's documents, and their ends."""
    return np.array([NO_ID if i is None else i for i in row["doc_ids"]], np.int64), np.cumsum(np.array(row["sizes"], np.int64))


def _copies(part: dict, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per copy: its string and place; per string: bytes and smallest doc_id; per copy its doc_id."""
    copies, place = np.frombuffer(part["copies"], np.int32), np.frombuffer(part["places"], np.int32).astype(np.int64)
    return np.repeat(np.arange(len(copies)), copies), place, np.frombuffer(part["sizes"], np.uint32).astype(np.int64), unpack_ids(part["lowest"], len(copies)), ids[np.searchsorted(ends, place, side="right")]


def _of(row: dict, code: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Per part of a chunk with strings of that code: the part, which strings they are, their places and sizes."""
    codes = _codes(row)
    for part in row["parts"] or []:
        at = np.flatnonzero(codes[part["shard"]] == code)
        if len(at):
            copies = np.frombuffer(part["copies"], np.int32)
            first = np.frombuffer(part["places"], np.int32)[(np.cumsum(copies) - copies)[at]].astype(np.int64)
            yield part, at, first, np.frombuffer(part["sizes"], np.uint32)[at].astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings that others decide on, to their shard."""
    for row in _rows(batches):
        out = []
        for part, at, first, size in _of(row, OTHERS):
            text = b"".join([row["text"][a:b] for a, b in zip(first.tolist(), (first + size).tolist())])
            low = unpack_ids(part["lowest"], len(part["sizes"]) // 4)[at]
            out.append({"shard": part["shard"], "chunk": row["chunk"], "text": text, "sizes": size.astype(np.uint32).tobytes(), "anchors": np.frombuffer(part["anchors"], np.uint32)[at].tobytes(), "lowest": pack_ids(low)})
        if out:
            yield _batch(out, _kind("text", "sizes", "anchors", "lowest"))


def _streamed(length: int):
    """Per (shard, chunk): a bit for each window of its strings, whether a smaller document has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches):
            size = _joined(rows, "sizes", np.uint32).astype(np.int64)
            counts = [len(r["sizes"]) // 4 for r in rows]
            low = np.concatenate([unpack_ids(r["lowest"], n) for r, n in zip(rows, counts)])
            windows = size - length + 1
            hit = in_smaller(_joined(rows, "text", np.uint8), np.cumsum(size) - size, windows, _joined(rows, "anchors", np.uint32), low, length)
            ends = np.concatenate([[0], np.cumsum(windows)])[np.concatenate([[0], np.cumsum(counts)])]
            yield _batch([{"shard": r["shard"], "chunk": r["chunk"], "hits": np.packbits(hit[a:b]).tobytes()} for r, a, b in zip(rows, ends, ends[1:])], _kind("hits"))

    return run


def _single_windows(row: dict, length: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, hash, place, doc_id) of each window of the strings under anchors with many, of each copy in the chunk's smallest document, by key and place."""
    place, low = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ids, ends = _owners(row)
    for part in row["parts"] or []:
        string, at, size, least, owner = _copies(part, ids, ends)
        pick = np.flatnonzero((_codes(row)[part["shard"]] == MANY)[string] & (owner == least[string]))
        n = size[string[pick]] - length + 1
        place.append(np.repeat(at[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum()))
        low.append(np.repeat(owner[pick], n))
    at, low = np.concatenate(place), np.concatenate(low)
    data = row["text"]
    value = np.frombuffer(b"".join([xxhash.xxh3_64_digest(data[a : a + length]) for a in at.tolist()]), np.uint64)
    key = keys(value, shards)
    by = np.lexsort((at, key))
    return key[by], value[by], at[by], low[by]


def _window_rows(length: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            key, value, _, low = _single_windows(row, length, shards)
            shard = (key >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])[: len(shard)])
            out = [{"shard": shard[a], "chunk": row["chunk"], "anchors": key[a:b].astype(np.uint32).tobytes(), "hashes": value[a:b].tobytes(), "lowest": pack_ids(low[a:b])} for a, b in zip(cuts, [*cuts[1:], len(key)])]
            if out:
                yield _batch(out, _kind("anchors", "hashes", "lowest"))

    return run


def _removed_windows(row: dict, n: int, length: int, shards: int) -> np.ndarray:
    """True where a window of a smaller document's starts, over the chunk's n bytes."""
    depth, one = np.zeros(n + 1, np.int32), np.zeros(n, bool)
    hits, codes = {x["shard"]: x["hits"] for x in row["hits"] or []}, _codes(row)
    ids, ends = _owners(row)
    for part in row["parts"] or []:
        string, place, size, low, owner = _copies(part, ids, ends)
        code, windows = codes[part["shard"]], size - length + 1
        whole = (owner > low[string]) | (code == GOES)[string]
        np.add.at(depth, place[whole], 1)
        np.add.at(depth, (place + windows[string])[whole], -1)
        if part["shard"] in hits:
            count = windows * (code == OTHERS)
            begin = np.cumsum(count) - count
            found = np.unpackbits(np.frombuffer(hits[part["shard"]], np.uint8), count=int(count.sum())) > 0
            pick = np.flatnonzero((code == OTHERS)[string] & (owner == low[string]))  # each copy in the smallest document
            m = windows[string[pick]]
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            gone = found[np.repeat(begin[string[pick]], m) + step]
            one[(np.repeat(place[pick], m) + step)[gone]] = True
    if row["single"]:
        at = _single_windows(row, length, shards)[2]
        code = np.concatenate([np.frombuffer(x["codes"], np.uint8) for x in sorted(row["single"], key=lambda x: x["shard"])])
        one[at[code == GOES]] = True
    return one | (np.cumsum(depth[:-1]) > 0)


def _cut(length: int, shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        _, sizes, text = _laid_out(row)
        before = np.concatenate([np.zeros(length, np.int32), np.cumsum(_removed_windows(row, len(text), length, shards), dtype=np.int32)])
        gone = before[length:] > before[:-length]  # a removed window starts at one of the last ``length`` places
        ends = np.cumsum(sizes)
        edge = np.concatenate([[False], gone, [False]])
        kept, spans = [], []
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):
            g = edge[a : b + 2].copy()
            g[0] = g[-1] = False
            at = np.flatnonzero(g[1:] != g[:-1])
            kept.append(text[a:b][~gone[a:b]].tobytes() if len(at) else row["text"][a:b])
            spans.append(at.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "kept", "edges"])


def remove_repeats(docs: DataFrame, length: int = 50, many: int = MANY_STRINGS) -> DataFrame:
    """(doc_id, n_bytes, kept binary, edges array<long>) per document.

    ``kept``: its bytes outside every ``length``-byte string that a document with a smaller doc_id also has;
    ``edges``: start, end, start, end ... of the removed runs. ``many``: see MANY_STRINGS; it changes no result.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    # a row here is a chunk of megabytes; small Arrow batches keep few of them in a worker at once
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = spark.table(_chunks(docs, parts))
    total = chunks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    met = lambda df, n: df.repartition(int(n), "shard").sortWithinPartitions("shard")
    by_chunk = lambda df, name, *columns: df.groupBy("chunk").agg(F.collect_list(F.struct("shard", *columns)).alias(name))

    least = min(parts, CORE_SHARDS * spark.sparkContext.defaultParallelism)
    before = max(least, total // 14 // SHARD_ANCHORS)
    sent = chunks.mapInArrow(_anchor_rows(length, before), "shard long, chunk long, anchors binary")
    back = freeze(met(sent, before).mapInArrow(_repeated, "shard long, chunk long, anchors binary"), "anchors")
    size = back.agg(F.coalesce(F.sum(F.octet_length("anchors")), F.lit(0))).first()[0] // 4 * (length + 18)
    shards = max(least, size // SHARD_BYTES)
    rows = chunks.join(by_chunk(back, "back", "anchors"), "chunk").mapInArrow(_string_rows(length, before, shards), STRINGS)
    strings = spark.table(_bucketed(rows, "strings_" + uuid.uuid4().hex, parts))

    digests = ("shard", "anchors", "hashes", "lowest")
    sent = _only(strings, *digests).select("chunk", F.inline("parts")).select("shard", "chunk", *digests[1:])
    answers = freeze(met(sent, shards).mapInArrow(_answers(many), "shard long, chunk long, codes binary, many long"), "answers")
    asked = chunks.join(_only(strings, "shard", "anchors", "lowest", "sizes", "copies", "places"), "chunk").join(by_chunk(answers, "codes", "codes"), "chunk")
    sent = asked.mapInArrow(_texts, "shard long, chunk long, text binary, sizes binary, anchors binary, lowest binary")
    hits = freeze(met(sent, shards).mapInArrow(_streamed(length), "shard long, chunk long, hits binary"), "hits")
    dealt = answers.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    wide = max(least, dealt * RUN_WINDOWS // SHARD_ANCHORS)
    if not dealt:
        single = answers.select("shard", "chunk", "codes").where("false")
    else:
        sent = asked.mapInArrow(_window_rows(length, wide), "shard long, chunk long, anchors binary, hashes binary, lowest binary")
        single = freeze(met(sent, wide).mapInArrow(_answers(many), "shard long, chunk long, codes binary, many long"), "windows")
    told = chunks.join(_only(strings, "shard", "lowest", "sizes", "copies", "places"), "chunk", "left").join(by_chunk(answers, "codes", "codes"), "chunk", "left")
    told = told.join(by_chunk(hits, "hits", "hits"), "chunk", "left").join(by_chunk(single, "single", "codes"), "chunk", "left")
    return told.mapInArrow(partial(_cut, length, wide), "doc_id long, n_bytes long, kept binary, edges array<long>")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), (F.size("edges") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
