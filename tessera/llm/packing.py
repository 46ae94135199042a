"""Packing by power-of-two decomposition: no sequence crosses documents and none needs padding.

A document's n token ids (its text's, then one end id) are cut into as many full pieces of ``capacity`` as fit and the
binary decomposition of the rest, largest first. Each piece is a sequence of its own; pieces of equal length form a
bucket, and sequence numbers run without gaps bucket by bucket, longest first.

Tokenizing: the byte-level pre-tokenizer's words are found over whole slices of text in numpy, each different word is
encoded once by the tokenizers library, and ids are gathered by word. Words are grouped by a 64-bit hash and each is then
compared, character by character, with the one whose ids it gets; on a clash, on a text with a special token's literal or
on unassigned code points the library encodes the whole text.

Defined cases: null text is empty and gives the single end id; null and repeated doc_ids are packed like others; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import freeze, table, texts_of

CAPACITY = 1024
END_ID = 0
#: Words kept by a Python worker between slices; then it starts afresh.
WORDS_KEPT = 2_000_000
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
#: Unicode White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordEncoder:
    """ids of whole texts, word by word, equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kinds = {"L": LETTER, "N": NUMBER}
        self.kind = np.array([UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER) for i in range(0x110000)], np.uint8)
        self.kind[WHITE_SPACE] = SPACE
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a blank, written as this letter
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.power = [np.ones(1, np.uint64)] * 2
        self.forget()

    def forget(self) -> None:
        self.key = np.zeros(0, np.uint64)  # sorted
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        self.word, self.letters = np.zeros(0, np.int64), np.zeros(0, np.int32)  # where each word is among the characters kept, and its length
        self.text, self.filled = np.zeros(1 << 18, np.uint32), 0

    def starts(self, code: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """True where a word starts; doc: the place of each document's first character, then the end."""
        n = len(code)
        first = np.zeros(n, bool)
        first[doc[:-1][doc[:-1] < n]] = True
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        after = np.append(first[1:], True)  # a document ends after this place
        # the last of a run of white space goes with what follows: a blank joins it, another stands alone
        last = (kind == SPACE) & ~after
        last[:-1] &= kind[1:] != SPACE
        at = np.flatnonzero(last)
        start[at] = True
        start[at[code[at] == 32] + 1] = False
        # contractions
        at = np.flatnonzero((code == 39) & start)
        at = at[(at + 1 < n) & ~after[at]]
        one = code[at + 1]
        two = np.where((at + 2 < n) & ~after[np.minimum(at + 1, n - 1)], code[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, end in ((at[short], at[short] + 2), (at[long], at[long] + 3)):
            start[hit + 1] = False
            start[end[end < n]] = True
        return start

    def hashes(self, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(code)
        if len(self.power[0]) < n:
            base = 0x9E3779B97F4A7C15
            for k, factor in enumerate((base, pow(base, -1, 1 << 64))):
                factors = np.full(n + 1, factor, np.uint64)
                factors[0] = 1
                self.power[k] = np.cumprod(factors)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * self.power[0][:n])])
        return (total[end] - total[start]) * self.power[1][start]

    @staticmethod
    def same(one: np.ndarray, at: np.ndarray, size: np.ndarray, other: np.ndarray, place: np.ndarray) -> bool:
        """Whether each one[at:at + size] equals other[place:place + size]."""
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return bool((one[np.repeat(at, size) + step] == other[np.repeat(place, size) + step]).all())

    def learn(self, key: np.ndarray, words: list[str]) -> None:
        """Encode new words and keep them. Words of a blank and letters are encoded as one text, which splits at its blanks."""
        run = self.blank_and_letters(words)
        alone = np.ones(len(words), bool)
        alone[run] = False
        alone = np.flatnonzero(alone).tolist()
        size = np.zeros(len(words), np.int32)
        ids = []
        if len(run):
            encoding = self.tokenizer.encode_batch_fast(["".join([words[i] for i in run])], add_special_tokens=False)[0]
            ids.append(np.array(encoding.ids, np.uint32))
            size[run] = np.diff(np.append(np.flatnonzero(self.opens[ids[-1]]), len(ids[-1])))
        for i, encoding in zip(alone, self.tokenizer.encode_batch_fast([words[i] for i in alone], add_special_tokens=False)):
            ids.append(np.array(encoding.ids, np.uint32))
            size[i] = len(ids[-1])
        order = np.concatenate([np.array(run, np.int64), np.array(alone, np.int64)])
        self.store(key, words, np.concatenate(ids), size, order)

    def store(self, key: np.ndarray, words: list[str], new: np.ndarray, size: np.ndarray, order: np.ndarray) -> None:
        """Keep words with their ids ``new``, which stand in the ``order`` given; ``size``: ids of each word."""
        begin = np.empty(len(words), np.int64)
        begin[order] = self.used + np.cumsum(size[order]) - size[order]
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.fromiter(map(len, words), np.int32, len(words))
        while self.filled + len(code) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros(len(self.text), np.uint32)])
        self.text[self.filled : self.filled + len(code)] = code
        word = self.filled + np.cumsum(letters) - letters
        self.filled += len(code)
        by = np.argsort(np.concatenate([self.key, key]), kind="stable")
        self.key, self.begin, self.size, self.word, self.letters = (np.concatenate(x)[by] for x in ((self.key, key), (self.begin, begin), (self.size, size), (self.word, word), (self.letters, letters)))

    def blank_and_letters(self, words: list[str]) -> np.ndarray:
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        letters = np.add.reduceat((self.kind[code] == LETTER).astype(np.int64), begin)
        return np.flatnonzero((code[begin] == 32) & (letters == size - 1) & (size > 1))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = self.whole(t)
            else:
                plain.append(i)
        joined = "".join([texts[i] for i in plain])
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[code]
        doc = np.cumsum([0, *(len(texts[i]) for i in plain)])
        if (kind == UNKNOWN).any():
            if len(texts) == 1:
                return [self.whole(texts[0])]
            return [self.encode([t])[0] for t in texts]
        if len(code):
            start = np.flatnonzero(self.starts(code, kind, doc))
            end = np.append(start[1:], len(code))
            key = self.hashes(code, start, end)
            number, keys = pd.factorize(key)
            first = np.empty(len(keys), np.int64)
            first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
            own, letters = first[number], end - start
            if (letters[own] != letters).any() or not self.same(code, start, letters, code, start[own]):
                return [self.whole(t) for t in texts]
            if len(self.key) + len(keys) > WORDS_KEPT:
                self.forget()
            at = np.minimum(np.searchsorted(self.key, keys), max(0, len(self.key) - 1))
            new = np.flatnonzero(self.key[at] != keys) if len(self.key) else np.arange(len(keys))
            if len(new):
                self.learn(keys[new], [joined[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
                at = np.searchsorted(self.key, keys)
            if (self.letters[at] != letters[first]).any() or not self.same(code, start[first], letters[first], self.text, self.word[at]):
                return [self.whole(t) for t in texts]
            slot = at[number]
            size = self.size[slot]
            before = np.cumsum(size) - size
            ids = self.flat[np.repeat(self.begin[slot] - before, size) + np.arange(size.sum())]
            ends = np.append(0, np.cumsum(size))[np.searchsorted(start, doc)]
        else:
            ids, ends = np.zeros(0, np.uint32), np.zeros(len(doc), np.int64)
        for j, i in enumerate(plain):
            out[i] = ids[ends[j] : ends[j + 1]]
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Full pieces, then the binary decomposition of the rest, largest first. ``capacity``: a power of two."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, part int, serial long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), and the writing task's part with the serial number of the piece among those of its length there."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, serials = WordEncoder(path), TaskContext.get().partitionId(), {}
        for batch, texts in texts_of(batches, 1 << 20):
            rows: list[list] = [[] for _ in range(6)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                n, at = len(ids) + 1, 0
                data = ids.astype("<u4").tobytes() + int(end_id).to_bytes(4, "little")
                for length in piece_lengths(n, capacity):
                    serial = serials[length] = serials.get(length, -1) + 1
                    for column, value in zip(rows, (doc_id, at, length, n, data[4 * at : 4 * (at + length)], serial)):
                        column.append(value)
                    at += length
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(rows, kinds)), pa.array([part] * len(rows[0]), pa.int32()), pa.array(rows[5], pa.int64())], names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "serial"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def number_sequences(cut: DataFrame) -> DataFrame:
    """``pieces`` (or any columns of it with length, part and serial) with sequence_id and offset instead of part and serial.

    The rows are written once, so that numbers given to a task's rows stay. The running totals are within a length, over one row
    per task; each length's first number comes from the sums of the (few) lengths.
    """
    kept = freeze(cut, "pieces")
    sizes = freeze(kept.groupBy("length", "part").agg(F.count("*").alias("count")), "piece-sizes")
    length = sizes.groupBy("length").agg(F.sum("count").alias("all"))
    before = length.alias("a").join(F.broadcast(length.alias("b")), F.col("b.length") > F.col("a.length"), "left").groupBy("a.length").agg(F.coalesce(F.sum("b.all"), F.lit(0)).alias("before"))
    base = F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")
    sizes = sizes.select("length", "part", base.alias("base")).join(F.broadcast(before), "length")
    numbered = kept.join(sizes.select("length", "part", (F.col("base") + F.col("before")).alias("base")), ["length", "part"])
    columns = [c for c in cut.columns if c not in ("part", "serial")]
    return numbered.select(*columns, (F.col("base") + F.col("serial")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def packed(docs: DataFrame) -> DataFrame:
    cut = pieces(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "part", "serial")
    return number_sequences(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
