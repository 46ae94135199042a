"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a piece model (B) cover the same bytes.

Both sides cut the same bytes, a blank and the text. In each batch, keyed by document, ``pandas.merge_asof`` gives each A
token's start the B token that covers it, and each B token's start its A token; the union of both directions is all
overlaps, as two tokens overlap where the later of their starts lies in the other. Where both sides end together a group ends.

How many documents hold an id pair is counted in three steps that never move a row a link: a chunk of documents (about
``CHUNK_BYTES`` of text) is written as one row with its different pairs and, per document, their numbers and occurrences;
the chunks' pair counts are added up over the corpus; each chunk then asks for its own pairs once and is answered.

Tokens: words (a run of blanks and what follows) are encoded once and kept, as in packing; no piece of B and no
pre-token of A goes past one. A vocabulary where a piece does is encoded text by text.

Defined cases: null and empty texts, and texts whose tokens' bytes on either side are not the blank and the text, have no
tokens: zeros and an empty string; null and repeated doc_ids are rows like others and count as documents of their own; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import freeze, table, texts_of
from tessera.llm.packing import LETTER, SPACE, WordEncoder, default_tokenizer

SLICE_BYTES, CHUNK_BYTES = 1 << 20, 8 << 20
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The published letters of byte-level vocabularies: printable Latin-1 stands for itself, the others for U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Spelled:
    """Bytes of each token id, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        names = [str(i).encode() for i in range(len(tokens))]
        width = len(names[-1]) + 1
        self.digits = np.frombuffer(b"".join(n.ljust(width) for n in names), np.uint8).reshape(-1, width)
        self.n_digits = np.array([len(n) for n in names])

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.bytes[np.repeat(self.begin[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())]


class ByteTokens(WordEncoder):
    """Side A: ids of a blank and a text; special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.special, self.tokenizer.encode_special_tokens = [], True
        letters = byte_letters()
        names = {i: t for t, i in self.tokenizer.get_vocab().items()}
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # an added token's id never comes from plain text
        self.spelled = Spelled([b"" if i in added or i not in names else bytes(letters[c] for c in names[i]) for i in range(max(names) + 1)])


class PieceTokens(WordEncoder):
    """Side B: ids of a text, given with the blank that the model adds."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        one = lambda i, n: bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode()
        self.spelled = Spelled([b"" if self.model.is_control(i) else one(i, n) for i, n in enumerate(names)])
        self.by_words = not any(re.search("[^▁]▁", n) for n in names)
        self.special = []
        self.kind = np.full(0x110000, LETTER, np.uint8)
        self.kind[32] = SPACE
        self.power = [np.ones(1, np.uint64)] * 2
        self.forget()

    def starts(self, code: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """A word starts with each document and at each blank after another character."""
        start = kind == SPACE
        start[1:] &= kind[:-1] != SPACE
        start[doc[:-1][doc[:-1] < len(code)]] = True
        return start

    def encoded(self, words: list[str]) -> list[list[int]]:
        """Words, the blank in front left to the model; a lone blank, which it would take for nothing, as two less one."""
        out = self.model.encode([w[1:] for w in words], num_threads=1)
        lone = self.model.encode("a ")[-1:]
        return [lone if w == " " else ids for w, ids in zip(words, out)]

    def learn(self, key: np.ndarray, words: list[str]) -> None:
        ids = self.encoded(words)
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        self.store(key, words, np.fromiter(chain.from_iterable(ids), np.uint32, size.sum()), size, np.arange(len(ids)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return super().encode(texts) if self.by_words else [self.whole(t) for t in texts]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text[1:], num_threads=1), np.uint32)


def aligned(texts: list[str], a: ByteTokens, b: PieceTokens) -> tuple[list[int], dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
    """Of texts (not empty): places of those with tokens, NUMBERS of each, digests, and all links as place and pair (A id * 2**32 + B id)."""
    whole = [" " + t for t in texts]
    ids = [side.encode(whole) for side in (a, b)]
    size = [[np.array([len(x) for x in own]), np.concatenate([np.zeros(0, np.uint32), *own]).astype(np.int64)] for own in ids]
    data = [w.encode("utf-8", "surrogatepass") for w in whole]
    upto = np.cumsum([len(x) for x in data])
    same = np.ones(len(texts), bool)
    lengths = [np.add.reduceat(np.append(side.spelled.size[flat], 0), np.minimum(np.cumsum(n) - n, len(flat))) * (n > 0) for side, (n, flat) in zip((a, b), size)] if texts else [np.zeros(0, np.int64)] * 2
    for length in lengths:
        same &= length == np.diff(upto, prepend=0)
    for side, own in zip((a, b), ids):
        good = np.flatnonzero(same)
        if len(good):
            spelled = side.spelled.spell(np.concatenate([own[i] for i in good]))
            given = np.frombuffer(b"".join([data[i] for i in good]), np.uint8)
            wrong = np.flatnonzero(spelled != given)
            if len(wrong):
                ends = np.cumsum([len(data[i]) for i in good])
                same[good[np.searchsorted(ends, wrong, side="right")]] = False
    good = np.flatnonzero(same)
    if not len(good):
        return [], {c: np.zeros(0, np.int64) for c in NUMBERS}, [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    tables = []
    for side, own in zip((a, b), ids):
        flat = np.concatenate([own[i] for i in good]).astype(np.int64)
        ends = np.cumsum(side.spelled.size[flat])
        tables.append(pd.DataFrame({"doc": np.repeat(np.arange(len(good)), [len(own[i]) for i in good]), "start": ends - side.spelled.size[flat], "id": flat, "end": ends}))
    left, right = tables
    # starts are counted over the whole batch, so they are in order; the key keeps each document to itself
    over = pd.merge_asof(left, right[["doc", "start", "id"]], on="start", by="doc", suffixes=("", "_b"))
    under = pd.merge_asof(right, left[["doc", "start", "id"]].assign(begin=left["start"]), on="start", by="doc", suffixes=("", "_a"))
    under = under[under["begin"] != under["start"]]  # equal starts are the first direction's already
    doc = np.concatenate([over["doc"].to_numpy(), under["doc"].to_numpy()])
    pair = np.concatenate([over["id"].to_numpy() << 32 | over["id_b"].to_numpy(np.int64), under["id_a"].to_numpy(np.int64) << 32 | under["id"].to_numpy()])
    shared = np.intersect1d(left["end"].to_numpy(), right["end"].to_numpy(), assume_unique=True)
    n = {"n_a": np.bincount(left["doc"], minlength=len(good)), "n_b": np.bincount(right["doc"], minlength=len(good)), "n_links": np.bincount(doc, minlength=len(good))}
    n["n_groups"] = np.bincount(left["doc"].to_numpy()[np.searchsorted(left["end"].to_numpy(), shared)], minlength=len(good))
    return good.tolist(), n, digests(left, right, shared, len(good), a.spelled, b.spelled), doc, pair


def digests(left: pd.DataFrame, right: pd.DataFrame, shared: np.ndarray, docs: int, a: Spelled, b: Spelled) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` per document, decimal ids."""
    ends = [t["end"].to_numpy() for t in (left, right)]
    doc = np.concatenate([left["doc"], right["doc"]])
    group = np.concatenate([np.searchsorted(shared, e) for e in ends])  # ends within a group come before its own
    side = np.repeat([0, 1], [len(left), len(right)])
    order = np.argsort(group * 2 + side, kind="stable")
    width = max(a.digits.shape[1], b.digits.shape[1])
    line = np.zeros((len(order), width), np.uint8)
    line[: len(left), : a.digits.shape[1]] = a.digits[left["id"]]
    line[len(left) :, : b.digits.shape[1]] = b.digits[right["id"]]
    digits = np.concatenate([a.n_digits[left["id"]], b.n_digits[right["id"]]])
    mark = np.where(np.isin(np.concatenate(ends), shared), np.where(side == 0, ord("|"), ord(";")), ord(","))
    line[np.arange(len(order)), digits] = mark
    line, digits, doc = line[order], digits[order] + 1, doc[order]
    text = line[np.arange(width) < digits[:, None]].tobytes()
    stop = np.cumsum(np.bincount(doc, digits, docs).astype(np.int64))
    return [hashlib.sha256(text[i : j - 1]).hexdigest() for i, j in zip([0, *stop[:-1].tolist()], stop.tolist())]


CHUNK = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<int>, which binary, times binary, keys binary, held binary"


class Chunk:
    """Rows of documents gathered until they make a row of CHUNK."""

    def __init__(self) -> None:
        self.bytes, self.ids = 0, []
        self.numbers: dict[str, list] = {c: [] for c in NUMBERS}
        self.digest: list[str] = []
        self.doc, self.pair = [], []

    def add(self, ids: list, texts: list[str], a: ByteTokens, b: PieceTokens) -> None:
        asked = [i for i, t in enumerate(texts) if t]
        good, n, digest, doc, pair = aligned([texts[i] for i in asked], a, b)
        rows = np.array([asked[i] for i in good], np.int64)
        for c in NUMBERS:
            full = np.zeros(len(texts), np.int64)
            full[rows] = n[c]
            self.numbers[c].append(full)
        named = [""] * len(texts)
        for i, x in zip(rows.tolist(), digest):
            named[i] = x
        self.digest += named
        self.doc.append(rows[doc] + len(self.ids))
        self.pair.append(pair)
        self.ids += ids
        self.bytes += sum(map(len, texts))

    def row(self, number: int) -> pa.RecordBatch:
        code, keys = pd.factorize(np.concatenate(self.pair))
        own, times = np.unique(np.concatenate(self.doc) * max(1, len(keys)) + code, return_counts=True)
        doc, which = np.divmod(own, max(1, len(keys)))
        values = {"chunk": number, "doc_id": self.ids} | {c: np.concatenate(x) for c, x in self.numbers.items()}
        values |= {"groups_sha256": self.digest, "pairs": np.bincount(doc, minlength=len(self.ids)).astype(np.int32), "which": which.astype("<i4").tobytes(), "times": times.astype("<i4").tobytes()}
        values |= {"keys": keys.astype("<i8").tobytes(), "held": np.bincount(which, minlength=len(keys)).astype("<i4").tobytes()}
        kinds = {"chunk": pa.int64(), "doc_id": pa.list_(pa.int64()), **{c: pa.list_(pa.int64()) for c in NUMBERS}, "groups_sha256": pa.list_(pa.string()), "pairs": pa.list_(pa.int32()), **dict.fromkeys(("which", "times", "keys", "held"), pa.binary())}
        return pa.RecordBatch.from_arrays([pa.array([values[c]], kind) for c, kind in kinds.items()], names=list(kinds))


def chunks(docs: DataFrame, byte_tokens: str | None = None, piece_tokens: str | None = None) -> DataFrame:
    """CHUNK rows: documents' numbers and digests in lists; ``pairs`` per document of ``which`` (place among ``keys``) and ``times`` (links); ``held``: documents of the chunk with a key."""
    paths = byte_tokens or default_tokenizer(), piece_tokens or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ByteTokens(paths[0]), PieceTokens(paths[1])
        number, chunk = TaskContext.get().partitionId() << 33, Chunk()
        for batch, texts in texts_of(batches, SLICE_BYTES):
            chunk.add(batch.column(0).to_pylist(), texts, a, b)
            if chunk.bytes >= CHUNK_BYTES:
                yield chunk.row(number)
                number, chunk = number + 1, Chunk()
        if chunk.ids:
            yield chunk.row(number)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNK)


def chunk_keys(kept: DataFrame) -> DataFrame:
    """(chunk, place, a, b, held): a row per chunk and pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, keys, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys, held = np.frombuffer(keys, "<i8"), np.frombuffer(held, "<i4")
                parts = [np.full(len(keys), chunk), np.arange(len(keys), dtype=np.int32), (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), held]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["chunk", "place", "a", "b", "held"])

    return kept.select("chunk", "keys", "held").mapInArrow(run, "chunk long, place int, a int, b int, held int")


def pair_counts(keys: DataFrame) -> DataFrame:
    """(a, b, count, best): documents that hold the pair linked; whether no other pair of its A id has more."""
    counts = keys.groupBy("a", "b").agg(F.sum("held").alias("count"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_tokens: str | None = None, piece_tokens: str | None = None) -> DataFrame:
    """Per document doc_id, NUMBERS, n_best, count_sum and groups_sha256."""
    kept = freeze(chunks(docs, byte_tokens, piece_tokens), "aligned")
    keys = freeze(chunk_keys(kept), "aligned-pairs")
    answers = keys.select("chunk", "place", "a", "b").join(pair_counts(keys), ["a", "b"]).select("chunk", "place", "count", "best")

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        place = right.column("place").to_numpy()
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        row = left.to_pylist()[0]
        which, times = np.frombuffer(row["which"], "<i4"), np.frombuffer(row["times"], "<i4").astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(row["pairs"])]).astype(np.int64)
        sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (times * best[which], times * count[which])]
        names = ["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"]
        columns = [row["doc_id"], *(row[c] for c in NUMBERS), *sums, row["groups_sha256"]]
        return pa.table([pa.array(x, pa.string() if n == "groups_sha256" else pa.int64()) for n, x in zip(names, columns)], names=names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return kept.drop("keys", "held").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answer, schema)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
