"""Quality classifier: supervised subword embeddings.

A text's words (split at white space, with their marks and case) and the character n-grams of each whole word, between ``<``
and ``>``, are hashed into buckets with learned vectors; a word may be of any length. So are two kinds of word n-grams: pairs of
neighbouring words as they stand, and runs of up to ``REACH`` words by how far back each last stood in the document (nowhere,
or the distance's power of two). The latter have the same buckets whatever the words are, so that training learns from some
repeated lines and words what others look like. A document is the mean of its features' vectors, a linear layer
and softmax give the probability of label 1, and all is trained by numpy stochastic gradient descent, with weight decay; the
rate is chosen on an inner fold of the training rows. As the layer is linear, a word adds fixed amounts to the document's two
sums, which workers keep for words they have met.

The fit uses at most ``TRAIN_ROWS`` labelled rows, those first by a hash of doc_id; of rows that repeat a labelled doc_id the
smallest label counts (of rows of ``docs`` that repeat it the smallest text), and only documents outside the held-out fold take part. Scores never see labels, lang, source or doc_id.

Defined cases: null and empty texts score as the bias alone; a null doc_id is scored (held_out null); null labels are not
learned from; without any usable label each score is 0.5; an empty table gives no rows; other columns are kept by
``keep_good`` and not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, texts_of

TRAIN_ROWS = 3_000
BUCKETS, DIMENSION, BATCH = 1 << 15, 8, 32
#: Rates tried on the inner fold; weight decay per batch, as a share of the rate.
RATES, DECAY = (0.25, 0.5, 1.0), 1e-4
#: Words of a run by distances, and the powers of two told apart; features that a pair and a run count.
REACH, LEVELS = 4, 16
PAIR_WEIGHT, RUN_WEIGHT = 1, 2
#: Passes over the rows: so many that there are STEPS batches, EPOCHS at least.
EPOCHS, STEPS = 5, 600
NGRAMS = (2, 4)
FOLDS = 5
THRESHOLD = 0.3
#: Words whose sums a worker keeps before it starts afresh.
WORDS_KEPT = 300_000
#: Words of more characters are hashed in tiles of ``TILE`` characters and their sums not kept.
SHORT, TILE = 40, 1 << 14


def word_buckets(word: str) -> list[int]:
    """Buckets of a short word itself and of its n-grams."""
    data = f"<{word}>".encode("utf-8", "surrogatepass")
    crc = zlib.crc32
    out = [crc(data, 1) % BUCKETS]
    if len(data) == len(word) + 2:
        for n in range(NGRAMS[0], NGRAMS[1] + 1):
            out += [crc(data[i : i + n]) % BUCKETS for i in range(len(data) - n + 1)]
        return out
    at = [i for i, b in enumerate(data) if b & 0xC0 != 0x80] + [len(data)]  # where characters start
    for n in range(NGRAMS[0], NGRAMS[1] + 1):
        out += [crc(data[i:j]) % BUCKETS for i, j in zip(at, at[n:])]
    return out


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def run_buckets(word: str) -> Iterator[np.ndarray]:
    """The same buckets as ``word_buckets`` of a word of any length, a tile of its characters at a time."""
    word = f"<{word}>"
    yield np.array([zlib.crc32(word.encode("utf-8", "surrogatepass"), 1) % BUCKETS])
    most = NGRAMS[1]
    for low in range(0, len(word), TILE):
        code = np.frombuffer(word[low : low + TILE + most - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)  # bytes of each character's UTF-8
        wide = int(size.max())
        octets = []
        for k in range(wide):
            tail = code >> (6 * np.maximum(size - 1 - k, 0)).astype(np.uint32)
            lead = np.where(size == 1, code, tail | np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[size]) if k == 0 else tail & 0x3F | 0x80
            octets.append(lead.astype(np.uint32) & 0xFF)
        crc = np.full(min(TILE, len(code)), 0xFFFFFFFF, np.uint32)
        for n in range(1, most + 1):
            crc = crc[: len(code) - n + 1]
            here = slice(n - 1, n - 1 + len(crc))
            for k in range(wide):
                next_ = _CRC[(crc ^ octets[k][here]) & 0xFF] ^ crc >> np.uint32(8)
                crc = next_ if k == 0 else np.where(size[here] > k, next_, crc)
            if n >= NGRAMS[0] and len(crc):
                yield ((crc ^ np.uint32(0xFFFFFFFF)) % BUCKETS).astype(np.int64)


def mixed(value: np.ndarray) -> np.ndarray:
    return ((value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BUCKETS


def word_ngrams(number: np.ndarray, code: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(weight, buckets) of a text's word n-grams. ``number``: equal for equal words and only for them; ``code``: a word's hash."""
    if len(code) > 1:
        yield PAIR_WEIGHT, mixed(code[:-1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + code[1:].astype(np.uint64))
    order = np.argsort(number, kind="stable")
    again = number[order[1:]] == number[order[:-1]]
    level = np.zeros(len(number), np.int64)
    back = order[1:][again] - order[:-1][again]
    level[order[1:][again]] = 1 + np.minimum(np.log2(back).astype(np.int64), LEVELS - 2)
    run = level
    for n in range(1, min(REACH, len(level)) + 1):
        if n > 1:
            run = run[: len(level) - n + 1] * LEVELS + level[n - 1 :]
        yield RUN_WEIGHT, mixed(run * LEVELS + n)


def features(text: str, kept: dict[str, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, share of the text's features) of one text. ``kept``: buckets of short words met so far."""
    kept = {} if kept is None else kept
    counts: dict[str, int] = {}
    words = text.split()
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    total = np.zeros(BUCKETS)
    short = [w for w in counts if len(w) <= SHORT]
    if short:
        lists = []
        for w in short:
            if w not in kept:
                kept[w] = word_buckets(w)
            lists.append(kept[w])
        weight = np.repeat(np.array([counts[w] for w in short], float), [len(x) for x in lists])
        total += np.bincount(np.concatenate(lists), weight, BUCKETS)
    for w in counts:
        if len(w) > SHORT:
            for at in run_buckets(w):
                total += np.bincount(at, minlength=BUCKETS) * counts[w]
    place = {w: i for i, w in enumerate(counts)}
    number = np.array([place[w] for w in words])
    for weight, at in word_ngrams(number, np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in counts])[number]):
        total += weight * np.bincount(at, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, (total[at] / total.sum()).astype(np.float32)


class Model:
    def __init__(self, seed: int = 2, rate: float = 0.5):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSION)).astype(np.float32)
        self.layer, self.bias = np.zeros((DIMENSION, 2), np.float32), np.zeros(2, np.float32)
        self.rng, self.rate = rng, rate

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> "Model":
        batches = -(-len(rows) // BATCH)
        epochs = max(EPOCHS, -(-STEPS // batches))
        steps, total = 0, epochs * batches
        for _ in range(epochs):
            order = self.rng.permutation(len(rows))
            for low in range(0, len(order), BATCH):
                part = order[low : low + BATCH]
                shares = self._dense([rows[i] for i in part])
                hidden = shares @ self.vectors
                error = self.softmax(hidden @ self.layer + self.bias)
                error[np.arange(len(part)), labels[part]] -= 1
                rate = self.rate * (1 - steps / total)
                back = error @ self.layer.T
                self.layer -= rate * hidden.T @ error / len(part) * 4
                self.bias -= rate * error.mean(0)
                self.vectors *= np.float32(1 - rate * DECAY)
                self.vectors -= np.float32(rate * 4) * (shares.T @ back)
                steps += 1
        return self

    @staticmethod
    def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for i, (at, share) in enumerate(rows):
            out[i, at] = share
        return out

    def loss(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> float:
        p = np.concatenate([self.softmax(self._dense(rows[i : i + BATCH]) @ self.vectors @ self.layer + self.bias) for i in range(0, len(rows), BATCH)])
        return float(-np.log(np.maximum(p[np.arange(len(rows)), labels], 1e-9)).mean())

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def scorer(self) -> "Scorer":
        return Scorer((self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0]))


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """A model of all the rows' ``features``, with the rate that does best on every fifth row when fitted on the others."""
    inner = np.arange(len(rows)) % FOLDS == 0
    rate = RATES[len(RATES) // 2]
    if len(rows) >= 4 * FOLDS:
        pick = lambda mask: ([rows[i] for i in np.flatnonzero(mask)], labels[mask])
        rate = min(RATES, key=lambda r: Model(rate=r).fit(*pick(~inner)).loss(*pick(inner)))
    return Model(rate=rate).fit(rows, labels)


class Scorer:
    """Probability of label 1 of whole texts, from each bucket's part in the difference of the two sums."""

    def __init__(self, part: np.ndarray, bias: float):
        self.part, self.bias = part, bias
        self.forget()

    def forget(self) -> None:
        """No word is kept: its place in the arrays of parts, numbers of features and hashes."""
        self.slot: dict[str, int] = {}
        self.used = 0
        self.sums, self.size, self.code = np.zeros(1 << 10), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.uint64)

    def learn(self, word: str) -> int:
        if len(word) <= SHORT:
            tiles = [np.array(word_buckets(word))]
        else:
            tiles = run_buckets(word)
        sums, size = 0.0, 0
        for at in tiles:
            sums, size = sums + float(self.part[at].sum()), size + len(at)
        if self.used == len(self.sums):
            self.sums, self.size, self.code = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.size, self.code))
        i = self.used
        self.sums[i], self.size[i], self.code[i] = sums, size, zlib.crc32(word.encode("utf-8", "surrogatepass"))
        self.used += 1
        return i

    def __call__(self, text: str) -> float:
        words = text.split()
        if not words:
            return float(1 / (1 + np.exp(-self.bias)))
        if self.used > WORDS_KEPT:
            self.forget()
        number = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        long: dict[str, int] = {}  # not kept
        for i in np.flatnonzero(number < 0).tolist():
            w = words[i]
            known = self.slot if len(w) <= SHORT else long
            if w not in known:
                known[w] = self.learn(w)
            number[i] = known[w]
        total, n = self.sums[number].sum(), int(self.size[number].sum())
        for weight, at in word_ngrams(number, self.code[number]):
            total, n = total + weight * self.part[at].sum(), n + weight * len(at)
        for w in long:  # their places stay unused until all are forgotten
            self.sums[long[w]] = 0.0
        return float(1 / (1 + np.exp(-(self.bias + total / n))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Scorer:
    """The scorer fitted on ``most`` labelled rows at most; tasks work their features out, so that no text goes to the driver."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_quality")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("t")).join(F.broadcast(chosen), "_id")
    # one row per doc_id before any goes to the driver: the smallest text, null first
    rows = rows.groupBy("_id", "_quality").agg(F.min(F.struct("t"))["t"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            kept: dict[str, list[int]] = {}
            found = [features(t, kept) for t in texts]
            data = [pa.array([x.astype(kind).tobytes() for x in column], pa.binary()) for column, kind in zip(zip(*found), ("<u2", "<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *data], names=["_id", "_quality", "at", "share"])

    rows = rows.select("_id", F.col("_quality").cast("int").alias("_quality"), "text").mapInArrow(run, "_id long, _quality int, at binary, share binary").toPandas().sort_values("_id")
    if not len(rows):
        return Scorer(np.zeros(BUCKETS), 0.0)
    found = [(np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(share, "<f4")) for at, share in zip(rows["at"], rows["share"])]
    return fitted(found, (rows["_quality"].to_numpy() > 0).astype(np.int64)).scorer()


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) of each row."""
    part, bias = scorer.part, scorer.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(part, bias)
        for batch, texts in texts_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own(t) for t in texts], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows that score under ``threshold``."""
    part, bias = scorer.part, scorer.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(part, bias)
        for batch, texts in texts_of(batches):
            yield batch.filter(pa.array([own(t) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
