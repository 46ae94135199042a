"""Secret scans: rules find base spans, and a character convolutional network judges every candidate in its context.

Candidates are the base spans; every run of ``[A-Za-z0-9+/_=-]`` of ``LEAST`` characters or more; and the value of
``LEAST_VALUE`` or more after any ``name =`` or ``name:``. Of a run or value that base spans overlap, each stretch outside them
of that length. Each is read as one window: the characters before it, its own and those after; one longer than a window as
several, each ``STEP`` further, whose scores are averaged. The network (character vectors, one convolution, mean and maximum
pooling, a softmax-like sigmoid) runs in numpy and is trained on labelled findings; its scores are calibrated on findings set
aside, and its threshold is the highest that still recalls ``RECALL`` of the true ones there that no base rule names (base
spans stay without it). Base spans always stay; a candidate at or over the threshold is added as kind ``token``.

Labelled findings: the base spans of a bounded sample of documents (true), those of the sample's other candidates that have a
known harmless shape (false; the rest may be secrets and have no label), and as many generated ones of kinds that no rule
names: random keys of ``KEYS`` after other names (true); ``PLAIN`` text (false). ``UNSEEN_KEYS`` and ``UNSEEN_PLAIN`` are shapes
that no training run generates; ``unseen_report`` measures recall and false alarms on them.

Defined cases: null text is empty and has no spans; null and repeated doc_ids are scanned like others (a null one is not in the
sample); an empty table gives no rows; other columns, of any name, are kept by ``redact`` and not read; overlapping findings all
count, and redaction covers their union.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, texts_of

#: Fixed patterns of the base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # greedy runs, so the same as runs of 24 or more
NAMES = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "token")
LEAST, LEAST_VALUE = 16, 8
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: A value after the end of a name; ``named`` looks at the name.
VALUE = re.compile(rf"""(?<=[A-Za-z0-9_.-])["']?\x20*[:=]\x20*["']?([^\s"'<>,;]{{{LEAST_VALUE},}})""")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
ENDS = ".,:!?)]}"
#: Known harmless shapes: words (in one case, or the first letter capital) and numbers, one or several joined by marks; marks alone; a time.
_PIECE = r"(?>[A-Z]?[a-z]++[0-9]{0,4}+|[A-Z]++|[0-9]++)"
HARMLESS = re.compile(rf"[+/_=-]*+(?:{_PIECE}(?:[+/_=-]++|\Z))*+|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{4,6}}Z?")
#: Letters of one case of which so many follow each other, and as many digits, are no words or numbers of a text.
LONG_WORD, LONG_NUMBER = 30, 20

SAMPLE_DOCS = 3_000
#: Findings of the sample that training takes, the first by a hash.
MOST_FINDINGS = 24_000
#: Generated findings at least.
GENERATED = 6_000
RECALL = 0.97
BEFORE, OWN, AFTER = 24, 40, 8
WIDTH, STEP = BEFORE + OWN + AFTER, 32
SYMBOLS, VECTOR, FILTERS, REACH = 98, 8, 24, 5
BATCH, RATE = 64, 0.15
#: Passes over the findings: so many that there are STEPS batches, EPOCHS at least.
EPOCHS, STEPS = 5, 1500

Span = tuple[int, int, int]  # kind's place in KINDS, start, end


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(n in low for n in NAMES):
            out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def named(text: str, end: int) -> bool:
    """Whether the run of name characters that ends here has a letter at its start or after a mark, as names of any length have."""
    letter = False
    while end and text[end - 1] in NAME:
        end -= 1
        if text[end].isalpha():
            letter = True
        elif text[end].isdigit():
            letter = False
        elif letter:
            return True
    return letter and not (end and text[end - 1].isascii() and text[end - 1].isalnum())


def other_candidates(text: str, base: list[Span]) -> list[Span]:
    """Runs and values, cut around the base spans that overlap them; a stretch counts by its own length."""
    found = [(m.start(), m.end(), LEAST) for m in RUN.finditer(text)]
    if ":" in text or "=" in text:
        found += [(m.start(1), m.start(1) + len(m[1].rstrip(ENDS)), LEAST_VALUE) for m in VALUE.finditer(text) if named(text, m.start())]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    out = set()
    for start, end, least in found:
        at, i = start, bisect_left(starts, start)
        while i and any(e > start for _, e in taken[max(0, i - len(KINDS)) : i]):
            i -= 1
        for s, e in taken[i:]:
            if s >= end:
                break
            if e > at:
                if s - at >= least:
                    out.add((3, at, s))
                at = e
        if end - at >= least:
            out.add((3, at, end))
    return sorted(out)


def harmless(run: str) -> bool:
    """Whether a run is of words and numbers, each of letters of one case or of digits alone and of usual length, or of marks, or a time."""
    return HARMLESS.fullmatch(run) is not None and not any(len(p) > (LONG_NUMBER if p.isdigit() else LONG_WORD) for p in re.split("[+/_=-]+", run))


def tiles(start: int, end: int) -> list[tuple[int, int]]:
    """The stretches of at most ``OWN`` characters as which a candidate is read."""
    if end - start <= OWN:
        return [(start, end)]
    return [(at, at + OWN) for at in (*range(start, end - OWN, STEP), end - OWN)]


def window(text: str, start: int, end: int) -> np.ndarray:
    """Symbols around a stretch of at most ``OWN`` characters: 0 for nothing, 1 for any character outside printable ASCII, else the character."""
    own = text[start:end].ljust(OWN, "\0")
    before, after = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), text[end : end + AFTER].ljust(AFTER, "\0")
    code = np.frombuffer((before + own + after).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(code == 0, 0, np.where((code >= 32) & (code < 127), code - 30, 1))


class CharNet:
    def __init__(self, seed: int = 1):
        rng = self.rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.3, (SYMBOLS, VECTOR)).astype(np.float32)
        self.mask = np.zeros((WIDTH, 1), np.float32)
        self.mask[BEFORE : BEFORE + OWN] = 1
        self.kernel = rng.normal(0, 1 / np.sqrt(REACH * (VECTOR + 1)), (REACH * (VECTOR + 1), FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.out, self.bias = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.float32(0)
        self.slope, self.level, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        put = np.concatenate([self.vectors[x], np.broadcast_to(self.mask, (len(x), WIDTH, 1))], axis=2)
        seen = np.lib.stride_tricks.sliding_window_view(put, REACH, axis=1).swapaxes(2, 3).reshape(len(x), WIDTH - REACH + 1, -1)
        fired = np.maximum(seen @ self.kernel + self.shift, 0)
        top = fired.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(fired, top[:, None, :], 1)[:, 0], fired.mean(axis=1)], axis=1)
        return seen, fired, top, pooled, pooled @ self.out + self.bias

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        epochs = max(EPOCHS, -(-STEPS * BATCH // len(x)))
        for epoch in range(epochs):
            order = self.rng.permutation(len(x))
            rate = np.float32(RATE * (1 - epoch / epochs))
            for low in range(0, len(order), BATCH):
                part = order[low : low + BATCH]
                seen, fired, top, pooled, z = self._forward(x[part])
                error = ((1 / (1 + np.exp(-z)) - y[part]) / len(part)).astype(np.float32)
                back = error[:, None] * self.out[None, :]
                self.out -= rate * 4 * pooled.T @ error
                self.bias -= rate * 4 * error.sum()
                grad = np.repeat(back[:, None, FILTERS:] / fired.shape[1], fired.shape[1], axis=1)
                rows, cols = np.indices(top.shape)
                grad[rows, top, cols] += back[:, :FILTERS]
                grad *= fired > 0
                to_seen = (grad @ self.kernel.T).reshape(*grad.shape[:2], REACH, VECTOR + 1)
                self.kernel -= rate * 4 * seen.reshape(-1, seen.shape[2]).T @ grad.reshape(-1, FILTERS)
                self.shift -= rate * 4 * grad.sum(axis=(0, 1))
                change = np.zeros_like(self.vectors)
                for r in range(REACH):
                    np.add.at(change, x[part][:, r : r + grad.shape[1]], to_seen[:, :, r, :VECTOR])
                self.vectors -= rate * 4 * change

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[4].astype(float) for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL, counts: np.ndarray | None = None) -> None:
        """Platt's scale on findings set aside, then the highest threshold with that recall of the true ones that ``counts`` marks (all)."""
        z = self.raw(x)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z + b)))
            a, b = a - 0.1 * ((p - y) * z).mean(), b - 0.1 * (p - y).mean()
        self.slope, self.level = a, b
        true = np.sort(self.scores(x)[(y > 0) & (True if counts is None else counts)])
        self.threshold = float(true[int((1 - recall) * len(true))]) if len(true) else 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.raw(x))

    def scaled(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * raw + self.level)))

    def judge(self, spans: Iterable[tuple[str, int, int]]) -> np.ndarray:
        """A score per candidate (text, start, end)."""
        windows, counts = [], []
        raw = [np.zeros(0)]
        for text, start, end in spans:
            parts = tiles(start, end)
            counts.append(len(parts))
            for s, e in parts:
                windows.append(window(text, s, e))
                if len(windows) == 4096:
                    raw.append(self.raw(np.stack(windows)))
                    windows = []
        if windows:
            raw.append(self.raw(np.stack(windows)))
        counts, raw = np.array(counts, np.int64), np.concatenate(raw)
        return self.scaled(np.add.reduceat(raw, np.cumsum(counts) - counts) / counts) if len(counts) else raw


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
NAMES_OF_KEYS = ["key: ", "auth=", "credential = ", "bearer ", "private_key: ", "", "access ", "pwd=", "signature: ", 'client_key = "']


class Shapes:
    """Strings of random keys and of plain text, by shape."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def pick(self, letters: str, n: int) -> str:
        return "".join(self.rng.choice(list(letters), n))

    def word(self, low: int = 3, high: int = 9) -> str:
        return self.pick("etaoinshrdlucmfeataoin", int(self.rng.integers(low, high)))

    def key(self, shape: str, n: int) -> str:
        pick, mixed = self.pick, LOWER + UPPER + DIGITS
        match shape:
            case "mixed":
                return pick(mixed, n)
            case "base64":
                return pick(mixed + "+/", n) + "="
            case "hex":
                return pick(DIGITS + ("abcdef", "ABCDEF")[n % 2], n)
            case "sk":
                return "sk_" + pick(LOWER + DIGITS, n)
            case "ghp":
                return "ghp_" + pick(mixed, 36)
            case "upper":
                return pick(UPPER + DIGITS, n)
            case "both cases":
                return pick(LOWER + UPPER, n)
            case "short value":
                return pick(mixed + "!#%*", int(self.rng.integers(10, 16)))
            case "uuid":
                return "-".join(pick(DIGITS + "abcdef", k) for k in (8, 4, 4, 4, 12))
            case "xoxb":
                return f"xoxb-{pick(DIGITS, 12)}-{pick(mixed, 24)}"
            case "glpat":
                return "glpat-" + pick(mixed + "-_", 20)
            case "jwt":
                return f"eyJ{pick(mixed, 33)}.eyJ{pick(mixed, 60)}.{pick(mixed + '-_', 43)}"
            case "url-safe":
                return pick(mixed + "-_", 43)
        raise ValueError(shape)

    def plain(self, shape: str) -> str:
        pick, word, number = self.pick, self.word, lambda n: int(self.rng.integers(n))
        match shape:
            case "path":
                return "/".join(word() for _ in range(4)) + str(number(99))
            case "kebab":
                return "-".join(word() for _ in range(3)) + "-" + str(number(2020))
            case "snake":
                return "_".join(word() for _ in range(3)) + str(number(9))
            case "camel":
                return "".join(word().title() for _ in range(4)) + str(number(99))
            case "time":
                return "2024-01-" + pick(DIGITS, 2) + "T" + pick(DIGITS, 6) + "Z"
            case "page":
                return pick(DIGITS, 12) + "page" + pick(DIGITS, 3)
            case "query":
                return word() + "=" + word() + "123" + word()
            case "word":
                return self.word(8, 28)
            case "Word":
                return self.word(8, 28).title()
            case "WORD":
                return self.word(8, 28).upper()
            case "number":
                return pick(DIGITS, 8 + number(12))
            case "marks":
                return pick("-=_", 1) * (16 + number(60))
            case "url":
                return f"https://{word()}.example.org/{word()}/{word()}?{word()}={number(99)}"
            case "mail":
                return f"{word()}.{word()}@{word()}.example.com"
            case "version":
                return f"v{number(9)}.{number(20)}.{number(99)}-{word()}.{number(9)}"
            case "isbn":
                return f"978-{number(9)}-{pick(DIGITS, 4)}-{pick(DIGITS, 4)}-{number(9)}"
            case "file":
                return f"{word()}_{word()}-{number(2024)}.{word(3, 4)}.gz"
        raise ValueError(shape)


KEYS = ["mixed", "base64", "hex", "sk", "ghp", "upper", "both cases", "short value"]
UNSEEN_KEYS = ["uuid", "xoxb", "glpat", "jwt", "url-safe"]
PLAIN = ["path", "kebab", "snake", "camel", "time", "page", "query", "word", "Word", "WORD", "number", "marks"]
UNSEEN_PLAIN = ["url", "mail", "version", "isbn", "file"]


def generated(n: int, rng: np.random.Generator, keys: list[str] = KEYS, plain: list[str] = PLAIN) -> list[tuple[str, int, int, int]]:
    """Findings (text, start, end, label), half of them true."""
    shapes, out = Shapes(rng), []
    for i in range(n):
        if i % 2:
            shape = keys[int(rng.integers(len(keys)))]
            value = shapes.key(shape, int(rng.integers(16, 64)))
            names = [x for x in NAMES_OF_KEYS if x[-1:] in ("=", "\"", " ") and len(x) > 3] if shape == "short value" else NAMES_OF_KEYS
            name = names[int(rng.integers(len(names)))]
        else:
            value = shapes.plain(plain[int(rng.integers(len(plain)))])
            name = ["", "see ", "file ", "id ", "on: ", "at ", "title = ", "name: "][int(rng.integers(8))]
        lead = "".join(shapes.word(2, 16) + (" ", " ", ", ", "!! ")[int(rng.integers(4))] for _ in range(4)) + name
        if rng.random() < 0.25:
            lead = lead.upper()
        tail = (" ", '" ', ", ", ". ")[int(rng.integers(4))] + shapes.word(3, 14)
        if rng.random() < 0.25:
            tail = tail.upper()
        out.append((lead + value + tail, len(lead), len(lead) + len(value), i % 2))
    return out


def sample_findings(docs: DataFrame, most: int = SAMPLE_DOCS, findings: int = MOST_FINDINGS) -> list[tuple[str, int, int, int]]:
    """Findings in the ``most`` documents that come first by a hash of doc_id, each as the stretches as which it is read, in as much text as a window shows; ``findings`` of them at most, the first by a hash."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in texts_of(batches):
            rows = []
            for t in texts:
                base = base_spans(t)
                for kind, start, end in base + [c for c in other_candidates(t, base) if harmless(t[c[1] : c[2]])]:
                    for s, e in tiles(start, end):
                        low = max(0, s - BEFORE)
                        rows.append({"text": t[low : e + AFTER], "start": s - low, "end": e - low, "label": int(kind < 3)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32())]))

    found = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(ids), "_id").select("_id", "text").mapInArrow(run, "text string, start int, end int, label int")
    rows = found.orderBy(F.xxhash64("text", "start", "end"), "text", "start", "end", "label").limit(findings).collect()
    return [(r["text"], r["start"], r["end"], r["label"]) for r in rows]


def train(findings: list[tuple[str, int, int, int]], seed: int = 1) -> CharNet:
    """A calibrated network from labelled findings (text, start, end, label)."""
    net = CharNet(seed)
    rows = [(t, s, e, label) for t, start, end, label in findings for s, e in tiles(start, end)]
    x = np.stack([window(t, s, e) for t, s, e, _ in rows])
    y = np.array([label for *_, label in rows], float)
    unnamed = np.array([not any(low < e and s < high for _, low, high in base_spans(t)) for t, s, e, _ in rows])
    order = net.rng.permutation(len(x))
    aside, rest = order[: len(x) // 4], order[len(x) // 4 :]
    net.fit(x[rest], y[rest])
    net.calibrate(x[aside], y[aside], counts=unnamed[aside])
    return net


def fit(docs: DataFrame, seed: int = 1) -> CharNet:
    own = sample_findings(docs)
    return train(own + generated(max(GENERATED, len(own)), np.random.default_rng(seed)), seed)


def unseen_report(net: CharNet, n: int = 2000, seed: int = 77) -> dict[str, float]:
    """By shape that no training run generates: the share found, of keys, and the share of false alarms, of plain text."""
    out = {}
    for keys, plain in ((UNSEEN_KEYS, [PLAIN[0]]), ([KEYS[0]], UNSEEN_PLAIN)):
        for shape in keys if keys is UNSEEN_KEYS else plain:
            rows = generated(n // 5, np.random.default_rng(seed), *(([shape], plain) if keys is UNSEEN_KEYS else (keys, [shape])))
            rows = [r for r in rows if r[3] == (keys is UNSEEN_KEYS)]
            out[shape] = float((net.judge((t, s, e) for t, s, e, _ in rows) >= net.threshold).mean())
    return out


def find(texts: list[str], net: CharNet) -> list[list[tuple[int, int, int, float]]]:
    """Per text its spans (kind, start, end, score) by start, then kind: all base ones, and candidates at or over the threshold."""
    spans = []
    for t in texts:
        base = base_spans(t)
        spans.append(base + other_candidates(t, base))
    scores = iter(net.judge((t, s, e) for t, mine in zip(texts, spans) for _, s, e in mine).tolist())
    out = []
    for mine in spans:
        scored = [(k, s, e, next(scores)) for k, s, e in mine]
        out.append(sorted((x for x in scored if x[0] < 3 or x[3] >= net.threshold), key=lambda x: (x[1], x[0], x[2])))
    return out


FOUND = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"


def scan(docs: DataFrame, net: CharNet) -> DataFrame:
    """(doc_id, spans) per document; start and end in code points, end exclusive."""
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "score": p} for k, s, e, p in row] for row in find(texts, net)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kinds)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def redact(docs: DataFrame, net: CharNet, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns, with each span of secrets in text replaced by ``mark`` and n_chars, if there, set to the new length."""

    def clean(text: str, spans: list) -> str:
        out, at = [], 0
        for _, s, e, _ in spans:
            if s > at or not out:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            new = [clean(t, f) if f else t for t, f in zip(texts, find(texts, net))]
            held = batch.column(batch.schema.get_field_index("text"))
            new = [n if ok else None for n, ok in zip(new, held.is_valid().to_pylist())]
            columns = [pa.array(new, f.type) if f.name == "text" else c for c, f in zip(batch.columns, batch.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "token")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
