"""The pipeline's stages against brute force over planted cases."""

import hashlib
import math
import pathlib
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import near_copies, packing, quality, secrets


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    """Smallest doc_id reachable over pairs of Jaccard 0.8 or more."""
    sets = {i: brute_set(t) for i, t in rows}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    group = {}
    for i in sorted(sets):
        if i not in group:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in group:
                    group[k] = i
                    todo += [j for j in sets if j not in group and alike(sets[k], sets[j])]
    return group


def planted():
    """Texts with copies of which some words are replaced, so that pairs lie on both sides of 0.8."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([40, 120, 300, 900]))]
        rows.append(base)
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            rows.append([word() if rng.random() < share else w for w in base])
        rows.append(base[: int(len(base) * 0.85)])
    chain = [word() for _ in range(400)]
    for step in range(8):  # each text is like the next one only
        rows.append(chain[step * 30 : step * 30 + 190])
    rng.shuffle(rows)
    out = [(i, " ".join(r)) for i, r in enumerate(rows)]
    return out + [(9000, "one two"), (9001, "One  two"), (9002, ""), (9003, None), (9004, " ")]


def test_near_duplicates_stage(spark):
    rows = planted()
    docs = spark.createDataFrame(rows + [(None, rows[0][1])], "doc_id long, text string").repartition(3)
    want = brute_groups(rows)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()} == want
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(want.values())) and kept.count(None) == 1
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_near_duplicates_by_pivot_tables(spark, monkeypatch):
    """Without a shared band, pairs come by op10's fingerprints and pivot tables: chains of 4 bits are grouped, the sets decide."""
    rows = planted()
    prints = {i: near_copies.simhash.set_fingerprint(near_copies.shingle_set(t or "")) for i, t in rows}
    near = lambda i: [j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4]
    sets = {i: brute_set(t) for i, t in rows}
    group, want = {}, {}
    for into, start, others in ((group, sets, near), (want, sets, lambda i: [j for j in sets if group[i] == group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])):
        for i in sorted(start):
            todo = [] if i in into else [i]
            while todo:
                k = todo.pop()
                if k not in into:
                    into[k] = i
                    todo += [j for j in others(k) if j not in into]
    assert len(set(group.values())) < len(set(want.values())) < len(rows) - 60  # the sets part some, and the tables bring many together
    real = near_copies._sketches
    monkeypatch.setattr(near_copies, "_sketches", lambda docs: real(docs).withColumn("bands", F.array(F.xxhash64("key"))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()} == want


def test_groups_around_one_text_and_loose_ones(spark, monkeypatch):
    """Copies of one text that are not alike among themselves, the same without that text, and bands cut into parts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    rows = []
    for hub in (True, False):
        base = [word() for _ in range(80)]
        rows += [base] * hub
        for _ in range(150):
            copy = list(base)
            for at in rng.sample(range(10, 70), rng.choice([1, 1, 2])):
                copy[at] = word()
            rows.append(copy)
    rng.shuffle(rows)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    want = brute_groups(rows)
    monkeypatch.setattr(near_copies, "PART", 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()} == want


def test_block_comparison():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, 9000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, k, False), rng.integers(0, 1 << 60, 40, dtype=np.uint64)])) for k in rng.integers(6500, 9000, 30)]
    sets += [np.zeros(0, np.uint64), np.array([5], np.uint64), np.array([5], np.uint64), np.zeros(0, np.uint64)]
    group = np.arange(len(sets))
    group[3] = group[31]
    label = near_copies.linked(sets, group, 0.8)
    for i in range(len(sets)):
        reach, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j in range(len(sets)) if group[j] == group[k] or near_copies.similarity(sets[j], sets[k]) >= 0.8} - reach
            reach |= new
            todo += new
        assert label[i] == min(reach)


def brute_copies(doc_id, rate):
    """Poisson count of one document, by its md5."""
    u = (int(hashlib.md5(f"9|1|{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
    k, p = 0, math.exp(-rate)
    total = p
    while u > total:
        k += 1
        p *= rate / k
        total += p
    return k


def test_whole_pipeline(spark):
    """run() against each stage's rule applied in turn in plain Python, on planted copies, junk, secrets, nulls and repeated rows."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8)))
    texts = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(30, 200))]
        if i % 3 == 0:
            texts += [" ".join(w for w in words for _ in range(5))]
        else:
            texts += [" ".join(words), " ".join(words[:-1] + ["changed"])]
    texts += ['see token = "abcdef123456" and ' + "0123456789abcdef" * 2 + " " + " ".join(word() for _ in range(80)), "", None, "short text"]
    rows = [(i, t, "en", [None, "a", "b", "b"][i % 4], len(t or ""), 1, 2) for i, t in enumerate(texts)]
    rows += [rows[1], (None, texts[4], "en", "a", 5, 1, 2)]
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "pipeline"
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, rate int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    junk = {i for i, t in enumerate(texts) if t and sum(map(str.__eq__, t.split(), t.split()[1:])) > 20}
    spark.createDataFrame([(i, int(i not in junk)) for i in range(len(texts)) if i % 4], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, str(folder)).collect())

    scorer = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left = [r for r in rows if scorer(r[1] or "") >= quality.THRESHOLD]
    assert junk and not junk & {r[0] for r in left} and len(left) > len(texts) - len(junk) - 3
    group = brute_groups([(r[0], r[1]) for r in left if r[0] is not None])
    left = [r for r in dict.fromkeys(left) if r[0] is None or group[r[0]] == r[0]]
    net = secrets.fit(spark.createDataFrame(left, schema))
    clean = []
    for r, spans in zip(left, secrets.find([r[1] or "" for r in left], net)):
        text, at = "", 0
        for _, s, e, _ in spans:
            if s > at or not text and not at:
                text += (r[1][at:s]) + "[SECRET]"
            at = max(at, e)
        clean.append((r[0], text + (r[1] or "")[at:] if spans else r[1], r[3]))
    assert any("[SECRET]" in (t or "") for _, t, _ in clean)
    n = Counter(s for *_, s in clean)
    total = sum(math.sqrt(k) for k in n.values())
    encoder, want = packing.WordEncoder(packing.default_tokenizer()), Counter()
    for i, text, source in clean:
        rate = math.sqrt(n[source]) / total * len(clean) / n[source]
        ids = [*encoder.whole(text or "").tolist(), 0]
        copies = brute_copies(i if i is not None else "text:" + hashlib.md5((text or "").encode()).hexdigest(), rate)
        at = 0
        for length in packing.piece_lengths(len(ids)):
            want[i, at, length, zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()), len(ids)] += copies
            at += length
    assert got == +want


def test_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "empty"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, str(folder)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(folder)).columns == docs.columns
