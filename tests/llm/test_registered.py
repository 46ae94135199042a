"""The first ten queries as registered, on written tables: a text over a megabyte, columns that clash, and empty tables."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import packing, registry, secrets

CLASH = ["cid", "list", "probe", "n", "row", "shard", "chunk", "payload", "fp", "fingerprint", "score", "spans", "vector", "_size", "range", "copies", "length", "text_"]
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
}
TEN = [q for q in registry.QUERIES if int(q[2:].split("_")[0]) <= 10]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    long = prose(180_000)
    some = [prose(120) for _ in range(40)]
    return [long, some[0], some[0] + " " + long[700_000:700_400], long[:300] + "\n" + some[1], "", None, 'password: "hunter2hunter2" ' + some[2], *some, prose(50) + " é " + long[-90:]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, texts):
    path = tmp_path_factory.mktemp("registered")
    rng = np.random.default_rng(2)
    tables = {
        "documents": [(i, t, "en", "hot" if i % 3 else None, 1) for i, t in enumerate(texts)],
        "embeddings": [(i, (np.eye(8)[i % 4] + (0.001 if i % 4 < 2 else 0.3) * rng.normal(size=8)).tolist(), i % 2) for i in range(40)],
        "pages": [(i, "u", (t or "") if i % 2 else texts[0]) for i, t in enumerate(texts[:12])],
        "labels": [(i, i % 2, 0) for i in range(len(texts))],
    }
    for name, rows in tables.items():
        frame = spark.createDataFrame(rows, SCHEMAS[name])
        frame.repartition(3).write.parquet(f"{path}/plain/{name}.parquet")
        frame.select("*", *[F.lit(j).alias(c) for j, c in enumerate(CLASH)]).coalesce(2).write.parquet(f"{path}/clash/{name}.parquet")
        frame.limit(0).write.parquet(f"{path}/none/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", TEN)
def test_clashing_columns_and_empty_tables(spark, folder, name):
    """Columns of other names and other files change nothing; no rows give none, of the same columns."""
    query = registry.QUERIES[name]
    one, two = (query(spark, f"{folder}/{kind}") for kind in ("plain", "clash"))
    columns = [c for c in one.columns if c not in ("group_id", "sequence_id")]
    if name == "op9_mixing":  # carries the columns of its input
        columns = [c for c in columns if c not in CLASH]
    rows = [sorted(map(str, df.select(columns).collect())) for df in (one, two)]
    assert rows[0] == rows[1] and rows[0]
    none = query(spark, f"{folder}/none")
    assert none.count() == 0 and none.columns == one.columns


def test_repeats_of_a_long_text(spark, folder, texts):
    got = {r["doc_id"]: r for r in registry.QUERIES["op4_suffix_dedup"](spark, f"{folder}/plain").collect()}
    seen = set()
    for i, t in enumerate(texts):
        b = (t or "").encode()
        own = {b[p : p + 50] for p in range(len(b) - 49)}
        gone = np.zeros(len(b) + 2, np.int8)
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                gone[p + 1 : p + 51] = 1
        seen |= own
        kept = bytes(np.frombuffer(b, np.uint8)[gone[1:-1] == 0])
        want = (len(b), len(b) - len(kept), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest())
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want
    assert sum(r["n_spans"] > 0 for r in got.values()) >= 4


def test_a_long_text_elsewhere(spark, folder, texts):
    run = lambda name: registry.QUERIES[name](spark, f"{folder}/plain")
    assert len(texts[0]) > 1 << 20
    pieces = run("op5_packing").where("doc_id = 0").orderBy("start").collect()
    ids = packing.WordEncoder(packing.default_tokenizer()).whole(texts[0])
    assert sum(r["length"] for r in pieces) == len(ids) + 1 == pieces[0]["doc_tokens"] and max(r["length"] for r in pieces) == 1024
    words = texts[0].split()
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)], np.uint64)
    bits = sum(1 << k for k in range(64) if 2 * int((hashes >> np.uint64(k) & np.uint64(1)).sum()) > len(hashes))
    assert run("op10_simhash").where("doc_id = 0").first()["fingerprint"] == f"{bits:016x}"
    (found,) = run("op1_secrets").where("n_assign > 0").collect()
    assert found["doc_id"] == 6 and found["base_sha256"] == hashlib.sha256(b"assign:0:25").hexdigest()
    page = run("op7_warc").where("page_id = 0").first()
    assert (page["payload_bytes"], page["payload_digest"]) == (len(texts[0]), hashlib.sha1(texts[0].encode()).hexdigest())
