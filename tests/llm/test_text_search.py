"""Alignment, decontamination and ranked search on awkward small tables against brute force."""

import collections
import hashlib
import math
import random
import re

import duckdb
import pytest

from tessera.llm import alignment, decontamination, lexical

DOCS = "doc_id long, text string, row int, n int, items string, words int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "What is the capital of the river that flows by the old stone bridge near Évora town 7"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    common = ["river", "stone", "the", "of", "bridge", "Évora", "x1", "naïve", "汉字", "ÅNGSTRÖM"]
    prose = lambda n: " ".join(rng.choices(common, k=n))
    some = ["", None, "one", " ", "a ", "  a  b   ", "tail\n\n", "<|endoftext|> <s></s> <unk> <0x41>", "bad ▁ mark", "\u0000�\U0001f600", ITEM, f"{prose(30)} {ITEM.upper().replace(' ', '--')}! {prose(9)}", " ".join(ITEM.split()[3:14]) + " " + " ".join(ITEM.split()[2:12]), " ".join(ITEM.split()[:9]), "short answer here; short ANSWER"]
    return some + [prose(k) for k in (1, 9, 40, 40, 700)] + [some[11]] * 2


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 1, 2, "x", 3) for i, t in enumerate(texts)] + [(None, texts[10], None, None, None, None), (4, texts[11], 0, 0, "y", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(4)
    rows = [(1, ITEM), (2, "short answer"), (10, "the river the bridge"), (3, ITEM.lower()), (4, None), (5, "..."), (1, ITEM), (None, "naïve 汉字 x1"), (6, " ".join(rng.choices(["river", "stone", "the", "of"], k=400))), (7, "absent words only")]
    return spark.createDataFrame(rows, "item_id long, text string")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_hits(text, items):
    own, hit, named = words(text), set(), set()
    for item, t in items:
        w = words(t)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for p in range(len(own) - k + 1):
                if own[p : p + k] == w[i : i + k]:
                    hit |= set(range(p, p + k))
                    named |= {str(item)} - {"None"}
    return len(own), len(hit), sorted(named)


def test_decontamination(spark, docs, items, texts, monkeypatch):
    given = [tuple(r) for r in items.collect()]
    want = collections.Counter((r["doc_id"], *map(str, brute_hits(r["text"], given))) for r in docs.collect())
    place = [(m.start(), m.end()) for m in WORD.finditer(texts[11].translate(LOWER))]

    def check(found):
        rows = found.collect()
        assert collections.Counter((r["doc_id"], str(r["n_words"]), str(sum(h["words"] for h in r["hits"])), str(r["items"])) for r in rows) == want
        for r in rows:
            text = docs.where(f"doc_id <=> {'null' if r['doc_id'] is None else r['doc_id']}").first()["text"] if r["doc_id"] in (11, 12) else None
            for h in r["hits"] if text else ():
                assert words(text[h["start"] : h["end"]]) == words(text)[h["first"] : h["first"] + h["words"]]
        (hit,) = [h for h in [r for r in rows if r["doc_id"] == 11][0]["hits"] if h["words"] >= len(words(ITEM))]
        assert (hit["start"], hit["end"]) == (place[hit["first"]][0], place[hit["first"] + hit["words"] - 1][1])

    check(decontamination.scan(docs, items))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)  # several blocks and pieces
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 7)
    check(decontamination.scan(docs, items))
    clean = {r["doc_id"]: r for r in decontamination.remove(docs.where("doc_id is not null"), items).collect()}
    assert clean[10]["text"] == "" and clean[1]["text"] is None and clean[7]["text"] == texts[7] and clean[14]["text"] == " here; " and clean[10]["items"] == "x"
    assert {r["doc_id"] for r in decontamination.remove(docs, items, True).collect()} == {r[0] for r in want if r[2] == "0"}
    none = decontamination.scan(docs, items.limit(0))
    assert none.where("size(items) + size(hits) > 0").count() == 0 and none.count() == docs.count()
    assert decontamination.scan(docs.limit(0), items).count() == 0


def brute_ranks(rows, items, top=10):
    pooled = collections.defaultdict(set)
    for item, t in items:
        pooled[item] |= {t} - {None}
    own = [(i, collections.Counter(words(t))) for i, t in rows]
    sizes = [sum(c.values()) for _, c in own]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    out = []
    for item, several in pooled.items():
        asked = collections.Counter(w for t in several for w in words(t))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in own) + 1))) for t in asked}
        scores = [(-sum(k * weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_terms))) for t, k in asked.items() if c[t]), i is None, i) for (i, c), n in zip(own, sizes)]
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:top], 1)]
    return sorted(out, key=str)


def test_lexical(spark, docs, items, monkeypatch):
    rng = random.Random(8)
    more = [(100 + i, " ".join(rng.choices(["river", "stone", "the", "of", "town", "7", "old", *(f"w{k}" for k in range(40))], k=rng.choice([5, 60, 300]))), 0, 0, "", 0) for i in range(400)]
    all_docs = docs.union(spark.createDataFrame(more, DOCS))
    want = brute_ranks([(r["doc_id"], r["text"]) for r in all_docs.collect()], [tuple(r) for r in items.collect()])
    assert any(r[3] == s[3] and r[0] == s[0] for r, s in zip(want, want[1:]))  # ties are there
    check = lambda: sorted([tuple(r) for r in lexical.search(all_docs, items).select("item_id", "rank", "doc_id", "score").collect()], key=str)
    assert check() == want
    for name, value in (("HEAD", 30), ("BUCKET", 16), ("FOCUS", 2), ("BLOCK_BYTES", 200)):  # pruning and several blocks
        monkeypatch.setattr(lexical, name, value)
    assert check() == want
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_lexical_prunes(spark):
    """Most documents are passed over by length or by bounds before any exact score."""
    import numpy as np

    weight, df = np.full(40, 1000), np.full(40, 5)
    asked = lexical.Queries([{t: 1 for t in range(20)}], weight, df, np.zeros(1), 2)
    seen = []
    asked.rescore = lambda i, left, *rest: (seen.append(len(left)), lexical.Queries.rescore(asked, i, left, *rest))
    for high in (1000, 100, 10):
        n = 50
        terms, impact = np.tile(np.arange(20), n), np.full(20 * n, high)
        asked.read(np.arange(n), np.full(n, math.sqrt(20 * 1000 * high**2)), np.arange(0, 20 * n + 1, 20), terms, impact)
    assert seen == [50] and asked.found[0][0].tolist() == [20 * 1000 * 1000] * 2 and asked.found[0][1].tolist() == [0, 1]
    # same length, other terms: bounds leave none of them
    asked.read(np.arange(5), np.full(5, math.sqrt(20 * 1000 * 1000**2)), np.arange(0, 101, 20), np.tile(np.arange(20, 40), 5), np.full(100, 1000))
    assert seen == [50]


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(alignment.default_tokenizer()), sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    a_side.encode_special_tokens = True
    letters = alignment.byte_letters()
    docs = []
    for t in texts:
        a, b = a_side.encode(" " + (t or ""), add_special_tokens=False).ids if t else [], b_side.encode(t or "")
        a_bytes = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_side.id_to_piece(i)]]
        whole = (" " + (t or "")).encode()
        if not t or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            docs.append(([], [], []))
            continue
        spans = []
        for own in (a_bytes, b_bytes):
            at, out = 0, []
            for x in own:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        ends, groups = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}), []
        for low, high in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(x) for x, (s, e) in zip(ids, own) if low < e <= high) for ids, own in ((a, spans[0]), (b, spans[1]))))
        docs.append((groups, [(a[i], b[j]) for i, j in links], (len(a), len(b))))
    count = collections.Counter(p for _, links, _ in docs for p in set(links))
    most = collections.Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [(*(sizes or (0, 0)), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for groups, links, sizes in docs]


def test_alignment(spark, docs, texts, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = collections.Counter(zip([i for i, _ in rows], brute_alignment([t for _, t in rows])))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    check = lambda: collections.Counter((r["doc_id"], tuple(r[c] for c in columns)) for r in alignment.align(docs).collect())
    got = check()
    assert got == want
    assert [v for (i, v), _ in got.items() if i == 8][0][:4] == (0, 0, 0, 0) and [v for (i, v), _ in got.items() if i == 4][0][0] > 1
    monkeypatch.setattr(alignment, "SLICE_BYTES", 60)  # many chunks
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 200)
    assert check() == want
    assert alignment.align(docs.limit(0)).count() == 0


def test_pieces_word_by_word():
    """Words on their own give what the whole text gives, blanks at any place included."""
    side = alignment.PieceTokens(alignment.default_pieces())
    rng = random.Random(2)
    texts = ["".join(rng.choices([" ", "  ", "a", "the", "\n", "é", "汉", "\t", "ing", "<s>", ".", "7"], k=rng.choice([1, 3, 30]))) for _ in range(300)]
    assert side.by_words
    for t, ids in zip(texts, side.encode([" " + t for t in texts])):
        assert ids.tolist() == side.model.encode(t)


def test_queries_on_written_tables(spark, tmp_path, docs, items):
    """op12 and op13 as registered against their SQL; a text over a megabyte; empty tables."""
    rows = docs.where("doc_id is not null")
    rows.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    items.where("item_id is not null").distinct().coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for query, sql in ((decontamination.op12_decontamination, decontamination.OP12_SQL), (lexical.op13_lexical, lexical.OP13_SQL)):
        got = query(spark, str(tmp_path))
        columns = sorted(got.columns)
        want = con.sql(sql).project(", ".join(columns)).fetchall()
        assert sorted((tuple(r) for r in got.select(columns).collect()), key=str) == sorted(want, key=str)
    big = spark.createDataFrame([(900, "river stone " * 100_000 + ITEM, 0, 0, "", 0)], DOCS)
    (row,) = alignment.align(big).collect()
    assert row["n_groups"] > 100_000 and row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"]
    (row,) = decontamination.scan(big, items).collect()
    assert row["n_words"] == 200_000 + len(words(ITEM)) and row["hits"][-1]["first"] + row["hits"][-1]["words"] == row["n_words"] and row["items"] == ["1", "3"]
    assert lexical.search(big, items).where("item_id = 1").count() == 1
    for name, table in (("documents", rows), ("benchmark", items)):
        table.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    for query in (decontamination.op12_decontamination, lexical.op13_lexical, alignment.op11_alignment):
        assert query(spark, f"{tmp_path}/none").count() == 0
