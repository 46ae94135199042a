"""Products in parts, packed rounds, declared pairs and null keys against plain Python."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clean, cooccurrence, overlap, sampling

COUNTS = "sample_short string, aminoAcid string, vFamilyName string, jGeneName string, cnt long"


@pytest.fixture(scope="module")
def counts(spark):
    rng = random.Random(6)
    rows = [(f"F{s:03d}{rng.choice('EN')}", rng.choice([f"C{i}F" for i in range(60)] + [None]), rng.choice(["V1", None]), "J1") for s in range(14) for _ in range(40)]
    rows = sorted(set(rows), key=str) + [("alone", "only", "V9", "J9"), ("none", "x", "V9", "J9")]
    return spark.createDataFrame([(*r, 0 if r[0] == "none" else i % 9 + 1) for i, r in enumerate(rows)], COUNTS).repartition(3)


@pytest.mark.parametrize("cells", [1 << 23, 40])  # one square array; lists of cells, handed on often
def test_together(spark, counts, monkeypatch, cells):
    monkeypatch.setattr(cooccurrence, "CELLS", cells)
    monkeypatch.setattr(cooccurrence, "PAIRS", 100)
    rows = counts.where("cnt > 0").collect()
    own = collections.defaultdict(dict)
    for r in rows:
        own[r["sample_short"]][r["aminoAcid"], r["vFamilyName"], r["jGeneName"]] = r["cnt"]
    want = {(a, b): (len(own[a].keys() & own[b].keys()), sum(own[a][k] for k in own[a].keys() & own[b].keys())) for a in own for b in own}
    got = cooccurrence.together(counts.where("cnt > 0"), clean.KEY, "sample_short", "cnt")
    assert {(r["a"], r["b"]): (r["n"], r["x"]) for r in got.collect()} == {k: v for k, v in want.items() if v[0]}
    plan = overlap.overlap(counts)
    assert "aminoAcid" not in plan._jdf.queryExecution().optimizedPlan().toString()  # pairs come from the cells, not from clonotypes
    assert {(r["A"], r["B"]): (r["unique_AB"], r["AB_countA"], r["AB_countB"]) for r in plan.collect()} == {(a, b): (*want[a, b], want[b, a][1]) for a in own for b in own if a < b}
    assert cooccurrence.together(counts.limit(0), clean.KEY, "sample_short").count() == 0 and overlap.overlap(counts.limit(0)).count() == 0


def test_packed_rounds(spark, counts):
    """The same rounds as in rows, over more rounds than a byte and several parts of a sample."""
    rounds = 19
    groups = counts.select("sample_short").distinct().withColumn("grp", F.substring("sample_short", -1, 1))
    rows = sampling.draw_counts(counts.withColumn("depths", F.array(F.lit(60).cast("long"))), rounds, 5, 7)
    packed = sampling.draw_rounds(counts, 60, rounds, 5, 7)
    want = {tuple(r) for r in overlap.publicity(rows, groups).select(*clean.KEY, "grp", "k", "n_shared").collect()}
    for same in (packed, overlap.packed_draws(rows, rounds)):
        shared = overlap.packed_publicity(same, groups, rounds)
        assert {tuple(r) for r in overlap.unpacked(shared).collect()} == want
        for least in (2, 3):
            at_least = overlap.sharing_at_least(overlap.publicity(rows, groups)).where(f"N >= {least}")
            assert {tuple(r) for r in overlap.packed_sharing(shared, least).collect()} == {tuple(r) for r in at_least.collect()}
    wide = [r["shared"] for r in overlap.packed_publicity(packed, groups, rounds).collect()]
    assert {len(x) for x in wide} == {rounds} and sampling.draw_rounds(counts.limit(0), 60, 3).count() == 0
    with pytest.raises(ValueError):
        overlap.packed_sharing(shared, 1)


def test_packed_groups_over_batches(spark):
    """A clonotype's rows may end in another batch than they began in."""
    rng = np.random.default_rng(2)
    rows = [(f"S{i:04d}", f"C{k}", None, "J", bytes(rng.integers(0, 256, 2, dtype=np.uint8))) for k in range(5) for i in range(70)]
    packed = spark.createDataFrame(rows, "sample_short string, aminoAcid string, vFamilyName string, jGeneName string, rounds binary")
    groups = packed.select("sample_short").distinct().withColumn("grp", F.lit("g"))
    want = {f"C{k}": np.sum([np.unpackbits(np.frombuffer(r[4], np.uint8), bitorder="little")[:13] for r in rows if r[1] == f"C{k}"], axis=0).tolist() for k in range(5)}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
        got = {r["aminoAcid"]: r["shared"] for r in overlap.packed_publicity(packed, groups, 13).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == want


def test_draws_follow_the_weights(spark):
    counts = spark.createDataFrame([("s", f"C{i}", "V", "J", w) for i, w in enumerate([1, 2, 3, 94])], COUNTS)
    drawn = {r["aminoAcid"]: r["n"] for r in sampling.subsample(counts, 20_000, 5, 3).where("iter > 0").groupBy("aminoAcid").agg(F.sum("n").alias("n")).collect()}
    assert sum(drawn.values()) == 100_000 and all(abs(drawn[f"C{i}"] - 1000 * w) < 6 * (1000 * w) ** 0.5 for i, w in enumerate([1, 2, 3, 94]))


def test_declared_pairs(spark):
    groups = spark.createDataFrame([("a", "s3", 0), ("a", "s1", 1), ("b", "s1", 0), ("b", "s2", 1), ("c", "s9", 0)], "grp string, sample_short string, place int")
    get = lambda *x: {tuple(r) for r in overlap.declared_pairs(*x).collect()}
    assert get(groups, ["a", "c"], [("b", "a")]) == {("within", "a", "s3", "s1"), ("between", "b_a", "s1", "s3"), ("between", "b_a", "s2", "s3"), ("between", "b_a", "s2", "s1")}
    assert get(groups.drop("place").where("grp != 'c'")) == {("within", "a", "s1", "s3"), ("within", "b", "s1", "s2"), ("between", "a_b", "s3", "s1"), ("between", "a_b", "s3", "s2"), ("between", "a_b", "s1", "s2")}
    for wrong in ((groups, ["x"]), (groups, ["a"], [("a", "y")]), (groups, [], [])):
        with pytest.raises(ValueError):
            overlap.declared_pairs(*wrong)
    draws = spark.createDataFrame([("s1", "C", None, "J", 1, 2), ("s2", "C", None, "J", 1, 1), ("s3", "D", "V", "J", 2, 1), ("s1", "D", "V", "J", 2, 0)], "sample_short string, aminoAcid string, vFamilyName string, jGeneName string, iter int, n long")
    got = overlap.pairwise(draws, overlap.declared_pairs(groups, ["a", "b"]), 2)
    assert {(r["sample_a"], r["sample_b"], r["k"]): r["shared"] for r in got.collect()} == {("s3", "s1", 1): 0, ("s3", "s1", 2): 0, ("s1", "s2", 1): 1, ("s1", "s2", 2): 0}
    assert {r["sharing_by"] for r in got.collect()} == {"aminoAcid_vFamilyName_jGeneName"}


def test_null_keys_are_removed(spark):
    kind = "nucleotide string, aminoAcid string, vFamilyName string, jGeneName string, sequenceStatus string, cnt long, sample_short string"
    rows = spark.createDataFrame([("A", None, "V", "J", "Out", 5, "s"), ("A", "C", "V", "J", "In", 2, "s"), ("B", None, "V", "J", "Out", 1, "s"), (None, None, "V", "J", None, 7, "s"), ("C", "D", "V", None, "In", 9, "s")], kind)
    gone = spark.createDataFrame([("A", None, 1), ("A", None, 2), ("X", "C", 1)], "nucleotide string, aminoAcid string, cnt int")
    assert [r["cnt"] for r in clean.only(rows, gone).collect()] == [5] and {r["cnt"] for r in clean.without(rows, gone).collect()} == {2, 1, 7, 9} and clean.without(rows, gone).columns == rows.columns
    assert {(r["category"], r["num_sequences"], r["sum_counts"]) for r in clean.cleanup_summary(rows, gone).collect()} == {("removed", 1, 5), ("productive", 1, 2), ("nonproductive", 2, 8)}
