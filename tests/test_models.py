"""Rank-sum p, permutation p, areas under curves, recipe steps, rarefaction, exports and cleanup files."""

import gzip
import math
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.tails import normal_two_sided, rank_sum_law, rank_sum_two_sided
from tessera.operators import clean, comparisons, diversity, imgt, multivariate, sampling
from tessera.sources import readers

COUNTS = "sample_short string, aminoAcid string, vFamilyName string, jGeneName string, cnt long"


def test_rank_sum_law():
    for m, n in ((1, 1), (3, 3), (4, 5), (2, 7)):
        every = [sum(c) - m * (m + 1) / 2 for c in combinations(range(1, m + n + 1), m)]
        assert np.allclose(rank_sum_law(m, n), [np.mean(np.array(every) <= u) for u in range(m * n + 1)])
    assert rank_sum_two_sided(0, 3, 3, False, None) == pytest.approx(0.1) and rank_sum_two_sided(9, 3, 3, False, None) == pytest.approx(0.1)
    assert rank_sum_two_sided(12, 4, 6, False, None) == 1.0 and math.isclose(float(rank_sum_law(49, 49)[-1]), 1.0)
    # published two-sided 5 % points of U
    for m, n, u in ((5, 5, 2), (8, 8, 13), (10, 10, 23), (20, 20, 127)):
        assert rank_sum_two_sided(u, m, n, False, None) <= 0.05 < rank_sum_two_sided(u + 1, m, n, False, None)
    assert rank_sum_two_sided(5, 2, 5, True, 0.0) is None
    assert normal_two_sided(np.array([0.0, 1.959964, -2.575829])) == pytest.approx([1.0, 0.05, 0.01], abs=1e-6)


def test_wilcoxon_published(spark):
    """Permeability of the membrane at term and at 12 to 26 weeks (Hollander and Wolfe 1973): W = 35, one-sided p 0.1272."""
    term, early = [0.80, 0.83, 1.89, 1.04, 1.45, 1.38, 1.91, 1.64, 0.73, 1.46], [1.15, 0.88, 0.90, 0.74, 1.21]
    rows = [("a", g, v) for g, vs in (("term", term), ("early", early)) for v in vs]
    rows += [("tied", "term", float(v // 2)) for v in range(20)] + [("tied", "early", float(v // 3)) for v in range(9)] + [("same", g, 1.0) for g in ("term", "early")]
    values = spark.createDataFrame(rows, "k string, grp string, value double")
    got = {r["k"]: r for r in comparisons.wilcoxon_test(values, ["k"], ("term", "early")).collect()}
    assert got["a"]["U"] == 35 and got["a"]["p_value"] == pytest.approx(2 * 0.1272, abs=1e-4)
    x, y = np.array([v // 2 for v in range(20)]), np.array([v // 3 for v in range(9)])
    u = (x[:, None] > y).sum() + (x[:, None] == y).sum() / 2
    _, ties = np.unique(np.concatenate([x, y]), return_counts=True)
    sd = math.sqrt(20 * 9 / 12 * (30 - (ties**3 - ties).sum() / (29 * 28)))
    assert got["tied"]["U"] == u and got["tied"]["p_value"] == pytest.approx(math.erfc((abs(u - 90) - 0.5) / sd / math.sqrt(2)))
    assert got["same"]["p_value"] is None


def test_ks_without_the_own_labels(spark):
    rng = np.random.default_rng(4)
    rows = [("g1" if i < 4 else "g2", f"s{i}", 8 + j, float(v)) for i in range(8) for j, v in enumerate(rng.dirichlet(np.ones(5) + (i < 4) * np.arange(5)))]
    freqs = spark.createDataFrame(rows, "genotype string, sample_short string, len int, value double")
    (own,), (plain,) = (comparisons.ks_permuted(freqs, 999, plus_one=p, rounds=100).collect() for p in (True, False))
    assert own["ks"] == plain["ks"] and round(plain["p_perm"] * 999) + 1 == round(own["p_perm"] * 1000)
    table = np.array([[v for _, s, _, v in rows if s == f"s{i}"] for i in range(8)])
    far = lambda a: np.abs(np.cumsum(table[a].mean(0)) - np.cumsum(np.delete(table, a, 0).mean(0))).max()
    every = np.array([far(list(c)) for c in combinations(range(8), 4)])
    assert own["ks"] == pytest.approx(every[0]) and plain["p_perm"] == pytest.approx((every >= every[0] - 1e-12).mean(), abs=0.05)
    assert "Join" not in comparisons.ks_permuted(freqs, 5)._jdf.queryExecution().executedPlan().toString()


def test_roc_auc(spark):
    rng = np.random.default_rng(5)
    names = ["x", "y", "z"]
    rows = [(names[i % 3], *(float(round(v, 1)) for v in rng.random(3) + 0.4 * np.eye(3)[i % 3])) for i in range(60)] + [(None, 1.0, 1.0, 1.0), ("x", None, 0.5, 0.5), ("other", 1.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "label string, sx double, sy double, sz double")
    scores = {n: f"s{n}" for n in names}
    got = {(r["class1"], r["class2"]): r["auc"] for r in multivariate.auc_pairs(table, "label", scores).collect()}
    want = {}
    for i, a in enumerate(names):
        for b in names:
            if a != b:
                one, two = ([r[1 + i] for r in rows if r[0] == c and r[1 + i] is not None] for c in (a, b))
                want[a, b] = np.mean([(p > q) + (p == q) / 2 for p, q in product(one, two)])
    assert got == pytest.approx(want)
    assert multivariate.roc_auc(table, "label", scores).first()[0] == pytest.approx(np.mean(list(want.values())))
    assert multivariate.roc_auc(table.limit(0), "label", scores).first()[0] is None


def test_probabilities(spark):
    rng = np.random.default_rng(6)
    rows = [("abc"[i % 3], *map(float, rng.normal(size=2) + 2 * (i % 3))) for i in range(90)]
    wide = spark.createDataFrame(rows, "label string, f0 double, f1 double")
    model = multivariate.discriminant(wide, "label", ["f0", "f1"])
    got = wide.select("*", *model.probabilities().values(), model.predicted().alias("predicted")).collect()
    for r in got:
        p = [r[f"p_{c}"] for c in "abc"]
        assert sum(p) == pytest.approx(1) and "abc"[int(np.argmax(p))] == r["predicted"]
    # two classes: the log odds are Fisher's linear function
    two = wide.where("label != 'c'")
    model = multivariate.discriminant(two, "label", ["f0", "f1"])
    x, y = np.array([r[1:] for r in rows if r[0] != "c"]), np.array([r[0] == "b" for r in rows if r[0] != "c"])
    pooled = (np.cov(x[y].T) * (y.sum() - 1) + np.cov(x[~y].T) * ((~y).sum() - 1)) / (len(y) - 2)
    w = np.linalg.solve(pooled, x[y].mean(0) - x[~y].mean(0))
    odds = x @ w - w @ (x[y].mean(0) + x[~y].mean(0)) / 2
    got = [r["p_b"] for r in two.select(*model.probabilities().values()).collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-odds))).tolist(), abs=1e-6)


def test_boosted_and_forest(spark):
    rng = np.random.default_rng(7)
    wide = spark.createDataFrame([("ab"[i % 2], float(rng.normal() + 6 * (i % 2)), float(rng.normal())) for i in range(40)], "label string, f0 double, f1 double").coalesce(1)
    for kind in ("boosted", "forest"):
        got = multivariate.classifier(kind, wide, "label", ["f0", "f1"]).transform(wide)
        assert got.where("label = predicted").count() == 40


def test_near_zero_variance(spark):
    rows = [("k", "a" if i < 97 else "b", i, i % 4, None if i < 99 else 1, None) for i in range(100)]
    table = spark.createDataFrame(rows, "constant string, nearly string, free int, even int, alone int, none int")
    got = {r["column"]: r for r in multivariate.near_zero_variance(table, table.columns).collect()}
    assert {c for c, r in got.items() if r["dropped"]} == {"constant", "nearly", "alone", "none"} and {c for c, r in got.items() if r["constant"]} == {"constant", "alone", "none"}
    assert got["nearly"]["ratio"] == pytest.approx(97 / 3) and got["even"]["ratio"] == 1 and (got["free"]["values"], got["free"]["percent_unique"]) == (100, 100) and got["none"]["ratio"] is None
    # a rare second value among many different ones stays
    mixed = spark.createDataFrame([(0 if i < 60 else i,) for i in range(100)], "v int")
    assert not multivariate.near_zero_variance(mixed, ["v"]).first()["dropped"]


def test_dummies(spark):
    table = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "i int, k string")
    assert multivariate.dummies(table, "k").columns == ["i", "k_b", "k_c"]
    got = {r["i"]: (r["k_a"], r["k_b"]) for r in multivariate.dummies(table, "k", ["a", "b"], True).collect()}
    assert got == {1: (0, 1), 2: (1, 0), 3: (None, None), 4: (0, 0)}


def test_rarefaction(spark):
    """Mean different sequences of draws near the expectation; the depth is the smallest repertoire's by default."""
    rng = np.random.default_rng(8)
    rows = [(s, f"C{i}", "V", "J", int(c)) for s, n in (("s1", 200), ("s2", 80), ("s3", 50)) for i, c in enumerate(rng.integers(1, 9, n))] + [("s1", "zero", "V", "J", 0)]
    counts = spark.createDataFrame(rows, COUNTS)
    least = min(sum(r[4] for r in rows if r[0] == s) for s in ("s1", "s2", "s3"))
    want = {r["sample_short"]: r for r in diversity.expected_unique(counts).collect()}
    got = {r["sample_short"]: r for r in diversity.rarefied(counts, None, 60).collect()}
    assert got.keys() == want.keys() == {"s1", "s2", "s3"} and {r["depth"] for r in want.values()} == {least}
    for s, r in got.items():
        own = np.array([x[4] for x in rows if x[0] == s], float)
        assert want[s]["expected"] == pytest.approx((1 - (1 - own / own.sum()) ** least).sum())
        assert abs(r["unique_sequences"] - want[s]["expected"]) < 2.5 and r["rarefaction_iterations"] == 60 and r["sequence_index"] == "aminoAcid_vFamilyName_jGeneName"
        assert 0 <= r["clonality"] <= 1 and r["inverse_simpson"] <= r["unique_sequences"]
    deep = sum(r[4] for r in rows if r[0] == "s2")
    assert {r["sample_short"] for r in diversity.rarefied(counts, deep, 2).collect()} == {"s1", "s2"}
    curve = {(r["sample_short"], r["depth"]): r for r in diversity.rarefaction_curve(counts, 4, 30).collect()}
    total = {s: sum(r[4] for r in rows if r[0] == s) for s in ("s1", "s2", "s3")}
    assert curve.keys() == {(s, t * k // 4) for s, t in total.items() for k in (1, 2, 3, 4)}
    for (s, depth), r in curve.items():
        own = np.array([x[4] for x in rows if x[0] == s], float)
        assert abs(r["unique_sequences_mean"] - (1 - (1 - own / own.sum()) ** depth).sum()) < 4 and r["unique_sequences_sd"] >= 0
    assert diversity.rarefied(counts.limit(0), None, 2).count() == 0


def test_rarefaction_of_deep_samples(spark):
    """A depth of 10^15 cells costs what a small one does: draws beyond the number of clonotypes are made clonotype by clonotype."""
    counts = spark.createDataFrame([("s", "C1", "V", "J", 3 * 10**15), ("s", "C2", "V", "J", 10**15), ("t", "C1", "V", "J", 5)], COUNTS)
    got = {(r["sample_short"], r["depth"]): r for r in diversity.rarefaction_curve(counts, 4, 3).collect()}
    assert {d for s, d in got if s == "s"} == {k * 10**15 for k in (1, 2, 3, 4)} and {d for s, d in got if s == "t"} == {1, 2, 3, 5}
    for (s, _), r in got.items():
        n, clonality = (2, 1 + (3 * np.log2(0.75) + np.log2(0.25)) / 4) if s == "s" else (1, 1)
        assert (r["unique_sequences_mean"], r["unique_sequences_sd"]) == (n, 0) and r["clonality_mean"] == pytest.approx(clonality, abs=1e-6) and r["clonality_sd"] < 1e-6


@pytest.mark.parametrize("share", [40, 60, 100_000])
def test_draws_follow_the_weights(share):
    """One by one and place by place: means and variances of a multinomial, all draws made, heavy places beside the lightest."""
    weight, rng = np.random.default_rng(2).integers(1, 50, 50).astype(float), np.random.default_rng(3)
    draws, rounds = sampling._draws(weight), []
    for _ in range(4000):
        places, times = draws(rng, share)
        rounds.append(np.bincount(places, times, len(weight)))
    p, n = weight / weight.sum(), np.array(rounds)
    assert (n.sum(axis=1) == share).all()
    sd = np.sqrt(share * p * (1 - p))
    assert (abs(n.mean(axis=0) - share * p) < 5 * sd / np.sqrt(4000)).all() and (abs(n.var(axis=0) / sd**2 - 1) < 0.2).all()
    for odd in ([1e18, 1, 1, 1e18, 1], [1, 1e18], [7.0]):
        places, times = sampling._draws(np.array(odd))(rng, share)
        assert times.sum() == share and set(places) <= set(range(len(odd)))


def test_decimal_positions(spark):
    rows = spark.createDataFrame([("111A",), ("112E",), ("104",), (None,)], "p string")
    assert [r[0] for r in rows.select(imgt.decimal_position("p")).collect()] == ["111.1", "112.5", "104", None]


def test_cleanup_files(spark, tmp_path):
    head = "Category\tNumber of Sequences\tSum of Counts\n"
    for sample, text in {
        "F1E": head + "Removed Sequences\t1\t2\nProductive Sequences\t10\t 20 \nNon-Productive Sequences\t3\t4\n",
        "F2N": head + "productive sequences\t5\t6\r\nshort line\nProductive Sequences\t7\t8\n",
        "F3N": "nothing to count\n",
    }.items():
        (tmp_path / "deep" / sample).mkdir(parents=True)
        (tmp_path / "deep" / sample / f"{sample}_cleanup_summary.tsv").write_text(text)
    (tmp_path / "deep" / "other.tsv").write_text("Productive Sequences\t1\t1\n")
    got = {tuple(r) for r in readers.read_cleanup(spark, str(tmp_path)).collect()}
    assert got == {("F1E", "10", "3", "20", "4"), ("F2N", "7", "", "8", ""), ("F3N", "", "", "", "")}


@pytest.mark.parametrize("zipped", [True, False])
def test_matrix_export(spark, tmp_path, zipped):
    rows = spark.createDataFrame([(f"C{i:03d}" if i else None, s, i + k) for i in range(300) for k, s in enumerate(("a", "b", "x")) if (i + k) % 3], "aminoAcid string, sample_short string, cnt long").repartition(5)
    wide = clean.wide(rows, ["aminoAcid"], ["a", "b", "missing"])
    readers.write_matrix(wide, str(tmp_path / "m"), ["aminoAcid"], zipped)
    parts = b"".join(p.read_bytes() for p in sorted((tmp_path / "m").glob("part-*")))
    lines = (gzip.decompress(parts) if zipped else parts).decode().splitlines()
    assert lines[0] == "aminoAcid\ta\tb\tmissing"
    body = [line.split("\t") for line in lines[1:]]
    assert [r[0] for r in body] == [""] + [f"C{i:03d}" for i in range(1, 300)]
    assert body[1] == ["C001", "1", "2", "0"] and body[2] == ["C002", "2", "0", "0"] and len(body) == 300
    metrics = rows.withColumn("rows", F.lit(1))
    both = clean.wide_metrics(metrics, ["aminoAcid"], ["a", "b"], ["cnt", "rows"])
    assert both["rows"].columns == ["aminoAcid", "a_rows", "b_rows"] and tuple(both["cnt"].where("aminoAcid = 'C002'").first()) == ("C002", 2, 0)
    assert clean.wide_metrics(metrics, ["aminoAcid"], ["a"], ["cnt"])["cnt"].columns == ["aminoAcid", "a_cnt"]
