"""p values and test tables against published values, plain Python and brute force."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.tails import adjusted, chi2_p, normal_p
from tessera.operators import comparisons, imgt, overlap, reports, sampling

#: Smoothness of paper by laboratory (Scholz and Stephens 1987, table 4).
PAPER = [
    [38.7, 41.5, 43.8, 44.5, 45.5, 46.0, 47.7, 58.0],
    [39.2, 39.3, 39.7, 41.4, 41.8, 42.9, 43.3, 45.8],
    [34.0, 35.0, 39.0, 40.0, 43.0, 43.0, 44.0, 45.0],
    [34.0, 34.8, 34.8, 35.4, 37.2, 37.8, 41.2, 42.8],
]


def test_tails_as_columns(spark):
    rows = spark.createDataFrame([(1.959964, 3.841459, 1), (-2.575829, 11.344867, 3), (0.0, 0.0, 2), (None, None, None)], "z double, x double, df int")
    got = rows.select(normal_p(F.col("z")).alias("p"), chi2_p(F.col("x"), F.col("df")).alias("q")).collect()
    assert [None if r["p"] is None else round(r["p"], 5) for r in got] == [0.05, 0.01, 1.0, None]
    assert [None if r["q"] is None else round(r["q"], 5) for r in got] == [0.05, 0.01, 1.0, None]


def test_adjusted(spark):
    p = [0.01, 0.02, 0.03, 0.5, None]
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate(p)], "grp string, i int, p double")
    get = lambda *a: [r["q"] for r in adjusted(rows, "p", ["grp"], *a, out="q").orderBy("i").collect()]
    assert get("bonferroni") == pytest.approx([0.04, 0.08, 0.12, 1.0, None]) and get("none", 3) == pytest.approx([0.03, 0.06, 0.09, 1.0, None])
    assert get("fdr") == pytest.approx([0.04, 0.04, 0.04, 0.5, None]) and get("fdr", 3) == pytest.approx([0.12, 0.12, 0.12, 1.0, None])
    with pytest.raises(ValueError):
        get("other")


def test_anderson_darling_published():
    values = sorted({v for g in PAPER for v in g})
    table = np.array([[g.count(v) for v in values] for g in PAPER])
    t = (comparisons.ad_statistic(table) - 3) / comparisons.ad_moments(table.sum(axis=1).astype(float))
    assert round(t, 3) == 4.480 and abs(comparisons.ad_p(t, 4) - 0.0020) < 2.5e-4
    assert comparisons.ad_p(-5, 4) == 0.25 and comparisons.ad_p(50, 4) == 0.001


def test_anderson_darling_permutations(spark):
    """p near the share of all label choices that reach the observed statistic; groups of two samples take no part."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for cells in "EN":
        x = rng.dirichlet(np.ones(4), 7)
        x[:3, 0] += 0.5 if cells == "E" else 0.0
        x /= x.sum(1, keepdims=True)
        rows += [(cells, "g1" if i < 3 else "g2", f"{cells}{i}", 10 + j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
        rows += [(cells, "small", f"{cells}s{i}", 10, 1.0) for i in range(2)]
        whole = []
        for r in x:
            low = np.floor(r * 100)
            for j in sorted(range(4), key=lambda j: (-round(r[j] * 100 - low[j], 9), -j))[: int(100 - low.sum())]:
                low[j] += 1
            whole.append(low)
        whole = np.array(whole)
        stat = lambda a: comparisons.ad_statistic(np.stack([whole[list(a)].sum(0), np.delete(whole, list(a), 0).sum(0)]))  # noqa: B023, E731
        every = [stat(a) for a in combinations(range(7), 3)]
        want[cells] = (every[0] - 1) / comparisons.ad_moments(np.array([300.0, 400.0])), np.mean(np.array(every) >= every[0] - 1e-9)
    freqs = spark.createDataFrame(rows, "cells string, genotype string, sample_short string, len int, value double")
    got = {r["cells"]: r for r in comparisons.ad_test(freqs, ["cells"], 100, 1000).collect()}
    assert got.keys() == {"E", "N"}
    for cells, (t, p) in want.items():
        r = got[cells]
        assert math.isclose(r["ad_stat"], t, abs_tol=2e-6) and abs(r["p_permutation"] - p) < 0.06 and (r["n_groups"], r["groups"], r["n_samples"]) == (2, "g1|g2", 7)
    assert comparisons.ad_test(freqs.where("genotype != 'g1'"), ["cells"], 100, 50).count() == 0


def test_property_tables(spark):
    """Three groups with shifted means: both homozygous ones differ clearly, the mixed one lies between."""
    rng = np.random.default_rng(11)
    means = {"hoDQ2": (2, -1, 1, -0.5), "hoDQ8": (-2, 1, -1, 0.5), "heDQ2DQ8": (0.1, -0.1, 0.1, -0.1)}
    rows = [("CD4", pos, f"{g}{i}", g, *(float(v) for v in rng.normal(means[g], 0.35))) for pos in ("104", "107") for g, n in (("hoDQ2", 10), ("hoDQ8", 10), ("heDQ2DQ8", 6)) for i in range(n)]
    rows.append(("CD4", "104", "odd", "hoDQ2", None, 90.0, 90.0, 90.0))
    wide = spark.createDataFrame(rows, "cells string, IMGT_position string, sample_short string, genotype string, KF1 double, KF2 double, KF3 double, KF4 double")
    one, two = (t.collect() for t in comparisons.property_tables(wide, ["cells", "IMGT_position"], "KF"))
    assert len(one) == 2 and len(two) == 8
    for r in one:
        a, b = (np.array([x[4:] for x in rows if x[1] == r["IMGT_position"] and x[3] == g and x[4] is not None]) for g in ("hoDQ2", "hoDQ8"))
        assert r["p_value_oo"] < 0.001 and math.isclose(r["p_value_oo"], comparisons.hotelling_stat(a, b)[4], rel_tol=1e-9, abs_tol=1e-300) and r["q_value_oo"] >= r["p_value_oo"]
    for r in two:
        at = next(x for x in one if x["IMGT_position"] == r["IMGT_position"])
        assert (r["p_hotelling_oo"], r["q_hotelling_eo"]) == (at["p_value_oo"], at["q_value_eo"]) and r["p_value_oo"] <= r["q_value_oo"] and r["n_a_oo"] == 10
    with pytest.raises(ValueError):
        comparisons.property_tables(wide, ["cells"], "none")


def test_hotelling_by_hand():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(12, 3)), rng.normal(0.4, 1, (9, 3))
    t2, f, d1, d2, p, eta2 = comparisons.hotelling_stat(a, b)
    pooled = (11 * np.cov(a.T) + 8 * np.cov(b.T)) / 19
    diff = a.mean(0) - b.mean(0)
    assert math.isclose(t2, 12 * 9 / 21 * diff @ np.linalg.inv(pooled) @ diff, rel_tol=1e-9) and (d1, d2) == (3, 17) and math.isclose(f, t2 * 17 / 57)
    x = np.linspace(0, 200, 2_000_001)  # the F density summed beyond f
    c = math.exp(math.lgamma(10) - math.lgamma(1.5) - math.lgamma(8.5)) * (3 / 17) ** 1.5
    density = c * np.sqrt(x) * (1 + 3 * x / 17) ** -10
    assert math.isclose(p, density[x >= f].sum() * (x[1] - x[0]), rel_tol=1e-3) and math.isclose(eta2, t2 / (t2 + 19))


def test_null_keys_meet(spark):
    rows = [("F001E", None, "V1", "J1", 1, 3), ("F002E", None, "V1", "J1", 1, 2), ("F003E", "", "V1", "J1", 1, 2), ("F002E", "C", None, "J1", 1, 1), ("F003E", "C", None, "J1", 1, 1), ("F001N", None, "V1", "J1", 1, 3), ("F002E", "A|B", "C", "J1", 1, 1), ("F003E", "A", "B|C", "J1", 1, 1)]
    draws = spark.createDataFrame(rows, "sample_short string, aminoAcid string, vFamilyName string, jGeneName string, iter int, n long")
    groups = spark.createDataFrame([("F001E", "a"), ("F002E", "a"), ("F003E", "b"), ("F001N", "b")], "sample_short string, grp string")
    got = {(r["sample_a"], r["sample_b"]): r["shared"] for r in overlap.pairwise(draws, overlap.declared_pairs(groups), 1).collect()}
    assert got == {("F001E", "F002E"): 1, ("F001E", "F001N"): 1, ("F002E", "F001N"): 1, ("F002E", "F003E"): 1, ("F001E", "F003E"): 0, ("F001N", "F003E"): 0}
    got = {(r["sample1"], r["sample2"]): (r["unique_overlap"], r["comparison_type"]) for r in overlap.overlap_draws(draws).collect()}
    assert got == {("F001E", "F002E"): (1, "within_E"), ("F001E", "F003E"): (0, "within_E"), ("F002E", "F003E"): (1, "within_E"), ("F001E", "F001N"): (1, "E_vs_N")}


def test_hashed_draws_by_hand(spark):
    import hashlib

    rng = np.random.default_rng(5)
    rows = [(s, a, "V1", None if a and a[-1] == "3" else "J", int(c)) for s in ("x", "y") for a, c in [(None, 4), ("", 2), *((f"CASS{i % 7}F{i}", rng.integers(0, 9)) for i in range(60))]]
    counts = spark.createDataFrame(rows, "sample_short string, aminoAcid string, vFamilyName string, jGeneName string, cnt long").repartition(3)
    got = {(r["sample_short"], r["aminoAcid"], r["iter"]): r["n"] for r in sampling.subsample_hashed(counts, 200, 2).where("iter > 0").collect()}
    want: dict = {}
    for s in "xy":
        own = sorted([r for r in rows if r[0] == s and r[4]], key=lambda r: [(v is not None, v or "") for v in r[1:4]])
        high = np.cumsum([r[4] for r in own])
        for i in (1, 2):
            for j in range(1, 201):
                u = int(hashlib.md5(f"42|{s}|{i}|{j}".encode()).hexdigest()[:8], 16) / 2.0**32
                k = (s, own[int(np.searchsorted(high, u * high[-1], side="right"))][1], i)
                want[k] = want.get(k, 0) + 1
    assert got == want


def test_draws_in_parts(spark):
    """Each depth is drawn exactly, in the counts' proportions, alike under any partitioning."""
    rows = [(s, f"C{i:04d}F", "V", "J", 50 if i < 20 else 1) for s in ("x", "y") for i in range(1020)]
    counts = spark.createDataFrame(rows, "sample_short string, aminoAcid string, vFamilyName string, jGeneName string, cnt long")
    plan = counts.withColumn("depths", F.array(F.lit(100).cast("long"), F.lit(4000).cast("long")))
    one, two = ({tuple(r) for r in sampling.draw_counts(df, 3, part_rows=90).collect()} for df in (plan, plan.repartition(5)))
    assert one == two
    total: dict = {}
    large: dict = {}
    for s, a, _, _, depth, i, n in one:
        total[s, depth, i] = total.get((s, depth, i), 0) + n
        large[s, depth, i] = large.get((s, depth, i), 0) + n * (a < "C0020F")
    assert set(total) == {(s, d, i) for s in "xy" for d in (100, 4000) for i in (1, 2, 3)} and all(v == k[1] for k, v in total.items())
    assert all(abs(v / k[1] - 0.5) < (0.2 if k[1] == 100 else 0.05) for k, v in large.items())


def test_positions_and_tables(spark):
    order = imgt.position_order()
    names = sorted(order, key=order.get)
    assert names[:9] == [*map(str, range(104, 112)), "111A"] and names[-8:] == ["112A", *map(str, range(112, 119))] and len(names) == 25
    stats = spark.createDataFrame([("107", 0.9, 0.001), ("111", 0.9, 0.001), ("112", None, 0.001), ("111A", -1.0, None), ("113", 2.0, 0.0)], "IMGT_position string, cohen_d double, p_value double")
    assert {r[0] for r in reports.inner_positions(stats).collect()} == {"111", "112", "111A"}
    assert {r[0] for r in reports.inner_positions(stats, most_p=0.01, least_d=0.8).collect()} == {"111"}
    pairs = spark.createDataFrame([("a", "b"), ("a", "z")], "sample1 string, sample2 string")
    sheet = spark.createDataFrame([("a", "q"), ("b", "p")], "sample_short string, genotype string")
    assert {tuple(r) for r in reports.annotated_pairs(pairs, sheet, ["genotype"], "genotype").collect()} == {("a", "b", "q", "p", "p-q"), ("a", "z", "q", None, None)}
    logo = spark.createDataFrame([("107", "A", 0.3, 0.0), ("107", "C", 0.1, 0.4), ("107", "D", 0.001, 0.4)], "IMGT_position string, AA string, mean_a double, mean_b double")
    got = {(r["AA"], r["side"]): round(r["freq"], 6) for r in reports.position_matrix(logo, [], 0.01).collect()}
    assert got == {("A", "a"): 0.75, ("C", "a"): 0.25, ("C", "b"): 0.5, ("D", "b"): 0.5}
