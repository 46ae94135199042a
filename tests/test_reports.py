"""Reports, names and usage matrices on small tables against numpy and by hand."""

import numpy as np
import pytest

from tessera.operators import metadata, multivariate, reports


@pytest.fixture(scope="module")
def usage(spark):
    rng = np.random.default_rng(7)
    x = rng.dirichlet(np.ones(5), 60)
    y = np.repeat(["a", "b", "c"], 20)
    x[:20, 0] += 0.5
    x[20:40, 1] += 0.5
    rows = [(f"s{i:02d}", y[i], f"V{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)] + [(f"s{i:02d}", y[i], "same", 1.0) for i in range(60)]
    return spark.createDataFrame(rows, "sample_short string, grp string, gene string, value double"), x, y


def test_components(spark, usage):
    long, x, _ = usage
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    vt *= np.sign(vt[np.arange(5), np.abs(vt).argmax(1)])[:, None]
    got = {(r["sample_short"], r["component"]): r for r in multivariate.principal_components(long, ["sample_short"], "gene", "value", 2).collect()}
    assert len(got) == 120
    for i in range(60):
        for j in range(2):
            r = got[f"s{i:02d}", j + 1]
            assert np.isclose(r["score"], z[i] @ vt[j]) and np.isclose(r["explained"], s[j] ** 2 / (s**2).sum())
    assert multivariate.principal_components(long.where("gene = 'same'"), ["sample_short"], "gene", "value").count() == 0
    assert multivariate.principal_components(long.limit(0), ["sample_short"], "gene", "value").count() == 0
    assert len(multivariate.principal_components(long, ["sample_short"], "gene", "value", share=0.3).select("component").distinct().collect()) < 5


def test_discriminant(spark, usage):
    long, x, y = usage
    names = multivariate.features(long, "gene")
    wide = multivariate.matrix(long, ["sample_short", "grp"], "gene", "value", names)
    columns = [f"f{i}" for i in range(len(names))]
    model = multivariate.discriminant(wide, "grp", columns)
    mean = np.array([x[y == c].mean(0) for c in "abc"])
    within = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in zip("abc", mean)) / 57
    w = mean @ np.linalg.pinv(within)
    want = (x @ w.T - (w * mean).sum(1) / 2).argmax(1)
    got = {r["sample_short"]: r["predicted"] for r in model.predict(wide).collect()}
    assert [got[f"s{i:02d}"] for i in range(60)] == ["abc"[k] for k in want]
    cross = multivariate.cross_validate(wide, "grp", columns, 5)
    worth = multivariate.worth(cross, "grp").first()
    pairs = [(r["grp"], r["predicted"]) for r in cross.collect()]
    assert len(pairs) == 60 and np.isclose(worth["accuracy"], sum(a == b for a, b in pairs) / 60)
    c = np.array([[pairs.count((a, b)) for b in "abc"] for a in "abc"], float)
    t, p, n = c.sum(1), c.sum(0), c.sum()
    assert np.isclose(worth["mcc"], (np.trace(c) * n - t @ p) / np.sqrt((n * n - t @ t) * (n * n - p @ p)))
    assert multivariate.contributions(wide, "grp", model, names).groupBy("grp").count().where("count >= 5").count() == 3
    with pytest.raises(ValueError):
        multivariate.discriminant(wide.limit(0), "grp", columns)
    assert multivariate.worth(cross.limit(0), "grp").first()["accuracy"] is None


@pytest.mark.parametrize("kind", ["glm", "forest"])
def test_classifiers(usage, kind):
    long, _, _ = usage
    names = multivariate.features(long, "gene")
    wide = multivariate.matrix(long, ["sample_short", "grp"], "gene", "value", names)
    fitted = multivariate.classifier(kind, wide, "grp", [f"f{i}" for i in range(len(names))])
    assert multivariate.worth(fitted.transform(wide), "grp").first()["accuracy"] > 0.6


def test_holdout_keeps_units_whole(spark):
    units = spark.createDataFrame([(f"u{i // 2}", "x" if i < 40 else "y") for i in range(60)], "sample_short string, g string")
    got = multivariate.holdout(units, ["g"]).collect()
    assert sum(r["held_out"] for r in got) == 2 * (4 + 2) and len(got) == 60
    assert len({(r["sample_short"], r["held_out"]) for r in got}) == 30


def test_filters(spark):
    rows = spark.createDataFrame([("107", 0.001, None), ("111B", None, 0.2), ("116", 0.2, 0.01234567), (None, 0.001, 0.5), ("118", 0.5, 0.05)], "IMGT_position string, p_value_oo double, p_value_eo double")
    assert [r["IMGT_position"] for r in rows.where(reports.in_loop()).collect()] == ["111B", "116"]
    kept = reports.significant(rows).collect()
    assert sorted(str(r["IMGT_position"]) for r in kept) == ["107", "116", "None"] and {r["p_value_eo"] for r in kept} == {None, 0.0123, 0.5}
    with pytest.raises(ValueError):
        reports.significant(rows, prefix="q_")


def test_marks(spark):
    rows = spark.createDataFrame([("p1", 1.0, 2.0, 1.0, 0.004, 0.03), ("p2", 1.0, 2.0, 0.1, 0.004, 0.004), ("p3", 1.0, 2.0, None, 0.004, 0.004), ("p4", 1.0, None, -0.9, 0.001, 0.004)], "prop string, mean_a double, mean_b double, cohen_d double, q1 double, q2 double")
    got = {(r["prop"], r["grp"]): (r["is_sig"], r["stars"], r["mean_value"]) for r in reports.property_marks(rows, ["q1", "q2"]).collect()}
    assert got["p1", "a"] == (True, "*", 1.0) and got["p2", "b"] == (False, "", 2.0) and not got["p3", "a"][0] and got["p4", "b"] == (True, "***", None)


def test_names(spark):
    people = spark.createDataFrame([("Finland", "12", "homo DQ2", None), ("Finland", "9", "x", "IN ERROR SEND AS 6828"), ("TrialNet", "TN0013372F01", "het", ""), ("else", "q", None, None)], "cohort string, id string, genotype string, remark string")
    names = metadata.individual_names(people)
    assert [tuple(r) for r in names.collect()] == [("FIN_12", "F12", "homoDQ2"), ("FIN_6826", "F6826", "x"), ("TN0013372F01", "T13372", "het"), ("", "", None)]
    sheet = spark.createDataFrame([("FIN_6828_NAIVE_TCRB.tsv.gz", "a"), ("TN0013371F01_AgXP_TCRB.tsv.gz", "b"), ("odd", None)], "SAMPLE string, LOC string")
    got = {r["SAMPLE"]: (r["cells"], r["sample_short"]) for r in metadata.collate(sheet, names).collect()}
    assert list(got.values()).count((None, None)) == 1 and got["FIN_6828_NAIVE_TCRB.tsv.gz"] == ("N", "F6826N") and got["TN0013371F01_AgXP_TCRB.tsv.gz"] == ("E", "T13372E")


def test_exchange_names_clash(spark):
    rows = spark.createDataFrame([("ACG", "old", "12", "In", 1), ("A", "old", "x", None, 2)], "nucleotide string, sequence string, cdr3Length string, sequenceStatus string, extra int")
    got = metadata.exchange_names(rows)
    assert got.columns == ["sequence", "junction_aa_length", "frame_type", "extra", "productive"]
    assert [tuple(r) for r in got.collect()] == [("ACG", 12, "In", 1, True), ("A", None, None, 2, None)]
