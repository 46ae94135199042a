"""Every registered repertoire query against its SQL in DuckDB; statistics against published values."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.functions.tails import f_upper, gamma_q, t_two_sided
from tessera.operators import imgt
from tessera.operators.comparisons import hotelling_stat
from tessera.plans import queries
from tessera.sources import readers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(frame, columns):
    plain = lambda v: None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_subsample_is_stable_and_complete(spark):
    from tessera.operators.sampling import subsample

    counts = queries._merged(spark, SF)
    one, two = (subsample(df, 100, 2).toPandas() for df in (counts, counts.repartition(7)))
    assert rows(one, list(one.columns)) == rows(two, list(one.columns))
    assert set(one[one["iter"] > 0].groupby(["sample_short", "iter"])["n"].sum()) == {100}


def test_slices_change_no_draw(spark, monkeypatch):
    from tessera.operators import sampling

    counts = queries._merged(spark, SF)
    want = sampling.subsample_hashed(counts, 40, 2).toPandas()
    monkeypatch.setattr(sampling, "SLICE_ROWS", 3)
    got = sampling.subsample_hashed(counts, 40, 2).toPandas()
    assert rows(got, list(want.columns)) == rows(want, list(want.columns)) and set(want[want["iter"] > 0].groupby(["sample_short", "iter"])["n"].sum()) == {40}


def test_tails():
    assert math.isclose(t_two_sided(6.20, 37.2), 3.3e-7, rel_tol=0.02)
    assert math.isclose(f_upper(4.0, 1.0, 10.0), t_two_sided(2.0, 10.0), rel_tol=1e-9)
    assert math.isclose(gamma_q([1.0], [3.0])[0], math.exp(-3), rel_tol=1e-12)


def test_positions():
    assert imgt.positions(15) == [str(p) for p in range(104, 119)]
    assert imgt.positions(8) == ["104", "105", "106", "107", "115", "116", "117", "118"]
    assert imgt.positions(16)[8:10] == ["111A", "112"]
    assert imgt.positions(25)[8:18] == ["111A", "111B", "111C", "111D", "111E", "112E", "112D", "112C", "112B", "112A"]


def test_validity(spark):
    """As written out in plain Python, for ends, letters, lengths, blanks and breaks of lines."""
    rest = "ASSLGQAYEQ"
    texts = [None, "", "C", "CF", " " + "C" + rest + "YF ", "c" + rest + "yf", "C" + rest + "YV", "C" + rest + "V", "C" + rest + "W", "A" + rest + "F", "CAAAAAF", "CAAAAAAF", "C" + "A" * 23 + "F", "C" + "A" * 24 + "F", "C" + rest + "*F", "C" + rest + "F\n", "CB" + rest + "F"]

    def plain(t):
        a = (t or "").strip(" ").upper()
        return 8 <= len(a) <= 25 and a[0] == "C" and a.endswith(("F", "W", "YV")) and set(a) <= set("ACDEFGHIKLMNPQRSTVWY")

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, aminoAcid string").withColumn("ok", imgt.valid()).orderBy("i").collect()
    assert [r["ok"] for r in got] == [plain(t) for t in texts] and sum(map(plain, texts)) == 6


def test_local_tables(spark):
    """Small fixed tables are local relations with a known size, empty ones too; a null sample is of no cells."""
    from tessera.operators.metadata import of_cells
    from tessera.sources.staging import inline

    table = inline(spark, [(1, "a"), (None, "b")], "n int, s string")
    assert [tuple(r) for r in table.collect()] == [(1, "a"), (None, "b")] and "LocalTableScan" in table._jdf.queryExecution().executedPlan().toString()
    assert inline(spark, [], "n int, s string").dtypes == [("n", "int"), ("s", "string")] and not inline(spark, [], "n int").count()
    samples = inline(spark, [("F000E",), ("F000N",), (None,), ("E",)], "sample_short string")
    assert sorted(r[0] for r in of_cells(samples, "E").collect()) == ["E", "F000E"]


def test_min_support(spark):
    rows = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 0.0), ("q", "a", 1.0), ("q", "b", 0.5), ("r", "a", None)], "x string, sample_short string, value double")
    assert sorted(r["x"] + r["sample_short"] for r in imgt.min_support(rows, ["x"], 0.0, 2, "value").collect()) == ["qa", "qb"]


def test_hotelling_undefined():
    assert hotelling_stat(np.zeros((1, 2)), np.zeros((5, 2))) is None
    assert hotelling_stat(np.zeros((5, 2)), np.zeros((5, 2))) is None


def test_groups():
    assert readers.groups_from_tokens(["A:x, y,x"]) == {"A": ["x", "y"]}
    with pytest.raises(ValueError):
        readers.groups_from_tokens(["A:"])
    assert readers.groups_from_yaml(readers.groups_to_yaml({"A": ["x", "y"]})) == {"A": ["x", "y"]}
    assert readers.delimiter_of("a\tb\tc") == "\t" and readers.delimiter_of("abc") == ","


def test_ks_permuted_against_all_labels(spark):
    """p of each split near the share of all label choices that reach the observed distance."""
    from itertools import combinations

    from tessera.operators.comparisons import ks_permuted

    rng = np.random.default_rng(7)
    rows, want = [], {}
    for cells in "EN":
        x = rng.dirichlet(np.ones(4), 7)
        x[:3, 0] += 0.4 if cells == "E" else 0.0
        x /= x.sum(1, keepdims=True)
        rows += [(cells, "g1" if i < 3 else "g2", f"{cells}{i}", 10 + j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
        rows += [(cells, "small", f"{cells}s{i}", 10, 1.0) for i in range(2)]
        far = lambda a: np.abs(np.cumsum(x[a].mean(0)) - np.cumsum(np.delete(x, a, 0).mean(0))).max()  # noqa: B023, E731
        every = [far(list(a)) for a in combinations(range(7), 3)]
        want[cells] = every[0], np.mean(np.array(every) >= every[0] - 1e-12)
    freqs = spark.createDataFrame(rows, "cells string, genotype string, sample_short string, len int, value double")
    got = {r["cells"]: r for r in ks_permuted(freqs, 3000, split=("cells",)).collect()}
    assert got.keys() == {"E", "N"} and {(r["group1"], r["group2"]) for r in got.values()} == {("g1", "g2")}
    for cells, (ks, p) in want.items():
        assert math.isclose(got[cells]["ks"], ks, rel_tol=1e-9) and abs(got[cells]["p_perm"] - p) < 0.04
    at = queries.QUERIES["ks_perm"](spark, SF).toPandas()
    stat = queries.QUERIES["ks_stat"](spark, SF).toPandas()
    assert set(at["cells"]) == {"E", "N"}
    known = {(r.cells, *sorted((r.group1, r.group2))): r.ks for r in stat.itertuples()}
    for r in at.itertuples():
        assert math.isclose(r.ks, known[r.cells, r.group1, r.group2], abs_tol=1e-8) and math.isclose(r.p_perm * 10_001, round(r.p_perm * 10_001), abs_tol=1e-4)
