"""Readers and sinks on written files: extra, missing and reordered columns, nulls, gzip, blanks, several separators."""

import gzip

import pytest
from pyspark.sql import functions as F

from tessera.operators import clean
from tessera.sources import readers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    (gzip.open(path, "wt") if path.suffix == ".gz" else open(path, "w")).write(text)
    return str(path)


HEAD = ["nucleotide", "aminoAcid", "count (templates/reads)", "frequencyCount (%)", "cdr3Length", "vMaxResolved", "vFamilyName", "vGeneName", "jFamilyName", "jGeneName", "sequenceStatus"]


def test_rearrangements(spark, tmp_path):
    line = lambda *v: "\t".join(v) + "\n"
    put(tmp_path / "in/F001E_TCRB.tsv.gz", line(*HEAD) + line("ACG", "CASF", "3", "0.1", "36", "x", "TCRBV01", "TCRBV01-01", "TCRBJ01", "TCRBJ01-01", "In") + line("ACT", "", "many", "0.2", "x", "", "", "", "", "TCRBJ01-02", ""))
    put(tmp_path / "in/T002N.tsv", line(*reversed(HEAD), "further") + line("Out", "TCRBJ01-03", "TCRBJ01", "", "TCRBV02", "y", "39", "0.3", "7", "CASSF", "GGG", "z"))
    put(tmp_path / "in/T003N.tsv", line("nucleotide", "aminoAcid", "count (templates/reads)") + line("TTT", "CATF", "5"))
    got = {r["nucleotide"]: r.asDict() for r in readers.read_rearrangements(spark, str(tmp_path / "in")).collect()}
    assert readers.require(readers.read_rearrangements(spark, str(tmp_path / "in")), ["cnt", "sample_short"]).columns == ["sample_short", *(n for n, _ in readers.REARRANGEMENT.values())]
    assert got["ACG"] == {"sample_short": "F001E", "nucleotide": "ACG", "aminoAcid": "CASF", "cnt": 3, "cdr3Length": 36, "vFamilyName": "TCRBV01", "vGeneName": "TCRBV01-01", "jFamilyName": "TCRBJ01", "jGeneName": "TCRBJ01-01", "sequenceStatus": "In"}
    assert got["ACT"] == {"sample_short": "F001E", "nucleotide": "ACT", "jGeneName": "TCRBJ01-02"} | dict.fromkeys(["aminoAcid", "cnt", "cdr3Length", "vFamilyName", "vGeneName", "jFamilyName", "sequenceStatus"])
    assert (got["GGG"]["sample_short"], got["GGG"]["cnt"], got["GGG"]["cdr3Length"], got["GGG"]["vGeneName"]) == ("T002N", 7, 39, None)
    assert got["TTT"]["cnt"] == 5 and got["TTT"]["jGeneName"] is None
    removal = readers.read_removal(spark, put(tmp_path / "gone.tsv", "ACG\tCASF\nXXX\tYYY\n"))
    rows = readers.read_rearrangements(spark, str(tmp_path / "in"))
    assert {r["nucleotide"] for r in clean.without(rows, removal).collect()} == {"ACT", "GGG", "TTT"} and [r["nucleotide"] for r in clean.only(rows, removal).collect()] == ["ACG"]
    assert [r["SAMPLE"] for r in readers.samplesheet(spark, [str(tmp_path / "in")]).collect()] == ["F001E_TCRB"]
    with pytest.raises(ValueError, match="nothing"):
        readers.require(rows, ["cnt", "nothing"])


def test_headers_of_any_form(spark, tmp_path):
    """Byte order marks, line ends of two kinds, a header longer than a block, a name with blanks, a large body that is left alone."""
    head = "\t".join(f"column{i}" for i in range(20_000))
    put(tmp_path / "in/long.tsv", head + "\n" + "1\t" * 19_999 + "1\n")
    put(tmp_path / "in/with blanks+%.tsv.gz", "\ufeffa\tb\r\n" + "1\t2\r\n" * 200_000)
    put(tmp_path / "in/bare.tsv", "a\tb")
    put(tmp_path / "in/none.tsv", "")
    got = {r["path"].rsplit("/", 1)[1]: r["head"] for r in readers.headers(spark, str(tmp_path / "in")).collect()}
    assert got == {"long.tsv": head, "with blanks+%.tsv.gz": "a\tb", "bare.tsv": "a\tb"}
    assert len(head) > readers.HEAD_BYTES
    rows = readers.read_tsv(spark, str(tmp_path / "in"), {"b": ("b", "int"), "column7": ("c", "int")})
    assert {(r["sample_short"], r["b"], r["c"], r["n"]) for r in rows.groupBy("sample_short", "b", "c").agg(F.count("*").alias("n")).collect()} == {("with blanks+%", 2, None, 200_000), ("long", None, 1, 1)}


def test_counts_that_are_no_numbers(spark):
    rows = spark.createDataFrame([("a", "C", "V", "J", "2"), ("a", "C", "V", "J", "x"), ("a", None, "V", "J", None)], "sample_short string, aminoAcid string, vFamilyName string, jGeneName string, cnt string")
    assert {(r["aminoAcid"], r["cnt"]) for r in clean.clonotypes(rows).collect()} == {("C", 3.0), (None, 1.0)}


def test_lengths(spark, tmp_path):
    put(tmp_path / "S1E_summ.tsv", "param\tgroup\tS1E_orig\tmean_subsamples\ncdr3_length\t12\t0.1\t0.2\nV_J\tx\t1\t1\ncdr3_length\tnone\t1\t1\n")
    put(tmp_path / "S2N_summ.tsv", "group\tmean_subsamples\tparam\n13\t0.4\tcdr3_length\n14\t\tcdr3_length\n")
    got = readers.read_lengths(spark, str(tmp_path / "*_summ.tsv"))
    assert {tuple(r) for r in got.collect()} == {("S1E", 12, 0.2), ("S2N", 13, 0.4)}


@pytest.mark.parametrize("mark", [" ", "   ", "\t", ",", ";", "|"])
def test_properties(spark, tmp_path, mark):
    text = "\n".join(mark.join(r) for r in [["prop", "A", "C", "D"], ["VHSE1", "0.15", "-1", "x"], ["VHSE2", "1", "2", "3"]]) + "\n\n"
    got = {(r["AA"], r["prop"], r["value"]) for r in readers.read_properties(spark, put(tmp_path / "p.txt", text)).collect()}
    assert got == {("A", "VHSE1", 0.15), ("C", "VHSE1", -1.0), ("A", "VHSE2", 1.0), ("C", "VHSE2", 2.0), ("D", "VHSE2", 3.0)}
    text = "\n".join(mark.join(r) for r in [["AA", "KF1", "KF2"], ["A", "1", "2"], ["C", "3", "4"]])
    got = {(r["AA"], r["prop"], r["value"]) for r in readers.read_properties(spark, put(tmp_path / "q.txt", text)).collect()}
    assert got == {("A", "KF1", 1.0), ("A", "KF2", 2.0), ("C", "KF1", 3.0), ("C", "KF2", 4.0)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, "x y"), ("b", 3, "z")], "sample_short string, n int, t string")
    for zipped in (True, False):
        readers.write_tsv(rows, str(tmp_path / f"out{zipped}"), zipped)
        assert any(p.suffix == ".gz" for p in (tmp_path / f"out{zipped}").iterdir() if p.name.startswith("part")) == zipped
        back = spark.read.option("sep", "\t").option("header", True).schema(rows.schema).csv(str(tmp_path / f"out{zipped}"))
        assert {tuple(r) for r in back.collect()} == {tuple(r) for r in rows.collect()}
    readers.publish(rows, str(tmp_path / "pub"))
    readers.publish(rows.where("n = 2"), str(tmp_path / "pub"))
    assert {(r["sample_short"], r["n"]) for r in spark.read.parquet(str(tmp_path / "pub")).collect()} == {("a", 1), ("b", 2)}


def test_groups(spark, tmp_path):
    sheet = readers.read_sheet(spark, put(tmp_path / "s.csv", "sample_short,genotype\ns2, homo \ns1,homo\ns1,homo\ns3,\n,homo\ns4,hetero\n"))
    groups = readers.groups_from_sheet(sheet, "genotype", renames={"hetero": "het"})
    assert groups == {"het": ["s4"], "homo": ["s2", "s1"]} and list(groups) == ["homo", "het"] and readers.groups_from_yaml(readers.groups_to_yaml(groups)) == groups
    assert {tuple(r) for r in readers.groups_frame(spark, groups).collect()} == {("het", "s4"), ("homo", "s1"), ("homo", "s2")}
