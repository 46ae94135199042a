"""Names of individuals and samples, the standard exchange names of columns, anonymous ids, group membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vendor's column -> its name in the exchange format. Fixed values.
EXCHANGE = {
    "nucleotide": "sequence",
    "aminoAcid": "junction_aa",
    "cdr3Length": "junction_aa_length",
    "vGeneName": "v_call",
    "jGeneName": "j_call",
    "sequenceStatus": "frame_type",
    "cnt": "duplicate_count",
    "vFamilyName": "v_family",
    "jFamilyName": "j_family",
    "vGeneAllele": "v_allele",
    "jGeneAllele": "j_allele",
    "dGeneName": "d_gene",
}
#: Columns of the exchange format that the vendor's table cannot fill, left out where it has them. Fixed values.
EMPTIED = ["sequence_aa", "junction", "junction_length", "d_call", "c_call", "productive", "vj_in_frame", "stop_codon", "locus", "duplicate_frequency", "consensus_count", "d_family", "cdr1", "cdr1_aa", "cdr2", "cdr2_aa", "cdr3", "cdr3_aa", "clone_id", "cell_id"]
#: Sample names sent in error -> the right ones. Fixed values.
SENT_AS = {"FIN_6828": "FIN_6826", "TN0013371F01": "TN0013372F01"}


def exchange_names(rows: DataFrame) -> DataFrame:
    """Known columns under their exchange names, lengths and counts as long, plus ``productive`` (null with the frame).

    Other columns stay, unless they bear a name that a renamed one takes or one of ``EMPTIED``.
    """
    renamed = {EXCHANGE[c] for c in rows.columns if c in EXCHANGE}
    taken = renamed | set(EMPTIED)
    out = []
    for c, t in rows.dtypes:
        name = EXCHANGE.get(c, c)
        if c in EXCHANGE or c not in taken:
            whole = "length" in name or "count" in name
            out.append((F.col(c).try_cast("long") if whole else F.col(c)).alias(name))
    known = rows.select(*out)
    return known.withColumn("productive", F.col("frame_type") == "In") if "frame_type" in renamed else known


def individual_names(people: DataFrame) -> DataFrame:
    """newname, shortname and genotype_short of (cohort, id, genotype, remark); unknown cohorts get empty names."""
    error = F.coalesce(F.col("remark").contains("IN ERROR SEND AS 6828"), F.lit(False))
    new = F.when((F.col("cohort") == "Finland") & error, "FIN_6826").when(F.col("cohort") == "Finland", F.concat(F.lit("FIN_"), "id")).when(F.col("cohort") == "TrialNet", F.col("id")).otherwise("")
    n = F.col("newname")
    middle = F.substring(n, F.lit(5), F.greatest(F.length(n) - 7, F.lit(0)))
    short = F.when(n.startswith("FIN_"), F.replace(n, F.lit("IN_"), F.lit(""))).when(n.startswith("TN"), F.concat(F.lit("T"), middle)).otherwise("")
    return people.withColumn("newname", new).select("newname", short.alias("shortname"), F.replace("genotype", F.lit(" "), F.lit("")).alias("genotype_short"))


def collate(sheet: DataFrame, names: DataFrame) -> DataFrame:
    """The sample sheet (SAMPLE, LOC) with its individuals' names, cells (E or N) and sample_short; a sample without an individual keeps nulls."""
    part = lambda i: F.nullif(F.regexp_extract("SAMPLE", r"^(.*)_(NAIVE|AgXP)_TCRB\.tsv\.gz$", i), F.lit(""))
    base = part(1)
    right: Column = base
    for wrong, name in SENT_AS.items():
        right = F.when(base == wrong, name).otherwise(right)
    cells = F.when(part(2) == "AgXP", "E").when(part(2) == "NAIVE", "N")
    rows = sheet.select("SAMPLE", "LOC", right.alias("newname"), cells.alias("cells"))
    return rows.join(names.dropDuplicates(["newname"]), "newname", "left").select("SAMPLE", "LOC", "cells", "newname", "shortname", "genotype_short", F.concat("shortname", "cells").alias("sample_short"))


def anonymous_ids(annotation: DataFrame) -> DataFrame:
    """(patient, source, anonym_patient_id): source's first letter and a running number of two digits or more."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("patient")).cast("string")
    padded = F.when(F.length(n) < 2, F.concat(F.lit("0"), n)).otherwise(n)
    return annotation.select("patient", "source").distinct().select("patient", "source", F.concat(F.left("source", F.lit(1)), padded).alias("anonym_patient_id"))


def group_of(samples: DataFrame, groups: DataFrame) -> DataFrame:
    """``samples`` with ``grp``: that of the id without its cell letter if listed, else that of the full id, else null.

    ``groups`` (member, grp): one group a member, the least of several. Spark broadcasts it if it is small.
    """
    one = groups.groupBy("member").agg(F.min("grp").alias("grp"))
    base, full = (one.select(F.col("member").alias(f"_{k}"), F.col("grp").alias(f"_g{k}")) for k in "bf")
    stem = F.regexp_replace("sample_short", "[NE]$", "")
    joined = samples.join(base, stem == F.col("_b"), "left").join(full, F.col("sample_short") == F.col("_f"), "left")
    return joined.select(*[F.col(c) for c in samples.columns if c != "grp"], F.coalesce("_gb", "_gf").alias("grp"))


def of_cells(rows: DataFrame, cells: str, sample: str = "sample_short") -> DataFrame:
    """Rows of the samples whose name ends in the letter of ``cells`` (E or N); a null name is of none."""
    return rows.where(F.col(sample).endswith(cells))


def cleanup_by_sample(summary: DataFrame) -> DataFrame:
    """``cleanup_summary`` as a row per sample, 0 for categories it lacks."""
    names = ("removed", "productive", "nonproductive")
    cell = lambda c, v: F.coalesce(F.max(F.when(F.col("category") == c, F.col(v))), F.lit(0)).alias(f"{c}_{v}")
    return summary.groupBy("sample_short").agg(*[cell(c, v) for c in names for v in ("num_sequences", "sum_counts")])
