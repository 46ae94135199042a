"""Rearrangement TSVs, removal lists, sample sheets, property tables, group specifications; text sinks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column of a rearrangement file -> its name and type here.
REARRANGEMENT = {
    "nucleotide": ("nucleotide", "string"),
    "aminoAcid": ("aminoAcid", "string"),
    "count (templates/reads)": ("cnt", "bigint"),
    "cdr3Length": ("cdr3Length", "int"),
    "vFamilyName": ("vFamilyName", "string"),
    "vGeneName": ("vGeneName", "string"),
    "jFamilyName": ("jFamilyName", "string"),
    "jGeneName": ("jGeneName", "string"),
    "sequenceStatus": ("sequenceStatus", "string"),
}


def file_name() -> Column:
    """The file's name as it stands in its folder; Spark's own column has it percent-encoded."""
    return F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))


def sample_of_file() -> Column:
    """The file's name up to its first dot or underscore."""
    return F.regexp_extract(file_name(), r"^([^_.]+)", 1)


#: Bytes by which a file's first line is read.
HEAD_BYTES = 1 << 16


def first_line(path: str) -> str:
    """The first line of a file, ungzipped, without its end and a mark of byte order; reading stops there.

    ``path`` as Spark lists it: a scheme that Arrow has a file system for (file, hdfs, s3a, gs, abfss) or none.
    """
    scheme = urlsplit(path).scheme
    if scheme in ("", "file"):
        system, name = pyarrow.fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    else:
        system, name = pyarrow.fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", path), safe="/:@"))
    found = b""
    with system.open_input_stream(name, compression="gzip" if name.endswith(".gz") else None, buffer_size=HEAD_BYTES) as stream:
        while b"\n" not in found and (block := stream.read(HEAD_BYTES)):
            found += block
    return found.split(b"\n", 1)[0].decode("utf-8-sig", "replace").rstrip("\r")


def headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, head): the first line of each file, read in tasks through a file handle, so that a file's first block alone is read; files of no bytes have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            yield pa.RecordBatch.from_arrays([names, pa.array([first_line(n) for n in names.to_pylist()], pa.string())], names=["path", "head"])

    files = spark.read.format("binaryFile").load(paths).select("path")  # a listing: contents are not read
    return files.repartition("path").mapInArrow(run, "path string, head string")


def read_tsv(spark: SparkSession, paths: str | list[str], columns: dict[str, tuple[str, str]], sample: Column | None = None) -> DataFrame:
    """(sample_short, the columns' new names) of (gzipped) TSVs with headers, file by file.

    ``columns``: header -> (name, type). Columns are found by name in each file: others are not read, their order does not
    matter, and one that a file lacks is null there, as is a value that is not of the type. Empty values are null.
    """
    groups = {r["head"]: r["paths"] for r in headers(spark, paths).groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()}  # a name per file
    out = None
    for head, own in sorted(groups.items()):
        names = [h.strip().strip('"') for h in head.split("\t")]
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", True).csv(own)
        at = {n: f"c{i}" for i, n in reversed(list(enumerate(names)))}
        value = lambda h, t: F.expr(f"try_cast(nullif(trim({at[h]}), '') as {t})") if h in at else F.lit(None).cast(t)  # noqa: B023, E731
        part = rows.select((sample_of_file() if sample is None else sample).alias("sample_short"), *[value(h, t).alias(n) for h, (n, t) in columns.items()])
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "sample_short string, " + ", ".join(f"`{n}` {t}" for n, t in columns.values()))
    return out


def read_rearrangements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All samples' files as one table; the sample is the file name up to its first dot or underscore."""
    return read_tsv(spark, paths, REARRANGEMENT)


def read_lengths(spark: SparkSession, paths: str | list[str], value: str = "mean_subsamples") -> DataFrame:
    """(sample_short, len, value) from frequency summaries (``param``, ``group``, ...): the rows of CDR3 lengths, unparsable ones dropped."""
    rows = read_tsv(spark, paths, {"param": ("param", "string"), "group": ("len", "int"), value: ("value", "double")}, F.regexp_extract(file_name(), r"^(.*?)_[^_]*$", 1))
    return rows.where("param = 'cdr3_length' AND len IS NOT NULL AND value IS NOT NULL").select("sample_short", "len", "value")


def read_removal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("nucleotide string, aminoAcid string").option("sep", "\t").option("header", False).csv(path)


def read_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """(sample, num_seq_prod, num_seq_nonprod, counts_prod, counts_nonprod) of every ``*_cleanup_summary.tsv`` below ``folder``: one row a file, strings as they stand.

    The sample is the folder that the file is in. A line counts if it has three fields; of several of a kind the last does, and a
    kind that is missing is empty. A file of no bytes, which Spark's readers pass over, has no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_cleanup_summary.tsv").load(folder)
    lines = F.filter(F.transform(F.split(F.decode("content", "UTF-8"), r"\r?\n"), lambda line: F.split(line, "\t")), lambda f: F.size(f) >= 3)
    rows = files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("sample"), lines.alias("l"))
    non = lambda f: F.rlike(f[0], F.lit("(?i)non.productive sequences"))
    kinds = {"prod": lambda f: F.rlike(f[0], F.lit("(?i)productive sequences")) & ~F.rlike(f[0], F.lit("(?i)non")), "nonprod": non}
    value = lambda kind, at: F.coalesce(F.trim(F.get(F.try_element_at(F.filter("l", kinds[kind]), F.lit(-1)), F.lit(at))), F.lit(""))
    return rows.select("sample", *[value(kind, at).alias(f"{name}_{kind}") for at, name in ((1, "num_seq"), (2, "counts")) for kind in kinds])


def delimiter_of(head: str, default: str = ",") -> str:
    """The most frequent of tab, comma, semicolon and bar in a first line; where there is none, a blank if the line has one, else comma."""
    line = head.splitlines()[0].strip() if head else ""
    best = max("\t,;|", key=line.count)
    return best if best in line else " " if " " in line else default


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet with a header, all columns strings, the separator told from its first line; runs of blanks separate once."""
    head = spark.read.text(path).limit(1).collect()
    mark = delimiter_of(head[0][0] if head else "")
    if mark != " ":
        return spark.read.option("header", True).option("sep", mark).csv(path)
    names = head[0][0].split()
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("v"))
    rows = lines.where(F.concat_ws(" ", "v") != " ".join(names))
    return rows.select(*[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])


def samplesheet(spark: SparkSession, folders: list[str]) -> DataFrame:
    """SAMPLE, LOC of every .gz file of the folders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folders).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.tsv)?\.gz$", 1).alias("SAMPLE"), F.col("path").alias("LOC"))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """(AA, prop, value) from a table with amino acids as rows or as columns; values that are no numbers are dropped."""
    sheet = read_sheet(spark, path)
    first, *others = sheet.columns
    long = sheet.unpivot(first, others, "name", "value")
    by_prop = first.lower() in ("prop", "property")
    aa, prop = ("name", first) if by_prop else (first, "name")
    return long.select(F.col(aa).alias("AA"), F.col(prop).alias("prop"), F.expr("try_cast(value as double)").alias("value")).dropna()


def groups_from_tokens(tokens: Iterable[str]) -> dict[str, list[str]]:
    """``NAME:s1,s2`` tokens; blanks are skipped, repeats kept once, order kept."""
    out: dict[str, list[str]] = {}
    for token in tokens:
        name, sep, members = token.partition(":")
        if not sep or not name.strip() or name.strip() in out:
            raise ValueError(f"not a new NAME:sample,...: {token!r}")
        out[name.strip()] = list(dict.fromkeys(m.strip() for m in members.split(",") if m.strip()))
        if not out[name.strip()]:
            raise ValueError(f"group {name.strip()!r} is empty")
    return out


def groups_from_yaml(text: str) -> dict[str, list[str]]:
    import yaml

    spec = yaml.safe_load(text)
    spec = spec.get("groups", spec) if isinstance(spec, dict) else spec
    if not isinstance(spec, dict) or not spec or any(not isinstance(v, list) or not v or len(v) != len(set(v)) for v in spec.values()):
        raise ValueError("groups must map names to lists of samples, without repeats")
    return {str(k): [str(s) for s in v] for k, v in spec.items()}


def groups_from_sheet(sheet: DataFrame, group: str, sample: str = "sample_short", renames: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Group -> its samples, both in the order of the sheet; rows with a blank group or sample are left out, repeats kept once, groups renamed as said."""
    name = F.trim(F.col(group))
    rows = sheet.select(name.alias("g"), F.trim(F.col(sample)).alias("s"), F.monotonically_increasing_id().alias("i")).where("g != '' AND s != ''")
    out: dict[str, list[str]] = {}
    for r in rows.groupBy("g", "s").agg(F.min("i").alias("i")).orderBy("i").toLocalIterator():
        own = out.setdefault((renames or {}).get(r["g"], r["g"]), [])
        if r["s"] not in own:
            own.append(r["s"])
    return out


def groups_frame(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(g, s) for g, members in groups.items() for s in members], "grp string, sample_short string")


def groups_to_yaml(groups: dict[str, list[str]]) -> str:
    return "".join(f"{g}:\n" + "".join(f"  - {s}\n" for s in members) for g, members in groups.items())


def write_tsv(df: DataFrame, path: str, gzip: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def write_matrix(wide: DataFrame, path: str, by: list[str], gzip: bool = True) -> None:
    """Sorted TSV parts, the header in the first alone: the parts end to end, in the order of their names, are one table, gzipped ones too.

    Sorting is by ranges of ``by`` (nulls first); null is written empty.
    """
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    head = wide.sparkSession.createDataFrame([("\t".join(wide.columns),)], "value string").coalesce(1)
    body = wide.orderBy(*by).select(F.concat_ws("\t", *map(cell, wide.columns)).alias("value"))
    head.union(body).write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def publish(df: DataFrame, path: str, by: tuple[str, ...] = ("sample_short",)) -> None:
    """Parquet under ``path``, a folder per value of ``by``, which a reader prunes by; only folders with new rows are replaced."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
