"""Repertoire queries over the view of ``lineitem``, each with SQL where SQL can say it. Floats are rounded to 9 digits in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import clean, comparisons, diversity, imgt, metadata, overlap, sampling
from tessera.sources.adapter import REMOVED, REPERTOIRE, annotation, removal, repertoire

KEY = clean.KEY
DEPTH, DRAWS, SEED = 50, 3, 42
DIGITS = 9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _num() -> str:
    return ", ".join(f"({n}, {i}, '{p}')" for n, i, p in imgt.numbering())


PREFIX = f"""
WITH rep AS ({REPERTOIRE}),
gone AS (SELECT DISTINCT nucleotide, aminoAcid FROM rep WHERE nucleotide IN ({', '.join(REMOVED)})),
kept AS (SELECT * FROM rep WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.nucleotide IS NOT DISTINCT FROM rep.nucleotide AND gone.aminoAcid IS NOT DISTINCT FROM rep.aminoAcid)),
genes AS (SELECT * FROM kept WHERE vFamilyName IS NOT NULL AND jGeneName IS NOT NULL),
prod AS (SELECT * FROM genes WHERE sequenceStatus = 'In'),
merged AS (SELECT sample_short, aminoAcid, vFamilyName, jGeneName, sum(cnt)::BIGINT AS cnt FROM prod GROUP BY ALL),
ann AS (SELECT DISTINCT sample_short, left(sample_short, 4) AS patient, right(sample_short, 1) AS cells,
        CASE substr(sample_short, 2, 3)::INT % 3 WHEN 0 THEN 'hoDQ2' WHEN 1 THEN 'hoDQ8' ELSE 'heDQ2DQ8' END AS genotype FROM rep),
num(len, idx, IMGT_position) AS (VALUES {_num()}),
vld AS (SELECT *, upper(trim(aminoAcid)) AS aa, coalesce(length(aa) BETWEEN 8 AND 25 AND aa LIKE 'C%' AND (aa LIKE '%F' OR aa LIKE '%W' OR aa LIKE '%YV')
        AND regexp_full_match(aa, '[ACDEFGHIKLMNPQRSTVWY]+'), false) AS valid FROM merged),
res AS (SELECT v.sample_short, v.aminoAcid, v.vFamilyName, v.jGeneName, v.cnt, n.len, n.idx, n.IMGT_position, substr(v.aa, n.idx + 1, 1) AS AA_
        FROM vld v JOIN num n ON length(v.aa) = n.len WHERE v.valid),
stretch AS (SELECT *, (sum(cnt) OVER (PARTITION BY sample_short ORDER BY aminoAcid, vFamilyName, jGeneName ROWS UNBOUNDED PRECEDING))::BIGINT AS hi FROM merged),
tot AS (SELECT sample_short AS s, sum(cnt)::BIGINT AS total FROM merged GROUP BY 1),
draws AS (SELECT s, i AS iter, ('0x' || substr(md5(concat_ws('|', '{SEED}', s, i, j)), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 * total AS x
          FROM tot, range(1, {DRAWS + 1}) a(i), range(1, {DEPTH + 1}) b(j)),
sub AS (SELECT sample_short, aminoAcid, vFamilyName, jGeneName, 0::INT AS iter, cnt AS n FROM merged UNION ALL
        SELECT sample_short, aminoAcid, vFamilyName, jGeneName, iter::INT, count(*) FROM stretch JOIN draws ON s = sample_short AND x >= hi - cnt AND x < hi GROUP BY ALL)
"""


def add(name: str, sql: str | None = None, double: tuple[str, ...] = ()):
    """Register a query; its double columns are rounded in both engines."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            # adding 0.0 makes a rounded minus zero a plain one
            return df.select(*[(F.round(F.col(c), DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        QUERIES[name] = run
        if sql is not None:
            body = PREFIX + (", " if sql.lstrip().startswith("+") else "") + sql.lstrip().removeprefix("+")
            cols = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in double)
            SQL[name] = f"SELECT * REPLACE ({cols}) FROM ({body})" if double else body
        return f

    return register


def _rep(spark, d):
    return repertoire(spark, d)


def _kept(spark, d):
    rows = _rep(spark, d)
    return clean.without(rows, removal(rows))


def _prod(spark, d):
    return clean.with_genes(_kept(spark, d)).where(clean.productive())


def _merged(spark, d):
    return clean.merged(_prod(spark, d))


def _ann(spark, d):
    return annotation(_rep(spark, d))


def _sub(spark, d):
    return sampling.subsample_hashed(_merged(spark, d), DEPTH, DRAWS, SEED)


def _groups(spark, d):
    return _ann(spark, d).select("sample_short", F.col("genotype").alias("grp"))


add("anti_semi_removal", "SELECT * FROM kept")(_kept)


def _unread(rows: DataFrame) -> DataFrame:
    """As in files of real runs: rearrangements out of frame have no amino acids."""
    return rows.withColumn("aminoAcid", F.when(F.col("sequenceStatus") == "In", F.col("aminoAcid")))


_UNREAD = """, ur AS (SELECT * REPLACE (CASE WHEN sequenceStatus = 'In' THEN aminoAcid END AS aminoAcid) FROM rep), ug AS (SELECT DISTINCT nucleotide, aminoAcid FROM ur WHERE nucleotide IN ({gone})),
um AS (SELECT ur.*, EXISTS (SELECT 1 FROM ug WHERE ug.nucleotide = ur.nucleotide AND ug.aminoAcid IS NOT DISTINCT FROM ur.aminoAcid) AS listed FROM ur)""".format(gone=", ".join(REMOVED))
add("anti_semi_removal_null", _UNREAD + " SELECT * EXCLUDE (listed) FROM um WHERE NOT listed")(lambda s, d: (lambda rows: clean.without(rows, removal(rows)))(_unread(_rep(s, d))))
add("cleanup_summary_null", _UNREAD + """ SELECT sample_short, CASE WHEN listed THEN 'removed' WHEN sequenceStatus = 'In' THEN 'productive' ELSE 'nonproductive' END AS category, count(*) AS num_sequences, sum(cnt)::BIGINT AS sum_counts
 FROM um WHERE listed OR (vFamilyName IS NOT NULL AND jGeneName IS NOT NULL) GROUP BY ALL""")(lambda s, d: (lambda rows: clean.cleanup_summary(rows, removal(rows)))(_unread(_rep(s, d))))
add("filter_has_vj", "SELECT * FROM genes")(lambda s, d: clean.with_genes(_kept(s, d)))
add("split_productive", "SELECT *, sequenceStatus IS NOT DISTINCT FROM 'In' AS productive FROM genes")(lambda s, d: clean.with_genes(_kept(s, d)).withColumn("productive", clean.productive()))
add("merge_samples", "SELECT * FROM merged")(_merged)


@add("cleanup_summary", """SELECT sample_short, category, count(*) AS num_sequences, sum(cnt)::BIGINT AS sum_counts FROM (
 SELECT r.*, CASE WHEN (nucleotide, aminoAcid) IN (SELECT (nucleotide, aminoAcid) FROM gone) THEN 'removed' WHEN vFamilyName IS NULL OR jGeneName IS NULL THEN NULL
 WHEN sequenceStatus = 'In' THEN 'productive' ELSE 'nonproductive' END AS category FROM rep r) WHERE category IS NOT NULL GROUP BY ALL""")
def _cleanup(s, d):
    rows = _rep(s, d)
    return clean.cleanup_summary(rows, removal(rows))


_FREQ = """, a AS ({long}), g AS (SELECT sample_short, param, grp, count(*) AS row_count, sum(cnt)::BIGINT AS cell_count FROM a GROUP BY ALL)
SELECT sample_short, param, grp, row_count, row_count / sum(row_count) OVER w AS row_fraction, cell_count, cell_count / sum(cell_count) OVER w AS cell_fraction FROM g WINDOW w AS (PARTITION BY sample_short, param)"""
add("freqs_single", _FREQ.format(long=" UNION ALL ".join(f"SELECT sample_short, cnt, '{p}' AS param, {p}::VARCHAR AS grp FROM genes WHERE {p} IS NOT NULL" for p in diversity.SINGLE)), ("row_fraction", "cell_fraction"))(lambda s, d: diversity.freqs_single(clean.with_genes(_kept(s, d))))
add("freqs_combo", _FREQ.format(long="SELECT sample_short, cnt, 'V-J-length' AS param, concat_ws('-', vFamilyName, jFamilyName, cdr3Length) AS grp FROM genes"), ("row_fraction", "cell_fraction"))(lambda s, d: diversity.freqs_combo(clean.with_genes(_kept(s, d))))

_INDEX = """, x AS (SELECT {by}, {v}::DOUBLE AS x, row_number() OVER (PARTITION BY {by} ORDER BY {v}) AS i, sum({v}) OVER (PARTITION BY {by}) AS t FROM {rows})
SELECT {by}, count(*) AS total_sequences, count(*) AS unique_sequences, sum(x)::BIGINT AS total_count,
 CASE WHEN count(*) <= 1 THEN 1.0 ELSE 1 - greatest(-sum(x / t * log2(x / t)), 0) / log2(count(*)) END AS clonality,
 CASE WHEN count(*) <= 1 THEN 0.0 ELSE least(greatest(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 0), 1) END AS gini,
 max(x) / sum(x) AS top_sequence, 1 / sum(x / t * x / t) AS inverse_simpson, CASE WHEN count(*) <= 1 THEN 0.0 ELSE greatest(-sum(x / t * log2(x / t)), 0) END AS shannon_index, 1.0::DOUBLE AS convergence
FROM x GROUP BY {by}"""
_INDEX_COLS = ("clonality", "gini", "top_sequence", "inverse_simpson", "shannon_index", "convergence")
add("diversity_indices", _INDEX.format(by="sample_short", v="cnt", rows="merged").replace("AS convergence", f"AS convergence, '{'_'.join(KEY)}' AS sequence_index, NULL::BIGINT AS rarefaction_iterations"), _INDEX_COLS)(lambda s, d: diversity.named(diversity.indices(_merged(s, d))))
add("clonality_legacy", """, x AS (SELECT sample_short, aminoAcid, cnt / sum(cnt) OVER (PARTITION BY sample_short) AS p FROM prod)
SELECT sample_short, count(DISTINCT aminoAcid) AS unique_sequences, 1 + sum(p * log2(p)) / CASE WHEN count(DISTINCT aminoAcid) > 1 THEN log2(count(DISTINCT aminoAcid)) ELSE 1 END AS clonality FROM x GROUP BY 1""", ("clonality",))(lambda s, d: diversity.row_clonality(_prod(s, d)))
add("shannon_nat", """, x AS (SELECT sample_short, cnt / sum(cnt) OVER (PARTITION BY sample_short) AS p FROM prod)
SELECT sample_short, -sum(p * ln(p)) AS shannon_diversity FROM x GROUP BY 1""", ("shannon_diversity",))(lambda s, d: diversity.shannon_nat(_prod(s, d)))
add("inv_simpson_groups", """, x AS (SELECT sample_short, vFamilyName, cnt / sum(cnt) OVER (PARTITION BY sample_short, vFamilyName) AS p FROM merged)
SELECT sample_short, vFamilyName, 1 / sum(p * p) AS inverse_simpson FROM x GROUP BY ALL""", ("inverse_simpson",))(lambda s, d: diversity.indices(_merged(s, d), ["sample_short", "vFamilyName"]).select("sample_short", "vFamilyName", "inverse_simpson"))
add("common_sequences", "SELECT aminoAcid, count(DISTINCT sample_short) AS repertoire_count, sum(cnt)::BIGINT AS total_count FROM merged WHERE aminoAcid != '' GROUP BY 1 HAVING count(DISTINCT sample_short) >= 2")(lambda s, d: diversity.common_sequences(_merged(s, d)))
add("usage_size", "SELECT vFamilyName, jGeneName, cdr3Length, count(*) AS size FROM rep GROUP BY ALL")(lambda s, d: _rep(s, d).groupBy("vFamilyName", "jGeneName", "cdr3Length").agg(F.count("*").alias("size")))
add("usage_na_fractions", """SELECT has_na, sequenceStatus, s / sum(s) OVER () * 100 AS pct FROM (SELECT vFamilyName IS NULL OR jGeneName IS NULL AS has_na, sequenceStatus, sum(cnt)::BIGINT AS s FROM rep GROUP BY ALL)""", ("pct",))(
    lambda s, d: _rep(s, d).groupBy((F.col("vFamilyName").isNull() | F.col("jGeneName").isNull()).alias("has_na"), "sequenceStatus").agg(F.sum("cnt").alias("s")).select("has_na", "sequenceStatus", (F.col("s") / F.sum("s").over(Window.partitionBy()) * 100).alias("pct")))
add("nonprod_fraction", "SELECT sample_short, count(*) FILTER (sequenceStatus != 'In') / count(*) AS unique_fraction, sum(cnt) FILTER (sequenceStatus != 'In') / sum(cnt) AS count_fraction FROM genes GROUP BY 1", ("unique_fraction", "count_fraction"))(
    lambda s, d: clean.with_genes(_kept(s, d)).groupBy("sample_short").agg((F.count_if(~clean.productive()) / F.count("*")).alias("unique_fraction"), (F.sum(F.when(~clean.productive(), F.col("cnt"))) / F.sum("cnt")).alias("count_fraction")))
add("slice_max", "SELECT sample_short, aminoAcid, cnt FROM (SELECT *, rank() OVER (PARTITION BY sample_short ORDER BY cnt DESC) AS r FROM merged) WHERE r <= 5")(
    lambda s, d: _merged(s, d).withColumn("r", F.rank().over(Window.partitionBy("sample_short").orderBy(F.desc("cnt")))).where("r <= 5").select("sample_short", "aminoAcid", "cnt"))
add("cumsum_cdf", """, a AS (SELECT sample_short, length(aminoAcid) AS len, sum(cnt)::BIGINT AS c FROM merged GROUP BY ALL)
SELECT sample_short, len::INT AS len, sum(c) OVER (PARTITION BY sample_short ORDER BY len) / sum(c) OVER (PARTITION BY sample_short) AS cdf FROM a""", ("cdf",))(
    lambda s, d: _merged(s, d).groupBy("sample_short", F.length("aminoAcid").alias("len")).agg(F.sum("cnt").alias("c")).select("sample_short", "len", (F.sum("c").over(Window.partitionBy("sample_short").orderBy("len")) / F.sum("c").over(Window.partitionBy("sample_short"))).alias("cdf")))
add("join_annotation", "SELECT m.*, patient, cells, genotype FROM merged m LEFT JOIN ann USING (sample_short)")(lambda s, d: _merged(s, d).join(_ann(s, d).drop("source"), "sample_short", "left").select("sample_short", *KEY, "cnt", "patient", "cells", "genotype"))

_OVER = """, r AS (SELECT sample_short, {key}, sum(cnt)::BIGINT AS cnt FROM merged GROUP BY ALL), o AS (SELECT sample_short, count(*) AS u, sum(cnt)::BIGINT AS c FROM r GROUP BY 1),
b AS (SELECT x.sample_short AS A, y.sample_short AS B, count(*) AS n, sum(x.cnt)::BIGINT AS ca, sum(y.cnt)::BIGINT AS cb FROM r x JOIN r y ON {on} AND x.sample_short < y.sample_short GROUP BY ALL)
SELECT x.sample_short AS A, y.sample_short AS B, coalesce(n, 0) AS unique_AB, x.u AS unique_A, y.u AS unique_B, coalesce(ca, 0) AS AB_countA, coalesce(cb, 0) AS AB_countB, x.c AS count_A, y.c AS count_B,
 coalesce(coalesce(n, 0) / nullif(x.u + y.u - coalesce(n, 0), 0), 0) AS jaccard_index, left(x.sample_short, 4) || '_' || left(y.sample_short, 4) AS short_id
FROM o x JOIN o y ON x.sample_short < y.sample_short LEFT JOIN b ON b.A = x.sample_short AND b.B = y.sample_short"""
for _n, _k in (("overlap_raw", KEY), ("overlap_raw_2", KEY[:2]), ("overlap_raw_1", KEY[:1])):
    add(_n, _OVER.format(key=", ".join(_k), on=" AND ".join(f"x.{c} IS NOT DISTINCT FROM y.{c}" for c in _k)), ("jaccard_index",))(lambda s, d, k=_k: overlap.overlap(_merged(s, d), k))

_WIDE = ["F000E", "F000N", "F002E", "F002N", "F004E"]
add("merged_matrix", "SELECT aminoAcid, vFamilyName, jGeneName, " + ", ".join(f"coalesce(sum(cnt) FILTER (sample_short = '{n}'), 0)::BIGINT AS {n}" for n in _WIDE) + f" FROM merged WHERE sample_short IN ({', '.join(repr(n) for n in _WIDE)}) GROUP BY ALL")(
    lambda s, d: clean.wide(_merged(s, d), KEY, _WIDE))
add("cdr3_valid", "SELECT sample_short, aminoAcid, vFamilyName, jGeneName, cnt, valid FROM vld")(lambda s, d: _merged(s, d).withColumn("valid", imgt.valid()))
add("imgt_explode", "SELECT DISTINCT aminoAcid, idx, IMGT_position, AA_ AS AA FROM res")(lambda s, d: imgt.residues(_merged(s, d)).select("aminoAcid", "idx", "IMGT_position", "AA").distinct())
_IMGT = """, g AS (SELECT {by}, AA_ AS AA, sum(cnt)::BIGINT AS counts, count(*) FILTER (cnt > 0) AS rows FROM res GROUP BY ALL)
SELECT {by}, AA, counts, rows, coalesce(counts / nullif(sum(counts) OVER w, 0), 0) AS counts_freq, coalesce(rows / nullif(sum(rows) OVER w, 0), 0) AS rows_freq FROM g WINDOW w AS (PARTITION BY {by})"""
for _n, _l, _v in (("imgt_freq_full", False, False), ("imgt_freq_vfam", False, True), ("imgt_freq_wl", True, False), ("imgt_freq_wl_vfam", True, True)):
    add(_n, _IMGT.format(by=", ".join(["sample_short", "IMGT_position", *["len"] * _l, *["vFamilyName"] * _v])), ("counts_freq", "rows_freq"))(lambda s, d, l=_l, v=_v: imgt.aa_table(imgt.residues(_merged(s, d)), l, v))

add("subsample_md5", "SELECT * FROM sub")(_sub)
_SHARE = """, r AS (SELECT sample_short, iter, vFamilyName AS v, jGeneName AS j, length(aminoAcid) AS l FROM sub WHERE n > 0), g AS (
 SELECT 'V_J_length' AS param, concat_ws('-', v, j, l) AS grp, sample_short, iter FROM r UNION ALL SELECT 'vFamilyName', v, sample_short, iter FROM r UNION ALL SELECT 'jGeneName', j, sample_short, iter FROM r
 UNION ALL SELECT 'cdr3_length', l::VARCHAR, sample_short, iter FROM r UNION ALL SELECT 'V_J', concat_ws('-', v, j), sample_short, iter FROM r),
gg AS (SELECT param, grp, sample_short, iter, count(*) AS c FROM g GROUP BY ALL), f AS (SELECT param, grp, sample_short, iter, c / sum(c) OVER (PARTITION BY param, sample_short, iter) AS value FROM gg)"""
add("freqs_subsampled", _SHARE + " SELECT * FROM f", ("value",))(lambda s, d: diversity.freqs_subsampled(_sub(s, d)))
add("freqs_summary", _SHARE + " SELECT param, grp, sample_short, coalesce(max(value) FILTER (iter = 0), 0) AS orig, avg(value) FILTER (iter > 0) AS mean_subsamples FROM f GROUP BY ALL", ("orig", "mean_subsamples"))(lambda s, d: diversity.freqs_summary(diversity.freqs_subsampled(_sub(s, d))))
add("subs_median", f"""+v AS (SELECT sample_short, iter, vFamilyName, sum(n)::DOUBLE AS c FROM sub GROUP BY ALL), i AS (SELECT DISTINCT sample_short, vFamilyName FROM v)
SELECT i.sample_short, i.vFamilyName, median(coalesce(c, 0)) AS median FROM i, range(1, {DRAWS + 1}) r(k) LEFT JOIN v ON v.sample_short = i.sample_short AND v.vFamilyName = i.vFamilyName AND v.iter = k GROUP BY ALL""", ("median",))(
    lambda s, d: imgt.median_with_zeros(_sub(s, d).groupBy("sample_short", "vFamilyName", "iter").agg(F.sum("n").alias("c")).select("sample_short", "vFamilyName", F.when(F.col("iter") > 0, F.col("c")).alias("c")), ["sample_short", "vFamilyName"], DRAWS, "c"))
_DRAWN = """, k AS (SELECT DISTINCT sample_short AS s, iter, concat_ws('|', upper(trim(aminoAcid)), upper(trim(vFamilyName)), upper(trim(jGeneName))) AS k FROM sub WHERE iter > 0), u AS (SELECT s, iter, count(*) AS u FROM k GROUP BY ALL),
p AS (SELECT a.s AS s1, a.iter AS i1, b.s AS s2, b.iter AS i2, a.u AS u1, b.u AS u2, CASE WHEN right(a.s, 1) = right(b.s, 1) AND a.s < b.s THEN 'within_' || right(a.s, 1) WHEN right(a.s, 1) = 'E' AND right(b.s, 1) = 'N' AND left(a.s, 4) = left(b.s, 4) THEN 'E_vs_N' END AS t FROM u a, u b),
o AS (SELECT a.s AS s1, a.iter AS i1, b.s AS s2, b.iter AS i2, count(*) AS n FROM k a JOIN k b USING (k) GROUP BY ALL),
w AS (SELECT s1 AS sample1, i1 AS subsample1, s2 AS sample2, i2 AS subsample2, coalesce(n, 0) AS unique_overlap, u1 AS unique1, u2 AS unique2, coalesce(n, 0) / (u1 + u2 - coalesce(n, 0)) AS jaccard, t AS comparison_type, 'AMIN_VFAM_JGEN' AS short_id FROM p LEFT JOIN o USING (s1, i1, s2, i2) WHERE t IS NOT NULL)"""
add("overlap_subs", _DRAWN + " SELECT * FROM w", ("jaccard",))(lambda s, d: overlap.overlap_draws(_sub(s, d)))
add("overlap_mean", _DRAWN + " SELECT sample1, sample2, comparison_type, avg(jaccard) AS mean_jaccard, median(jaccard) AS median_jaccard FROM w GROUP BY ALL", ("mean_jaccard", "median_jaccard"))(lambda s, d: overlap.overlap_mean(overlap.overlap_draws(_sub(s, d))))
_PUB = """, sh AS (SELECT aminoAcid, vFamilyName, jGeneName, genotype AS grp, iter AS k, count(*) AS n_shared FROM sub JOIN ann USING (sample_short) WHERE iter > 0 GROUP BY ALL),
ge AS (SELECT aminoAcid, vFamilyName, jGeneName, grp, N, count(*) AS rounds FROM (SELECT *, unnest(range(2, n_shared + 1)) AS N FROM sh) GROUP BY ALL)"""
add("rare_publicity", _PUB + " SELECT * FROM sh")(lambda s, d: overlap.publicity(_sub(s, d), _groups(s, d)))


def _packed(s, d):
    """Sharing by round, a clonotype and group in one row."""
    return overlap.packed_publicity(overlap.packed_draws(_sub(s, d), DRAWS), _groups(s, d), DRAWS)


add("rare_publicity_packed", _PUB + " SELECT * FROM sh")(lambda s, d: overlap.unpacked(_packed(s, d)))
add("sharing_ge_n", _PUB + " SELECT * FROM ge")(lambda s, d: overlap.packed_sharing(_packed(s, d)))
add("sharing_summary", _PUB + " SELECT * FROM ge WHERE N >= 3 AND (aminoAcid, vFamilyName, jGeneName) IN (SELECT (aminoAcid, vFamilyName, jGeneName) FROM sh WHERE n_shared >= 3)")(lambda s, d: overlap.sharing_summary(overlap.publicity(_sub(s, d), _groups(s, d)), 3))
_PAIRS = """, x AS (SELECT DISTINCT {key}, sample_short AS s, iter AS k FROM sub WHERE iter > 0), dp AS ({pairs}),
m AS (SELECT a.s AS sample_a, b.s AS sample_b, a.k, count(*) AS shared FROM x a JOIN x b ON {on} AND a.k = b.k AND a.s != b.s GROUP BY ALL)
SELECT type_of_sharing, grps, '{by}' AS sharing_by, sample_a, sample_b, k::INT AS k, coalesce(shared, 0) AS shared FROM dp CROSS JOIN range(1, {draws} + 1) r(k) LEFT JOIN m USING (sample_a, sample_b, k)"""
_ALL_PAIRS = """SELECT CASE WHEN a.genotype = b.genotype THEN 'within' ELSE 'between' END AS type_of_sharing, CASE WHEN a.genotype = b.genotype THEN a.genotype ELSE a.genotype || '_' || b.genotype END AS grps,
 a.sample_short AS sample_a, b.sample_short AS sample_b FROM ann a JOIN ann b ON (a.genotype = b.genotype AND a.sample_short < b.sample_short) OR (a.genotype < b.genotype AND a.sample_short != b.sample_short)"""
# declared: one group with itself, and one pair of groups against the order of names; one sample of the sheet has no draws, and pairs with it share nothing
_SOME_PAIRS = """SELECT 'within' AS type_of_sharing, 'hoDQ8' AS grps, a.s AS sample_a, b.s AS sample_b FROM sheet a JOIN sheet b ON a.g = 'hoDQ8' AND b.g = 'hoDQ8' AND a.s < b.s
 UNION ALL SELECT 'between', 'hoDQ8_heDQ2DQ8', a.s, b.s FROM sheet a JOIN sheet b ON a.g = 'hoDQ8' AND b.g = 'heDQ2DQ8' AND a.s != b.s"""


def _pair_sql(key, pairs):
    return _PAIRS.format(key=", ".join(key), pairs=pairs, on=" AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in key), by="_".join(key), draws=DRAWS)


def _sheet(s, d):
    """The groups of a sheet that also names a sample without rearrangements."""
    return _groups(s, d).unionByName(s.createDataFrame([("F999N", "hoDQ8")], "sample_short string, grp string"))


add("pairwise_sharing", _pair_sql(KEY, _ALL_PAIRS))(lambda s, d: overlap.pairwise(_sub(s, d), overlap.declared_pairs(_groups(s, d)), DRAWS))
add("pairwise_declared", ", sheet AS (SELECT sample_short AS s, genotype AS g FROM ann UNION ALL SELECT 'F999N', 'hoDQ8')" + _pair_sql(KEY[:2], _SOME_PAIRS))(
    lambda s, d: overlap.pairwise(_sub(s, d), overlap.declared_pairs(_sheet(s, d), ["hoDQ8"], [("hoDQ8", "heDQ2DQ8")]), DRAWS, KEY[:2]))
add("v_family_of_public", _PUB + """, p AS (SELECT DISTINCT aminoAcid, vFamilyName, jGeneName, grp FROM sh WHERE n_shared >= 2) SELECT grp, vFamilyName, n, n / sum(n) OVER (PARTITION BY grp) AS fraction FROM (SELECT grp, vFamilyName, count(*) AS n FROM p GROUP BY ALL)""", ("fraction",))(
    lambda s, d: overlap.publicity(_sub(s, d), _groups(s, d)).where("n_shared >= 2").select(*KEY, "grp").distinct().groupBy("grp", "vFamilyName").agg(F.count("*").alias("n")).withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("grp"))))

_PROPS = "+pr(AA_, prop, value) AS (VALUES {}), pm AS (SELECT sample_short, IMGT_position, prop, sum(cnt * value) / nullif(sum(cnt)::DOUBLE, 0) AS mean_value FROM res JOIN pr USING (AA_) GROUP BY ALL)"


def _prop_sql(properties=imgt.cruciani_values) -> str:
    return _PROPS.format(", ".join(f"('{a}', '{p}', {v!r}::DOUBLE)" for a, p, v in properties()))


def _props(s, d):
    res = imgt.residues(_merged(s, d))
    return imgt.property_means(res, imgt.cruciani(s), ["sample_short", "IMGT_position"], "cnt")


add("weighted_mean_property", _prop_sql() + " SELECT * FROM pm", ("mean_value",))(_props)


_MEAN_OF_FREQS = """, fr AS (SELECT sample_short, IMGT_position, AA_, sum(cnt) AS c FROM res GROUP BY ALL), fq AS (SELECT *, c / sum(c) OVER (PARTITION BY sample_short, IMGT_position) AS f FROM fr)
SELECT sample_short, IMGT_position, prop, sum(f * value) / nullif(sum(f), 0) AS mean_value FROM fq JOIN pr USING (AA_) GROUP BY ALL"""


def _means_of_freqs(s, d, properties):
    return imgt.property_means(imgt.aa_table(imgt.residues(_merged(s, d))), properties(s), ["sample_short", "IMGT_position"], "counts_freq")


add("weighted_mean_freqs", _prop_sql() + _MEAN_OF_FREQS, ("mean_value",))(lambda s, d: _means_of_freqs(s, d, imgt.cruciani))
# factors of two digits over totals of 2^n are exact ties of the last digit; a shift beyond the noise of the sums rounds them alike
add("weighted_mean_kidera", _prop_sql(imgt.kidera_values) + _MEAN_OF_FREQS.replace("AS mean_value", "+ 1e-12 AS mean_value"), ("mean_value",))(
    lambda s, d: _means_of_freqs(s, d, imgt.kidera).withColumn("mean_value", F.col("mean_value") + 1e-12))


def _positional(s, d):
    rows = imgt.aa_table(imgt.residues(_merged(s, d))).select("sample_short", "IMGT_position", "AA", F.col("counts_freq").alias("value"))
    return imgt.min_support(rows, ["IMGT_position", "AA"], 0.0, 5, "value").join(_ann(s, d).drop("source"), "sample_short")


_TEST = """, g AS (SELECT sample_short, IMGT_position, AA_ AS AA, sum(cnt) AS c FROM res GROUP BY ALL), f AS (SELECT sample_short, IMGT_position, AA, c / sum(c) OVER (PARTITION BY sample_short, IMGT_position) AS value FROM g),
tr AS (SELECT f.*, patient, cells, genotype FROM f JOIN ann USING (sample_short) WHERE (IMGT_position, AA) IN (SELECT (IMGT_position, AA) FROM f GROUP BY IMGT_position, AA HAVING count(*) FILTER (value > 0) >= 5)),
tg(tag, genotype, side) AS (VALUES ('oo','hoDQ2','a'), ('oo','hoDQ8','b'), ('eo','heDQ2DQ8','a'), ('eo','hoDQ2','b'), ('eo','hoDQ8','b'), ('do','heDQ2DQ8','a'), ('do','hoDQ8','b'), ('po','heDQ2DQ8','a'), ('po','hoDQ2','b'))"""
for _n in "EN":
    add(f"filter_cells_{_n}", _TEST + f" SELECT sample_short, IMGT_position, AA, value, patient, cells, genotype FROM tr WHERE sample_short LIKE '%{_n}'", ("value",))(lambda s, d, c=_n: metadata.of_cells(_positional(s, d), c))
add("test_ready", _TEST + " SELECT sample_short, IMGT_position, AA, value, patient, cells, genotype FROM tr", ("value",))(_positional)
_TWO = """, st AS (SELECT cells, IMGT_position, {x}, tag, count(v) FILTER (side = 'a') AS na, count(v) FILTER (side = 'b') AS nb, avg(v) FILTER (side = 'a') AS ma, avg(v) FILTER (side = 'b') AS mb, var_samp(v) FILTER (side = 'a') AS va, var_samp(v) FILTER (side = 'b') AS vb
 FROM ({rows}) JOIN tg USING (genotype) GROUP BY ALL)"""
add("ttest_pooled", _TEST + _TWO.format(x="AA", rows="SELECT cells, IMGT_position, AA, sample_short, genotype, avg(value) AS v FROM tr GROUP BY ALL") + """, z AS (SELECT *, ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) AS sp FROM st WHERE na >= 2 AND nb >= 2)
SELECT cells, IMGT_position, AA, tag, na AS n_a, nb AS n_b, ma AS mean_a, mb AS mean_b, round((ma - mb) / sqrt(sp), 6) AS cohen_d, round((ma - mb) / sqrt(sp * (1 / na + 1 / nb)), 6) AS t, na + nb - 2 AS df FROM z WHERE sp > 1e-18""", ("mean_a", "mean_b", "cohen_d", "t"))(
    lambda s, d: (lambda o: o.withColumns({c: F.round(c, 6) for c in ("cohen_d", "t")}))(_pooled(s, d)))


def _pooled(s, d):
    # a pooled variance of rounding noise counts as 0 here
    return comparisons.ttest_pooled(_positional(s, d), ["cells", "IMGT_position", "AA"], least_variance=1e-18)


add("ttest_paired", _TEST + """, b AS (SELECT IMGT_position, AA, patient, genotype, avg(value) FILTER (cells = 'E') - avg(value) FILTER (cells = 'N') AS dd FROM tr GROUP BY ALL),
s AS (SELECT IMGT_position, AA, dd, unnest(['all', genotype]) AS stratum FROM b WHERE dd IS NOT NULL), z AS (SELECT IMGT_position, AA, stratum, count(*) AS n_pairs, avg(dd) AS mean_diff, stddev_samp(dd) AS sd_diff FROM s GROUP BY ALL HAVING count(*) >= 2)
SELECT IMGT_position, AA, stratum, n_pairs, mean_diff, sd_diff, CASE WHEN sd_diff > 1e-9 THEN round(mean_diff / (sd_diff / sqrt(n_pairs)), 6) END AS t, n_pairs - 1 AS df FROM z""", ("mean_diff", "sd_diff", "t"))(
    lambda s, d: comparisons.ttest_paired(_positional(s, d), ["IMGT_position", "AA"]).withColumn("t", F.when(F.col("sd_diff") > 1e-9, F.round("t", 6))))


def _prop_test(s, d):
    return _props(s, d).join(_ann(s, d).drop("source"), "sample_short")


_PROP_TEST = _prop_sql() + _TEST + ", pt AS (SELECT pm.*, patient, cells, genotype FROM pm JOIN ann USING (sample_short))"
add("welch", _PROP_TEST + _TWO.format(x="prop", rows="SELECT cells, IMGT_position, prop, genotype, mean_value AS v FROM pt") + """, z AS (SELECT *, va / na AS qa, vb / nb AS qb, na >= 2 AND nb >= 2 AND va / na + vb / nb > 1e-18 AS ok FROM st)
SELECT cells, IMGT_position, prop, tag, na AS n_a, nb AS n_b, ma AS mean_a, mb AS mean_b, ma - mb AS diff, CASE WHEN ok THEN round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) END AS cohen_d,
 CASE WHEN ok THEN round((ma - mb) / sqrt(qa + qb), 6) END AS t, CASE WHEN ok THEN round((qa + qb) * (qa + qb) / (qa * qa / (na - 1) + qb * qb / (nb - 1)), 6) END AS df FROM z""", ("mean_a", "mean_b", "diff", "cohen_d", "t", "df"))(lambda s, d: _welch(s, d))


def _welch(s, d):
    rows = comparisons.welch(_prop_test(s, d), ["cells", "IMGT_position", "prop"], "mean_value")
    sure = F.abs(F.try_divide("diff", "t")) > 1e-9  # a standard error of rounding noise counts as 0 here
    return rows.withColumns({c: F.when(sure, F.round(c, 6)) for c in ("cohen_d", "t", "df")})


@add("hotelling")
def _hotelling(s, d):
    props = ["PP1", "PP2", "PP3"]
    wide = _prop_test(s, d).groupBy("sample_short", "genotype", "cells", "IMGT_position").pivot("prop", props).agg(F.first("mean_value"))
    return comparisons.hotelling(wide, ["cells", "IMGT_position"], props)


@add("bh_fdr", """, a AS (SELECT sample_short, aminoAcid, vFamilyName, jGeneName, CASE WHEN cnt % 10 = 0 THEN NULL ELSE (cnt % 997 + 1) / 1000.0::DOUBLE END AS p FROM merged),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_short, p IS NULL ORDER BY p) AS k, count(p) OVER (PARTITION BY sample_short) AS m FROM a)
SELECT sample_short, aminoAcid, vFamilyName, jGeneName, p, CASE WHEN p IS NOT NULL THEN least(min(p * m / k) OVER (PARTITION BY sample_short, p IS NULL ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) END AS q_value FROM r""", ("p", "q_value"))
def _bh(s, d):
    from tessera.functions.tails import benjamini_hochberg

    rows = _merged(s, d).select("sample_short", *KEY, F.when(F.col("cnt") % 10 != 0, (F.col("cnt") % 997 + 1) / F.lit(1000.0)).alias("p"))
    return benjamini_hochberg(rows, "p", ["sample_short"])


def _lengths(s, d):
    rows = _merged(s, d).groupBy("sample_short", F.length("aminoAcid").alias("len")).agg(F.sum("cnt").alias("c"))
    share = rows.select("sample_short", "len", (F.col("c") / F.sum("c").over(Window.partitionBy("sample_short"))).alias("value"))
    return share.join(_ann(s, d), "sample_short").select("sample_short", "cells", "genotype", "len", "value")


_LEN = """, lf AS (SELECT sample_short, cells, genotype, len, c / sum(c) OVER (PARTITION BY sample_short) AS value FROM (SELECT sample_short, length(aminoAcid) AS len, sum(cnt) AS c FROM merged GROUP BY ALL) JOIN ann USING (sample_short))"""
add("ks_stat", _LEN + """, n AS (SELECT cells, genotype, count(DISTINCT sample_short) AS n FROM lf GROUP BY ALL), m AS (SELECT cells, genotype, len, sum(value) / any_value(n) AS m FROM lf JOIN n USING (cells, genotype) GROUP BY ALL),
q AS (SELECT *, m / sum(m) OVER (PARTITION BY cells, genotype) AS v FROM m), a AS (SELECT cells, len, sum(CASE WHEN genotype = 'hoDQ2' THEN v ELSE 0 END) AS x, sum(CASE WHEN genotype = 'hoDQ8' THEN v ELSE 0 END) AS y, sum(CASE WHEN genotype = 'heDQ2DQ8' THEN v ELSE 0 END) AS z FROM q GROUP BY ALL),
c AS (SELECT cells, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(z) OVER w AS z FROM a WINDOW w AS (PARTITION BY cells ORDER BY len))
SELECT cells, 'hoDQ2' AS group1, 'hoDQ8' AS group2, max(abs(x - y)) AS ks FROM c GROUP BY 1 UNION ALL SELECT cells, 'hoDQ2', 'heDQ2DQ8', max(abs(x - z)) FROM c GROUP BY 1 UNION ALL SELECT cells, 'hoDQ8', 'heDQ2DQ8', max(abs(y - z)) FROM c GROUP BY 1""", ("ks",))(lambda s, d: comparisons.ks_stat(_lengths(s, d), ["cells"]))
add("ks_perm_R")(lambda s, d: comparisons.ks_permuted(_lengths(s, d), plus_one=False, split=("cells",)))
add("ks_perm")(lambda s, d: comparisons.ks_permuted(_lengths(s, d), split=("cells",)))
add("ad_stat", _LEN + """, sh AS (SELECT sample_short, genotype, len, value * 1000 AS share FROM lf), lo AS (SELECT *, floor(share) AS low FROM sh),
rk AS (SELECT *, row_number() OVER (PARTITION BY sample_short ORDER BY round(share - low, 9) DESC, len DESC) AS r, 1000 - sum(low) OVER (PARTITION BY sample_short) AS rest FROM lo),
h AS (SELECT genotype, len, sum(low + (r <= rest)::INT)::DOUBLE AS f FROM rk GROUP BY ALL), g AS (SELECT genotype, sum(f) AS n FROM h GROUP BY 1), l AS (SELECT len, sum(f) AS l FROM h GROUP BY 1 HAVING sum(f) > 0),
x AS (SELECT g.genotype, g.n, l.len, l.l, coalesce(f, 0) AS f FROM g CROSS JOIN l LEFT JOIN h ON h.genotype = g.genotype AND h.len = l.len),
y AS (SELECT *, sum(l) OVER (PARTITION BY genotype) AS NN, sum(f) OVER w - f / 2 AS M, sum(l) OVER w - l / 2 AS B FROM x WINDOW w AS (PARTITION BY genotype ORDER BY len)),
z AS (SELECT genotype, n, NN, sum(l / NN * (NN * M - n * B) * (NN * M - n * B) / (B * (NN - B) - NN * l / 4)) AS s FROM y GROUP BY ALL)
SELECT round(max((NN - 1) / NN) * sum(s / n), 6) AS A2, count(*) AS k FROM z""", ("A2",))(lambda s, d: comparisons.ad_stat(comparisons.ad_histogram(_lengths(s, d))).withColumn("A2", F.round("A2", 6)))


def _usage(s, d):
    rows = _merged(s, d).groupBy("sample_short", "vFamilyName").agg(F.sum("cnt").alias("c"))
    return rows.select("sample_short", "vFamilyName", "c").join(_ann(s, d), "sample_short")


_RANK = ", v AS (SELECT sample_short, vFamilyName, sum(cnt)::BIGINT AS c, any_value(cells) AS cells, any_value(genotype) AS genotype FROM merged JOIN ann USING (sample_short) GROUP BY ALL)"
add("wilcoxon_cells", _RANK + """, r AS (SELECT *, rank() OVER (PARTITION BY vFamilyName ORDER BY c) + (count(*) OVER (PARTITION BY vFamilyName, c) - 1) / 2 AS r, count(*) OVER (PARTITION BY vFamilyName, c) AS ties FROM v),
g AS (SELECT vFamilyName, count(*) FILTER (cells = 'E') AS n1, count(*) FILTER (cells = 'N') AS n2, sum(r) FILTER (cells = 'E') AS r1, sum(ties * ties - 1) AS tie, count(*)::DOUBLE AS n FROM r GROUP BY 1)
SELECT vFamilyName, n1, n2, r1 - n1 * (n1 + 1) / 2 AS U, (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n + 1 - tie / (n * (n - 1)))) AS z FROM g WHERE n1 > 0 AND n2 > 0""", ("U", "z"))(
    lambda s, d: comparisons.wilcoxon(_usage(s, d).select("vFamilyName", F.col("cells").alias("grp"), F.col("c").alias("value")), ["vFamilyName"], ("E", "N")))
add("kruskal_genotype", _RANK + """, r AS (SELECT *, rank() OVER (PARTITION BY vFamilyName ORDER BY c) + (count(*) OVER (PARTITION BY vFamilyName, c) - 1) / 2 AS r, count(*) OVER (PARTITION BY vFamilyName, c) AS ties, count(*) OVER (PARTITION BY vFamilyName) AS n FROM v),
g AS (SELECT vFamilyName, genotype, sum(r) AS s, count(*) AS k, max(n)::DOUBLE AS n, sum(ties * ties - 1) AS tie FROM r GROUP BY ALL), h AS (SELECT vFamilyName, sum(s * s / k) AS q, max(n) AS n, sum(tie) AS tie, count(*) - 1 AS df FROM g GROUP BY 1)
SELECT vFamilyName, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS H, df FROM h WHERE df > 0""", ("H",))(
    lambda s, d: comparisons.kruskal(_usage(s, d).select("vFamilyName", F.col("genotype").alias("grp"), F.col("c").alias("value")), ["vFamilyName"]))
add("groups_yml", "SELECT genotype AS grp, string_agg(sample_short, ',' ORDER BY sample_short) AS samples FROM ann GROUP BY 1")(lambda s, d: _groups(s, d).groupBy("grp").agg(F.array_join(F.array_sort(F.collect_set("sample_short")), ",").alias("samples")))
add("subsample_np")(lambda s, d: sampling.subsample(_merged(s, d), 1000, 3))
add("rarefied_diversity")(lambda s, d: diversity.rarefied(_merged(s, d), 1000, 5))
add("rarefied_default")(lambda s, d: diversity.rarefied(_merged(s, d), None, 5))
add("expected_unique", """, t AS (SELECT sample_short, sum(cnt)::BIGINT AS t FROM merged GROUP BY 1)
SELECT sample_short, (SELECT min(t) FROM t) AS depth, sum(1 - pow(1 - cnt / t, (SELECT min(t) FROM t))) AS expected FROM merged JOIN t USING (sample_short) GROUP BY 1""", ("expected",))(lambda s, d: diversity.expected_unique(_merged(s, d)))
add("rarefaction_curve")(lambda s, d: diversity.rarefaction_curve(_merged(s, d)))


def _packed_np(s, d):
    return overlap.packed_publicity(sampling.draw_rounds(_merged(s, d), 1000, 5), _groups(s, d), 5)


add("rare_publicity_np")(lambda s, d: overlap.unpacked(_packed_np(s, d)))
add("sharing_np")(lambda s, d: overlap.packed_sharing(_packed_np(s, d)))
