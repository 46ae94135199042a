"""Queries over test results, names of samples and usage matrices; same rules as ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.tails import adjusted, benjamini_hochberg, t_p
from tessera.operators import clean, comparisons, diversity, imgt, metadata, multivariate, overlap, reports, sampling
from tessera.plans import queries as q
from tessera.plans.queries import add
from tessera.sources.adapter import removal
from tessera.sources.staging import written

INDEX = ["cells", "IMGT_position", "AA"]
NOISE = 1e-18  # a pooled variance of rounding noise counts as 0


def _t_sql(name: str, index: str, rows: str) -> str:
    """CTE ``name``: pooled t tests of ``rows`` by ``index``; needs the CTE tg."""
    return f""", {name} AS (SELECT {index}, tag, na AS n_a, nb AS n_b, ma AS mean_a, mb AS mean_b, round((ma - mb) / sqrt(sp), 6) AS cohen_d, round((ma - mb) / sqrt(sp * (1 / na + 1 / nb)), 6) AS t FROM (
 SELECT *, ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) AS sp FROM (SELECT {index}, tag, count(v) FILTER (side = 'a') AS na, count(v) FILTER (side = 'b') AS nb, avg(v) FILTER (side = 'a') AS ma, avg(v) FILTER (side = 'b') AS mb,
 var_samp(v) FILTER (side = 'a') AS va, var_samp(v) FILTER (side = 'b') AS vb FROM (SELECT {index}, sample_short, genotype, avg(value) AS v FROM {rows} GROUP BY ALL) JOIN tg USING (genotype) GROUP BY ALL) WHERE na >= 2 AND nb >= 2) WHERE sp > {NOISE})"""


def _tests(rows, index):
    stats = comparisons.ttest_pooled(rows, index, least_variance=NOISE)
    return stats.withColumns({c: F.round(c, 6) for c in ("cohen_d", "t")})


def _plain(s, d):
    return _tests(q._positional(s, d), INDEX)


_TT = q._TEST + _t_sql("tt", "cells, IMGT_position, AA", "tr")
_WIDE = ["n_a", "n_b", "cohen_d", "t"]
_TAGS = list(comparisons.TAGS)
add("join_tags_outer", _TT + " SELECT cells, IMGT_position, AA, " + ", ".join(f"max({v}) FILTER (tag = '{t}') AS {v}_{t}" for t in _TAGS for v in _WIDE) + " FROM tt GROUP BY ALL", tuple(f"{v}_{t}" for t in _TAGS for v in ("cohen_d", "t")))(
    lambda s, d: reports.side_by_side(_plain(s, d), INDEX, _WIDE))


def _with_p(s, d):
    return _plain(s, d).withColumn("p_value", t_p(F.col("t"), F.col("df")))


add("filter_significant")(lambda s, d: reports.significant(reports.side_by_side(_with_p(s, d), INDEX, ["p_value", "cohen_d"])))
add("filter_imgt_range")(lambda s, d: _with_p(s, d).where(reports.in_loop() & (F.col("p_value") < 0.01)))
add("plogo_table", _TT + """, h AS (SELECT cells, IMGT_position, AA, CASE WHEN cohen_d >= 0 THEN 'pos' ELSE 'neg' END AS direction, abs(cohen_d) AS height FROM tt WHERE tag = 'oo' AND abs(cohen_d) >= 0.3 AND greatest(mean_a, mean_b) >= 0.01),
y AS (SELECT *, sum(height) OVER (PARTITION BY cells, IMGT_position, direction ORDER BY height DESC, AA ROWS UNBOUNDED PRECEDING) AS top FROM h)
SELECT cells, IMGT_position, AA, direction, height, CASE WHEN direction = 'pos' THEN top - height ELSE -top END AS ymin, CASE WHEN direction = 'pos' THEN top ELSE -(top - height) END AS ymax FROM y""", ("height", "ymin", "ymax"))(
    lambda s, d: reports.logo_stack(_plain(s, d).where("tag = 'oo'"), ["cells"], 0.3, least_mean=0.01))
add("bonferroni_count", _TT + " SELECT cells, tag, count(*) AS tests FROM (SELECT DISTINCT cells, tag, IMGT_position, AA FROM tt WHERE IMGT_position IN (" + ", ".join(f"'{p}'" for p in reports.TESTED) + ") AND greatest(mean_a, mean_b) > 0.01) GROUP BY ALL")(
    lambda s, d: reports.tests_done(_plain(s, d), ["cells", "tag"]))


def _by_length(s, d, family):
    rows = imgt.aa_table(imgt.residues(q._merged(s, d)), True, family)
    return rows.withColumnRenamed("counts_freq", "value").join(q._ann(s, d).drop("source"), "sample_short")


_FREQ = "SELECT g.*, c / sum(c) OVER (PARTITION BY sample_short, IMGT_position, {by}) AS value FROM (SELECT sample_short, IMGT_position, {by}, AA_ AS AA, sum(cnt) AS c FROM res GROUP BY ALL) g"
add("driven_by_family", q._TEST + f", fl AS (SELECT f.*, cells, genotype FROM ({_FREQ.format(by='len')}) f JOIN ann USING (sample_short)), fv AS (SELECT f.*, cells, genotype FROM ({_FREQ.format(by='len, vFamilyName')}) f JOIN ann USING (sample_short))"
    + _t_sql("tl", "cells, IMGT_position, len, AA", "fl") + _t_sql("tv", "cells, IMGT_position, len, AA, vFamilyName", "fv")
    + """ SELECT cells, IMGT_position, len, AA, tag, count(vFamilyName) AS families_tested, coalesce(sum((abs(v.t) >= 2)::INT), 0)::BIGINT AS families_significant
 FROM tl LEFT JOIN tv v USING (cells, IMGT_position, len, AA, tag) WHERE abs(tl.t) >= 2 GROUP BY ALL""")(
    lambda s, d: reports.driven_by_family(_tests(_by_length(s, d, False), ["cells", "IMGT_position", "len", "AA"]), _tests(_by_length(s, d, True), ["cells", "IMGT_position", "len", "AA", "vFamilyName"]), ["cells", "IMGT_position", "len", "AA", "tag"], F.abs("t") >= 2))


@add("property_marks")
def _marks(s, d):
    stats = comparisons.welch(q._prop_test(s, d), ["cells", "IMGT_position", "prop"], "mean_value").where("tag = 'oo'")
    return reports.property_marks(benjamini_hochberg(stats.withColumn("p", t_p(F.col("t"), F.col("df"))), "p", ["cells"]), ["q_value"])


add("zscore_clip", q._prop_sql() + " SELECT *, CASE WHEN stddev_samp(mean_value) OVER w > 1e-9 THEN greatest(least((mean_value - avg(mean_value) OVER w) / stddev_samp(mean_value) OVER w, 2), -2) END AS z FROM pm WINDOW w AS (PARTITION BY IMGT_position, prop)", ("mean_value", "z"))(
    lambda s, d: reports.clipped_z(q._props(s, d), ["IMGT_position", "prop"], "mean_value"))
_LETTERS = ", le AS (SELECT len, right(sample_short, 1) AS cells, IMGT_position, string_agg(DISTINCT AA_, '' ORDER BY AA_) AS letters FROM res GROUP BY ALL)"


def _letters(s, d):
    return reports.letters(imgt.residues(q._merged(s, d)).withColumn("cells", F.right("sample_short", F.lit(1))), ["len", "cells", "IMGT_position"])


add("letters_concat", _LETTERS + " SELECT * FROM le")(_letters)
add("letter_position", _LETTERS + " SELECT len, cells, IMGT_position, place::INT AS place, substr(letters, place::INT, 1) AS AA FROM (SELECT *, unnest(range(1, length(letters) + 1)) AS place FROM le)")(lambda s, d: reports.spelled(_letters(s, d), ["len", "cells", "IMGT_position"]))
_BEST = ", best AS (SELECT aminoAcid, vFamilyName, jGeneName, grp, max(N) AS m FROM ge WHERE rounds >= 2 GROUP BY ALL) SELECT aminoAcid, vFamilyName, jGeneName, "
_GENOTYPES = ["hoDQ2", "hoDQ8", "heDQ2DQ8"]
add("public_filter", q._PUB + _BEST + ", ".join(f"coalesce(max(m) FILTER (grp = '{g}'), 0) AS {g}" for g in _GENOTYPES) + " FROM best GROUP BY ALL HAVING max(m) >= 3")(
    lambda s, d: reports.best_sharing(overlap.sharing_at_least(overlap.publicity(q._sub(s, d), q._groups(s, d))), _GENOTYPES, 3, 2))


def _families(s, d):
    return diversity.freqs_subsampled(q._sub(s, d)).where("param = 'vFamilyName' AND iter > 0")


_FAMILY = q._SHARE + ", fa AS (SELECT * FROM f WHERE param = 'vFamilyName' AND iter > 0)"
add("filter_prevalence", _FAMILY + " SELECT * FROM fa WHERE grp IN (SELECT grp FROM fa GROUP BY grp HAVING count(*) FILTER (value > 0) >= (SELECT count(*) FROM (SELECT DISTINCT sample_short, iter FROM fa)) / 3.0)", ("value",))(lambda s, d: reports.prevalent(_families(s, d), "grp"))
add("airr_rename", "SELECT sample_short, nucleotide AS sequence, aminoAcid AS junction_aa, vFamilyName AS v_family, jGeneName AS j_call, jFamilyName AS j_family, cdr3Length::BIGINT AS junction_aa_length, sequenceStatus AS frame_type, cnt AS duplicate_count, sequenceStatus = 'In' AS productive FROM rep")(lambda s, d: metadata.exchange_names(q._rep(s, d)))
add("cleanup_collate", """, c AS (SELECT r.*, CASE WHEN (nucleotide, aminoAcid) IN (SELECT (nucleotide, aminoAcid) FROM gone) THEN 'removed' WHEN vFamilyName IS NULL OR jGeneName IS NULL THEN NULL WHEN sequenceStatus = 'In' THEN 'productive' ELSE 'nonproductive' END AS k FROM rep r)
SELECT sample_short, """ + ", ".join(f"count(*) FILTER (k = '{k}') AS {k}_num_sequences, coalesce(sum(cnt) FILTER (k = '{k}'), 0)::BIGINT AS {k}_sum_counts" for k in ("removed", "productive", "nonproductive")) + " FROM c WHERE k IS NOT NULL GROUP BY 1")(
    lambda s, d: metadata.cleanup_by_sample(clean.cleanup_summary(q._rep(s, d), removal(q._rep(s, d)))))
add("anonym_ids", "SELECT patient, source, source || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS anonym_patient_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY patient) AS n FROM (SELECT DISTINCT patient, left(patient, 1) AS source FROM ann))")(lambda s, d: metadata.anonymous_ids(q._ann(s, d)))
add("oof_length", "SELECT sample_short, cdr3Length::INT AS cdr3Length, CASE WHEN cdr3Length % 3 = 0 THEN 'stop' ELSE 'out' END AS kind, count(*) AS n FROM genes WHERE sequenceStatus IS DISTINCT FROM 'In' AND cdr3Length BETWEEN 30 AND 66 GROUP BY ALL")(
    lambda s, d: clean.with_genes(q._kept(s, d)).where(~clean.productive() & F.col("cdr3Length").between(30, 66)).groupBy("sample_short", "cdr3Length", F.when(F.col("cdr3Length") % 3 == 0, "stop").otherwise("out").alias("kind")).agg(F.count("*").alias("n")))

_PEOPLE = """SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'Finland' WHEN s_suppkey % 3 = 1 THEN 'TrialNet' ELSE 'Other' END AS cohort,
 CASE WHEN s_suppkey % 3 = 0 THEN cast(s_suppkey AS string) ELSE concat('TN00', lpad(cast(s_suppkey AS string), 5, '0'), 'F01') END AS id,
 CASE WHEN s_nationkey % 2 = 0 THEN 'homo DQ2' ELSE 'homo DQ8' END AS genotype, CASE WHEN s_suppkey % 30 = 0 THEN 'IN ERROR SEND AS 6828' ELSE 'ok' END AS remark FROM {supplier}"""
_SHEET = """SELECT concat(CASE WHEN s_suppkey % 3 = 0 THEN concat('FIN_', cast(s_suppkey AS string)) ELSE concat('TN00', lpad(cast(s_suppkey AS string), 5, '0'), 'F01') END,
 CASE WHEN s_suppkey % 2 = 0 THEN '_NAIVE' ELSE '_AgXP' END, '_TCRB.tsv.gz') AS SAMPLE, concat('/in/', cast(s_suppkey AS string)) AS LOC FROM {supplier}"""


def _supplier(s, d, sql):
    return s.sql(sql, supplier=s.read.parquet(f"{d}/supplier.parquet"))


_NAMES = f""", pe AS ({_PEOPLE.replace('{supplier}', 'supplier')}), nn AS (SELECT *, CASE WHEN cohort = 'Finland' AND contains(remark, 'IN ERROR SEND AS 6828') THEN 'FIN_6826' WHEN cohort = 'Finland' THEN 'FIN_' || id WHEN cohort = 'TrialNet' THEN id ELSE '' END AS newname FROM pe),
na AS (SELECT newname, CASE WHEN newname LIKE 'FIN\\_%' ESCAPE '\\' THEN replace(newname, 'IN_', '') WHEN newname LIKE 'TN%' THEN 'T' || substr(newname, 5, length(newname) - 7) ELSE '' END AS shortname, replace(genotype, ' ', '') AS genotype_short FROM nn)"""
add("prep_names", _NAMES + " SELECT * FROM na")(lambda s, d: metadata.individual_names(_supplier(s, d, _PEOPLE)))
add("collate_info", _NAMES + f""", sh AS ({_SHEET.replace('{supplier}', 'supplier')}), b AS (SELECT *, regexp_extract(SAMPLE, '^(.*)_(NAIVE|AgXP)_TCRB', 1) AS raw, CASE WHEN SAMPLE LIKE '%AgXP%' THEN 'E' ELSE 'N' END AS cells FROM sh),
c AS (SELECT *, CASE raw WHEN 'FIN_6828' THEN 'FIN_6826' WHEN 'TN0013371F01' THEN 'TN0013372F01' ELSE raw END AS newname FROM b), one AS (SELECT newname, shortname, any_value(genotype_short) AS genotype_short FROM na WHERE newname NOT IN ('', 'FIN_6826') GROUP BY ALL)
SELECT SAMPLE, LOC, cells, newname, shortname, genotype_short, shortname || cells AS sample_short FROM c LEFT JOIN one USING (newname)""")(
    lambda s, d: metadata.collate(_supplier(s, d, _SHEET), metadata.individual_names(_supplier(s, d, _PEOPLE)).where("newname NOT IN ('', 'FIN_6826')")))


def _members(s, d):
    """A specification by patient for source F and by sample for the rest."""
    ann = q._ann(s, d)
    return ann.select(F.when(F.col("source") == "F", F.col("patient")).otherwise(F.col("sample_short")).alias("member"), F.col("genotype").alias("grp")).where("member NOT LIKE 'T%E'")


add("map_sample_group", "SELECT sample_short, patient, cells, genotype, CASE WHEN sample_short LIKE 'F%' OR sample_short LIKE '%N' THEN genotype END AS grp FROM ann")(
    lambda s, d: metadata.group_of(q._ann(s, d).drop("source"), _members(s, d)).select("sample_short", "patient", "cells", "genotype", "grp"))
add("slice_sample", "SELECT sample_short, patient, cells, genotype, row_number() OVER (PARTITION BY genotype, cells ORDER BY md5(sample_short), sample_short) <= floor(count(*) OVER (PARTITION BY genotype, cells) * 0.2) AS held_out FROM ann")(
    lambda s, d: multivariate.holdout(q._ann(s, d).drop("source"), ["genotype", "cells"]).select("sample_short", "patient", "cells", "genotype", "held_out"))
add("pairwise_np")(lambda s, d: overlap.pairwise(sampling.subsample(q._merged(s, d), 1000, 5), overlap.declared_pairs(q._groups(s, d)), 5))


def _usage_rows(s, d):
    """(long usage per draw with labels, feature names)."""
    long = reports.prevalent(_families(s, d), "grp").join(q._ann(s, d).drop("source"), "sample_short")
    return long, multivariate.features(long, "grp")


@add("pca_usage")
def _pca(s, d):
    return multivariate.principal_components(_usage_rows(s, d)[0], ["sample_short", "iter"], "grp", "value", 2)


def _split(s, d):
    long, names = _usage_rows(s, d)
    wide = multivariate.matrix(long, ["sample_short", "iter", "cells", "genotype"], "grp", "value", names)
    return multivariate.holdout(wide, ["genotype", "cells"]), [f"f{i}" for i in range(len(names))], names


@add("lda_holdout")
def _lda(s, d):
    wide, columns, _ = _split(s, d)
    model = multivariate.discriminant(wide.where("NOT held_out"), "genotype", columns)
    return model.predict(wide.where("held_out")).select("sample_short", "iter", "genotype", "predicted")


@add("lda_contributions")
def _contributions(s, d):
    wide, columns, names = _split(s, d)
    model = multivariate.discriminant(wide.where("NOT held_out"), "genotype", columns)
    return multivariate.contributions(wide.where("held_out"), "genotype", model, names)


@add("lda_cv_worth")
def _worth(s, d):
    wide, columns, _ = _split(s, d)
    return multivariate.worth(multivariate.cross_validate(wide.where("NOT held_out"), "genotype", columns, 5), "genotype")


@add("glm_holdout")
def _glm(s, d):
    wide, columns, _ = _split(s, d)
    model = multivariate.classifier("glm", wide.where("NOT held_out"), "genotype", columns)
    return model.transform(wide.where("held_out")).select("sample_short", "iter", "genotype", "predicted")


@add("forest_holdout")
def _forest(s, d):
    wide, columns, _ = _split(s, d)
    model = multivariate.classifier("forest", wide.where("NOT held_out"), "genotype", columns)
    return model.transform(wide.where("held_out")).select("sample_short", "iter", "genotype", "predicted")


@add("lda_holdout_auc")
def _lda_auc(s, d):
    wide, columns, _ = _split(s, d)
    model = multivariate.discriminant(wide.where("NOT held_out"), "genotype", columns)
    p = model.probabilities()
    return multivariate.auc_pairs(wide.where("held_out").select("genotype", *p.values()), "genotype", {c: f"p_{c}" for c in p})


#: Planted scores: how often a sample's cells are of one family, a different one for each class.
_PLANTED = {"hoDQ2": "TCRBV01", "hoDQ8": "TCRBV02", "heDQ2DQ8": "TCRBV03"}
_AUC = """, sc AS (SELECT sample_short, any_value(genotype) AS genotype, {scores} FROM merged JOIN ann USING (sample_short) GROUP BY 1),
lg AS ({long})
SELECT a.class1, b.genotype AS class2, count(DISTINCT a.sample_short) AS n1, count(DISTINCT b.sample_short) AS n2, avg(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0.0 END::DOUBLE) AS auc
FROM lg a JOIN lg b ON a.class1 = b.class1 AND a.genotype = a.class1 AND b.genotype != a.class1 GROUP BY ALL""".format(
    scores=", ".join(f"round(sum(CASE WHEN vFamilyName = '{v}' THEN cnt ELSE 0 END) / sum(cnt), 3) AS {g}" for g, v in _PLANTED.items()),
    long=" UNION ALL ".join(f"SELECT sample_short, genotype, '{g}' AS class1, {g} AS v FROM sc" for g in _PLANTED))


def _planted(s, d):
    share = lambda v: F.round(F.sum(F.when(F.col("vFamilyName") == v, F.col("cnt")).otherwise(0)) / F.sum("cnt"), 3)
    return q._merged(s, d).groupBy("sample_short").agg(*[share(v).alias(g) for g, v in _PLANTED.items()]).join(q._ann(s, d).select("sample_short", "genotype"), "sample_short")


add("auc_pairs", _AUC, ("auc",))(lambda s, d: multivariate.auc_pairs(_planted(s, d), "genotype", {g: g for g in _PLANTED}))
add("roc_auc", _AUC.replace("SELECT a.class1", ", ap AS (SELECT a.class1") + ") SELECT avg(auc) AS roc_auc FROM ap", ("roc_auc",))(lambda s, d: multivariate.roc_auc(_planted(s, d), "genotype", {g: g for g in _PLANTED}))
_NZV = ["sequenceStatus", "vFamilyName", "jFamilyName", "cnt", "rare", "same"]
_RARE = "CASE WHEN nucleotide < '02' THEN 1 ELSE 0 END"
add("near_zero_variance", f""", w AS (SELECT *, {_RARE} AS rare, 'x' AS same FROM rep), lg AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, {c}::VARCHAR AS v FROM w WHERE {c} IS NOT NULL" for c in _NZV)}),
c AS (SELECT col, v, count(*) AS n FROM lg GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC) AS k FROM c),
g AS (SELECT col, count(*) AS "values", max(n) FILTER (k = 1) / max(n) FILTER (k = 2) AS ratio, count(*) * 100 / sum(n) AS percent_unique FROM r GROUP BY 1)
SELECT col AS "column", "values", ratio, percent_unique, "values" <= 1 AS constant, "values" <= 1 OR coalesce(ratio > 19 AND percent_unique <= 10, false) AS dropped FROM g""", ("ratio", "percent_unique"))(
    lambda s, d: multivariate.near_zero_variance(q._rep(s, d).withColumns({"rare": F.expr(_RARE), "same": F.lit("x")}), _NZV))
add("dummies", """SELECT sample_short, patient, cells, (genotype = 'hoDQ2')::INT AS "genotype_hoDQ2", (genotype = 'hoDQ8')::INT AS "genotype_hoDQ8" FROM ann""")(lambda s, d: multivariate.dummies(q._ann(s, d).drop("source"), "genotype"))
add("decimal_position", "SELECT DISTINCT IMGT_position, CASE WHEN regexp_matches(IMGT_position, '[A-Z]$') THEN left(IMGT_position, length(IMGT_position) - 1) || '.' || (ascii(right(IMGT_position, 1)) - 64) ELSE IMGT_position END AS plain FROM res")(
    lambda s, d: imgt.residues(q._merged(s, d)).select("IMGT_position", imgt.decimal_position().alias("plain")).distinct())
add("ttest_pooled_p")(lambda s, d: comparisons.with_t_p(q._pooled(s, d), ["cells", "tag"]))
add("ttest_paired_p")(lambda s, d: comparisons.with_t_p(comparisons.ttest_paired(q._positional(s, d), ["IMGT_position", "AA"]), ["stratum"]))
add("welch_p")(lambda s, d: comparisons.with_t_p(q._welch(s, d), ["cells", "tag"]))
add("wilcoxon_cells_p")(lambda s, d: comparisons.wilcoxon_test(q._usage(s, d).select("vFamilyName", F.col("cells").alias("grp"), F.col("c").alias("value")), ["vFamilyName"], ("E", "N")))
add("kruskal_genotype_p")(lambda s, d: comparisons.with_h_p(comparisons.kruskal(q._usage(s, d).select("vFamilyName", F.col("genotype").alias("grp"), F.col("c").alias("value")), ["vFamilyName"])))
add("ad_test")(lambda s, d: comparisons.ad_test(q._lengths(s, d), ["cells"]))
add("ad_test_all_cells")(lambda s, d: comparisons.ad_test(q._lengths(s, d).withColumn("cells", F.lit("all")), ["cells"], n_perm=200))


def _wide_props(s, d):
    rows = written(q._prop_test(s, d), "property-means")  # read by each of the tests
    props = sorted({prop for _, prop, _ in imgt.cruciani_values()})
    return rows.groupBy("sample_short", "genotype", "cells", "IMGT_position").pivot("prop", props).agg(F.first("mean_value"))


add("props_hotelling")(lambda s, d: comparisons.property_tables(_wide_props(s, d), ["cells", "IMGT_position"])[0])
add("props_collate")(lambda s, d: comparisons.property_tables(_wide_props(s, d), ["cells", "IMGT_position"])[1])

_PAIRS = """, tp(tag, genotype, side) AS (VALUES ('heDQ2DQ8-hoDQ2','heDQ2DQ8','a'), ('heDQ2DQ8-hoDQ2','hoDQ2','b'), ('heDQ2DQ8-hoDQ8','heDQ2DQ8','a'), ('heDQ2DQ8-hoDQ8','hoDQ8','b'), ('hoDQ2-hoDQ8','hoDQ2','a'), ('hoDQ2-hoDQ8','hoDQ8','b')),
ws AS (SELECT cells, len, tag, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b, avg(value) FILTER (side = 'a') AS mean_a, avg(value) FILTER (side = 'b') AS mean_b,
 var_samp(value) FILTER (side = 'a') AS va, var_samp(value) FILTER (side = 'b') AS vb FROM lf JOIN tp USING (genotype) GROUP BY ALL)
SELECT cells, len::INT AS len, tag, n_a, n_b, mean_a, mean_b, CASE WHEN n_a >= 2 AND n_b >= 2 AND va / n_a + vb / n_b > 0 THEN round((mean_a - mean_b) / sqrt(va / n_a + vb / n_b), 6) END AS t FROM ws"""
add("welch_all_pairs", q._LEN + _PAIRS, ("mean_a", "mean_b", "t"))(
    lambda s, d: comparisons.welch(q._lengths(s, d), ["cells", "len"], tags=comparisons.all_pairs(_GENOTYPES)).select("cells", "len", "tag", "n_a", "n_b", "mean_a", "mean_b", F.round("t", 6).alias("t")))
add("min_freq_lengths", q._LEN + " SELECT cells, len::INT AS len FROM lf GROUP BY ALL HAVING min(value) >= 0.01")(lambda s, d: reports.frequent_everywhere(q._lengths(s, d), ["cells", "len"]))
add("inner_positions", _TT + " SELECT cells, IMGT_position, AA, tag, n_a, n_b, mean_a, mean_b, cohen_d, t, n_a + n_b - 2 AS df FROM tt WHERE IMGT_position NOT IN (" + ", ".join(f"'{p}'" for p in reports.OUTER) + ") AND abs(cohen_d) > 0.8", ("mean_a", "mean_b", "cohen_d", "t"))(
    lambda s, d: reports.inner_positions(_plain(s, d), least_d=0.8))
add("annotated_pairs", q._DRAWN + """, m AS (SELECT sample1, sample2, comparison_type, avg(jaccard) AS mean_jaccard FROM w GROUP BY ALL)
SELECT m.*, a.genotype AS genotype1, a.patient AS patient1, b.genotype AS genotype2, b.patient AS patient2, least(a.genotype, b.genotype) || '-' || greatest(a.genotype, b.genotype) AS genotype_comp FROM m LEFT JOIN ann a ON sample1 = a.sample_short LEFT JOIN ann b ON sample2 = b.sample_short""", ("mean_jaccard",))(
    lambda s, d: reports.annotated_pairs(overlap.overlap_mean(overlap.overlap_draws(q._sub(s, d))).drop("median_jaccard"), q._ann(s, d), ["genotype", "patient"], "genotype"))
add("logo_matrix", _TT + """, pm AS (SELECT tag, IMGT_position, AA, avg(mean_a) AS a, avg(mean_b) AS b FROM tt GROUP BY ALL), lg AS (SELECT tag, IMGT_position, AA, 'a' AS side, a AS freq FROM pm UNION ALL SELECT tag, IMGT_position, AA, 'b', b FROM pm)
SELECT tag, IMGT_position, AA, side, freq / sum(freq) OVER (PARTITION BY tag, IMGT_position, side) AS freq FROM lg WHERE freq >= 0.01""", ("freq",))(lambda s, d: reports.position_matrix(_plain(s, d), ["tag"], 0.01))
_ORDER = imgt.position_order()
add("imgt_order", "SELECT DISTINCT IMGT_position, CASE IMGT_position " + " ".join(f"WHEN '{p}' THEN {k}" for p, k in _ORDER.items()) + " END AS ord FROM res")(lambda s, d: imgt.with_order(imgt.residues(q._merged(s, d)).select("IMGT_position").distinct()))
_AGAIN = _TT + """, hi AS (SELECT DISTINCT cells, IMGT_position, AA FROM tt WHERE tag = 'oo' AND abs(t) >= 1.5), av AS (SELECT tr.* REPLACE (round(value, 9) AS value) FROM tr SEMI JOIN hi USING (cells, IMGT_position, AA) WHERE genotype IN ('hoDQ2', 'hoDQ8')),
ar AS (SELECT *, rank() OVER (PARTITION BY cells, IMGT_position, AA ORDER BY value) + (count(*) OVER (PARTITION BY cells, IMGT_position, AA, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY cells, IMGT_position, AA, value) AS ties FROM av),
ag AS (SELECT cells, IMGT_position, AA, count(*) FILTER (genotype = 'hoDQ2') AS n1, count(*) FILTER (genotype = 'hoDQ8') AS n2, sum(r) FILTER (genotype = 'hoDQ2') AS r1, sum(ties * ties - 1) AS tie, count(*)::DOUBLE AS n FROM ar GROUP BY ALL)
SELECT cells, IMGT_position, AA, n1, n2, r1 - n1 * (n1 + 1) / 2 AS U, (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / nullif(sqrt(n1 * n2 / 12 * (n + 1 - tie / (n * (n - 1)))), 0) AS z FROM ag WHERE n1 > 0 AND n2 > 0"""


def _again(s, d):
    stats = _plain(s, d)
    rows = reports.values_of_significant(q._positional(s, d), stats, INDEX, (F.col("tag") == "oo") & (F.abs("t") >= 1.5))
    return rows.select(*INDEX, F.col("genotype").alias("grp"), F.round("value", 9).alias("value"))


add("signif_values", _AGAIN, ("U", "z"))(lambda s, d: comparisons.wilcoxon(_again(s, d), INDEX, ("hoDQ2", "hoDQ8")))
add("signif_values_p")(lambda s, d: comparisons.wilcoxon_test(_again(s, d), INDEX, ("hoDQ2", "hoDQ8")))
add("p_adjust")(lambda s, d: adjusted(_plain(s, d).transform(comparisons.with_t_p), "p_value", ["cells", "tag"], "bonferroni", 3))
