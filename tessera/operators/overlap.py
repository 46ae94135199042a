"""Overlap and sharing of clonotypes between samples, groups and draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.clean import KEY
from tessera.operators.cooccurrence import together
from tessera.sources.staging import written


def overlap(counts: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Every pair of samples A < B with shared and own clonotypes, their counts and Jaccard index.

    Shared clonotypes and counts are cells of a product in parts (``cooccurrence``), own ones its diagonal; the pairs, those that
    share nothing included, come from the list of samples, a table of sequencing runs.
    """
    key = key or KEY
    rows = counts.groupBy("sample_short", *key).agg(F.sum("cnt").alias("cnt")).where("cnt > 0")
    cells = written(together(rows, key, "sample_short", "cnt"), "overlap")
    first = F.col("a") < F.col("b")
    both = cells.where("a != b").groupBy(F.least("a", "b").alias("A"), F.greatest("a", "b").alias("B")).agg(F.max("n").alias("unique_AB"), F.sum(F.when(first, F.col("x"))).alias("AB_countA"), F.sum(F.when(~first, F.col("x"))).alias("AB_countB"))
    own = cells.where("a = b")
    a = own.select(F.col("a").alias("A"), F.col("n").alias("unique_A"), F.col("x").alias("count_A"))
    b = own.select(F.col("a").alias("B"), F.col("n").alias("unique_B"), F.col("x").alias("count_B"))
    pairs = a.join(b, F.col("A") < F.col("B")).join(both, ["A", "B"], "left").na.fill(0, ["unique_AB", "AB_countA", "AB_countB"])
    union = F.col("unique_A") + F.col("unique_B") - F.col("unique_AB")
    return pairs.select("A", "B", "unique_AB", "unique_A", "unique_B", "AB_countA", "AB_countB", "count_A", "count_B", F.coalesce(F.try_divide("unique_AB", union), F.lit(0.0)).alias("jaccard_index"), F.concat(F.left("A", F.lit(4)), F.lit("_"), F.left("B", F.lit(4))).alias("short_id"))


def _label() -> Column:
    """A draw (s, iter) as one label."""
    return F.concat(F.col("iter"), F.lit(":"), F.col("s")).alias("draw")


def _parts(label: str, i: int | str) -> list[Column]:
    """s and iter of a label."""
    return [F.substr(label, F.instr(label, ":") + 1).alias(f"s{i}"), F.substring_index(label, ":", 1).cast("int").alias(f"iter{i}")]


def overlap_draws(draws: DataFrame) -> DataFrame:
    """Jaccard index of every pair of draws within E, within N and between E and N of one patient."""
    rows = draws.where("iter > 0 AND n > 0").select(F.col("sample_short").alias("s"), "iter", F.to_json(F.array(*[F.upper(F.trim(k)) for k in KEY])).alias("k")).distinct()
    cells, patient = (lambda i: F.right(f"s{i}", F.lit(1))), (lambda i: F.left(f"s{i}", F.lit(4)))
    wanted = ((cells(1) == cells(2)) & (F.col("s1") < F.col("s2"))) | ((cells(1) == "E") & (cells(2) == "N") & (patient(1) == patient(2)))
    # a label begins with the draw, so that samples are compared by what follows its colon
    near = (F.right("a", F.lit(1)) == F.right("b", F.lit(1))) | (F.substr("a", F.instr("a", ":") + 1, F.lit(4)) == F.substr("b", F.instr("b", ":") + 1, F.lit(4)))
    met = written(together(rows.select("k", _label()), ["k"], "draw", wanted=near), "draws")
    own = met.where("a = b").select("a", F.col("n").alias("u"))
    side = lambda i: own.select(*_parts("a", i), F.col("u").alias(f"u{i}"), F.col("a").alias(f"d{i}"))
    # each draw stands in the classes that it can be compared in: its cells, and its patient; the join is on them, so that no other pair is made
    classed = lambda df, i: df.withColumn("c", F.explode(F.array(F.concat(F.lit("within_"), cells(i)), F.concat(F.lit("E_vs_N "), patient(i)))))
    kind = F.regexp_extract("c", "^[^ ]+", 0)
    pairs = classed(side(1), 1).join(classed(side(2), 2), "c").where(wanted & (F.col("c").startswith("within_") == (cells(1) == cells(2)))).withColumn("comparison_type", kind)
    out = pairs.join(met.select(F.col("a").alias("d1"), F.col("b").alias("d2"), F.col("n").alias("unique_overlap")), ["d1", "d2"], "left").na.fill(0, ["unique_overlap"])
    jaccard = F.col("unique_overlap") / (F.col("u1") + F.col("u2") - F.col("unique_overlap"))
    return out.select(F.col("s1").alias("sample1"), F.col("iter1").alias("subsample1"), F.col("s2").alias("sample2"), F.col("iter2").alias("subsample2"), "unique_overlap", F.col("u1").alias("unique1"), F.col("u2").alias("unique2"), jaccard.alias("jaccard"), "comparison_type", F.lit("_".join(k[:4].upper() for k in KEY)).alias("short_id"))


def overlap_mean(draw_pairs: DataFrame) -> DataFrame:
    return draw_pairs.groupBy("sample1", "sample2", "comparison_type").agg(F.avg("jaccard").alias("mean_jaccard"), F.median("jaccard").alias("median_jaccard"))


def publicity(draws: DataFrame, groups: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, grp, k, n_shared): samples of the group whose k-th draw has the clonotype; zeros implicit."""
    key = key or KEY
    seen = draws.where("iter > 0 AND n > 0").select(*key, "sample_short", "iter").distinct()
    return seen.join(groups, "sample_short").groupBy(*key, "grp", F.col("iter").alias("k")).agg(F.count("*").alias("n_shared"))


def packed_draws(draws: DataFrame, rounds: int, key: list[str] | None = None) -> DataFrame:
    """(sample_short, key, rounds): the rounds that drew the clonotype, as bits (round k is bit k - 1, low bits first), of drawn counts of up to ``rounds`` rounds."""
    key = key or KEY
    lists = draws.where(F.col("iter").between(1, rounds) & (F.col("n") > 0)).groupBy("sample_short", *key).agg(F.collect_set("iter").alias("rounds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            bits = np.zeros((batch.num_rows, rounds), np.uint8)
            bits[np.repeat(np.arange(batch.num_rows), np.array(lists.value_lengths())), np.array(lists.flatten()) - 1] = 1
            packed = pa.array([r.tobytes() for r in np.packbits(bits, axis=1, bitorder="little")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=batch.schema.names)

    kinds = dict(lists.dtypes)
    return lists.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in ("sample_short", *key)] + ["rounds binary"]))


def packed_publicity(packed: DataFrame, groups: DataFrame, rounds: int, key: list[str] | None = None) -> DataFrame:
    """(key, grp, shared): samples of the group that have the clonotype in each round, as one array of ``rounds`` numbers.

    ``packed``: (sample_short, key, rounds as bits), a row for a sample and clonotype; a clonotype's rows in a group, no more than
    its samples, are sorted together and added up in a stream.
    """
    key = key or KEY
    by = [*key, "grp"]
    rows = packed.join(groups.select("sample_short", "grp"), "sample_short").select(*by, "rounds").repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None  # the last group of the rows so far

        def out(columns: list, sums: np.ndarray) -> pa.RecordBatch:
            ends = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * rounds)
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(sums.astype(np.int32).ravel()))], names=[*by, "shared"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in by:
                code = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            start = np.flatnonzero(new)
            width = -(-rounds // 8)
            bits = np.frombuffer(b"".join(batch.column("rounds").to_pylist()), np.uint8).reshape(-1, width)
            sums = np.add.reduceat(np.unpackbits(bits, axis=1, bitorder="little")[:, :rounds].astype(np.int32), start, axis=0)
            named = batch.select(by).take(pa.array(start))
            first, last = (tuple(named.column(c)[i].as_py() for c in by) for i in (0, len(start) - 1))
            if held is not None and held == first:
                sums[0] += total
            elif held is not None:
                yield out([pa.array([v], batch.schema.field(c).type) for v, c in zip(held, by)], total[None])
            if len(start) > 1:
                yield out([c.slice(0, len(start) - 1) for c in named.columns], sums[:-1])
            held, total, kinds = last, sums[-1], batch.schema
        if held is not None:
            yield out([pa.array([v], kinds.field(c).type) for v, c in zip(held, by)], total[None])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in by] + ["shared array<int>"]))


def unpacked(shared: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``packed_publicity`` as rows (key, grp, k, n_shared), zeros left out."""
    key = key or KEY
    return shared.select(*key, "grp", F.posexplode("shared").alias("k", "n")).where("n > 0").select(*key, "grp", (F.col("k") + 1).alias("k"), F.col("n").cast("long").alias("n_shared"))


def packed_sharing(shared: DataFrame, least: int = 2, key: list[str] | None = None) -> DataFrame:
    """(key, grp, N, rounds): rounds in which at least N samples share the clonotype, from N = ``least``; one pass over ``packed_publicity``."""
    key = key or KEY
    if least < 2:
        raise ValueError("least must be 2 or more")
    rows = shared.withColumn("most", F.array_max("shared")).where(F.col("most") >= least)
    rows = rows.select(*key, "grp", "shared", F.explode(F.sequence(F.lit(least).cast("long"), F.col("most").cast("long"))).alias("N"))
    return rows.select(*key, "grp", "N", F.size(F.filter("shared", lambda n: n >= F.col("N"))).cast("long").alias("rounds"))


def sharing_at_least(shared: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, grp, N, rounds): rounds in which at least N samples share the clonotype, N from 2."""
    key = key or KEY
    return shared.where("n_shared >= 2").select(*key, "grp", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n_shared"))).alias("N")).groupBy(*key, "grp", "N").agg(F.count("*").alias("rounds"))


def sharing_summary(shared: DataFrame, least: int = 2, key: list[str] | None = None) -> DataFrame:
    """The same for clonotypes public (some round with ``least`` samples or more) in any group, from N = least."""
    key = key or KEY
    if least < 2:
        raise ValueError("least must be 2 or more")
    public = shared.where(F.col("n_shared") >= least).select(*key).distinct()
    rows = sharing_at_least(shared, key).where(F.col("N") >= least)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in key]
    return rows.alias("r").join(public.alias("p"), same, "left_semi")


def declared_pairs(groups: DataFrame, within: list[str] | None = None, between: list[tuple[str, str]] | None = None) -> DataFrame:
    """(type_of_sharing, grps, sample_a, sample_b): every pair of samples that a comparison declares.

    ``groups``: grp, sample_short and, for pairs in that order, place; else by name. ``within``: groups whose samples are compared
    with each other, all by default; ``between``: pairs of groups, by default all once in the order of names, where neither list is
    given. An unknown group is an error; a sample in both groups is not compared with itself.
    """
    rows = groups.select("grp", "sample_short", (F.col("place") if "place" in groups.columns else F.col("sample_short")).alias("place")).distinct()
    if within is None and between is None:
        named = rows.select("grp").distinct()
        plan = named.select(F.lit("within").alias("type_of_sharing"), F.col("grp").alias("ga"), F.col("grp").alias("gb"))
        plan = plan.union(named.select(F.col("grp").alias("ga")).join(named.select(F.col("grp").alias("gb")), F.col("ga") < F.col("gb")).select(F.lit("between"), "ga", "gb"))
    else:
        asked = [("within", g, g) for g in within or []] + [("between", a, b) for a, b in between or []]
        unknown = {g for _, *names in asked for g in names} - {r[0] for r in rows.select("grp").distinct().collect()}
        if unknown or not asked:
            raise ValueError(f"unknown groups: {', '.join(sorted(unknown))}" if asked else "no comparison is declared")
        plan = groups.sparkSession.createDataFrame(asked, "type_of_sharing string, ga string, gb string")
    side = lambda i: rows.select(F.col("grp").alias(f"g{i}"), F.col("sample_short").alias(f"sample_{i}"), F.col("place").alias(f"p{i}"))
    inside = F.col("type_of_sharing") == "within"
    pairs = plan.join(side("a"), "ga").join(side("b"), "gb").where((inside & (F.col("pa") < F.col("pb"))) | (~inside & (F.col("sample_a") != F.col("sample_b"))))
    return pairs.select("type_of_sharing", F.when(inside, F.col("ga")).otherwise(F.concat_ws("_", "ga", "gb")).alias("grps"), "sample_a", "sample_b")


def pairwise(draws: DataFrame, pairs: DataFrame, rounds: int, key: list[str] | None = None) -> DataFrame:
    """``pairs`` (``declared_pairs``) with sharing_by, k from 1 to ``rounds`` and shared: clonotypes that both samples' k-th draws have, zeros included."""
    key = key or KEY
    seen = draws.where("iter > 0 AND n > 0").select(*key, "iter", F.col("sample_short").alias("s")).distinct()
    met = together(seen.select(*key, "iter", _label()), [*key, "iter"], "draw", wanted=F.col("a") != F.col("b"))
    met = met.select(*_parts("a", "_a"), *_parts("b", "_b"), F.col("n").alias("shared")).select(F.col("s_a").alias("sample_a"), F.col("s_b").alias("sample_b"), F.col("iter_a").alias("k"), "shared")
    asked = pairs.select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("k"))
    return asked.join(met, ["sample_a", "sample_b", "k"], "left").select("type_of_sharing", "grps", F.lit("_".join(key)).alias("sharing_by"), "sample_a", "sample_b", "k", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))
