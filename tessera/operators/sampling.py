"""Weighted sampling with replacement, reproducible under any partitioning.

``subsample`` draws in numpy: how many of a sample's draws fall in each of its parts (clonotypes dealt by hash) first, then within
each part, so that no task holds a whole sample; ``draw_rounds`` keeps of the same draws only which rounds have a clonotype. ``subsample_hashed`` draws by md5 in plain DataFrame functions, which any SQL engine
repeats exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.clean import KEY
from tessera.sources.staging import written


def _rng(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5("|".join(map(str, parts)).encode()).digest()[:8], "big"))


#: Clonotypes of a sample's part, about, for draws in numpy; slices of its cumulated counts and letters of the leading key, for hashed ones.
PART_ROWS, SLICES, LETTERS = 100_000, 16, 6
#: Stretches and draws of a slice, about, beyond which a sample has more slices.
SLICE_ROWS = 100_000


def _draws(weight: np.ndarray) -> Callable[[np.random.Generator, int], tuple[np.ndarray, np.ndarray]]:
    """What makes ``share`` draws by weight: (places, how often each); a place may come several times.

    Up to as many draws as places are made one by one; more are made place by place, as counts of the same distribution, so that
    a draw's depth costs nothing. Light places come first there, as what is left of the weight for the last ones is a difference.
    """
    upto, light = np.cumsum(weight), np.argsort(weight, kind="stable")

    def draw(rng: np.random.Generator, share: int) -> tuple[np.ndarray, np.ndarray]:
        if share > len(weight):
            n = rng.multinomial(share, weight[light] / weight.sum())
            return light[n > 0], n[n > 0]
        return np.minimum(np.searchsorted(upto, rng.random(share) * upto[-1], side="right"), len(upto) - 1), np.ones(share, np.int64)

    return draw


def _dealt(counts: DataFrame, iterations: int, seed: int, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """The counts by part of a sample, and for each part its share of every draw (plan: depth, shares by iteration)."""
    some = written(counts.where("cnt > 0"), "counts")
    parts = some.groupBy("sample_short").agg(F.ceil(F.count("*") / part_rows).alias("parts"))
    rows = some.join(parts, "sample_short").withColumn("part", F.pmod(F.xxhash64(*KEY), F.col("parts")).cast("int"))
    depths = F.array_sort(F.array_distinct(F.first("depths")))
    totals = rows.groupBy("sample_short", "part").agg(F.sum("cnt").alias("size"), depths.alias("depths"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("part"), []
        p = pdf["size"].to_numpy(float) / pdf["size"].sum()
        for depth in pdf["depths"].iloc[0]:
            n = [_rng(seed, pdf["sample_short"].iloc[0], depth, i).multinomial(depth, p) for i in range(1, iterations + 1)]
            out += [(pdf["sample_short"].iloc[0], part, depth, list(row)) for part, row in zip(pdf["part"], np.array(n).T.reshape(len(pdf), -1))]
        return pd.DataFrame(out, columns=["sample_short", "part", "depth", "shares"])

    dealt = totals.groupBy("sample_short").applyInPandas(deal, "sample_short string, part int, depth long, shares array<long>")
    dealt = dealt.groupBy("sample_short", "part").agg(F.sort_array(F.collect_list(F.struct("depth", "shares"))).alias("plan"))
    return rows.select("sample_short", "part", *KEY, "cnt"), dealt


def draw_rounds(counts: DataFrame, depth: int, rounds: int, seed: int = 42, part_rows: int = PART_ROWS) -> DataFrame:
    """(sample_short, key, rounds): the rounds of ``subsample`` that drew the clonotype, as bits (round k is bit k - 1, low bits first); others are left out.

    One row for a sample and clonotype, whatever the number of rounds, and no row for a draw.
    """
    rows, dealt = _dealt(counts.withColumn("depths", F.array(F.lit(depth).cast("long"))), rounds, seed, part_rows)

    def draw(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.sort_by([(c, "ascending") for c in KEY])
        bits = np.zeros((left.num_rows, -(-rounds // 8)), np.uint8)
        if left.num_rows and right.num_rows:
            name, part = (k.as_py() for k in key)
            draws = _draws(rows.column("cnt").to_numpy().astype(float))
            for step in right.column("plan")[0].as_py():
                for i, share in enumerate(step["shares"], 1):
                    hit, _ = draws(_rng(seed, name, part, step["depth"], i), share)
                    column = bits[:, (i - 1) >> 3]
                    column[hit] |= np.uint8(1 << (i - 1 & 7))
        some = np.flatnonzero(bits.any(axis=1))
        packed = pa.array([r.tobytes() for r in bits[some]], pa.binary())
        return rows.select(["sample_short", *KEY]).take(pa.array(some)).append_column("rounds", packed)

    by = ["sample_short", "part"]
    return rows.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(draw, "sample_short string, aminoAcid string, vFamilyName string, jGeneName string, rounds binary")


def draw_counts(counts: DataFrame, iterations: int, seed: int = 42, part_rows: int = PART_ROWS) -> DataFrame:
    """(sample_short, key, depth, iter, n) at each of the depths in column ``depths``; drawn zeros are implicit."""
    rows, dealt = _dealt(counts, iterations, seed, part_rows)

    def draw(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, out = left.sort_values(KEY, na_position="last", ignore_index=True), []
        if len(rows) and len(right):
            draws = _draws(rows["cnt"].to_numpy(float))
            for step in right["plan"].iloc[0]:
                for i, share in enumerate(step["shares"], 1):
                    places, times = draws(_rng(seed, *key, step["depth"], i), share)
                    n = np.zeros(len(rows), np.int64)
                    np.add.at(n, places, times)
                    out.append(rows[n > 0].assign(depth=step["depth"], iter=i, n=n[n > 0]))
        columns = ["sample_short", *KEY, "depth", "iter", "n"]
        return pd.concat(out)[columns] if out else pd.DataFrame({c: [] for c in columns})

    schema = "sample_short string, aminoAcid string, vFamilyName string, jGeneName string, depth long, iter int, n long"
    by = ["sample_short", "part"]
    return rows.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(draw, schema)


def subsample(counts: DataFrame, depth: int, iterations: int, seed: int = 42) -> DataFrame:
    """(sample_short, key, iter, n): iteration 0 is the original; drawn zeros are implicit."""
    columns = ["sample_short", *KEY, "iter", "n"]
    drawn = draw_counts(counts.withColumn("depths", F.array(F.lit(depth).cast("long"))), iterations, seed)
    own = counts.where("cnt > 0").select("sample_short", *KEY, F.lit(0).alias("iter"), F.col("cnt").cast("long").alias("n"))
    return own.union(drawn.select(*columns))


def cumulated(counts: DataFrame) -> DataFrame:
    """Rows with their stretch [lo, hi) of the sample's cumulated counts in the order of the key, and the sample's total and number of rows.

    Sums run within the key's first letters and over the sums of those, so that a sample is not one task's.
    """
    rows = written(counts.where("cnt > 0").select("sample_short", *KEY, "cnt"), "counts").select("*", F.substring(KEY[0], 1, LETTERS).alias("block"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy("sample_short", "block").agg(F.sum("cnt").alias("size"), F.count("*").alias("rows"))
    whole = Window.partitionBy("sample_short")
    blocks = blocks.select("sample_short", "block", (F.sum("size").over(upto(whole.orderBy("block"))) - F.col("size")).alias("before"), F.sum("size").over(whole).alias("total"), F.sum("rows").over(whole).alias("rows"))
    inner = F.sum("cnt").over(upto(Window.partitionBy("sample_short", "block").orderBy(*KEY)))
    same = (F.col("r.sample_short") == F.col("b.sample_short")) & F.col("r.block").eqNullSafe(F.col("b.block"))
    out = rows.withColumn("hi", inner).alias("r").join(blocks.alias("b"), same)
    high = F.col("before") + F.col("hi")
    return out.select("r.sample_short", *KEY, "cnt", high.alias("hi"), (high - F.col("cnt")).alias("lo"), "total", "rows")


def subsample_hashed(counts: DataFrame, depth: int, iterations: int, seed: int = 42) -> DataFrame:
    """As ``subsample``, each draw the clonotype whose stretch of the cumulated counts holds a hashed uniform number.

    Stretches and draws are sorted together, slice by slice of the cumulated counts, and each draw takes the last stretch that
    starts before it: no draw is compared with more than that. A sample has a slice for ``SLICE_ROWS`` of its stretches and draws,
    and at least ``SLICES``; how many there are changes no draw.
    """
    stretch = written(cumulated(counts), "stretches")
    total = stretch.groupBy("sample_short").agg(F.max("total").alias("total"), F.max("rows").alias("rows"))
    draws = total.select("sample_short", "total", "rows", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iter")).select("*", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("j"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "sample_short", "iter", "j")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    slice_of = lambda at: F.expr(f"({at}) * greatest({SLICES}, (rows + {depth * iterations}) div {SLICE_ROWS}) div total")
    draws = draws.select("sample_short", "iter", F.floor(u * F.col("total")).cast("long").alias("at"), "total", "rows").withColumn("slice", slice_of("at"))
    starts = stretch.select("sample_short", F.struct(*KEY).alias("own"), F.col("lo").alias("at"), F.explode(F.sequence(slice_of("lo"), slice_of("hi - 1"))).alias("slice"))
    none = F.lit(None).cast(starts.schema["own"].dataType)
    rows = starts.select("sample_short", "slice", "at", F.lit(0).alias("iter"), "own").union(draws.select("sample_short", "slice", "at", "iter", none.alias("own")))
    last = F.last("own", True).over(Window.partitionBy("sample_short", "slice").orderBy("at", "iter").rowsBetween(Window.unboundedPreceding, 0))
    hit = rows.select("sample_short", "iter", last.alias("own")).where("iter > 0").select("sample_short", "own.*", "iter")
    drawn = hit.groupBy("sample_short", *KEY, "iter").agg(F.count("*").alias("n"))
    return stretch.select("sample_short", *KEY, F.lit(0).alias("iter"), F.col("cnt").alias("n")).union(drawn)
