"""Usage matrices: principal components, linear discriminants, holdouts and folds, worth of predictions.

Features are genes or families, so a matrix has some hundred columns at most; units are rows without bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_FEATURES = 1000


def features(long: DataFrame, feature: str) -> list[str]:
    """Sorted names of the features; more than ``MOST_FEATURES`` are an error."""
    names = [r[0] for r in long.where(F.col(feature).isNotNull()).select(feature).distinct().limit(MOST_FEATURES + 1).collect()]
    if len(names) > MOST_FEATURES:
        raise ValueError(f"{feature} has more than {MOST_FEATURES} levels")
    return sorted(names)


def matrix(long: DataFrame, unit: list[str], feature: str, value: str, names: list[str]) -> DataFrame:
    """A row per unit; column ``f<i>`` has its value of the i-th name, 0 where it has none."""
    if not names:
        return long.select(*unit).distinct()
    cell = lambda n: F.coalesce(F.sum(F.when(F.col(feature) == n, F.col(value).cast("double"))), F.lit(0.0))
    return long.groupBy(*unit).agg(*[cell(n).alias(f"f{i}") for i, n in enumerate(names)])


def principal_components(long: DataFrame, unit: list[str], feature: str, value: str, k: int | None = None, share: float = 1.0) -> DataFrame:
    """(unit, component, score, explained) of the centred and scaled matrix.

    Constant features drop out; components stop at ``k``, or where they explain ``share`` of the variance. A component's
    largest loading is positive. No rows where nothing varies.
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = features(long, feature)
    wide = matrix(long, unit, feature, value, names)
    spread = wide.agg(*[F.stddev_samp(f"f{i}") for i in range(len(names))]).first() if names else []
    used = [f"f{i}" for i, s in enumerate(spread) if s is not None and s > 1e-12]
    if not used:
        return wide.select(*unit, F.lit(0).alias("component"), F.lit(0.0).alias("score"), F.lit(0.0).alias("explained")).limit(0)
    raw = VectorAssembler(inputCols=used, outputCol="raw").transform(wide)
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(raw).transform(raw)
    model = PCA(k=len(used), inputCol="scaled", outputCol="pc").fit(scaled)
    explained, loadings = model.explainedVariance.toArray(), model.pc.toArray()
    enough = int(np.searchsorted(np.cumsum(explained), share - 1e-12)) + 1
    sign = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(len(used))])
    kept = range(min(k or enough, len(used)))
    scores = F.inline(F.array(*[F.struct(F.lit(j + 1).alias("component"), (F.element_at("s", j + 1) * float(sign[j])).alias("score"), F.lit(float(explained[j])).alias("explained")) for j in kept]))
    return model.transform(scaled).select(*unit, vector_to_array("pc").alias("s")).select(*unit, scores)


@dataclass(frozen=True)
class Discriminant:
    """Linear scores of each class over ``columns``, and the axes that part the classes, best first."""

    classes: list[str]
    columns: list[str]
    weights: np.ndarray
    offsets: np.ndarray
    axes: np.ndarray

    def _scores(self) -> list[Column]:
        score = lambda w, b: sum((F.col(c) * float(v) for c, v in zip(self.columns, w)), F.lit(float(b)))
        return [score(w, b) for w, b in zip(self.weights, self.offsets)]

    def probabilities(self, prefix: str = "p_") -> dict[str, Column]:
        """Class -> column of its posterior probability (named by ``prefix`` and the class), the classes sharing one covariance."""
        scores = self._scores()
        best = F.greatest(*scores)
        parts = [F.exp(s - best) for s in scores]
        return {c: (p / sum(parts[1:], parts[0])).alias(f"{prefix}{c}") for c, p in zip(self.classes, parts)}

    def predicted(self) -> Column:
        """The class with the highest score; of equal scores the last by name."""
        ranked = [F.struct(score.alias("s"), F.lit(c).alias("c")) for c, score in zip(self.classes, self._scores())]
        best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0]
        return best["c"]

    def predict(self, wide: DataFrame, into: str = "predicted") -> DataFrame:
        return wide.withColumn(into, self.predicted())


def _class_moments(wide: DataFrame, label: str, columns: list[str]) -> dict[str, np.ndarray]:
    """Per class the sums of products of (1, features): partial sums in the tasks, then one small aggregation."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, part in pdf.groupby("label"):
                x = np.column_stack([np.ones(len(part)), part[columns].to_numpy(float)])
                sums[name] = sums.get(name, 0) + x.T @ x
        yield pd.DataFrame({"label": list(sums), "m": [m.ravel().tolist() for m in sums.values()]})

    rows = wide.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), *columns)
    total = rows.mapInPandas(run, "label string, m array<double>").select("label", F.posexplode("m").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    flat: dict[str, np.ndarray] = {}
    size = len(columns) + 1
    for r in total.collect():
        flat.setdefault(r["label"], np.zeros(size * size))[r["at"]] = r["v"]
    return {c: flat[c].reshape(size, size) for c in sorted(flat)}


def discriminant(wide: DataFrame, label: str, columns: list[str]) -> Discriminant:
    """Fitted with the classes' shares as priors; directions without variance (shares sum to 1) carry no weight."""
    return _fitted(_class_moments(wide, label, columns), columns)


def _fitted(moments: dict[str, np.ndarray], columns: list[str]) -> Discriminant:
    if len(moments) < 2:
        raise ValueError("a discriminant needs two classes")
    n = np.array([m[0, 0] for m in moments.values()])
    mean = np.array([m[0, 1:] / m[0, 0] for m in moments.values()])
    within = sum(m[1:, 1:] - m[0, 0] * np.outer(u, u) for m, u in zip(moments.values(), mean)) / max(n.sum() - len(n), 1)
    values, vectors = np.linalg.eigh(within)
    varies = values > 1e-8 * max(values.max(), 1e-300)
    whiten = vectors[:, varies] / np.sqrt(values[varies])
    weights = mean @ whiten @ whiten.T
    offsets = np.log(n / n.sum()) - (weights * mean).sum(1) / 2
    apart = (mean - n @ mean / n.sum()) @ whiten
    order, turn = np.linalg.eigh((apart.T * n) @ apart)
    axes = (whiten @ turn[:, np.argsort(-order)[: len(n) - 1]]).T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return Discriminant(list(moments), columns, weights, offsets, axes)


def classifier(kind: str, wide: DataFrame, label: str, columns: list[str], seed: int = 42):
    """A fitted Spark ML pipeline (glm, forest or boosted) that adds ``predicted``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(wide)
    named = {"featuresCol": "_x", "labelCol": "_y", "predictionCol": "_p"}
    model = {"glm": lambda: LogisticRegression(family="multinomial", **named), "forest": lambda: RandomForestClassifier(seed=seed, **named), "boosted": lambda: OneVsRest(classifier=GBTClassifier(seed=seed, **named), **named)}[kind]()
    back = IndexToString(inputCol="_p", outputCol="predicted", labels=index.labels)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), index, model, back]).fit(wide)


def holdout(units: DataFrame, strata: list[str], unit: str = "sample_short", share: float = 0.2) -> DataFrame:
    """``units`` with ``held_out``: of each stratum the first floor(share n) distinct units by md5. Rows of a unit stay together."""
    by = Window.partitionBy(*strata)
    one = units.select(*strata, unit).distinct()
    rank = F.row_number().over(by.orderBy(F.md5(F.col(unit)), unit))
    picked = one.select(unit, (rank <= F.floor(F.count("*").over(by) * share)).alias("held_out")).groupBy(unit).agg(F.max("held_out").alias("held_out"))
    return units.join(picked, unit, "left")


def folds(units: DataFrame, strata: list[str], k: int, unit: str = "sample_short") -> DataFrame:
    """``units`` with ``fold`` from 0 to k - 1, dealt in turn within each stratum by md5."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(F.col(unit)), unit))
    dealt = units.select(*strata, unit).distinct().select(unit, ((rank - 1) % k).alias("fold")).groupBy(unit).agg(F.min("fold").alias("fold"))
    return units.join(dealt, unit, "left")


def cross_validate(wide: DataFrame, label: str, columns: list[str], k: int = 10, unit: str = "sample_short") -> DataFrame:
    """Every row with the class that the discriminant of the other folds predicts.

    The sums of products of each fold come from one pass and add up to those of any choice of folds.
    """
    dealt = folds(wide, [label], k, unit)
    parts = _class_moments(dealt.where(F.col(label).isNotNull()).withColumn("_part", F.concat_ws("|", "fold", label)), "_part", columns)
    guess = F.lit(None).cast("string")
    for i in {p.split("|", 1)[0] for p in parts}:
        rest: dict[str, np.ndarray] = {}
        for part, m in parts.items():
            fold, name = part.split("|", 1)
            if fold != i:
                rest[name] = rest.get(name, 0) + m
        guess = F.when(F.col("fold") == int(i), _fitted(rest, columns).predicted()).otherwise(guess)
    return dealt.withColumn("predicted", guess)


def worth(predictions: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    """accuracy, mean precision and F over the classes, and Matthews' coefficient; null where undefined."""
    cells = predictions.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    ys = cells.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    ps = cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("g"))
    c = ys.join(ps, "c", "full").na.fill(0, ["t", "hit", "g"])
    s = c.agg(
        F.sum("t").alias("n"), F.sum("hit").alias("hits"), F.sum(F.col("t") * F.col("g")).alias("tg"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("g") * F.col("g")).alias("gg"),
        F.avg(F.try_divide("hit", "g")).alias("precision"), F.avg(F.try_divide(2 * F.col("hit"), F.col("t") + F.col("g"))).alias("f"),
    )
    square = F.col("n").cast("double") * F.col("n")
    mcc = F.try_divide(F.col("hits").cast("double") * F.col("n") - F.col("tg"), F.sqrt((square - F.col("tt")) * (square - F.col("gg"))))
    return s.select((F.col("hits") / F.nullif(F.col("n"), F.lit(0))).alias("accuracy"), "precision", "f", mcc.alias("mcc"))


def auc_pairs(rows: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """(class1, class2, n1, n2, auc): how often a row of class1 scores higher for class1 (column ``scores[class1]``) than one of class2, ties half.

    Rows of other classes, and rows with a null label or score, take no part. Equal scores are counted together first, and ranks run
    over the different scores of a pair of classes.
    """
    names = list(scores)
    mine = [F.struct(F.lit(a).alias("class1"), F.lit(b).alias("class2"), F.col(scores[a]).cast("double").alias("v"), (F.col(label) == a).alias("hit"), F.col(label).isin(a, b).alias("ok")) for a in names for b in names if a != b]
    long = rows.select(F.inline(F.array(*mine))).where("ok AND v IS NOT NULL")
    each = long.groupBy("class1", "class2", "v").agg(F.count_if("hit").alias("a"), F.count_if(~F.col("hit")).alias("b"))
    below = F.sum("b").over(Window.partitionBy("class1", "class2").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("b") / 2
    won = each.withColumn("won", F.col("a") * below).groupBy("class1", "class2").agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum("won").alias("won"))
    return won.where("n1 > 0 AND n2 > 0").select("class1", "class2", "n1", "n2", (F.col("won") / (F.col("n1") * F.col("n2"))).alias("auc"))


def roc_auc(rows: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """One row: the mean of ``auc_pairs`` over all ordered pairs of classes (Hand and Till), for two classes with complementary scores the usual area."""
    return auc_pairs(rows, label, scores).agg(F.avg("auc").alias("roc_auc"))


def near_zero_variance(rows: DataFrame, columns: list[str], most_ratio: float = 95 / 5, least_unique: float = 10.0) -> DataFrame:
    """(column, values, ratio, percent_unique, constant, dropped) per column, over its values that are not null.

    ratio: of the two commonest values' counts (null with fewer than two); percent_unique: different values to all. Dropped is a
    constant column, and one with a ratio over ``most_ratio`` and at most ``least_unique`` percent. One pass counts all columns'
    values; the second sees how many values have a count, at most the root of twice the rows.
    """
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]))).where("v IS NOT NULL")
    times = long.groupBy("column", "v").agg(F.count("*").alias("n")).groupBy("column", "n").agg(F.count("*").alias("k"))
    sums = times.groupBy("column").agg(F.sum("k").alias("values"), F.sum(F.col("n") * F.col("k")).alias("all"), F.sort_array(F.collect_list(F.struct("n", "k")), False).alias("by"))
    known = rows.sparkSession.createDataFrame([(c,) for c in columns], "column string").join(sums, "column", "left")
    first = F.get("by", F.lit(0))
    second = F.when(first["k"] > 1, first["n"]).otherwise(F.get("by", F.lit(1))["n"])
    out = known.select("column", F.coalesce("values", F.lit(0)).alias("values"), F.try_divide(first["n"], second).alias("ratio"), (F.col("values") * 100 / F.col("all")).alias("percent_unique"))
    constant = F.col("values") <= 1
    return out.select("*", constant.alias("constant"), (constant | F.coalesce((F.col("ratio") > most_ratio) & (F.col("percent_unique") <= least_unique), F.lit(False))).alias("dropped"))


def dummies(rows: DataFrame, column: str, levels: list[str] | None = None, one_hot: bool = False) -> DataFrame:
    """``rows`` with a 0/1 column ``<column>_<level>`` for each level instead of ``column``, the first level left out unless ``one_hot``; null stays null, an unknown level is 0 in all."""
    levels = features(rows, column) if levels is None else levels
    value = F.col(f"`{column}`")
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != column], *[F.when(value.isNotNull(), (value == v).cast("int")).alias(f"{column}_{v}") for v in levels[not one_hot :]])


def contributions(wide: DataFrame, label: str, model: Discriminant, names: list[str], axis: int = 0, top: int = 5) -> DataFrame:
    """(label, feature, contribution): per class the ``top`` features by mean share in the axis's score, ties included."""
    terms = [F.col(c) * float(w) for c, w in zip(model.columns, model.axes[axis])]
    total = F.abs(sum(terms, F.lit(0.0)))
    long = wide.select(label, F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.try_divide(t, total).alias("v")) for n, t in zip(names, terms)])))
    mean = long.groupBy(label, "feature").agg(F.avg("v").alias("contribution"))
    rank = F.rank().over(Window.partitionBy(label).orderBy(F.abs("contribution").desc_nulls_last()))
    return mean.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")
