"""Rank tests, corrections, ROC curves, association of labelings, and regressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sigloom.functions.special import normal_tail
from sigloom.operators import regression, rounds
from sigloom.operators.ordered import running


def centred(rows: DataFrame, value: str, by: str, name: str) -> DataFrame:
    """The value less its mean within ``by``."""
    return rows.withColumn(name, F.col(value) - F.avg(value).over(W.partitionBy(by)))


def rank_sums(rows: DataFrame, group: str, value: str, label: str) -> DataFrame:
    """group, n1, n2, u1, z, ties (0 without any): two-sided Mann-Whitney with average ranks, tie and continuity correction.

    Ranks come from counts per distinct value (combined map-side) and their running sums.
    """
    per = rows.groupBy(group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("t"), F.count_if(label).alias("p"))
    upto = running(per, [group], [F.col("v")], {"upto": F.col("t")})
    rank = F.col("upto") - F.col("t") + (F.col("t") + 1) / 2
    ranked = upto.select(group, "t", "p", rank.alias("rank"))
    s = ranked.groupBy(group).agg(F.sum(F.col("p") * F.col("rank")).alias("r1"), F.sum("p").alias("n1"), F.sum(F.col("t") - F.col("p")).alias("n2"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    u1 = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    most = F.greatest(u1, F.col("n1") * F.col("n2") - u1)
    z = F.when(var > 0, (most - F.col("n1") * F.col("n2") / 2 - 0.5) / F.sqrt(var)).otherwise(F.lit(0.0))
    return s.select(group, "n1", "n2", u1.alias("u1"), z.alias("z"), "ties")


def tail_probability(z: Column) -> Column:
    """Two-sided p of a normal score, by a rational approximation good to 7.5e-8 that any SQL engine can follow."""
    x = F.abs(z)
    t = 1 / (1 + F.lit(0.2316419) * x)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    return F.least(F.lit(1.0), 2 * F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly)


def exact_tail(n1: int, n2: int, u: float) -> float:
    """Two-sided p of U without ties, by counting arrangements."""
    ways = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        for k in range(n1 * n2, n2 + i - 1, -1):
            ways[k] -= ways[k - n2 - i]
        for k in range(i, n1 * n2 + 1):
            ways[k] += ways[k - i]
    return min(1.0, 2 * sum(ways[int(max(u, n1 * n2 - u)) :]) / sum(ways))


def exact_rank_test(a: list[float], b: list[float]) -> float:
    """Two-sided p of two small samples without ties."""
    return exact_tail(len(a), len(b), sum((x > y) + 0.5 * (x == y) for x in a for y in b))


def rank_probability(tests: DataFrame, few: int = 8) -> DataFrame:
    """``rank_sums`` with p: exact where the smaller sample has at most ``few`` values and none are tied, else of the normal score."""

    @F.pandas_udf("double")
    def exact(n1, n2, u1):
        import pandas as pd

        return pd.Series([exact_tail(int(a), int(b), u) for a, b, u in zip(n1, n2, u1, strict=True)], dtype=float)

    small = (F.least("n1", "n2") <= few) & (F.col("ties") == 0)
    # the exact count runs over the rows that need it, one a group
    counted = tests.filter(small).withColumn("p", exact("n1", "n2", "u1"))
    return counted.unionByName(tests.filter(~small).withColumn("p", tail_probability(F.col("z"))))


def asymptotic_p(z: float) -> float:
    return min(1.0, 2 * normal_tail(z))


def step_down(tests: DataFrame, key: str, p: str = "p") -> DataFrame:
    """Holm-Sidak adjusted p: a running maximum over ascending p. One row per test, laid out by ranges of p."""
    m = tests.agg(F.count(F.lit(1)).alias("m")).first()["m"]
    placed = running(tests, [], [F.col(p), F.col(key)], {"place": F.lit(1)})
    raw = placed.withColumn("raw", 1 - F.pow(1 - F.col(p), F.lit(m) - F.col("place") + 1)).drop("place")
    most = running(raw, [], [F.col(p), F.col(key)], {"most": F.col("raw")}, F.max)
    return most.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("most"))).drop("raw", "most")


def stars(p: Column) -> Column:
    """Marks of significance; the second branch is never reached, as published."""
    return F.when(p < 0.05, "*").when(p < 0.01, "**").otherwise("")


def folds(rows: DataFrame, k: int, label: str, order: str) -> DataFrame:
    """fold of each row: stratified and unshuffled; class sizes follow dealing the sorted labels round-robin."""
    per = {bool(r[0]): r[1] for r in rows.groupBy(label).count().collect()}  # two rows
    dealt: dict[bool, list[int]] = {}
    at = 0
    for c in sorted(per):
        full, rest = divmod(per[c], k)
        sizes = [full] * k
        for j in range(at, at + rest):
            sizes[j % k] += 1
        dealt[c] = sizes
        at += per[c]
    fold = F.lit(k - 1)
    for c, sizes in dealt.items():
        ends = np.cumsum(sizes).tolist()
        for f in range(k - 2, -1, -1):
            fold = F.when((F.col(label) == F.lit(c)) & (F.col("place") <= ends[f]), F.lit(f)).otherwise(fold)
    return running(rows, [label], [F.col(order)], {"place": F.lit(1)}).withColumn("fold", fold).drop("place")


def roc_points(rows: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """by, score, fpr, tpr after each distinct score, descending, and fpr0, tpr0 before it."""
    per = rows.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("n"))
    per = running(per, list(by), [F.col("score").desc()], {"p1": F.col("p"), "n1": F.col("n")})
    whole = per.groupBy(*by).agg(F.nullif(F.sum("p"), F.lit(0)).alias("all_p"), F.nullif(F.sum("n"), F.lit(0)).alias("all_n"))
    met = per.join(whole, list(by))
    return met.select(*by, "score", (F.col("n1") / F.col("all_n")).alias("fpr"), (F.col("p1") / F.col("all_p")).alias("tpr"), ((F.col("n1") - F.col("n")) / F.col("all_n")).alias("fpr0"), ((F.col("p1") - F.col("p")) / F.col("all_p")).alias("tpr0"))


def auc(points: DataFrame, *by: str) -> DataFrame:
    """Trapezoid area per ``by``, from (0, 0)."""
    return points.groupBy(*by).agg(F.sum((F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2).alias("auc"))


def mean_roc(points: DataFrame, fold: str, grid: int = 100) -> DataFrame:
    """x, tpr: fold curves interpolated on an even grid from 0 to 1 and averaged; the ends are forced to 0 and 1."""
    at = points.sparkSession.range(grid).select((F.col("id") / F.lit(grid - 1)).alias("x"))  # ``grid`` rows
    met = points.filter("fpr > fpr0").join(F.broadcast(at), (F.col("x") >= F.col("fpr0")) & ((F.col("x") < F.col("fpr")) | ((F.col("x") == 1) & (F.col("fpr") == 1))))
    value = F.col("tpr0") + (F.col("x") - F.col("fpr0")) / (F.col("fpr") - F.col("fpr0")) * (F.col("tpr") - F.col("tpr0"))
    mean = met.groupBy("x").agg(F.avg(value).alias("tpr"))
    return mean.select("x", F.when(F.col("x") == 0, 0.0).when(F.col("x") == 1, 1.0).otherwise(F.col("tpr")).alias("tpr"))


def curve_area(curve: DataFrame) -> DataFrame:
    """auc of an averaged curve (x, tpr); the grid has a hundred rows."""
    at = W.orderBy("x")
    step = (F.col("x") - F.lag("x").over(at)) * (F.col("tpr") + F.lag("tpr").over(at)) / 2
    return curve.select(step.alias("step")).agg(F.sum("step").alias("auc"))


def repeated_folds(rows: DataFrame, k: int, repeats: int, key: str, seed: str = "fold") -> DataFrame:
    """rows once for each of ``repeats`` (repeat) with their fold there: shuffled by hash, without regard to labels; the first folds have a row more."""
    n = rows.count()
    every = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = F.md5(F.concat(F.lit(seed), F.col("repeat").cast("string"), F.lit(":"), F.col(key).cast("string")).cast("binary"))
    placed = running(every.withColumn("_order", order), ["repeat"], [F.col("_order"), F.col(key)], {"place": F.lit(1)}).drop("_order")
    full, more = divmod(n, k)
    long = (full + 1) * more
    fold = F.when(F.col("place") <= long, F.floor((F.col("place") - 1) / F.lit(full + 1))).otherwise(F.lit(more) + F.floor((F.col("place") - 1 - long) / F.lit(max(full, 1))))
    return placed.withColumn("fold", fold.cast("int")).drop("place")


def local_fit(rows: DataFrame, by: str, x: str, y: str, low: float, high: float, bins: int = 50, share: float = 2 / 3) -> DataFrame:
    """by, x, fit: y smoothed by a tricube-weighted line through the nearest ``share`` of the rows.

    Rows fall into ``bins`` equal cells between ``low`` and ``high``, so a group's summary is
    an array of at most ``bins`` entries whatever its number of rows.
    """
    width = (high - low) / bins
    cell = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(x) - low) / width)))
    summed = rows.groupBy(by, (F.lit(low) + (cell + 0.5) * width).alias("x")).agg(F.count(y).alias("n"), F.sum(y).alias("y"))
    cells = summed.groupBy(by).agg(F.collect_list(F.struct("x", "n", "y")).alias("cells"), F.sum("n").alias("total"))
    at = cells.select(by, "cells", F.ceil(F.lit(share) * F.col("total")).alias("least"), F.explode("cells.x").alias("x"))
    near = F.array_sort(F.transform("cells", lambda c: F.struct(F.abs(c["x"] - F.col("x")).alias("d"), c["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("h"))
    reach = F.aggregate(near, start, lambda s, e: F.struct((s["seen"] + e["n"]).alias("seen"), F.when(s["h"].isNull() & (s["seen"] + e["n"] >= F.col("least")), e["d"]).otherwise(s["h"]).alias("h")), lambda s: s["h"])

    def weight(c: Column) -> Column:
        d = F.abs(c["x"] - F.col("x"))
        return F.when(d == 0, 1.0).when(d < F.col("h"), F.pow(1 - F.pow(d / F.col("h"), 3), 3)).otherwise(0.0)

    def total(part) -> Column:
        return F.aggregate("cells", F.lit(0.0), lambda s, c: s + weight(c) * part(c, c["x"] - F.col("x")))

    sums = {"s0": total(lambda c, d: c["n"]), "s1": total(lambda c, d: c["n"] * d), "s2": total(lambda c, d: c["n"] * d * d), "t0": total(lambda c, d: c["y"]), "t1": total(lambda c, d: c["y"] * d)}
    base = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    fit = F.when(base > 1e-9, (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / base).otherwise(F.col("t0") / F.col("s0"))
    return at.withColumn("h", reach).withColumns(sums).select(by, "x", fit.alias("fit"))


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """mi in nats, and both entropies, from the contingency counts."""
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    na, nb = F.sum("n").over(W.partitionBy(a)), F.sum("n").over(W.partitionBy(b))
    joint = cells.withColumns({"na": na, "nb": nb}).crossJoin(F.broadcast(cells.agg(F.sum("n").alias("total"))))  # one row
    p = F.col("n") / F.col("total")
    return joint.agg(F.sum(p * F.log(p * F.col("total") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"), (-F.sum(p * F.log(F.col("na") / F.col("total")))).alias("h_a"), (-F.sum(p * F.log(F.col("nb") / F.col("total")))).alias("h_b"))


def adjusted_mutual_information(rows: DataFrame, a: str, b: str) -> float:
    """Mutual information less its expectation under fixed margins, over the mean entropy less the same."""
    return association({(r[0], r[1]): r[2] for r in rows.groupBy(a, b).count().collect()})  # a row per pair of labels


def association(cells: dict[tuple, int]) -> float:
    """Adjusted mutual information from the contingency counts of two labelings."""
    left: dict = {}
    right: dict = {}
    for (x, y), c in cells.items():
        left[x] = left.get(x, 0) + c
        right[y] = right.get(y, 0) + c
    n = sum(left.values())
    if len(left) == len(right) == 1 or not n:
        return 1.0
    mi = sum(c / n * math.log(n * c / (left[x] * right[y])) for (x, y), c in cells.items() if c)
    ha, hb = (-sum(v / n * math.log(v / n) for v in side.values()) for side in (left, right))
    expected = sum(expected_information(x, y, n) for x in left.values() for y in right.values())
    top, bottom = mi - expected, (ha + hb) / 2 - expected
    return top / bottom if abs(bottom) > 1e-15 else 1.0


def expected_information(x: int, y: int, n: int) -> float:
    """Expected contribution of a cell with margins ``x`` and ``y``: a sum over the hypergeometric law of its count.

    The sum covers forty standard deviations, beyond which the law's mass is nil, so its
    length grows with the root of ``n``.
    """
    low, high = max(0, x + y - n), min(x, y)
    mean = x * y / n
    spread = 40 * math.sqrt(max(1.0, mean * (n - x) / n * (n - y) / max(1, n - 1))) + 40
    k = np.arange(max(low, int(mean - spread)), min(high, int(mean + spread)) + 1, dtype=np.float64)
    ratio = (x - k[:-1]) * (y - k[:-1]) / ((k[:-1] + 1) * (n - x - y + k[:-1] + 1))
    log_mass = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
    mass = np.exp(log_mass - log_mass.max())
    some = k > 0
    return float((mass[some] * k[some] / n * np.log(n * k[some] / (x * y))).sum() / mass.sum())


def logistic(rows: DataFrame, features: str = "features", label: str = "y", c: float = 1.0, l1: float = 1.0):
    """A balanced, penalised logistic model (``ml``), with the penalty as 1 / (c * n)."""
    from pyspark.ml.classification import LogisticRegression

    counts = {bool(r[0]): r[1] for r in rows.groupBy(label).count().collect()}  # two rows
    n = sum(counts.values())
    weight = F.when(F.col(label), F.lit(n / (2 * max(1, counts.get(True, 0))))).otherwise(F.lit(n / (2 * max(1, counts.get(False, 0)))))
    ready = rows.withColumn("label", F.col(label).cast("double")).withColumn("weight", weight)
    return LogisticRegression(featuresCol=features, weightCol="weight", elasticNetParam=l1, regParam=1 / (c * n), standardization=False, maxIter=100).fit(ready)


def logistic_search(rows: DataFrame, k: int, penalties: tuple[float, ...], l1: float, key: str):
    """The model on all rows with the penalty of the best mean accuracy over ``k`` inner folds (the first of equals)."""
    d = rounds.settle(folds(rows, k, "y", key))
    right = dict.fromkeys(penalties, 0.0)
    for f in range(k):
        train, test = d.filter(F.col("fold") != f), d.filter(F.col("fold") == f)
        for c in right:
            got = logistic(train, c=c, l1=l1).transform(test)
            right[c] += got.agg(F.avg(((F.col("prediction") == 1) == F.col("y")).cast("double"))).first()[0] or 0.0
    return logistic(d, c=max(right, key=lambda c: right[c]), l1=l1)


def searched_scores(rows: DataFrame, k: int, penalties: tuple[float, ...] = regression.PENALTIES, l1: float = 1.0, key: str = "pep_id") -> DataFrame:
    """fold, y, score of each row (key, y, x) by a model that hasn't seen its fold and whose penalty inner folds picked.

    A table of up to ``rounds.ONE_TASK_CELLS`` cells is searched in one task, a larger one by Spark ML.
    """
    d = rounds.settle(folds(rows.select(key, "y", "x"), k, "y", key))
    first = d.select(F.size("x").alias("n")).first()
    shape = "fold int, y boolean, score double"
    if first is None:
        return rows.sparkSession.createDataFrame([], shape)
    if d.count() * first["n"] <= rounds.ONE_TASK_CELLS:

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            order = np.argsort(np.concatenate([np.asarray(b.column(key)) for b in held]), kind="stable")
            x, y, fold = (np.concatenate(v)[order] for v in zip(*((b.column("x").flatten().to_numpy().reshape(b.num_rows, -1), np.asarray(b.column("y")).astype(bool), np.asarray(b.column("fold"))) for b in held), strict=True))
            for f in range(k):
                w, _ = regression.search(x[fold != f], y[fold != f], k, penalties, l1)
                own = fold == f
                yield pa.RecordBatch.from_arrays([pa.array(np.full(own.sum(), f, np.int32)), pa.array(y[own]), pa.array(np.round(regression.scores(w, x[own]), 6))], names=["fold", "y", "score"])

        return d.coalesce(1).mapInArrow(search, shape)
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = d.withColumn("features", array_to_vector("x")).drop("x")
    parts = []
    for f in range(k):
        model = logistic_search(ready.filter(F.col("fold") != f).drop("fold"), k, penalties, l1, key)
        parts.append(model.transform(ready.filter(F.col("fold") == f)).select("fold", "y", F.round(vector_to_array("probability")[1], 6).alias("score")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gram(rows: DataFrame, x: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Cross products, sums and number of the vectors in ``x``, which have no null.

    Each partition folds its vectors into one row, and these are summed cell by cell: a row
    is never expanded into the squares of its length.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                v = np.hstack([v, np.ones((len(v), 1))])  # the column of ones gives sums and number
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

    folded = rows.select(x).mapInArrow(parts, "g array<double>").select(F.posexplode("g").alias("at", "v"))
    got = folded.groupBy("at").agg(F.sum("v").alias("v")).collect()  # the square of the number of samples
    d = math.isqrt(len(got))
    whole = np.zeros(d * d)
    for r in got:
        whole[r["at"]] = r["v"]
    whole = whole.reshape(d, d)
    return (whole[:-1, :-1], whole[-1, :-1], round(whole[-1, -1])) if d else (np.zeros((0, 0)), np.zeros(0), 0)


def principal(rows: DataFrame, x: str, parts: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, loadings and variance shares from one aggregation of the cross products (samples are few)."""
    products, sums, n = gram(rows, x)
    mean = sums / n
    values, vectors = np.linalg.eigh((products - n * np.outer(mean, mean)) / (n - 1))
    order = np.argsort(values)[::-1][:parts]
    loadings = vectors[:, order]
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])  # the largest entry is positive
    return mean, loadings, values[order] / values.sum()


def principal_scores(rows: DataFrame, x: str, mean: np.ndarray, loadings: np.ndarray) -> DataFrame:
    """rows with pc, the coordinates of their centred vector along the loadings."""
    centred = F.zip_with(x, F.array(*[F.lit(float(v)) for v in mean]), lambda v, m: v - m)
    along = lambda part: F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(v)) for v in part]), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn("pc", F.array(*[along(part) for part in loadings.T]))


def top_clusters(coefficients: DataFrame, members: DataFrame, most: int = 3) -> DataFrame:
    """place (0 first), cluster, coef of the ``most`` largest coefficients by size among the clusters that have members; of equals the higher cluster."""
    held = coefficients.join(members.select("cluster").distinct(), "cluster", "left_semi")
    top = held.orderBy(F.desc(F.abs("coef")), F.desc("cluster")).limit(most)
    return top.select((F.row_number().over(W.orderBy(F.desc(F.abs("coef")), F.desc("cluster"))) - 1).alias("place"), "cluster", "coef")


def best_and_plain(results: DataFrame) -> DataFrame:
    """task, weight, performance, kind: the rows of weight 0 (plain), and of the others each task's best (weighted; the smallest weight of equals)."""
    plain = results.filter("weight = 0").select("task", "weight", "performance", F.lit("plain").alias("kind"))
    order = F.struct("performance", -F.col("weight"))
    best = results.filter("weight <> 0").groupBy("task").agg(F.max(order).alias("o"))
    return plain.unionByName(best.select("task", (-F.col("o").getField("col2")).alias("weight"), F.col("o.performance").alias("performance"), F.lit("weighted").alias("kind")))


class Filling(rounds.Task):
    """Missing cells from the leading directions of the cross products, round by round.

    ``shrink`` takes that share of the first round's largest singular value off every one.
    """

    def __init__(self, rank: int | None, shrink: float, most: int, tol: float):
        self.rank, self.shrink, self.most, self.tol = rank, shrink, most, tol

    def load(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        n = batch.num_rows
        return [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(kind) for c, kind in (("x", float), ("miss", bool))]

    def join(self, blocks: list) -> list[np.ndarray]:
        return [np.concatenate([b[k] for b in blocks]) for k in (0, 1)]

    def advance(self, block: list[np.ndarray], params: dict | None) -> np.ndarray:
        moved, size, products = 0.0, 0.0, np.zeros((block[0].shape[1],) * 2)
        for low in range(0, len(block[0]), 2048):  # what is held of so many rows stays in the processor's cache
            x, miss = (v[low : low + 2048] for v in block)
            if params is not None:
                at = np.flatnonzero(miss)
                new, old = (x @ params["project"]).ravel()[at], x.ravel()[at]
                moved, size = moved + float(((new - old) ** 2).sum()), size + float((new**2).sum())
                x.ravel()[at] = new
            products += x.T @ x
        return np.concatenate([[moved, size], products.ravel()])

    def decide(self, sums: np.ndarray, params: dict | None, step: int) -> tuple[dict, bool]:
        if params is not None and (sums[0] <= self.tol**2 * sums[1] or step >= self.most):
            return params, True
        d = math.isqrt(len(sums) - 2)
        values, vectors = np.linalg.eigh(sums[2:].reshape(d, d))
        order = np.argsort(values)[::-1][: self.rank]
        size = np.sqrt(np.maximum(values[order], 0))
        less = self.shrink * size.max(initial=0) if params is None else params["less"]
        keep = np.maximum(size - less, 0) / np.maximum(size, 1e-12)
        return {"project": (vectors[:, order] * keep) @ vectors[:, order].T, "less": less}, False

    def state(self, block: list[np.ndarray]) -> dict[str, np.ndarray]:
        return {"x": block[0]}


def _walked(rows: DataFrame, task: Filling) -> DataFrame:
    rows = rounds.settle(rows)
    first = rows.select(F.size("x").alias("n")).first()
    return rounds.walk(rows, task, first["n"])[0] if first else rows


def low_rank_fill(rows: DataFrame, rank: int, most: int = 200, tol: float = 1e-4) -> DataFrame:
    """Missing cells of ``x`` (with ``miss``) from the leading ``rank`` directions, iterated from the samples' means.

    Ends when the missing cells move by less than ``tol``, relative to their size.
    """
    from sigloom.operators.mixture import filled, sample_means

    return _walked(filled(rows, sample_means(rows)), Filling(rank, 0.0, most, tol))


def soft_fill(rows: DataFrame, shrink: float = 1 / 50, most: int = 100, tol: float = 1e-3) -> DataFrame:
    """Missing cells of ``x`` (with ``miss``) by soft thresholding of all singular values, iterated from zero."""
    zero = F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))
    return _walked(rows.withColumn("x", zero), Filling(None, shrink, most, tol))
