"""Baseline clusterers and hierarchical linkage over a bounded number of representatives.

Up to ``REPRESENTATIVES`` rows stand for themselves; more are summarised by K-means into as
many weighted points.  Hierarchical, density, message-passing and spectral methods then work on these
points alone, and a row takes the label of its representative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.operators.rounds import settle

#: Weighted points that stand for all rows, at most.
REPRESENTATIVES = 1024


def representatives(rows: DataFrame, x: str, most: int = REPRESENTATIVES, seed: int = 1) -> tuple[np.ndarray, DataFrame]:
    """Up to ``most`` rows, or centres of as many groups, and the rows with ``point``, the index of theirs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if rows.count() <= most:
        own = settle(rows).withColumn("_at", F.monotonically_increasing_id())  # settled rows keep their places
        got = own.select("_at", x).orderBy("_at").collect()  # at most ``most`` rows
        places = rows.sparkSession.createDataFrame([(r["_at"], k) for k, r in enumerate(got)], "_at long, point int")
        return np.array([r[x] for r in got], float), own.join(F.broadcast(places), "_at").drop("_at")
    ready = rows.withColumn("features", array_to_vector(x))
    model = KMeans(k=most, seed=seed, maxIter=10, predictionCol="point").fit(ready)
    return np.array(model.clusterCenters()), model.transform(ready).drop("features")


class Leaves:
    """Clustering features (number, sum, sum of squares), each within ``threshold`` of its centre; at most ``most``.

    A feature goes into the nearest one that keeps its radius, else stands alone.  When there
    are too many, the threshold grows and the features are dealt anew.
    """

    def __init__(self, most: int, threshold: float):
        self.most, self.threshold = most, threshold
        self.n, self.sums, self.squares = np.zeros(0), None, np.zeros(0)

    def add(self, n: float, total: np.ndarray, squares: float) -> None:
        if self.sums is None:
            self.sums = np.zeros((0, len(total)))
        if len(self.n):
            k = int(((self.sums / self.n[:, None] - total / n) ** 2).sum(axis=1).argmin())
            m, t, q = self.n[k] + n, self.sums[k] + total, self.squares[k] + squares
            if q / m - ((t / m) ** 2).sum() <= self.threshold**2:
                self.n[k], self.sums[k], self.squares[k] = m, t, q
                return
        self.n, self.sums, self.squares = np.append(self.n, n), np.vstack([self.sums, total]), np.append(self.squares, squares)
        while len(self.n) > self.most:
            held = self.n, self.sums, self.squares
            self.threshold *= 1.5
            self.n, self.sums, self.squares = np.zeros(0), np.zeros((0, held[1].shape[1])), np.zeros(0)
            for one in zip(*held, strict=True):
                self.add(*one)


def leaf_centres(rows: DataFrame, x: str, most: int = REPRESENTATIVES, threshold: float = 0.5) -> np.ndarray:
    """Centres of the features that the rows fall into: first inside the partitions, then of what these found, in two steps."""
    shape = "n double, total array<double>, squares double"

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = Leaves(most, threshold)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(batch.num_columns - 1 if batch.num_columns == 1 else 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if batch.num_columns == 1:
                n, squares = np.ones(len(vectors)), (vectors**2).sum(axis=1)
            else:
                n, squares = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for one in zip(n, vectors, squares, strict=True):
                leaves.add(*one)
        if len(leaves.n):
            yield pa.RecordBatch.from_arrays([pa.array(leaves.n), pa.array(leaves.sums.tolist(), pa.list_(pa.float64())), pa.array(leaves.squares)], names=["n", "total", "squares"])

    parts = rows.select(x).mapInArrow(folded, shape)
    some = parts.repartition(max(1, rows.rdd.getNumPartitions() // 64)).mapInArrow(folded, shape)
    got = some.coalesce(1).mapInArrow(folded, shape).collect()  # at most ``most`` rows
    return np.array([np.array(r["total"]) / r["n"] for r in got])


def nearest_centre(rows: DataFrame, x: str, centres: np.ndarray, name: str) -> DataFrame:
    """rows with the index of the centre nearest to ``x``; the first of equals."""
    shape = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema.fields), T.StructField(name, T.IntegerType())])
    norms = (centres**2).sum(axis=1)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(x).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = (norms[None, :] - 2 * v @ centres.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[*batch.schema.names, name])

    return rows.mapInArrow(found, shape)


def squared(points: np.ndarray) -> np.ndarray:
    """Squared distances between all points."""
    norms = (points**2).sum(axis=1)
    return np.maximum(norms[:, None] + norms[None, :] - 2 * points @ points.T, 0)


def linkage(points: np.ndarray, sizes: np.ndarray, method: str) -> list[tuple[int, int, float, float]]:
    """Merges (a, b, height, size) of ``ward``, ``average``, ``complete`` or ``centroid`` linkage, nearest pair first.

    The k-th merge makes cluster ``len(points) + k``.  Distances after a merge follow from
    those before by the recurrence of Lance and Williams.
    """
    n = len(points)
    d = squared(points)
    size = sizes.astype(float).copy()
    if method == "ward":
        d = 2 * d * size[:, None] * size[None, :] / (size[:, None] + size[None, :])
    elif method in ("average", "complete"):
        d = np.sqrt(d)
    elif method != "centroid":
        raise ValueError("method is ward, average, complete or centroid")
    np.fill_diagonal(d, np.inf)
    name = list(range(n))
    out = []
    for k in range(n - 1):
        a, b = sorted(divmod(int(np.argmin(d)), n))
        height, na, nb = d[a, b], size[a], size[b]
        if method == "ward":
            new = ((na + size) * d[a] + (nb + size) * d[b] - size * height) / (na + nb + size)
        elif method == "average":
            new = (na * d[a] + nb * d[b]) / (na + nb)
        elif method == "complete":
            new = np.maximum(d[a], d[b])
        else:
            new = (na * d[a] + nb * d[b]) / (na + nb) - na * nb * height / (na + nb) ** 2
        new[[a, b]] = np.inf
        new[np.isinf(d[a]) | np.isinf(d[b])] = np.inf
        d[a], d[:, a] = new, new
        d[b], d[:, b] = np.inf, np.inf
        size[a] = na + nb
        out.append((min(name[a], name[b]), max(name[a], name[b]), float(height if method in ("average", "complete") else np.sqrt(max(height, 0))), float(size[a])))
        name[a] = n + k
    return out


def leaves(merges: list[tuple[int, int, float, float]], n: int) -> list[int]:
    """Points in the order of the tree, smaller name first."""
    order = {k: [k] for k in range(n)}
    for k, (a, b, _, _) in enumerate(merges):
        order[n + k] = order.pop(a) + order.pop(b)
    return [x for part in order.values() for x in part]


def cut(merges: list[tuple[int, int, float, float]], n: int, k: int) -> np.ndarray:
    """Labels of ``n`` points after all but the last ``k - 1`` merges."""
    member = {i: [i] for i in range(n)}
    for i, (a, b, _, _) in enumerate(merges[: max(0, n - k)]):
        member[n + i] = member.pop(a) + member.pop(b)
    labels = np.empty(n, int)
    for label, own in enumerate(member.values()):
        labels[own] = label
    return labels


def mean_shift(points: np.ndarray, sizes: np.ndarray, share: float = 0.3, rounds: int = 100) -> np.ndarray:
    """Labels by the mode that each point climbs to under a flat kernel as wide as the nearest ``share`` of points."""
    far = np.sqrt(squared(points))
    width = np.sort(far, axis=1)[:, max(1, int(len(points) * share)) - 1].mean()
    at = points.copy()
    for _ in range(rounds):
        near = np.sqrt(np.maximum((at**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * at @ points.T, 0)) <= width
        weight = near * sizes
        total = weight.sum(axis=1, keepdims=True)
        new = np.where(total > 0, weight @ points / np.maximum(total, 1e-300), at)
        moved, at = np.abs(new - at).max(), new
        if moved < 1e-3 * width:
            break
    modes: list[np.ndarray] = []
    labels = np.empty(len(points), int)
    for i, here in enumerate(at):
        hit = next((m for m, mode in enumerate(modes) if np.linalg.norm(mode - here) <= width), None)
        if hit is None:
            hit = len(modes)
            modes.append(here)
        labels[i] = hit
    return labels


def affinity(points: np.ndarray, damping: float = 0.5, rounds: int = 200) -> np.ndarray:
    """Labels by affinity propagation; similarities are negative squared distances, preferences their median."""
    n = len(points)
    s = -squared(points)
    np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]) if n > 1 else 0.0)
    s += 1e-12 * np.abs(s).max() * np.arange(n)[None, :] / max(1, n)  # ties go one way
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(rounds):
        both = a + s
        best = both.argmax(axis=1)
        most = both[np.arange(n), best]
        both[np.arange(n), best] = -np.inf
        other = np.repeat(most[:, None], n, axis=1)
        other[np.arange(n), best] = both.max(axis=1)
        r = damping * r + (1 - damping) * (s - other)
        held = np.maximum(r, 0)
        np.fill_diagonal(held, np.diag(r))
        new = held.sum(axis=0)[None, :] - held
        own = np.diag(new).copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, own)
        a = damping * a + (1 - damping) * new
    heads = np.flatnonzero(np.diag(a + r) > 0)
    if not len(heads):
        return np.zeros(n, int)
    labels = s[:, heads].argmax(axis=1)
    labels[heads] = np.arange(len(heads))
    return labels


def lloyd(points: np.ndarray, k: int, sizes: np.ndarray, rounds: int = 100) -> np.ndarray:
    """K-means labels of few weighted points; each start lies farthest from those before it."""
    picked = [int(((points - np.average(points, axis=0, weights=sizes)) ** 2).sum(axis=1).argmin())]
    while len(picked) < min(k, len(points)):
        picked.append(int(np.min([((points - points[p]) ** 2).sum(axis=1) for p in picked], axis=0).argmax()))
    centres = points[picked]
    labels = np.zeros(len(points), int)
    for step in range(rounds):
        new = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        if step and (new == labels).all():
            break
        labels = new
        centres = np.array([np.average(points[labels == c], axis=0, weights=sizes[labels == c]) if (labels == c).any() else centres[c] for c in range(len(centres))])
    return labels


def spectral(points: np.ndarray, k: int, sizes: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """Labels by K-means on the leading directions of the normalised Gaussian affinity of all the rows that the points stand for."""
    w = np.exp(-gamma * squared(points))
    degree = w @ sizes
    scale = np.sqrt(sizes / degree)
    _, vectors = np.linalg.eigh(w * scale[:, None] * scale[None, :])
    return lloyd(vectors[:, -k:] / np.sqrt(sizes * degree)[:, None], k, sizes)


def baselines(points: np.ndarray, sizes: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Labels of the representatives by each method; all but affinity weigh them by their rows."""
    n = len(points)
    out = {m: cut(linkage(points, sizes, m), n, k) for m in ("ward", "average", "complete")}
    return out | {"mean_shift": mean_shift(points, sizes), "affinity": affinity(points), "spectral": spectral(points, k, sizes)}


def birch(centres: np.ndarray, k: int) -> np.ndarray:
    """Labels of the features' centres: Ward's linkage of the centres, each counting once."""
    return cut(linkage(centres, np.ones(len(centres)), "ward"), len(centres), k)
