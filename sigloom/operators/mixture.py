"""The dual-signal mixture: diagonal Gaussians over samples plus a sequence score, with missing cells.

Rows are narrow: pep_id, x array<double> (null where missing and not yet filled), miss
array<boolean>, codes array<int> (position * 20 + residue) and r array<double>.

A fit walks rounds (``operators/rounds``): each folds the rows of a partition into sums whose
size is the model's, and the model for the next round follows from their total.  What a row
needs to know of earlier rounds (the cells that were filled for it) follows from the models
since the last copy of the rows, so no round writes the table.  Column forms of single steps
(``moments``, ``m_step``, ``scored``) stay inside whole-stage code.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions.residues import ALPHABET, WINDOW, pam250
from sigloom.functions.special import betainc, binomial_below, log_sum_exp
from sigloom.operators import rounds
from sigloom.operators.rounds import settle

EPS = 10 * 2.220446049250313e-16
FLOOR = 1e-6
#: Rows that a step takes at a time, few enough for the processor's cache; squares over variances beyond which a distance isn't multiplied out (it would be off by 1e-8 or so).
AT_ONCE, LOST = 2048, 1e8


@dataclass
class Model:
    """Means and variances (cluster by sample), log weights, and per cluster a score for each code."""

    means: list[list[float]]
    variances: list[list[float]]
    log_pi: list[float]
    table: list[list[float]] | None = None
    method: str = "binomial"
    weight: float = 0.0
    bounds: list[float] = field(default_factory=list)


def codes(seq: Column) -> Column:
    """position * 20 + residue of each letter of a sequence."""
    letters = F.split(F.upper(seq), "")
    return F.transform(F.slice(letters, 1, WINDOW), lambda c, i: (i * 20 + F.position(c, F.lit(ALPHABET)) - 1).cast("int"))


def rows_of(signal: DataFrame, samples: int) -> DataFrame:
    """pep_id, x, miss of a long signal (pep_id, sample_idx, x)."""
    cells = F.map_from_entries(F.collect_list(F.struct("sample_idx", "x")))  # as many cells as samples
    wide = signal.filter(F.col("x").isNotNull()).groupBy("pep_id").agg(cells.alias("m"))
    every = signal.select("pep_id").distinct().join(wide, "pep_id", "left")
    x = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: F.try_element_at(F.col("m"), s))
    return every.select("pep_id", x.alias("x")).withColumn("miss", F.transform("x", lambda v: v.isNull()))


def filled(rows: DataFrame, means: list[float]) -> DataFrame:
    """Missing cells at the sample's mean."""
    lits = F.array(*[F.lit(float(v)) for v in means])
    return rows.withColumn("x", F.zip_with("x", lits, lambda v, m: F.coalesce(v, m)))


def sample_means(rows: DataFrame) -> list[float]:
    got = rows.select(F.posexplode("x").alias("s", "v")).groupBy("s").agg(F.avg("v").alias("m")).collect()  # a row per sample
    return [r["m"] or 0.0 for r in sorted(got, key=lambda r: r["s"])]


def moments(rows: DataFrame, k: int) -> tuple[list[float], list[list[float]], list[list[float]]]:
    """Cluster weights, sums r*x and sums r*x*x per cluster and sample, in one pass over the cells."""
    cells = rows.select("r", F.posexplode("x").alias("s", "v"))
    sums = [f(c).alias(f"{n}{c}") for c in range(k) for n, f in (("a", lambda c: F.sum(F.col("r")[c] * F.col("v"))), ("b", lambda c: F.sum(F.col("r")[c] * F.col("v") * F.col("v"))), ("n", lambda c: F.sum(F.col("r")[c])))]
    got = sorted(cells.groupBy("s").agg(*sums).collect(), key=lambda r: r["s"])
    n = [got[0][f"n{c}"] for c in range(k)]
    return n, [[r[f"a{c}"] for r in got] for c in range(k)], [[r[f"b{c}"] for r in got] for c in range(k)]


def code_sums(rows: DataFrame, k: int) -> list[list[float]]:
    """Weighted counts of each code per cluster: at most 220 rows."""
    got = rows.select("r", F.explode("codes").alias("code")).groupBy("code").agg(*[F.sum(F.col("r")[c]).alias(f"q{c}") for c in range(k)]).collect()
    out = [[0.0] * (20 * WINDOW) for _ in range(k)]
    for r in got:
        for c in range(k):
            out[c][r["code"]] = r[f"q{c}"]
    return out


def binomial_table(sums: list[list[float]], n: list[float], background: list[float]) -> list[list[float]]:
    """P(Binomial(n, background) <= weighted count) for each cluster and code."""
    return [[betainc(max(n[c] - q, 1e-3), q + 1, 1 - background[code]) for code, q in enumerate(row)] for c, row in enumerate(sums)]


def pam_table(sums: list[list[float]], n: list[float]) -> list[list[float]]:
    """Mean substitution score against the cluster's residues at the position, for each code."""
    m = pam250()
    return [[sum(m[code % 20][b] * row[code // 20 * 20 + b] for b in range(20)) / max(n[c], 1e-5) for code in range(20 * WINDOW)] for c, row in enumerate(sums)]


def m_step(rows: DataFrame, k: int, method: str = "binomial", weight: float = 0.0, background: list[float] | None = None) -> Model:
    n, a, b = moments(rows, k)
    held = [v + EPS for v in n]
    means = [[s / held[c] for s in a[c]] for c in range(k)]
    variances = [[s / held[c] - m * m + FLOOR for s, m in zip(b[c], means[c], strict=True)] for c in range(k)]
    log_pi = [math.log(v / sum(held)) for v in held]
    table = None
    if weight:
        sums = code_sums(rows, k)
        table = binomial_table(sums, n, background) if method == "binomial" else pam_table(sums, n)
    return Model(means, variances, log_pi, table, method, weight)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows with l (log joint density per cluster), lse and r."""
    spark = rows.sparkSession
    d = len(model.means[0])
    entries = []
    for c in range(len(model.means)):
        const = model.log_pi[c] - 0.5 * (d * math.log(2 * math.pi) + sum(math.log(v) for v in model.variances[c]))
        entries.append((const, model.means[c], [0.5 / v for v in model.variances[c]], model.table[c] if model.table else []))
    one = spark.createDataFrame([(entries,)], "model array<struct<c:double,mu:array<double>,h:array<double>,t:array<double>>>")

    def joint(m: Column) -> Column:
        gauss = F.aggregate(F.zip_with(F.col("x"), F.zip_with(m["mu"], m["h"], lambda a, b: F.struct(a.alias("mu"), b.alias("h"))), lambda v, p: F.pow(v - p["mu"], 2) * p["h"]), F.lit(0.0), lambda s, v: s + v)
        out = m["c"] - gauss
        if model.table:
            seq = F.aggregate(F.col("codes"), F.lit(0.0), lambda s, i: s + F.element_at(m["t"], i + 1))
            out = out + F.lit(model.weight) * (F.log(seq) if model.method == "binomial" else seq)
        return out

    keep = [c for c in rows.columns if c not in ("l", "lse", "r")]
    with_l = rows.select(*keep).join(F.broadcast(one)).withColumn("l", F.transform("model", joint)).drop("model")  # the model is one row
    with_lse = with_l.withColumn("lse", log_sum_exp(F.col("l")))
    return with_lse.withColumn("r", F.transform("l", lambda v: F.exp(v - F.col("lse"))))


def hard(r: Column) -> Column:
    """The cluster of the largest responsibility; the first of equals."""
    return (F.array_position(r, F.array_max(r)) - 1).cast("int")


def refilled(rows: DataFrame, model: Model) -> DataFrame:
    """Originally missing cells at the centre of the row's hard label."""
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in model.means])
    own = F.element_at(centres, hard(F.col("r")) + 1)
    x = F.zip_with(F.zip_with("x", "miss", lambda v, m: F.struct(v.alias("v"), m.alias("m"))), own, lambda c, mu: F.when(c["m"], mu).otherwise(c["v"]))
    return rows.withColumn("x", x)


def lower_bound(rows: DataFrame) -> float:
    return rows.agg(F.avg("lse")).first()[0]


@dataclass
class Block:
    """The rows of a batch or a whole table as matrices; ``x`` is filled where ``miss``, ``truth`` is there where asked for."""

    x: np.ndarray
    miss: np.ndarray
    codes: np.ndarray
    r: np.ndarray
    truth: np.ndarray | None = None

    def parts(self) -> Iterator[Block]:
        """The rows, some at a time, which share their memory with the block's."""
        for low in range(0, len(self.x), AT_ONCE):
            yield Block(*(None if v is None else v[low : low + AT_ONCE] for v in vars(self).values()))


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """A column of equally long lists as a matrix; null cells as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def block_of(batch: pa.RecordBatch) -> Block:
    n = batch.num_rows
    return Block(matrix(batch.column("x"), n).astype(float), matrix(batch.column("miss"), n).astype(bool), matrix(batch.column("codes"), n).astype(int), matrix(batch.column("r"), n).astype(float))


@dataclass
class Terms:
    """A model as matrices: per cluster a constant, one more for the distance from ``origin``, and what multiplies a row's distances to it and their squares."""

    means: np.ndarray
    variances: np.ndarray
    origin: np.ndarray
    const: np.ndarray
    apart: np.ndarray
    factors: np.ndarray
    tables: list[np.ndarray]
    method: str
    weight: float


def pairs(positions: int) -> list[tuple[int, ...]]:
    return [tuple(range(p, min(p + 2, positions))) for p in range(0, positions, 2)]


def own_codes(p: int) -> np.ndarray:
    """The codes that position ``p`` can have: of no residue, then of each."""
    return np.arange(20 * p - 1, 20 * p + 20)


def keys(codes: np.ndarray) -> list[np.ndarray]:
    """Per pair of positions (the last may stand alone) a number for the residues there."""
    if codes[:, 0].min(initial=0) < 0:
        raise ValueError("a sequence begins with no residue")
    places = [[codes[:, p] - (20 * p - 1) for p in pair] for pair in pairs(codes.shape[1])]
    return [own[0] * 21 + own[1] if len(own) > 1 else own[0] for own in places]


def terms(model: Model, positions: int = WINDOW) -> Terms:
    means, variances = np.array(model.means), np.array(model.variances)
    origin = means.mean(axis=0)
    apart = means - origin
    const = np.array(model.log_pi) - 0.5 * (means.shape[1] * math.log(2 * math.pi) + np.log(variances).sum(axis=1))
    tables = []
    if model.table is not None and model.weight:
        own = np.array(model.table).T
        for first, *second in pairs(positions):
            tables.append(own[own_codes(first)])
            for p in second:
                tables[-1] = (tables[-1][:, None, :] + own[own_codes(p)][None, :, :]).reshape(-1, own.shape[1])
    return Terms(means, variances, origin, const, -0.5 * (apart**2 / variances).sum(axis=1), np.hstack([apart / variances, -0.5 / variances]).T.copy(), tables, model.method, model.weight)


def joint(block: Block, t: Terms) -> np.ndarray:
    """Log joint density (rows by clusters).

    Squares are multiplied out, which loses digits where a cluster is narrow for its distance
    from the rows; such clusters are taken as they stand.
    """
    n, d = block.x.shape
    powers = np.empty((n, 2 * d))
    np.subtract(block.x, t.origin, out=powers[:, :d])
    np.square(powers[:, :d], out=powers[:, d:])
    out = powers @ t.factors
    out += t.const + t.apart
    far = powers[:, d:].max(axis=0, initial=0)
    for c in np.flatnonzero(((far + (t.means - t.origin) ** 2) / t.variances).sum(axis=1) > LOST):
        out[:, c] = t.const[c] - 0.5 * ((block.x - t.means[c]) ** 2) @ (1 / t.variances[c])
    if t.tables:
        total, one = np.zeros_like(out), np.empty_like(out)
        for table, at in zip(t.tables, keys(block.codes), strict=True):
            total += np.take(table, at, axis=0, out=one, mode="clip")  # other modes copy once more
        if t.method == "binomial":
            with np.errstate(divide="ignore"):
                np.log(total, out=total)
        total *= t.weight
        out += total
    return out


def expect(block: Block, t: Terms, l: np.ndarray | None = None) -> np.ndarray:
    """Sets the responsibilities; returns each row's log density."""
    l = joint(block, t) if l is None else l
    most = l.max(axis=1, keepdims=True)
    lse = most[:, 0] + np.log(np.exp(l - most).sum(axis=1))
    np.exp(np.subtract(l, lse[:, None], out=block.r), out=block.r)
    return lse


def refill(block: Block, t: Terms) -> None:
    """Missing cells at the centre of the row's hard label."""
    np.copyto(block.x, t.means[block.r.argmax(axis=1)], where=block.miss)


def summed(block: Block, lse: np.ndarray, sequences: bool) -> np.ndarray:
    """Rows, sum of log densities, weights, moments and, where asked, weighted counts of the codes, end to end."""
    r = np.ascontiguousarray(block.r.T)
    parts = [np.array([len(block.x), lse.sum()]), r.sum(axis=1), (r @ block.x).ravel(), (r @ block.x**2).ravel()]
    if sequences:
        counts = np.zeros((len(r), 20 * WINDOW))
        for pair, at in zip(pairs(block.codes.shape[1]), keys(block.codes), strict=True):
            own = np.array([np.bincount(at, weights, minlength=21 ** len(pair)) for weights in r]).reshape(len(r), *[21] * len(pair))
            for axis, p in enumerate(pair):
                counts[:, own_codes(p)] += own.sum(axis=2 - axis) if len(pair) > 1 else own
        parts.append(counts.ravel())
    return np.concatenate(parts)


def maximise(sums: np.ndarray, k: int, samples: int, method: str, weight: float, background: list[float] | None, sequences: bool) -> Model:
    """The model that the sums give; without a sequence score before the first round has counted codes."""
    n = sums[2 : 2 + k]
    a, b = (sums[2 + k + m * k * samples : 2 + k + (m + 1) * k * samples].reshape(k, samples) for m in (0, 1))
    held = n + EPS
    means = a / held[:, None]
    variances = b / held[:, None] - means**2 + FLOOR
    table = None
    if sequences:
        counts = sums[2 + k + 2 * k * samples :].reshape(k, -1)
        if method == "binomial":
            table = binomial_below(counts, n[:, None], np.array(background)[None, :])
        else:
            scores = np.array(pam250(), float)
            table = (counts.reshape(k, -1, 20) @ scores).reshape(k, -1) / np.maximum(n, 1e-5)[:, None]
    return Model(means.tolist(), variances.tolist(), np.log(held / held.sum()).tolist(), None if table is None else table.tolist(), method, weight)


class Rounds(rounds.Task):
    """EM as rounds: a round's parameters are a model (None before the first), and its sums give the next."""

    def __init__(self, k: int, samples: int, method: str, weight: float, background: list[float] | None, most: int, tol: float):
        self.k, self.samples, self.method, self.weight, self.background, self.most, self.tol = k, samples, method, weight, background, most, tol

    def load(self, batch: pa.RecordBatch) -> Block:
        return block_of(batch)

    def join(self, blocks: list[Block]) -> Block:
        whole = Block(None, None, None, None)
        for name in [n for n, v in vars(blocks[0]).items() if v is not None]:
            setattr(whole, name, np.concatenate([getattr(b, name) for b in blocks]))
            for b in blocks:
                setattr(b, name, None)  # else all is held twice
        return whole

    def advance(self, block: Block, model: Model | None) -> np.ndarray:
        t = terms(model, block.codes.shape[1]) if model is not None else None
        sums = 0.0
        for part in block.parts():
            lse = np.zeros(len(part.x))
            if t is not None:
                lse = expect(part, t)
                refill(part, t)
            sums = sums + summed(part, lse, bool(self.weight) and t is not None)
        return sums

    def decide(self, sums: np.ndarray, model: Model | None, step: int) -> tuple[Model, bool]:
        bounds = [] if model is None else [*model.bounds, float(sums[1] / max(sums[0], 1))]
        done = model is not None and (len(bounds) >= self.most or len(bounds) > 1 and abs(bounds[-1] - bounds[-2]) < self.tol)
        new = maximise(sums, self.k, self.samples, self.method, self.weight, self.background, bool(self.weight) and model is not None)
        new.bounds = bounds
        return new, done

    def state(self, block: Block) -> dict[str, np.ndarray]:
        return {"x": block.x, "r": block.r}


class Imputing(Rounds):
    """Rounds that end with the squared error at the missing cells of known ``truth``."""

    def load(self, batch: pa.RecordBatch) -> Block:
        block = block_of(batch)
        block.truth = matrix(batch.column("truth"), batch.num_rows).astype(float)
        return block

    def outcome(self, block: Block, model: Model) -> np.ndarray:
        t, error = terms(model, block.codes.shape[1]), 0.0
        for part in block.parts():
            expect(part, t)
            refill(part, t)
            error += float(((part.x - part.truth)[part.miss & ~np.isnan(part.truth)] ** 2).sum())
        return np.array([error])


def imputation_error(rows: DataFrame, k: int, method: str = "binomial", weight: float = 0.0, background: list[float] | None = None, most: int = 200, tol: float = 1e-4) -> tuple[float, Model]:
    """The squared error at missing cells of known ``truth`` after a fit from the rows' own r, and the model; x has no nulls, and no table is written."""
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        return 0.0, Model([[]] * k, [[]] * k, [0.0] * k, bounds=[0.0])
    model, sums = rounds.outcome(rows, Imputing(k, first["n"], method, weight, background, most, tol), first["n"] + k)
    return float(sums[0]), model


def fit(rows: DataFrame, k: int, method: str = "binomial", weight: float = 0.0, background: list[float] | None = None, most: int = 200, tol: float = 1e-4, start: str = "means") -> tuple[DataFrame, Model]:
    """Iterates from the rows' own r until the bound moves by less than ``tol``; returns scored rows and model.

    The first model is of the Gaussians alone; a round takes responsibilities, fills missing
    cells at the centre of the hard label and then forms the next model.  Missing cells begin
    at the ``means`` of the samples or by ``soft`` thresholding of the singular values.
    """
    if method not in ("binomial", "pam250") or (method == "binomial" and weight and not background):
        raise ValueError("method is binomial (with a background) or pam250")
    if start not in ("means", "soft"):
        raise ValueError("start is means or soft")
    if start == "soft":
        from sigloom.operators.stats import soft_fill

        rows = soft_fill(rows)
    else:
        rows = filled(rows, sample_means(rows))
    rows = settle(rows)
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        return scored_by(rows, Model([[]] * k, [[]] * k, [0.0] * k)), Model([[]] * k, [[]] * k, [0.0] * k)
    task = Rounds(k, first["n"], method, weight, background, most, tol)
    rows, model = rounds.walk(rows, task, first["n"] + k)
    return settle(scored_by(rows, model)), model


def scored_by(rows: DataFrame, model: Model) -> DataFrame:
    """rows with l, lse and r by the model, a batch at a time."""
    keep = [f for f in rows.schema.fields if f.name not in ("l", "lse", "r")]
    shape = T.StructType([*keep, T.StructField("l", T.ArrayType(T.DoubleType())), T.StructField("lse", T.DoubleType()), T.StructField("r", T.ArrayType(T.DoubleType()))])

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                block = block_of(batch)
                t = terms(model, block.codes.shape[1])
                l = joint(block, t)
                lse = expect(block, t, l)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), rounds.lists(l), pa.array(lse), rounds.lists(block.r)], names=[f.name for f in shape.fields])

    return rows.mapInArrow(score, shape)


def one_hot(label: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.when(c == label, 1.0).otherwise(0.0))


def kmeans_start(rows: DataFrame, k: int, seed: int, full: bool = False) -> DataFrame:
    """rows with r of one for the K-means label of their cells, the missing ones at the sample's mean; ``full`` rows have no null."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k == 1:
        return rows.withColumn("r", F.array(F.lit(1.0)))
    x = F.col("x")
    if not full:
        means = F.array(*[F.lit(float(v)) for v in sample_means(rows)])
        x = F.zip_with("x", means, lambda v, m: F.coalesce(v, m))
    ready = rows.withColumn("features", array_to_vector(x))
    model = KMeans(k=k, seed=seed, maxIter=20, predictionCol="own").fit(ready)
    r = F.array(*[F.when(F.col("own") == c, 1.0).otherwise(0.0) for c in range(k)])  # inside one_hot's lambda, the label would be predicted anew for each cluster
    return model.transform(ready).withColumn("r", r).drop("features", "own")


def fit_best(rows: DataFrame, k: int, starts: int = 2, **options) -> tuple[DataFrame, Model]:
    """The best of several starts, each from K-means labels; the first is the rows' own r where they have one."""
    best = None
    for s in range(starts):
        own = rows if not s and "r" in rows.columns else kmeans_start(rows, k, s + 1)
        got = fit(own, k, **options)
        if best is None or got[1].bounds[-1] > best[1].bounds[-1]:
            best = got
    return best


def imputed(rows: DataFrame, model: Model, offset_labels: bool = False) -> DataFrame:
    """x with missing cells at the label's centre; ``offset_labels`` takes the centre of the label before."""
    if not offset_labels:
        return refilled(rows, model)
    moved = Model([model.means[-1], *model.means[:-1]], model.variances, model.log_pi)
    return refilled(rows, moved)
