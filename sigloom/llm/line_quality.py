"""Document quality from its lines, by a linear-chain conditional random field.

Every line is good or bad.  Its features are its own (what signs it holds, how its words
repeat, whether it came before) and those of the lines beside it; neighbouring labels are
tied by transition weights.  A document's quality is the mean of its lines' marginal
probabilities of being good, by forward-backward, weighted by line length, and calibrated
by a logistic curve.  Labels exist for documents only, so in training each line takes its
document's; the field is fitted by its likelihood gradient on a sample that is bounded in
documents and in lines.  Texts stay on the executors: the driver gets the sample's features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import settle, slices, with_text

#: Labelled documents that are fitted, at most, and their lines, at most; gradient steps; penalty on squared weights.
FIT_DOCS, FIT_LINES, STEPS, PENALTY = 3_000, 100_000, 150, 1e-3
#: Documents that still have a line at a place, up to which they are walked one by one.
FEW = 4
#: Lines whose features are held at once when scoring.
BLOCK_LINES = 1 << 14
#: Score from which a document is predicted good.
GOOD_FROM = 0.7

#: Classes of bytes that are counted in a line, by their members.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*@^~<>=+_", b"!?", b"|", b".,;:", b"()[]{}\"'/\\-", bytes(range(128, 256)))
OWN = len(CLASSES) + 6
#: Own features of a line and of the lines before and after it, and a constant.
WIDTH = 3 * OWN + 1


def own_features(lines: list[bytes], seen: set[bytes]) -> np.ndarray:
    """Own features (lines by OWN) of lines that follow those ``seen``, to which they are added."""
    n, k = len(lines), len(CLASSES)
    lengths = np.fromiter(map(len, lines), np.int64, n)
    own = np.zeros((n, OWN))
    # bytes by class: one count over (line, class) pairs
    line_of = np.repeat(np.arange(n), lengths)
    kinds = _CLASS_OF[np.frombuffer(b"".join(lines), np.uint8)]
    counts = np.bincount(line_of * (k + 1) + kinds, minlength=n * (k + 1)).reshape(n, -1)[:, 1:]
    own[:, :k] = counts / np.maximum(lengths, 1)[:, None]
    for i, line in enumerate(lines):
        words = line.split()
        m = len(words)
        if m:
            own[i, k] = len(set(words)) / m
            own[i, k + 1] = sum(a == b for a, b in pairwise(words)) / m
            own[i, k + 2] = min(1.0, (len(line) / m) / 20)
            own[i, k + 3] = line in seen
            seen.add(line)
    own[:, k + 4] = np.minimum(np.log1p(lengths) / 10, 1.5)
    own[:, k + 5] = lengths == 0
    return own


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines by WIDTH) and lengths of a text's lines; an empty text has one empty line."""
    lines = text.split(b"\n")
    own = own_features(lines, set())
    out = np.zeros((len(lines), WIDTH))
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[:, -1] = 1
    return out, np.fromiter(map(len, lines), np.int64, len(lines))


def line_scores(text: bytes, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features' weighted sum for each line, and the lines' lengths; features are held for a block of lines only."""
    lines = text.split(b"\n")
    n = len(lines)
    parts = np.empty((n, 3))  # what a line gives itself, the next and the one before
    seen: set[bytes] = set()
    sides = weights[:-1].reshape(3, OWN).T
    for start in range(0, n, BLOCK_LINES):
        parts[start : start + BLOCK_LINES] = own_features(lines[start : start + BLOCK_LINES], seen) @ sides
    total = parts[:, 0] + weights[-1]
    total[1:] += parts[:-1, 1]
    total[:-1] += parts[1:, 2]
    return total, np.fromiter(map(len, lines), np.int64, n)


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for k, members in enumerate(CLASSES):
        table[list(members)] = k + 1
    return table


_CLASS_OF = _class_table()


@dataclass
class Field:
    """Line weights for good (bad has none), transition scores [from, to], and the curve of the document score."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def chains(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Lines in the order of their place in the document, longer documents first, and where each place begins.

    The documents with a line at a place are the first of those with one at the place before.
    """
    n = np.array(lengths, np.int64)
    order = np.argsort(-n, kind="stable")
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    place = np.arange(n.sum()) - np.repeat(first, n)
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    lines = np.lexsort((np.repeat(rank, n), place))
    starts = np.concatenate([[0], np.cumsum(np.bincount(place))]) if len(place) else np.zeros(1, np.int64)
    return lines, starts


def messages(unary: np.ndarray, layout: tuple[np.ndarray, np.ndarray], moves: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Places as (begin, end) and, in the layout's order, the unary scores and what lines hear from both sides.

    Log-odds carry the messages: with two labels one number a line is enough each way.
    """
    lines, starts = layout
    u = unary[lines]
    ahead, behind = u.copy(), np.zeros_like(u)
    (m00, m01), (m10, m11) = moves
    spans = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
    wide = next((k for k, (s, e) in enumerate(spans) if e - s <= FEW), len(spans))  # places only get narrower
    for (s0, _), (s, e) in zip(spans[:wide], spans[1:wide], strict=False):
        x = ahead[s0 : s0 + e - s]
        ahead[s:e] += np.logaddexp(m01, x + m11) - np.logaddexp(m00, x + m10)
    if wide < len(spans):
        first = spans[max(wide - 1, 0)][0]
        own, there, back = u[first:].tolist(), ahead[first:].tolist(), [0.0] * (len(u) - first)
        narrow = [(s0 - first, s - first, e - s) for (s0, _), (s, e) in zip(spans[max(wide - 1, 0) :], spans[max(wide, 1) :], strict=False)]
        for s0, s, n in narrow:
            for k in range(n):
                x = there[s0 + k]
                there[s + k] += _log_add(m01, x + m11) - _log_add(m00, x + m10)
        for s0, s, n in reversed(narrow):
            for k in range(n):
                x = own[s + k] + back[s + k]
                back[s0 + k] = _log_add(m10, x + m11) - _log_add(m00, x + m01)
        ahead[first:], behind[first:] = there, back
    for (s0, _), (s, e) in zip(spans[:wide][-2::-1], spans[:wide][:0:-1], strict=False):
        x = u[s:e] + behind[s:e]
        behind[s0 : s0 + e - s] = np.logaddexp(m10, x + m11) - np.logaddexp(m00, x + m01)
    return spans, u, ahead, behind


def _log_add(a: float, b: float) -> float:
    return (a if a > b else b) + log1p(exp(-abs(a - b)))


def _good(lines: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    good = np.empty_like(ahead)
    good[lines] = 1 / (1 + np.exp(-np.clip(ahead + behind, -700, 700)))
    return good


def line_marginals(unary: np.ndarray, layout: tuple[np.ndarray, np.ndarray], moves: np.ndarray) -> np.ndarray:
    """P(good) of each line, by forward-backward over all documents at once."""
    _, _, ahead, behind = messages(unary, layout, moves)
    return _good(layout[0], ahead, behind)


def marginals(unary: np.ndarray, layout: tuple[np.ndarray, np.ndarray], moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the summed pair marginals [from, to]."""
    spans, u, ahead, behind = messages(unary, layout, moves)
    (m00, m01), (m10, m11) = moves
    pairs = np.zeros((2, 2))
    for (s0, _), (s, e) in zip(spans, spans[1:], strict=False):
        x, y = ahead[s0 : s0 + e - s], u[s:e] + behind[s:e]
        joint = np.stack([np.full_like(x, m00), m01 + y, m10 + x, m11 + x + y])
        joint = np.exp(joint - joint.max(axis=0))
        pairs += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return _good(layout[0], ahead, behind), pairs


def document_means(good: np.ndarray, line_bytes: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Per document the mean of its lines' P(good), weighted by their length (an empty line weighs one byte)."""
    weight = line_bytes + 1.0
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def train(features: np.ndarray, line_bytes: np.ndarray, lengths: list[int], labels: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """Fits the field by adaptive gradient steps, then the curve from mean marginal to document label."""
    docs = len(lengths)
    if not docs:
        return Field(np.zeros(WIDTH), np.zeros((2, 2)))
    y = np.repeat(labels, lengths).astype(float)
    share = 1.0 / np.repeat(lengths, lengths)  # documents count alike, however many lines they have
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    inner = np.ones(len(y), bool)
    inner[first] = False
    seen = np.array([[(1 - y[inner]).sum(), 0.0], [0.0, y[inner].sum()]])
    weights, moves = np.zeros(WIDTH), np.zeros((2, 2))
    squares, move_squares = np.full(WIDTH, 1e-8), np.full((2, 2), 1e-8)
    layout = chains(lengths)
    for _ in range(steps):
        good, pairs = marginals(features @ weights, layout, moves)
        step = features.T @ ((y - good) * share) / docs - penalty * weights
        move = (seen - pairs) / len(y) - penalty * moves * 10
        squares += step * step
        move_squares += move * move
        weights = weights + 0.5 * step / np.sqrt(squares)
        moves = np.clip(moves + 0.1 * move / np.sqrt(move_squares), -2, 2)
    field = Field(weights, moves)
    x = _logit(document_means(line_marginals(features @ weights, layout, moves), line_bytes, lengths))
    slope, shift = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        slope += 0.05 * float(((labels - p) * x).mean())
        shift += 0.2 * float((labels - p).mean())
    field.slope, field.shift = max(slope, 1e-3), shift
    return field


def scores(field: Field, texts: list[str]) -> np.ndarray:
    """Document scores between 0 and 1."""
    parts = [line_scores(t.encode(), field.weights) for t in texts]
    lengths = [len(p[1]) for p in parts]
    good = line_marginals(np.concatenate([p[0] for p in parts]), chains(lengths), field.moves)
    x = _logit(document_means(good, np.concatenate([p[1] for p in parts]), lengths))
    return 1 / (1 + np.exp(-(field.slope * x + field.shift)))


def _score_rows(field: Field):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                names = [n for n in batch.schema.names if n != "text"]
                found = scores(field, batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.float64())], names=[*names, "score"])

    return rows


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces ``text`` by its lines' features and lengths, as bytes."""
    for whole in batches:
        for batch in slices(whole):
            found = [line_features(t.encode()) for t in batch.column("text").to_pylist()]
            names = [n for n in batch.schema.names if n != "text"]
            made = [pa.array([f.astype("<f4").tobytes() for f, _ in found], pa.binary()), pa.array([n.astype("<i8").tobytes() for _, n in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], names=[*names, "features", "line_bytes"])


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES) -> Field:
    """Trains on the labelled rows, not held out, whose id hashes lowest; both bounds are parameters.

    At most ``fit_docs`` documents are drawn, and of these as many, in the order of the draw,
    as have ``fit_lines`` lines together (a longer one is passed over): whole documents always.
    Of rows that share an id one counts.
    """
    usable = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = usable.withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "doc_id").limit(fit_docs)
    texts = with_text(docs, "doc_id").join(F.broadcast(drawn), "doc_id").groupBy("draw", "doc_id", "quality").agg(F.min("text").alias("text"))
    texts = settle(texts.withColumn("lines", F.regexp_count("text", F.lit("\n")) + 1))
    left, taken = fit_lines, []
    for r in texts.select("draw", "lines").orderBy("draw", "doc_id").collect():  # at most ``fit_docs`` rows
        if r["lines"] <= left:
            taken.append(r["draw"])
            left -= r["lines"]
    shape = "draw long, doc_id long, quality int, features binary, line_bytes binary"
    kept = texts.join(F.broadcast(docs.sparkSession.createDataFrame([(d,) for d in taken], "draw long")), "draw", "left_semi")
    rows = kept.select("draw", F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text").mapInArrow(_feature_rows, shape)
    parts, marks = [], []
    for r in rows.orderBy("draw", "doc_id").toLocalIterator():  # at most ``fit_lines`` lines
        parts.append((np.frombuffer(r["features"], "<f4").reshape(-1, WIDTH).astype(float), np.frombuffer(r["line_bytes"], "<i8")))
        marks.append(r["quality"])
    if not parts:
        return train(np.zeros((0, WIDTH)), np.zeros(0), [], np.zeros(0))
    return train(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [len(p[1]) for p in parts], np.array(marks, float))


def score_quality(docs: DataFrame, labels: DataFrame | None = None, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only the text enters a score, and all of it.  Null texts count as empty: one empty line.  Repeated rows
    score alike; without labelled rows every score is one half; an empty table gives an empty
    result; other columns are not read.
    """
    field = field or fit(docs, labels)
    shape = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    rows = with_text(docs, "doc_id").select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_score_rows(field), shape).withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))
