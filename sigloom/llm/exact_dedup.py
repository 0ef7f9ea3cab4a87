"""Exact duplicates by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks.  A chunk's fingerprint is its polynomial
value modulo two 31-bit primes, and neighbours combine by length-shifted arithmetic:
``h(xy) = h(x) * base**len(y) + h(y)``.  Texts of up to ``huge_bytes`` are folded where
they are read; the chunks of longer ones are spread over the cluster, hashed one by one
and summed, each shifted by the bytes that follow it.

Rows whose length and fingerprint agree are then compared chunk by chunk: per chunk
place the smallest and largest bytes of the whole group are aggregated (with map-side
combination, so a group of any size costs each task one row per chunk), and equal ends
prove equality.  A group that fails is split by content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import raw_bytes, settle, slices, with_text

#: (prime, base) of the two residues.
RINGS = ((2147483647, 1103515245), (2147483629, 1566083941))
#: Bytes per chunk; a chunk's dot product with the powers stays under 255 * 2**31 * 2**14 < 2**63.
CHUNK_BYTES = 1 << 14
#: Texts longer than this are hashed by chunks in parallel.
HUGE_BYTES = 1 << 15
#: Rows with equal fingerprints up to which their keys are broadcast to the texts, in some 40 MB; the texts of more are joined by shuffling.
BROADCAST_ROWS = 500_000


def powers(prime: int, base: int, n: int) -> np.ndarray:
    """``base**(n-1) .. base**0`` modulo ``prime``."""
    out = np.empty(n, np.int64)
    value = 1
    for k in range(n - 1, -1, -1):
        out[k] = value
        value = value * base % prime
    return out


def chunk_value(data: np.ndarray, table: np.ndarray, prime: int) -> int:
    """The polynomial value of one chunk of at most ``CHUNK_BYTES`` bytes."""
    return int(np.dot(data.astype(np.int64), table[len(table) - len(data) :])) % prime if len(data) else 0


def combine(left: int, right: int, right_len: int, prime: int, base: int) -> int:
    """The fingerprint of two neighbours from theirs alone; associative."""
    return (left * pow(base, right_len, prime) + right) % prime


def fold(data: np.ndarray, tables: list[np.ndarray]) -> tuple[int, int]:
    """Both residues of a whole text."""
    halves = []
    for (prime, base), table in zip(RINGS, tables, strict=True):
        value = 0
        for start in range(0, len(data), CHUNK_BYTES):
            part = data[start : start + CHUNK_BYTES]
            value = combine(value, chunk_value(part, table, prime), len(part), prime, base)
        halves.append(value)
    return halves[0], halves[1]


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces ``text`` by its residues l and r, shifted by the ``after`` bytes that follow it, if named."""
    tables = [powers(p, b, CHUNK_BYTES) for p, b in RINGS]
    for whole in batches:
        for batch in slices(whole):
            data, at = raw_bytes(batch.column("text"))
            pairs = [fold(data[s:e], tables) for s, e in zip(at[:-1], at[1:], strict=True)]
            names = [n for n in batch.schema.names if n not in ("text", "after")]
            if "after" in batch.schema.names:
                (p0, b0), (p1, b1) = RINGS
                after = batch.column("after").to_pylist()
                pairs = [(l * pow(b0, n, p0) % p0, r * pow(b1, n, p1) % p1) for (l, r), n in zip(pairs, after, strict=True)]
            sides = [pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + sides, names=[*names, "l", "r"])


def _pieces(text: Column) -> Column:
    """(no, piece) over the bytes of a text; the empty text has one empty piece."""
    data = text.cast("binary")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / F.lit(CHUNK_BYTES)).cast("int"))
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(i.alias("no"), F.substring(data, i * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)).alias("piece")),
    )


def _rows(docs: DataFrame) -> DataFrame:
    return with_text(docs, "doc_id").withColumn("row_key", F.xxhash64("doc_id", "text"))


def fingerprint(docs: DataFrame, huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """doc_id, row_key, bytes, sha, l, r: one row per row of ``docs``.

    Null texts count as empty.  Only the chunks of texts over ``huge_bytes`` are shuffled.
    """
    rows = _rows(docs).withColumns({"bytes": F.octet_length("text").cast("long"), "sha": F.sha2(F.col("text").cast("binary"), 256)})
    keys = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("row_key", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("sha", T.StringType())]
    sides = [T.StructField("l", T.LongType()), T.StructField("r", T.LongType())]
    names = [k.name for k in keys]

    small = rows.filter(F.col("bytes") <= huge_bytes).select(*names, "text").mapInArrow(_fold_rows, T.StructType(keys + sides))

    huge = rows.filter(F.col("bytes") > huge_bytes).select(*names, F.explode(_pieces(F.col("text"))).alias("c"))
    after = F.greatest(F.lit(0).cast("long"), F.col("bytes") - (F.col("c.no").cast("long") + 1) * CHUNK_BYTES)
    spread = huge.select(*names, F.col("c.no").alias("no"), after.alias("after"), F.col("c.piece").alias("text")).repartition(F.xxhash64("row_key", "no"))
    hashed = spread.mapInArrow(_fold_rows, T.StructType([*keys, T.StructField("no", T.IntegerType()), *sides]))
    # rows that repeat doc_id and text add the same residues again: the exact sums are divided by their number
    copies = F.count_if(F.col("no") == 0).alias("copies")
    summed = hashed.groupBy(*names).agg(F.sum("l").alias("l"), F.sum("r").alias("r"), copies)
    one = [F.expr(f"(l div copies) % {RINGS[0][0]}").alias("l"), F.expr(f"(r div copies) % {RINGS[1][0]}").alias("r")]
    whole = summed.select(*names, *one, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    return small.unionByName(whole)


def differing(docs: DataFrame, prints: DataFrame, groups: DataFrame) -> DataFrame:
    """bytes, l, r of the groups that share length and fingerprint but not every chunk."""
    key = ["bytes", "l", "r"]
    members = prints.join(groups.filter("group_size > 1").select(*key), key, "left_semi")
    # gathered by row, not by group, so that a large group's rows leave the join's partitions
    members = settle(members.groupBy("row_key").agg(F.collect_set(F.struct(*key)).alias("g")).select("row_key", F.explode("g").alias("g")).select("row_key", "g.*"))
    # other texts stay where they are read
    members = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    texts = _rows(docs).select("row_key", "text").join(members, "row_key")
    chunks = texts.select(*key, F.explode(_pieces(F.col("text"))).alias("c")).select(*key, "c.no", "c.piece")
    ends = chunks.groupBy(*key, "no").agg(F.min("piece").alias("least"), F.max("piece").alias("most"))
    return ends.filter("least <> most").select(*key).distinct()


def exact_duplicates(docs: DataFrame, huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; null counts as empty; of equal texts the
    largest doc_id stays (a null id only where all are null).  Where rows repeat a doc_id
    with the same text, each is returned and exactly one is kept.  Texts of any length are
    compared whole.  An empty table gives an empty result.  Other columns of ``docs`` are not read.
    """
    key = ["bytes", "l", "r"]
    # settled rows keep their places, so a row's number tells it from its equals
    prints = settle(fingerprint(docs, huge_bytes)).withColumn("row", F.monotonically_increasing_id())
    sums = [F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")]
    # settled, so that joins with them have their shuffles next to them and a group's rows can be split over tasks
    groups = settle(prints.groupBy(*key).agg(*sums))
    split = settle(differing(docs, prints, groups))
    parted = prints.withColumn("part", F.lit(""))
    if not split.isEmpty():
        groups = groups.join(split, key, "left_anti").withColumn("part", F.lit(""))
        apart = prints.join(split, key, "left_semi").withColumn("part", F.col("sha"))
        parted = prints.join(split, key, "left_anti").withColumn("part", F.lit("")).unionByName(apart)
        groups = settle(groups.unionByName(apart.groupBy(*key, "part").agg(*sums)))
        key = [*key, "part"]
    return parted.join(groups, key).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.col("sha").alias("text_sha256"))
