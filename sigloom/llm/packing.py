"""Packing documents into token sequences by minimum bin slack.

Texts become token ids once, where they are read; only one small row per piece travels
on.  The packer sees a histogram of piece lengths, never the pieces: its size is bounded
by the sequence length, whatever the number of documents.  For each bin, seeded with the
longest piece left, a bitset subset-sum dynamic program over the available lengths finds
the fullest feasible combination; that combination is removed as often as the histogram
allows before the next is sought, so at most one search per distinct length exhausts it.
Pieces then take their places by their rank among those of equal length, and ranks come
from per-bucket counts, so a length that a third of all pieces share is never in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sigloom.llm.common import settle, slices, with_text
from sigloom.llm.tokens import TextEncoder

SEQUENCE_TOKENS = 1024
END_ID = 2
#: Pieces of one length per bucket, about; buckets grow with the table.
BUCKET_ROWS = 20_000


def cut(n_tokens: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than ``most``."""
    first = n_tokens % most or most
    return [(0, min(first, n_tokens))] + [(s, most) for s in range(first, n_tokens, most)]


def fullest(counts: list[int], seed: int, room: int) -> list[int]:
    """Lengths, at most ``room`` in sum, with the largest sum that the bag ``counts`` allows.

    ``counts[k]`` pieces have length ``k``; ``seed`` is left out of nothing: the caller has
    already taken it.  Reachable sums are the bits of an integer; a length available m times
    enters in binary portions, longest length first, and the walk back reads off one choice.
    """
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for length in range(min(room, seed), 0, -1):
        left = min(counts[length], room // length)
        portion = 1
        while left > 0:
            take = min(portion, left)
            wider = (reach | reach << take * length) & mask
            if wider != reach:
                steps.append((length, take, reach))
                reach = wider
            left -= take
            portion *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    chosen: list[int] = []
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            chosen += [length] * take
            best -= take * length
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one bin, number of such bins) that use up the histogram."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] += n
    patterns: list[tuple[list[int], int]] = []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            bin_ = [longest, *fullest(counts, longest, capacity - longest)]
            counts[longest] += 1
            times = min(counts[length] // bin_.count(length) for length in set(bin_))
            for length in bin_:
                counts[length] -= times
            patterns.append((bin_, times))
    return patterns


def places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, past rank, pieces per bin, first bin, offset of the first) per pattern and length."""
    used: dict[int, int] = {}
    out = []
    base = 0
    for bin_, times in patterns:
        offset = 0
        for length in sorted(set(bin_), reverse=True):
            k = bin_.count(length)
            first = used.get(length, 0)
            out.append((length, first, first + k * times, k, base, offset))
            used[length] = first + k * times
            offset += k * length
        base += times
    return out


def _piece_rows(tokenizer_path: str, end_id: int, most: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.shared(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        for whole in batches:
            for batch in slices(whole):
                cols: list[list] = [[], [], [], [], []]
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    own = encoder.encode(text) + end
                    for piece, (start, length) in enumerate(cut(len(own) // 4, most)):
                        for col, value in zip(cols, (doc_id, piece, start, length, zlib.crc32(own[4 * start : 4 * (start + length)])), strict=True):
                            col.append(value)
                kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows


def token_pieces(docs: DataFrame, tokenizer_path: str, most: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's token pieces."""
    shape = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")])
    return with_text(docs, "doc_id").mapInArrow(_piece_rows(tokenizer_path, end_id, most), shape)


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """``pieces`` (doc_id, piece, length in 1..capacity, more) with sequence_id and offset."""
    pieces = settle(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    slots = places(minimum_bin_slack(counts, capacity))
    most = max(counts.values(), default=0)
    buckets = max(16, -(-most // BUCKET_ROWS))
    spark = pieces.sparkSession
    # settled pieces keep their places, so a row's number is the same whenever a task is run again; ids may be null or shared
    bucketed = pieces.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    ahead = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    before = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(ahead, F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = bucketed.withColumn("at", rank).join(before, ["length", "bucket"]).withColumn("rank", F.col("at") + F.col("before"))
    # one row per pattern and length: the patterns are at most ``capacity``, so this stays within a few thousand rows
    table = spark.createDataFrame(slots, "slot_length long, lo long, hi long, k long, base long, first long")
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    step = F.col("rank") - F.col("lo")
    return (
        ranked.join(F.broadcast(table), fits)
        .withColumn("sequence_id", F.col("base") + F.expr("(rank - lo) div k"))
        .withColumn("offset", F.col("first") + (step % F.col("k")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty: one piece with the end id alone.  Texts of any length are
    encoded whole; only those of more ids than ``capacity`` are cut.  Rows that repeat a doc_id
    or have none are documents of their own; which of equal lengths goes where follows the
    rows' places.  An empty table gives an empty result.  Other columns of ``docs`` are not read.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity)
