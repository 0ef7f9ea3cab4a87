"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, repeated where its target
exceeds its size, and a document is served in packets of at most ``PACKET_WORDS`` words, so
that a long one doesn't hold up its source's share.  A packet's virtual finish time is the
cumulative words of its source up to and with it, divided by the source's target.  All
packets are range-sorted by these times, and service ends where their running sum reaches
the total budget: the last packet counts as far as the budget goes.  The words that a
source is served stay within about a packet of its target.

Cumulative sums never walk a whole source, or the whole schedule, in one task.  Inside a
source documents fall into buckets of the shuffled order; bucket totals (one small row each)
give the start of each bucket, and only inside a bucket are rows summed in order.  The
schedule is laid out by ranges of finish time; a total for each range gives its start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sigloom.llm.common import settle

#: Weights of the sources in code point order, over and over; share of all words; most repeats of a document.
WEIGHTS, SHARE, MOST_REPEATS = (3, 1, 2), 1.5, 2
SEED = "mix-1"
#: Sources up to which their targets are broadcast; a longer list is joined by shuffling.
BROADCAST_SOURCES = 10_000
#: Documents of the largest source in a bucket, about, and the fewest buckets; they grow with the table.
BUCKET_ROWS, LEAST_BUCKETS = 4_000, 256
#: Words of a packet, at most.
PACKET_WORDS = 128
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of runs of other characters than the six ASCII white-space ones; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fair_targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> dict[str | None, float]:
    """Target words per source: shares by weight, none above ``repeats`` times its size.

    Sources are weighed in code point order, null last.  The level ``rate`` is the excess
    reshared until it holds: with sources by ``repeats * size / weight``, those that reach
    their limit first come first, and the rest share what these leave.
    """
    named = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weighed = [(name, size, weights[k % len(weights)]) for k, (name, size) in enumerate(named)]
    budget = share * sum(size for _, size in sizes)
    queue = sorted(weighed, key=lambda x: (repeats * x[1] / x[2], x[0] is None, x[0] or ""))
    used, heavy = 0, sum(w for _, _, w in queue)
    targets: dict[str | None, float] = {}
    for k, (name, size, weight) in enumerate(queue):
        rate = (budget - used) / heavy
        if repeats * size / weight >= rate:
            targets |= {n: float(w * rate) for n, _, w in queue[k:]}
            break
        targets[name] = float(repeats * size)
        used += repeats * size
        heavy -= weight
    return targets


def shuffle_key(seed: str = SEED) -> Column:
    """The place of a document in the shuffled order: a hash of its id and text, so that reruns agree and rows without an id spread."""
    own = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))


def row_key() -> Column:
    """Rows that agree in it are the same document, told apart by their turn only."""
    return F.xxhash64("doc_id", "source", "text")


def queue_places(sized: DataFrame, targets: DataFrame, rows_in_largest: int) -> DataFrame:
    """``sized`` (row, doc_id, source, size, key, more) with source_size, target and ``before``: the words of its source ahead of it."""
    buckets = max(LEAST_BUCKETS, -(-rows_in_largest // BUCKET_ROWS))
    keyed = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    keyed = keyed.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("int"))
    ahead = F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(ahead, F.lit(0)).alias("bucket_before"))
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("before", F.col("ahead") + F.col("bucket_before")).drop("s", "b", "bucket", "ahead", "bucket_before", "key")


def packets(placed: DataFrame, repeats: int, most: int) -> DataFrame:
    """A row for each packet of each round: words, upto (words of its source up to its end) and finish (virtual finish time).

    A document without words is one empty packet.
    """
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(most)).cast("int"))
    cut = placed.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("packet", F.explode(F.sequence(F.lit(0), count - 1)))
    end = F.least(F.col("size"), (F.col("packet") + 1).cast("long") * most)
    cut = cut.withColumn("words", end - F.col("packet").cast("long") * most).withColumn("upto", F.col("round") * F.col("source_size") + F.col("before") + end)
    return cut.withColumn("finish", F.when(F.col("target") > 0, F.col("upto") / F.col("target")).otherwise(F.lit(0.0))).drop("before", "packet")


def _cut_rows(starts: dict[int, int], budget: int):
    """Replaces ``words`` of packets in the order of their finish by what the budget leaves for them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent: dict[int, int] = {}
        for batch in batches:
            part, words = (np.asarray(batch.column(n)).astype(np.int64) for n in ("part", "words"))
            ahead = np.zeros(len(words), np.int64)
            for p in np.unique(part).tolist():
                own = part == p
                upto = spent.get(p, starts[p]) + np.cumsum(words[own])
                ahead[own] = upto - words[own]
                spent[p] = int(upto[-1])
            served = np.clip(budget - ahead, 0, words)
            kept = [n for n in batch.schema.names if n not in ("part", "words")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(served)], names=[*kept, "served"])

    return rows


def serve(schedule: DataFrame, budget: int) -> DataFrame:
    """Range-sorts the packets by finish time and cuts them where their running sum reaches the budget.

    ``words`` gives way to ``served``.  The layout is settled with its ranges' numbers; what
    travels to the driver and back is one number a range.
    """
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("upto"), F.col("row")]
    laid = settle(schedule.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).drop("source", "upto"))
    totals = {r["part"]: r["n"] for r in laid.groupBy("part").agg(F.sum("words").alias("n")).collect()}  # a row per range
    starts, ahead = {}, 0
    for part in sorted(totals):
        starts[part] = ahead
        ahead += totals[part]
    kept = [f for f in laid.schema.fields if f.name not in ("part", "words")]
    return laid.mapInArrow(_cut_rows(starts, budget), T.StructType([*kept, T.StructField("served", T.LongType())]))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS, seed: str = SEED, packet_words: int = PACKET_WORDS) -> DataFrame:
    """The packets after the cut: row, doc_id, row_key, size, source_size, target, round (0 first), finish, served (words)."""
    text_of = docs.select("doc_id", "source", row_key().alias("row_key"), words(F.col("text")).alias("size"), shuffle_key(seed).alias("key"))
    sized = settle(text_of).withColumn("row", F.monotonically_increasing_id())
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).collect()  # a row per source
    spark = docs.sparkSession
    targets = fair_targets([(r["source"], r["source_size"]) for r in totals], weights, share, repeats)
    kind = docs.schema["source"].dataType
    shape = T.StructType([T.StructField("of", kind), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    table = spark.createDataFrame([(r["source"], r["source_size"], targets[r["source"]]) for r in totals], shape)
    if len(totals) <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    placed = queue_places(sized, table, max((r["rows"] for r in totals), default=0))
    # the targets add up to half words at most, but for rounding
    budget = math.floor(sum(targets.values()) + 1e-3)
    return serve(packets(placed, repeats, packet_words), budget)


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (repeats counted).

    Size is the number of words of the whole text; null and empty texts have none and are
    taken for none.  A null source is a source.  Rows that repeat a doc_id are documents of
    their own; of packets that finish together the source that comes first in code point order
    is served first.  An empty table gives an empty result.  Other columns are not read.
    """
    whole = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return mix(docs, **options).groupBy("row").agg(*whole, F.sum("served").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: each document served, range-sorted by virtual finish time.

    A document that two rounds serve comes twice.  One that is in service when the budget ends
    is taken if at least half of it was served: documents stay whole.  Documents without words
    (null, empty, blank) have nothing to serve and go.  An empty table gives an empty result.
    """
    served = mix(docs, **options).groupBy("row", "round").agg(F.first("row_key").alias("row_key"), F.first("size").alias("size"), F.sum("served").alias("taken"), F.max("finish").alias("finish"))
    entries = served.filter("taken > 0 and 2 * taken >= size").select("row_key", "round", "finish")
    turn = W.partitionBy("row_key", "round").orderBy("finish")
    entries = entries.repartition("row_key").select("row_key", "finish", F.row_number().over(turn).alias("entry_turn"))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), row_key().alias("row_key"))
    rows = keyed.withColumn("row_turn", F.row_number().over(W.partitionBy("row_key").orderBy("row_key")))
    # written as a difference so that the join's only key is the one by which both sides lie
    met = rows.join(entries, "row_key").filter(F.col("row_turn") - F.col("entry_turn") == 0)
    return met.repartitionByRange("finish").sortWithinPartitions("finish").select("doc.*")
