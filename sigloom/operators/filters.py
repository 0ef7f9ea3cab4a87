"""Filters and labels of long signal tables: (row key, sample, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sigloom.functions.residues import ALPHABET, WINDOW


def by_ratio(signal: DataFrame, key: str, samples: int, least: float, x: str = "x") -> DataFrame:
    """Keys seen in at least ``least`` of the samples, with how many and the ratio."""
    seen = signal.groupBy(key).agg(F.count(x).alias("n_seen"))
    return seen.withColumn("ratio", F.col("n_seen") / F.lit(samples)).filter(F.col("ratio") >= least)


def by_experiments(signal: DataFrame, key: str, least: int, experiment: str = "experiment", x: str = "x") -> DataFrame:
    """Keys seen in at least ``least`` distinct experiments, with their number."""
    seen = F.countDistinct(F.when(F.col(x).isNotNull(), F.col(experiment)))
    return signal.groupBy(key).agg(seen.alias("n_experiments")).filter(F.col("n_experiments") >= least)


def incomplete(signal: DataFrame, key: str, samples: int, ratio: float | None = None, experiments: int | None = None) -> DataFrame:
    """The signal without rows that miss too much; the ratio decides if both are given."""
    if ratio is None and experiments is None:
        raise ValueError("a ratio or a number of experiments is needed")
    kept = by_ratio(signal, key, samples, ratio) if ratio is not None else by_experiments(signal, key, experiments)
    return signal.join(kept.select(key), key, "left_semi")


def hashed(key: Column, seed: str) -> Column:
    """A whole number from a key, the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def sample_with_replacement(keys: DataFrame, key: str, draws: int | None = None, seed: str = "draw", ratio: float | None = None) -> DataFrame:
    """draw, key: ``draws`` picks by hash, or ``ratio`` of the keys. Keys lie in hash buckets whose counts place every pick."""
    n = keys.count()
    draws = int(n * ratio) if ratio is not None else draws
    if draws is None:
        raise ValueError("a number or a ratio is needed")
    if not n:
        return keys.sparkSession.range(0).select(F.col("id").alias("draw"), F.lit(None).cast(keys.schema[key].dataType).alias(key))
    buckets = max(1, n // 100_000)
    rows = keys.select(key, (F.floor(hashed(F.col(key), "place") * F.lit(buckets) / F.lit(1 << 48))).alias("bucket"))
    ahead = F.coalesce(F.sum("m").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).select("bucket", ahead.alias("ahead"))
    turn = F.row_number().over(W.partitionBy("bucket").orderBy(hashed(F.col(key), "place"), key)) - 1
    numbered = rows.withColumn("turn", turn).join(starts, "bucket").select(key, (F.col("turn") + F.col("ahead")).alias("at"))
    picks = keys.sparkSession.range(draws).select(F.col("id").alias("draw"), F.pmod(hashed(F.col("id"), seed), F.lit(n)).alias("at"))
    return picks.join(numbered, "at").select("draw", key)


def paired(names: DataFrame, name: str = "name", mark: str = ".N", without: str = "IR") -> DataFrame:
    """Patients that have both a marked and an unmarked sample; names that hold ``without`` don't count."""
    rows = names.filter(~F.col(name).contains(without)).select(F.replace(F.col(name), F.lit(mark), F.lit("")).alias("patient"), F.col(name).endswith(mark).alias("marked"))
    return rows.groupBy("patient").agg(F.count_if("marked").alias("a"), F.count_if(~F.col("marked")).alias("b")).filter("a > 0 and b > 0").select("patient")


def bad_sequences(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows whose sequence is null, of another length or beyond the alphabet."""
    good = F.col(seq).rlike(f"(?i)^[{ALPHABET}]{{{WINDOW}}}$")
    return rows.filter(F.coalesce(~good, F.lit(True)))


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one side alone has, and which side."""
    l, r = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    return l.join(r, key, "full_outer").filter("l is null or r is null").select(key, F.when(F.col("l"), "left").otherwise("right").alias("side"))


def require_sequences(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """``rows`` as they are; reading one whose sequence isn't valid is an error that names it."""
    good = F.coalesce(F.col(seq).rlike(f"(?i)^[{ALPHABET}]{{{WINDOW}}}$"), F.lit(False))
    return rows.withColumn(seq, F.when(good, F.col(seq)).otherwise(F.raise_error(F.concat(F.lit("not a sequence: "), F.coalesce(F.col(seq), F.lit("null"))))))


def require_numeric(rows: DataFrame, columns: list[str]) -> None:
    """An error that names the columns that hold no numbers."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    odd = [c for c in columns if not isinstance(kinds[c], T.NumericType)]
    if odd:
        raise ValueError(f"columns without numbers: {', '.join(odd)}")


def drop_null_columns(rows: DataFrame) -> DataFrame:
    """The columns that hold no null, in one pass."""
    found = rows.agg(*[F.bool_or(F.col(f"`{c}`").isNull()).alias(f"c{k}") for k, c in enumerate(rows.columns)]).first()
    return rows.select(*[F.col(f"`{c}`") for k, c in enumerate(rows.columns) if not found[k]])


def labelled(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The row of every one of ``keys``; one without a row is an error that names it."""
    met = keys.select(key).join(rows.withColumn("_there", F.lit(True)), key, "left")
    there = F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no row for: "), F.col(key).cast("string"))))
    return met.withColumn(key, there).drop("_there")


def mutation_flags(mutations: DataFrame, sample: str, names: list[str]) -> DataFrame:
    """The named columns as booleans, for the patients with a marked and an unmarked sample."""
    patients = paired(mutations.select(F.col(sample).alias("name"))).withColumnRenamed("patient", sample)
    return labelled(mutations, patients, sample).select(sample, *[F.col(f"`{n}`").cast("boolean").alias(n) for n in names])


def hot_cold(groups: DataFrame, sample: str = "Sample ID", group: str = "Group") -> DataFrame:
    """sample and hot: whether an unmarked sample is in the hot group; of other groups none is listed.  In the samples' order."""
    whole = drop_null_columns(groups)
    hot = F.when(F.col(group) == "Hot-tumor enriched", True).when(F.col(group) == "Cold-tumor enriched", False)
    rows = whole.select(F.col(f"`{sample}`").alias("sample"), hot.alias("hot"))
    return rows.filter(~F.col("sample").endswith(".N") & F.col("hot").isNotNull()).orderBy("sample")


def go_terms(terms: DataFrame, words: tuple[str, ...] = ("immune", "T cell", "B cell")) -> DataFrame:
    """process, fold, direction of the rows (process, fold, direction) that name one of the words, once for each that they name.

    Folds below the table's precision go; the highest come first.
    """
    named = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.col("process").contains(w))
    rows = terms.withColumn("word", F.explode(named)).filter(F.col("fold") != " < 0.01")
    return rows.select(F.split_part("process", F.lit("(GO"), F.lit(1)).alias("process"), F.col("fold").cast("double").alias("fold"), "direction").orderBy(F.desc("fold"), "process")


def masked_experiment(cells: DataFrame, key: str = "pep_id", seed: str = "mask") -> DataFrame:
    """``cells`` (key, experiment, x, more) with x null in one experiment of each row, picked by hash among those it was seen in."""
    order = F.struct(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"), F.lit(":"), F.col("experiment").cast("string")).cast("binary")), "experiment")
    picked = cells.filter("x is not null").groupBy(F.col(key).alias("_key")).agg(F.min_by("experiment", order).alias("_gone"))
    met = cells.join(picked, F.col(key) == F.col("_key"), "left")
    return met.withColumn("x", F.when(F.col("experiment") == F.col("_gone"), F.lit(None)).otherwise(F.col("x"))).drop("_key", "_gone")
