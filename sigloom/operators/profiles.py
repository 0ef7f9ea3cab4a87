"""Scoring matrices per cluster, their distance to reference profiles, and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sigloom.functions.residues import ALPHABET, CENTRE
from sigloom.functions.special import LOWEST, clipped, masked_log2
from sigloom.operators.sequence import complete


def levelled(matrix: DataFrame, value: str, *keys: str, skip_centre: bool) -> DataFrame:
    """Values over their mean among the residues of the position; the centre is left as it is if asked."""
    mean = F.avg(value).over(W.partitionBy(*keys, "pos"))
    ratio = F.col(value) / F.when(mean == 0, F.lit(None)).otherwise(mean)
    return matrix.withColumn(value, F.when(F.col("pos") == CENTRE, F.col(value)).otherwise(ratio) if skip_centre else ratio)


def control(count_matrix: DataFrame) -> DataFrame:
    """pos, aa, score: log2 of counts over the position's mean; an absent residue has the lowest number."""
    rows = levelled(count_matrix, "cnt", skip_centre=False)
    return rows.select("pos", "aa", F.when(F.col("cnt") > 0, F.log2("cnt")).when(F.col("cnt") == 0, F.lit(LOWEST)).otherwise(F.lit(0.0)).alias("score"))


def offset_weights(resp: DataFrame, k: int) -> DataFrame:
    """``resp`` (pep_id, cluster, r, hard) with the weights of the cluster before, the last one's for the first; hard counts stay."""
    moved = resp.select("pep_id", ((F.col("cluster") + 1) % k).cast("int").alias("cluster"), "r")
    return resp.drop("r").join(moved, ["pep_id", "cluster"])


def scoring(residues: DataFrame, resp: DataFrame, background: DataFrame | None = None, psp: bool = False) -> DataFrame:
    """cluster, pos, aa, score between 0 and 3, of the clusters with a hard member.

    ``residues`` (pep_id, pos, aa); ``resp`` (pep_id, cluster, r, hard).  Weighted counts over
    the position's mean, over the background's, as masked log2; at the centre S, T and Y are
    hard counts over their mean.  ``background`` (pos, aa, cnt) defaults to all residues; with
    ``psp`` it is (pos, aa, score), logs as of ``control``, by which the ratios are divided as
    they are, at the centre too.
    """
    spark = residues.sparkSession
    base = residues.groupBy("pos", "aa").agg(F.count(F.lit(1)).alias("cnt")) if background is None else background
    if psp:
        bg = background.select("pos", "aa", F.col("score").alias("bg"))
    else:
        bg = levelled(complete(spark, base).withColumn("cnt", F.col("cnt").cast("double")), "cnt", skip_centre=True).withColumnRenamed("cnt", "bg")
    there = resp.groupBy("cluster").agg(F.sum("hard").alias("n")).filter("n > 0")
    joined = residues.join(resp.join(F.broadcast(there.select("cluster")), "cluster", "left_semi"), "pep_id")  # a row per cluster
    soft = joined.groupBy("cluster", "pos", "aa").agg(F.sum("r").alias("cnt"), F.sum("hard").alias("n"))
    full = complete(spark, soft, "cluster").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = levelled(full, "cnt", "cluster", skip_centre=True).join(F.broadcast(bg), ["pos", "aa"])
    score = masked_log2(F.when(F.col("bg") != 0, F.col("cnt") / F.col("bg")))
    acceptor = (F.col("pos") == CENTRE) & F.col("aa").isin("S", "T", "Y")
    mean = F.avg(F.when(acceptor, F.col("n"))).over(W.partitionBy("cluster", "pos"))
    centre = F.when((F.col("n") > 0) & (mean > 0), F.log2(F.col("n") / mean)).otherwise(F.lit(0.0))
    value = F.when(acceptor, centre).otherwise(F.coalesce(score, F.lit(0.0)))
    return rows.withColumn("v", value).select("cluster", "pos", "aa", clipped(F.col("v"), 0.0, 3.0).alias("score"))


def information(matrix: DataFrame) -> DataFrame:
    """cluster, total: the sum of scores but for the centre."""
    return matrix.filter(F.col("pos") != CENTRE).groupBy("cluster").agg(F.sum("score").alias("total"))


def permuted(matrix: DataFrame, order: list[int]) -> DataFrame:
    """The matrix with position ``order[i]`` moved to ``i``."""
    moves = matrix.sparkSession.createDataFrame([(p, i) for i, p in enumerate(order)], "pos int, to int")
    return matrix.join(F.broadcast(moves), "pos").select("cluster", F.col("to").alias("pos"), "aa", "score")


def shuffle_order(moved: list[int]) -> list[int]:
    """Positions after a shuffle: the nine others in the order ``moved``, the centre back in its place, then the last at 1."""
    order = [*moved[:CENTRE], CENTRE, *moved[CENTRE:]]
    return [order[0], 10, *order[1:]]


def distances(matrix: DataFrame, profiles: DataFrame) -> DataFrame:
    """kinase, cluster, d: Frobenius distance over nine slots (positions 0-4 and 6-9) and the residues."""
    slot = F.when(F.col("pos") < CENTRE, F.col("pos")).otherwise(F.col("pos") - 1)
    ours = matrix.filter((F.col("pos") != CENTRE) & (F.col("pos") != 10)).select("cluster", slot.alias("slot"), "aa", "score")
    theirs = profiles.select("kinase", F.col("pos").alias("slot"), "aa", F.col("score").alias("profile"))
    pairs = ours.join(theirs, ["slot", "aa"])
    return pairs.groupBy("kinase", "cluster").agg(F.sqrt(F.sum(F.pow(F.col("score") - F.col("profile"), 2))).alias("d"))


def centred(dist: DataFrame) -> DataFrame:
    """Distances less their mean per kinase, then less the mean per cluster."""
    by_kinase = dist.withColumn("d", F.col("d") - F.avg("d").over(W.partitionBy("kinase")))
    return by_kinase.withColumn("d", F.col("d") - F.avg("d").over(W.partitionBy("cluster")))


def acceptors(matrix: DataFrame, mode: str = "argmax") -> DataFrame:
    """cluster, acceptor: the class of the centre's highest score, or ``S/T`` for every cluster by ``always_st``."""
    if mode not in ("argmax", "always_st"):
        raise ValueError("mode is argmax or always_st")
    order = F.struct("score", -F.position(F.col("aa"), F.lit(ALPHABET)))
    top = matrix.filter(F.col("pos") == CENTRE).groupBy("cluster").agg(F.max_by("aa", order).alias("aa"))
    found = F.when(F.col("aa").isin("S", "T"), F.lit("S/T")).otherwise(F.col("aa")) if mode == "argmax" else F.lit("S/T")
    return top.select("cluster", found.alias("acceptor"))


def upstream(residues: DataFrame, resp: DataFrame, profiles: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """kinase, cluster, d: the clusters' matrices against the profiles; ``background`` holds the control matrix of other windows."""
    return distances(scoring(residues, resp, background, psp=background is not None), profiles)


def shuffled_distances(matrix: DataFrame, profiles: DataFrame, order: list[int], kinase: str) -> DataFrame:
    """kinase, cluster, d, shuffled: the distances of one profile before and after a shuffle of the matrices' positions."""
    own = profiles.filter(F.col("kinase") == kinase)
    before = distances(matrix, own).withColumn("shuffled", F.lit(False))
    return before.unionByName(distances(permuted(matrix, order), own).withColumn("shuffled", F.lit(True)))


def nearest(dist: DataFrame, hits: int, classes: DataFrame | None = None, acceptor: DataFrame | None = None) -> DataFrame:
    """The ``hits`` nearest kinases of each cluster, of the cluster's acceptor class if classes are given."""
    rows = dist
    if classes is not None:
        known = rows.join(F.broadcast(classes), "kinase", "left")  # a row per profile
        missing = F.raise_error(F.concat(F.lit("no class for: "), "kinase"))
        rows = known.withColumn("class", F.when(F.col("class").isNull(), missing).otherwise(F.col("class")))
        rows = rows.join(F.broadcast(acceptor), "cluster").filter(F.col("class") == F.col("acceptor"))
    place = F.row_number().over(W.partitionBy("cluster").orderBy("d", "kinase"))
    return rows.withColumn("place", place).filter(F.col("place") <= hits)
