"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and works on all
that the stage before kept.  All but the last return the columns of ``documents``, and
further ones as they are, whatever their names.

Stages decide by row: an operator is given, in the place of doc_id, the id with a hash of
id, text, lang and source, so rows that share an id or have none are judged one by one.  Null
and empty texts are texts without letters or words.  Texts of any length are read whole.
An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import exact_dedup, langid, mixing, packing, simhash
from sigloom.llm.common import settle, shared_folder, table
from sigloom.llm.queries import TOKENIZER


def _row() -> Column:
    return F.xxhash64("doc_id", "text", "lang", "source")


def _keyed(docs: DataFrame) -> DataFrame:
    """What the operators read, with (id, row) as doc_id."""
    return docs.select(F.struct(F.col("doc_id").alias("id"), _row().alias("row")).alias("doc_id"), "text", "lang", "source")


def _matched(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """doc and row of the rows of ``docs`` that are (``left_semi``) or aren't (``left_anti``) among ``rows``."""
    keys = rows.select(F.col("doc_id.id").alias("of_id"), F.col("doc_id.row").alias("of_row")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("doc"), _row().alias("row"))
    return packed.join(keys, (F.col("row") == F.col("of_row")) & F.col("doc.doc_id").eqNullSafe(F.col("of_id")), how)


def _one_each(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows that stay by ``verdicts`` (doc_id, stays; one per row of ``docs``); of rows that can't be told apart, one."""
    per = settle(verdicts.groupBy("doc_id").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")))
    gone, repeated = per.filter("not stays").select("doc_id"), per.filter("stays and n > 1").select("doc_id")
    if repeated.isEmpty():
        return _matched(docs, gone, "left_anti").select("doc.*")
    alone = _matched(docs, gone.union(repeated), "left_anti").select("doc.*")
    once = _matched(docs, repeated, "left_semi").groupBy("row", "doc.doc_id").agg(F.first("doc").alias("doc"))
    return alone.union(once.select("doc.*"))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letters, or likelier in none of the declared languages."""
    return _matched(docs, langid.identify_documents(_keyed(docs)).filter("not accepted"), "left_anti").select("doc.*")


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null equals empty) the row with the largest doc_id stays."""
    return _one_each(docs, exact_dedup.exact_duplicates(_keyed(docs)).select("doc_id", F.col("kept").alias("stays")))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word similarity of 0.8 or more the one with the smallest doc_id, or none, stays."""
    found = simhash.similar_documents(_keyed(docs))
    return _one_each(docs, found.select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("stays")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix's order, as often as it takes them; those without words go, a null source is a source."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets; rows that share an id or have none are documents of their own."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("language_id", identify), ("exact_dedup", dedup_exact), ("near_dedup", dedup_near), ("source_mix", mix), ("best_fit_packing", pack)]

#: Similarity, tokenizer ids and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again, and deleted once the next stage has read it.

    The last stage settles its pieces before it returns, so nothing reads its input later.
    """
    docs, held = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        path = None
        if k < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        if held:
            _delete(spark, held)
        held = path
    return docs
