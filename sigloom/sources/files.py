"""Readers of the bundled file kinds: plain tables, FASTA, profile folders and block tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sigloom.functions.residues import ALPHABET
from sigloom.functions.special import clipped, masked_log2
from sigloom.operators.filters import require_numeric
from sigloom.operators.sequence import map_sites


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A headed table; a byte order mark before the first name is dropped."""
    reader = spark.read.option("header", True)
    rows = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def signal_table(spark: SparkSession, path: str, experiments: str, least: int = 2) -> DataFrame:
    """row, seq, sample, experiment, x of a signal table: the rows seen in at least ``least`` experiments.

    The first column is a number and goes, as do Protein, Gene and Position; Sequence is the
    key; every other column is a sample.  ``experiments`` names a table whose second column is
    the experiment of each sample, in the samples' order.
    """
    raw = csv(spark, path)
    kept = raw.select(*raw.columns[1:]).drop("Protein", "Gene", "Position")
    samples = [c for c in kept.columns if c != "Sequence"]
    require_numeric(kept, samples)
    dealt = csv(spark, experiments)
    groups = [r[0] for r in dealt.select(dealt.columns[1]).collect()]  # a row per sample
    if len(groups) != len(samples):
        raise ValueError(f"{len(samples)} samples, but {len(groups)} experiments")
    cells = F.array(*[F.struct(F.lit(c).alias("sample"), F.lit(g).alias("experiment"), F.col(f"`{c}`").cast("double").alias("x")) for c, g in zip(samples, groups, strict=True)])
    seen = F.size(F.array_distinct(F.transform(F.filter(cells, lambda c: c["x"].isNotNull()), lambda c: c["experiment"])))
    rows = kept.select(F.monotonically_increasing_id().alias("row"), F.col("Sequence").alias("seq"), cells.alias("cells"), seen.alias("seen"))
    return rows.filter(F.col("seen") >= least).select("row", "seq", F.explode("cells").alias("c")).select("row", "seq", "c.*")


def site_table(spark: SparkSession, path: str, proteome: str, without: str = "ARPC2_HUMAN;") -> DataFrame:
    """seq and the value columns of a table of sites (``GENE(S123);``), mapped to windows of their proteins.

    FDR goes, as do the row named ``without`` and the sites that don't map.
    """
    raw = csv(spark, path).drop("FDR").withColumnRenamed("sh.index.sites", "site").filter(F.col("site") != without)
    values = [c for c in raw.columns if c != "site"]
    sites = raw.select(F.split_part("site", F.lit("("), F.lit(1)).alias("gene"), F.regexp_extract("site", r"\(([A-Za-z0-9]+)\)", 1).alias("position"), *[F.col(f"`{c}`") for c in values])
    mapped = map_sites(sites, fasta(spark, proteome, "gene"), *values)
    return mapped.filter("rejected is null").select(F.col("motif").alias("seq"), *[F.col(f"`{c}`") for c in values])


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """name, url, members of a ragged tab-separated file."""
    cut = F.split("value", "\t")
    return spark.read.text(path).select(cut[0].alias("name"), cut[1].alias("url"), F.slice(cut, 3, F.greatest(F.size(cut) - 2, F.lit(0))).alias("members"))


def fasta(spark: SparkSession, path: str, names: str = "full") -> DataFrame:
    """name, seq of multi-line records; of records with one name the last stays.

    ``full`` names stand between ``HUMAN `` and `` OS`` (a record without them is an error);
    ``gene`` names follow `` GN=`` (records without it are left out).
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))  # files may be read in any order
    text = spark.read.text(path, lineSep="\n>").select("value", place.alias("ord"))
    head = F.regexp_extract("value", r"^>?([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    rows = text.select("ord", head.alias("head"), body.alias("seq"))
    if names == "gene":
        named = rows.select("ord", F.regexp_extract("head", r" GN=([^ ]*)", 1).alias("name"), "seq").filter("name <> ''")
    else:
        found = F.regexp_extract("head", r"HUMAN (.*?) OS", 1)
        named = rows.select("ord", F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no name in: "), "head"))).alias("name"), "seq")
    return named.groupBy("name").agg(F.max_by("seq", "ord").alias("seq"), F.max("ord").alias("ord"))


def profile_folder(spark: SparkSession, path: str, skip: str = "pssm_data") -> DataFrame:
    """kinase, pos (0-8), aa, score of a folder of residue-by-offset tables, one file a kinase.

    A file without negative values holds ratios and is taken to log2; files that hold logs stay.
    """
    offsets = ["-5", "-4", "-3", "-2", "-1", "+1", "+2", "+3", "+4"]
    shape = T.StructType([T.StructField("aa", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in offsets)])
    raw = spark.read.schema(shape).option("header", True).option("enforceSchema", True).csv(path, pathGlobFilter="*.csv")
    wide = raw.withColumn("kinase", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)).filter(F.col("kinase") != skip)
    wide = wide.filter(F.length("aa") == 1).filter(F.lit(ALPHABET).contains(F.col("aa")))
    cells = F.posexplode(F.array(*[F.col(f"`{c}`") for c in offsets])).alias("pos", "raw")
    long = wide.select("kinase", "aa", cells)
    least = F.min("raw").over(W.partitionBy("kinase"))
    return long.select("kinase", "pos", "aa", F.when(least >= 0, F.log2("raw")).otherwise(F.col("raw")).alias("score"))


def profile_blocks(spark: SparkSession, path: str) -> DataFrame:
    """kinase, pos (0-8), aa, score of a headerless file of 16-line blocks: a name, then 15 positions by residue columns.

    Rows 2 to 11 but 8 of a block are kept in file order, scores are masked logs between 0 and 3.
    """
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n")).alias("line", "row")).filter("row <> ''")
    cut = whole.select(F.floor(F.col("line") / 16).alias("block"), (F.col("line") % 16).alias("r"), F.split("row", ",").alias("cells"))
    names = cut.filter("r = 0").select("block", F.trim(F.col("cells")[0]).alias("kinase"))
    values = cut.filter("r > 0").withColumn("at", F.col("r") - 1).filter("at between 2 and 11 and at <> 8")
    pos = F.when(F.col("at") < 8, F.col("at") - 2).otherwise(F.col("at") - 3)
    long = values.select("block", pos.cast("int").alias("pos"), F.posexplode("cells").alias("col", "cell")).filter(F.col("col") < 20)
    score = clipped(masked_log2(F.col("cell").cast("double")), 0.0, 3.0)
    return long.join(names, "block").select("kinase", "pos", F.substring(F.lit(ALPHABET), F.col("col") + 1, F.lit(1)).alias("aa"), score.alias("score"))
