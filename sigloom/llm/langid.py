"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per document: the likelihood of its text
under byte-trigram models, the language that its markup declares, the suffix of its
address, and a prior for its host.  Host priors are smoothed hierarchically: a host's
expected language counts lean on its registered domain's, and these on the whole table's;
all three are grouped aggregations of soft counts, and a document's own share is taken out
before it meets its host's prior.  A language that none of the models knows has a model of
its own, in which every trigram is equally likely; documents that it wins are rejected.

Texts are read once and only a row of log-likelihoods per document travels on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sigloom.llm.common import raw_bytes, settle, slices

#: Trigram cells. Distinct trigrams may share one.
CELLS = 1 << 16
#: Labelled rows from which each language's trigram model is fitted, at most.
FIT_ROWS = 3_000
#: Overlapping trigrams are not independent: their log-likelihood counts by this factor.
TEMPER = 0.25
#: Share of declarations that are right; share of addresses under a language's own suffix that are in it.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
#: Documents' worth of belief that a host borrows from its domain, and a domain from the table.
BORROWED = 20.0
UNKNOWN, UNKNOWN_PRIOR = "und", 1e-4
#: Country suffixes whose language is one of few; others say nothing.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}


def cells(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram cells of each text's letters, end to end, and the row offsets into them.

    ASCII letters lose their case, bytes beyond ASCII stay, and all else is a space; a
    trigram of three spaces or one that crosses texts counts for nothing (cell -1).
    """
    table = np.full(256, 32, np.int64)
    table[65:91] = table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    plain = table[data]
    out = np.full(len(data), -1, np.int64)
    if len(data) > 2:
        code = (plain[:-2] << 16) + (plain[1:-1] << 8) + plain[2:]
        cell = (code * 2654435761 >> 13) % CELLS
        cell[code == 0x202020] = -1
        out[:-2] = cell
        for back in (1, 2):
            ends = at[1:] - back
            out[ends[ends >= 0]] = -1
    return out, at


def _count_rows(langs: list[str]):
    """Trigram counts per language of a partition of labelled texts, one row each of fixed size."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {lang: np.zeros(CELLS, np.int64) for lang in langs}
        for whole in batches:
            for batch in slices(whole):
                cell, at = cells(*raw_bytes(batch.column("text")))
                for lang, s, e in zip(batch.column("lang").to_pylist(), at[:-1], at[1:], strict=True):
                    own = cell[s:e]
                    counts[lang] += np.bincount(own[own >= 0], minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([counts[x].astype("<i8").tobytes() for x in langs], pa.binary())], names=["lang", "counts"])

    return rows


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and a table of log-probabilities (cell by language, last column: unknown).

    ``labelled`` has row_id, text, lang.  The languages are those of all rows that have a text
    with letters; of each the ``fit_rows`` rows whose id and text hash lowest are used.  That
    number bounds what is read here per language and is a parameter.
    """
    some = labelled.filter("lang is not null").filter(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]") & (F.octet_length("text") > 2)).withColumn("draw", F.xxhash64("row_id", "text"))
    rows_of = some.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n"))  # a row per language
    # a language's draws below a limit that about 1.2 * fit_rows + 50 of them meet: few are left to be ranked, however many rows it has
    share = (F.lit(1.2 * fit_rows + 50) / F.col("n")).alias("share")
    near = some.select("lang", "draw").join(F.broadcast(rows_of.select("lang", share)), "lang").filter(F.col("draw") / F.lit(2.0**64) + 0.5 <= F.col("share")).select("lang", "draw").distinct()
    turn = F.row_number().over(W.partitionBy("lang").orderBy("draw"))
    drawn = settle(near.withColumn("turn", turn).filter(F.col("turn") <= fit_rows).select("lang", "draw"))
    langs = sorted(r["lang"] for r in drawn.select("lang").distinct().collect())  # a row per language
    rows = some.join(F.broadcast(drawn), ["lang", "draw"], "left_semi")
    counts = np.zeros((CELLS, len(langs)), np.int64)
    if langs:
        for r in rows.select("text", "lang").repartition(4).mapInArrow(_count_rows(langs), "lang string, counts binary").toLocalIterator():
            counts[:, langs.index(r["lang"])] += np.frombuffer(r["counts"], "<i8")
    table = np.empty((CELLS, len(langs) + 1), np.float32)
    # unseen cells share 0.05 a cell, but no more than the distinct ones seen: a model of few texts must not be as even as the unknown's
    loose = np.minimum(0.05, (counts > 0).sum(axis=0) / CELLS)
    table[:, :-1] = np.log((counts + loose) / (counts.sum(axis=0) + loose * CELLS))
    table[:, -1] = -np.log(CELLS)
    return langs, table


def _likelihood_rows(table: np.ndarray):
    width = table.shape[1]
    padded = np.vstack([table, np.zeros((1, width), np.float32)])  # cell -1 adds nothing

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=1 << 20):
                cell, at = cells(*raw_bytes(batch.column("text")))
                sums = np.zeros((batch.num_rows, width))
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    for k in range(width):
                        sums[full, k] = np.add.reduceat(padded[:, k][cell].astype(np.float64), at[:-1][full])
                    seen = np.add.reduceat((cell >= 0).astype(np.int64), at[:-1][full])
                grams = np.zeros(batch.num_rows, np.int64)
                if len(full):
                    grams[full] = seen
                names = [n for n in batch.schema.names if n != "text"]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(grams), lists], names=[*names, "grams", "likelihoods"])

    return rows


def text_evidence(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """``rows`` with text replaced by grams and likelihoods (one per language, and unknown)."""
    rest = [f for f in rows.schema.fields if f.name != "text"]
    shape = T.StructType([*rest, T.StructField("grams", T.LongType()), T.StructField("likelihoods", T.ArrayType(T.DoubleType()))])
    texts = rows.select(*(f.name for f in rest), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_likelihood_rows(table), shape)


def normalised(scores: Column) -> Column:
    """Probabilities from an array of log-scores."""
    most = F.array_max(scores)
    shifted = F.transform(scores, lambda x: F.exp(x - most))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def _table(values: dict[str, list[float]], key: Column, width: int) -> Column:
    """A small constant map's entry, or zeros."""
    out = F.array(*[F.lit(0.0)] * width)
    for name, row in values.items():
        out = F.when(key == name, F.array(*[F.lit(float(v)) for v in row])).otherwise(out)
    return out


def fuse(evidence: DataFrame, langs: list[str], temper: float = TEMPER) -> DataFrame:
    """Adds posterior (array, last: unknown), text_lang, lang, probability, accepted.

    ``evidence`` has grams, likelihoods, declared, suffix, host and domain; each of the last
    four may be null and then says nothing.  A text without letters has no text evidence and
    is rejected.
    """
    width = len(langs) + 1
    right = {x: [np.log(DECLARED_RIGHT if y == x else (1 - DECLARED_RIGHT) / max(1, width - 1)) for y in [*langs, UNKNOWN]] for x in langs}
    own = {s: [np.log(SUFFIX_RIGHT if y == x else (1 - SUFFIX_RIGHT) / max(1, width - 1)) for y in [*langs, UNKNOWN]] for s, x in SUFFIXES.items() if x in langs}
    declared = F.regexp_extract(F.lower("declared"), "^([a-z]+)", 1)
    prior = F.array(*[F.lit(float(np.log((1 - UNKNOWN_PRIOR) / max(1, len(langs)))))] * len(langs), F.lit(float(np.log(UNKNOWN_PRIOR))))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    text = F.transform("likelihoods", lambda x: x * F.lit(temper))
    rows = evidence.withColumn("text_score", text)
    rows = rows.withColumn("score", add(add(F.col("text_score"), _table(right, declared, width)), _table(own, F.lower("suffix"), width)))
    rows = settle(rows.withColumn("soft", normalised(add(F.col("score"), prior))).drop("likelihoods"))

    parts = [F.sum(F.col("soft")[k]).alias(f"s{k}") for k in range(width)]
    by_host = rows.groupBy("domain", "host").agg(*parts)
    by_domain = by_host.groupBy("domain").agg(*[F.sum(f"s{k}").alias(f"d{k}") for k in range(width)])
    whole = by_domain.agg(*[F.sum(f"d{k}").alias(f"t{k}") for k in range(width)]).first()
    total = [(whole[k] or 0.0) + 1.0 for k in range(width)]
    base = [x / sum(total) for x in total]
    domain_sum = sum((F.col(f"d{k}") for k in range(1, width)), F.col("d0"))
    host_sum = sum((F.col(f"s{k}") for k in range(1, width)), F.col("s0"))
    by_domain = by_domain.select("domain", *[((F.col(f"d{k}") + BORROWED * base[k]) / (domain_sum + BORROWED)).alias(f"p{k}") for k in range(width)])
    same = F.col("domain").eqNullSafe(F.col("domain2"))
    hosts = by_host.join(by_domain.withColumnRenamed("domain", "domain2"), same).select(F.col("domain").alias("d"), F.col("host").alias("h"), host_sum.alias("n"), F.array(*[f"s{k}" for k in range(width)]).alias("seen"), F.array(*[f"p{k}" for k in range(width)]).alias("lean"))
    joined = rows.join(hosts, F.col("domain").eqNullSafe(F.col("d")) & F.col("host").eqNullSafe(F.col("h")))
    # the document's own soft counts leave its host's before the prior is formed
    rest = F.zip_with("seen", "soft", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    host_prior = F.zip_with(rest, F.col("lean"), lambda a, b: F.log((a + BORROWED * b) / (F.greatest(F.col("n") - 1.0, F.lit(0.0)) + BORROWED)))
    names = F.array(*[F.lit(x) for x in [*langs, UNKNOWN]])
    pick = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    out = joined.withColumn("posterior", normalised(add(F.col("score"), host_prior)))
    found = pick(F.col("posterior"))
    known = (F.col("grams") > 0) & (found != UNKNOWN)
    return out.select(
        *[c for c in evidence.columns if c not in ("likelihoods",)],
        "posterior",
        F.when(F.col("grams") > 0, pick(F.col("text_score"))).otherwise(F.lit(UNKNOWN)).alias("text_lang"),
        F.when(known, found).otherwise(F.lit(UNKNOWN)).alias("found_lang"),
        F.array_max("posterior").alias("probability"),
        known.alias("accepted"),
    )


def identify_documents(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, declared, text_lang, found_lang, probability, accepted.

    ``lang`` is what the document declares and ``source`` is its host; documents have no
    address.  Models are fitted on a bounded sample of the declared languages unless given.
    A null or empty text, or one without letters, is rejected as ``und``.  Texts of any length
    are read whole; of languages that are equally likely the first by name is found.  Repeated
    rows are judged alike; an empty table gives an empty result; other columns are not read.
    """
    langs, table = model or fit(docs.select(F.col("doc_id").alias("row_id"), "text", "lang"))
    rows = docs.select("doc_id", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.lit(None).cast("string").alias("domain"), "text")
    return fuse(text_evidence(rows, table), langs).select("doc_id", "declared", "text_lang", "found_lang", "probability", "accepted")


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, declared, suffix, host, domain and visible text of web pages."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1)
    rows = pages.select("page_id", F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"), bare.alias("text"))
    return rows.select("page_id", "declared", F.substring_index("host", ".", -1).alias("suffix"), "host", F.substring_index("host", ".", -2).alias("domain"), "text")


def identify_pages(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """One row per row of ``pages`` with all four kinds of evidence; missing ones say nothing."""
    langs, table = model
    out = fuse(text_evidence(page_rows(pages), table), langs)
    return out.select("page_id", "host", "declared", "text_lang", "found_lang", "probability", "accepted")
