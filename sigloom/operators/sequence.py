"""Symbol sequences: windows, counts, position weights, motifs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sigloom.functions.residues import ALPHABET, CENTRE, FREQUENCIES, WINDOW
from sigloom.operators.ordered import running
from sigloom.operators.rounds import settle


#: Distinct prefixes that are broadcast to the proteins, in some 40 MB; more are joined by shuffling.
BROADCAST_PREFIXES = 500_000
#: Letters of distinct peptides that are sent to the proteins as an automaton.
BROADCAST_LETTERS = 4 << 20


def alphabet(spark: SparkSession) -> DataFrame:
    """aa, aa_idx, freq."""
    return spark.createDataFrame([(a, i, f) for i, (a, f) in enumerate(FREQUENCIES.items())], "aa string, aa_idx int, freq double")


def windows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, seq: every window of eleven letters of the alphabet centred on S, T or Y; ASCII letters only, upper case."""
    letters = F.upper(F.regexp_replace(F.col(text), "[^A-Za-z]", ""))
    found = F.regexp_extract_all(letters, F.lit(f"(?=([{ALPHABET}]{{5}}[STY][{ALPHABET}]{{5}}))"), F.lit(1))
    return texts.select(key, F.explode(found).alias("seq"))


def residues(peptides: DataFrame, key: str = "pep_id", seq: str = "seq") -> DataFrame:
    """key, pos, aa: the sparse one-hot form."""
    letters = F.split(F.upper(F.col(seq)), "")
    return peptides.select(key, F.posexplode(F.slice(letters, 1, WINDOW)).alias("pos", "aa"))


def complete(spark: SparkSession, counts: DataFrame, *keys: str) -> DataFrame:
    """counts (keys, pos, aa, cnt) with zeros where a residue does not occur."""
    grid = spark.range(WINDOW).select(F.col("id").cast("int").alias("pos")).crossJoin(alphabet(spark).select("aa"))  # 220 rows
    for k in keys:
        grid = counts.select(k).distinct().crossJoin(F.broadcast(grid))
    return grid.join(counts, [*keys, "pos", "aa"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def counts(rows: DataFrame) -> DataFrame:
    """pos, aa, cnt of (key, pos, aa) rows, completed."""
    return complete(rows.sparkSession, rows.groupBy("pos", "aa").agg(F.count(F.lit(1)).alias("cnt")))


def weights(count_matrix: DataFrame) -> DataFrame:
    """pos, aa, cnt, p with the background frequencies as pseudocounts."""
    lifted = count_matrix.join(F.broadcast(alphabet(count_matrix.sparkSession)), "aa").withColumn("v", F.col("cnt") + F.col("freq"))
    return lifted.select("pos", "aa", "cnt", (F.col("v") / F.sum("v").over(W.partitionBy("pos"))).alias("p"))


def site_counts(peptides: DataFrame, seq: str = "seq") -> DataFrame:
    """Number of windows by their centre: n_y, n_s, n_t."""
    c = F.upper(F.substring(seq, CENTRE + 1, 1))
    return peptides.agg(*[F.count_if(c == x).alias(f"n_{x.lower()}") for x in "YST"])


def quota(spark: SparkSession, background: DataFrame, foreground: DataFrame, order: str, seq: str = "seq") -> DataFrame:
    """The first windows by ``order`` of each centre so that shares follow the foreground's.

    With enough tyrosines, each centre has its share of all; else all tyrosines are taken
    and the others scaled to them.  Windows with ``_`` or ``X`` don't count.
    """
    usable = background.filter(~F.col(seq).contains("_") & ~F.col(seq).contains("X"))
    fore, back = site_counts(foreground, seq).first(), site_counts(usable, seq).first()
    n, total = sum(fore) or 1, sum(back)
    share = {c: fore[f"n_{c}"] / n for c in "yst"}
    size = total if back["n_y"] >= total * share["y"] else int(back["n_y"] / share["y"])
    want = {c: int(size * share[c]) for c in "yst"}
    site = F.upper(F.substring(seq, CENTRE + 1, 1))
    limit = F.when(F.col("site") == "Y", want["y"]).when(F.col("site") == "S", want["s"]).otherwise(want["t"])
    placed = running(usable.withColumn("site", site), ["site"], [F.col(order), F.col(seq)], {"turn": F.lit(1)})
    return placed.filter(F.col("turn") <= limit).drop("turn")


def motif(sequence: Column, at: Column, size: int = CENTRE) -> Column:
    """The window of ``size`` residues around the 0-based place, centre in lower case.

    Dashes fill it where it begins before the sequence, or else where it ends behind it; never both.
    """
    left = F.substring(sequence, F.greatest(F.lit(1), at - size + 1), F.least(at, F.lit(size)))
    right = F.substring(sequence, at + 2, F.lit(size))
    centre = F.lower(F.substring(sequence, at + 1, F.lit(1)))
    return F.concat(F.lpad(left, size, "-"), centre, F.when(at < size, right).otherwise(F.rpad(right, size, "-")))


def map_sites(sites: DataFrame, proteome: DataFrame, *keep: str) -> DataFrame:
    """sites (gene, position like S123, and the columns to ``keep``) with motif and why it is rejected, if it is.

    Rejected: no such gene, a window that is not whole, another residue at the place, or
    none of S, T, Y.
    """
    at = (F.try_to_number(F.substring(F.col("position"), F.lit(2), F.lit(10)), F.lit("9999999999")).cast("int")) - 1
    joined = sites.join(proteome.select(F.col("name").alias("gene"), F.col("seq").alias("protein")), "gene", "left").withColumn("at", at)
    found = F.substring(F.col("protein"), F.col("at") + 1, F.lit(1))
    why = (
        F.when(F.col("protein").isNull(), "no gene")
        .when((F.col("at") < CENTRE) | (F.col("at") + CENTRE >= F.length("protein")), "short")
        .when(found != F.substring("position", 1, 1), "other residue")
        .when(~found.isin("S", "T", "Y"), "no acceptor")
    )
    return joined.select("gene", "position", *[F.col(f"`{c}`") for c in keep], F.when(why.isNull(), motif(F.col("protein"), F.col("at"))).alias("motif"), why.alias("rejected"))


def contains_match(peptides: DataFrame, proteome: DataFrame, k: int = 6) -> DataFrame:
    """pep_id, name: the first protein by ``ord`` whose sequence holds the peptide.

    Up to ``BROADCAST_LETTERS`` of distinct peptides go to the proteins as one automaton, which
    walks each sequence once.  Beyond that, peptides of at least ``k`` letters meet proteins by their first ``k`` letters, shorter ones
    by their own length, so there is one equi-join per length and no cross product.
    """
    words = settle(peptides.select("seq").filter("seq is not null").distinct())
    if (words.agg(F.sum(F.length("seq") + 1)).first()[0] or 0) <= BROADCAST_LETTERS:
        return _walked(peptides, proteome, [r["seq"] for r in words.collect()])
    lengths = [r[0] for r in peptides.select(F.least(F.length("seq"), F.lit(k))).distinct().collect()]  # at most ``k`` rows
    parts = []
    for n in lengths:
        own = settle(peptides.filter(F.least(F.length("seq"), F.lit(k)) == n).withColumn("key", F.substring("seq", 1, n)))
        # only the protein's number travels with its prefixes; candidates meet the protein itself afterwards
        grams = proteome.filter(F.length("seq") >= n).select("ord", F.explode(F.regexp_extract_all("seq", F.lit(f"(?=(.{{{n}}}))"), F.lit(1))).alias("key"))
        keys = own.select("key").distinct()
        # where the peptides' own prefixes are few, others never leave the scan
        grams = grams.join(F.broadcast(keys) if keys.count() <= BROADCAST_PREFIXES else keys, "key", "left_semi").distinct()
        near = own.join(grams, "key").select("pep_id", F.col("seq").alias("part"), "ord")
        parts.append(near.join(proteome, "ord").filter(F.col("seq").contains(F.col("part"))))
    if not parts:
        return peptides.select("pep_id", F.lit(None).cast("string").alias("name")).limit(0)
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    return joined.groupBy("pep_id").agg(F.min_by("name", F.struct("ord", "name")).alias("name"))


def _walked(peptides: DataFrame, proteome: DataFrame, words: list[str]) -> DataFrame:
    """``contains_match`` by an automaton of the ``words``."""
    kinds = {f.name: f.dataType for f in proteome.schema.fields}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in words:
            if word:
                automaton.add_word(word, word)
        automaton.make_automaton()
        every = [""] if "" in words else []  # every sequence holds the empty one
        for batch in batches:
            at, parts = [], []
            for k, seq in enumerate(batch.column("seq").to_pylist()):
                if seq is not None:
                    own = [*every, *({w for _, w in automaton.iter(seq)} if len(automaton) else ())]
                    at += [k] * len(own)
                    parts += own
            taken = batch.select(["ord", "name"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), *taken.columns], names=["seq", "ord", "name"])

    shape = T.StructType([T.StructField("seq", T.StringType()), T.StructField("ord", kinds["ord"]), T.StructField("name", T.StringType())])
    first = proteome.select("ord", "name", "seq").mapInArrow(found, shape).groupBy("seq").agg(F.min_by("name", F.struct("ord", "name")).alias("name"))
    return peptides.select("pep_id", "seq").join(first, "seq").select("pep_id", "name").groupBy("pep_id").agg(F.first("name").alias("name"))


def match_names(peptides: DataFrame, proteome: DataFrame, k: int = 6) -> DataFrame:
    """peptides (pep_id, name, ms_seq) with the protein's name and sequence: the named one if it holds the peptide, else the first that does.

    A peptide that no protein holds is an error that names it.
    """
    up = F.upper("ms_seq")
    named = proteome.select(F.trim("name").alias("name"), F.col("seq").alias("protein"))
    met = settle(peptides.withColumn("name", F.trim("name")).join(named, "name", "left").withColumn("held", F.coalesce(F.col("protein").contains(up), F.lit(False))))
    own = met.filter("held").select("pep_id", "name", "ms_seq", "protein")
    rest = met.filter("not held").select("pep_id", "ms_seq")
    found = contains_match(rest.select("pep_id", up.alias("seq")), proteome, k)
    other = rest.join(found, "pep_id", "left")
    name = F.when(F.col("name").isNull(), F.raise_error(F.concat(F.lit("no protein holds: "), "ms_seq"))).otherwise(F.col("name"))
    return own.unionByName(other.withColumn("name", name).join(named, "name").select("pep_id", "name", "ms_seq", "protein"))


def multi_site_motifs(peptides: DataFrame) -> DataFrame:
    """pep_id, pos, motif of peptides (pep_id, ms_seq with lower-case sites, protein) that their protein holds.

    A lower-case y is the centre wherever one is, else the first t or s.  Further sites are
    lower-cased and listed when less than five residues away; with one y beside t or s the
    centre is among the listed and skipped, with several y only the later y count.
    """
    ms, up = F.col("ms_seq"), F.col("protein")
    letters = F.split(ms, "")
    where = lambda of: F.filter(F.sequence(F.lit(0), F.length(ms) - 1), lambda i: F.array_contains(F.array(*[F.lit(c) for c in of]), letters[i]))
    ys, ts, all_ = where("y"), where("ts"), where("yts")
    rows = peptides.filter(up.contains(F.upper(ms))).select("pep_id", *[c for c in ("name",) if c in peptides.columns], "ms_seq", "protein", ys.alias("ys"), ts.alias("ts"), all_.alias("any"), F.expr("instr(protein, upper(ms_seq)) - 1").alias("start"))
    rows = rows.filter(F.size("any") > 0)
    tail = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    centre = F.when(F.size("ys") > 0, F.element_at("ys", 1)).otherwise(F.element_at("ts", 1))
    more = F.when(F.size("ys") > 1, tail(F.col("ys"))).when((F.size("ys") == 1) & (F.size("ts") > 0), F.col("any")).when(F.size("ys") == 0, tail(F.col("ts"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("centre", centre.cast("int")).withColumn("more", more)
    rows = rows.withColumn("near", F.filter("more", lambda i: (F.abs(i - F.col("centre")) < CENTRE) & (i != F.col("centre")))).withColumn("at", F.col("start") + F.col("centre"))
    plain = F.split(motif(up, F.col("at")), "")
    marked = F.transform(plain, lambda c, i: F.when(F.array_contains("near", i - CENTRE + F.col("centre")), F.lower(c)).otherwise(c))
    site = lambda i: F.concat(F.upper(F.substring(up, i + 1, F.lit(1))), (i + 1).cast("string"), F.lit("-p"))
    listed = F.concat(F.array(site(F.col("at"))), F.transform("near", lambda i: site(F.col("start") + i)))
    return rows.select("pep_id", *[c for c in ("name",) if c in peptides.columns], F.array_join(listed, ";").alias("pos"), F.array_join(marked, "").alias("motif"))
