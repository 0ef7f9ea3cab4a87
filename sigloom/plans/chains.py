"""Files written from the tables and read again by the loaders, and the composed analyses, as queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.residues import ALPHABET, profile_classes
from sigloom.functions.special import rounded
from sigloom.operators import filters, mixture, profiles, sequence, stats
from sigloom.operators.rounds import settle, shared_folder
from sigloom.plans.base import ALPHABET_SQL, EVENT_CELLS, K, MODEL, RESIDUES, SAMPLES, SIGNAL, peptides, signal, table
from sigloom.plans.matrices import ORDER, PSPL, hard_labels, one_step, pssms, reference_profiles
from sigloom.plans.registry import query
from sigloom.plans.tables import PROTEOME, proteome
from sigloom.sources import files
from sigloom.streaming import cells


def through_files(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` finds in what ``write`` has put into a folder of its own; the folder goes, the result is settled."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    write(folder)
    found = settle(read(folder))
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    return found


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = there.getFileSystem(spark._jsc.hadoopConfiguration()).create(there, True)
    out.write(bytearray(text.encode()))
    out.close()


# ---- loaders


def wide_signal(spark, sf_dir):
    """The table's form: a number, the sequence, three columns that go, and a column per sample; two of three experiments of a row are empty."""
    seen = lambda s: (F.col("vec_id") * 31 + s // 8 * 17) % 3 == 0
    samples = [F.when(seen(s), F.col("embedding")[s].cast("double")).alias(f"S{s:02d}") for s in range(SAMPLES)]
    own = table(spark, sf_dir, "embeddings").join(peptides(spark, sf_dir).select(F.col("pep_id").alias("vec_id"), "seq"), "vec_id")
    return own.select("vec_id", F.col("seq").alias("Sequence"), F.lit("p").alias("Protein"), F.lit("g").alias("Gene"), F.lit("S1").alias("Position"), *samples)


@query(f"""WITH {SIGNAL}, {RESIDUES}, w AS (SELECT pep_id, string_agg(aa, '' ORDER BY pos) AS seq FROM res GROUP BY pep_id),
c AS (SELECT pep_id, s // 8 AS experiment, x FROM sig WHERE (pep_id * 31 + s // 8 * 17) % 3 = 0),
k AS (SELECT pep_id FROM c GROUP BY pep_id HAVING count(DISTINCT experiment) >= 3)
SELECT seq, count(*) AS n_seen, round(sum(x), 4) + 0.0 AS total FROM c JOIN k USING (pep_id) JOIN w USING (pep_id) GROUP BY seq""")
def load_signal(spark, sf_dir):
    """A signal table and its samples' experiments, read from files: rows seen in three experiments or more."""

    def write(folder):
        wide_signal(spark, sf_dir).write.option("header", True).csv(f"{folder}/signal")
        put(spark, f"{folder}/experiments.csv", "﻿Sample ID,Experiment\r\n" + "".join(f"S{s:02d},{s // 8}\r\n" for s in range(SAMPLES)))

    got = through_files(spark, write, lambda f: files.signal_table(spark, f"{f}/signal", f"{f}/experiments.csv", 3))
    return got.filter("x is not null").groupBy("seq").agg(F.count(F.lit(1)).alias("n_seen"), rounded(F.sum("x")).alias("total"))


def records(spark, sf_dir, head: F.Column) -> DataFrame:
    """Records with the sequence in lines of sixty letters."""
    lines = F.regexp_replace("seq", "(.{60})", "$1\n")
    return proteome(spark, sf_dir).select("ord", F.concat(F.lit(">"), head, F.lit("\n"), lines).alias("value"))


SITES = f"""{PROTEOME}, sites AS (SELECT doc_id, 'P' || doc_id AS gene, doc_id % 97 AS place, CASE doc_id % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'T' WHEN 2 THEN 'Y' ELSE 'A' END AS want FROM documents),
mapped AS (SELECT doc_id, substr(seq, place::INT - 4, 5) || lower(want) || substr(seq, place::INT + 2, 5) AS seq FROM sites JOIN prot ON prot.name = sites.gene
  WHERE place >= 5 AND place + 5 < length(seq) AND substr(seq, place::INT + 1, 1) = want AND want IN ('S', 'T', 'Y'))"""


@query(f"WITH {SITES} SELECT seq, doc_id * 0.5::DOUBLE AS fold FROM mapped")
def load_sites(spark, sf_dir):
    """A table of sites and the proteins' records, read from files: the sites' windows with their values."""
    letter = F.element_at(F.array(*[F.lit(c) for c in "STYA"]), (F.col("doc_id") % 4 + 1).cast("int"))
    site = F.concat(F.lit("P"), F.col("doc_id").cast("string"), F.lit("("), letter, (F.col("doc_id") % 97 + 1).cast("string"), F.lit(");"))
    own = table(spark, sf_dir, "documents").select(site.alias("sh.index.sites"), F.lit(0.01).alias("FDR"), (F.col("doc_id") * 0.5).alias("MCF7.a.fold"))
    one = spark.createDataFrame([("ARPC2_HUMAN;", 0.01, 1.0)], own.schema)

    def write(folder):
        own.unionByName(one).write.option("header", True).csv(f"{folder}/sites")
        head = F.concat(F.lit("sp|X HUMAN Protein OS=Homo sapiens GN="), F.col("name"), F.lit(" PE=1"))
        records(spark, sf_dir, head).select("value").write.text(f"{folder}/proteome")

    return through_files(spark, write, lambda f: files.site_table(spark, f"{f}/sites", f"{f}/proteome")).toDF("seq", "fold")


@query(f"""WITH {PROTEOME} SELECT 'full' AS kind, 'Kin ' || ord % 50 AS name, arg_max(length(seq), ord) AS n FROM prot GROUP BY ALL
UNION ALL SELECT 'gene', 'G' || ord % 70, arg_max(length(seq), ord) FROM prot WHERE ord % 3 > 0 GROUP BY ALL""")
def fasta_names(spark, sf_dir):
    """Records by both kinds of names; of equal names the last counts, without a gene a record has no gene name."""
    gene = F.when(F.col("ord") % 3 > 0, F.concat(F.lit(" GN=G"), (F.col("ord") % 70).cast("string"))).otherwise("")
    head = F.concat(F.lit("sp|X HUMAN Kin "), (F.col("ord") % 50).cast("string"), F.lit(" OS=Homo sapiens"), gene, F.lit(" PE=1"))

    def read(folder):
        own = lambda kind: files.fasta(spark, folder, kind).select(F.lit(kind).alias("kind"), "name", F.length("seq").alias("n"))
        return own("full").unionByName(own("gene"))

    return through_files(spark, lambda f: records(spark, sf_dir, head).repartitionByRange(1, "ord").sortWithinPartitions("ord").select("value").write.text(f), read)


def cell(name: str, at: str) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(name), *[F.col(c).cast("string") for c in at.split()]).cast("binary")), 1, 6), 16, 10).cast("int") % 300 / 100.0


@query(f"""WITH {ALPHABET_SQL}, c AS (SELECT n_name AS kinase, p::INT AS pos, aa, ('0x' || substr(md5(n_name || ':' || p || ':' || aa), 1, 6))::INT % 300 / 100.0::DOUBLE + CASE WHEN n_nationkey % 2 = 0 THEN 0.25 ELSE -1 END AS raw FROM nation CROSS JOIN range(9) t(p) CROSS JOIN alpha)
SELECT kinase, pos, aa, round(CASE WHEN min(raw) OVER (PARTITION BY kinase) >= 0 THEN log2(raw) ELSE raw END, 4) + 0.0 AS score FROM c""")
def profile_tables(spark, sf_dir):
    """A folder of residue-by-offset tables, one file a profile: ratios go to logs, logs stay, other files are skipped."""
    raws = reference_profiles(spark, sf_dir).join(table(spark, sf_dir, "nation").select(F.col("n_name").alias("kinase"), "n_nationkey"), "kinase")
    raws = raws.select("kinase", "pos", "aa", (F.col("score") + F.when(F.col("n_nationkey") % 2 == 0, 0.25).otherwise(-1.0)).alias("raw")).collect()  # 25 x 9 x 20 rows

    def write(folder):
        own: dict[str, dict] = {}
        for r in raws:
            own.setdefault(r["kinase"], {})[r["aa"], r["pos"]] = r["raw"]
        for kinase, raw in own.items():
            rows = [f"{a}," + ",".join(repr(raw[a, p]) for p in range(9)) for a in ALPHABET] + ["pT" + ",1" * 9, "pY" + ",1" * 9]
            put(spark, f"{folder}/{kinase}.csv", "﻿,-5,-4,-3,-2,-1,+1,+2,+3,+4\r\n" + "\r\n".join(rows) + "\r\n")
        put(spark, f"{folder}/pssm_data.csv", "other\r\n")

    got = through_files(spark, write, lambda f: files.profile_folder(spark, f))
    return got.select("kinase", "pos", "aa", rounded(F.col("score")).alias("score"))


@query(f"""WITH {ALPHABET_SQL}, c AS (SELECT n_name AS kinase, r::INT AS r, aa_idx, aa, ('0x' || substr(md5(n_name || ':' || r || ':' || aa_idx), 1, 6))::INT % 300 / 20.0::DOUBLE AS v FROM nation CROSS JOIN range(2, 12) t(r) CROSS JOIN alpha WHERE r <> 8)
SELECT kinase, CASE WHEN r < 8 THEN r - 2 ELSE r - 3 END AS pos, aa, round(least(3.0, greatest(0.0, CASE WHEN v > 0 THEN log2(v) ELSE 0 END)), 4) + 0.0 AS score FROM c""")
def profile_blocks(spark, sf_dir):
    """A file of blocks, a name and fifteen positions each; clipped logs of nine of them."""
    grid = table(spark, sf_dir, "nation").select(F.col("n_name").alias("kinase")).crossJoin(spark.range(15).select(F.col("id").alias("r"))).crossJoin(spark.range(21).select(F.col("id").alias("c")))  # 25 x 15 x 21 rows
    values = {(r["kinase"], r["r"], r["c"]): r["v"] for r in grid.withColumn("v", cell("kinase", "r c") * 5).collect()}
    lines = []
    for kinase in sorted({k for k, _, _ in values}):
        lines += [kinase + "," * 20, *(",".join(repr(values[kinase, r, c]) for c in range(21)) for r in range(15))]
    got = through_files(spark, lambda f: put(spark, f"{f}/blocks.csv", "\r\n".join(lines) + "\r\n"), lambda f: files.profile_blocks(spark, f"{f}/blocks.csv"))
    return got.select("kinase", "pos", "aa", rounded(F.col("score")).alias("score"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c}')" for k, c in profile_classes().items()) + ") t(kinase, class)")
def kinase_classes(spark, sf_dir):
    return spark.createDataFrame(list(profile_classes().items()), "kinase string, class string")


@query(f"WITH {EVENT_CELLS} SELECT user_id, count(*) AS n_seen, count(DISTINCT experiment) AS n_experiments, round(sum(x), 4) + 0.0 AS total FROM cells GROUP BY user_id HAVING count(DISTINCT experiment) >= 2")
def stream_cells(spark, sf_dir):
    """Users seen on two days or more, from the events as a stream."""
    got = through_files(spark, lambda f: None, lambda f: cells.run_to_end(cells.cells(cells.event_stream(spark, sf_dir)), f))
    kept = filters.incomplete(got, "user_id", 1, experiments=2)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_seen"), F.countDistinct("experiment").alias("n_experiments"), rounded(F.sum("x")).alias("total"))


# ---- labels


@query("""WITH s AS (SELECT DISTINCT 'P' || user_id || CASE WHEN event_type IN ('click', 'view') THEN '.N' ELSE '' END || CASE WHEN user_id % 10 = 0 THEN '.IR' ELSE '' END AS name, user_id FROM events),
m AS (SELECT name, length(name) % 2 AS egfr, user_id % 3 = 0 AS alk FROM s), p AS (SELECT replace(name, '.N', '') AS patient, ends_with(name, '.N') AS marked FROM s WHERE NOT contains(name, 'IR')),
b AS (SELECT patient FROM p GROUP BY patient HAVING count(*) FILTER (marked) > 0 AND count(*) FILTER (NOT marked) > 0)
SELECT name, egfr::BOOLEAN AS egfr, alk FROM m JOIN b ON m.name = b.patient""")
def mutation_flags(spark, sf_dir):
    name = F.concat(F.lit("P"), F.col("user_id").cast("string"), F.when(F.col("event_type").isin("click", "view"), ".N").otherwise(""), F.when(F.col("user_id") % 10 == 0, ".IR").otherwise(""))
    own = table(spark, sf_dir, "events").select(name.alias("name"), "user_id").distinct()
    own = own.select("name", (F.length("name") % 2).alias("egfr"), F.when(F.col("user_id") % 3 == 0, 1).otherwise(0).alias("alk"), F.lit(0).alias("other"))
    return filters.mutation_flags(own, "name", ["egfr", "alk"])


@query("""SELECT 'C' || c_custkey AS sample, c_mktsegment = 'MACHINERY' AS hot FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 3 <> 0""")
def hot_cold_labels(spark, sf_dir):
    """Labels of the unmarked samples; a column with a null anywhere goes first."""
    group = F.when(F.col("c_mktsegment") == "BUILDING", "Cold-tumor enriched").when(F.col("c_mktsegment") == "MACHINERY", "Hot-tumor enriched").otherwise("NAT enriched")
    sample = F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.when(F.col("c_nationkey") % 3 == 0, ".N").otherwise(""))
    return filters.hot_cold(table(spark, sf_dir, "customer").select(sample.alias("Sample ID"), group.alias("Group"), F.when(F.col("c_custkey") > 1, 1).alias("Note")))


@query("""WITH t AS (SELECT p_name || ' (GO:' || p_partkey || ')' AS process, CASE WHEN p_size < 5 THEN ' < 0.01' ELSE p_size || '.5' END AS fold, p_brand AS direction, w
  FROM part, (VALUES ('red'), ('bolt'), ('steel')) v(w) WHERE contains(p_name || ' (GO:' || p_partkey || ')', w))
SELECT split_part(process, '(GO', 1) AS process, fold::DOUBLE AS fold, direction FROM t WHERE fold <> ' < 0.01'""")
def go_terms(spark, sf_dir):
    """Terms that name one of three words, once for each, without folds below the precision, the highest first."""
    process = F.concat("p_name", F.lit(" (GO:"), F.col("p_partkey").cast("string"), F.lit(")"))
    fold = F.when(F.col("p_size") < 5, " < 0.01").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    return filters.go_terms(table(spark, sf_dir, "part").select(process.alias("process"), fold.alias("fold"), F.col("p_brand").alias("direction")), ("red", "bolt", "steel"))


@query("""WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY ('0x' || substr(md5('place' || vec_id::VARCHAR), 1, 12))::BIGINT, vec_id) - 1 AS place FROM embeddings),
d AS (SELECT range AS draw, ('0x' || substr(md5('ratio' || range::VARCHAR), 1, 12))::BIGINT % (SELECT count(*) FROM embeddings) AS place FROM range((SELECT trunc(count(*) * 0.3)::BIGINT FROM embeddings)))
SELECT draw, vec_id FROM d JOIN n USING (place)""")
def sample_ratio(spark, sf_dir):
    return filters.sample_with_replacement(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", seed="ratio", ratio=0.3)


@query("SELECT l_returnflag, l_linestatus, round(sum(round_even(l_quantity / 8, 2)), 2) AS total FROM lineitem GROUP BY ALL")
def half_even(spark, sf_dir):
    """Ties go to the even digit."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(F.bround(F.col("l_quantity") / 8, 2)), 2).alias("total"))


@query(f"WITH {RESIDUES} SELECT aa, count(*) AS n FROM res WHERE pos = 5 GROUP BY aa")
def strict_sequences(spark, sf_dir):
    """Windows by their centre, read through the check that no sequence is invalid."""
    return filters.require_sequences(peptides(spark, sf_dir)).groupBy(F.substring("seq", 6, 1).alias("aa")).agg(F.count(F.lit(1)).alias("n"))


# ---- motifs


@query(f"""WITH {PROTEOME}, pep AS (SELECT ord, substr(seq, (ord % 40 + 1)::INT, 15) AS up FROM prot WHERE length(seq) >= 55),
l AS (SELECT ord, up, list_transform(range(15), lambda i: CASE WHEN substr(up, i::INT + 1, 1) IN ('S', 'T', 'Y') AND (i + ord) % 2 = 0 THEN lower(substr(up, i::INT + 1, 1)) ELSE substr(up, i::INT + 1, 1) END) AS c FROM pep),
own AS (SELECT l.*, first_ord, array_to_string(c, '') AS ms FROM l JOIN (SELECT p.ord, min(prot.ord) AS first_ord FROM pep p JOIN prot ON contains(prot.seq, p.up) GROUP BY p.ord) f USING (ord)),
named AS (SELECT own.ord, ms, c, CASE WHEN ord % 2 = 0 OR second_has THEN (CASE WHEN ord % 2 = 0 THEN ord ELSE ord + 1 END) ELSE first_ord END AS at_ord
  FROM (SELECT own.*, coalesce(contains(n.seq, up), false) AS second_has FROM own LEFT JOIN prot n ON n.ord = own.ord + 1) own),
q AS (SELECT named.ord, ms, c, prot.name, prot.seq AS protein, instr(prot.seq, upper(ms)) - 1 AS start,
  list_filter(range(15), lambda i: c[i + 1] = 'y') AS ys, list_filter(range(15), lambda i: c[i + 1] IN ('t', 's')) AS ts, list_filter(range(15), lambda i: c[i + 1] IN ('y', 't', 's')) AS al FROM named JOIN prot ON prot.ord = at_ord),
d AS (SELECT *, CASE WHEN len(ys) > 0 THEN ys[1] ELSE ts[1] END AS centre, CASE WHEN len(ys) > 1 THEN ys[2:] WHEN len(ys) = 1 AND len(ts) > 0 THEN al WHEN len(ys) = 0 THEN ts[2:] ELSE [] END AS more FROM q WHERE len(al) > 0),
e AS (SELECT *, list_filter(more, lambda i: abs(i - centre) < 5 AND i <> centre) AS near, start + centre AS place FROM d),
f AS (SELECT *, repeat('-', greatest(0, 5 - place)::INT) || substr(protein, greatest(0, place - 5)::INT + 1, least(5, place)::INT) || lower(substr(protein, place::INT + 1, 1)) || substr(protein, place::INT + 2, 5) AS w FROM e),
g AS (SELECT *, CASE WHEN place < 5 THEN w ELSE rpad(w, 11, '-') END AS plain FROM f)
SELECT ord AS pep_id, name, array_to_string(list_prepend(upper(substr(protein, place::INT + 1, 1)) || (place + 1) || '-p', list_transform(near, lambda i: upper(substr(protein, (start + i)::INT + 1, 1)) || (start + i + 1) || '-p')), ';') AS pos,
  array_to_string(list_transform(range(length(plain)), lambda i: CASE WHEN list_contains(near, i - 5 + centre) THEN lower(substr(plain, i::INT + 1, 1)) ELSE substr(plain, i::INT + 1, 1) END), '') AS motif FROM g""")
def motif_chain(spark, sf_dir):
    """Peptides with several lower-case sites, half of them under another protein's name, matched and mapped to windows."""
    at = (F.col("ord") % 40 + 1).cast("int")
    own = proteome(spark, sf_dir).filter("length(seq) >= 55").select("ord", F.split(F.substring(F.col("seq"), at, F.lit(15)), "").alias("c"))
    marked = F.transform("c", lambda c, i: F.when(c.isin("S", "T", "Y") & ((i + F.col("ord")) % 2 == 0), F.lower(c)).otherwise(c))
    name = F.concat(F.lit("P"), (F.col("ord") + F.col("ord") % 2).cast("string"))
    return sequence.multi_site_motifs(sequence.match_names(own.select(F.col("ord").alias("pep_id"), name.alias("name"), F.array_join(marked, "").alias("ms_seq")), proteome(spark, sf_dir), 12))


# ---- clusters and profiles


def soft(spark, sf_dir):
    """pep_id, cluster, r, hard after one step."""
    got = one_step(spark, sf_dir).withColumn("own", mixture.hard(F.col("r"))).select("pep_id", "own", F.posexplode("r").alias("cluster", "r"))
    return got.select("pep_id", "cluster", "r", (F.col("own") == F.col("cluster")).cast("int").alias("hard"))


def _soft_sql(weights_of: str, background: str) -> str:
    """The matrices of soft weights, those of ``weights_of`` counting for a cluster; background bg(pos, aa, b)."""
    return f"""{MODEL}, {RESIDUES}, {ALPHABET_SQL}, {background},
grid AS (SELECT c.cluster, pos::INT AS pos, alpha.aa FROM (SELECT DISTINCT cluster FROM hard) c CROSS JOIN range(11) t(pos) CROSS JOIN alpha),
sq AS (SELECT {weights_of} AS cluster, pos, aa, sum(r) AS q FROM res JOIN resp USING (pep_id) GROUP BY ALL),
hq AS (SELECT hard.cluster, pos, aa, count(*) AS n FROM res JOIN hard USING (pep_id) GROUP BY ALL),
full_ AS (SELECT g.cluster, g.pos, g.aa, coalesce(q, 0) AS q, coalesce(n, 0) AS n FROM grid g LEFT JOIN sq USING (cluster, pos, aa) LEFT JOIN hq USING (cluster, pos, aa)),
v AS (SELECT *, CASE WHEN pos = 5 THEN q ELSE q / avg(q) OVER (PARTITION BY cluster, pos) END AS v, avg(n) FILTER (aa IN ('S', 'T', 'Y')) OVER (PARTITION BY cluster, pos) AS m FROM full_),
soft AS (SELECT cluster, v.pos, v.aa, greatest(0.0, least(3.0, CASE WHEN v.pos = 5 AND v.aa IN ('S', 'T', 'Y') THEN CASE WHEN n > 0 THEN log2(n / m) ELSE 0 END
  WHEN b <> 0 AND v / b > 0 THEN log2(v / b) ELSE 0 END)) AS score FROM v JOIN bg ON bg.pos = v.pos AND bg.aa = v.aa)"""


ALL_ROWS = "bg0 AS (SELECT t.pos::INT AS pos, alpha.aa, count(res.aa) AS n FROM range(11) t(pos) CROSS JOIN alpha LEFT JOIN res ON res.pos = t.pos AND res.aa = alpha.aa GROUP BY t.pos, alpha.aa), bg AS (SELECT pos, aa, CASE WHEN pos = 5 THEN n ELSE n / avg(n) OVER (PARTITION BY pos) END AS b FROM bg0)"
OTHER_ROWS = "bg0 AS (SELECT t.pos::INT AS pos, alpha.aa, count(res.aa) AS n FROM range(11) t(pos) CROSS JOIN alpha LEFT JOIN res ON res.pos = t.pos AND res.aa = alpha.aa AND res.pep_id % 3 = 0 GROUP BY t.pos, alpha.aa), bg AS (SELECT pos, aa, CASE WHEN n > 0 THEN log2(n / m) ELSE -1.7976931348623157e308 END AS b FROM (SELECT *, avg(n) OVER (PARTITION BY pos) AS m FROM bg0))"


@query(f"WITH {_soft_sql('cluster', ALL_ROWS)} SELECT cluster, pos, aa, round(score, 4) + 0.0 AS score FROM soft")
def pssm_soft(spark, sf_dir):
    return profiles.scoring(sequence.residues(peptides(spark, sf_dir)), soft(spark, sf_dir)).withColumn("score", rounded(F.col("score")))


@query(f"WITH {_soft_sql(f'(cluster + 1) % {K}', ALL_ROWS)} SELECT cluster, pos, aa, round(score, 4) + 0.0 AS score FROM soft")
def pssm_offset(spark, sf_dir):
    """The weights of the cluster before, the hard counts of the cluster itself."""
    resp = profiles.offset_weights(soft(spark, sf_dir), K)
    return profiles.scoring(sequence.residues(peptides(spark, sf_dir)), resp).withColumn("score", rounded(F.col("score")))


NATIONS = "pspl AS (SELECT n_name AS kinase, p::INT AS slot, aa, ('0x' || substr(md5(n_name || ':' || p || ':' || aa), 1, 6))::INT % 300 / 100.0::DOUBLE AS score FROM nation CROSS JOIN range(9) t(p) CROSS JOIN alpha)"


@query(f"""WITH {_soft_sql('cluster', OTHER_ROWS)}, {NATIONS}
SELECT kinase, cluster, round(sqrt(sum(pow(soft.score - pspl.score, 2))), 4) AS d FROM pspl JOIN soft ON pspl.aa = soft.aa AND pspl.slot = CASE WHEN pos < 5 THEN pos ELSE pos - 1 END AND pos <> 5 AND pos <> 10 GROUP BY kinase, cluster""")
def upstream_kinases(spark, sf_dir):
    """Distances of the clusters' matrices, against a control matrix of other windows, to the profiles."""
    own = peptides(spark, sf_dir)
    control = profiles.control(sequence.counts(sequence.residues(own.filter("pep_id % 3 = 0"))))
    return profiles.upstream(sequence.residues(own), soft(spark, sf_dir), reference_profiles(spark, sf_dir), control).withColumn("d", rounded(F.col("d")))


@query(f"""WITH {PSPL}, ctl AS (SELECT pos, aa, greatest(0.0, least(3.0, CASE WHEN n > 0 THEN log2(n / m) ELSE 0 END)) AS score FROM (SELECT pos, aa, b AS n, avg(b) OVER (PARTITION BY pos) AS m FROM b)),
every AS (SELECT cluster, pos, aa, score FROM pssm UNION ALL SELECT -1, pos, aa, score FROM ctl),
both_ AS (SELECT cluster, pos, aa, score, false AS shuffled FROM every UNION ALL SELECT cluster, list_position({ORDER}, pos)::INT - 1, aa, score, true FROM every)
SELECT kinase, cluster, round(sqrt(sum(pow(both_.score - pspl.score, 2))), 4) AS d, shuffled FROM pspl JOIN both_ ON pspl.aa = both_.aa AND pspl.slot = CASE WHEN pos < 5 THEN pos ELSE pos - 1 END AND pos <> 5 AND pos <> 10
WHERE kinase = 'FRANCE' GROUP BY kinase, cluster, shuffled""")
def shuffled_control(spark, sf_dir):
    """One profile's distances to the clusters' matrices and to an appended control, before and after a shuffle of positions."""
    control = profiles.control(sequence.counts(sequence.residues(peptides(spark, sf_dir))))
    slice_ = control.select(F.lit(-1).alias("cluster"), "pos", "aa", F.greatest(F.lit(0.0), F.least(F.lit(3.0), F.col("score"))).alias("score"))
    return profiles.shuffled_distances(pssms(spark, sf_dir).unionByName(slice_), reference_profiles(spark, sf_dir), ORDER, "FRANCE").withColumn("d", rounded(F.col("d")))


@query(f"""WITH {PSPL}, cls AS (SELECT n_name AS kinase, CASE WHEN n_nationkey % 2 = 0 THEN 'Y' ELSE 'S/T' END AS class FROM nation),
top AS (SELECT cluster, arg_max(aa, (score, -strpos('{ALPHABET}', aa))) AS aa FROM pssm WHERE pos = 5 GROUP BY cluster),
k AS (SELECT dist.*, row_number() OVER (PARTITION BY cluster ORDER BY d, kinase) AS place FROM dist JOIN cls USING (kinase) JOIN top USING (cluster) WHERE class = CASE WHEN aa IN ('S', 'T') THEN 'S/T' ELSE aa END)
SELECT kinase, cluster, round(d, 4) AS d, place::INT AS place FROM k WHERE place <= 3""")
def acceptor_topk(spark, sf_dir):
    """The nearest profiles of each cluster whose class is that of the cluster's acceptor."""
    matrix = pssms(spark, sf_dir)
    classes = table(spark, sf_dir, "nation").select(F.col("n_name").alias("kinase"), F.when(F.col("n_nationkey") % 2 == 0, "Y").otherwise("S/T").alias("class"))
    dist = profiles.distances(matrix, reference_profiles(spark, sf_dir))
    return profiles.nearest(dist, 3, classes, profiles.acceptors(matrix)).select("kinase", "cluster", rounded(F.col("d")).alias("d"), "place")


@query(f"""WITH {MODEL}, c AS (SELECT label AS cluster, round(avg(x), 6) AS coef FROM sig WHERE s = 0 GROUP BY label)
SELECT row_number() OVER (ORDER BY abs(coef) DESC, cluster DESC) - 1 AS place, cluster, coef FROM c WHERE cluster IN (SELECT cluster FROM hard) AND cluster <> 3 ORDER BY place LIMIT 3""")
def top_clusters(spark, sf_dir):
    coefs = signal(spark, sf_dir).filter("s = 0").groupBy(F.col("label").alias("cluster")).agg(F.round(F.avg("x"), 6).alias("coef"))
    members = hard_labels(spark, sf_dir).select("cluster").filter("cluster <> 3")
    return stats.top_clusters(coefs, members)


@query("""WITH r AS (SELECT l_shipmode_task AS task, weight, round(avg(l_extendedprice), 2) AS performance FROM (SELECT l_returnflag AS l_shipmode_task, (l_linenumber - 1) * 100.0::DOUBLE AS weight, l_extendedprice FROM lineitem) GROUP BY ALL),
b AS (SELECT task, arg_max(weight, (performance, -weight)) AS weight, max(performance) AS performance FROM r WHERE weight <> 0 GROUP BY task)
SELECT task, weight, performance, 'plain' AS kind FROM r WHERE weight = 0 UNION ALL SELECT task, weight, performance, 'weighted' FROM b""")
def best_vs_plain(spark, sf_dir):
    """Each task's results without weight beside the best of those with one."""
    results = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("task"), ((F.col("l_linenumber") - 1) * 100.0).alias("weight")).agg(F.round(F.avg("l_extendedprice"), 2).alias("performance"))
    return stats.best_and_plain(results)
