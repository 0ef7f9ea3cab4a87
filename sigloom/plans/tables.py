"""Filters, joins, labels and sequence counts as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions.residues import ALPHABET
from sigloom.functions.special import rounded
from sigloom.operators import filters, profiles, sequence
from sigloom.plans.base import ALPHABET_SQL, EVENT_CELLS, RESIDUES, WINDOWS, cells, peptides, spread, table
from sigloom.plans.registry import query


@query(f"""WITH {EVENT_CELLS}, n AS (SELECT count(DISTINCT sample) AS n FROM cells)
SELECT user_id, count(x) AS n_seen, round(count(x) / any_value(n), 4) AS ratio FROM cells, n GROUP BY user_id HAVING count(x) / any_value(n) >= 0.05""")
def filter_ratio(spark, sf_dir):
    c = cells(spark, sf_dir)
    n = c.agg(F.countDistinct("sample")).first()[0]
    return filters.by_ratio(c, "user_id", n, 0.05).withColumn("ratio", rounded(F.col("ratio")))


@query(f"WITH {EVENT_CELLS} SELECT user_id, count(DISTINCT experiment) AS n_experiments FROM cells WHERE x IS NOT NULL GROUP BY user_id HAVING count(DISTINCT experiment) >= 2")
def filter_experiments(spark, sf_dir):
    return filters.by_experiments(cells(spark, sf_dir), "user_id", 2)


@query("""WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY ('0x' || substr(md5('place' || vec_id::VARCHAR), 1, 12))::BIGINT, vec_id) - 1 AS place FROM embeddings),
d AS (SELECT range AS draw, ('0x' || substr(md5('draw' || range::VARCHAR), 1, 12))::BIGINT % (SELECT count(*) FROM embeddings) AS place FROM range(200))
SELECT draw, vec_id FROM d JOIN n USING (place)""")
def sample_subset(spark, sf_dir):
    return filters.sample_with_replacement(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 200)


@query("""WITH s AS (SELECT DISTINCT 'P' || user_id || CASE WHEN event_type IN ('click', 'view') THEN '.N' ELSE '' END || CASE WHEN user_id % 10 = 0 THEN '.IR' ELSE '' END AS name FROM events),
p AS (SELECT replace(name, '.N', '') AS patient, ends_with(name, '.N') AS marked FROM s WHERE NOT contains(name, 'IR'))
SELECT patient FROM p GROUP BY patient HAVING count(*) FILTER (marked) > 0 AND count(*) FILTER (NOT marked) > 0""")
def paired_samples(spark, sf_dir):
    name = F.concat(F.lit("P"), F.col("user_id").cast("string"), F.when(F.col("event_type").isin("click", "view"), ".N").otherwise(""), F.when(F.col("user_id") % 10 == 0, ".IR").otherwise(""))
    return filters.paired(table(spark, sf_dir, "events").select(name.alias("name")).distinct())


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 END AS hot, c_nationkey IN (1, 5, 9) AS member, NOT (c_nationkey IN (1, 5, 9)) OR c_acctbal > 0 AS either FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def label_recode(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    member = F.col("c_nationkey").isin(1, 5, 9)
    return c.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).alias("hot"), member.alias("member"), (~member | (F.col("c_acctbal") > 0)).alias("either"))


@query("SELECT o_orderkey, n_name, o_totalprice > 100000 AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def label_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations: 25 rows
    big = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(big, "o_orderkey", "left_semi").select("o_orderkey", "n_name", (F.col("o_totalprice") > 100000).alias("y"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def drop_keys(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(gone, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def symmetric_difference(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return filters.symmetric_difference(a, b, "k")


@query(f"WITH {WINDOWS} SELECT seq, count(*) AS n FROM win GROUP BY seq")
def kmer_windows(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return sequence.windows(docs, "doc_id").groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT seq, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS seq FROM documents) WHERE NOT regexp_full_match(seq, '(?i)[{ALPHABET}]{{11}}') GROUP BY seq")
def seq_validate(spark, sf_dir):
    """Runs of letters in the texts that aren't sequences of the window's length over the alphabet."""
    runs = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("seq"))
    return filters.bad_sequences(runs).groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RESIDUES} SELECT count(*) FILTER (aa = 'Y') AS n_y, count(*) FILTER (aa = 'S') AS n_s, count(*) FILTER (aa = 'T') AS n_t FROM res WHERE pos = 5")
def site_counts(spark, sf_dir):
    return sequence.site_counts(peptides(spark, sf_dir))


COUNTS = f"{RESIDUES}, {ALPHABET_SQL}, cnt AS (SELECT t.pos::INT AS pos, alpha.aa, any_value(freq) AS freq, count(res.aa) AS cnt FROM range(11) t(pos) CROSS JOIN alpha LEFT JOIN res ON res.pos = t.pos AND res.aa = alpha.aa GROUP BY t.pos, alpha.aa)"


@query(f"WITH {COUNTS} SELECT pos, aa, cnt FROM cnt")
def count_matrix(spark, sf_dir):
    return sequence.counts(sequence.residues(peptides(spark, sf_dir)))


@query(f"WITH {COUNTS} SELECT pos, aa, cnt, round((cnt + freq) / sum(cnt + freq) OVER (PARTITION BY pos), 4) AS p FROM cnt")
def pwm_pseudocount(spark, sf_dir):
    return sequence.weights(sequence.counts(sequence.residues(peptides(spark, sf_dir)))).withColumn("p", rounded(F.col("p")))


@query(f"""WITH {COUNTS}, m AS (SELECT pos, aa, cnt / avg(cnt) OVER (PARTITION BY pos) AS v FROM cnt)
SELECT pos, aa, CASE WHEN v > 0 THEN round(log2(v), 4) + 0.0 ELSE -1.7976931348623157e308 END AS score FROM m""")
def control_pssm(spark, sf_dir):
    got = profiles.control(sequence.counts(sequence.residues(peptides(spark, sf_dir))))
    return got.withColumn("score", F.when(F.col("score") < -1e300, F.col("score")).otherwise(rounded(F.col("score"))))


@query(f"""WITH {WINDOWS}, {RESIDUES}, b AS (SELECT doc_id, seq, substr(seq, 6, 1) AS site FROM win WHERE NOT contains(seq, 'X')),
f AS (SELECT count(*) FILTER (aa = 'Y') / count(*) AS y, count(*) FILTER (aa = 'S') / count(*) AS s, count(*) FILTER (aa = 'T') / count(*) AS t FROM res WHERE pos = 5),
n AS (SELECT count(*) AS n, count(*) FILTER (site = 'Y') AS ny FROM b),
q AS (SELECT CASE WHEN ny >= n * y THEN n ELSE trunc(ny / y)::BIGINT END AS size, y, s, t FROM n, f),
k AS (SELECT b.*, row_number() OVER (PARTITION BY site ORDER BY doc_id, seq) AS turn FROM b)
SELECT site, count(*) AS n, min(seq) AS least, max(seq) AS most, max(doc_id) AS last_doc FROM k, q
WHERE turn <= trunc(size * CASE site WHEN 'Y' THEN y WHEN 'S' THEN s ELSE t END) GROUP BY site""")
def background_quota(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    got = sequence.quota(spark, sequence.windows(docs, "doc_id"), peptides(spark, sf_dir), "doc_id")
    return got.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("least"), F.max("seq").alias("most"), F.max("doc_id").alias("last_doc"))


PROTEOME = "prot AS (SELECT doc_id AS ord, 'P' || doc_id AS name, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents)"


def proteome(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("name"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))


@query(f"""WITH {PROTEOME}, pep AS (SELECT item_id AS pep_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark)
SELECT pep_id, arg_min(name, ord) AS name FROM pep JOIN prot ON contains(prot.seq, pep.seq) GROUP BY pep_id""")
def contains_join(spark, sf_dir):
    pep = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pep_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))
    return sequence.contains_match(pep, proteome(spark, sf_dir), 12)


@query(f"""WITH {PROTEOME}, sites AS (SELECT 'P' || doc_id AS gene, CASE doc_id % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'T' WHEN 2 THEN 'Y' ELSE 'A' END || (doc_id % 97 + 1) AS position, doc_id % 97 AS place, CASE doc_id % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'T' WHEN 2 THEN 'Y' ELSE 'A' END AS want FROM documents),
j AS (SELECT sites.*, seq, substr(seq, place::INT + 1, 1) AS found FROM sites LEFT JOIN prot ON prot.name = sites.gene),
w AS (SELECT *, CASE WHEN seq IS NULL THEN 'no gene' WHEN place < 5 OR place + 5 >= length(seq) THEN 'short' WHEN found <> want THEN 'other residue' WHEN found NOT IN ('S', 'T', 'Y') THEN 'no acceptor' END AS rejected FROM j)
SELECT gene, position, CASE WHEN rejected IS NULL THEN substr(seq, place::INT - 4, 5) || lower(found) || substr(seq, place::INT + 2, 5) END AS motif, rejected FROM w""")
def motif_mapping(spark, sf_dir):
    letter = F.element_at(F.array(*[F.lit(c) for c in "STYA"]), (F.col("doc_id") % 4 + 1).cast("int"))
    sites = table(spark, sf_dir, "documents").select(F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("gene"), F.concat(letter, (F.col("doc_id") % 97 + 1).cast("string")).alias("position"))
    return sequence.map_sites(sites, proteome(spark, sf_dir))


@query("SELECT l_returnflag, l_linestatus, metric, value FROM (SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY ALL) UNPIVOT (value FOR metric IN (quantity, price))")
def melt(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return wide.unpivot(["l_returnflag", "l_linestatus"], ["quantity", "price"], "metric", "value")


@query("SELECT p_brand AS grp, round(sum(p_retailprice), 2) AS score FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1 ORDER BY score DESC, grp LIMIT 40")
def group_score_top(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("grp")).agg(F.round(F.sum("p_retailprice"), 2).alias("score")).orderBy(F.desc("score"), "grp").limit(40)


@query("""(SELECT c_custkey, c_acctbal, 'top' AS side FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)
UNION ALL (SELECT c_custkey, c_acctbal, 'bottom' AS side FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10)""")
def topn_bottomn(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    top = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).withColumn("side", F.lit("top"))
    return top.unionByName(c.orderBy("c_acctbal", "c_custkey").limit(10).withColumn("side", F.lit("bottom")))


@query("SELECT o_orderkey, 'early' AS kind FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'dear' AS kind FROM orders WHERE o_totalprice > 300000")
def union_groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus = 'F' and o_totalprice > 200000").select("o_orderkey", F.lit("early").alias("kind"))
    return a.unionByName(o.filter("o_totalprice > 300000").select("o_orderkey", F.lit("dear").alias("kind")))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_order, max(o_totalprice) AS price FROM orders GROUP BY o_custkey")
def idxmax_best(spark, sf_dir):
    best = F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("best_order"), F.max("o_totalprice").alias("price"))


@query("SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) AS geomean, round(avg(ln(l_extendedprice)), 4) AS log_geomean FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1")
def geomean_summary(spark, sf_dir):
    mean = F.avg(F.log("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").filter("l_extendedprice > 0").groupBy("l_returnflag").agg(rounded(F.exp(mean)).alias("geomean"), rounded(mean).alias("log_geomean"))


@query("SELECT c_mktsegment, round(regr_slope(c_acctbal, c_custkey), 6) + 0.0 AS slope, round(stddev_samp(c_acctbal) / sqrt(count(*)), 4) AS sem FROM customer GROUP BY 1")
def linear_fit(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg((rounded(F.regr_slope("c_acctbal", "c_custkey"), 6)).alias("slope"), rounded(F.stddev_samp("c_acctbal") / F.sqrt(F.count(F.lit(1)))).alias("sem"))


@query("SELECT p_partkey, split_part(p_name, ' ', 2) AS term, try_cast(replace(p_brand, 'Brand#', '') AS DOUBLE) AS fold, p_size FROM part WHERE contains(p_name, 'bolt') OR contains(p_name, 'red') OR contains(p_type, 'PROMO')")
def term_filter(spark, sf_dir):
    kept = F.col("p_name").contains("bolt") | F.col("p_name").contains("red") | F.col("p_type").contains("PROMO")
    fold = F.expr("try_cast(replace(p_brand, 'Brand#', '') as double)")
    return table(spark, sf_dir, "part").filter(kept).select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("term"), fold.alias("fold"), "p_size")


@query("""WITH c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS experiment, value FROM events),
e AS (SELECT user_id, experiment, row_number() OVER (PARTITION BY user_id ORDER BY md5('mask' || user_id || ':' || experiment), experiment) AS k FROM (SELECT DISTINCT user_id, experiment FROM c))
SELECT c.user_id, count(*) AS n, count(*) FILTER (k = 1) AS n_masked, any_value(e.experiment) FILTER (k = 1) AS experiment FROM c JOIN e ON c.user_id = e.user_id AND c.experiment = e.experiment GROUP BY c.user_id""")
def add_missingness(spark, sf_dir):
    c = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("experiment"), "value")
    key = F.md5(F.concat(F.lit("mask"), F.col("user_id").cast("string"), F.lit(":"), F.col("experiment")).cast("binary"))
    picked = c.groupBy("user_id").agg(F.min_by("experiment", F.struct(key, "experiment")).alias("gone"))
    return c.join(picked, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("experiment") == F.col("gone")).alias("n_masked"), F.max("gone").alias("experiment"))
