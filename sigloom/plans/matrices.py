"""The mixture, imputation, scoring matrices and profile distances as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions.special import rounded
from sigloom.operators import mixture, profiles, sequence, stats
from sigloom.plans.base import ALPHABET_SQL, K, MASKED, MODEL, PAM_SQL, RESIDUES, SIGNAL, background_weights, masked, peptides, rows, signal, table
from sigloom.plans.registry import query


def one_step(spark, sf_dir):
    start = rows(spark, sf_dir)
    # settled: what is read off it would evaluate the densities anew each time
    return mixture.settle(mixture.scored(start, mixture.m_step(start, K)))


@query(f"WITH {MODEL} SELECT cluster, s, round(mu, 4) + 0.0 AS mu, round(var, 4) + 0.0 AS var FROM mom")
def mstep_moments(spark, sf_dir):
    m = mixture.m_step(rows(spark, sf_dir), K)
    cells = [(c, s, m.means[c][s], m.variances[c][s]) for c in range(K) for s in range(len(m.means[c]))]  # clusters by samples
    return spark.createDataFrame(cells, "cluster int, s int, mu double, var double").select("cluster", "s", rounded(F.col("mu")).alias("mu"), rounded(F.col("var")).alias("var"))


@query(f"WITH {MODEL} SELECT pep_id, cluster, round(r, 4) + 0.0 AS r, round(l, 3) + 0.0 AS l FROM resp")
def estep_responsibility(spark, sf_dir):
    got = one_step(spark, sf_dir).select("pep_id", F.posexplode(F.arrays_zip("r", "l")).alias("cluster", "v"))
    return got.select("pep_id", "cluster", rounded(F.col("v.r")).alias("r"), rounded(F.col("v.l"), 3).alias("l"))


@query(f"WITH {MODEL} SELECT pep_id, label, cluster FROM hard")
def hard_labels(spark, sf_dir):
    return one_step(spark, sf_dir).select("pep_id", "label", mixture.hard(F.col("r")).alias("cluster"))


@query(f"WITH {MODEL} SELECT cluster, count(*) AS n, count(*) FILTER (cluster = label) AS n_same FROM hard GROUP BY cluster")
def nonempty_clusters(spark, sf_dir):
    return hard_labels(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cluster") == F.col("label")).alias("n_same"))


@query(f"WITH {MODEL} SELECT round(avg(z), 3) AS bound FROM lse")
def lower_bound(spark, sf_dir):
    return one_step(spark, sf_dir).agg(rounded(F.avg("lse"), 3).alias("bound"))


@query(f"WITH {SIGNAL} SELECT s, " + ", ".join(f"round(avg(x) FILTER (label = {c}), 4) + 0.0 AS c{c}" for c in range(K)) + " FROM sig GROUP BY s")
def centers_wide(spark, sf_dir):
    wide = signal(spark, sf_dir).groupBy("s").pivot("label", list(range(K))).agg(F.avg("x"))
    return wide.select("s", *[rounded(F.col(str(c))).alias(f"c{c}") for c in range(K)])


@query(f"WITH {SIGNAL}, c AS (SELECT label, s, avg(x) AS mu FROM sig GROUP BY ALL) SELECT label, s, round(mu - avg(mu) OVER (PARTITION BY s), 4) + 0.0 AS centred FROM c")
def center_normalize(spark, sf_dir):
    centres = signal(spark, sf_dir).groupBy("label", "s").agg(F.avg("x").alias("mu"))
    return stats.centred(centres, "mu", "s", "d").select("label", "s", rounded(F.col("d")).alias("centred"))


CENTRES = f"{SIGNAL}, c AS (SELECT label, s, avg(x) AS mu FROM sig GROUP BY ALL)"


@query(f"WITH {CENTRES} SELECT a.label AS a, b.label AS b, round(sum(a.mu * b.mu) / (sqrt(sum(a.mu * a.mu)) * sqrt(sum(b.mu * b.mu))), 4) + 0.0 AS cosine, round(sqrt(sum(pow(a.mu - b.mu, 2))), 4) AS distance FROM c a JOIN c b ON a.s = b.s AND a.label < b.label GROUP BY ALL")
def center_pairs(spark, sf_dir):
    c = signal(spark, sf_dir).groupBy("label", "s").agg(F.avg("x").alias("mu"))
    pairs = c.select(F.col("label").alias("a"), "s", F.col("mu").alias("u")).join(c.select(F.col("label").alias("b"), "s", F.col("mu").alias("v")), "s").filter("a < b")
    norm = lambda x: F.sqrt(F.sum(F.col(x) * F.col(x)))
    return pairs.groupBy("a", "b").agg(rounded(F.sum(F.col("u") * F.col("v")) / (norm("u") * norm("v"))).alias("cosine"), rounded(F.sqrt(F.sum(F.pow(F.col("u") - F.col("v"), 2)))).alias("distance"))


@query(f"WITH {CENTRES}, w AS (SELECT pep_id, label, avg(pow(x - mu, 2)) AS mse FROM sig JOIN c USING (label, s) GROUP BY ALL) SELECT label, count(*) AS n, round(avg(mse), 4) AS mse FROM w GROUP BY label")
def peptide_distance(spark, sf_dir):
    sig = signal(spark, sf_dir)
    c = sig.groupBy("label", "s").agg(F.avg("x").alias("mu"))
    per = sig.join(c, ["label", "s"]).groupBy("pep_id", "label").agg(F.avg(F.pow(F.col("x") - F.col("mu"), 2)).alias("mse"))
    return per.groupBy("label").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("mse")).alias("mse"))


@query(f"""WITH {MASKED}, f AS (SELECT pep_id, label, s, truth, x, avg(x) OVER (PARTITION BY s) AS mean, min(x) OVER (PARTITION BY s) AS least, avg(x) OVER (PARTITION BY label, s) AS own FROM mis)
SELECT 'mean' AS method, count(*) AS n, round(sum(pow(truth - mean, 2)), 4) AS sse FROM f WHERE x IS NULL
UNION ALL SELECT 'minimum', count(*), round(sum(pow(truth - least, 2)), 4) FROM f WHERE x IS NULL
UNION ALL SELECT 'zero', count(*), round(sum(pow(truth, 2)), 4) FROM f WHERE x IS NULL
UNION ALL SELECT 'cluster', count(*), round(sum(pow(truth - coalesce(own, mean), 2)), 4) FROM f WHERE x IS NULL""")
def impute_error(spark, sf_dir):
    f = masked(spark, sf_dir)
    per = f.groupBy("s").agg(F.avg("x").alias("mean"), F.min("x").alias("least"))
    own = f.groupBy("label", "s").agg(F.avg("x").alias("own"))
    gone = f.filter("x is null").join(per, "s").join(own, ["label", "s"], "left")
    fills = gone.select("truth", F.explode(F.create_map(F.lit("mean"), F.col("mean"), F.lit("minimum"), F.col("least"), F.lit("zero"), F.lit(0.0), F.lit("cluster"), F.coalesce("own", "mean"))).alias("method", "fill"))
    return fills.groupBy("method").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(F.pow(F.col("truth") - F.col("fill"), 2))).alias("sse"))


@query(f"WITH {MASKED} SELECT pep_id, s, round(coalesce(x, avg(x) OVER (PARTITION BY label, s)), 4) + 0.0 AS x FROM mis")
def impute_cluster(spark, sf_dir):
    cells = masked(spark, sf_dir)
    own = cells.groupBy("label", "s").agg(F.avg("x").alias("own"))
    return cells.join(own, ["label", "s"]).select("pep_id", "s", rounded(F.coalesce("x", "own")).alias("x"))


def _round_sql(k: int) -> str:
    """The k-th round: densities of the cells filled so far, hard labels, refilled cells, and the next model."""
    return f"""
l{k} AS (SELECT x{k}.pep_id, m{k}.cluster, any_value(m{k}.lp) - 0.5 * (count(*) * ln(2 * pi()) + sum(pow(x - mu, 2) / var) + sum(ln(var))) AS l FROM x{k} JOIN m{k} USING (s) GROUP BY x{k}.pep_id, m{k}.cluster),
t{k} AS ({"SELECT pep_id, cluster, l FROM l0" if not k else f"SELECT l{k}.pep_id, l{k}.cluster, l + 0.05 * score AS l FROM l{k} JOIN s{k} ON s{k}.pep_id = l{k}.pep_id AND s{k}.cluster = l{k}.cluster"}),
z{k} AS (SELECT pep_id, max(l) + ln(sum(exp(l - most))) AS z FROM (SELECT *, max(l) OVER (PARTITION BY pep_id) AS most FROM t{k}) GROUP BY pep_id),
r{k} AS (SELECT t{k}.pep_id, cluster, exp(l - z) AS r FROM t{k} JOIN z{k} USING (pep_id)),
h{k} AS (SELECT pep_id, arg_max(cluster, (r, -cluster)) AS cluster FROM r{k} GROUP BY pep_id),
x{k + 1} AS (SELECT x{k}.pep_id, x{k}.s, miss, CASE WHEN miss THEN mu ELSE x END AS x FROM x{k} JOIN h{k} USING (pep_id) JOIN m{k} ON m{k}.cluster = h{k}.cluster AND m{k}.s = x{k}.s),
n{k + 1} AS (SELECT cluster, sum(r) AS n FROM r{k} GROUP BY cluster),
m{k + 1} AS (SELECT cluster, s, sum(r * x) / (any_value(n) + 2.220446049250313e-15) AS mu, sum(r * x * x) / (any_value(n) + 2.220446049250313e-15) - pow(sum(r * x) / (any_value(n) + 2.220446049250313e-15), 2) + 1e-6 AS var,
  ln((any_value(n) + 2.220446049250313e-15) / any_value(tot)) AS lp FROM x{k + 1} JOIN r{k} USING (pep_id) JOIN n{k + 1} USING (cluster), (SELECT sum(n + 2.220446049250313e-15) AS tot FROM n{k + 1}) GROUP BY cluster, s),
q{k + 1} AS (SELECT cluster, pos, aa, sum(r) AS q FROM res JOIN r{k} USING (pep_id) GROUP BY ALL),
u{k + 1} AS (SELECT q.cluster, q.pos, pam.aa1 AS aa, sum(pam.score * q.q) / any_value(n) AS v FROM q{k + 1} q JOIN pam ON pam.aa2 = q.aa JOIN n{k + 1} USING (cluster) GROUP BY ALL),
s{k + 1} AS (SELECT pep_id, u.cluster, sum(v) AS score FROM res JOIN u{k + 1} u USING (pos, aa) GROUP BY pep_id, u.cluster)"""


TWO_ROUNDS = f"""{MASKED}, {RESIDUES}, {PAM_SQL},
x0 AS (SELECT pep_id, s, x IS NULL AS miss, coalesce(x, avg(x) OVER (PARTITION BY s)) AS x FROM mis),
g AS (SELECT DISTINCT pep_id, label AS cluster FROM sig), k0 AS (SELECT cluster, count(*) AS n FROM g GROUP BY cluster),
m0 AS (SELECT cluster, s, sum(x) / (any_value(n) + 2.220446049250313e-15) AS mu, sum(x * x) / (any_value(n) + 2.220446049250313e-15) - pow(sum(x) / (any_value(n) + 2.220446049250313e-15), 2) + 1e-6 AS var,
  ln((any_value(n) + 2.220446049250313e-15) / any_value(tot)) AS lp FROM x0 JOIN g USING (pep_id) JOIN k0 USING (cluster), (SELECT sum(n + 2.220446049250313e-15) AS tot FROM k0) GROUP BY cluster, s),""" + _round_sql(0) + "," + _round_sql(1) + "," + _round_sql(2)


@query(f"WITH {TWO_ROUNDS} SELECT pep_id, h2.cluster, round(z, 3) + 0.0 AS lse FROM h2 JOIN z2 USING (pep_id)")
def em_two_rounds(spark, sf_dir):
    """Two rounds with missing cells and substitution scores from the given labels, and the responsibilities after them."""
    got, _ = mixture.fit(rows(spark, sf_dir, hide=True), K, "pam250", 0.05, most=2, tol=0.0)
    return got.select("pep_id", mixture.hard(F.col("r")).alias("cluster"), rounded(F.col("lse"), 3).alias("lse"))


@query()
def em_converged(spark, sf_dir):
    """The mixture with missing cells and substitution scores until its bound rests, the better of two starts."""
    got, _ = mixture.fit_best(rows(spark, sf_dir, hide=True), K, method="pam250", weight=1.0, start="soft")
    return got.select("pep_id", mixture.hard(F.col("r")).alias("cluster"), rounded(F.col("lse"), 2).alias("lse"))


@query()
def plain_mixture(spark, sf_dir):
    """Two clusters by the signal alone."""
    got, _ = mixture.fit_best(rows(spark, sf_dir).drop("r"), 2, weight=0.0)
    return got.select("pep_id", mixture.hard(F.col("r")).alias("cluster"), rounded(F.col("lse"), 2).alias("lse"))


@query()
def em_binomial(spark, sf_dir):
    """The same with binomial enrichment against the pseudocounted background; its imputed cells."""
    got, model = mixture.fit_best(rows(spark, sf_dir, hide=True), K, method="binomial", weight=1.0, background=background_weights(spark, sf_dir), start="soft")
    cells = mixture.imputed(got, model).select("pep_id", mixture.hard(F.col("r")).alias("cluster"), F.posexplode(F.arrays_zip("x", "miss")).alias("s", "c")).filter("c.miss")
    return cells.select("pep_id", "cluster", "s", rounded(F.col("c.x")).alias("x"))


@query()
def low_rank_impute(spark, sf_dir):
    """The imputed cells, filled until they move by less than 1e-5."""
    got = stats.low_rank_fill(rows(spark, sf_dir, hide=True).select("pep_id", "x", "miss"), 5, tol=1e-5)
    cells = got.select("pep_id", F.posexplode(F.arrays_zip("x", "miss")).alias("s", "c")).filter("c.miss")
    return cells.select("pep_id", "s", rounded(F.col("c.x")).alias("x"))


@query(f"""WITH {RESIDUES}, {PAM_SQL}, w AS (SELECT label AS cluster, pos, aa, count(*) AS n FROM res GROUP BY ALL),
t AS (SELECT cluster, pos, aa1 AS aa, sum(score * n) AS s FROM w JOIN pam ON pam.aa2 = w.aa GROUP BY ALL),
z AS (SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label)
SELECT pep_id, t.cluster, round(sum(s) / any_value(z.n), 4) + 0.0 AS score FROM res JOIN t USING (pos, aa) JOIN z ON z.cluster = t.cluster GROUP BY pep_id, t.cluster""")
def pam_score(spark, sf_dir):
    start = rows(spark, sf_dir)
    n, _, _ = mixture.moments(start, K)
    tab = mixture.pam_table(mixture.code_sums(start, K), n)
    return _table_scores(spark, start, tab, log=False)


def _table_scores(spark, start, tab, log):
    model = spark.createDataFrame([(c, row) for c, row in enumerate(tab)], "cluster int, t array<double>")
    total = F.aggregate("codes", F.lit(0.0), lambda s, i: s + F.element_at("t", i + 1))
    return start.select("pep_id", "codes").join(F.broadcast(model)).select("pep_id", "cluster", rounded(F.log(total) if log else total).alias("score"))  # one row per cluster


BINOMIAL = f"""{RESIDUES}, {ALPHABET_SQL}, grid AS (SELECT c.cluster, pos::INT AS pos, alpha.aa, freq FROM (SELECT DISTINCT label AS cluster FROM embeddings) c CROSS JOIN range(11) t(pos) CROSS JOIN alpha),
k AS (SELECT g.cluster, g.pos, g.aa, any_value(g.freq) AS freq, count(res.aa) AS k FROM grid g LEFT JOIN res ON res.label = g.cluster AND res.pos = g.pos AND res.aa = g.aa GROUP BY ALL),
bg AS (SELECT pos, aa, (sum(k) + any_value(freq)) / sum(sum(k) + any_value(freq)) OVER (PARTITION BY pos) AS p FROM k GROUP BY pos, aa),
n AS (SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label),
p AS (SELECT k.cluster, k.pos, k.aa, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(bg.p) + (n - j) * ln(1 - bg.p))) AS cdf
  FROM (SELECT k.*, n.n, unnest(range(k.k + 1)) AS j FROM k JOIN n USING (cluster)) k JOIN bg ON bg.pos = k.pos AND bg.aa = k.aa GROUP BY k.cluster, k.pos, k.aa)"""


@query(f"WITH {BINOMIAL} SELECT pep_id, p.cluster, round(ln(sum(cdf)), 4) + 0.0 AS score FROM res JOIN p USING (pos, aa) GROUP BY pep_id, p.cluster")
def binomial_score(spark, sf_dir):
    start = rows(spark, sf_dir)
    n, _, _ = mixture.moments(start, K)
    bg = background_weights(spark, sf_dir)
    return _table_scores(spark, start, mixture.binomial_table(mixture.code_sums(start, K), n, bg), log=True)


PSSM = f"""{RESIDUES}, {ALPHABET_SQL}, grid AS (SELECT c.cluster, pos::INT AS pos, alpha.aa FROM (SELECT DISTINCT label AS cluster FROM embeddings) c CROSS JOIN range(11) t(pos) CROSS JOIN alpha),
q AS (SELECT g.cluster, g.pos, g.aa, count(res.aa) AS q FROM grid g LEFT JOIN res ON res.label = g.cluster AND res.pos = g.pos AND res.aa = g.aa GROUP BY ALL),
b AS (SELECT pos, aa, sum(q) AS b FROM q GROUP BY ALL),
b2 AS (SELECT pos, aa, CASE WHEN pos = 5 THEN b ELSE b / avg(b) OVER (PARTITION BY pos) END AS b FROM b),
v AS (SELECT cluster, pos, aa, q, CASE WHEN pos = 5 THEN q ELSE q / avg(q) OVER (PARTITION BY cluster, pos) END AS v,
  avg(q) FILTER (aa IN ('S', 'T', 'Y')) OVER (PARTITION BY cluster, pos) AS m FROM q),
pssm AS (SELECT cluster, v.pos, v.aa, greatest(0.0, least(3.0,
  CASE WHEN v.pos = 5 AND v.aa IN ('S', 'T', 'Y') THEN CASE WHEN q > 0 THEN log2(q / m) ELSE 0 END
       WHEN b > 0 AND v / b > 0 THEN log2(v / b) ELSE 0 END)) AS score FROM v JOIN b2 ON b2.pos = v.pos AND b2.aa = v.aa)"""


def pssms(spark, sf_dir):
    pep = peptides(spark, sf_dir)
    resp = pep.select("pep_id", F.col("label").alias("cluster"), F.lit(1.0).alias("r"), F.lit(1).alias("hard"))
    return profiles.scoring(sequence.residues(pep), resp)


@query(f"WITH {PSSM} SELECT cluster, pos, aa, round(score, 4) + 0.0 AS score FROM pssm")
def pssm_clusters(spark, sf_dir):
    return pssms(spark, sf_dir).withColumn("score", rounded(F.col("score")))


@query(f"WITH {PSSM} SELECT cluster, round(sum(score), 4) AS total FROM pssm WHERE pos <> 5 GROUP BY cluster")
def pssm_information(spark, sf_dir):
    return profiles.information(pssms(spark, sf_dir)).withColumn("total", rounded(F.col("total")))


MOVED = [3, 1, 4, 0, 2, 9, 6, 8, 7]
ORDER = profiles.shuffle_order(MOVED)


@query(f"WITH {PSSM} SELECT cluster, list_position({ORDER}, pos)::INT - 1 AS pos, aa, round(score, 4) + 0.0 AS score FROM pssm")
def pssm_shuffle(spark, sf_dir):
    return profiles.permuted(pssms(spark, sf_dir), ORDER).withColumn("score", rounded(F.col("score")))


PSPL = f"""{PSSM}, pspl AS (SELECT n_name AS kinase, p::INT AS slot, aa, ('0x' || substr(md5(n_name || ':' || p || ':' || aa), 1, 6))::INT % 300 / 100.0::DOUBLE AS score FROM nation CROSS JOIN range(9) t(p) CROSS JOIN alpha),
dist AS (SELECT kinase, cluster, sqrt(sum(pow(pssm.score - pspl.score, 2))) AS d FROM pspl JOIN pssm ON pspl.aa = pssm.aa AND pspl.slot = CASE WHEN pos < 5 THEN pos ELSE pos - 1 END AND pos <> 5 AND pos <> 10 GROUP BY ALL)"""


def reference_profiles(spark, sf_dir):
    cells = table(spark, sf_dir, "nation").select(F.col("n_name").alias("kinase")).crossJoin(spark.range(9).select(F.col("id").cast("int").alias("pos"))).crossJoin(sequence.alphabet(spark).select("aa"))  # 25 x 9 x 20 rows
    key = F.concat_ws(":", "kinase", F.col("pos").cast("string"), "aa")
    return cells.withColumn("score", F.conv(F.substring(F.md5(key.cast("binary")), 1, 6), 16, 10).cast("int") % 300 / 100.0)


def kinase_distances(spark, sf_dir):
    return profiles.distances(pssms(spark, sf_dir), reference_profiles(spark, sf_dir))


@query(f"WITH {PSPL} SELECT kinase, cluster, round(d, 4) AS d FROM dist")
def kinase_distance(spark, sf_dir):
    return kinase_distances(spark, sf_dir).withColumn("d", rounded(F.col("d")))


@query(f"WITH {PSPL}, a AS (SELECT kinase, cluster, d - avg(d) OVER (PARTITION BY kinase) AS d FROM dist) SELECT kinase, cluster, round(d - avg(d) OVER (PARTITION BY cluster), 4) + 0.0 AS d FROM a")
def distance_centering(spark, sf_dir):
    return profiles.centred(kinase_distances(spark, sf_dir)).withColumn("d", rounded(F.col("d")))


@query(f"WITH {PSPL}, k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d, kinase) AS place FROM dist) SELECT kinase, cluster, round(d, 4) AS d, place::INT AS place FROM k WHERE place <= 5")
def kinase_topk(spark, sf_dir):
    return profiles.nearest(kinase_distances(spark, sf_dir), 5).withColumn("d", rounded(F.col("d")))
