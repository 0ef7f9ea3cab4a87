"""Rank tests, corrections, ROC analysis, label association and regressions as queries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sigloom.functions.special import rounded
from sigloom.operators import clusterers, filters, mixture, regression, stats
from sigloom.plans.base import K, MASKED, MODEL, SAMPLES, SIGNAL, background_weights, masked, rows, signal, table
from sigloom.plans.matrices import hard_labels
from sigloom.plans.registry import query

#: Independent fits that are handed to the cluster at a time.
FITS_AT_ONCE = 4
TAIL = """least(1.0, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * (1 / (1 + 0.2316419 * z)) * (0.319381530 + (1 / (1 + 0.2316419 * z)) * (-0.356563782
 + (1 / (1 + 0.2316419 * z)) * (1.781477937 + (1 / (1 + 0.2316419 * z)) * (-1.821255978 + (1 / (1 + 0.2316419 * z)) * 1.330274429)))))"""
RANKS = f"""{SIGNAL}, v AS (SELECT s, round(x, 2) AS x, label % 2 = 1 AS y FROM sig),
r AS (SELECT s, y, rank() OVER (PARTITION BY s ORDER BY x) + (count(*) OVER (PARTITION BY s, x) - 1) / 2 AS rk, count(*) OVER (PARTITION BY s, x) AS t FROM v),
g AS (SELECT s, sum(rk) FILTER (y) AS r1, count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n2, sum(t * t - 1) AS ties FROM r GROUP BY s),
u AS (SELECT s, n1, n2, r1 - n1 * (n1 + 1) / 2 AS u1, n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))) AS w FROM g),
mw AS (SELECT s, n1, n2, u1, abs((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(w)) AS z, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(w) AS z0 FROM u),
pv AS (SELECT *, {TAIL} AS p FROM mw),
hs AS (SELECT *, 1 - pow(1 - p, count(*) OVER () - row_number() OVER (ORDER BY p, s) + 1) AS raw FROM pv),
adj AS (SELECT *, least(1.0, max(raw) OVER (ORDER BY p, s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adjusted FROM hs)"""


def two_groups(spark, sf_dir):
    return signal(spark, sf_dir).select("s", F.round("x", 2).alias("x"), (F.col("label") % 2 == 1).alias("y"))


def tests(spark, sf_dir):
    got = stats.rank_sums(two_groups(spark, sf_dir), "s", "x", "y")
    return got.withColumn("p", stats.tail_probability(F.col("z")))


@query(f"WITH {RANKS} SELECT s, n1, n2, round(u1, 1) AS u1, round(z0, 4) + 0.0 AS z, round(p, 4) AS p FROM pv")
def mann_whitney(spark, sf_dir):
    return tests(spark, sf_dir).select("s", "n1", "n2", rounded(F.col("u1"), 1).alias("u1"), rounded(F.col("z")).alias("z"), rounded(F.col("p")).alias("p"))


@query("""WITH RECURSIVE v AS (SELECT p_brand || '-' || p_size AS grp, p_partkey % 2 = 1 AS y, md5(p_partkey::VARCHAR) AS x FROM part),
g AS (SELECT grp, count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n2 FROM v GROUP BY grp HAVING count(*) FILTER (y) > 0 AND count(*) FILTER (NOT y) > 0),
u AS (SELECT a.grp, count(*) FILTER (a.x > b.x) AS u1 FROM v a JOIN v b ON a.grp = b.grp AND a.y AND NOT b.y GROUP BY a.grp),
walk(i, j, u) AS (SELECT 0, 0, 0 UNION ALL SELECT i + a, j + 1 - a, u + CASE WHEN a = 1 THEN j ELSE 0 END FROM walk, (VALUES (0), (1)) s(a) WHERE i + a <= (SELECT max(n1) FROM g) AND j + 1 - a <= (SELECT max(n2) FROM g))
SELECT g.grp, any_value(n1) AS n1, any_value(n2) AS n2, any_value(u1)::DOUBLE AS u1, round(least(1.0, 2.0::DOUBLE * count(*) FILTER (walk.u >= greatest(u1, n1 * n2 - u1)) / count(*)), 4) + 0.0 AS p
FROM g JOIN u ON u.grp = g.grp JOIN walk ON i = n1 AND j = n2 GROUP BY g.grp""")
def rank_test_exact(spark, sf_dir):
    """Small samples: the exact distribution of U."""
    place = F.conv(F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 13), 16, 10).cast("double")
    own = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("grp"), place.alias("x"), (F.col("p_partkey") % 2 == 1).alias("y"))
    got = stats.rank_probability(stats.rank_sums(own, "grp", "x", "y").filter("n1 > 0 and n2 > 0"))
    return got.select("grp", "n1", "n2", "u1", rounded(F.col("p")).alias("p"))


@query(f"WITH {RANKS} SELECT s, round(p, 4) AS p, round(p_adjusted, 4) AS p_adjusted, CASE WHEN p_adjusted < 0.05 THEN '*' WHEN p_adjusted < 0.01 THEN '**' ELSE '' END AS stars FROM adj")
def holm_sidak(spark, sf_dir):
    adj = stats.step_down(tests(spark, sf_dir), "s")
    return adj.select("s", rounded(F.col("p")).alias("p"), rounded(F.col("p_adjusted")).alias("p_adjusted"), stats.stars(F.col("p_adjusted")).alias("stars"))


@query(f"WITH {RANKS}, m AS (SELECT s, avg(x) FILTER (NOT y) - avg(x) FILTER (y) AS fc FROM v GROUP BY s) SELECT s, round(p_adjusted, 4) AS p_adjusted, round(fc, 4) + 0.0 AS fc FROM adj JOIN m USING (s)")
def volcano(spark, sf_dir):
    fc = two_groups(spark, sf_dir).groupBy("s").agg((F.avg(F.when(~F.col("y"), F.col("x"))) - F.avg(F.when(F.col("y"), F.col("x")))).alias("fc"))
    adj = stats.step_down(tests(spark, sf_dir), "s").select("s", rounded(F.col("p_adjusted")).alias("p_adjusted"))
    return adj.join(fc, "s").withColumn("fc", rounded(F.col("fc")))


ROC = """base AS (SELECT doc_id, toxic = 1 AS y, round(n_chars / 100.0, 0) AS score FROM documents JOIN labels USING (doc_id)),
cls AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY y) AS n, (SELECT count(*) FROM base WHERE NOT y) AS n0 FROM base),
siz AS (SELECT y, f, any_value(n) // 5 + CASE WHEN y THEN (CASE WHEN (f - any_value(n0) % 5 + 5) % 5 < any_value(n) % 5 THEN 1 ELSE 0 END) ELSE (CASE WHEN f < any_value(n) % 5 THEN 1 ELSE 0 END) END AS size FROM cls CROSS JOIN range(5) t(f) GROUP BY y, f),
edge AS (SELECT y, f, sum(size) OVER (PARTITION BY y ORDER BY f) AS past, sum(size) OVER (PARTITION BY y ORDER BY f) - size AS first FROM siz),
fold AS (SELECT doc_id, cls.y, score, f::INT AS fold FROM cls JOIN edge ON edge.y = cls.y AND k >= first AND k < past),
pts AS (SELECT fold, score, sum(sum((NOT y)::INT)) OVER w / sum(sum((NOT y)::INT)) OVER (PARTITION BY fold) AS fpr, sum(sum(y::INT)) OVER w / sum(sum(y::INT)) OVER (PARTITION BY fold) AS tpr
  FROM fold GROUP BY fold, score WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
area AS (SELECT fold, sum((fpr - x0) * (tpr + y0) / 2) AS auc FROM (SELECT *, coalesce(lag(fpr) OVER q, 0) AS x0, coalesce(lag(tpr) OVER q, 0) AS y0 FROM pts WINDOW q AS (PARTITION BY fold ORDER BY score DESC)) GROUP BY fold)"""


def points(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    base = base.select("doc_id", (F.col("toxic") == 1).alias("y"), F.round(F.col("n_chars") / 100.0, 0).alias("score"))
    return stats.roc_points(stats.folds(base, 5, "y", "doc_id"), "score", "y", "fold")


@query(f"WITH {ROC} SELECT fold, score, round(fpr, 4) AS fpr, round(tpr, 4) AS tpr FROM pts")
def roc_points(spark, sf_dir):
    return points(spark, sf_dir).select("fold", "score", rounded(F.col("fpr")).alias("fpr"), rounded(F.col("tpr")).alias("tpr"))


CURVE = f"""{ROC}, seg AS (SELECT fold, fpr, tpr, coalesce(lag(fpr) OVER q, 0) AS x0, coalesce(lag(tpr) OVER q, 0) AS y0 FROM pts WINDOW q AS (PARTITION BY fold ORDER BY score DESC)),
grid AS (SELECT range / 99.0::DOUBLE AS x FROM range(100)),
curve AS (SELECT x, CASE WHEN x = 0 THEN 0 WHEN x = 1 THEN 1 ELSE avg(y0 + (x - x0) / (fpr - x0) * (tpr - y0)) END AS tpr FROM grid JOIN seg ON fpr > x0 AND x >= x0 AND (x < fpr OR (x = 1 AND fpr = 1)) GROUP BY x)"""


@query(f"WITH {CURVE} SELECT round(x, 4) + 0.0 AS x, round(tpr, 4) + 0.0 AS tpr FROM curve")
def mean_roc_curve(spark, sf_dir):
    return stats.mean_roc(points(spark, sf_dir), "fold").select(rounded(F.col("x")).alias("x"), rounded(F.col("tpr")).alias("tpr"))


@query(f"""WITH {CURVE}, a AS (SELECT sum((x - px) * (tpr + pt) / 2) AS auc FROM (SELECT *, lag(x) OVER (ORDER BY x) AS px, lag(tpr) OVER (ORDER BY x) AS pt FROM curve)),
e AS (SELECT stddev_samp(auc) / sqrt(count(*)) AS sem FROM area) SELECT round(auc, 4) AS auc, round(sem, 4) AS sem FROM a, e""")
def mean_auc(spark, sf_dir):
    """The area under the mean of the folds' curves, and the standard error of the folds' own areas."""
    own = points(spark, sf_dir)
    area = stats.curve_area(stats.mean_roc(own, "fold"))
    sem = stats.auc(own, "fold").agg((F.stddev_samp("auc") / F.sqrt(F.count(F.lit(1)))).alias("sem"))
    return area.crossJoin(F.broadcast(sem)).select(rounded(F.col("auc")).alias("auc"), rounded(F.col("sem")).alias("sem"))  # one row each


@query("""WITH base AS (SELECT doc_id, toxic = 1 AS y, round(n_chars / 100.0, 0) AS score FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) AS n FROM base),
pl AS (SELECT rep::INT AS repeat, base.*, row_number() OVER (PARTITION BY rep ORDER BY md5('fold' || rep || ':' || doc_id), doc_id) AS place FROM base CROSS JOIN range(10) t(rep)),
fo AS (SELECT repeat, y, score, CASE WHEN place <= (n // 4 + 1) * (n % 4) THEN (place - 1) // (n // 4 + 1) ELSE n % 4 + (place - 1 - (n // 4 + 1) * (n % 4)) // (n // 4) END AS fold FROM pl, n),
pts AS (SELECT repeat, fold, score, sum(sum((NOT y)::INT)) OVER w / nullif(sum(sum((NOT y)::INT)) OVER (PARTITION BY repeat, fold), 0) AS fpr, sum(sum(y::INT)) OVER w / nullif(sum(sum(y::INT)) OVER (PARTITION BY repeat, fold), 0) AS tpr
  FROM fo GROUP BY repeat, fold, score WINDOW w AS (PARTITION BY repeat, fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT repeat, fold::INT AS fold, round(sum((fpr - x0) * (tpr + y0) / 2), 4) + 0.0 AS auc FROM (SELECT *, coalesce(lag(fpr) OVER q, 0) AS x0, coalesce(lag(tpr) OVER q, 0) AS y0 FROM pts WINDOW q AS (PARTITION BY repeat, fold ORDER BY score DESC)) GROUP BY repeat, fold""")
def repeated_fold_areas(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    base = base.select("doc_id", (F.col("toxic") == 1).alias("y"), F.round(F.col("n_chars") / 100.0, 0).alias("score"))
    own = stats.roc_points(stats.repeated_folds(base, 4, 10, "doc_id"), "score", "y", "repeat", "fold")
    return stats.auc(own, "repeat", "fold").withColumn("auc", rounded(F.col("auc")))


AMI = f"""{MODEL}, j AS (SELECT label, cluster, count(*) AS n FROM hard GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY label) AS a, sum(n) OVER (PARTITION BY cluster) AS b, sum(n) OVER () AS z FROM j),
m AS (SELECT sum(n / z * ln(n * z / (a * b))) AS mi FROM t), la AS (SELECT label, sum(n)::BIGINT AS a FROM j GROUP BY label), lb AS (SELECT cluster, sum(n)::BIGINT AS b FROM j GROUP BY cluster), tot AS (SELECT sum(n)::BIGINT AS z FROM j),
h AS (SELECT (SELECT -sum(a / z * ln(a / z)) FROM la, tot) AS ha, (SELECT -sum(b / z * ln(b / z)) FROM lb, tot) AS hb),
e AS (SELECT sum(k / z * ln(z * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(z - a + 1) + lgamma(z - b + 1) - lgamma(z + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(z - a - b + k + 1))) AS emi
  FROM (SELECT a, b, z, unnest(range(greatest(1, a + b - z), least(a, b) + 1))::DOUBLE AS k FROM la, lb, tot))"""


@query(f"WITH {AMI} SELECT round((mi - emi) / ((ha + hb) / 2 - emi), 4) + 0.0 AS ami FROM m, h, e")
def adjusted_information(spark, sf_dir):
    ami = stats.adjusted_mutual_information(hard_labels(spark, sf_dir), "label", "cluster")
    return spark.createDataFrame([(float(ami),)], "ami double").select(rounded(F.col("ami")).alias("ami"))


@query(f"WITH {MODEL}, j AS (SELECT label, cluster, count(*) AS n FROM hard GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY label) AS a, sum(n) OVER (PARTITION BY cluster) AS b, sum(n) OVER () AS z FROM j) SELECT round(sum(n / z * ln(n * z / (a * b))), 4) AS mi, round(-sum(n / z * ln(a / z)), 4) AS h_a, round(-sum(n / z * ln(b / z)), 4) AS h_b FROM t")
def mutual_info(spark, sf_dir):
    got = stats.mutual_information(hard_labels(spark, sf_dir), "label", "cluster")
    return got.select(*[rounded(F.col(c)).alias(c) for c in ("mi", "h_a", "h_b")])


@query()
def baseline_clusterers(spark, sf_dir):
    """Adjusted mutual information between all pairs of the given labels and the baseline clusterings."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.functions import array_to_vector

    d = rows(spark, sf_dir).select("pep_id", "label", "x", array_to_vector("x").alias("features"))
    points, found = clusterers.representatives(d.drop("features"), "x")
    for name, kind in (("kmeans", KMeans), ("bisecting", BisectingKMeans)):
        found = kind(k=K, seed=1, maxIter=10, predictionCol=name).fit(d).transform(found.withColumn("features", array_to_vector("x"))).drop("features")
    centres = clusterers.leaf_centres(d, "x")
    found = clusterers.nearest_centre(found, "x", centres, "leaf")
    cells = found.groupBy("label", "kmeans", "bisecting", "point", "leaf").count().collect()  # bounded by labels and representatives
    sizes = np.zeros(len(points))
    for r in cells:
        sizes[r["point"]] += r["count"]
    held = clusterers.baselines(points, sizes, K)
    leaves = clusterers.birch(centres, K)
    names = ["label", "kmeans", "bisecting", "birch", *held]
    label = lambda r, name: int(leaves[r["leaf"]]) if name == "birch" else int(held[name][r["point"]]) if name in held else r[name]
    out = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            pairs: dict[tuple, int] = {}
            for r in cells:
                key = label(r, a), label(r, b)
                pairs[key] = pairs.get(key, 0) + r["count"]
            out.append((a, b, round(stats.association(pairs), 4)))
    return spark.createDataFrame(out, "a string, b string, ami double")


@query()
def hierarchical_linkage(spark, sf_dir):
    """Centroid linkage of the clusters' centres: merges in order, nearest first."""
    got = signal(spark, sf_dir).groupBy("label", "s").agg(F.avg("x").alias("mu")).collect()  # clusters by samples
    labels = sorted({r["label"] for r in got})
    points = np.zeros((len(labels), SAMPLES))
    for r in got:
        points[labels.index(r["label"]), r["s"]] = r["mu"]
    merges = clusterers.linkage(points, np.ones(len(labels)), "centroid")
    return spark.createDataFrame([(k, a, b, round(h, 4), int(n)) for k, (a, b, h, n) in enumerate(merges)], "step int, a int, b int, height double, size int")


@query("""WITH c AS (SELECT l_returnflag AS grp, 0.5 + (least(49, greatest(0, floor(l_quantity - 0.5))) + 0.5) AS x, count(l_extendedprice) AS n, sum(l_extendedprice) AS y FROM lineitem GROUP BY ALL),
t AS (SELECT grp, ceil(sum(n) * 2.0::DOUBLE / 3) AS least_n FROM c GROUP BY grp),
p AS (SELECT a.grp, a.x AS x0, b.x - a.x AS d, b.n, b.y, least_n FROM c a JOIN c b USING (grp) JOIN t USING (grp)),
s AS (SELECT *, sum(n) OVER (PARTITION BY grp, x0 ORDER BY abs(d)) AS seen FROM p),
h AS (SELECT *, min(abs(d)) FILTER (seen >= least_n) OVER (PARTITION BY grp, x0) AS h FROM s),
w AS (SELECT *, CASE WHEN d = 0 THEN 1 WHEN abs(d) < h THEN pow(1 - pow(abs(d) / h, 3), 3) ELSE 0 END AS w FROM h),
m AS (SELECT grp, x0, sum(w * n) AS s0, sum(w * n * d) AS s1, sum(w * n * d * d) AS s2, sum(w * y) AS t0, sum(w * y * d) AS t1 FROM w GROUP BY grp, x0)
SELECT grp, x0 AS x, round(CASE WHEN s0 * s2 - s1 * s1 > 1e-9 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END, 2) AS fit FROM m""")
def lowess_fit(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_quantity", "l_extendedprice")
    return stats.local_fit(items, "grp", "l_quantity", "l_extendedprice", 0.5, 50.5).withColumn("fit", rounded(F.col("fit"), 2))


#: Clusters and sequence weights of the imputation runs.
IMPUTED = ((1, 0.0), (45, 0.0), (1, 100.0), (45, 100.0), (1, 1e6), (45, 1e6), (2, 0.0), (2, 100.0), (20, 0.0), (20, 100.0), (40, 0.0), (40, 100.0))


def experiments(spark, sf_dir):
    """The signal's seen cells, eight samples an experiment."""
    return masked(spark, sf_dir).select("pep_id", "label", "s", (F.col("s") / 8).cast("int").alias("experiment"), "x")


@query(f"""WITH {MASKED}, c AS (SELECT pep_id, s, s // 8 AS experiment, x FROM mis),
p AS (SELECT pep_id, arg_min(experiment, md5('mask' || pep_id || ':' || experiment)) AS gone FROM (SELECT DISTINCT pep_id, experiment FROM c WHERE x IS NOT NULL) GROUP BY pep_id)
SELECT pep_id, s, round(CASE WHEN experiment = gone THEN NULL ELSE x END, 4) + 0.0 AS x FROM c JOIN p USING (pep_id)""")
def masked_experiments(spark, sf_dir):
    return filters.masked_experiment(experiments(spark, sf_dir)).select("pep_id", "s", rounded(F.col("x")).alias("x"))


@query(f"""WITH {MASKED}, c AS (SELECT pep_id, s, s // 8 AS experiment, x FROM mis),
p AS (SELECT pep_id, arg_min(experiment, md5('mask' || pep_id || ':' || experiment)) AS gone FROM (SELECT DISTINCT pep_id, experiment FROM c WHERE x IS NOT NULL) GROUP BY pep_id),
h AS (SELECT s, x AS truth, CASE WHEN experiment = gone THEN NULL ELSE x END AS x FROM c JOIN p USING (pep_id)),
f AS (SELECT truth, x, avg(x) OVER (PARTITION BY s) AS mean, min(x) OVER (PARTITION BY s) AS least FROM h)
SELECT m AS method, round(sum(pow(truth - CASE m WHEN 'average' THEN mean WHEN 'minimum' THEN least ELSE 0 END, 2)), 4) AS sse FROM f, (VALUES ('average'), ('minimum'), ('zero')) v(m) WHERE x IS NULL AND truth IS NOT NULL GROUP BY m""")
def baseline_errors(spark, sf_dir):
    return _baseline_errors(experiments(spark, sf_dir)).select("method", rounded(F.col("sse")).alias("sse"))


def _baseline_errors(cells):
    hidden = filters.masked_experiment(cells.withColumn("truth", F.col("x")))
    per = hidden.groupBy("s").agg(F.avg("x").alias("average"), F.min("x").alias("minimum"))
    fills = F.create_map(F.lit("average"), F.col("average"), F.lit("minimum"), F.col("minimum"), F.lit("zero"), F.lit(0.0))
    gone = hidden.filter("x is null and truth is not null").join(F.broadcast(per), "s")  # a row per sample
    return gone.select("truth", F.explode(fills).alias("method", "fill")).groupBy("method").agg(F.sum(F.pow(F.col("truth") - F.col("fill"), 2)).alias("sse"))


def masked_rows(spark, sf_dir, seed="mask"):
    """Mixture rows with one experiment hidden in each, and ``truth``."""
    cells = filters.masked_experiment(experiments(spark, sf_dir).withColumn("truth", F.col("x")), seed=seed)
    wide = cells.groupBy("pep_id").agg(F.array_sort(F.collect_list(F.struct("s", "x", "truth"))).alias("c"))  # as many cells as samples
    own = wide.select("pep_id", F.col("c.x").alias("x"), F.col("c.truth").alias("truth")).withColumn("miss", F.transform("x", lambda v: v.isNull()))
    return own.join(rows(spark, sf_dir).select("pep_id", "codes"), "pep_id")


def _error(got):
    cells = got.select(F.explode(F.arrays_zip("x", "miss", "truth")).alias("c")).filter("c.miss and c.truth is not null")
    return cells.agg(F.sum(F.pow(F.col("c.x") - F.col("c.truth"), 2))).first()[0]


def imputation_errors(spark, sf_dir, pairs, runs=1):
    """run, clusters, weight, method, sse at hidden cells, of the mixture for each pair and of the baselines; runs differ in what is hidden.

    Fits are independent and go to the cluster side by side, the largest first; one cluster has but one start.
    """
    out = []
    for run in range(runs):
        with ThreadPoolExecutor(2 * max(FITS_AT_ONCE, spark.sparkContext.defaultParallelism)) as pool:  # some only wait for their start
            background = pool.submit(background_weights, spark, sf_dir)
            given = mixture.settle(masked_rows(spark, sf_dir, f"mask{run or ''}"))
            low_rank = pool.submit(lambda given=given: _error(stats.low_rank_fill(given.drop("codes"), 5, tol=1e-5)))
            plain = pool.submit(lambda run=run: [(r["method"], r["sse"]) for r in _baseline_errors(experiments(spark, sf_dir)).collect()] if not run else [])  # three rows
            start = stats.soft_fill(given)

            def one(own, k, weight, background=background):
                error, model = mixture.imputation_error(own.result(), k, "binomial", weight, background.result())
                return model.bounds[-1], error

            fits = {}
            for k in sorted({k for k, _ in pairs}, reverse=True):
                starts = [pool.submit(mixture.kmeans_start, start, k, s, True) for s in ((1, 2) if k > 1 else (1,))]
                for weight in sorted({w for c, w in pairs if c == k}, reverse=True):
                    fits[k, weight] = [pool.submit(one, own, k, weight) for own in starts]
        out += [(run, k, weight, "mixture", max((f.result() for f in fits[k, weight]), key=lambda f: f[0])[1]) for k, weight in pairs]
        base = [*plain.result(), ("low_rank", low_rank.result())]
        out += [(run, k, weight, method, sse) for k, weight in pairs for method, sse in base]
    return spark.createDataFrame([(r, k, w, m, round(float(e), 2)) for r, k, w, m, e in out], "run int, clusters int, weight double, method string, sse double")


@query()
def imputation_grid(spark, sf_dir):
    """Squared errors at hidden cells of the converged mixture and the baselines, over numbers of clusters and sequence weights."""
    return imputation_errors(spark, sf_dir, IMPUTED)


@query()
def phenotype_sweep(spark, sf_dir):
    """Area under the mean curve of searched models that tell three labels of the samples from the clusters' centres, over sequence weights.

    Folds are shuffled and repeated ten times; each fit searches its penalty by folds of its own.
    """
    return phenotype_areas(spark, sf_dir)


def phenotype_areas(spark, sf_dir, weights=(0.0, 1e2, 1e6), runs=1, folds=2, repeats=10, clusters=35):
    bg = background_weights(spark, sf_dir)
    start = mixture.settle(rows(spark, sf_dir))
    tasks = [(weight, run) for weight in weights for run in range(runs)]

    def one(task):
        weight, run = task
        fits = [mixture.fit(mixture.kmeans_start(start, clusters, 1 + 2 * run + s), clusters, "binomial", weight, bg)[1] for s in (0, 1)]
        centres = np.array(max(fits, key=lambda m: m.bounds[-1]).means).T
        return centres - centres.mean(axis=1, keepdims=True)

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        centres = list(pool.map(one, tasks))
    s = np.arange(SAMPLES)
    labels = {"odd": s % 2 == 1, "third": s % 3 == 0, "either": (s % 5 == 0) | (s % 7 == 0)}
    jobs = [(w, r, name, k, f, t) for t, (w, r) in enumerate(tasks) for name in labels for k in range(repeats) for f in range(folds)]

    def fits(batches):
        for batch in batches:
            curves = []
            for row in batch.to_pylist():
                x, y = centres[row["task"]], labels[row["label"]]
                test = regression.repeated(SAMPLES, folds, row["repeat"]) == row["fold"]
                w, _ = regression.search(x[~test], y[~test], folds)
                curves.append(regression.on_grid(*regression.curve(np.round(regression.scores(w, x[test]), 6), y[test])).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("weight", "run", "label")), pa.array(curves, pa.list_(pa.float64()))], names=["weight", "run", "label", "curve"])

    dealt = spark.createDataFrame(jobs, "weight double, run int, label string, repeat int, fold int, task int").repartition(len(jobs))
    got = dealt.mapInArrow(fits, "weight double, run int, label string, curve array<double>").collect()  # a row per fit
    curves: dict[tuple, list] = {}
    for r in got:
        curves.setdefault((r["weight"], r["run"], r["label"]), []).append(r["curve"])
    return spark.createDataFrame([(*key, round(regression.area(np.array(c)), 4)) for key, c in sorted(curves.items())], "weight double, run int, label string, auc double")


@query()
def pca_variance(spark, sf_dir):
    _, _, share = stats.principal(rows(spark, sf_dir), "x")
    return spark.createDataFrame([(i, round(float(v), 4)) for i, v in enumerate(share)], "part int, share double")


@query()
def pca_scores(spark, sf_dir):
    """Coordinates of the rows along the first two directions; a direction's largest entry is positive."""
    own = rows(spark, sf_dir)
    mean, loadings, _ = stats.principal(own, "x")
    got = stats.principal_scores(own.select("pep_id", "x"), "x", mean, loadings)
    return got.select("pep_id", rounded(F.col("pc")[0]).alias("pc1"), rounded(F.col("pc")[1]).alias("pc2"))


@query()
def pca_loadings(spark, sf_dir):
    _, loadings, _ = stats.principal(rows(spark, sf_dir), "x")
    return spark.createDataFrame([(s, round(float(a), 4), round(float(b), 4)) for s, (a, b) in enumerate(loadings)], "s int, pc1 double, pc2 double")


@query()
def logreg_cv(spark, sf_dir):
    """Areas under the curves of models that tell the parity of a cluster from its centred samples, with the penalty that inner folds pick, and under their mean."""
    cells = signal(spark, sf_dir)
    centred = cells.join(cells.groupBy("s").agg(F.avg("x").alias("mean")), "s").withColumn("x", F.col("x") - F.col("mean"))
    wide = centred.groupBy("pep_id", "label").agg(F.array_sort(F.collect_list(F.struct("s", "x"))).alias("c"))  # as many cells as samples
    scored = stats.searched_scores(wide.select("pep_id", (F.col("label") % 2 == 1).alias("y"), F.col("c.x").alias("x")), 3)
    own = mixture.settle(stats.roc_points(scored, "score", "y", "fold"))
    area = stats.curve_area(stats.mean_roc(own, "fold")).first()["auc"]
    return stats.auc(own, "fold").select("fold", rounded(F.col("auc"), 3).alias("auc"), rounded(F.lit(float(area)), 3).alias("mean_auc"))
