"""Inputs that the core queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.residues import ALPHABET, CENTRE, FREQUENCIES, WINDOW, pam250
from sigloom.operators import mixture, sequence

K, SAMPLES = 10, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` as they are read; only a table of fewer parts than there are cores is dealt out anew."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pep_id, s, x, label: embeddings as a long signal; the label is the initial cluster."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pep_id"), "label", F.posexplode("embedding").alias("s", "v")).select("pep_id", "label", "s", F.col("v").cast("double").alias("x"))


def hidden():
    """Cells that count as missing, by a rule of row and sample."""
    return (F.col("pep_id") * 31 + F.col("s") * 17) % 11 == 0


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal with ``truth`` and x null where hidden."""
    return signal(spark, sf_dir).withColumn("truth", F.col("x")).withColumn("x", F.when(~hidden(), F.col("x")))


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pep_id, seq, label: a window per embedding from its id's hash, centred on S, T or Y."""
    digest = F.md5(F.col("vec_id").cast("string").cast("binary"))
    number = lambda p: F.conv(F.substring(digest, 2 * p + 1, 2), 16, 10).cast("int")
    letters = [F.substring(F.lit("STY" if p == CENTRE else ALPHABET), number(p) % (3 if p == CENTRE else 20) + 1, F.lit(1)) for p in range(WINDOW)]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pep_id"), F.concat(*letters).alias("seq"), "label")


def rows(spark: SparkSession, sf_dir: str, *, hide: bool = False) -> DataFrame:
    """Mixture rows: pep_id, x, miss, codes, r (one for the given label)."""
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pep_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")
    gone = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda s: (F.col("pep_id") * 31 + s * 17) % 11 == 0) if hide else F.transform("x", lambda v: F.lit(False))
    d = d.withColumn("miss", gone).join(peptides(spark, sf_dir).select("pep_id", mixture.codes(F.col("seq")).alias("codes")), "pep_id")
    if hide:
        d = d.withColumn("x", F.zip_with("x", "miss", lambda v, m: F.when(~m, v)))
    one = F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda c: F.when(c == F.col("label"), 1.0).otherwise(0.0))
    return d.withColumn("r", one)


def background_weights(spark: SparkSession, sf_dir: str) -> list[float]:
    """Share of each residue at each position of all windows, with pseudocounts, by code."""
    out = [0.0] * (20 * WINDOW)
    for r in sequence.weights(sequence.counts(sequence.residues(peptides(spark, sf_dir)))).collect():  # 220 rows
        out[r["pos"] * 20 + ALPHABET.index(r["aa"])] = r["p"]
    return out


SIGNAL = f"""sig AS (SELECT vec_id AS pep_id, label, unnest(range({SAMPLES}))::INT AS s, unnest(embedding)::DOUBLE AS x FROM embeddings)"""
MASKED = SIGNAL + """, mis AS (SELECT pep_id, label, s, x AS truth, CASE WHEN (pep_id * 31 + s * 17) % 11 <> 0 THEN x END AS x FROM sig)"""
RESIDUES = f"""res AS (SELECT vec_id AS pep_id, label, p::INT AS pos,
  CASE WHEN p = {CENTRE} THEN substr('STY', ('0x' || substr(md5(vec_id::VARCHAR), 2 * p::INT + 1, 2))::INT % 3 + 1, 1)
       ELSE substr('{ALPHABET}', ('0x' || substr(md5(vec_id::VARCHAR), 2 * p::INT + 1, 2))::INT % 20 + 1, 1) END AS aa
  FROM embeddings CROSS JOIN range({WINDOW}) t(p))"""
ALPHABET_SQL = "alpha AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {i}, {f}::DOUBLE)" for i, (a, f) in enumerate(FREQUENCIES.items())) + ") t(aa, aa_idx, freq))"
PAM_SQL = "pam AS (SELECT * FROM (VALUES " + ", ".join(f"('{ALPHABET[i]}', '{ALPHABET[j]}', {v})" for i, row in enumerate(pam250()) for j, v in enumerate(row)) + ") t(aa1, aa2, score))"
WINDOWS = f"""letters AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents),
chars AS (SELECT doc_id, unnest(string_split(l, '')) AS c, unnest(range(length(l))) AS i FROM letters WHERE length(l) > 10),
win AS (SELECT doc_id, seq FROM (SELECT doc_id, c{"".join(f" || lead(c, {k}) OVER w" for k in range(1, WINDOW))} AS seq FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i))
  WHERE regexp_full_match(seq, '[{ALPHABET}]{{5}}[STY][{ALPHABET}]{{5}}'))"""
EVENT_CELLS = """cells AS (SELECT user_id, event_type || '-' || strftime(ts, '%Y-%m-%d') AS sample, strftime(ts, '%Y-%m-%d') AS experiment, avg(value) AS x FROM events GROUP BY ALL)"""
MODEL = SIGNAL + """, mom AS (SELECT label AS cluster, s, sum(x) / (count(*) + 2.220446049250313e-15) AS mu,
  sum(x * x) / (count(*) + 2.220446049250313e-15) - (sum(x) / (count(*) + 2.220446049250313e-15)) ** 2 + 1e-6 AS var,
  count(*) + 2.220446049250313e-15 AS n FROM sig GROUP BY label, s),
pri AS (SELECT cluster, ln(n / sum(n) OVER ()) AS lp FROM (SELECT DISTINCT cluster, n FROM mom)),
ll AS (SELECT sig.pep_id, any_value(sig.label) AS label, mom.cluster, any_value(lp) - 0.5 * (count(*) * ln(2 * pi()) + sum(pow(x - mu, 2) / var) + sum(ln(var))) AS l
  FROM sig JOIN mom USING (s) JOIN pri USING (cluster) GROUP BY sig.pep_id, mom.cluster),
lse AS (SELECT pep_id, max(l) AS m, max(l) + ln(sum(exp(l - m0))) AS z FROM (SELECT *, max(l) OVER (PARTITION BY pep_id) AS m0 FROM ll) GROUP BY pep_id),
resp AS (SELECT ll.pep_id, label, cluster, l, z, exp(l - z) AS r FROM ll JOIN lse USING (pep_id)),
hard AS (SELECT pep_id, any_value(label) AS label, arg_max(cluster, (r, -cluster)) AS cluster FROM resp GROUP BY pep_id)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, sample, experiment, x: events as a sparse signal."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf_dir, "events").groupBy("user_id", F.concat("event_type", F.lit("-"), day).alias("sample"), day.alias("experiment")).agg(F.avg("value").alias("x"))
