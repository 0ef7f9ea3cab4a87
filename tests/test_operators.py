"""Core operators: invariants, published cases and edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import residues, special
from sigloom.operators import clusterers, filters, mixture, ordered, profiles, regression, rounds, sequence, stats
from sigloom.plans import base
from sigloom.sources import files

SF = "/root/testdata/sf0.001"


def test_fixed_tables():
    m = residues.pam250()
    assert len(m) == 20 and all(m[i][j] == m[j][i] for i in range(20) for j in range(20)) and m[17][17] == 17
    classes = residues.profile_classes()
    assert len(classes) == 64 and classes["ABL"] == "Y" and classes["AKT"] == "S/T"


def test_betainc_is_the_binomial_sum():
    for n, k, p in ((10, 3, 0.2), (200, 20, 0.05), (50, 49, 0.9)):
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert special.betainc(n - k, k + 1, 1 - p) == pytest.approx(want, abs=1e-11)


def test_exact_and_asymptotic_rank_tests():
    assert stats.exact_rank_test([1, 2, 3], [4, 5, 6]) == pytest.approx(0.1)
    assert stats.asymptotic_p(1.959963984540054) == pytest.approx(0.05, abs=1e-9)


def test_missing_modes(spark):
    rows = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 1, 2, None), ("b", 0, 1, 1.0), ("b", 1, 2, 2.0), ("c", 0, 1, None), ("c", 1, 2, None)], "k string, s int, experiment int, x double")
    keys = lambda df: {r["k"] for r in df.select("k").collect()}
    assert keys(filters.incomplete(rows, "k", 2, ratio=0.5, experiments=2)) == {"a", "b"}
    assert keys(filters.incomplete(rows, "k", 2, experiments=2)) == {"b"}
    with pytest.raises(ValueError):
        filters.incomplete(rows, "k", 2)


def test_background_quota_scales_to_scarce_tyrosines(spark):
    row = lambda k, c: (k, "AAAAA" + c + "AAAAA")
    back = spark.createDataFrame([row(k, "YSSSTT"[k % 6] if k < 12 else "S") for k in range(40)] + [(90, "AA_AAYAAAAA"), (91, "AAXAAYAAAAA")], "ord long, seq string")
    fore = spark.createDataFrame([row(k, c) for k, c in enumerate("YYST")], "ord long, seq string")
    got = {r["site"]: r["count"] for r in sequence.quota(spark, back, fore, "ord").groupBy("site").count().collect()}
    assert got == {"Y": 2, "S": 1, "T": 1}


def test_multi_site_rules(spark):
    protein = "MKAAASAATYAASAKRSTAA"
    rows = [(1, "AASAAtyAASAK", protein), (2, "AAsAATYAASAK", protein), (3, "AAsAAtYAAsAK", protein), (4, "sAAT", protein), (5, "KrstQQ", protein)]
    got = {r["pep_id"]: (r["pos"], r["motif"]) for r in sequence.multi_site_motifs(spark.createDataFrame(rows, "pep_id int, ms_seq string, protein string")).collect()}
    assert got[1] == ("Y10-p;T9-p", "ASAAtyAASAK")
    assert got[2] == ("S6-p", "MKAAAsAATYA")
    assert got[3] == ("S6-p;T9-p", "MKAAAsAAtYA")  # the site seven away is beyond the window
    assert got[4] == ("S6-p", "MKAAAsAATYA") and 5 not in got


def test_motif_pads_at_the_ends(spark):
    got = spark.createDataFrame([("STYAC", 1), ("ACDEFGHIKLMS", 11)], "s string, at int").select(sequence.motif(F.col("s"), F.col("at")).alias("m")).collect()
    assert [r["m"] for r in got] == ["----StYAC", "HIKLMs-----"]  # dashes on one side only


def test_shuffle_puts_the_last_column_second():
    assert profiles.shuffle_order([0, 1, 2, 3, 4, 6, 7, 8, 9]) == [0, 10, 1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_distance_is_zero_only_for_equal_profiles(spark):
    cells = [(0, p, a, float((p * 7 + i) % 3)) for p in range(11) for i, a in enumerate(residues.ALPHABET)]
    matrix = spark.createDataFrame(cells, "cluster int, pos int, aa string, score double")
    slot = lambda p: p if p < 5 else p - 1
    same = spark.createDataFrame([("K", slot(p), a, s) for _, p, a, s in cells if p not in (5, 10)], "kinase string, pos int, aa string, score double")
    assert profiles.distances(matrix, same).first()["d"] == 0
    assert profiles.distances(matrix, same.withColumn("score", F.col("score") + 1)).first()["d"] == pytest.approx(math.sqrt(180))


def test_mixture_without_sequence_weight(spark):
    rows = base.rows(spark, SF)
    got, model = mixture.fit(rows, base.K, weight=0.0, most=5)
    assert all(b >= a - 1e-6 for a, b in zip(model.bounds, model.bounds[1:], strict=False))
    assert all(abs(sum(r["r"]) - 1) < 1e-9 for r in got.select("r").collect())


@pytest.mark.parametrize(("method", "weight"), [("pam250", 0.1), ("pam250", 10.0), ("binomial", 0.1), ("binomial", 10.0)])
def test_mixture_scores_are_finite_and_observed_cells_stay(spark, method, weight):
    rows = base.rows(spark, SF, hide=True)
    got, model = mixture.fit(rows, base.K, method, weight, [0.05] * 220, most=2)
    full = mixture.imputed(got, model).join(rows.select("pep_id", F.col("x").alias("seen")), "pep_id").select("x", "seen", "lse").collect()
    for r in full:
        assert math.isfinite(r["lse"]) and all(math.isfinite(v) for v in r["x"])
        assert all(s is None or s == v for s, v in zip(r["seen"], r["x"], strict=True))


def test_ami_and_rank_sums(spark):
    rows = spark.createDataFrame([(k % 3, k % 3, k % 2) for k in range(30)], "a int, b int, c int")
    assert stats.adjusted_mutual_information(rows, "a", "b") == pytest.approx(1.0)
    assert abs(stats.adjusted_mutual_information(rows, "a", "c")) < 0.1
    r = stats.rank_sums(spark.createDataFrame([(1, float(k), k >= 5) for k in range(10)], "g int, x double, y boolean"), "g", "x", "y").first()
    assert (r["n1"], r["n2"], r["u1"]) == (5, 5, 25.0)


def test_low_rank_fill_recovers_a_rank_one_table(spark):
    rng = np.random.default_rng(1)
    full = np.outer(rng.normal(size=40), rng.normal(size=6))
    gone = rng.random(full.shape) < 0.1
    rows = spark.createDataFrame([(i, [None if g else float(v) for v, g in zip(r, m, strict=True)], [bool(g) for g in m]) for i, (r, m) in enumerate(zip(full, gone, strict=True))], "pep_id int, x array<double>, miss array<boolean>")
    back = {r["pep_id"]: r["x"] for r in stats.low_rank_fill(rows, 1, most=8).collect()}
    error = np.abs(np.array([back[i] for i in range(40)]) - full)[gone]
    assert error.mean() < 0.5 * np.abs(full[gone]).mean()


def test_low_rank_fill_iterates_until_the_cells_rest(spark):
    rng = np.random.default_rng(1)
    full = np.outer(rng.normal(size=40), rng.normal(size=6))
    gone = rng.random(full.shape) < 0.1
    rows = spark.createDataFrame([(i, [None if g else float(v) for v, g in zip(r, m, strict=True)], [bool(g) for g in m]) for i, (r, m) in enumerate(zip(full, gone, strict=True))], "pep_id int, x array<double>, miss array<boolean>")
    back = {r["pep_id"]: r["x"] for r in stats.low_rank_fill(rows, 1, tol=1e-3).collect()}
    error = np.abs(np.array([back[i] for i in range(40)]) - full)[gone]
    assert error.mean() < 0.05 * np.abs(full[gone]).mean()


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿Sample ID,Group\r\nP.N,x\r\n".encode())
    assert files.csv(spark, str(tmp_path / "t.csv")).first().asDict() == {"Sample ID": "P.N", "Group": "x"}
    (tmp_path / "p.fa").write_text(">sp|1 HUMAN Kin one OS=H GN=AB1 PE=1\nMKL\nAAA\n>sp|2 HUMAN Kin two OS=H PE=1\nCC\n>sp|3 HUMAN Kin one OS=H GN=AB1\nTTT\n")
    full = {r["name"]: r["seq"] for r in files.fasta(spark, str(tmp_path / "p.fa")).collect()}
    assert full == {"Kin one": "TTT", "Kin two": "CC"}
    assert {r["name"] for r in files.fasta(spark, str(tmp_path / "p.fa"), "gene").collect()} == {"AB1"}
    folder = tmp_path / "pspl"
    folder.mkdir()
    (folder / "AB.csv").write_text("﻿,-5,-4,-3,-2,-1,+1,+2,+3,+4\nA,1,2,4,8,1,1,1,1,1\npT,1,1,1,1,1,1,1,1,1\n")
    (folder / "CD.csv").write_text(",-5,-4,-3,-2,-1,+1,+2,+3,+4\nA,-1,2,4,8,1,1,1,1,1\n")
    got = {(r["kinase"], r["pos"]): r["score"] for r in files.profile_folder(spark, str(folder)).collect()}
    assert got["AB", 2] == 2.0 and got["CD", 2] == 4.0 and len(got) == 18
    block = ["NAME" + "," * 20] + [",".join(["2" if r == 2 else "16"] * 21) for r in range(15)]
    (tmp_path / "b.csv").write_bytes(("\r\n".join(block) + "\r\n").encode())
    cells = {(r["pos"], r["aa"]): r["score"] for r in files.profile_blocks(spark, str(tmp_path / "b.csv")).collect()}
    assert len(cells) == 180 and cells[0, "A"] == 1.0 and cells[8, "V"] == 3.0
    (tmp_path / "g.gmt").write_text("S1\thttp://x\t1\t2\t3\nS2\thttp://y\t4\n")
    assert [len(r["members"]) for r in files.gene_sets(spark, str(tmp_path / "g.gmt")).orderBy("name").collect()] == [3, 1]


def blobs(n=12):
    rng = np.random.default_rng(5)
    centres = np.array([[0.0, 0.0], [4.0, 0.0], [0.0, 5.0]])
    return np.vstack([c + rng.normal(scale=0.2, size=(n, 2)) for c in centres]), np.repeat(np.arange(3), n)


def same_parts(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("method", ["ward", "average", "complete", "centroid"])
def test_linkage_equals_recomputed_distances(method):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(9, 3))
    sizes = rng.integers(1, 4, 9).astype(float)
    own = {i: [i] for i in range(9)}

    def apart(p, q):
        a, b = own[p], own[q]
        if method in ("average", "complete"):
            d = np.linalg.norm(points[a][:, None] - points[b][None], axis=2)
            return d.max() if method == "complete" else (d * sizes[a][:, None] * sizes[b]).sum() / (sizes[a].sum() * sizes[b].sum())
        gap = np.linalg.norm(np.average(points[a], axis=0, weights=sizes[a]) - np.average(points[b], axis=0, weights=sizes[b]))
        return gap if method == "centroid" else gap * math.sqrt(2 * sizes[a].sum() * sizes[b].sum() / (sizes[a].sum() + sizes[b].sum()))

    for k, (a, b, height, size) in enumerate(clusterers.linkage(points, sizes, method)):
        assert height == pytest.approx(min(apart(p, q) for p in own for q in own if p < q)) and height == pytest.approx(apart(a, b))
        own[9 + k] = own.pop(a) + own.pop(b)
        assert size == sizes[own[9 + k]].sum()


def test_baselines_find_separate_groups():
    points, want = blobs()
    for name, labels in clusterers.baselines(points, np.ones(len(points)), 3).items():
        assert same_parts(labels, want), name


def test_weights_stand_for_copies():
    points, _ = blobs(4)
    sizes = np.arange(1, len(points) + 1)
    copies = np.repeat(points, sizes, axis=0)
    for few, many in ((clusterers.spectral(points, 3, sizes), clusterers.spectral(copies, 3, np.ones(len(copies)))), (clusterers.lloyd(points, 3, sizes), clusterers.lloyd(copies, 3, np.ones(len(copies))))):
        assert same_parts(np.repeat(few, sizes), many)


def test_features_hold_every_row_and_find_separate_groups(spark):
    points, want = blobs(40)
    leaves = clusterers.Leaves(9, 0.1)
    for v in points:
        leaves.add(1.0, v, float((v**2).sum()))
    assert len(leaves.n) <= 9 and leaves.n.sum() == len(points) and np.allclose(leaves.sums.sum(axis=0), points.sum(axis=0)) and np.isclose(leaves.squares.sum(), (points**2).sum())
    assert (leaves.squares / leaves.n - ((leaves.sums / leaves.n[:, None]) ** 2).sum(axis=1) <= leaves.threshold**2 + 1e-9).all()
    rows = spark.createDataFrame([([float(v) for v in p], int(w)) for p, w in zip(points, want, strict=True)], "x array<double>, w int").repartition(5)
    centres = clusterers.leaf_centres(rows, "x", 30)
    got = clusterers.nearest_centre(rows, "x", centres, "leaf").collect()
    labels = clusterers.birch(centres, 3)
    assert len(centres) <= 30 and same_parts([int(labels[r["leaf"]]) for r in got], [r["w"] for r in got])


def test_representatives_cover_every_row(spark):
    points, want = blobs(40)
    rows = spark.createDataFrame([(i, [float(v) for v in p], int(w)) for i, (p, w) in enumerate(zip(points, want, strict=True))], "k int, x array<double>, w int")
    centres, found = clusterers.representatives(rows, "x", most=9)
    got = found.select("w", "point").collect()
    assert len(got) == 120 and len(centres) <= 9
    every, own = clusterers.representatives(rows, "x")
    assert len(every) == 120 and all(every[r["point"]].tolist() == r["x"] for r in own.collect())
    assert all(len({r["w"] for r in got if r["point"] == p}) == 1 for p in {r["point"] for r in got})


def test_expected_information_is_the_hypergeometric_mean():
    for x, y, n in ((3, 4, 10), (7, 8, 10), (200, 90, 400)):
        want = sum(math.comb(y, k) * math.comb(n - y, x - k) / math.comb(n, x) * k / n * math.log(n * k / (x * y)) for k in range(max(1, x + y - n), min(x, y) + 1))
        assert stats.expected_information(x, y, n) == pytest.approx(want, abs=1e-12)


def test_gram_and_principal(spark):
    table = np.random.default_rng(3).normal(size=(50, 4))
    rows = spark.createDataFrame([([float(v) for v in r],) for r in table], "x array<double>").repartition(5)
    products, sums, n = stats.gram(rows, "x")
    assert n == 50 and np.allclose(products, table.T @ table) and np.allclose(sums, table.sum(axis=0))
    _, _, share = stats.principal(rows, "x", 4)
    assert np.allclose(share, np.sort(np.linalg.eigvalsh(np.cov(table.T)))[::-1] / np.trace(np.cov(table.T)))
    assert stats.gram(rows.filter("false"), "x")[2] == 0


def test_local_fit_keeps_a_line(spark):
    rows = spark.createDataFrame([(k % 2, float(k), 3.0 * k + 1) for k in range(20)], "g int, x double, y double")
    got = stats.local_fit(rows, "g", "x", "y", -0.5, 19.5, bins=20).collect()
    assert len(got) == 20 and all(r["fit"] == pytest.approx(3 * r["x"] + 1) for r in got)
    alone = stats.local_fit(rows.filter("x = 4"), "g", "x", "y", -0.5, 19.5, bins=20).collect()
    assert [r["fit"] for r in alone] == [13.0]


@pytest.mark.parametrize(("method", "weight"), [("pam250", 0.0), ("pam250", 0.5), ("binomial", 0.5)])
def test_rounds_agree_in_one_task_and_in_many(spark, monkeypatch, method, weight):
    rows = base.rows(spark, SF, hide=True).repartition(3).cache()
    found = []
    for cells, chain in ((1 << 30, 8), (0, 2)):
        monkeypatch.setattr(rounds, "ONE_TASK_CELLS", cells)
        monkeypatch.setattr(rounds, "CHAIN", chain)
        got, model = mixture.fit(rows, base.K, method, weight, [0.05] * 220, most=5, tol=0.0)
        found.append((sorted((r["pep_id"], r["lse"], r["x"], int(np.argmax(r["r"]))) for r in got.collect()), model))
    (a, one), (b, many) = found
    assert one.bounds == pytest.approx(many.bounds) and len(one.bounds) == 5
    assert np.allclose(one.means, many.means) and [x[3] for x in a] == [x[3] for x in b]
    assert all(x[1] == pytest.approx(y[1]) and np.allclose(x[2], y[2]) for x, y in zip(a, b, strict=True))


def test_fit_ends_when_the_bound_rests(spark):
    rows = base.rows(spark, SF, hide=True)
    for weight in (0.0, 1.0):
        _, model = mixture.fit(rows, base.K, "pam250", weight)
        b = model.bounds
        assert len(b) < 200 and abs(b[-1] - b[-2]) < 1e-4 and all(abs(y - x) >= 1e-4 for x, y in zip(b, b[1:-1], strict=False))


def test_block_steps_are_those_of_the_columns(spark):
    rows = base.rows(spark, SF).cache()
    model = mixture.m_step(rows, base.K, "pam250", 0.5)
    by_columns = {r["pep_id"]: (r["lse"], r["r"]) for r in mixture.scored(rows, model).collect()}
    for r in mixture.scored_by(rows, model).collect():
        assert r["lse"] == pytest.approx(by_columns[r["pep_id"]][0]) and np.allclose(r["r"], by_columns[r["pep_id"]][1], atol=1e-9)
    assert special.binomial_below(np.array([3.0, 20, 49]), np.array([10.0, 200, 50]), np.array([0.2, 0.05, 0.9])) == pytest.approx([special.betainc(max(n - k, 1e-3), k + 1, 1 - p) for n, k, p in ((10, 3, 0.2), (200, 20, 0.05), (50, 49, 0.9))])
    a, b, x = np.random.default_rng(1).random((3, 500)) * np.array([[300], [50], [1]]) + 1e-3
    assert special.betainc_many(a, b, np.minimum(x, 1.0)) == pytest.approx([special.betainc(*v) for v in zip(a, b, np.minimum(x, 1.0), strict=True)], abs=1e-12)


@pytest.mark.parametrize("weight", [0.0, 0.5])
def test_imputation_error_is_that_of_the_fit(spark, monkeypatch, weight):
    given = base.rows(spark, SF, hide=True).drop("r").withColumn("truth", F.transform("x", lambda v, i: F.when(i % 5 > 0, F.coalesce(v, i * 0.01)))).cache()
    full = mixture.filled(given, mixture.sample_means(given)).repartition(3).cache()
    start = mixture.kmeans_start(full, 4, 1, full=True).cache()
    assert sorted((r["pep_id"], r["r"]) for r in start.collect()) == sorted((r["pep_id"], r["r"]) for r in mixture.kmeans_start(full, 4, 1).collect())
    got, model = mixture.fit(start, 4, weight=weight, background=[0.05] * 220, most=5, tol=0.0)
    cells = mixture.imputed(got, model).select(F.explode(F.arrays_zip("x", "miss", "truth")).alias("c")).filter("c.miss and c.truth is not null")
    error = cells.agg(F.sum(F.pow(F.col("c.x") - F.col("c.truth"), 2))).first()[0]
    for cells, chain in ((1 << 30, 8), (0, 2)):
        monkeypatch.setattr(rounds, "ONE_TASK_CELLS", cells)
        monkeypatch.setattr(rounds, "CHAIN", chain)
        found, own = mixture.imputation_error(start, 4, weight=weight, background=[0.05] * 220, most=5, tol=0.0)
        assert found == pytest.approx(error) and own.bounds == pytest.approx(model.bounds)


def test_labels_are_predicted_once_a_row(spark):
    start = mixture.kmeans_start(base.rows(spark, SF).drop("r"), 4, 1)
    assert " AS own#" in start._jdf.queryExecution().optimizedPlan().toString()  # a column of its own, not a part of r's expression


def test_narrow_far_clusters_keep_their_digits_and_blocks_of_any_size_agree(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3)) + np.array([0, 1e4, 0])
    codes = np.arange(11) * 20 + rng.integers(0, 20, (500, 11))
    means, variances = np.array([[0, 1e4, 0], [0, -1e4, 0], [1, 1e4, 1]]), np.array([[1e-6] * 3, [1.0] * 3, [1.0] * 3])
    model = mixture.Model(means.tolist(), variances.tolist(), np.log([0.2, 0.3, 0.5]).tolist(), rng.random((3, 220)).tolist(), "binomial", 2.0)
    plain = np.array([[model.log_pi[c] - 0.5 * (3 * math.log(2 * math.pi) + np.log(variances[c]).sum() + ((v - means[c]) ** 2 / variances[c]).sum()) + 2 * math.log(sum(model.table[c][i] for i in own)) for c in range(3)] for v, own in zip(x, codes, strict=True)])
    block = lambda: mixture.Block(x.copy(), np.zeros(x.shape, bool), codes, np.ones((500, 3)) / 3)
    got = mixture.joint(block(), mixture.terms(model))
    assert np.allclose(got, plain, rtol=1e-12, atol=1e-7)
    found = []
    for size in (7, 1 << 20):
        monkeypatch.setattr(mixture, "AT_ONCE", size)
        found.append(mixture.Rounds(3, 3, "binomial", 2.0, [0.05] * 220, 5, 0.0).advance(block(), model))
    assert np.allclose(*found)
    r = np.exp(plain - plain.max(axis=1, keepdims=True))
    r /= r.sum(axis=1, keepdims=True)
    counts = np.array([[r[(codes == code).any(axis=1), c].sum() for code in range(220)] for c in range(3)])
    assert np.allclose(found[0][-660:], counts.ravel(), atol=1e-6)


def test_soft_fill_keeps_seen_cells_and_agrees_in_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    full = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 6))
    gone = rng.random(full.shape) < 0.1
    rows = spark.createDataFrame([(i, [None if g else float(v) for v, g in zip(r, m, strict=True)], [bool(g) for g in m]) for i, (r, m) in enumerate(zip(full, gone, strict=True))], "pep_id int, x array<double>, miss array<boolean>").repartition(3)
    found = []
    for cells in (1 << 30, 0):
        monkeypatch.setattr(rounds, "ONE_TASK_CELLS", cells)
        back = {r["pep_id"]: r["x"] for r in stats.soft_fill(rows).collect()}
        found.append(np.array([back[i] for i in range(40)]))
    assert np.allclose(*found) and (found[0][~gone] == full[~gone]).all()
    assert np.abs(found[0] - full)[gone].mean() < 0.3 * np.abs(full[gone]).mean()


def test_best_start(spark):
    rows = base.rows(spark, SF, hide=True)
    _, one = mixture.fit(rows, base.K, most=3)
    _, best = mixture.fit_best(rows, base.K, most=3)
    assert best.bounds[-1] >= one.bounds[-1]
    got, _ = mixture.fit_best(rows.drop("r"), 3, starts=1, most=2)
    assert all(abs(sum(r["r"]) - 1) < 1e-9 for r in got.select("r").collect())


def test_logistic_fit_is_the_penalised_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    y = x[:, 0] + 0.5 * rng.normal(size=60) > 0.3
    for c, l1 in ((0.05, 1.0), (1.0, 1.0), (1.0, 0.5), (100.0, 1.0)):
        w = regression.fit(x, y, c, l1, most=20_000, tol=1e-10)

        def loss(v, c=c, l1=l1):
            m = (x @ v[:-1] + v[-1]) * np.where(y, 1, -1)
            return c * (regression.balanced(y) * np.logaddexp(0, -m)).sum() + l1 * np.abs(v[:-1]).sum() + (1 - l1) / 2 * (v[:-1] ** 2).sum()

        assert all(loss(w) <= loss(w + 1e-3 * rng.normal(size=5)) + 1e-9 for _ in range(200))
    assert (regression.fit(x, y, 1e-4)[:-1] == 0).all()
    fold = regression.stratified(y, 3)
    assert all(abs(np.bincount(fold[y == c], minlength=3) - (y == c).sum() / 3).max() < 1 for c in (False, True))
    assert sorted(np.bincount(regression.repeated(11, 4, 1)).tolist()) == [2, 3, 3, 3]
    score, truth = np.array([0.9, 0.8, 0.8, 0.1]), np.array([True, True, False, False])
    fpr, tpr = regression.curve(score, truth)
    assert fpr.tolist() == [0, 0, 0.5, 1] and tpr.tolist() == [0, 0.5, 1, 1]
    assert regression.area(np.array([regression.on_grid(fpr, tpr)])) == pytest.approx(0.875, abs=0.01)


def test_searched_scores_agree_in_one_task_and_by_spark_ml(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3))
    y = x[:, 0] + 0.3 * rng.normal(size=90) > 0
    rows = spark.createDataFrame([(k, bool(b), [float(v) for v in r]) for k, (r, b) in enumerate(zip(x, y, strict=True))], "pep_id int, y boolean, x array<double>")
    found = []
    for cells in (1 << 30, 0):
        monkeypatch.setattr(rounds, "ONE_TASK_CELLS", cells)
        found.append(sorted(tuple(r) for r in stats.searched_scores(rows, 2, (0.01, 1.0)).collect()))
    assert [r[:2] for r in sorted(found[0], key=lambda r: r[:2])] == [r[:2] for r in sorted(found[1], key=lambda r: r[:2])]
    assert np.abs(np.array([r[2] for r in found[0]]) - np.array([r[2] for r in found[1]])).max() < 0.05


def test_errors_name_what_is_wrong(spark, tmp_path):
    with pytest.raises(Exception, match="not a sequence: AB"):
        filters.require_sequences(spark.createDataFrame([("AB",)], "seq string")).collect()
    with pytest.raises(ValueError, match="b"):
        filters.require_numeric(spark.createDataFrame([(1.0, "x")], "a double, b string"), ["a", "b"])
    rows = spark.createDataFrame([("P1", 1), ("P1.N", 0)], "name string, egfr int")
    assert [tuple(r) for r in filters.mutation_flags(rows, "name", ["egfr"]).collect()] == [("P1", True)]
    with pytest.raises(Exception, match="no row for: P2"):
        filters.labelled(rows, spark.createDataFrame([("P2",)], "name string"), "name").collect()
    assert filters.drop_null_columns(spark.createDataFrame([(1, None), (2, 3)], "a int, b int")).columns == ["a"]
    proteins = spark.createDataFrame([(1, "A", "MKAAASAATYAA")], "ord int, name string, seq string")
    with pytest.raises(Exception, match="no protein holds"):
        sequence.match_names(spark.createDataFrame([(1, "A", "AAsAATW")], "pep_id int, name string, ms_seq string"), proteins).collect()
    got = sequence.match_names(spark.createDataFrame([(1, " A ", "AAsAAT"), (2, "B", "KAAAs")], "pep_id int, name string, ms_seq string"), proteins).collect()
    assert sorted((r["pep_id"], r["name"]) for r in got) == [(1, "A"), (2, "A")]
    dist = spark.createDataFrame([("X", 0, 1.0)], "kinase string, cluster int, d double")
    with pytest.raises(Exception, match="no class for: X"):
        profiles.nearest(dist, 1, spark.createDataFrame([("Z", "Y")], "kinase string, class string"), spark.createDataFrame([(0, "Y")], "cluster int, acceptor string")).collect()
    with pytest.raises(ValueError):
        filters.sample_with_replacement(rows, "name")
    (tmp_path / "s.csv").write_text("n,Sequence,Protein,Gene,Position,A,B\n1,AAAAASAAAAA,p,g,S1,1.0,\n2,AAAAATAAAAA,p,g,S1,1.0,2.0\n")
    (tmp_path / "e.csv").write_text("Sample,Experiment\nA,1\nB,2\n")
    got = files.signal_table(spark, str(tmp_path / "s.csv"), str(tmp_path / "e.csv")).collect()
    assert sorted((r["seq"], r["sample"], r["experiment"], r["x"]) for r in got) == [("AAAAATAAAAA", "A", 1, 1.0), ("AAAAATAAAAA", "B", 2, 2.0)]
    (tmp_path / "e.csv").write_text("Sample,Experiment\nA,1\n")
    with pytest.raises(ValueError, match="2 samples"):
        files.signal_table(spark, str(tmp_path / "s.csv"), str(tmp_path / "e.csv"))


def test_principal_scores_are_those_of_the_decomposition(spark):
    table = np.random.default_rng(3).normal(size=(50, 4)) * [3, 2, 1, 1]
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(table)], "k int, x array<double>")
    mean, loadings, _ = stats.principal(rows, "x")
    _, _, vt = np.linalg.svd(table - table.mean(axis=0), full_matrices=False)
    want = vt[:2].T * np.sign(vt[:2].T[np.abs(vt[:2].T).argmax(axis=0), [0, 1]])
    assert np.allclose(loadings, want)
    got = {r["k"]: r["pc"] for r in stats.principal_scores(rows, "x", mean, loadings).collect()}
    assert np.allclose([got[k] for k in range(50)], (table - table.mean(axis=0)) @ want)


def test_running_sums_of_a_large_group(spark):
    rows = spark.createDataFrame([("a" if k % 10 else None, (k * 37) % 500, k) for k in range(500)], "g string, o int, v int").repartition(7)
    got = ordered.running(rows, ["g"], [F.col("o").desc()], {"place": F.lit(1), "upto": F.col("v")}).collect()
    assert len(got) == 500
    for g in ("a", None):
        total = 0
        own = sorted((r for r in got if r["g"] == g), key=lambda r: -r["o"])
        for k, r in enumerate(own):
            total += r["v"]
            assert (r["place"], r["upto"]) == (k + 1, total)
    assert not ordered.running(rows.filter("false"), ["g"], [F.col("o")], {"place": F.lit(1)}).collect()


@pytest.mark.parametrize("letters", [1 << 20, 0])
def test_contains_match_takes_the_first_protein(spark, monkeypatch, letters):
    monkeypatch.setattr(sequence, "BROADCAST_LETTERS", letters)
    proteins = spark.createDataFrame([(2, "B", "MKAAASAATYA"), (1, "A", "XXAAASAATXX"), (3, "C", "KR"), (4, "D", None)], "ord int, name string, seq string")
    peptides = spark.createDataFrame([(1, "AAASAAT"), (2, "AAASAATY"), (3, "KR"), (4, "AAASAATZ"), (5, "AAASAAT")], "pep_id int, seq string")
    assert {r["pep_id"]: r["name"] for r in sequence.contains_match(peptides, proteins).collect()} == {1: "A", 2: "B", 3: "C", 5: "A"}
    assert sequence.contains_match(peptides.filter("false"), proteins).count() == 0
