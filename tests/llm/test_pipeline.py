"""The pipeline's stages against brute force on a small table."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline
from fixtures import awkward, frame, prose
from pyspark.sql import functions as F
from test_corpus_operators import like_classes

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, SF)
    assert known.columns == COLUMNS and known.count() >= 0.98 * docs.count()

    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    once = stages["exact_dedup"](spark, docs, SF)
    last = {}
    for d, t in rows.items():
        last[t] = max(d, last.get(t, -1))
    assert once.columns == COLUMNS and sorted(r["doc_id"] for r in once.collect()) == sorted(last.values())

    near = stages["near_dedup"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(set(like_classes(list(rows.items())).values()))

    mixed = stages["source_mix"](spark, docs, SF)
    assert mixed.columns == COLUMNS
    served = [r["doc_id"] for r in mixed.collect()]
    assert all(1 <= served.count(d) <= 2 for d in set(served))

    packed = corpus_pipeline.run(spark, SF).collect()
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert not [f for f in os.listdir(folder) if f.startswith("pipeline-")]
    filled = {}
    for r in packed:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_on_awkward_rows(spark):
    docs = frame(spark, clash=True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "best_fit_packing" or out.columns == docs.columns, name
        assert out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_exact(spark, docs, SF).collect()]
    assert len(kept) == len(set(kept)) == len({t or "" for _, t, *_ in awkward()})


def test_rows_that_share_an_id_or_have_none_are_judged_one_by_one(spark):
    en, other = prose(1, 80), prose(2, 80)
    rows = [(1, en, "en", "a", 1), (1, "12 34", "en", "a", 1), (None, "...", "en", "a", 1), (None, other, "en", "a", 1), (2, prose(3, 80), "en", "a", 1)]
    docs = frame(spark, [*rows, *[(10 + k, prose(10 + k, 60), "en", "a", 1) for k in range(20)]])
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.identify(spark, docs, SF).collect()]
    assert (1, en) in left and (None, other) in left and not {(1, "12 34"), (None, "...")} & set(left)

    rows = [(1, en, "en", "a", 1), (1, other, "en", "a", 1), (None, en, "en", "a", 1), (None, other + " x", "en", "a", 1), (2, en, "en", "a", 1), (2, en, "en", "a", 1), (3, "u v", "en", "a", 1)]
    left = sorted([(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_exact(spark, frame(spark, rows), SF).collect()], key=repr)
    assert left == sorted([(1, other), (None, other + " x"), (2, en), (3, "u v")], key=repr)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_near(spark, frame(spark, rows), SF).collect()]
    assert sorted(left, key=repr) == sorted([(None, en), (None, other + " x"), (3, "u v")], key=repr)

    out = corpus_pipeline.mix(spark, frame(spark, rows), SF).collect()
    assert {(r["doc_id"], r["text"]) for r in out} <= {(d, t) for d, t, *_ in rows}
    pieces = corpus_pipeline.pack(spark, frame(spark, rows), SF)
    assert pieces.filter("piece = 0").count() == len(rows) and pieces.filter(F.col("doc_id").isNull()).count() == 2


def test_pipeline_leaves_no_near_copies_of_five_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = corpus_pipeline.dedup_near(spark, docs, SF)
    shingles = []
    for r in left.collect():
        w = (r["text"] or "").lower().split()
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    assert left.count() < docs.count()
    assert not any(len(a & b) >= 0.8 * len(a | b) for k, a in enumerate(shingles) for b in shingles[:k])
