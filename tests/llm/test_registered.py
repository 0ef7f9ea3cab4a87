"""The registered queries that SQL can't express, over whole tables, against plain code."""

import array
import hashlib
import os
import sys
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_corpus_operators import plain_links, plain_personal, plain_print, plain_secrets

from sigloom.llm import credentials, pii
from sigloom.llm.queries import TOKENIZER, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return queries()[name](spark, SF).collect()


def test_packing(spark, texts):
    theirs = Tokenizer.from_file(TOKENIZER)
    pieces, bins = {}, {}
    for r in rows(spark, "op3_best_fit_packing"):
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    for d, own in pieces.items():
        ids = array.array("I", [*theirs.encode(texts[d], add_special_tokens=False).ids, 2])
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 1024 for r in own[1:]) and 1 <= own[0]["length"] <= 1024
        assert len(ids) > 1024 or len(own) == 1
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    total = 0
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert len(bins) <= 1.005 * -(-total // 1024) + 1


def test_secrets(spark, texts):
    found = rows(spark, "op4_secret_scan")
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        base, links = plain_secrets(texts[r["doc_id"]]), plain_links(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x[0] for x in base) for k in credentials.BASE]
        assert r["base_sha256"] == hashlib.sha256(credentials.listed(base).encode()).hexdigest()
        order = {k: i for i, k in enumerate((*credentials.BASE, *credentials.WEAK))}
        assert r["spans"] == credentials.listed(sorted([*base, *(w for w, _ in links)], key=lambda x: (x[1], order[x[0]])))


def test_personal_data(spark, texts):
    found = rows(spark, "op6_personal_data")
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    added = 0
    for r in found:
        base = plain_personal(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x[0] for x in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        more = [x for x in spans if x not in base]
        assert [x for x in spans if x in base] == base and not any(a < y and x < b for _, a, b in more for _, x, y in base)
        added += len(more)
    assert added < 0.02 * len(texts)


def test_fingerprints_and_components(spark, texts):
    found = {r["doc_id"]: r for r in rows(spark, "op8_simhash_dedup")}
    assert found.keys() == texts.keys()
    ids = np.array(sorted(texts))
    prints = np.array([plain_print(texts[d]) for d in ids.tolist()], np.uint64)
    assert all(found[d]["fingerprint"] == f"{int(p):016x}" for d, p in zip(ids.tolist(), prints, strict=True))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    least = ids.copy()
    while True:
        new = np.where(near, least[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == least).all():
            break
        least = new
    assert [found[d]["component_id"] for d in ids.tolist()] == least.tolist()


def test_quality(spark, texts):
    found = {r["doc_id"]: r for r in rows(spark, "op9_line_quality")}
    assert found.keys() == texts.keys()
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for d, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [(found[d]["score"], q) for d, q in marks.items() if found[d]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print(f"held-out AUC {auc:.4f}, accuracy {np.mean([(s >= 0.7) == q for s, q in held]):.4f}, good {np.mean([q for _, q in held]):.3f}")
    assert auc > 0.95


def test_audio(spark, texts):
    found = rows(spark, "op10_telephony_audio")
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    seen = {}
    for r in found:
        data = texts[r["doc_id"]].encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert seen.setdefault(data, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
