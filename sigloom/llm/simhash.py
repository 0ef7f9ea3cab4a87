"""Near duplicates by SimHash, found through a byte-position inverted index.

A fingerprint has eight bytes.  Two fingerprints that differ in at most three bits differ
in at most three bytes, so they share at least five positional bytes: the guaranteed
minimum of the count filter.  Postings are keyed by four positions at a time, taken from a
family of twenty such sets that any five shared positions must contain one of, so no
linked pair is missed and a posting list holds one fingerprint in four thousand million
instead of one in 256.  Inside a posting list the shared positional bytes are tallied per
pair, pairs below the minimum are dropped, and the others are verified by their bits.

A list emits a spanning forest of its links instead of all its pairs: each fingerprint
found is compared with those still unreached only, so a dense group of any size costs
about its size.  Components over all lists follow by large-star and small-star rounds on
distinct fingerprints; rows with one fingerprint never meet as rows.

``similar_documents`` finds near copies by the similarity of their shingles through the same
index.  A vote of 64 bits can't carry that: texts of similarity 0.8 differ in a tenth to a
quarter of the bits, and no affordable family of position sets bounds that.  So each of
``WIDE`` positions holds a byte of the one shingle that ranks first there, and two texts share
a positional byte about as often as they are similar.  Postings are keyed by sets of
positions, shared bytes are tallied inside a list, pairs below the minimum are dropped, and
what is left is verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import floor, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import settle, slices, with_text

SHINGLE_WORDS, MOST_BITS, SEED = 3, 3, 42
BYTES = 8
#: Lists longer than this are split by a fifth shared position first.
LONG_LIST = 4096

#: Words of a shingle and least similarity of near copies.
LIKE_WORDS, LEAST_SHARE = 5, 0.8
#: Positional bytes of the wide signature, sets of positions by which postings are keyed, and positions in a set.
#: Texts of similarity 0.8 have no set in common once in about four thousand pairs, of 0.85 once in two hundred thousand.
WIDE, SETS, SET_POSITIONS = 128, 32, 6
#: The minimum lies this many standard deviations below the shared bytes expected at the least similarity.
SLACK = 4.5
#: Rows of a cluster that are compared as one group; of a posting list, and shingles of these, held in a task at once.
CLUSTER_ROWS, LIST_ROWS, LIST_SHINGLES = 256, 4096, 4 << 20
#: Members of clusters up to which their ids are broadcast to the scan; more are joined by shuffling.
BROADCAST_MEMBERS = 500_000


def position_sets() -> list[tuple[int, ...]]:
    """Twenty sets of four of the eight positions; every five positions contain one.

    Deal the positions into a cycle of three groups and take the sets within a group or with
    three in one group and one in the next: the construction of Turan's problem for fours.
    """
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    where = {p: g for g, own in enumerate(groups) for p in own}

    def taken(s: tuple[int, ...]) -> bool:
        n = [sum(where[p] == g for p in s) for g in range(3)]
        return any(n[g] == 4 or n[g] == 3 and n[(g + 1) % 3] == 1 or n[g] == 2 and n[(g + 1) % 3] == 2 for g in range(3))

    found = [s for s in combinations(range(BYTES), 4) if taken(s)]
    assert all(any(set(s) <= set(five) for s in found) for five in combinations(range(BYTES), 5))
    return found


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> bytes:
    """XXH64 digests (big-endian) of the word shingles, end to end."""
    found = text.encode().lower().split()  # bytes: A-Z alone change case, and exactly the six ASCII white-space characters split
    if not found:
        return b""
    digest = xxhash.xxh64_digest
    whole = b" ".join(found)
    if len(found) <= words:
        return digest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[: len(found) - words] + 1).tolist()]
    return b"".join([digest(whole[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)])


def majority(digests: bytes) -> int:
    """The fingerprint: each bit that over half the hashes have."""
    if not digests:
        return 0
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for start in range(0, len(rows), 1 << 15):
        bits = np.unpackbits(rows[start : start + (1 << 15)], axis=1)
        for k in range(0, len(bits), 255):  # a byte can count to 255
            total += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * total > len(rows)).tobytes(), "big")


def _fingerprint_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                prints = [majority(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
                signed = np.array(prints, np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed)], names=["doc_id", "print"])

    return rows


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and print (the 64 bits as a signed long) of every row of ``docs``."""
    shape = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("print", T.LongType())])
    return with_text(docs, "doc_id").mapInArrow(_fingerprint_rows(words), shape)


def linked(one: np.uint64, others: np.ndarray, bits: int) -> np.ndarray:
    """Mask of the others that share enough positional bytes with ``one`` and differ in at most ``bits`` bits."""
    differ = others ^ one
    shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    mask = shared >= BYTES - bits
    at = np.flatnonzero(mask)
    mask[at] = np.bitwise_count(differ[at]) <= bits
    return mask


def forest(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that span each component of a posting list; every reached member is compared with the unreached."""
    edges: list[tuple[int, int]] = []
    left = members
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            mask = linked(one, left, bits)
            if mask.any():
                near = left[mask]
                edges += [(int(one), int(x)) for x in near]
                queue += list(near)
                left = left[~mask]
    return edges


def list_links(members: np.ndarray, positions: tuple[int, ...], bits: int) -> list[tuple[int, int]]:
    """Links of one posting list.  A long one is split by each further position in turn: a linked pair shares one of them."""
    if len(members) <= LONG_LIST:
        return forest(members, bits)
    edges: list[tuple[int, int]] = []
    for p in sorted(set(range(BYTES)) - set(positions)):
        byte = members >> np.uint64(8 * p) & np.uint64(255)
        order = np.argsort(byte, kind="stable")
        for part in np.split(members[order], np.flatnonzero(np.diff(byte[order])) + 1):
            edges += forest(part, bits)
    return edges


def _link_rows(sets: list[tuple[int, ...]], bits: int):
    """Walks rows sorted by (which, posting) and links each list; a list may span Arrow batches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64),) * 3

        def flush(which: np.ndarray, posting: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(posting) != 0)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(which)]])
            edges: list[tuple[int, int]] = []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                edges += list_links(np.sort(prints[s:e].view(np.uint64)), sets[which[s]], bits)
            pairs = np.array(edges, np.uint64).reshape(-1, 2).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            new = tuple(np.asarray(batch.column(n)).astype(np.int64) for n in ("which", "posting", "print"))
            which, posting, prints = (np.concatenate(x) for x in zip(held, new, strict=True))
            if not len(which):
                continue
            last = np.flatnonzero((which != which[-1]) | (posting != posting[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield flush(which[:cut], posting[:cut], prints[:cut])
            held = which[cut:], posting[cut:], prints[cut:]
        if len(held[0]):
            yield flush(*held)

    return rows


def links(prints: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """a, b: links that connect all distinct fingerprints at ``bits`` differing bits or fewer (``bits`` at most 3)."""
    if bits > 3:
        raise ValueError("the position sets guarantee links of up to three bits")
    sets = position_sets()

    def posting(positions: tuple[int, ...]):
        value = F.lit(0).cast("long")
        for k, p in enumerate(positions):
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned("print", 8 * p).bitwiseAND(F.lit(255).cast("long")), 8 * k))
        return value

    keys = F.array(*[posting(s) for s in sets])
    posted = prints.select("print").distinct().select("print", F.posexplode(keys).alias("which", "posting"))
    lists = posted.repartition("which", "posting").sortWithinPartitions("which", "posting", "print")
    return lists.mapInArrow(_link_rows(sets, bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node by value) of every node that has a link but the roots.

    Alternates large-star and small-star rounds; each is one grouping by node, its result is
    settled, and the rounds end when the links no longer change.
    """
    edges = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # settled, so that the join's shuffles lie next to it and a hub's neighbours can be split over tasks
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = settle(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(now)


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MOST_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    A text without words (null, empty, blank) has the fingerprint zero, which links like any
    other; one with fewer words than a shingle hashes them all.  component_id is the smallest
    doc_id reachable (null only where every reachable id is null).  Repeated rows are returned
    as often as they come.  An empty table gives an empty result.  Other columns are not read.
    """
    prints = settle(fingerprints(docs, words))
    roots = components(links(prints, bits)).select(F.col("node").alias("print"), "root")
    least = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    rooted = settle(least.join(roots, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root")))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(heads, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def _draw(rule: int) -> np.ndarray:
    """A column of 32-bit numbers, one a position, by a linear congruence."""
    out, x = [], rule
    for _ in range(WIDE):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x >> 32)
    return np.array(out, np.uint32).reshape(-1, 1)


_TIMES, _PLUS = _draw(1) | np.uint32(1), _draw(2)


def wide_sets() -> np.ndarray:
    """Sets of positions: the positions in two orders, cut into runs."""
    runs = WIDE // SET_POSITIONS
    order = [i * step % WIDE for step in (1, 45) for i in range(runs * SET_POSITIONS)]
    return np.array(order).reshape(-1, SET_POSITIONS)[:SETS]


def least_shared(share: float) -> int:
    """Shared positional bytes from which a pair is verified."""
    match = share + (1 - share) / 256
    return floor(WIDE * match - SLACK * sqrt(WIDE * match * (1 - match)))


def shingle_set(text: str, words: int = LIKE_WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    return np.unique(np.frombuffer(shingle_hashes(text, words), np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The wide signature; texts without words share one."""
    low = (shingles ^ shingles >> np.uint64(32)).astype(np.uint32)
    first = np.full(WIDE, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 512):
        ranks = low[start : start + 512] * _TIMES + _PLUS
        ranks ^= ranks >> np.uint32(15)
        first = np.minimum(first, ranks.min(axis=1))
    return first.astype(np.uint8)


def set_key(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def _signature_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
                made = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "key", "shingles", "signature"])

    return rows


def _set_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "held"])

    return rows


def _posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and posting: the bytes at a set's positions behind the set's number."""
    sets = wide_sets()
    scale = np.uint64(1) << np.arange(0, 8 * SET_POSITIONS, 8, dtype=np.uint64)
    number = np.arange(SETS, dtype=np.uint64) << np.uint64(48)
    for batch in batches:
        held = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, WIDE)
        postings = (held[:, sets].astype(np.uint64) * scale).sum(axis=2, dtype=np.uint64) + number
        keys = np.repeat(np.asarray(batch.column("key")), SETS)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(postings.ravel().astype(np.int64))], names=["key", "posting"])


def tally_forest(keys: np.ndarray, signatures: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs that span each component of a list under ``least`` shared positional bytes."""
    return _spanning(keys, lambda one, others: (signatures[others] == signatures[one]).sum(axis=1) >= least)


def like_forest(keys: np.ndarray, sets: list[np.ndarray], share: float) -> list[tuple[int, int]]:
    """Pairs that span each component of a list under similarity ``share``, counted on the shingles."""
    sizes = np.array([len(s) for s in sets])
    flat, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mine = np.zeros(len(flat) + 1, bool)

    def near(one: int, others: np.ndarray) -> np.ndarray:
        small, large = np.minimum(sizes[others], sizes[one]), np.maximum(sizes[others], sizes[one])
        mask = small >= share * large
        at = others[mask]
        if not len(at):
            return mask
        mine[numbers[starts[one] : starts[one + 1]]] = True
        cells = np.concatenate([numbers[starts[k] : starts[k + 1]] for k in at])
        both = np.add.reduceat(np.append(mine[cells], False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[at])])[:-1]) * (sizes[at] > 0)
        mine[numbers[starts[one] : starts[one + 1]]] = False
        mask[mask] = both >= share * (sizes[at] + sizes[one] - both)
        return mask

    return _spanning(keys, near)


def _spanning(keys: np.ndarray, near) -> list[tuple[int, int]]:
    """Pairs of keys that span the components of ``near``(one, others): every member found is compared with those not yet reached."""
    edges: list[tuple[int, int]] = []
    left = np.arange(len(keys))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            one = queue.pop()
            mask = near(one, left)
            if mask.any():
                edges += [(int(keys[one]), int(keys[k])) for k in left[mask]]
                queue += left[mask].tolist()
                left = left[~mask]
    return edges


def _forest_rows(least: int | None, share: float):
    """Walks rows sorted by (posting, block) and spans each list, by tally or on the shingles; a list may span Arrow batches."""

    def links(rows: dict) -> list[tuple[int, int]]:
        keys, first = np.unique(np.array(rows["key"], np.int64), return_index=True)
        if len(keys) < 2:
            return []
        held = [rows["held"][k] for k in first.tolist()]
        if least is not None:
            return tally_forest(keys, np.frombuffer(b"".join(held), np.uint8).reshape(-1, WIDE), least)
        return like_forest(keys, [np.frombuffer(h, np.uint64) for h in held], share)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {"key": [], "held": []}

        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])

        for batch in batches:
            lists = [np.asarray(batch.column(n)) for n in ("posting", "block")]
            cuts = np.flatnonzero((np.diff(lists[0]) != 0) | (np.diff(lists[1]) != 0)) + 1
            edges: list[tuple[int, int]] = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if s == e:
                    continue
                name = int(lists[0][s]), int(lists[1][s])
                if name != at:
                    edges += links(own)
                    at, own = name, {"key": [], "held": []}
                for n in own:
                    own[n] += batch.column(n).slice(s, e - s).to_pylist()
            yield out(edges)
        yield out(links(own))

    return rows


def dealt(rows: DataFrame, load: list, key: str = "key") -> DataFrame:
    """rows (posting, key, more) with ``block``.

    ``load`` has (column, most) pairs.  A list whose sum of a column is beyond its ``most`` is
    cut into parts by its keys' hash, and each pair of parts is a block, so that any two rows
    meet in one block and no block is heavier than about ``most``.
    """
    parts = F.greatest(F.lit(1), *[F.ceil(F.lit(2.0) * F.sum(c) / F.lit(most)) for c, most in load]).cast("int")
    heavy = F.lit(False)
    for k, (_, most) in enumerate(load):
        heavy = heavy | (F.col(f"_load{k}") > most)
    sums = [F.sum(c).alias(f"_load{k}") for k, (c, _) in enumerate(load)]
    many = settle(rows.groupBy("posting").agg(*sums, parts.alias("parts")).filter(heavy).select(F.col("posting").alias("_posting"), "parts"))
    met = rows.join(many, F.col("posting") == F.col("_posting"), "left").drop("_posting")
    part = F.pmod(F.xxhash64(key), F.col("parts")).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.least(part, q) * F.col("parts") + F.greatest(part, q))
    return met.withColumn("block", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(blocks))).drop("parts")


def _spanned(rows: DataFrame, least: int | None, share: float) -> DataFrame:
    laid = rows.select("posting", "block", "key", "held").repartition("posting", "block").sortWithinPartitions("posting", "block")
    return laid.mapInArrow(_forest_rows(least, share), "a long, b long").distinct()


def similar_documents(docs: DataFrame, words: int = LIKE_WORDS, share: float = LEAST_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id and component_id, the smallest doc_id reachable by links.

    A link joins texts whose sets of ``words``-word shingles (case and white space aside; a
    shorter text is one shingle) have ``share`` or more of their union in common.  Texts of any
    length are read whole; null counts as empty, and texts without words are alike.
    component_id is null only where every reachable id is null.  Repeated rows are returned as
    often as they come; an empty table gives an empty result; other columns are not read.

    The index gives candidates, tallied inside posting lists; they form loose clusters.  A
    document's shingles then travel once to its cluster, or, where a cluster has more than
    ``CLUSTER_ROWS`` texts, to its posting lists in it.  Lists span their links, never all pairs.
    """
    shape = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in ("key", "shingles")), T.StructField("signature", T.BinaryType())])
    keyed = settle(with_text(docs, "doc_id").mapInArrow(_signature_rows(words), shape))
    nodes = settle(keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("shingles").alias("shingles"), F.min("signature").alias("signature")))
    posted = nodes.select("key", "signature").mapInArrow(_posting_rows, "key long, posting long")
    shared = settle(posted.groupBy("posting").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    listed = settle(posted.join(shared.select("posting"), "posting"))
    signed = dealt(listed.withColumn("one", F.lit(1)), [("one", LIST_ROWS)]).join(nodes.select("key", F.col("signature").alias("held")), "key")
    loose = components(_spanned(signed, least_shared(share), share)).select(F.col("node").alias("key"), F.col("root").alias("cluster"))
    loose = loose.union(loose.select("cluster", "cluster").distinct())  # a root is no node of its own

    sizes = loose.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    members = settle(loose.join(sizes, "cluster").join(nodes.select("key", "least", "shingles"), "key"))
    texts = with_text(docs, "doc_id")
    ids = members.select(F.col("least").alias("id")).distinct()
    ids = F.broadcast(ids) if members.count() <= BROADCAST_MEMBERS else ids
    found = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").mapInArrow(_set_rows(words), "key long, held binary")
    sets = settle(found.join(members.select("key"), "key", "left_semi").groupBy("key").agg(F.min("held").alias("held")))
    small = members.filter(F.col("n") <= CLUSTER_ROWS).select(F.col("cluster").alias("posting"), "key", "shingles")
    # a posting list and the cluster within which it is looked at
    large = members.filter(F.col("n") > CLUSTER_ROWS).select("key", "cluster", "shingles").join(listed, "key").select(F.xxhash64("cluster", "posting").alias("posting"), "key", "shingles")
    groups = dealt(small.unionByName(large).withColumn("one", F.lit(1)), [("one", LIST_ROWS), ("shingles", LIST_SHINGLES)])
    roots = components(_spanned(groups.join(sets, "key"), None, share))

    rooted = settle(nodes.select("key", "least").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    return keyed.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")
