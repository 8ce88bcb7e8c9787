"""SimHash near-duplicates, searched by vantage-point trees.

Every text gets a 64-bit fingerprint of its word shingles. Fingerprints within
`radius` bits are linked, and a document's class is its connected component.

The search works on distinct fingerprints. A vantage-point tree, fitted on a
bounded sample, deals them to shards: at a node with pivot p and median
distance m, those with d(x, p) <= m + radius go to the inner branch and those
with d(x, p) > m to the outer one. By the triangle inequality two fingerprints
within the radius differ by at most that in d(., p), so they meet in at least
one branch; only the ring in between goes to both. Shards repeat this with
pivots of their own, then compare exactly. A shard returns a star for each of
its components and never the pairs. A ball too dense for bounds to cut, and for
the radius of 2 a shard over MAX_SHARD fingerprints, is resolved by probe keys:
balls of radius 1 around two fingerprints meet exactly if these differ in 2
bits at most. Other radii compare such a ball in full.

`distinct_rows` is the search for a pipeline: rows whose sets of word shingles
have a Jaccard similarity of `similarity` or more are linked. Its fingerprint
has 256 bits. A pair at 0.8 differs in 39 of them (deviation 6) and unrelated
texts in 128 (deviation 8), so a reach of 80 bits parts the two, but a ring of
80 bits holds everything and trees cut nothing. So texts are told apart by
their shingles first: one that shares less than `similarity` of them with all
other texts is like none and stays. The others are dealt to shards by those
shared shingles that come first in one order of all, of which similar sets
have one in common. A shard's vantage point is compared with its members;
where that leaves more than one class, a vantage-point tree of the shard finds
the pairs that fingerprints and counts leave open. These make cells, each text
in one at most, and a cell compares its sets in full.
Fingerprints decide what is compared, the sets themselves what is linked.

Null, empty and blank texts have fingerprint zero and are linked like others.
Equal rows are each returned by near_duplicates; distinct_rows keeps one of
them. Rows with a null id have no class in near_duplicates and all stay in
distinct_rows. Ties between rows of one id go to the lesser hash of the text.
Texts of any length are read whole. Extra columns are ignored, or passed on by
distinct_rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.components import connected, merge, settle
from corpusloom.llm.texts import Words, blocks, confirm, mix64, release
from corpusloom.session import staged

SEED = 42
SAMPLE = 8192  # fingerprints that the dealing tree is fitted on, whatever the input
SHARD = 8192  # fingerprints a shard aims at
MAX_SHARD = 262_144  # beyond it, probe keys
LEAF = 512  # fingerprints compared directly
REACH = 80  # bits of 256 in which similar texts may differ
CHUNK, PER_BUCKET = 5_000_000, 24_000_000  # characters of text to a chunk and to a bucket of shingles, about
TEXTS, SHINGLES = 4096, 2_000_000  # texts and shingles to a block that a task holds in the exact comparison, about
PART = 256  # texts to a product of incidence tables
OFFSETS = np.random.default_rng(SEED).integers(1, 1 << 63, 4, dtype=np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], dtype="<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp): fp as a signed long with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            fps = np.array([fingerprint(t, size) for t in block["text"]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block["id"], pa.int64()), pa.array(fps)], ["id", "fp"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


class Tree:
    """A complete vantage-point tree: node k has children 2k+1 (inner) and 2k+2."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7):
        self.depth = depth
        self.pivots = np.zeros((1 << depth) - 1, np.uint64)
        self.medians = np.zeros((1 << depth) - 1, np.int64)
        rng = np.random.default_rng(seed)
        members = {0: sample}
        for node in range((1 << depth) - 1):
            own = members.pop(node)
            own = own if len(own) else sample
            tries = own[rng.integers(0, len(own), 4)]
            spread = [np.bitwise_count(own ^ p).std() for p in tries]
            pivot = tries[int(np.argmax(spread))]
            d = np.bitwise_count(own ^ pivot)
            self.pivots[node], self.medians[node] = pivot, int(np.median(d))
            members[2 * node + 1], members[2 * node + 2] = own[d <= self.medians[node]], own[d > self.medians[node]]

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard): the shards each fingerprint goes to."""
        rows, nodes = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count(fps[rows] ^ self.pivots[nodes]).astype(np.int64)
            inner, outer = d <= self.medians[nodes] + radius, d > self.medians[nodes]
            rows = np.concatenate([rows[inner], rows[outer]])
            nodes = np.concatenate([2 * nodes[inner] + 1, 2 * nodes[outer] + 2])
        return rows, nodes - ((1 << self.depth) - 1)


def _exact(fps: np.ndarray, own: np.ndarray, radius: int, parent: np.ndarray) -> np.ndarray:
    """Compare all of own with each other, block by block."""
    for at in range(0, len(own), LEAF):
        part = fps[own[at : at + LEAF]]
        for to in range(at, len(own), LEAF):
            i, j = np.nonzero(np.bitwise_count(part[:, None] ^ fps[own[to : to + LEAF]][None, :]) <= radius)
            keep = i + at < j + to
            if keep.any():
                parent = merge(parent, own[at + i[keep]], own[to + j[keep]])
    return parent


def probes(fps: np.ndarray) -> np.ndarray:
    """(n, 65): each fingerprint and its 64 neighbours at one bit."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    return fps[:, None] ^ flips[None, :]


def _by_probes(fps: np.ndarray, own: np.ndarray, parent: np.ndarray) -> np.ndarray:
    keys = probes(fps[own]).ravel()
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    who = own[order // 65]
    return merge(parent, who[:-1][same], who[1:][same])


def local_components(fps: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints: the index of the least member of each one's component."""
    parent = np.arange(len(fps))
    rng = np.random.default_rng(11)
    todo = [np.arange(len(fps))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            parent = _exact(fps, own, radius, parent)
            continue
        pivot = fps[own[rng.integers(len(own))]]
        d = np.bitwise_count(fps[own] ^ pivot).astype(np.int64)
        median = int(np.median(d))
        inner, outer = own[d <= median + radius], own[d > median]
        if max(len(inner), len(outer)) > 0.85 * len(own):  # a ball too dense for bounds to cut
            parent = _by_probes(fps, own, parent) if radius == 2 else _exact(fps, own, radius, parent)
        else:
            todo += [inner, outer]
    return settle(parent)


def classes(found: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, rep, component) of (id, fp): rep is the least id of a fingerprint, component of its class."""
    spark = found.sparkSession
    distinct = staged(found.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-distinct")
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / SHARD))))
    share = min(1.0, 2 * SAMPLE / max(1, n))
    if depth:
        rows = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").limit(SAMPLE).collect()
        tree = spark.sparkContext.broadcast(Tree(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64), depth))
    else:
        tree = spark.sparkContext.broadcast(Tree(np.zeros(0, np.uint64), 0))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, reps = (np.asarray(batch.column(k)) for k in (0, 1))
            rows, shards = tree.value.route(fps.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(fps[rows]), pa.array(reps[rows])], ["shard", "fp", "rep"])

    known = distinct.where("rep is not null")
    dealt = staged(known.mapInArrow(deal, "shard long, fp long, rep long"), "simhash-dealt")
    sizes = dealt.groupBy("shard").count()
    large = [r[0] for r in sizes.where(F.col("count") > MAX_SHARD).collect()] if n > MAX_SHARD and radius == 2 else []

    def shard_stars(table: pa.Table) -> pa.Table:
        reps = table.column("rep").to_numpy()
        order = np.argsort(reps, kind="stable")
        reps = reps[order]
        root = local_components(table.column("fp").to_numpy()[order].view(np.uint64), radius)
        linked = np.nonzero(root != np.arange(len(root)))[0]
        return pa.table({"a": reps[linked], "b": reps[root[linked]]})

    usual = dealt.where(~F.col("shard").isin(large)) if large else dealt
    edges = usual.groupBy("shard").applyInArrow(shard_stars, "a long, b long")
    if large:

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 8192):
                    part = batch.slice(at, 8192)
                    k = probes(np.asarray(part.column(0)).view(np.uint64)).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.repeat(np.asarray(part.column(1)), 65))], ["key", "rep"])

        probed = dealt.where(F.col("shard").isin(large)).select("fp", "rep").distinct().mapInArrow(keys, "key long, rep long")
        least = probed.groupBy("key").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1")
        edges = edges.unionByName(probed.join(least, "key").where("rep <> b").select(F.col("rep").alias("a"), "b"))
    labels = connected(edges.distinct())
    return distinct.join(labels, distinct["rep"] == labels["id"], "left").select("fp", "rep", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the fingerprint in 16 hex digits."""
    found = staged(with_fingerprints(docs, id_col, text_col, size), "simhash-fp")
    by_fp = classes(found, radius).select(F.col("fp").alias("key"), "component")
    joined = found.join(by_fp, found["fp"] == by_fp["key"], "left")
    return joined.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Each text's word shingles as sorted distinct hashes; fewer than `size` words are one shingle."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    starts, found, _ = words.windows(hashes, size)
    at = np.searchsorted(words.doc[starts], np.arange(len(texts) + 1))
    out = []
    for d, n in enumerate(words.counts.tolist()):
        if n >= size:
            out.append(np.unique(found[at[d] : at[d + 1]]))
        else:
            own = hashes[words.first[d] : words.first[d + 1]].tobytes()
            out.append(np.array([xxhash.xxh64_intdigest(own, SEED)] if n else [], np.uint64))
    return out


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """256 bits as four words: each bit by the majority of the shingles."""
    total = np.zeros(256, np.int64)
    for at in range(0, len(shingles), 16_320):
        part = mix64(shingles[at : at + 16_320, None] + OFFSETS[None, :])
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8)  # 255 ones fit a byte
        total += sums.sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(shingles), bitorder="little").view(np.uint64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared) - 1e-9


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 8192) -> np.ndarray:
    """How many shingles each of the sets `left` shares with each of the sets `right`, by products of incidence tables."""
    sizes = np.array([len(x) for x in sets], np.int64)
    every, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[column] > 1
    owner, column = owner[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        at, to = np.searchsorted(column, [low, low + width])
        table = np.zeros((len(sets), width), np.float32)
        table[owner[at:to], column[at:to] - low] = 1
        out += table[left] @ table[right].T
    return out.astype(np.int64)


def _open(wide: np.ndarray, known: np.ndarray, n: np.ndarray, alone: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sets of different `known` classes can be similar, by their fingerprints and by how many shingles they can share."""
    distance = np.zeros((len(left), len(right)), np.int16)
    for k in range(wide.shape[1]):
        distance += np.bitwise_count(wide[left, k][:, None] ^ wide[right, k][None, :])
    most = np.minimum((n - alone)[left][:, None], (n - alone)[right][None, :])
    total = n[left][:, None] + n[right][None, :]
    return (distance <= REACH) & (known[left][:, None] != known[right][None, :]) & (most >= similarity * (total - most) - 1e-9)


def open_links(wide: np.ndarray, known: np.ndarray, n: np.ndarray, alone: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest (a, b) of the pairs that _open leaves, searched by a vantage-point tree.

    A node's vantage point is a fingerprint or the empty set, whichever cut m
    leaves the least pairs in the inner branch, d(x, p) <= m + REACH, and the
    outer one, d(x, p) > m. From the empty set a set is as far as it is large,
    and similar ones differ by the factor `similarity` at most. Balls that no
    cut makes smaller are compared directly.
    """
    parent, rng, todo = np.arange(len(wide)), np.random.default_rng(11), [np.arange(len(wide))]
    while todo:
        own = todo.pop()
        if (known[own] == known[own[0]]).all():
            continue
        if len(own) > LEAF:
            d = np.bitwise_count(wide[own] ^ wide[own[rng.integers(len(own))]]).sum(axis=1, dtype=np.int64)
            sizes = np.unique(n[own])
            least, cut = 0.85 * len(own) ** 2, None
            for x, ms, fars in ((d, np.arange(256), np.arange(256) + REACH), (n[own], sizes, sizes / similarity + 1e-6)):
                order = np.sort(x)
                pairs = np.searchsorted(order, fars, "right").astype(float) ** 2 + (len(own) - np.searchsorted(order, ms, "right")).astype(float) ** 2
                if pairs.min() <= least:
                    k = int(np.argmin(pairs))
                    least, cut = pairs[k], (x <= fars[k], x > ms[k])
            if cut:
                todo += [own[side] for side in cut if side.any()]
                continue
        for at in range(0, len(own), LEAF):
            for to in range(at, len(own), LEAF):
                left, right = own[at : at + LEAF], own[to : to + LEAF]
                i, j = np.nonzero(_open(wide, known, n, alone, left, right, similarity))
                if len(i):
                    parent = merge(parent, left[i], right[j])
    root = settle(parent)
    linked = np.flatnonzero(root != np.arange(len(root)))
    return linked, root[linked]


def similar_links(sets: list[np.ndarray], wide: np.ndarray, known: np.ndarray, alone: np.ndarray, side: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest (a, b) of exact links between sets of different `known` classes; between the sides only, if there are any."""
    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(sizes - alone, kind="stable")  # those that can share much with each other meet in few products
    lefts, rights = (order, order) if side is None else (order[~side[order]], order[side[order]])
    parent = np.arange(len(sets))
    for at in range(0, len(lefts), PART):
        for to in range(at if side is None else 0, len(rights), PART):
            left, right = lefts[at : at + PART], rights[to : to + PART]
            near = _open(wide, known, sizes, alone, left, right, similarity)
            near &= parent[left][:, None] != parent[right][None, :]
            if not near.any():
                continue
            left, right, near = left[near.any(axis=1)], right[near.any(axis=0)], near[near.any(axis=1)][:, near.any(axis=0)]
            both = overlaps([sets[k] for k in (*left, *right)], np.arange(len(left)), np.arange(len(left), len(left) + len(right)))
            near &= both >= similarity * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-9
            i, j = np.nonzero(near)
            parent = settle(merge(parent, left[i], right[j]))
    linked = np.flatnonzero(parent != np.arange(len(sets)))
    return linked, parent[linked]


def _places(sets: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct places sorted, each shingle's among them, whether two texts have it); a place is a bucket and 32 bits of a hash."""
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    at = (mix64(every + np.uint64(5)) % np.uint64(buckets)) << np.uint64(32) | every >> np.uint64(32)
    distinct, back, counts = np.unique(at, return_inverse=True, return_counts=True)
    return distinct, back, counts > 1


def _bounds(distinct: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(distinct >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


SURVIVORS = "id long, h long, g long, n long, alone long, digest binary, set binary, bits binary, w0 long, w1 long, w2 long, w3 long"


def survivors(known: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of known(id, h, g, text): the texts with `similarity` of their shingles or more also in other texts, and those without any.

    Each chunk of texts sends its distinct shingles, 32 bits each in a bucket's
    list; the bucket answers one bit for each. Two shingles with equal bits
    count as shared, so a text can pass too much and never too little.
    """
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks, buckets = max(1, round(total / CHUNK)), max(1, round(total / PER_BUCKET))
    rows = known.withColumn("chunk", F.pmod(F.col("h"), F.lit(chunks)))

    def all_sets(texts: list[str | None]) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(texts):
            to, room = at, 1 << 20
            while to < len(texts) and (to == at or len(texts[to] or "") <= room):
                room -= len(texts[to] or "")
                to += 1
            out += shingle_sets(texts[at:to], size)
            at = to
        return out

    def send(key: tuple, table: pa.Table) -> pa.Table:
        release()
        distinct, _, _ = _places(all_sets(table.column("text").to_pylist()), buckets)
        at = _bounds(distinct, buckets)
        full = np.flatnonzero(np.diff(at))
        short = distinct.astype(np.uint32)
        return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(full), pa.int64()), "packed": pa.array([short[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        release()
        found = confirm([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("packed")])
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "bits": pa.array([np.packbits(x).tobytes() for x in found], pa.binary())})

    def keep(table: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        sets = all_sets(table.column("text").to_pylist())
        distinct, back, shared = _places(sets, buckets)
        at = _bounds(distinct, buckets)
        for bucket, packed in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
            n = at[bucket + 1] - at[bucket]
            shared[at[bucket] : at[bucket + 1]] |= np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
        flags, ends = shared[back], np.cumsum([len(x) for x in sets])
        chosen, out = [], [[], [], [], [], [], []]
        for k, (own, end) in enumerate(zip(sets, ends.tolist())):
            bits = flags[end - len(own) : end]
            if not len(own) or bits.sum() >= similarity * len(own) - 1e-9:
                chosen.append(k)
                large = len(own) * (1 - similarity) >= similarity - 1e-9  # lesser sets are similar to equal ones only
                row = (len(own), int((~bits).sum()), xxhash.xxh3_128_digest(own.tobytes(), SEED), own.tobytes() if large else None, np.packbits(bits).tobytes() if large else None, wide_fingerprint(own))
                for column, value in zip(out, row):
                    column.append(value)
        wide = np.array(out[5], np.uint64).reshape(-1, 4).view(np.int64)
        left = table.select(["id", "h", "g"]).take(pa.array(chosen, pa.int64()))
        columns = [*(pa.array(x, pa.int64()) for x in out[:2]), *(pa.array(x, pa.binary()) for x in out[2:5]), *(pa.array(wide[:, k]) for k in range(4))]
        return pa.table([*(x.combine_chunks() for x in left.columns), *columns], names=[x.split()[0] for x in SURVIVORS.split(", ")])

    sent = rows.groupBy("chunk").applyInArrow(send, "bucket int, chunk long, packed binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "bucket int, chunk long, bits binary")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(keep, SURVIVORS)


def shard_keys(nodes: DataFrame, similarity: float) -> DataFrame:
    """(key, node, own): shards such that two similar sets meet in one at least; own is how many shingles no other text has.

    Of two sets in one order, the first (1 - similarity) * n + 1 shingles have
    one in common. The order puts shingles that no other text has first; these
    lead nowhere and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, packed, bits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own = np.frombuffer(packed.as_buffer(), np.uint64)
                shared = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=len(own)).astype(bool)
                alone = int((~shared).sum())
                first = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 - alone
                keys = own[shared][: max(first, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(np.full(len(keys), x, np.int64)) for x in (node, alone))], ["key", "node", "own"])

    return nodes.where("set is not null").select("node", "set", "bits").mapInArrow(run, "key long, node long, own long")


def verified(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose fingerprints lie within reach and whose sets are similar."""
    wide = [f"w{k}" for k in range(4)]
    left = nodes.select(F.col("node").alias("a"), *(F.col(w).alias(f"a_{w}") for w in wide))
    right = nodes.select(F.col("node").alias("b"), *(F.col(w).alias(f"b_{w}") for w in wide))
    apart = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in wide), F.lit(0))
    near = pairs.join(left, "a").join(right, "b").where(apart <= REACH).select("a", "b")
    sets = nodes.select("node", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(2), batch.column(3)
            good = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in zip(one, two)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


WIDE = ("w0", "w1", "w2", "w3")


def _wide(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(w).to_numpy() for w in WIDE], axis=1).view(np.uint64)


def cells(members: DataFrame, similarity: float) -> DataFrame:
    """(node, cell) of the members (key, node, class, n, alone, w0 ... w3) of shards that can be similar to one of another class.

    Each shard searches its own tree. All such pairs lie within a cell, and a node is in one cell.
    """

    def search(table: pa.Table) -> pa.Table:
        names = table.column("node").to_numpy()
        a, b = open_links(_wide(table), *(table.column(c).to_numpy() for c in ("class", "n", "alone")), similarity)
        return pa.table({"a": names[a], "b": names[b]})

    found = connected(members.groupBy("key").applyInArrow(search, "a long, b long").distinct())
    return found.select(F.col("id").alias("node"), F.col("component").alias("cell"))


def dealt(celled: DataFrame) -> DataFrame:
    """Rows (cell, n, ...) by pairs (i, j) of blocks of their cell; a cell of up to TEXTS texts and SHINGLES shingles is one block."""
    sums = celled.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / TEXTS), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks").cast("long")).cast("int")
    paired = celled.join(sums, "cell").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return paired.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")


def similar_classes(nodes: DataFrame, similarity: float) -> DataFrame:
    """(id, component) of the nodes (node, n, alone, set, bits, w0 ... w3) that are similar to another.

    Every shard first compares its members with its vantage point, the member
    with the fewest shingles of its own, as the text is that others were copied
    from. Where that leaves a shard in more than one class, its tree finds the
    members to compare in full; shards of the same members are searched once.
    Sets are sent to cells, not to shards, so once each where a cell is a block.
    """
    keyed = staged(shard_keys(nodes, similarity), "simhash-keys")
    points = keyed.groupBy("key").agg(F.min_by("node", F.struct("own", "node")).alias("b"), F.count("*").alias("size")).where("size > 1")
    rays = keyed.join(points, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    near = staged(verified(rays, nodes, similarity), "simhash-near")
    labels = connected(near).withColumnRenamed("id", "node")
    classed = keyed.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("class"))
    mixed = classed.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    mixed = staged(mixed.groupBy("size", "members").agg(F.min("key").alias("key")), "simhash-mixed")
    if mixed.isEmpty():
        return labels.select(F.col("node").alias("id"), "component")
    members = classed.join(mixed.select("key"), "key").join(nodes.select("node", "n", "alone", *WIDE), "node")
    found = cells(members, similarity)
    celled = found.join(labels, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component").join(nodes.select("node", "n", "alone", "set", *WIDE), "node")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        names = table.column("node").to_numpy()
        side = None if key[1].as_py() == key[2].as_py() else table.column("own").to_numpy() == key[2].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        a, b = similar_links(sets, _wide(table), table.column("class").to_numpy(), table.column("alone").to_numpy(), side, similarity)
        return pa.table({"a": names[a], "b": names[b]})

    more = staged(dealt(celled).groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "simhash-more")
    return connected(near.unionByName(more))


def distinct_rows(docs: DataFrame, size: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one row of each class of similar texts, that of the least id; rows without an id all stay."""
    h, g = (F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)) for k in (1, 2))
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), h.alias("h"), g.alias("g"), F.col(text_col).alias("text"))
    found = staged(survivors(known, size, similarity), "simhash-survivors")
    first = [F.first(c).alias(c) for c in ("n", "alone", "set", "bits", "w0", "w1", "w2", "w3")]
    nodes = found.groupBy("digest").agg(F.min(F.struct("id", "h", "g")).alias("least"), *first)
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "simhash-nodes")
    labels = similar_classes(nodes, similarity)
    classed = nodes.join(labels, nodes["node"] == labels["id"], "left").select("least", F.coalesce("component", "node").alias("component"))
    kept = classed.groupBy("component").agg(F.min("least").alias("least")).select("least.*").withColumn("stays", F.lit(True))
    marks = staged(found.select("id", "h", "g").distinct().join(kept, ["id", "h", "g"], "left").select(F.col("id").alias("mark_id"), F.col("h").alias("mark_h"), F.col("g").alias("mark_g"), F.coalesce("stays", F.lit(False)).alias("stays")), "simhash-marks")
    names = [f"col_{k}" for k in range(len(docs.columns))]
    rows = docs.where(F.col(id_col).isNotNull()).select(*(F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, names)), F.col(id_col).cast("long").alias("row_id"), h.alias("row_h"), g.alias("row_g"))
    left = rows.join(marks, (F.col("row_id") == F.col("mark_id")) & (F.col("row_h") == F.col("mark_h")) & (F.col("row_g") == F.col("mark_g")), "left").where("stays is null or stays")
    same = Window.partitionBy("row_id", "row_h", "row_g").orderBy(F.xxhash64(*names))  # equal rows are copies: one of them stays
    left = left.withColumn("copy", F.row_number().over(same)).where("copy = 1").select(*(F.col(x).alias(c) for c, x in zip(docs.columns, names)))
    return left.unionByName(docs.where(F.col(id_col).isNull()))
