"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

Signature: each shingle with count w owns the weight range [0, w), which is
discretised into bands [0, 1), [1, 2), [2, 4), [4, 8), ...  Every band is a
Poisson process of its own whose points carry an arrival time, a register and
a level; points at levels beyond w do not count.  Each register keeps its
first point.  Two registers are equal with just the probability of the
weighted Jaccard similarity.  Points are drawn in rounds, and a process stops
when its next arrival is later than every register's, so most shingles need
one point.

Candidates share all ``ROWS`` registers of one of ``BANDS`` bands.  The
multiset overlap of candidates is computed from their texts.  Documents whose
words agree are one node throughout, and a class is a connected component of
the links between nodes.  To find components without all pairs of a bucket,
candidates are taken in rounds: a node and the hub of most of its buckets; then
all its hubs that still lie in other components; at last every remaining pair
of a bucket across components, unless their maps of shingles prove an overlap
too small.  A pair within one component need not be verified.

Hot contents, classes and hubs, to whose members texts or rows are joined, are
dealt into salts, so no task holds one whole.

A text of fewer than five words is one shingle.  Texts without words are equal
only as whole texts; a null text is a class of its own.  Texts are read whole,
however long; rows that repeat are in one class; other columns are not read,
whatever their names, and pass ``deduplicate`` unchanged.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import UPPER, Scratch, free_name, is_empty, salted_join, small_side, text_key

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
#: Bits of the map of a document's shingles; two maps bound the overlap from above.
BITMAP = 2048
_SEED = np.uint64(0x5851F42D4C957F2D)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


#: A-Z as a-z, and a space for every byte that is in no word.
_FOLDED = bytes(b + 32 if chr(b) in UPPER else b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def folded(text: str) -> bytes:
    """The words of a text, lower-cased, with a space between them."""
    return b" ".join(text.encode().translate(_FOLDED).split())


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of folded texts, one after the other, and the text that each word is in."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.r_[0, ends[:-1] + 1]
    sizes = ends - starts
    powers = np.multiply.accumulate(np.full(int(sizes.max()) + 1, 0x9FB21C651E98DF25, np.uint64))
    values = _BYTES[data] * powers[np.arange(len(data)) - np.repeat(starts, sizes + 1)]
    values[ends] = 0
    owners = np.cumsum(data[ends] == 10) - (data[ends] == 10)
    hashes = _mix(np.add.reduceat(values, starts) + sizes.astype(np.uint64))
    return hashes[sizes > 0], owners[sizes > 0]


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of folded texts, and the text that each is in; fewer words than ``size`` make one shingle."""
    words, owners = word_hashes(texts)
    counts = np.bincount(owners, minlength=len(texts))
    found, of = [], []
    for n in range(1, size + 1):
        # texts of exactly n words have one shingle of n; those of more have shingles of ``size``
        wanted = counts == n if n < size else counts >= n
        last = len(words) - n + 1
        if last <= 0 or not wanted.any():
            continue
        out = np.full(last, n, np.uint64)
        for k in range(n):
            out = _mix(out ^ words[k : last + k]) + np.uint64(k)
        whole = (owners[:last] == owners[n - 1 :]) & wanted[owners[:last]]
        found.append(out[whole])
        of.append(owners[:last][whole])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(of)


def multiset(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) with counts: owners, hashes, counts."""
    order = np.lexsort((hashes, owners))
    h, o = hashes[order], owners[order]
    starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.zeros(0, int)
    return o[starts], h[starts], np.diff(np.r_[starts, len(h)])


def bag_minhash(owners: np.ndarray, elements: np.ndarray, counts: np.ndarray, docs: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (docs x registers) of weighted sets given as rows (owner, element, count)."""
    # a row for each element and band of its weight range
    owner, element, count, low, width = owners, elements, counts, np.zeros(len(counts)), np.ones(len(counts))
    rows = [(owner, element, count, low, width)]
    edge = 1
    while len(counts) and edge < counts.max():
        more = counts > edge
        rows.append((owners[more], _mix(elements[more] + np.uint64(edge)), counts[more], np.full(more.sum(), float(edge)), np.full(more.sum(), float(edge))))
        edge *= 2
    owner, element, count, low, width = (np.concatenate(x) for x in zip(*rows))
    first = np.full(docs * registers, np.inf)
    point = np.zeros(docs * registers, np.uint64)
    time, k, cut = np.zeros(len(owner)), 0, low + width > count
    while len(owner):
        draw = _mix(element + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(_uniform(draw)) / width
        draw = _mix(draw ^ _SEED)
        counted = np.ones(len(owner), bool)
        # only the band that the count ends in has levels beyond it
        counted[cut] = low[cut] + width[cut] * _uniform(_mix(draw[cut])) < count[cut]
        at = owner * registers + (draw % np.uint64(registers)).astype(np.int64)
        a, t, d = at[counted], time[counted], draw[counted]
        np.minimum.at(first, a, t)
        won = first[a] == t
        point[a[won]] = d[won]
        last = first.reshape(docs, registers).max(axis=1)
        stay = time < last[owner]
        owner, element, count, low, width, time, cut = (x[stay] for x in (owner, element, count, low, width, time, cut))
        k += 1
    return point.reshape(docs, registers)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Which of ``BITMAP`` values the shingles hash to, as 64-bit words."""
    bits = np.zeros(BITMAP, bool)
    bits[(_mix(hashes ^ _SEED) % np.uint64(BITMAP)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def band_hashes(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        out = _mix(out ^ parts[:, :, k]) + np.uint64(k + 1)
    return out.view(np.int64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two documents given as shingle hashes."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / max(len(a) + len(b) - both, 1)


def _chunks(texts: list[str | None], most: int = 1 << 18, rows: int = 250) -> Iterator[slice]:
    """Slices of about ``most`` characters, or one text, and at most ``rows`` texts."""
    start = held = 0
    for k, t in enumerate(texts):
        if k > start and (held + len(t or "") > most or k - start == rows):
            yield slice(start, k)
            start, held = k, 0
        held += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), content (of the words, or of a text without any), shingles and band hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in _chunks(texts):
                own = [folded(t or "") for t in texts[at]]
                content = [None if t is None else hashlib.md5(w or b"\0" + t.encode()).hexdigest() for t, w in zip(texts[at], own)]
                shingles, owners = shingle_hashes(own)
                bands: list = [None] * len(own)
                maps: list = [None] * len(own)
                filled, compact = np.unique(owners, return_inverse=True)
                if len(filled):
                    for i, row in zip(filled, band_hashes(bag_minhash(*multiset(shingles, compact), len(filled)))):
                        bands[i] = row
                    order = np.argsort(compact, kind="stable")
                    for i, part in zip(filled, np.split(shingles[order], np.cumsum(np.bincount(compact))[:-1])):
                        maps[i] = bitmap(part)
                part = batch.slice(at.start, at.stop - at.start)
                sizes = np.bincount(owners, minlength=len(own))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(content, pa.string()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))], names=["doc_id", "key", "content", "shingles", "bands", "map"])

    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(sign, "doc_id long, key long, content string, shingles int, bands array<long>, map array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), whether their weighted Jaccard is at least ``threshold``; texts: (node, text).

    Many pairs may have the same ``b``, a hub."""
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    hubs = counts.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    met = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    met = salted_join(met, hubs, ["b"], ["a"], counts=counts).select("a", "b", "text_a", "text_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                hashes, owners = shingle_hashes([folded(a), folded(b)])
                near.append(weighted_jaccard(hashes[owners == 0], hashes[owners == 1]) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    return met.mapInArrow(verify, "a long, b long, near boolean")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """The least node of each linked node's component: (node, root).  Links: (a, b)."""
    both = scratch.table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    roots = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    while True:
        # the least root among a node's neighbours, then that root's own root
        seen = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = roots.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = scratch.table(nearer.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        roots = moved.select("node", "root")
        if is_empty(moved.where("old != root")):
            return roots


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its class), ``content``, the key of its words, ``key`` of its text, and class_key.

    An id may have several texts, in one class or in several; class_id and class_key together name a class."""
    with Scratch(docs.sparkSession, "near-dedup-work") as work:
        return _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), threshold, work, Scratch(docs.sparkSession, "near-dedup"))


def _classes(docs: DataFrame, threshold: float, scratch: Scratch, kept: Scratch) -> DataFrame:
    signed = kept.table(_signed(docs))
    # one row stands for a content: the one with the least id and text key
    nodes = signed.where(F.col("content").isNotNull()).groupBy("content").agg(
        F.min(F.struct("doc_id", "key", "shingles", "bands", "map")).alias("first"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("named"), F.count("*").alias("n")
    )
    nodes = scratch.table(nodes.select("content", "named", "n", F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"), "first.shingles", "first.bands", "first.map", F.monotonically_increasing_id().alias("node")))
    buckets = nodes.where("shingles > 0").select("node", "shingles", F.posexplode("bands").alias("band", "hash"))
    bucket = ["band", "hash"]
    shared = buckets.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    buckets = scratch.table(buckets.join(shared, bucket))
    # a bucket's hub is the node that meets most others: what near copies were made from, if it is there
    met_by = buckets.groupBy("node").agg(F.sum("n").alias("meets"))
    hub = F.max(F.struct("meets", -F.col("node"))).alias("hub")
    first = buckets.join(met_by, "node").groupBy(*bucket).agg(hub).select(*bucket, (-F.col("hub.col2")).alias("hub"))
    buckets = scratch.table(buckets.drop("n").join(first, bucket))

    candidates = scratch.table(buckets.select("node").distinct())
    wanted = small_side(scratch.table(nodes.join(candidates, "node", "left_semi").select("first_id", "first_key", "node")))
    own = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    texts = own.join(wanted, own["doc_id"].eqNullSafe(wanted["first_id"]) & (own["key"] == wanted["first_key"])).select("node", "text")
    texts = scratch.table(texts.groupBy("node").agg(F.first("text").alias("text")))

    low, high = F.least("shingles", "other"), F.greatest("shingles", "other")
    long_enough = low >= threshold * high  # an overlap of the shorter one at most
    size = buckets.select(F.col("node").alias("hub"), F.col("shingles").alias("other")).distinct()
    hubs = buckets.where("node != hub").groupBy("node", "hub", "shingles").agg(F.count("*").alias("times")).join(size, "hub").where(long_enough)
    hubs = scratch.table(hubs.select(F.col("node").alias("a"), F.col("hub").alias("b"), "times"))

    # each node and the hub that is its in most buckets come first
    one = scratch.table(hubs.groupBy("a").agg(F.max(F.struct("times", "b")).alias("p")).select("a", "p.b"))
    checked = scratch.table(_verified(one, texts, threshold))
    roots = components(checked.where("near"), scratch)
    rounds = 1
    while True:
        labelled = scratch.table(buckets.drop("hub").join(roots, "node", "left").select("band", "hash", "node", "shingles", F.coalesce("root", "node").alias("root")))
        if rounds == 1:
            # each node and the first nodes of its buckets, if they are still apart
            at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
            apart = hubs.join(at("a"), "a", "left").join(at("b"), "b", "left")
            apart = apart.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b").distinct()
        else:
            # buckets across components: those outside the largest component against all others
            spread = labelled.groupBy("band", "hash", "root").agg(F.count("*").alias("n")).groupBy("band", "hash").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main"))
            # few buckets lie in several components; their rows are the only ones that meet
            spread = scratch.table(spread.where("roots > 1").drop("roots"))
            mixed = scratch.table(labelled.join(spread, bucket))
            outside = mixed.where("root != main").select("band", "hash", F.col("node").alias("x"), F.col("shingles").alias("other"), F.col("root").alias("root_x"))
            maps = nodes.select("node", "map")
            outside = outside.join(maps.select(F.col("node").alias("x"), F.col("map").alias("map_x")), "x")
            mixed = mixed.join(maps, "node")
            # at least so many shingles of the one are missing in the other
            missing = lambda p, q: F.aggregate(F.zip_with(p, q, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda s, n: s + n)
            shared_most = F.least(F.col("other") - missing("map_x", "map"), F.col("shingles") - missing("map", "map_x"))
            possible = shared_most >= threshold * (F.col("other") + F.col("shingles") - shared_most)
            met = outside.join(mixed, bucket).where((F.col("root_x") != F.col("root")) & long_enough & possible)
            apart = met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
        known = checked.select("a", "b") if rounds == 1 else checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        apart = scratch.table(apart.join(known, ["a", "b"], "left_anti"))
        if not is_empty(apart):
            checked = scratch.table(checked.unionByName(_verified(apart, texts, threshold)))
            roots = components(checked.where("near"), scratch)
        if rounds == 2:
            break
        rounds += 1

    # contents are named by the least id of their class, then rows by their content
    named = scratch.table(nodes.select("content", "node", "named", "n").join(roots, "node", "left").select("content", "named", "n", F.coalesce("root", "node").alias("root")))
    least = named.groupBy("root").agg(F.min("named").alias("least"), F.count("*").alias("n"))
    of_content = salted_join(named.drop("named"), least, ["root"], ["content"]).select("content", "n", F.col("least.doc_id").alias("class_id"), F.col("least.key").alias("class_key"))
    of_content = kept.table(of_content)
    rows = signed.where(F.col("content").isNotNull()).select("doc_id", "key", "content")
    named = salted_join(rows, of_content, ["content"], ["doc_id", "key"]).select("doc_id", "class_id", "content", "key", "class_key")
    alone = signed.where(F.col("content").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), "content", "key", F.col("key").alias("class_key"))
    return named.unionByName(alone)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents, one of each class: the one with the least id.  The columns stay.

    Documents without id or text stay; of rows that repeat that id in one class, one stays.  Unlike texts
    under one id are documents of their own."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    found = scratch.table(classes(docs))
    stays = (F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("class_key"))
    name = free_name(docs, "key")
    own = docs.withColumn(name, text_key(F.col("text")))
    of = lambda t: (own["doc_id"] == t["doc_id"]) & (own[name] == t["key"])
    gone = small_side(scratch.table(found.where(F.col("doc_id").isNotNull() & ~stays).select("doc_id", "key").distinct()))
    kept = own.join(gone, of(gone), "left_anti")
    twice = scratch.table(found.where(stays & F.col("content").isNotNull()).groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"))
    if is_empty(twice):
        return kept.drop(name)
    twice = small_side(twice)
    once = kept.join(twice, of(twice), "left_semi").dropDuplicates(["doc_id", name])
    return kept.join(twice, of(twice), "left_anti").unionByName(once).drop(name)
