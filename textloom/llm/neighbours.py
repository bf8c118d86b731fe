"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: normalised vectors are centred and turned by several learned rotations
(iterative quantisation from different starts); the signs are the bits.  Mean,
rotations and slack are fitted on a bounded sample (``SAMPLE_ROWS``); every
row is indexed.

Index: rows are cut into blocks, and a block keeps its codes and, for each
substring of 16 bits, its rows sorted by that substring's value.

Search: two codes within distance m * (t + 1) - 1 differ by at most t bits in
one of m substrings, so looking up all values within t bits of the query's
finds every code within that radius.  The radius grows with t from query to
query.  The cosines of the codes found are computed on the original vectors in
double precision; the k-th best of them tells how far apart codes of a nearer
vector can be (the angle's share of the bits and ``slack`` deviations), and a
query is done once the radius covers that.  Queries whose neighbours lie too
far for looking up values (beyond ``REACH`` bits a substring) compare their
code with all of the block, within the radius that their k nearest codes give.

Rows that repeat an id, with the same or another vector, are one candidate or
one query: the score of two ids is the best of any of their rows.

Vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, nor do null ids; components of any finite
size do, for vectors are scaled by powers of two.  Rows with the query's
own id are its own.  Other columns are not read, whatever their names.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.language_id import hash_limit

#: Most vectors that rotations and radius are fitted on, about.
SAMPLE_ROWS = 16_384
SAMPLE_QUERIES = 512
BITS = 256
#: Share of true neighbours in the sample whose codes lie within the radius that their angle gives.
RADIUS_SHARE = 0.97
#: Bits by which looked-up substrings of 16 bits differ from the query's at most.
REACH = 2
BLOCK_ROWS = 16_384
QUERY_ROWS = 512


@dataclass(frozen=True)
class BinaryCode:
    mean: np.ndarray
    rotations: np.ndarray  # dimensions x bits
    slack: float

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes, whole 64-bit words long."""
        bits = (_unit(vectors) - self.mean) @ self.rotations > 0
        packed = np.packbits(bits, axis=1)
        return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        """How far apart the codes of vectors with at least this cosine are, but for rare ones."""
        bits = self.rotations.shape[1]
        share = np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi
        return bits * share + self.slack * np.sqrt(bits * np.maximum(share * (1 - share), 1 / bits))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component near one: no angle and no rounding changes, but squares neither vanish nor overflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all codes of ``a`` to all of ``b``."""
    x, y = a.view(np.uint64), b.view(np.uint64)
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def fit_rotations(sample: np.ndarray, bits: int = BITS, rounds: int = 15, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    x = _unit(sample)
    mean = x.mean(axis=0)
    x = x - mean
    order = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    width = min(x.shape[1], bits)
    basis = order[:, :width]
    v, random, out = x @ basis, np.random.default_rng(seed), []
    for _ in range(max(1, round(bits / width))):
        turn = np.linalg.qr(random.standard_normal((width, width)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        out.append(basis @ turn)
    return mean, np.hstack(out)


def fit(sample: np.ndarray, k: int = 5) -> BinaryCode:
    """Rotations, and the slack within which the sample's true neighbours lie."""
    mean, rotations = fit_rotations(sample)
    code = BinaryCode(mean, rotations, 0.0)
    if len(sample) <= k:
        return BinaryCode(mean, rotations, float("inf"))
    queries = np.linspace(0, len(sample) - 1, min(len(sample), SAMPLE_QUERIES)).astype(int)
    near = _unit(sample)[queries] @ _unit(sample).T
    near[np.arange(len(queries)), queries] = -np.inf
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    codes = code.encode(sample)
    apart = np.take_along_axis(hamming(codes[queries], codes), true, axis=1)
    # beyond what the k-th neighbour's angle gives, in deviations
    farthest = np.take_along_axis(near, true, axis=1).min(axis=1)
    expected, deviation = code.radius(farthest), BinaryCode(mean, rotations, 1.0).radius(farthest) - code.radius(farthest)
    return BinaryCode(mean, rotations, float(np.quantile((apart - expected[:, None]) / deviation[:, None], RADIUS_SHARE)))


#: All 16-bit values by the number of their bits.
_FLIPS = [np.flatnonzero(np.bitwise_count(np.arange(1 << 16, dtype=np.uint32)) == n).astype(np.uint16) for n in range(REACH + 1)]


def substring_tables(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each 16-bit substring of the codes: its values in order, and the rows that have them."""
    parts = codes.view(np.uint16)
    orders = [np.argsort(parts[:, k], kind="stable") for k in range(parts.shape[1])]
    return [(parts[order, k], order) for k, order in enumerate(orders)]


def look_up(tables: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (query, row) where a substring differs from the query's by just ``bits`` bits."""
    found, rows = [], max((len(order) for _, order in tables), default=0)
    for k, (values, order) in enumerate(tables):
        wanted = queries.view(np.uint16)[:, k, None] ^ _FLIPS[bits][None, :]
        first, last = np.searchsorted(values, wanted, "left").ravel(), np.searchsorted(values, wanted, "right").ravel()
        size = last - first
        of = np.repeat(np.arange(len(queries)), len(_FLIPS[bits]))
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        found.append(np.repeat(of, size) * rows + order[at])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return np.divmod(pairs, max(rows, 1))


def _kth_best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int, queries: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are a query's k best ids, each with its best row, and every query's k-th score (-1 if it has fewer)."""
    order = np.lexsort((-score, ids, q))
    order = order[np.r_[True, (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])]] if len(order) else order
    order = order[np.lexsort((ids[order], -score[order], q[order]))]
    starts = np.searchsorted(q[order], np.arange(queries))
    place = np.arange(len(order)) - starts[q[order]]
    kth = np.full(queries, -1.0)
    kth[q[order[place == k - 1]]] = score[order[place == k - 1]]
    return order[place < k], kth


@dataclass
class Block:
    """An indexed block of rows."""

    code: BinaryCode
    ids: np.ndarray
    vectors: np.ndarray
    ranked: int = 0  # pairs whose cosines were computed

    def __post_init__(self) -> None:
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.codes = self.code.encode(self.vectors)
        self.tables = substring_tables(self.codes)

    def search(self, k: int, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest ids to each query: query ids, ids, cosines."""
        codes, norms = self.code.encode(queries), np.sqrt(np.einsum("ij,ij->i", queries, queries))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]

        def rank(q: np.ndarray, v: np.ndarray) -> np.ndarray:
            """Adds the cosines of new pairs, keeps each query's best ids, and returns its k-th score."""
            other = query_ids[q] != self.ids[v]
            q, v = q[other], v[other]
            self.ranked += len(q)
            score = np.concatenate([np.einsum("ij,ij->i", queries[q[i : i + 65_536]], self.vectors[v[i : i + 65_536]]) for i in range(0, len(q), 65_536)] or [np.zeros(0)])
            held.append((q, v, score / (norms[q] * self.norms[v])))
            q, v, score = (np.concatenate(x) for x in zip(*held))
            best, kth = _kth_best(q, self.ids[v], score, k, len(queries))
            held[:] = [(q[best], v[best], score[best])]
            return kth

        far = len(self.tables) * (REACH + 1) - 1
        seen = np.zeros((len(queries), len(self.ids)), bool)
        going, kth = np.arange(len(queries)), np.full(len(queries), -1.0)
        for bits in range(REACH + 1):
            if bits == REACH:
                # so many values are looked up only where they can suffice
                going = going[self.code.radius(kth[going]) <= far]
            if not len(going):
                break
            q, v = look_up(self.tables, codes[going], bits)
            q = going[q]
            new = ~seen[q, v]
            seen[q[new], v[new]] = True
            kth = rank(q[new], v[new])
            going = going[self.code.radius(kth[going]) > len(self.tables) * (bits + 1) - 1]
        done = self.code.radius(kth) <= far
        rest = np.flatnonzero(~done)
        for first in range(0, len(rest), 64):
            self._compare(rest[first : first + 64], codes, seen, rank, k)
        (q, v, score) = held[0]
        return query_ids[q], self.ids[v], score

    def _compare(self, some: np.ndarray, codes: np.ndarray, seen: np.ndarray, rank, k: int) -> None:
        """Ranks, for some queries, the rows whose whole codes are within the radius."""
        apart = hamming(codes[some], self.codes)
        most = min(4 * k, len(self.ids)) - 1
        near = np.partition(apart, most, axis=1)[:, most, None]
        for wanted in (lambda kth: near, lambda kth: self.code.radius(kth[some])[:, None]):
            limit = wanted(rank(np.zeros(0, int), np.zeros(0, int)))
            q, v = np.nonzero((apart <= limit) & ~seen[some])
            seen[some[q], v] = True
            rank(some[q], v)


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))


def _packed(rows: DataFrame, most: int, dims: int) -> DataFrame:
    """Blocks of at most ``most`` rows: ids and vectors as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - size)
                at += part.num_rows
                size += part.num_rows
                held.append((part.column(0).to_numpy(), part.column(1).flatten().to_numpy()))
                if size == most:
                    yield _block(held)
                    held, size = [], 0
        if held:
            yield _block(held)

    def _block(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, vectors = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "vectors": [scaled(vectors.astype(np.float64).reshape(len(ids), dims)).tobytes()]})

    return rows.where(F.size("vector") == dims).select("id", "vector").mapInArrow(pack, "ids binary, vectors binary")


def nearest(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None) -> DataFrame:
    """The ``k`` nearest rows of ``index`` to each row of ``queries``: query_id, rank, vec_id, score."""
    spark = index.sparkSession
    rows, asked = _usable(index, id_col, vector_col), _usable(queries, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dims, total = sizes[0]["dims"], sizes[0]["count"]
    taken = F.xxhash64("id") <= hash_limit(SAMPLE_ROWS / total)
    # one row of each id, so that an id's own repeats are not what the radius is fitted on
    sample = rows.where((F.size("vector") == dims) & taken).groupBy("id").agg(F.min("vector").alias("vector")).toPandas().sort_values("id")
    if not len(sample):
        sample = rows.where(F.size("vector") == dims).limit(SAMPLE_ROWS).select("id", "vector").toPandas()
    code = spark.sparkContext.broadcast(fit(scaled(np.stack(sample["vector"])), k))

    # each block of queries meets each block of the index once; both are dealt over the same cells
    cells = cells or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = _packed(rows, BLOCK_ROWS, dims).withColumn("cell", F.pmod(F.xxhash64("ids"), F.lit(cells)))
    asked = _packed(asked.dropDuplicates(["id", "vector"]), QUERY_ROWS, dims).select(F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"))
    met = blocks.join(asked.hint("merge"), "cell").select("query_ids", "query_vectors", "ids", "vectors")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]

        def keep(i: bytes, v: bytes) -> Block:
            """The block as an index; the rows of one block follow one another."""
            if last[0] != i:
                last[:] = i, Block(code.value, np.frombuffer(i, np.int64), np.frombuffer(v).reshape(-1, dims))
            return last[1]

        for batch in batches:
            for q, qv, i, v in zip(*(batch.column(c).to_pylist() for c in range(4))):
                held = keep(i, v)
                a, b, s = held.search(k, np.frombuffer(q, np.int64), np.frombuffer(qv).reshape(-1, dims))
                yield pa.RecordBatch.from_pydict({"query_id": a, "vec_id": b, "score": s})

    found = met.mapInArrow(search, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame) -> DataFrame:
    """Queries are the rows whose id is divisible by 50."""
    return nearest(embeddings, embeddings.where(F.pmod(F.col("vec_id"), F.lit(50)) == 0))
