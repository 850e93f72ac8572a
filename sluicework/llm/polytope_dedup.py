"""Near-duplicate embeddings by cross-polytope hashing.

A unit vector is rotated by three rounds of random signs and a fast Hadamard
transform; the coordinate largest in size, with its sign, is the nearest corner of
a cross-polytope. Several corners make a bucket's key; several tables are kept. Each
vector also enters the buckets next to its own (the corners it missed by
least), so that a pair meets if any of their buckets agree. Every pair that meets is verified
by its cosine in double precision, and counted in the least key that both have.

Keys have more corners the more vectors there are, and each corner more makes a pair miss a table
more often. The tables follow: as many as a pair at the threshold needs to meet, measured on random pairs.

Equal vectors are one class, compared once. A bucket too large for a task is cut into
blocks, and pairs of blocks are compared. Tasks hand on each vector's links and a spanning
forest of them, never pairs.

Defined results: a vector that is null, of length zero, or holds null or non-finite components, and one
without an id, has no links; vectors of several lengths are compared as if filled with zeros, however long; a row
that repeats an id and vector is the same vector listed twice; two vectors under one id are two vectors, as classes have numbers of their own;
a pair at the threshold exactly is linked; an empty table gives no rows; columns other than id and vector are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, emit, shuffle_partitions, table
from .components import Forest, components

COSINE = 0.9
#: Tables, buckets of a table that a vector enters, members of a block, unrelated vectors that a bucket should hold about (which sets the corners of a key), seed.
TABLES, PROBES, BLOCK, FILL, SEED = 8, 6, 1024, 1 / 32, 99
#: Share of the pairs at the threshold that may meet in no table, about, at any size; beyond MOST tables a key has a corner less instead.
MISS, MOST = 0.001, 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of each row; its length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x


def keys(x: np.ndarray, corners: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """n x (tables * probes) keys of unit rows."""
    n, d = x.shape
    full = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, full - d))).astype(np.float64)
    out = np.empty((n, tables * probes), np.int64)
    for t in range(tables):
        best, alternatives = [], []
        for k in range(corners):
            y = x
            for r in range(3):
                y = hadamard(y * (np.random.default_rng((SEED, t, k, r)).integers(0, 2, full) * 2 - 1)) / math.sqrt(full)
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, : min(4, full)]
            corner = top * 2 + (np.take_along_axis(y, top, 1) < 0)
            best.append(corner[:, 0])
            height = np.take_along_axis(size, top, 1)
            alternatives += [(height[:, 0] - height[:, a], k, corner[:, a]) for a in range(1, top.shape[1])]
        loss = np.stack([a[0] for a in alternatives], 1)
        order = np.argsort(loss, axis=1, kind="stable")
        for p in range(probes):
            use = [b.copy() for b in best]
            if p:
                pick = order[:, min(p - 1, order.shape[1] - 1)]
                for j, (_, k, corner) in enumerate(alternatives):
                    use[k] = np.where(pick == j, corner, use[k])
            key = np.full(n, t, np.int64)
            for c in use:
                key = key * (2 * full) + c
            out[:, t * probes + p] = key
    return out


def misses(d: int, corners: int, threshold: float = COSINE, tables: int = TABLES, probes: int = PROBES, pairs: int | None = None) -> np.ndarray:
    """Of random pairs of unit vectors at the threshold: tables x pairs, whether they miss in the table."""
    full = 1 << max(1, (d - 1).bit_length())
    n = pairs or max(512, min(4096, (1 << 18) // full))
    rng = np.random.default_rng((SEED, d, corners))
    a, b = rng.normal(size=(2, n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    cosine = min(1.0, max(-1.0, threshold))
    ka, kb = (keys(x, corners, tables, probes).reshape(n, tables, probes) for x in (a, cosine * a + math.sqrt(1 - cosine**2) * b))
    return ~(ka[:, :, :, None] == kb[:, :, None, :]).any((2, 3)).T


def plan(n: int, d: int, threshold: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> tuple[int, int]:
    """(corners of a key, tables) for n distinct vectors; `tables` at least."""
    corners = max(2, math.ceil(math.log(max(2, n / FILL)) / math.log(2 << max(1, (d - 1).bit_length()))))
    while True:
        missed = misses(d, corners, threshold, TABLES, probes)
        one = missed.mean()
        need = 1 if one <= MISS else math.ceil(math.log(MISS) / math.log(min(one, 1 - 1 / missed.size)))
        need = max(tables, need)
        # In few dimensions there are few different rotations: what the tables miss together is looked at.
        if corners == 1 or need <= MOST and (d > 32 or misses(d, corners, threshold, need, probes).all(0).mean() <= 2 * MISS):
            return corners, need
        corners -= 1


def matrix(vectors: list | np.ndarray, d: int) -> np.ndarray:
    """Unit rows in double precision, filled with zeros to length d."""
    out = np.zeros((len(vectors), d))
    if isinstance(vectors, np.ndarray):
        out[:, : vectors.shape[1]] = vectors
    else:
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def stored(v: list[float]) -> bytes:
    """A vector's bytes: single precision where that loses nothing."""
    wide = np.array(v)
    with np.errstate(over="ignore"):
        narrow = wide.astype(np.float32)
    return narrow.tobytes() if (narrow == wide).all() else wide.tobytes()


def gathered(raw: list[bytes], n: list[int]) -> np.ndarray | list[np.ndarray]:
    """Stored vectors again: one array where all are of one kind."""
    if len(set(n)) == 1 and len(set(map(len, raw))) == 1:
        return np.frombuffer(b"".join(raw), np.float32 if len(raw[0]) == 4 * n[0] else np.float64).reshape(len(raw), n[0])
    return [np.frombuffer(r, np.float32 if len(r) == 4 * k else np.float64) for r, k in zip(raw, n, strict=True)]


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least key that rows of a and b share."""
    least = np.full(len(a), np.iinfo(np.int64).max)
    for j in range(b.shape[1]):
        met = (a == b[:, j : j + 1]).any(1)
        least = np.where(met, np.minimum(least, b[:, j]), least)
    return least


HASHED = pa.schema([("rep", pa.int64()), ("copies", pa.int64()), ("length", pa.int32()), ("vector", pa.binary()), ("keys", pa.list_(pa.int64())), ("packed", pa.binary())])
FOUND = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _compare(rows: list[tuple], d: int, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(rep, links, root) of the vectors of one bucket, or of one pair of blocks of it.

    rows: (key, low, high, own, rep, copies, length, vector, packed keys); two blocks are compared across only.
    """
    key, low, high = rows[0][:3]
    own, rep, copies = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
    x = matrix(gathered([r[7] for r in rows], [r[6] for r in rows]), d)
    left, right = (np.flatnonzero(own == low), np.flatnonzero(own == high)) if low != high else (np.arange(len(rows)),) * 2
    i, j = np.nonzero(x[left] @ x[right].T >= threshold - 1e-9)
    i, j = left[i], right[j]
    ahead = rep[i] < rep[j] if low == high else rep[i] != rep[j]
    i, j = i[ahead], j[ahead]
    if not len(i):
        return
    exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
    i, j = i[exact], j[exact]
    ks = np.frombuffer(b"".join(r[8] for r in rows), np.int64).reshape(len(rows), -1)
    counted = np.empty(len(i), bool)
    for s in range(0, len(i), 1 << 16):
        counted[s : s + (1 << 16)] = _first_shared(ks[i[s : s + (1 << 16)]], ks[j[s : s + (1 << 16)]]) == key
    i, j = i[counted], j[counted]
    links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
    forest = Forest()
    for a, b in set(zip(rep[i].tolist(), rep[j].tolist(), strict=True)) if len(i) < 4096 else _thin(rep[i], rep[j]):
        forest.join(a, b)
    for k in np.flatnonzero(links).tolist():
        yield int(rep[k]), int(links[k]), forest.find(int(rep[k]))


def _thin(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs that keep what is joined: rounds of least neighbours first, then all pairs not yet joined."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    i, j = at[: len(a)], at[len(a) :]
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    for n, r in zip(nodes.tolist(), nodes[label].tolist(), strict=True):
        if n != r:
            yield n, r


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = COSINE, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", bad), F.lit(True)) & F.exists("embedding", lambda v: v != 0)
    good = rows.where(usable)
    # A class's number is written with it, so that it is the same in all later steps.
    classes = checkpoint(good.distinct().groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    size = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    n, d = size[0], size[1] or 1
    corners, tables = plan(n, d, threshold, tables, probes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for b in batches:
                if b.num_rows:
                    vs = b.column("embedding").to_pylist()
                    ks = keys(matrix(vs, d), corners, tables, probes)
                    yield from ((r, c, len(v), stored(v), k.tolist(), k.tobytes()) for r, c, v, k in zip(b.column("rep").to_pylist(), b.column("copies").to_pylist(), vs, ks, strict=True))

        return emit(made(), HASHED, lambda r: 400 + 16 * tables * probes)

    spread = classes.select("rep", "copies", "embedding").repartition(shuffle_partitions(spark)).mapInArrow(hashed, "rep long, copies long, length int, vector binary, keys array<long>, packed binary")
    spread = checkpoint(spread)
    entered = spread.select("rep", F.explode(F.array_distinct("keys")).alias("key"))
    # Counts are cut from their lineage, so that both sides of the join are dealt anew and a full bucket can be split over tasks.
    shared = checkpoint(entered.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    met = entered.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = met.select("key", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep")
    sent = dealt.join(spread, "rep").select("key", "low", "high", "own", "rep", "copies", "length", "vector", "packed")
    grouped = sent.repartition(shuffle_partitions(spark), "key", "low", "high").sortWithinPartitions("key", "low", "high")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            held: list[tuple] = []
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held and held[0][:3] != r[:3]:
                        if len(held) > 1:
                            yield from _compare(held, d, threshold)
                        held = []
                    held.append(r)
            if len(held) > 1:
                yield from _compare(held, d, threshold)

        return emit(made(), FOUND)

    found = checkpoint(grouped.mapInArrow(compared, "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("rep != root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    told = classes.join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    told = checkpoint(told.select("embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"))
    least = checkpoint(told.groupBy("component").agg(F.min("least").alias("component_id")))
    told = told.join(least, "component").select("embedding", "n_links", "component_id")
    linked = good.join(told, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_polytope_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
