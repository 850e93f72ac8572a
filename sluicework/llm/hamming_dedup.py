"""Near-duplicate texts by MinHash and a multi-index Hamming join.

A text's set of word shingles is hashed by `HASHES` functions; of each least hash one byte is
kept. Two signatures differ in about a share (1 - similarity) of their bytes, so a
pair at the similarity asked for differs in more than `distance` bytes with a probability below MISS (far
less the more alike it is); `distance` follows from the similarity.

A signature is cut into so many chunks that of `distance` differing bytes at most one falls into
some chunk (pigeonhole). Each chunk is entered under every choice of one byte left
out, so that every pair within the distance meets under a key. Whole signatures are
compared in two steps: each text with the leader of each of its keys, which joins most of a large group one link a text; then, in
blocks, what shares a key and is not yet joined. Full shingle sets confirm in the same two steps: each text against
the leader it was found by, then the rest of each component in blocks. Tasks hand on forests of links, never pairs.

Texts with equal sets are one class, compared once. Defined results: a text without words, or null, has an
empty set and no links, and is kept; one with fewer words than a shingle is one shingle; a very long text is a set like any other, alone in its block if
need be; a text at the percentage exactly is linked; each row is a document of its own, also where ids or whole rows repeat, and classes have numbers of their own,
so that two texts under one id stay apart; a row without an id is linked like others, gives its component no id, and is kept where
none has one (component_id is then null); columns other than id and text are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents, drop_tables, emit, id_and_text, row_key, shuffle_partitions, sliced
from .components import Forest, components
from .words import BASES, U, Words, mix, span_hashes

#: Words of a shingle, links at this many percent, bytes of a signature, chance to miss a pair just there, members of a block, seed.
SHINGLE, PERCENT, HASHES, MISS, BLOCK, SEED = 3, 85, 64, 1e-4, 512, 5
#: Classes that are streamed past one leader in a task, about; shingles that a block of full sets holds together, about.
STREAM, HEAVIEST = 500, 500_000
#: Classes (a few numbers each) up to which a table of them is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000


@lru_cache(maxsize=4)
def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 63, hashes, dtype=np.uint64) * U(2) + U(1), r.integers(0, 1 << 63, hashes, dtype=np.uint64)


class Sets:
    """Distinct shingles of a batch's texts: `values` from first[i] to first[i + 1] are sorted."""

    def __init__(self, column: pa.Array, shingle: int = SHINGLE):
        w = Words(column, lower=True)
        size = np.diff(w.first)
        n = len(size)
        many = np.where(size >= shingle, size - shingle + 1, (size > 0).astype(np.int64))
        text = np.repeat(np.arange(n), many)
        at = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + w.first[:-1][text]
        end = at + np.minimum(shingle, size[text])
        h = span_hashes(w.hash, BASES[1], at, end) if len(text) else np.empty(0, U)
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1]))) if len(h) else np.empty(0, bool)
        self.values, text = h[fresh], text[fresh]
        self.size = np.bincount(text, minlength=n)
        self.first = np.concatenate(([0], np.cumsum(self.size)))

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each set."""
        total = [np.concatenate((np.zeros(1, U), np.cumsum(mix(self.values * U(b)), dtype=U))) for b in BASES[:2]]
        a, b = (t[self.first[1:]] - t[self.first[:-1]] for t in total)
        return a.view(np.int64), b.view(np.int64)

    def signatures(self, hashes: int = HASHES) -> np.ndarray:
        """One byte of each least hash; rows of empty sets are zero."""
        out = np.zeros((len(self.size), hashes), np.uint8)
        some = np.flatnonzero(self.size)
        if len(some):
            for k, (a, b) in enumerate(zip(*_functions(hashes), strict=True)):
                h = self.values * a + b
                h ^= h >> U(32)
                out[some, k] = mix(np.minimum.reduceat(h * U(0x9E3779B97F4A7C15), self.first[:-1][some])).astype(np.uint8)
        return out


def distance_at(percent: int, hashes: int = HASHES, miss: float = MISS) -> int:
    """Bytes that may differ so that a pair of this similarity is within them but for a chance of `miss` (21 at 85 percent)."""
    p = (1 - percent / 100) * (1 - 1 / 256)
    below = 0.0
    for d in range(hashes + 1):
        below += math.comb(hashes, d) * p**d * (1 - p) ** (hashes - d)
        if 1 - below <= miss:
            return d
    return hashes


def chunks(hashes: int, distance: int) -> list[np.ndarray]:
    """Places of each chunk: so many that `distance` errors leave at most one in some chunk."""
    return np.array_split(np.arange(hashes), max(1, (distance + 2) // 2))


def keys(signatures: np.ndarray, distance: int) -> np.ndarray:
    """n x hashes keys: each chunk with one of its bytes left out."""
    n, hashes = signatures.shape
    out = np.empty((n, hashes), np.int64)
    for c, places in enumerate(chunks(hashes, distance)):
        for left in places:
            rest = [p for p in places if p != left]
            key = np.full(n, (c << 8 | left) + 1, U)
            for p in rest:
                key = mix(key * U(257) + signatures[:, p].astype(U) + U(1))
            out[:, left] = key.view(np.int64)
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("signature", pa.list_(pa.int64()))])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_SENT = pa.schema([("leader", pa.int64()), ("part", pa.int64()), ("first", pa.bool_()), ("rep", pa.int64()), ("shingles", pa.binary())])
_SETS = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])


def signed(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, n_shingles, h1, h2, signature: its bytes as longs) of every row. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        for b in sliced(batches):
            s = Sets(b.column("text"), shingle)
            h1, h2 = s.digests()
            longs = s.signatures().view(np.int64)
            packed = pa.ListArray.from_arrays(pa.array(np.arange(len(longs) + 1, dtype=np.int32) * longs.shape[1]), pa.array(longs.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(s.size.astype(np.int64)), pa.array(h1), pa.array(h2), packed], schema=_SIGNED)

    return docs.withColumn("row", row_key()).mapInArrow(run, "doc_id long, row long, n_shingles long, h1 long, h2 long, signature array<long>")


def bytes_apart(a: Column, b: Column, hashes: int = HASHES) -> Column:
    """In how many bytes two signatures (as longs) differ: each differing byte leaves one bit."""
    total = F.lit(0)
    for i in range(hashes // 8):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for n in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows with equal first `width` values, which come together."""
    held: list[tuple] = []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][:width] != r[:width]:
                if len(held) > 1:
                    yield held
                held = []
            held.append(r)
    if len(held) > 1:
        yield held


def _sides(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Members of the two blocks; rows: (group, low, high, own, label, ...). Within one block those of the commonest label need only be compared with the others."""
    own = np.array([r[3] for r in rows])
    left, right = np.flatnonzero(own == rows[0][1]), np.flatnonzero(own == rows[0][2])
    if rows[0][1] == rows[0][2]:
        common = Counter(r[4] for r in rows).most_common(1)[0][0]
        left = np.array([i for i in left.tolist() if rows[i][4] != common], np.int64)
    return left, right


def _joined(label: list[int], pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(label, root): a forest of the labels whose members are paired."""
    forest = Forest()
    for i, j in pairs:
        if label[i] != label[j]:
            forest.join(label[i], label[j])
    yield from ((x, root) for x in list(forest.up) if (root := forest.find(x)) != x)


def _within(rows: list[tuple], distance: int) -> Iterator[tuple[int, int]]:
    """Links of labels with members whose signatures differ in at most `distance` bytes; rows: (key, low, high, own, label, signature)."""
    label = [r[4] for r in rows]
    left, right = _sides(rows)
    sig = np.array([r[5] for r in rows], np.int64).view(np.uint8).reshape(len(rows), -1)
    other = sig[right]
    return _joined(label, ((i, j) for i in left.tolist() for j in right[(other != sig[i]).sum(1) <= distance].tolist()))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share so many of their items."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(rows: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Links of labels with members whose full sets are alike; rows: (cluster, low, high, own, label, shingles)."""
    label = [r[4] for r in rows]
    sets = [np.frombuffer(r[5], U) for r in rows]
    left, right = _sides(rows)
    if len(rows) <= 3:
        return _joined(label, ((i, j) for i in left.tolist() for j in right.tolist() if label[i] != label[j] and alike(sets[i], sets[j], percent)))
    size = np.array([len(s) for s in sets])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), size)
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    shared = np.zeros((len(rows), len(rows)), np.float32)
    width = 2048
    for w in range(0, int(word[-1]) + 1, width):
        a, z = np.searchsorted(word, [w, w + width])
        m = np.zeros((len(rows), width), np.float32)
        m[owner[a:z], word[a:z] - w] = 1
        live = np.flatnonzero(m.any(1))
        m = m[live]
        shared[np.ix_(live, live)] += m @ m.T
    both = shared[np.ix_(left, right)].astype(np.int64)
    union = size[left][:, None] + size[right][None] - both
    return _joined(label, ((left[i], right[j]) for i, j in zip(*np.nonzero(100 * both >= percent * union), strict=True)))


def _against_leaders(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[int, int]]:
    """(rep, leader) of the members whose set is like their leader's; rows: (leader, part, first, rep, shingles), the leader's own first in each part."""
    at, head = None, None
    for b in batches:
        for leader, part, first, rep, shingles in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if first:
                at, head = (leader, part), np.frombuffer(shingles, U)
            elif at == (leader, part) and alike(head, np.frombuffer(shingles, U), percent):
                yield rep, leader


def _rest(rows: DataFrame, group: str, block: int, weight: Column, heaviest: int, tested: Column, *more: str) -> DataFrame:
    """(group, low, high, own, label, more): members of groups with several labels, at the pairs of blocks where two labels can meet.

    A group that fits one block is one. In others the members of the commonest label, which are joined already, have blocks that meet those of the rest only; the rest's meet each other too.
    Blocks have about `block` members and `heaviest` of weight together. tested: which members' pair with a leader has been looked at before;
    a group whose every pair has is left out.
    """
    by_label = rows.groupBy(group, "label").agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.sum(tested.cast("long")).alias("done"))
    mixed = by_label.groupBy(group).agg(F.count("*").alias("labels"), F.sum("n").alias("all"), F.sum("w").alias("heavy"), F.sum("done").alias("done"), F.max(F.struct("n", "label", "w")).alias("top"))
    cut = lambda n, w: F.ceil(F.greatest(F.lit(1.0), n / block, w / heaviest)).cast("int")
    mixed = mixed.where((F.col("labels") > 1) & (2 * F.col("done") < F.col("all") * (F.col("all") - 1)))
    one = (F.col("all") <= block) & (F.col("heavy") <= heaviest)
    mains, others = cut(F.col("top.n"), F.col("top.w")), cut(F.col("all") - F.col("top.n"), F.col("heavy") - F.col("top.w"))
    mixed = checkpoint(mixed.select(group, F.col("top.label").alias("main"), F.when(one, 1).otherwise(mains).alias("mains"), F.when(one, 0).otherwise(others).alias("others")))
    held = rows.join(mixed, group)
    main = F.col("label") == F.col("main")
    held = held.withColumn("own", F.when(main | (F.col("others") == 0), F.pmod(F.xxhash64("rep"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("rep"), F.nullif(F.col("others"), F.lit(0)))).cast("int"))
    held = held.select("*", F.explode(F.sequence(F.when(main & (F.col("others") > 0), F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)).alias("other"))
    return held.select(group, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "label", "rep", *more)


def _meeting(dealt: DataFrame, group: str, payload: str, compare) -> DataFrame:
    """(u, v): links that `compare` finds among the rows of each pair of blocks."""
    spark = dealt.sparkSession
    grouped = dealt.select(group, "low", "high", "own", "label", payload).repartition(shuffle_partitions(spark), group, "low", "high").sortWithinPartitions(group, "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        return emit((f for g in _groups(batches, 3) for f in compare(g)), _LINKS)

    return checkpoint(grouped.mapInArrow(run, "u long, v long"))


def _labelled(rows: DataFrame, found: DataFrame, name: str = "label") -> DataFrame:
    """rows with their component, or else their own number."""
    return rows.join(found.select(F.col("node").alias("rep"), F.col("component").alias("_of")), "rep", "left").withColumn(name, F.coalesce("_of", "rep")).drop("_of")


def _more(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components of what was found and of links between components."""
    return checkpoint(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))) if links.take(1) else found


def _with_sets(docs: DataFrame, wanted: DataFrame, shingle: int, schema: pa.Schema, kinds: str, rows_of) -> DataFrame:
    """rows_of(the wanted row, its set) of each wanted class; wanted: row, h1, h2 and more; only the text with these digests is read."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    names = wanted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()

        def made():
            for b in sliced(batches):
                s = Sets(b.column("text"), shingle)
                h1, h2 = s.digests()
                for i, r in enumerate(zip(*(b.column(c).to_pylist() for c in names), strict=True)):
                    r = dict(zip(names, r, strict=True))
                    if h1[i] == r["h1"] and h2[i] == r["h2"]:
                        yield from rows_of(r, s.values[s.first[i] : s.first[i + 1]].tobytes())

        return emit(made(), schema, lambda r: len(r[-1]) + 64)

    return docs.withColumn("row", row_key()).join(wanted, "row").select(*names, "text").mapInArrow(run, kinds)


def clusters_of(classes: DataFrame, distance: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rep, leader): pairs within the distance, one a class at most; (node, component): components of all pairs within it. classes: rep, signature.

    Each class is compared with the leader (least number) of each of its keys first, pair by pair. Most of a large group is joined by that alone;
    what is left of a key, classes with different labels, is compared in blocks.
    """

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k = keys(b.column("signature").flatten().to_numpy(zero_copy_only=False).view(np.uint8).reshape(b.num_rows, HASHES), distance)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("rep").to_numpy(), HASHES)), pa.array(k.ravel())], names=["rep", "key"])

    entries = classes.select("rep", "signature").mapInArrow(entered, "rep long, key long")
    # Leaders are cut from their lineage, so that both sides of the join are dealt anew and a key with very many classes can be split over tasks.
    shared = checkpoint(entries.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).where("n > 1").select("key", "leader"))
    met = checkpoint(entries.join(shared, "key").select("key", "rep", "leader"))
    signature = classes.select("rep", "signature")
    pairs = met.where("rep != leader").select("rep", "leader").distinct()
    seen = pairs.join(signature, "rep").join(signature.select(F.col("rep").alias("leader"), F.col("signature").alias("other")), "leader")
    stars = checkpoint(seen.where(bytes_apart(F.col("signature"), F.col("other")) <= distance).groupBy("rep").agg(F.min("leader").alias("leader")))
    found = checkpoint(components(stars.select(F.col("rep").alias("u"), F.col("leader").alias("v"))))
    # An eighth of the keys joins most of what leaders have left, so that few of the others have several labels when it is their turn.
    # Signatures are short: a block of them is four times one of full sets.
    first = F.pmod("key", F.lit(8)) == 0
    for part in (first, ~first):
        left = _rest(_labelled(met.where(part), found), "key", 4 * block, F.lit(1), 4 * block, F.col("rep") != F.col("leader"))
        places = left.groupBy("rep").agg(F.collect_list(F.struct("key", "low", "high", "own", "label")).alias("places"))  # a signature is joined once, not once a key
        left = places.join(signature, "rep").select("signature", F.explode("places").alias("p")).select("p.*", "signature")
        found = _more(found, _meeting(left, "key", "signature", lambda g: _within(g, distance)))
    return stars, found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, distance: int | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row: `row_key`, component: its number, null for empty sets) of every row."""
    distance = distance_at(percent) if distance is None else distance
    docs = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    rows = checkpoint(signed(docs, shingle))
    usable = F.col("n_shingles") > 0
    # A class's number is written with it, so that it is the same in all later steps.
    classes = rows.where(usable).groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("signature").alias("signature"))
    classes = checkpoint(classes.withColumn("rep", F.monotonically_increasing_id()))
    stars, near = clusters_of(classes, distance, block)

    # On full sets: each pair with a leader first, then what is left of each cluster in blocks.
    parts = checkpoint(stars.groupBy("leader").agg(F.ceil(F.count("*") / STREAM).alias("parts")))
    members = stars.join(parts, "leader").select("rep", "leader", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), F.lit(False).alias("first"))
    heads = parts.select(F.col("leader").alias("rep"), "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("first"))
    orders = members.unionByName(heads).groupBy("rep").agg(F.collect_list(F.struct("leader", "part", "first")).alias("orders"))
    wanted = checkpoint(orders.join(classes.select("rep", "row", "h1", "h2"), "rep"))
    sent = _with_sets(docs, wanted, shingle, _SENT, "leader long, part long, first boolean, rep long, shingles binary", lambda r, s: ((o["leader"], o["part"], o["first"], r["rep"], s) for o in r["orders"]))
    sent = sent.repartition(shuffle_partitions(spark), "leader", "part").sortWithinPartitions("leader", "part", F.desc("first"))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        return emit(_against_leaders(batches, percent), _LINKS)

    linked = checkpoint(components(sent.mapInArrow(streamed, "u long, v long")))
    grouped = classes.select("rep", "row", "h1", "h2", "n_shingles").join(near.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    grouped = _labelled(grouped, linked).join(stars.select("rep", F.lit(True).alias("_led")), "rep", "left").withColumn("led", F.col("_led").isNotNull())
    left = checkpoint(_rest(grouped, "cluster", block, F.col("n_shingles"), HEAVIEST, F.col("led"), "row", "h1", "h2"))
    some = checkpoint(left.select("rep", "row", "h1", "h2").distinct())
    sets = _with_sets(docs, some, shingle, _SETS, "rep long, shingles binary", lambda r, s: [(r["rep"], s)])
    found = _more(linked, _meeting(left.drop("row", "h1", "h2").join(sets, "rep"), "cluster", "shingles", lambda g: _confirmed(g, percent)))

    told = _labelled(classes.select("rep", "h1", "h2", "n_shingles", "least"), found, "component")
    least = checkpoint(told.groupBy("component").agg(F.min("least").alias("component_id")))
    told = told.join(least, "component").select("h1", "h2", "n_shingles", "component", "component_id")
    linked = rows.where(usable).join(told, ["h1", "h2", "n_shingles"]).select("doc_id", "n_shingles", "component_id", "row", "component")
    alone = rows.where(~usable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row", F.lit(None).cast("long").alias("component"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "row", "component")


def op5_hamming_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by shared 3-word shingles."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
