"""Removal of repeated windows of words, by compressed FM-indexes over content-routed shards.

Searching every document in the index of every shard would cost documents times shards. So
windows are routed: each names the least hash among its k-grams, its anchor, and equal
windows name equal anchors. Neighbouring windows with one anchor form a segment. Anchors
that occur once end there. For the rest, distinct segments go to the shard of their anchor; a
shard's FM-index (a wavelet matrix of packed bits over the transform of its
segments) is searched backward by each of its segments, many in lockstep, which
gives how far each match reaches and so the stretches whose every window occurs at least twice. Segments that occur
twice as they are need no search: their count is that of each of their windows, at least. Verdicts return to documents by the segment's digest,
and are reported as intervals of words, too.

Words stand for 64-bit hashes, segments for 128-bit digests. An anchor with very many
distinct segments is cut into blocks, and each block is searched in the index of every block.

Defined results: a null text has no words; texts shorter than a window lose nothing; each row is
a document of its own, whatever its id, so that a repeated row repeats its windows and rows without an id are searched like others; a very long text
is cut into segments like any other; of equal k-grams in a window the first is the anchor; columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator


import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents, drop_tables, emit, id_and_text, row_key, shuffle_partitions, sliced
from .words import BASES, U, Words, span_hashes

#: Words of a window and of a k-gram; words of a shard's index; distinct segments of a block.
WINDOW, GRAM, SHARD_WORDS, BLOCK = 35, 8, 200_000, 512


def gram_of(window: int) -> int:
    """Words of a k-gram: so many that a segment has 62 windows at most, a mask's bits."""
    return min(window, max(GRAM, window - 61))


class Segments:
    """The segments of a batch: their text, first word (in the batch), windows, anchor and digest."""

    def __init__(self, words: Words, window: int = WINDOW):
        n = len(words.hash)
        gram = gram_of(window)
        count = n - window + 1
        size = np.diff(words.first)
        text = np.repeat(np.arange(len(size)), size)
        if count <= 0:
            self.text = self.first = self.windows = np.empty(0, np.int64)
            self.anchor = self.h1 = self.h2 = np.empty(0, np.int64)
            return
        at = np.arange(n - gram + 1)
        g = span_hashes(words.hash, BASES[1], at, at + gram)
        pick = sliding_window_view(g, window - gram + 1).argmin(1) + np.arange(count)
        inside = text[:count] == text[window - 1 :]
        i = np.flatnonzero(inside)
        fresh = np.ones(len(i), bool)
        if len(i):
            fresh[1:] = (pick[i][1:] != pick[i][:-1]) | (np.diff(i) != 1) | (text[i][1:] != text[i][:-1])
        head = np.flatnonzero(fresh)
        self.first = i[head]
        self.windows = np.diff(np.append(head, len(i)))
        self.text = text[self.first]
        self.anchor = g[pick[self.first]].view(np.int64)
        end = self.first + self.windows + window - 1
        self.h1 = span_hashes(words.hash, BASES[1], self.first, end).view(np.int64)
        self.h2 = span_hashes(words.hash, BASES[2], self.first, end).view(np.int64)


class PackedBits:
    """A bit vector in 64-bit words with counts before each: rank in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(U)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words)))).astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        low = self.words[w] & ((U(1) << (i & 63).astype(U)) - U(1))
        return self.before[w].astype(np.int64) + np.bitwise_count(low)


class FMIndex:
    """Backward search over sequences of words (as small integers), of `depth` words at most: suffixes are ordered by so many."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        n = len(text)
        order, rank = np.argsort(text, kind="stable"), text.astype(np.int64)
        step = 1
        while step < depth:
            later = np.zeros(n, np.int64)
            later[:-step] = rank[step:] + 1 if step < n else 0
            pair = rank * (n + symbols + 2) + later
            order = np.argsort(pair, kind="stable")
            s = pair[order]
            new = np.cumsum(np.concatenate(([0], (s[1:] != s[:-1]).astype(np.int64))))
            rank = np.empty(n, np.int64)
            rank[order] = new
            step *= 2
            if new[-1] == n - 1:
                break
        bwt = text[order - 1]  # of the first suffix: the text's last symbol
        self.n = n
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.levels: list[tuple[int, PackedBits, int]] = []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit & 1).astype(np.uint8)
            packed = PackedBits(ones)
            zeros = int(n - ones.sum())
            self.levels.append((bit, packed, zeros))
            bwt = np.concatenate((bwt[ones == 0], bwt[ones == 1]))

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the sequences with one more symbol in front."""
        base = np.zeros(len(low), np.int64)
        for bit, packed, zeros in self.levels:
            one = symbol >> bit & 1 == 1
            lo, hi, b0 = packed.rank(low), packed.rank(high), packed.rank(base)
            low, high, base = np.where(one, zeros + lo, low - lo), np.where(one, zeros + hi, high - hi), np.where(one, zeros + b0, base - b0)
        start = self.before[symbol]
        return start + low - base, start + high - base


def matches(index: FMIndex, words: np.ndarray, first: np.ndarray, windows: np.ndarray, least: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each segment (words[first:], so many windows) the bit mask of the windows that occur at least `least` times.

    Windows are decided from the left. A search runs backward from a window's end: if it dies at
    a word, every window from there back is decided; if it lives, the next search
    takes twice as many windows at once.
    """
    mask = np.zeros(len(first), np.int64)
    s, more = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    live = np.flatnonzero(windows > 0)
    p = first[live] + window
    low, high = np.zeros(len(live), np.int64), np.full(len(live), index.n)
    while len(live):
        p = p - 1
        low, high = index.extend(low, high, words[p])
        dead = high - low < least[live]
        begun = p == first[live] + s[live]
        done = dead | begun
        if done.any():
            k = np.flatnonzero(done)
            who = live[k]
            died = dead[k]
            hit = who[~died]
            mask[hit] |= ((np.int64(1) << (more[hit] + 1)) - 1) << s[hit]
            s[hit] += more[hit] + 1
            more[hit] = 2 * more[hit] + 1
            lone = died & (more[who] == 0)
            s[who[lone]] = p[k][lone] - first[who[lone]] + 1
            more[who[died & ~lone]] = 0
            room = windows[who] - s[who] - 1
            more[who] = np.minimum(more[who], np.maximum(room, 0))
            p[k] = first[who] + s[who] + more[who] + window
            low[k], high[k] = 0, index.n
            stay = np.ones(len(live), bool)
            stay[k[room < 0]] = False
            live, p, low, high = live[stay], p[stay], low[stay], high[stay]
    return mask


_FOUND = pa.schema([("anchor", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("times", pa.int64()), ("row", pa.int64())])
_CONTENT = pa.schema([("anchor", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("times", pa.int64()), ("blocks", pa.int32()), ("content", pa.binary())])
_INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_MASKS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("mask", pa.int64())])


def repeated_segments(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, h1, h2, times, rep, variants): the distinct segments of anchors that occur more than once. docs: row, text.

    times: how often the segment occurs; rep: a row that has it (its `row_key`); variants: distinct segments of the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        for b in sliced(batches):
            seg = Segments(Words(b.column("text")), window)
            ids = b.column("row").to_numpy()
            if not len(seg.first):
                continue
            order = np.lexsort((ids[seg.text], seg.h2, seg.h1))
            h1, h2 = seg.h1[order], seg.h2[order]
            head = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
            times = np.diff(np.append(head, len(order)))
            at = order[head]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seg.anchor[at], seg.h1[at], seg.h2[at], times, ids[seg.text[at]])], schema=_FOUND)

    found = docs.select("row", "text").mapInArrow(run, "anchor long, h1 long, h2 long, times long, row long")
    distinct = checkpoint(found.groupBy("anchor", "h1", "h2").agg(F.sum("times").alias("times"), F.min("row").alias("rep")))
    # Counts by anchor are cut from their lineage, so that both sides of the join are dealt anew and an anchor with very many segments can be split over tasks.
    totals = checkpoint(distinct.groupBy("anchor").agg(F.sum("times").alias("total"), F.count("*").alias("variants")).where("total > 1").select("anchor", "variants"))
    return checkpoint(distinct.join(totals, "anchor"))


def _contents(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of each wanted segment, from the document named for it."""
    lists = wanted.groupBy(F.col("rep").alias("row")).agg(F.collect_list(F.struct("anchor", "h1", "h2", "times", "blocks")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in sliced(batches):
                words = Words(b.column("text"))
                seg = Segments(words, window)
                lists = [{(w["h1"], w["h2"]): w for w in ws} for ws in b.column("wanted").to_pylist()]
                for t, f, n, h1, h2 in zip(seg.text.tolist(), seg.first.tolist(), seg.windows.tolist(), seg.h1.tolist(), seg.h2.tolist(), strict=True):
                    w = lists[t].pop((h1, h2), None)
                    if w is not None:
                        yield w["anchor"], h1, h2, w["times"], w["blocks"], words.hash[f : f + n + window - 1].tobytes()

        return emit(rows(), _CONTENT, lambda r: 600)

    return docs.join(lists, "row").select("text", "wanted").mapInArrow(run, "anchor long, h1 long, h2 long, times long, blocks int, content binary")


def _shard(rows: list[tuple], window: int) -> Iterator[tuple[int, int, int]]:
    """(h1, h2, mask) of the segments that are to be searched; rows: (h1, h2, indexed, searched, content)."""
    lengths = np.array([len(r[4]) // 8 for r in rows])
    hashes = np.frombuffer(b"".join(r[4] for r in rows), U)
    _, words = np.unique(hashes, return_inverse=True)
    words = words.astype(np.int64) + 1
    symbols = int(words.max()) + 1
    first = np.cumsum(lengths) - lengths
    indexed, stream = (np.array([r[k] for r in rows]) for k in (2, 3))
    text = np.zeros(int((lengths[indexed] + 1).sum()), np.int64)  # 0 stands between segments
    keep = np.repeat(indexed, lengths)
    place = np.arange(int(lengths[indexed].sum())) + np.repeat(np.arange(int(indexed.sum())), lengths[indexed])
    text[place] = words[keep]
    if not len(text) or not stream.any():
        return
    index = FMIndex(text, symbols, 2 * window - gram_of(window))  # a segment's words at most
    least = np.where(indexed, 2, 1)[stream]
    masks = matches(index, words, first[stream], lengths[stream] - window + 1, least, window)
    for k, m in zip(np.flatnonzero(stream).tolist(), masks.tolist(), strict=True):
        if m:
            yield rows[k][0], rows[k][1], m


def verdicts(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block: int = BLOCK) -> DataFrame:
    """(h1, h2, mask): which windows of each distinct segment occur elsewhere; -1: all of them. docs: row, text."""
    spark = docs.sparkSession
    segments = repeated_segments(docs, window)
    several = segments.where("variants > 1").withColumn("blocks", F.ceil(F.col("variants") / block).cast("int"))
    contents = _contents(docs, several, window)
    own = F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int")
    once = F.col("times") < 2  # one that occurs twice as it is need not be searched
    there = F.struct(F.col("own").alias("low"), F.col("other").alias("high"), F.lit(True).alias("indexed"), (once & (F.col("own") == F.col("other"))).alias("searched"))
    back = F.struct(F.col("other").alias("low"), F.col("own").alias("high"), F.lit(False).alias("indexed"), F.lit(True).alias("searched"))
    each = contents.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = each.select("anchor", "h1", "h2", "content", "blocks", F.explode(F.when(once & (F.col("own") != F.col("other")), F.array(there, back)).otherwise(F.array(there))).alias("d"))
    grouped = dealt.select("anchor", "d.low", "d.high", "blocks", "h1", "h2", "d.indexed", "d.searched", "content")
    grouped = grouped.repartition(shuffle_partitions(spark), "anchor", "low", "high").sortWithinPartitions("anchor", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()

        def rows():
            held: list[tuple] = []
            size, last = 0, None
            for b in batches:
                for *key, blocks, h1, h2, indexed, searched, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held and key != last[0] and (blocks > 1 or last[1] > 1 or size >= shard_words):
                        yield from _shard(held, window)
                        held, size = [], 0
                    last = (key, blocks)
                    held.append((h1, h2, indexed, searched, content))
                    size += len(content) // 8
            if held:
                yield from _shard(held, window)

        return emit(rows(), _MASKS)

    partial = grouped.mapInArrow(run, "h1 long, h2 long, mask long")
    searched = partial.groupBy("h1", "h2").agg(F.bit_or("mask").alias("mask"))
    return checkpoint(segments.where("times > 1").select("h1", "h2", F.lit(-1).cast("long").alias("mask")).unionByName(searched))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept: the words that stay, joined by a space, intervals: of the words that go, from 0, ends exclusive) of every row,
    and `carried`, a struct of the columns named."""
    carried = F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(0).alias("_"))
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row_key(id_col, text_col).alias("row"), carried.alias("carried"))
    docs = id_and_text(docs, id_col, text_col).select(row_key().alias("row"), "text")
    known = verdicts(docs, window)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        for b in sliced(batches):
            seg = Segments(Words(b.column("text")), window)
            order = np.lexsort((seg.h2, seg.h1, seg.text))
            t, h1, h2 = seg.text[order], seg.h1[order], seg.h2[order]
            head = np.concatenate(([True], (t[1:] != t[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))) if len(t) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(b.column("row").to_numpy()[t[head]]), pa.array(h1[head]), pa.array(h2[head])], names=["row", "h1", "h2"])

    had = docs.mapInArrow(listed, "row long, h1 long, h2 long").join(known, ["h1", "h2"])
    masks = had.groupBy("row").agg(F.collect_list(F.struct("h1", "h2", "mask")).alias("masks"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        for b in sliced(batches):
            words = Words(b.column("text"))
            seg = Segments(words, window)
            lists = [{(m["h1"], m["h2"]): m["mask"] for m in ms or ()} for ms in b.column("masks").to_pylist()]
            cover = np.zeros(len(words.hash) + 1, np.int64)
            for t, f, n, h1, h2 in zip(seg.text.tolist(), seg.first.tolist(), seg.windows.tolist(), seg.h1.tolist(), seg.h2.tolist(), strict=True):
                m = lists[t].get((h1, h2)) if lists[t] else None
                if m == -1:
                    cover[f] += 1
                    cover[f + n + window - 1] -= 1
                elif m:
                    for k in range(n):
                        if m >> k & 1:
                            cover[f + k] += 1
                            cover[f + k + window] -= 1
            stays = np.cumsum(cover[:-1]) == 0
            data, kept, left, intervals = words.data.tobytes(), [], [], []
            for a, z in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                own = stays[a:z]
                edge = np.flatnonzero(np.diff(np.concatenate(([True], own, [True])).astype(np.int8)))
                intervals.append([{"start": i, "end": j} for i, j in edge.reshape(-1, 2).tolist()])
                own = [data[s:e] for s, e in zip(words.start[a:z][own].tolist(), words.end[a:z][own].tolist(), strict=True)]
                left.append(len(own))
                kept.append(b" ".join(own).decode())
            n = np.diff(words.first)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(n - np.array(left, np.int64)), pa.array(kept, pa.string()), pa.array(intervals, _INTERVALS), b.column("carried")], names=["doc_id", "n_words", "n_removed", "kept", "intervals", "carried"])

    kind = held.schema["carried"].dataType.simpleString()
    joined = held.join(masks, "row", "left").select("doc_id", "text", "masks", "carried")
    return joined.mapInArrow(removed, f"doc_id long, n_words long, n_removed long, kept string, intervals array<struct<start:long,end:long>>, carried {kind}")


def op10_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that start anywhere else."""
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
