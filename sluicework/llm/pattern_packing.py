"""Packing of documents into sequences by non-negative least squares over length patterns.

1. Every document becomes token ids (a word table: a word's ids do not depend on
   its neighbours, so each distinct word is tokenized once a worker) and a
   closing id; longer ones are cut at the limit.
2. The histogram of piece lengths, at most `limit` rows, goes to the driver. Patterns of up
   to three bins of lengths that fill a sequence are enumerated; an active-set
   solver fits their repeat counts to the histogram; the counts are rounded down and
   turned into exact lengths, the last part of a pattern by best fit.
3. What remains is packed by best-fit decreasing on the histogram, first into
   the gaps that the patterns left.
4. A piece's rank among those of its length, found by salted counts, names its slot.

The driver's work and what tasks are sent depend on the limit, not on the input.
Defined results: null and empty texts are one closing id; a very long text is cut into pieces of the limit and one shorter one; each row is a document of its own,
repeated or not, with an id or without; pieces of one length are interchangeable, and which of them takes which slot goes by their rank within a salt;
an empty table gives no rows; columns other than id and text are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, documents, emit, id_and_text, kept, texts

LIMIT, CLOSE_ID, BINS = 2048, 0, 256
#: Tokens that a pattern's repeats may leave empty; what fits worse is packed with the rest.
SLACK = 0
#: Words that a worker's table holds before it starts anew; bounds memory, not what is tokenized.
TABLE_WORDS = 900_000
#: Rows of one length that share a salt, about.
SALT_ROWS = 50_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTable:
    """Ids of texts, exact for a tokenizer that drops white space and never joins across it."""

    def __init__(self, path: str, most: int = TABLE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk, self.most = Tokenizer.from_file(path), most
        vocab = self.tk.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.size, self.ids = np.empty(1024, np.int64), np.empty(1024, np.int64), np.empty(4096, np.int32)
        self.words = self.used = 0
        self.add([" "], np.array([1]), np.array([CLOSE_ID]))  # no chunk holds a space

    def add(self, words: list[str], size: np.ndarray, flat: np.ndarray) -> None:
        """Words with their numbers of ids, and the ids of all."""
        n, m = self.words + len(words), self.used + len(flat)
        if n > len(self.start):
            self.start, self.size = (np.concatenate([a, np.empty(n, a.dtype)]) for a in (self.start, self.size))
        if m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(m, np.int32)])
        self.at.update(zip(words, range(self.words, n), strict=True))
        self.size[self.words : n], self.ids[self.used : m] = size, flat
        self.start[self.words : n] = self.used + np.cumsum(size) - size
        self.words, self.used = n, m

    def expand(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in order, where each begins, and the end)."""
        n = self.size[codes]
        total = np.concatenate(([0], np.cumsum(n)))
        return self.ids[np.repeat(self.start[codes] - total[:-1], n) + np.arange(total[-1])], total

    def learn(self, chunks: set[str]) -> None:
        if self.words + 2 * len(chunks) > self.most:
            self.clear()
        new = [c for c in chunks if c not in self.at]
        # a word and the stops behind it are tokenized apart, so that they share entries
        cores = {c: k for c in new if (k := c.rstrip(_STOPS)) != c and k[-1:].isalnum()}
        alone = {*(c for c in new if c not in cores), *(x for c, k in cores.items() for x in (k, c[len(k) :]) if x not in self.at)}
        plain = [c for c in alone if _PLAIN.fullmatch(c)]
        self._plain(plain)
        others = list(alone.difference(plain))
        made = [e.ids for e in self.tk.encode_batch_fast(others, add_special_tokens=False)]
        self.add(others, np.fromiter(map(len, made), np.int64, len(made)), np.fromiter(chain.from_iterable(made), np.int32))
        pairs = np.fromiter((self.at[x] for c, k in cores.items() for x in (k, c[len(k) :])), np.int64, 2 * len(cores))
        flat, total = self.expand(pairs)
        self.add(list(cores), np.diff(total[::2]), flat)

    def _plain(self, words: list[str]) -> None:
        """Words of letters alone, many in one text: each is one word of the tokenizer's, and ends where an id closes a word."""
        step = 256
        made = [e.ids for e in self.tk.encode_batch_fast([" ".join(words[i : i + step]) for i in range(0, len(words), step)], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(made), np.int32)
        last = np.flatnonzero(self.ends[flat])
        self.add(words, np.diff(last, prepend=-1), flat)

    def batch(self, ts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with a closing id each, where each text ends)."""
        parts = [(t.lower() if _latin(t) else t).replace("\n", " ").split(" ") for t in ts]
        self.learn(set().union(*parts))
        at = self.at.__getitem__
        codes = array("q")
        ends = np.empty(len(ts), np.int64)
        for k, p in enumerate(parts):
            codes.extend(map(at, p))
            codes.append(0)
            ends[k] = len(codes)
        flat, total = self.expand(np.frombuffer(codes, np.int64))
        return flat.astype("<u4"), total[ends]


#: Marks that a run of letters or digits ends at, in this tokenizer's split; an apostrophe may belong to what follows it.
_STOPS = ".,;:!?*#%&$"
#: Lower-case letters of Latin-1.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _latin(t: str) -> bool:
    """Whether Python's lower-casing is the tokenizer's own and makes no special string, so that forms of a word may share an entry."""
    if "<|" in t:
        return False
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(("words", path), lambda: WordTable(path))

        def rows():
            for ids, ts in texts(batches):
                flat, ends = table.batch(ts)
                begin = 0
                for i, end in zip(ids, ends.tolist(), strict=True):
                    for k, at in enumerate(range(begin, end, limit)):
                        part = flat[at : min(at + limit, end)]
                        yield i, k, at - begin, len(part), zlib.crc32(part)
                    begin = end

        return emit(rows(), PIECES)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(bins: int) -> np.ndarray:
    """All ways to fill `bins` with one to three parts, largest first, as a (bins + 1) x n matrix of counts."""
    cols = [(bins,)] + [(a, bins - a) for a in range(bins - 1, (bins - 1) // 2, -1) if bins - a <= a]
    cols += [(a, b, bins - a - b) for a in range(bins - 2, 0, -1) for b in range(min(a, bins - a - 1), 0, -1) if 1 <= bins - a - b <= b]
    m = np.zeros((bins + 1, len(cols)))
    for j, c in enumerate(cols):
        for b in c:
            m[b, j] += 1
    return m


def nnls(a: np.ndarray, y: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - y|, by an active set."""
    n = a.shape[1]
    gram_y, x, free = a.T @ y, np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(gram_y).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        grad = gram_y - a.T @ (a[:, free] @ x[free])
        grad[free] = -np.inf
        j = int(grad.argmax())
        if grad[j] <= tol:
            break
        free[j] = True
        while True:
            k = np.flatnonzero(free)
            sub = a[:, k]
            z = np.linalg.solve(sub.T @ sub + 1e-10 * np.eye(len(k)), gram_y[k])
            if z.min() > 0:
                x[:] = 0
                x[k] = z
                break
            low = z <= 0
            step = np.min(x[k][low] / np.maximum(x[k][low] - z[low], 1e-300))
            x[k] += step * (z - x[k])
            drop = k[low & (x[k] <= 1e-12)]
            free[drop if len(drop) else k[z.argmin()]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def plan(histogram: dict[int, int], limit: int = LIMIT, bins: int = BINS) -> list[tuple[tuple[int, ...], int]]:
    """Groups (lengths in order, repeats) that use each piece of the histogram exactly once."""
    left = np.zeros(limit + 1, np.int64)
    for n, c in histogram.items():
        left[n] += c
    groups: list[tuple[tuple[int, ...], int]] = []
    if left[limit]:
        groups.append(((limit,), int(left[limit])))
        left[limit] = 0
    bins = min(bins, limit)
    width = -(-limit // bins)
    of = -(-np.arange(limit + 1) // width)
    full = -(-limit // width)
    a = patterns(full)
    x = np.floor(nnls(a, np.bincount(of, weights=left, minlength=full + 1)[: full + 1]) + 1e-9).astype(np.int64)
    for j in sorted(np.flatnonzero(x), key=lambda j: -int(np.flatnonzero(a[:, j])[-1])):
        parts = [b for b in range(full, 0, -1) for _ in range(int(a[b, j]))]
        want = int(x[j])
        while want and (chosen := _choose(left, parts, width, limit)):
            times = min([want, *(int(left[n]) // chosen.count(n) for n in chosen)])
            for n in chosen:
                left[n] -= times
            groups.append((tuple(chosen), times))
            want -= times
    return _fill(left, groups, limit)


def _choose(left: np.ndarray, parts: list[int], width: int, limit: int) -> list[int]:
    """Lengths that are left, one from each bin, the last by best fit, with a gap of at most SLACK; empty if there are none."""

    def search(chosen: list[int], i: int) -> list[int]:
        room, last = limit - sum(chosen), i == len(parts) - 1
        low, high = (parts[i] - 1) * width + 1, min(parts[i] * width, room)
        if last:
            low, high = max(1, room - SLACK), room
        for n in range(high, low - 1, -1):
            if left[n] > chosen.count(n) and (found := [*chosen, n] if last else search([*chosen, n], i + 1)):
                return found
        return []

    return search([], 0)


def _fill(left: np.ndarray, groups: list[tuple[tuple[int, ...], int]], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of what is left, into the gaps of the groups first."""
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for lengths, n in groups:
        gaps.setdefault(limit - sum(lengths), []).append((lengths, n))
    for length in range(limit, 0, -1):
        count = int(left[length])
        while count:
            room = min((g for g in gaps if g >= length), default=None)
            if room is None:
                each = limit // length
                if count >= each:
                    put, n = (length,) * each, count // each
                else:
                    put, n = (length,) * count, 1
                gaps.setdefault(limit - length * len(put), []).append((put, n))
                count -= n * len(put)
                continue
            lengths, n = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
            if n > count:
                gaps.setdefault(room, []).append((lengths, n - count))
                n = count
            gaps.setdefault(room - length, []).append(((*lengths, length), n))
            count -= n
    return [g for held in gaps.values() for g in held]


def slots(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank of each run of slots, its sequence for rank 0, its offset)."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for lengths, n in groups:
        at = 0
        for length in lengths:
            runs.setdefault(length, []).append((n, base, at))
            at += length
        base += n
    out = {}
    for length, held in runs.items():
        n, first, offset = (np.array(c, np.int64) for c in zip(*held, strict=True))
        rank = np.cumsum(n) - n
        out[length] = (rank, first - rank, offset)
    return out


def pack(made: DataFrame, limit: int = LIMIT, bins: int = BINS) -> DataFrame:
    """made (as `pieces` gives it, read several times: checkpoint it) with sequence_id and offset."""
    histogram = {r[0]: r[1] for r in made.groupBy("length").count().collect()}  # at most `limit` rows
    where = slots(plan(histogram, limit, bins))
    salts = max(64, sum(histogram.values()) // SALT_ROWS)
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own).cast("long") - 1)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    placed = ranked.join(bases, ["length", "salt"]).select(*PIECES.names, (F.col("rank") + F.col("base")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, base, off = where[n]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = base[k] + rank[at], off[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in PIECES.names), pa.array(sequence), pa.array(offset)], names=[*PIECES.names, "sequence_id", "offset"])

    return placed.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most LIMIT tokens."""
    return pack(checkpoint(pieces(documents(spark, sf_dir))))
