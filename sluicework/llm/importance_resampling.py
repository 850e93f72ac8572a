"""Resampling towards a target distribution by importance weights of hashed n-grams.

A text's features are its runs of one to three words; a feature's bucket is the CRC-32 of its bytes. A bucket's gain says how much
likelier the target's texts make it than all documents do; a document's weight is the sum of the gains of its features, and its score
adds Gumbel noise from a hash of its id, so that the highest scores are a draw without replacement in proportion to the
exponential of the weights.

One pass counts buckets (a task hands on one count a bucket), a second one scores each document against the array of
gains, which is of fixed size. The k-th highest key (score descending, id ascending) is found by radix selection: at most
DIGIT_BITS of the key at a time are counted, and only what shares the digits found so far is counted on. No
sort sees a document that is not drawn: those drawn are dealt by ranges, sorted, and ranked by each range's place.

CRC-32 of joined words comes from the words' own: appending n bytes is a linear map of 32 bits, whose tables follow from the polynomial. Each distinct word
of a batch is hashed once.

Defined results: a null or empty text has no features, weight 0 and a score of noise alone; texts of fewer than `min_words` words are
never drawn; a null id counts as an empty one in the noise and stands last among equal scores; repeated rows are documents of their own: of equal keys those
that come first in the table are drawn; very long texts are counted whole; an empty table gives no rows, an empty target gives gains
from its absence; columns other than id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_words import ALNUM, BatchWords
from .common import checkpoint, documents, id_and_text, sliced, table

#: Buckets of features.
BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 3
#: Bits of a key that one round of the selection counts: at most 2**16 counts reach the driver.
DIGIT_BITS = 16
#: Bytes of text that a worker holds as words at a time.
CHUNK = 2 << 20
#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
_LAST = (1 << 63) - 1
_SIGN = -(1 << 63)


# ---- CRC-32 of joined words ----


@lru_cache(maxsize=1)
def _appending() -> tuple[np.ndarray, np.ndarray]:
    """What appending bytes does to a CRC, as four tables of 256 each: of 0 to 63 bytes, and of 64 * 2**j bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    small = []
    for _ in range(65):
        small.append(now)
        now = step[now & 255] ^ (now >> np.uint32(8))
    double = [small.pop()]
    for _ in range(31):
        double.append(_through(double[-1], double[-1]))
    return np.stack(small), np.stack(double)


def _through(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def crc_join(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of A + B from A's, B's and B's length in bytes."""
    small, double = _appending()
    rest, many = length & 63, length >> 6
    x = small[rest, 0, left & 255] ^ small[rest, 1, (left >> 8) & 255] ^ small[rest, 2, (left >> 16) & 255] ^ small[rest, 3, left >> 24]
    for j in range(int(many.max(initial=0)).bit_length()):
        at = np.flatnonzero((many >> j) & 1)
        x[at] = _through(double[j], x[at])
    return x ^ right


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, int]:
    """(buckets of all features, the text of each, words a text) of a column of texts."""
    w = BatchWords(column, ALNUM)
    each = [x.encode() for x in w.distinct.to_pylist()]
    alone = np.fromiter(map(zlib.crc32, each), np.uint32, len(each))[w.code]
    spaced = np.fromiter((zlib.crc32(b" " + x) for x in each), np.uint32, len(each))[w.code]
    length = np.fromiter((len(x) + 1 for x in each), np.int64, len(each))[w.code]
    found, rows = [alone], [w.row]
    run = alone
    for n in range(1, LONGEST):
        run = crc_join(run[: max(0, len(alone) - n)], spaced[n:], length[n:])
        inside = w.row[n:] == w.row[: max(0, len(w.row) - n)]
        found.append(run[inside])
        rows.append(w.row[n:][inside])
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(rows), np.diff(w.first)


# ---- counts, gains and scores ----


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in sliced(batches, most=CHUNK):
            total += np.bincount(features(b.column("text"), buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    only = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return only.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(of_documents: DataFrame, of_target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain in thousandths, `buckets` numbers in all, from (bucket, n) of the documents and of the target."""
    spark = of_documents.sparkSession
    both = of_documents.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(of_target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    each = [(r.bucket, r.s, r.t) for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()]  # as many rows as buckets
    at, s, t = (np.array(c, np.int64) for c in zip(*sorted(each), strict=True))
    assert len(at) == buckets
    up, down = (t + 1).astype(float) * float(s.sum() + buckets), (s + 1).astype(float) * float(t.sum() + buckets)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, most=CHUNK):
            found, row, words = features(b.column("text"), len(gain))
            weight = np.zeros(b.num_rows, np.int64)
            np.add.at(weight, row, gain[found])
            n = np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = 42, id_col: str = "doc_id") -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


# ---- selection by digits of the key ----


def _image(name: str, descending: bool) -> Column:
    """A long's bits, so that unsigned order is the order asked for."""
    bits = F.col(name).bitwiseXOR(F.lit(_SIGN))
    return F.bitwise_not(bits) if descending else bits


def first_keys(rows: DataFrame, key: list[tuple[str, bool]], k: int, digit_bits: int = DIGIT_BITS) -> Column:
    """The condition that the k first rows by `key` (long columns, whether descending; no nulls, no two rows alike) meet, and no other.

    Rounds count one digit of the rows that agree with the digits found; each brings at most 2**digit_bits counts to the driver. Bits on which all rows
    agree take no round.
    """
    if k <= 0:
        return F.lit(False)
    ends = rows.agg(F.count("*"), *(f(c) for c, _ in key for f in (F.min, F.max))).first()
    if ends[0] <= k:
        return F.lit(True)
    before, here, left = F.lit(False), F.lit(True), k
    for i, (name, descending) in enumerate(key):
        image = _image(name, descending)
        shift = (ends[1 + 2 * i] ^ ends[2 + 2 * i]).bit_length() if (ends[1 + 2 * i] ^ ends[2 + 2 * i]) >= 0 else 64
        while shift > 0:
            width = min(digit_bits, shift)
            shift -= width
            digit = F.shiftrightunsigned(image, shift).bitwiseAND(F.lit((1 << width) - 1))
            counts = dict(rows.where(here).groupBy(digit.alias("digit")).count().collect())
            for found in sorted(counts):
                if left <= counts[found]:
                    break
                left -= counts[found]
            before, here = before | (here & (digit < found)), here & (digit == found)
            if left == counts[found]:
                return before | here
    return before | here


def ranked(rows: DataFrame, key: list[tuple[str, bool]], name: str = "rank") -> DataFrame:
    """rows with their place (from 1) in the order of the key: dealt by ranges and sorted once, then each range's rows follow those of the ranges before."""
    order = [F.desc(c) if down else F.asc(c) for c, down in key]
    placed = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())  # as many rows as ranges
    at, starts = 0, []
    for p, n in sizes:
        starts.append((p, at))
        at += n
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    joined = placed.withColumn("_part", part.cast("long")).join(F.broadcast(starts), "_part", "left")  # one row a range
    return joined.select(*rows.columns, (F.col("_before") + within + 1).alias(name))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", digit_bits: int = DIGIT_BITS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null where it is not drawn."""
    found = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    scored = weighed(docs, found, id_col, text_col).withColumn("score", F.col("weight") + noise(seed))
    rows = checkpoint(scored.withColumn("_id", F.coalesce("doc_id", F.lit(_LAST))).withColumn("_tie", F.monotonically_increasing_id()))
    key = [("score", True), ("_id", False), ("_tie", False)]
    able = rows.where(F.col("n_words") >= min_words)
    drawn = (F.col("n_words") >= min_words) & first_keys(able, key, able.count() * percent // 100, digit_bits)
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    return rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(ranked(rows.where(drawn), key).select(*out, "rank"))


def op11_radix_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against the benchmark's texts; five percent are drawn."""
    return resampled(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
