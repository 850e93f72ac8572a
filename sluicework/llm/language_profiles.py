"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. A letter n-gram is bound: the vectors of its
letters, each permuted by its place, are multiplied. A text bundles (adds)
its n-grams; a language's prototype bundles the normalised texts it is learned from, less what all prototypes share. A text
takes the language of the prototype with the largest cosine, and that cosine is its score (0 at least).

Defined results: a null text, or one without letters, is `und` with score 0; a text of any length is bundled whole; equal texts have equal results, repeated rows each
their own; of equal cosines the language first by name is taken; where nothing can be learned every text is `und`; a row without an id is predicted, may be learned from, and is not held out
(in the query, which learns by id, it is not learned from); columns other than id, text and the language of training rows are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, kept, prepare, sliced

UNKNOWN = "und"
#: Texts a language is learned from at most, about, and texts of all languages together; dimensions; letters of an n-gram; seed.
SAMPLE, TOTAL, DIMENSIONS, LETTERS, SEED = 1500, 20_000, 1024, 3, 20_240
#: Characters, about, that are learned from in all: what bounds the driver where texts are very long.
SAMPLE_CHARS = 64 << 20
#: n-gram vectors that a worker keeps before it starts anew.
KEPT = 12_000


class Vectors:
    """n-gram vectors, made when first met; what they are depends on the letters alone."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = LETTERS):
        self.d, self.n = dimensions, n
        self.letters: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.codes = np.empty(0, np.int64)
        self.rows = np.empty((0, self.d), np.float32)

    def _letter(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            if len(self.letters) > 4_000:
                self.letters.clear()
            self.letters[cp] = np.random.default_rng((SEED, cp)).integers(0, 2, self.d, dtype=np.int8) * 2 - 1
        return self.letters[cp]

    def _bind(self, code: int) -> np.ndarray:
        out = np.ones(self.d, np.int8)
        for place in range(self.n):
            out *= np.roll(self._letter(code >> 21 * place & 0x1FFFFF), place)
        return out

    def get(self, codes: np.ndarray) -> np.ndarray:
        """Rows of sorted distinct codes."""
        at = np.searchsorted(self.codes, codes)
        known = (at < len(self.codes)) & (self.codes[np.minimum(at, max(len(self.codes) - 1, 0))] == codes) if len(self.codes) else np.zeros(len(codes), bool)
        if not known.all():
            if len(self.codes) > KEPT:
                self._clear()
                known = np.zeros(len(codes), bool)
            new = codes[~known]
            where = np.searchsorted(self.codes, new)
            made = np.array([self._bind(c) for c in new.tolist()], np.float32).reshape(-1, self.d)
            self.codes, self.rows = np.insert(self.codes, where, new), np.insert(self.rows, where, made, axis=0)
            at = np.searchsorted(self.codes, codes)
        return self.rows[at]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The normalised bundle of a text's n-grams over its words; null without letters."""
        cps = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32).astype(np.int64)
        letter = _is_letter(cps)
        if not letter.any():
            return None
        cps = np.where(letter, cps, 32)
        cps = np.concatenate(([32], cps, [32]))
        cps = cps[np.concatenate(([True], (cps[1:] != 32) | (cps[:-1] != 32)))]  # one blank between words
        if len(cps) < self.n:
            cps = np.pad(cps, (0, self.n - len(cps)), constant_values=32)
        code = np.zeros(len(cps) - self.n + 1, np.int64)
        for place in range(self.n):
            code |= cps[place : len(cps) - self.n + 1 + place] << 21 * place
        codes, count = np.unique(code, return_counts=True)
        out = np.zeros(self.d, np.float32)
        for i in range(0, len(codes), 4096):
            out += np.sqrt(count[i : i + 4096]).astype(np.float32) @ self.get(codes[i : i + 4096])
        norm = float(np.linalg.norm(out))
        return out / norm if norm else out


_LETTERS: dict[str, np.ndarray] = {}


def _is_letter(cps: np.ndarray) -> np.ndarray:
    if "all" not in _LETTERS:
        _LETTERS["all"] = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTERS["all"][cps]


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # of unit length, without what they share


def learn(texts_by_language: list[tuple[str, str]], vectors: Vectors | None = None) -> Profiles:
    v = vectors or Vectors()
    sums: dict[str, np.ndarray] = {}
    for lang, text in texts_by_language:
        b = v.bundle(text)
        if b is not None:
            sums[lang] = sums.get(lang, 0) + b
    names = sorted(sums)
    p = np.array([sums[n] / max(float(np.linalg.norm(sums[n])), 1e-12) for n in names], np.float32).reshape(len(names), v.d)
    own = p - p.mean(0) if len(names) > 1 else p
    return Profiles(names, own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12) if len(names) else own)


def predict(p: Profiles, v: Vectors, text: str | None) -> tuple[str, float]:
    b = v.bundle(text)
    if b is None or not p.languages:
        return UNKNOWN, 0.0
    cosines = p.prototypes @ b
    k = int(cosines.argmax())
    return p.languages[k], float(min(1.0, max(0.0, cosines[k])))


def remainder(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Profiles:
    """Profiles from about `sample` rows of each language, and TOTAL of all, chosen by a hash of the id; fewer where they would have more than SAMPLE_CHARS characters.

    Of more than TOTAL languages the commonest are learned (ties by name), a text each: the sample is what bounds the languages.
    """
    held = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(1 << 30)).alias("h"))
    found = held.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"), F.min("h").alias("first"))
    stats = found.orderBy(F.desc("n"), "lang").limit(TOTAL).collect()
    if not stats:
        return learn([])
    sample, chars = min(sample, max(1, TOTAL // len(stats))), SAMPLE_CHARS // len(stats)
    # a language's first row by hash always counts, so that none is left out by chance
    shares = [(r.lang, max(r.first + 1, min(1 << 30, int((1 << 30) * min(sample / r.n, chars / max(1, r.size)))))) for r in stats]
    chosen = train.sparkSession.createDataFrame(shares, "lang string, share long")  # TOTAL rows at most
    rows = held.join(F.broadcast(chosen), "lang").where("h < share").select("lang", "text").collect()
    return learn(sorted((r[0], r[1]) for r in rows))


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, and `carried`, a struct of the columns named."""
    prepare(docs.sparkSession)
    sent = SparkContext.getOrCreate().broadcast(profiles)  # languages x dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, v = sent.value, kept("language vectors", Vectors)
        for b in sliced(batches, most=1 << 20):
            made = [predict(p, v, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), b.column("carried")], names=["doc_id", "lang_pred", "score", "carried"])

    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(0).alias("_"))).alias("carried"))
    return held.mapInArrow(run, f"doc_id long, lang_pred string, score double, carried {held.schema['carried'].dataType.simpleString()}")


def op6_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those whose remainder is not 2."""
    docs = documents(spark, sf_dir)
    profiles = fit(docs.where(remainder("doc_id", 4) != 2))
    return identify(docs, profiles).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
