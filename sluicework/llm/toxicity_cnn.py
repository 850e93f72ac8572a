"""A convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the sum of hashed vectors: the word's own, its first letters' and
its last letters'. Filters of several widths run over the words; each filter's
maximum over the text, rectified, feeds a logistic unit. Because a filter is linear
up to the maximum, a word's share in each filter is computed once a worker.

Thresholds are calibrated by language on all labelled rows that the filters were not trained on, counted by score on the
executors; the rows of each class weigh as much as all labelled rows of it, so that the size of the sample does not move a threshold. The language of a text is
guessed from its words (log odds learned from training rows), so that no label, language, source or id is an input of a score;
the score is shifted so that the language's threshold stands at 0.7.

Every sum over a word's or a text's numbers runs in one fixed order and in double precision, so that a score is a function of its text, whatever batch it is in.

Defined results: a null text is empty; an empty text has the score of no words; a very long text is scored whole, its words' shares in one array;
without labels of both kinds every score is 0; an id labelled twice counts once, as toxic if any of its labels is, and null labels are no labels;
repeated rows are scored each; a row without an id is scored, never learned from and not held out; of thresholds with equal F1 the highest is taken, of equally likely languages
the first by name; columns other than id and text (and `lang` of training rows) are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents, emit, id_and_text, kept, table, texts
from .language_profiles import remainder

THRESHOLD = 0.7
#: Labelled rows of each class that the filters are fitted on at most, about; seed of their choice.
SAMPLE_TOXIC, SAMPLE_OTHER, SEED = 2000, 3000, 7
BUCKETS, DIMENSIONS, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 8
EPOCHS, STEPS, BATCH, RATE = 8, 300, 64, 0.1
#: Of so many labelled rows one, by a hash of the id, is never trained on; bins of a logit, and the logit beyond which all is one bin, in the counts by score; rows of each class with which a language has its own threshold.
FOLDS, BINS, FAR, LEAST = 4, 64, 64, 30
#: Words that a worker keeps before it starts anew.
KEPT = 250_000
_PLACES = sum(WIDTHS)


def features(chunk: str) -> list[int]:
    """Buckets of a word's hashed vectors."""
    w = chunk.lower().strip(".,;:!?\"'()[]|*#-")
    if not w:
        return []
    b = f"<{w}>"
    return [zlib.crc32(m.encode()) % BUCKETS for m in (f"={w}", f"^{b[:5]}", f"^{b[:6]}", f"${b[-5:]}")]


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # width x dimensions x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    languages: list[str]
    odds: np.ndarray  # BUCKETS x languages: a whole word's log odds
    cuts: np.ndarray  # by language, as logits


class Words:
    """Shares of words in the filters and languages; index 0 is a blank."""

    def __init__(self, m: Model):
        self.m = m
        self._mix = np.concatenate([f[j] for f in m.filters for j in range(len(f))], axis=1).astype(np.float64)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        n = self._mix.shape[1] + self.m.odds.shape[1]
        self.rows = np.zeros((1024, n))
        self.used = 1

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.at]
        if self.used + len(new) > KEPT:
            self.clear()
            new = list(chunks)
        if not new:
            return
        made = [features(c) for c in new]
        size = np.array([len(f) for f in made])
        flat = np.array([i for f in made for i in f], np.int64)
        vec = np.zeros((len(new), DIMENSIONS))
        odd = np.zeros((len(new), self.m.odds.shape[1]), np.float32)
        some = np.flatnonzero(size)
        if len(some):
            begin = (np.cumsum(size) - size)[some]
            for j in range(int(size.max())):
                more = size[some] > j
                vec[some[more]] += self.m.embedding[flat[begin[more] + j]]
            vec[some] /= np.sqrt(size[some])[:, None]
            whole = [zlib.crc32(f"={new[i].lower().strip('.,;:!?\"\'()[]|*#-')}".encode()) % BUCKETS for i in some]
            odd[some] = self.m.odds[whole]
        need = self.used + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]))])
        self.rows[self.used : need] = np.concatenate([_product(vec, self._mix), odd], axis=1)
        self.at.update(zip(new, range(self.used, need), strict=True))
        self.used = need


def _product(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """x @ weights, each number summed in one order however many rows there are."""
    out = np.zeros((len(x), *weights.shape[1:]))
    for k in range(len(weights)):
        out += np.multiply.outer(x[:, k], weights[k]) if weights.ndim == 1 else x[:, k : k + 1] * weights[k]
    return out


def _layout(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices with blanks behind each text, where each begins, where its words end)."""
    pad = max(WIDTHS) - 1
    flat: list[int] = []
    begin, end = [], []
    for x in lists:
        begin.append(len(flat))
        flat += x or [0]
        end.append(len(flat))
        flat += [0] * pad
    return np.array(flat, np.int64), np.array(begin), np.array(end)


def _bounds(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.stack([begin, end], 1).ravel()


def logits(words: Words, ts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(logit, language) of each text."""
    m = words.m
    if not ts:
        return np.empty(0), np.empty(0, np.int64)
    parts = [t.split() for t in ts]
    words.learn(set().union(*parts))
    at = words.at.__getitem__
    idx, begin, end = _layout([list(map(at, p)) for p in parts])
    cut = _bounds(begin, end)
    pooled, col = [], 0
    n = len(idx) - max(WIDTHS) + 1
    shares = words.rows[:, : len(m.bias) // FILTERS and _PLACES * FILTERS]
    for k, w in enumerate(WIDTHS):
        z = shares[idx[:n], col : col + FILTERS].copy()
        for j in range(1, w):
            z += shares[idx[j : n + j], col + j * FILTERS : col + (j + 1) * FILTERS]
        col += w * FILTERS
        pooled.append(np.maximum(0, np.maximum.reduceat(z, cut[cut < n], axis=0)[::2] + m.bias[k * FILTERS : (k + 1) * FILTERS]))
    out = _product(np.concatenate(pooled, 1), m.out.astype(np.float64)) + m.out_bias
    odds = np.add.reduceat(words.rows[idx[:n], _PLACES * FILTERS :], cut[cut < n], axis=0)[::2]
    return out, odds.argmax(1) if odds.shape[1] else np.zeros(len(ts), np.int64)


def scores(words: Words, ts: list[str]) -> np.ndarray:
    z, lang = logits(words, ts)
    cuts = words.m.cuts
    shift = np.log(THRESHOLD / (1 - THRESHOLD)) - (cuts[lang] if len(cuts) else 0)
    return 1 / (1 + np.exp(-np.clip(z + shift, -40, 40)))


def train(rows: list[tuple[str, str, int]], epochs: int = EPOCHS, calibrated: bool = True) -> Model | None:
    """A model of (text, language or '', label) rows; null without both labels. If calibrated, a quarter of them sets the thresholds instead."""
    if len({y for *_, y in rows}) < 2:
        return None
    rng = np.random.default_rng(SEED)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    fold = (np.arange(len(rows)) % 4 == 3) & calibrated  # calibrates
    at: dict[str, int] = {"": 0}
    docs = [[at.setdefault(c, len(at)) for c in t.split()] for t, *_ in rows]
    made = [features(c) for c in at]
    size = np.maximum(1, np.array([len(f) for f in made]))
    most = max(map(len, made), default=1) or 1
    most = min(most, 40)
    feats = np.full((len(made), most), BUCKETS, np.int64)
    for i, f in enumerate(made):
        feats[i, : min(len(f), most)] = f[:most]
    size = np.minimum(size, most)
    emb = np.concatenate([rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)), np.zeros((1, DIMENSIONS))]).astype(np.float32)
    filters = [rng.normal(0, 0.4, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    n_f = FILTERS * len(WIDTHS)
    bias, out, out_bias = np.zeros(n_f, np.float32), rng.normal(0, 0.3, n_f).astype(np.float32), 0.0
    y = np.array([r[2] for r in rows], np.float32)
    a_emb, a_fil, a_bias, a_out, a_ob = np.full((BUCKETS + 1, 1), 1e-3, np.float32), [np.full_like(f, 1e-2) for f in filters], np.full(n_f, 1e-2, np.float32), np.full(n_f, 1e-2, np.float32), 1e-2
    fit = np.flatnonzero(~fold)
    for _ in range(max(epochs, -(-STEPS * BATCH // max(1, len(fit))))):  # few rows are read more often
        rng.shuffle(fit)
        for s in range(0, len(fit), BATCH):
            b = fit[s : s + BATCH]
            raw, begin, end = _layout([_thinned(docs[i], rng) for i in b])
            uniq, idx = np.unique(raw, return_inverse=True)
            vec = np.zeros((len(uniq), DIMENSIONS), np.float32)
            f = feats[uniq]
            for j in range(most):
                if (f[:, j] < BUCKETS).any():
                    vec += emb[f[:, j]]
            vec /= np.sqrt(size[uniq])[:, None]
            n = len(idx) - max(WIDTHS) + 1
            best, pooled = [], []
            for k, w in enumerate(WIDTHS):
                z = sum((vec @ filters[k][j])[idx[j : n + j]] for j in range(w))
                top = np.array([z[p:q].argmax(0) + p for p, q in zip(begin, end, strict=True)])
                best.append(top)
                pooled.append(np.take_along_axis(z, top, 0) + bias[k * FILTERS : (k + 1) * FILTERS])
            pre = np.concatenate(pooled, 1)
            act = np.maximum(0, pre)
            p = 1 / (1 + np.exp(-np.clip(act @ out + out_bias, -30, 30)))
            g = (p - y[b]) / len(b)
            g_act = g[:, None] * out * (pre > 0)
            for k, w in enumerate(WIDTHS):
                gk = g_act[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    at_words = idx[best[k] + j]  # texts x FILTERS
                    g_fil = np.einsum("bfd,bf->df", vec[at_words], gk)
                    g_vec = gk[:, :, None] * filters[k][j].T[None] / np.sqrt(size[uniq[at_words]])[:, :, None]
                    live = gk.ravel() != 0
                    rows_f = f[at_words.ravel()[live]]
                    gv = g_vec.reshape(-1, DIMENSIONS)[live]
                    flat, held = rows_f.ravel(), np.repeat(gv, most, 0)
                    ok = flat < BUCKETS
                    u, inv = np.unique(flat[ok], return_inverse=True)
                    if len(u):
                        total = np.zeros((len(u), DIMENSIONS), np.float32)
                        np.add.at(total, inv, held[ok])
                        a_emb[u] += (total**2).mean(1, keepdims=True)
                        emb[u] -= RATE * total / np.sqrt(a_emb[u])
                    a_fil[k][j] += g_fil**2
                    filters[k][j] -= 0.5 * RATE * g_fil / np.sqrt(a_fil[k][j])
            g_bias, g_out, g_ob = g_act.sum(0), act.T @ g, float(g.sum())
            a_bias += g_bias**2
            a_out += g_out**2
            a_ob += g_ob**2
            bias -= RATE * g_bias / np.sqrt(a_bias)
            out -= RATE * g_out / np.sqrt(a_out)
            out_bias -= RATE * g_ob / a_ob**0.5
    languages, odds = _language_odds(rows)
    m = Model(emb[:BUCKETS], filters, bias, out, out_bias, languages, odds, np.zeros(max(1, len(languages))))
    if calibrated:
        m.cuts = _calibrate(m, [r for r, c in zip(rows, fold, strict=True) if c])
    return m


def _thinned(words: list[int], rng: np.random.Generator) -> list[int]:
    """A random share of a text's words, so that no word hides what others would teach."""
    if len(words) < 8:
        return words
    keep = rng.random(len(words)) < rng.uniform(0.15, 1)
    return [w for w, k in zip(words, keep, strict=True) if k] or words


def _language_odds(rows: list[tuple[str, str, int]]) -> tuple[list[str], np.ndarray]:
    """Log odds of the training rows' words by language."""
    languages = sorted({lang for _, lang, _ in rows if lang})
    counts = np.full((BUCKETS, len(languages)), 0.05, np.float32)
    for k, lang in enumerate(languages):
        c = Counter(w for t, g, _ in rows if g == lang for w in {x.lower().strip(".,;:!?\"'()[]|*#-") for x in t.split()})
        for w, n in c.items():
            counts[zlib.crc32(f"={w}".encode()) % BUCKETS, k] += n
    logs = np.log(counts / counts.sum(0, keepdims=True)) if languages else counts
    return languages, (logs - logs.mean(1, keepdims=True)).astype(np.float32) if languages else logs


def _calibrate(m: Model, rows: list[tuple[str, str, int]]) -> np.ndarray:
    """By language, the logit with the best F1 on held rows, in the middle of its gap; languages with few rows take that of all."""
    words = Words(m)
    zs, langs = zip(*(logits(words, [r[0] for r in rows[i : i + 256]]) for i in range(0, len(rows), 256)), strict=True)
    z, lang, y = np.concatenate(zs), np.concatenate(langs), np.array([r[2] for r in rows])

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-z)
        z, y = z[order], y[order]
        hit = np.cumsum(y)
        f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
        k = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[0])
        return float((z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - 1)) / 2)

    overall = best(z, y)
    return np.array([best(z[at], y[at]) if (at := lang == k).any() and min(y[at].sum(), (1 - y[at]).sum()) >= 30 else overall for k in range(max(1, len(m.languages)))])


def _marked(labels: DataFrame, toxic: int, other: int) -> DataFrame | None:
    """(doc_id, y, chosen, held) of the labelled rows: about `toxic` and `other` are chosen, one in FOLDS is held; null without both labels. labels: doc_id, toxic."""
    marked = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("y")).where("doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r[0]: r[1] for r in marked.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("y") == 1, min(1 << 30, int((1 << 30) * toxic / counts[1]))).otherwise(min(1 << 30, int((1 << 30) * other / counts[0])))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < share
    return marked.select("doc_id", "y", chosen.alias("chosen"), (F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS)) == 0).alias("held"))


def _learned(docs: DataFrame, marked: DataFrame | None) -> tuple[Model | None, DataFrame | None]:
    """A model without thresholds of the chosen rows that are not held, and (doc_id, y, held) of all labelled rows, held meaning not trained on."""
    if marked is None:
        return None, None
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    chosen = marked.where("chosen")
    if chosen.count() <= 4 * (SAMPLE_TOXIC + SAMPLE_OTHER):  # about toxic + other rows; beyond, the join decides by itself
        chosen = F.broadcast(chosen)
    rows = named.join(chosen, "doc_id").select("text", "lang", "y", "held").collect()
    used = [r for r in rows if not r[3]]
    few = len({r[2] for r in used}) < 2  # so few that all are trained on, and set the thresholds too
    model = train(sorted((r[0], r[1], r[2]) for r in (rows if few else used)), calibrated=False)
    return model, marked.select("doc_id", "y", (F.lit(few) | F.col("held") | ~F.col("chosen")).alias("held"))


def _cuts(found: DataFrame, marked: DataFrame, languages: int) -> np.ndarray:
    """By language, the logit with the best F1 of all labelled rows not trained on; languages with few rows take that of all. found: doc_id, z, language."""
    kept_in = F.least(F.greatest(F.floor(F.col("z") * BINS), F.lit(-FAR * BINS)), F.lit(FAR * BINS))
    counts = found.join(marked, "doc_id").groupBy("language", kept_in.alias("bin"), "y", "held").agg(F.count("*").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi")).collect()  # 4 rows a language and bin at most
    every, out = np.zeros(2), np.zeros(2)
    for r in counts:
        every[r.y] += r.n
        out[r.y] += r.n * r.held
    rows = [r for r in counts if r.held]
    weight = every / np.maximum(out, 1)

    def best(rows: list) -> float:
        bins: dict[int, list] = {}
        for r in rows:
            b = bins.setdefault(r.bin, [r.lo, r.hi, 0.0, 0.0])
            b[0], b[1] = min(b[0], r.lo), max(b[1], r.hi)
            b[2 + r.y] += r.n * weight[r.y]
        lo, hi, n0, n1 = np.array([b for _, b in sorted(bins.items(), reverse=True)]).T
        f1 = 2 * np.cumsum(n1) / (np.cumsum(n0 + n1) + n1.sum())
        k = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[0])
        return float((lo[k] + (hi[k + 1] if k + 1 < len(lo) else lo[k] - 1)) / 2)

    overall = best(rows) if out.all() else 0.0
    cuts = np.full(max(1, languages), overall)
    for k in range(languages):
        own = [r for r in rows if r.language == k]
        if all(sum(r.n for r in own if r.y == y) >= LEAST for y in (0, 1)):
            cuts[k] = best(own)
    return cuts


def fit(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, other: int = SAMPLE_OTHER) -> Model | None:
    """A model: filters of about `toxic` and `other` labelled rows at most, chosen by a hash of the id, thresholds of all others. labels: doc_id, toxic."""
    model, marked = _learned(docs, _marked(labels, toxic, other))
    if model is not None:
        named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(marked.select("doc_id"), "doc_id")
        model.cuts = _cuts(found(named, model), marked, len(model.languages))
    return model


OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("z", pa.float64()), ("language", pa.int32())])


def _told(docs: DataFrame, model: Model | None, tell, schema: pa.Schema, kinds: str) -> DataFrame:
    """tell(words or None, texts) gives the columns beside doc_id. docs: doc_id, text."""
    name = uuid.uuid4().hex  # of this model, for the workers' tables
    sent = SparkContext.getOrCreate().broadcast(model)  # BUCKETS x (DIMENSIONS + languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        words = kept(("toxicity", name), lambda: Words(m)) if m is not None else None

        def rows():
            for ids, ts in texts(batches):
                for i in range(0, len(ids), 200):
                    yield from zip(ids[i : i + 200], *tell(words, ts[i : i + 200]), strict=True)

        return emit(rows(), schema)

    return docs.mapInArrow(run, kinds)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    return _told(id_and_text(docs, id_col, text_col), model, lambda words, part: [scores(words, part).tolist() if words else [0.0] * len(part)], OUT, "doc_id long, score double")


def found(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, z, language) of every row: the logit before thresholds, and the number of the language guessed."""
    return _told(id_and_text(docs, id_col, text_col), model, lambda words, part: [x.tolist() for x in logits(words, part)], FOUND, "doc_id long, z double, language int")


def op2_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels whose remainder is not 1; texts are gone through once, for thresholds and scores alike."""
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model, marked = _learned(docs, _marked(labels.where(remainder("doc_id", 3) != 1), SAMPLE_TOXIC, SAMPLE_OTHER))
    if model is None:
        scored = score(docs, None)
    else:
        seen = checkpoint(found(docs, model))
        shift = [float(np.log(THRESHOLD / (1 - THRESHOLD)) - c) for c in _cuts(seen, marked, len(model.languages))]
        z = F.col("z") + F.element_at(F.array(*map(F.lit, shift)), F.col("language") + 1)
        scored = seen.select("doc_id", (1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))))).alias("score"))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
