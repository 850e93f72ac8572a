"""How far the sources of a language diverge in their terms: each source from each other, and the terms that each uses most beyond its language.

A language keeps the terms of at least `least_docs` of its documents. A group's share of a term is a smoothed whole number of billionths;
two shares p and q diverge by floor((p - q)**2 / (p + q)). The divergence of two sources is the sum over all kept terms, also over those that
neither has. All of it is exact arithmetic of 64-bit whole numbers.

Sums over terms are split by how many groups have a term. *Heavy* terms (HEAVY groups and more) go to dense tiles: a block of terms by two
blocks of groups as a matrix of shares, filled with what a group without the term has. *Light* terms are not laid out: if no group had any term, each
would add f0 = f(p0, q0), and so does each kept term to begin with. What a group that has a term differs by from f0 against a group that has none depends on the count alone, so
that counts of terms by count stand for the terms; and for two groups that both have a term its posting list, shorter than HEAVY, gives a
correction. The parts add up to the sum over all terms exactly.

Defined results: null text, lang and source are ''; a group without terms is listed, with the shares of none; a language without kept terms has pairs of
value 0 and no terms; a language with one source has no pairs; repeated rows are documents of their own; very long texts are counted whole, in pieces of none
(one text at a time); an empty table gives no rows; columns other than text, lang and source are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_words import ALPHA, BatchWords
from .common import checkpoint, documents, prepare, sliced

#: Documents of its language that a kept term stands in.
LEAST_DOCS = 10
#: Terms of so many groups of a language are dense.
HEAVY = 16
#: Groups of a block and terms of a block, about: a tile's matrices have no more cells.
GROUP_BLOCK, TERM_BLOCK = 64, 256
SCALE = 1_000_000_000
#: Ranks of the part `term`.
TOP = 10
#: Bytes of text that a worker counts at a time.
CHUNK = 4 << 20
#: Groups, counted, whose figures are sent to every task; beyond, they are joined.
SENT_GROUPS = 5_000

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def diverge(p, q):
    """floor((p - q)**2 / (p + q)) of numbers or arrays."""
    return (p - q) * (p - q) // (p + q)


def _counted(b: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, occurrences, documents) of a batch, and a row with the term '' for each group."""
    names = list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True))
    groups = {g: i for i, g in enumerate(dict.fromkeys(names))}
    of = np.array([groups[g] for g in names], np.int64)
    w = BatchWords(b.column("text"), ALPHA)
    size = max(1, len(w.distinct))
    each, n = np.unique(w.row * size + w.code, return_counts=True)  # a document's terms
    key, back = np.unique(of[each // size] * size + each % size, return_inverse=True)
    occurs, docs = np.bincount(back, weights=n, minlength=len(key)).astype(np.int64), np.bincount(back, minlength=len(key))
    langs, sources = pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string())
    g = np.concatenate((key // size, np.arange(len(groups))))
    term = pa.concat_arrays([w.distinct.cast(pa.string()).take(pa.array(key % size)), pa.array([""] * len(groups), pa.string())])
    nothing = np.zeros(len(groups), np.int64)
    columns = [langs.take(pa.array(g)), sources.take(pa.array(g)), term, pa.array(np.concatenate((occurs, nothing))), pa.array(np.concatenate((docs, nothing)).astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, schema=_COUNTS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's texts, CHUNK bytes at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for b in sliced(iter([whole]), most=CHUNK):
            held.append(b)
            size += b.column("text").nbytes + 64 * b.num_rows
            if size >= CHUNK:
                yield _counted(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, size = [], 0
    if held:
        yield _counted(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, total, groups, first) of each kept term that a group has, and a row with the term '' for each group.

    total: its occurrences in the language; groups: how many have it; first: true in one of them. One exchange by (lang, term) serves the sums by group and those by language.
    """
    prepare(docs.sparkSession)
    only = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    own = only.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    told = own.repartition("lang", "term").select(
        "lang", "source", "term", "n", F.sum("n").over(over).alias("total"), F.sum("docs").over(over).alias("in_docs"), F.count("*").over(over).alias("groups"), (F.col("source") == F.min("source").over(over)).alias("first")
    )
    return told.where((F.col("term") == "") | (F.col("in_docs") >= least_docs)).drop("in_docs")


def group_figures(counts: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(lang, source, size, lang_size, kept, light, dense, sources) of each group: occurrences of kept terms in it and in its language, the language's kept,
    light and heavy terms, and its groups."""
    real = F.col("term") != ""
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    lang = counts.groupBy("lang").agg(
        F.sum("n").alias("lang_size"), F.count_if(real & F.col("first")).alias("kept"), F.count_if(real & F.col("first") & (F.col("groups") < heavy)).alias("light"), F.count_if(~real).alias("sources")
    )
    return own.join(lang, "lang").withColumn("dense", F.col("kept") - F.col("light"))


def _share(n, size, kept):
    """A share in billionths; the product is a decimal, as a very frequent term's passes 64 bits."""
    return F.lit(1) + F.expr(f"cast({n} + 2L as decimal(20, 0)) * {SCALE}L div ({size} + 2L * {kept})")


def shares(counts: DataFrame, figures: DataFrame, sent: int = SENT_GROUPS) -> DataFrame:
    """Each row of a kept term with its group's share p, the share p0 of a term that it has not, and its language's share q."""
    few = figures.count() <= sent
    own = figures.select("lang", "source", "size", "lang_size", "kept")
    rows = counts.where("term != ''").join(F.broadcast(own) if few else own, ["lang", "source"])
    return rows.select("lang", "source", "term", "n", "groups", _share("n", "size", "kept").alias("p"), _share("0L", "size", "kept").alias("p0"), _share("total", "lang_size", "kept").alias("q"))


def term_part(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The terms of each group that it uses more than its language does, by divergence, up to a rank."""
    value = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return value.withColumn("rank", place).where(F.col("rank") <= top)


# ---- pairs ----


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of a tile for each two of its groups, one of block i and one of block j (source before other in the order of names).

    Rows: kind 0, a group (p0; n: the kept terms, in one tile of each two blocks); 1, a heavy term's share; 2, n light terms of share p.
    """
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    groups = pdf[pdf["kind"] == 0].sort_values("source")
    names, block, p0 = groups["source"].to_numpy(), groups["block"].to_numpy(), groups["p0"].to_numpy(np.int64)
    kept = int(groups["n"].max()) if len(groups) else 0
    place = {s: k for k, s in enumerate(names)}
    dense = pdf[pdf["kind"] == 1]
    codes, terms = pd.factorize(dense["term"])
    m = np.repeat(p0[:, None], len(terms), axis=1)
    m[dense["source"].map(place).to_numpy(np.int64), codes] = dense["p"].to_numpy(np.int64)
    few = pdf[pdf["kind"] == 2]
    few_at, few_p, few_n = few["source"].map(place).to_numpy(np.int64), few["p"].to_numpy(np.int64), few["n"].to_numpy(np.int64)
    total = np.zeros((len(names), len(names)), np.int64)  # what is found at k of k and another: both directions are added at the end
    for k in range(len(names)):
        f0 = diverge(p0[k], p0)
        if block[k] == i:
            other = np.flatnonzero(block == j) if i != j else np.arange(k + 1, len(names))
            total[k, other] += kept * f0[other]
            if len(terms):  # a heavy term that no group of either block has is not here, and adds f0
                total[k, other] += diverge(m[k][None, :], m[other]).sum(axis=1) - len(terms) * f0[other]
        at = few_at == k
        if at.any():  # terms of group k against those without them
            total[k] += (few_n[at, None] * (diverge(few_p[at, None], p0[None, :]) - f0[None, :])).sum(axis=0)
    first, second = np.triu_indices(len(names), 1)
    wanted = (block[first] == i) & (block[second] == j) | (block[first] == j) & (block[second] == i)
    first, second = first[wanted], second[wanted]
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "a": names[first], "b": names[second], "value": total[first, second] + total[second, first]})


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two groups that both have a light term differ by from the sums of each alone; posting lists of one length are one matrix."""
    for b in batches:
        lists = b.column("posts")
        items, off = lists.flatten(), np.diff(lists.offsets.to_numpy())
        start = np.cumsum(off) - off
        names, p, p0 = items.field("source").dictionary_encode(), items.field("p").to_numpy(), items.field("p0").to_numpy()
        code = names.indices.to_numpy()
        lang = b.column("lang").dictionary_encode()
        lang_of = lang.indices.to_numpy().astype(np.int64)
        n = max(1, len(names.dictionary))
        keys, values = [], []
        for m in np.unique(off).tolist():
            rows = np.flatnonzero(off == m)
            at = start[rows][:, None] + np.arange(m)
            for x in range(m):
                for y in range(x + 1, m):  # in the order of names
                    px, py, x0, y0 = p[at[:, x]], p[at[:, y]], p0[at[:, x]], p0[at[:, y]]
                    keys.append((lang_of[rows] * n + code[at[:, x]]) * n + code[at[:, y]])
                    values.append(diverge(px, py) - diverge(px, y0) - diverge(x0, py) + diverge(x0, y0))
        if not keys:
            continue
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        value = np.zeros(len(key), np.int64)
        np.add.at(value, back, np.concatenate(values))
        take = lambda d, k: d.take(pa.array(k))
        yield pa.RecordBatch.from_arrays([take(lang.dictionary, key // (n * n)), take(names.dictionary, key // n % n), take(names.dictionary, key % n), pa.array(value)], names=["lang", "a", "b", "value"])


def pair_part(rows: DataFrame, figures: DataFrame, heavy: int = HEAVY, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """Each group's divergence from each other one of its language. rows: as `shares` gives them, figures: as `group_figures` does."""
    group_blocks, term_blocks = F.ceil(F.col("sources") / group_block), F.greatest(F.lit(1), F.ceil(F.col("dense") / term_block))
    sizes = figures.select("lang", group_blocks.cast("int").alias("gb"), term_blocks.cast("int").alias("tb")).distinct()
    block = F.pmod(F.xxhash64("source"), F.col("gb")).cast("int")
    none = F.lit("")
    # each language's numbers of blocks: one row a language, so the small side of every join
    groups = figures.join(sizes, "lang").select(
        F.lit(0).alias("kind"), "lang", "source", block.alias("block"), "gb", F.explode(F.sequence(F.lit(0), F.col("tb") - 1)).alias("k"), none.alias("term"), F.lit(1).cast("long").alias("p"),
        F.when(F.col("kept") > 0, _share("0L", "size", "greatest(kept, 1L)")).otherwise(F.lit(1)).alias("p0"), F.col("kept").alias("n"),
    ).withColumn("n", F.when(F.col("k") == 0, F.col("n")).otherwise(F.lit(0)))
    dense = rows.where(F.col("groups") >= heavy).join(sizes, "lang").select(
        F.lit(1).alias("kind"), "lang", "source", block.alias("block"), "gb", F.pmod(F.xxhash64("term"), F.col("tb")).cast("int").alias("k"), "term", "p", "p0", F.lit(1).cast("long").alias("n")
    )
    sparse = rows.where(F.col("groups") < heavy)
    same = sparse.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n")).join(sizes, "lang").select(
        F.lit(2).alias("kind"), "lang", "source", block.alias("block"), "gb", F.pmod(F.xxhash64("p"), F.col("tb")).cast("int").alias("k"), none.alias("term"), "p", "p0", "n"
    )
    other = F.explode(F.sequence(F.lit(0), F.col("gb") - 1)).alias("other")
    laid = groups.unionByName(dense).unionByName(same).select("*", other).select("kind", "lang", "source", "block", "k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "term", "p", "p0", "n")
    tiles = laid.groupBy("lang", "k", "i", "j").applyInPandas(_tile, "lang string, a string, b string, value long")
    posts = sparse.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("posts"))  # fewer than HEAVY
    light = posts.where(F.size("posts") > 1).select("lang", "posts").mapInArrow(_corrections, "lang string, a string, b string, value long")
    summed = tiles.unionByName(light).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return summed.select("lang", ways, "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn("rank", place)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, heavy: int = HEAVY, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences of groups and of their terms."""
    counts = checkpoint(term_counts(docs, text_col, lang_col, source_col, least_docs))
    figures = checkpoint(group_figures(counts, heavy))
    rows = shares(counts, figures)
    return pair_part(rows, figures, heavy, group_block, term_block).unionByName(term_part(rows, top))


def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' groups, audited."""
    return audit(documents(spark, sf_dir))
