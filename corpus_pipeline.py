"""A training corpus from raw documents: five stages, each by one operator of the llm package.

Each stage takes all documents that the one before kept. All but the last
return the columns of `documents`; the last gives each piece's place in a sequence. Stages read only the columns of
`documents`, so that others, whatever their names, do no harm; an empty table passes through all of them. What each makes of nulls,
empty and very long texts, ties and repeated rows is said with it; whole texts are read however long they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm import fm_dedup, hamming_dedup, language_profiles, pattern_packing, secret_scan
from sluicework.llm.common import checkpoint, documents, row_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle and percent of similarity of near duplicates here.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, however short; profiles are learned from those that name theirs.

    A text that is null, empty or without letters has no language and goes. Of equally near languages the first by name is taken; repeated rows and
    rows without an id are told like others. Where no document names a language, none is known and all go.
    """
    profiles = language_profiles.fit(docs)
    told = language_profiles.identify(docs, profiles, carry=COLUMNS)
    return told.where(F.col("lang_pred") != language_profiles.UNKNOWN).select("carried.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, with the least id; rows without an id come last, ties go by a hash of the row.

    Rows whose text is null or has no words stay as they are. Of rows that are the same in id and text one stays. Two texts under one id are two documents.
    """
    found = hamming_dedup.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT).select("doc_id", "row", "component")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    winners = found.where("component is not null").groupBy("component").agg(first.alias("w")).select("w.row")
    named = docs.select(*COLUMNS, row_key().alias("row"))
    blank = found.where("component is null").select("row").distinct()
    return named.join(checkpoint(winners.unionByName(blank)), "row").dropDuplicates(["row"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; one that is nothing else goes.

    Texts that lose nothing stay as they are, null and empty ones too. Each row is a document of its own: what two rows share goes from both,
    whatever their ids, so that rows which are the same throughout go (near_dedup leaves one of them).
    """
    made = fm_dedup.remove_repeats(docs, carry=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("carried.text"))
    left = made.where("n_removed = 0 or n_removed < n_words")
    return left.select("carried.doc_id", text.alias("text"), "carried.lang", "carried.source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("carried.n_chars")).alias("n_chars"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; overlapping ones by one. Null texts stay null, empty ones empty, repeated rows are marked each."""
    letters = secret_scan.letter_pairs(docs)
    found = secret_scan.limits(secret_scan.scan(docs, letters=letters))
    seen = secret_scan.spans(secret_scan.scan(docs, carry=COLUMNS, letters=letters), found)
    text = secret_scan.redacted(F.col("carried.text"), F.col("spans"))
    hit = F.size("spans") > 0
    return seen.select("carried.doc_id", text.alias("text"), "carried.lang", "carried.source", F.when(hit, F.length(text).cast("long")).otherwise(F.col("carried.n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in a sequence. A null or empty text is one token; repeated rows are packed each; ties in length go by a hash."""
    return pattern_packing.pack(checkpoint(pattern_packing.pieces(docs)))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secrets", secrets), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; lineage is cut between them."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
