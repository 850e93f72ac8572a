"""Resampling, archives and the divergence audit against brute force, round trips and SQL."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from sluicework.llm import divergence_audit, importance_resampling, oracles, registry, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "word", "Ärger İst ß", "x" * 200_000, "a b c " * 3_000, "Tab\tand\nline\r\n\x00end", "日本 語 123 4a", "…—", "A-b_c 9"]


def texts(n, seed=0, words=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgéñ") for _ in range(r.randint(1, 7))) for _ in range(60)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, words))) for _ in range(n)]


@pytest.mark.parametrize("name", ["op11_radix_importance_resampling", "op12_splittable_warc", "op13_source_divergence_audit"])
def test_query_agrees_with_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    told, df = c.sql(oracles.ORACLE[name]), registry.QUERIES[name](spark, sf_dir)
    assert sorted(map(str, df.select(*sorted(df.columns)).collect())) == sorted(map(str, spark.createDataFrame(told.fetchall(), df.select(*told.columns).schema).select(*sorted(df.columns)).collect()))


# ---- resampling ----


def test_joined_crc_is_that_of_joined_bytes():
    r = random.Random(1)
    pairs = [(r.randbytes(r.choice((0, 1, 5, 63, 64, 65, 5000))), r.randbytes(r.choice((0, 1, 2, 63, 64, 127, 128, 4097, 100_003)))) for _ in range(200)]
    left, right = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    got = importance_resampling.crc_join(left, right, np.array([len(p[1]) for p in pairs], np.int64))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def plain_features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resampling(docs, target):
    own, aim = Counter(f for _, t in docs for f in plain_features(t)[1]), Counter(f for t in target for f in plain_features(t)[1])
    s, t = sum(own.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((own[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in docs:
        n, f = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    drawn = able[: len(able) * 5 // 100]
    return sorted(map(repr, (r[:5] for r in out))), [(r[0], r[4]) for r in drawn]


@pytest.mark.parametrize("digit_bits", [3, 16])
def test_resampling_agrees_with_brute_force(spark, digit_bits):
    docs = [(i - 40, t) for i, t in enumerate(texts(400, 3) + ODD)] + [(None, t) for t in texts(20, 4)] + [(7, texts(400, 3)[47])] * 30
    target = texts(20, 5) + [None, ""]
    df = spark.createDataFrame([(*d, "1", 2.0) for d in docs], "doc_id long, text string, bucket string, rank double").repartition(5)
    got = importance_resampling.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), digit_bits=digit_bits).collect()
    rows, drawn = plain_resampling(docs, target)
    assert sorted(repr([r.doc_id, r.n_words, r.n_features, r.weight, r.score]) for r in got) == rows
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_selection_finds_the_first_keys_whatever_their_digits(spark):
    r = random.Random(2)
    values = [(r.choice((-(1 << 63), -5, 0, 3, (1 << 63) - 1, r.randint(-9, 9))), r.randint(-3, 3), i) for i in range(300)]
    df = spark.createDataFrame(values, "a long, b long, c long")
    key = [("a", True), ("b", False), ("c", False)]
    order = sorted(values, key=lambda v: (-v[0], v[1], v[2]))
    for k in (0, 1, 17, 150, 299, 300, 400):
        assert {tuple(x) for x in df.where(importance_resampling.first_keys(df, key, k, 5)).collect()} == set(order[:k])
    assert [x["c"] for x in importance_resampling.ranked(df.repartition(3), key).orderBy("rank").collect()] == [v[2] for v in order]


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance_resampling.resampled(none, none).collect() == []
    assert len(importance_resampling.resampled(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none).collect()) == 1


# ---- archives ----


def written(spark, folder, rows):
    warc.register(spark)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, file string").repartition(3)
    warc.with_revisits(df).write.format("warc").mode("append").save(str(folder))
    return df


PAGES = [(i, f"http://h/{i}", t, "x", None) for i, t in enumerate([*ODD, *ODD, *texts(60, 8, 400)])] + [(None, None, "word", None, None), (None, "a\r\nb: é", "lone", None, None), (5, "u", "again", None, None), (5, "u", "again", None, None)]


def plain_records(rows):
    by = {}
    for i, _, t, *_ in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for i, _, t, *_ in rows:
        body = (t or "").encode()
        last = max((x for x in by[t or ""] if x is not None), default=None)
        out.append((f"urn:page:{i}" if i is not None else None, "response" if i == last else "revisit", None if i == last else f"urn:page:{last}", len(body), warc.digest(body)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("split", [1 << 26, 4096, 333])
def test_archives_come_back_whole_from_any_split(spark, tmp_path, split):
    written(spark, tmp_path / "w", PAGES)
    back = spark.read.format("warc").option("splitBytes", split).load(str(tmp_path / "w"))
    got = back.collect()
    assert sorted(repr((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest)) for r in got) == plain_records(PAGES)
    assert all(r.payload is None if r.record_type == "revisit" else hashlib.sha1(r.payload).digest() and len(r.payload) == r.payload_bytes for r in got)
    assert {r.target_uri for r in got if r.record_id is None} == {None, "a%0D%0Ab: é"}


def test_any_gzip_reader_opens_the_archives(spark, tmp_path):
    written(spark, tmp_path / "w", PAGES)
    assert sum(gzip.open(p).read().count(b"WARC/1.1\r\nWARC-Type: ") for p in (tmp_path / "w").glob("*.gz")) == len(PAGES)


def by_ranges(path, split):
    size = Path(path).stat().st_size
    return [r for at in range(0, size, split) for r in warc.records(str(path), at, min(at + split, size))]


def test_archives_within_payloads_are_no_records(tmp_path):
    inner = b"".join(warc.member(warc.encoded(f"in:{i}", "response", None, None, b"hidden"), b"T" * 16) for i in range(5))
    outer = [warc.encoded(f"out:{i}", "response", None, None, random.Random(i).randbytes(3000) + inner) for i in range(20)]
    own, foreign = tmp_path / "own.warc.gz", tmp_path / "foreign.warc.gz"
    own.write_bytes(b"".join(warc.member(x, b"U" * 16) for x in outer))
    foreign.write_bytes(b"".join(gzip.compress(x) for x in outer))
    for split in (100, 777, 1 << 20):
        assert [r[0] for r in by_ranges(own, split)] == [f"out:{i}" for i in range(20)]
    single = b"".join(gzip.compress(warc.encoded(f"out:{i}", "response", None, None, random.Random(i).randbytes(2000) + inner[: len(inner) // 5])) for i in range(20))
    foreign.write_bytes(single)
    for split in (100, 777, 1 << 20):
        assert [r[0] for r in by_ranges(foreign, split)] == [f"out:{i}" for i in range(20)]


def test_damage_costs_the_damaged_record_alone(tmp_path):
    members = [warc.member(warc.encoded(f"r:{i}", "response", None, None, random.Random(i).randbytes(500)), b"V" * 16) for i in range(30)]
    broken = bytearray(members[11])
    broken[len(broken) // 2] ^= 0xFF
    path = tmp_path / "d.warc.gz"
    path.write_bytes(b"".join(bytes(broken) if i == 11 else m for i, m in enumerate(members)) + b"trailing")
    for split in (64, 1000, 1 << 20):
        assert [r[0] for r in by_ranges(path, split)] == [f"r:{i}" for i in range(30) if i != 11]


def test_files_of_failed_attempts_do_not_count(spark, tmp_path):
    written(spark, tmp_path / "w", PAGES)
    orphan = next((tmp_path / "w").glob("*.gz"))
    (tmp_path / "w" / "part-other.warc.gz").write_bytes(orphan.read_bytes())
    assert spark.read.format("warc").load(str(tmp_path / "w")).count() == len(PAGES)
    written(spark, tmp_path / "w", PAGES[:2])  # a second job adds to the folder
    assert spark.read.format("warc").load(str(tmp_path / "w")).count() == len(PAGES) + 2


def test_archives_of_nothing(spark, tmp_path):
    written(spark, tmp_path / "w", [])
    assert spark.read.format("warc").load(str(tmp_path / "w")).count() == 0
    assert spark.read.format("warc").load(str(tmp_path / "none")).count() == 0


def test_short_payloads_may_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.record_id: r.refers_to for r in warc.with_revisits(df, least_bytes=3).collect()}
    assert got == {"urn:page:1": None, "urn:page:2": None, "urn:page:3": "urn:page:4", "urn:page:4": None}


# ---- divergence ----


def plain_audit(rows, least, top):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))) for t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t in df if df[t] >= least}
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        whole = sum(count.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in count.items():
            pairs = [(sum(f(share(c, t), share(e, t)) for t in kept), o) for o, e in count.items() if o != s]
            terms = [(f(share(c, t), share(whole, t)), t) for t in c if share(c, t) > share(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize(("heavy", "group_block", "term_block"), [(16, 64, 256), (3, 2, 3), (1, 3, 1000), (1000, 2, 7)])
def test_audit_agrees_with_brute_force(spark, heavy, group_block, term_block):
    r = random.Random(6)
    rows = [(t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "s4", "s5", "é", None, "hot", "hot", "hot"])) for t in texts(300, 9, 25) + ODD]
    rows += [(None, "en", "silent"), ("only one", "xx", "a"), ("", "yy", "a"), (None, "yy", "b")] + [("same words here", "en", "hot")] * 15
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "text string, lang string, source string, n long, term string").repartition(6)
    got = divergence_audit.audit(df, least_docs=4, top=10, heavy=heavy, group_block=group_block, term_block=term_block).collect()
    assert sorted(tuple(x) for x in got) == plain_audit(rows, 4, 10)


def test_audit_of_nothing(spark):
    assert divergence_audit.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_shares_of_very_frequent_terms_do_not_overflow(spark):
    df = spark.createDataFrame([(10**13, 2 * 10**13, 5)], "n long, size long, kept long")
    assert df.select(divergence_audit._share("n", "size", "kept").alias("p")).first().p == 1 + 10**9 * (10**13 + 2) // (2 * 10**13 + 10)


# ---- learning from very many languages and very long texts ----


def test_thousands_of_languages_are_learned(spark):
    from sluicework.llm import language_profiles

    df = spark.createDataFrame([(i, f"abc{i} def{i % 97}", f"l{i % 5000}") for i in range(6000)], "doc_id long, text string, lang string")
    assert len(language_profiles.fit(df).languages) == 5000


def test_very_long_texts_are_learned_from_within_the_bound(spark, monkeypatch):
    from sluicework.llm import language_profiles

    taken = []
    monkeypatch.setattr(language_profiles, "learn", lambda rows, vectors=None: taken.extend(rows))
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.expr("repeat('lorem ipsum ', 170000)").alias("text"), F.lit("la").alias("lang"))
    language_profiles.fit(df)
    assert 1 <= len(taken) and sum(len(t) for _, t in taken) < 2 * language_profiles.SAMPLE_CHARS
