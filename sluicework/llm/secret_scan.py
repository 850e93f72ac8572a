"""Secret scans with DataFrame functions alone.

Base spans come from three patterns. The method adds spans: long runs of key-like
characters that overlap no base span get an inferred encoding, and three tests ask whether their symbols are
random in it: chi-squared uniformity over the alphabet, runs about its middle, and
lag-one serial correlation. A run that any of them rejects (at ALPHA, shared by the three) is no key.

What is not rejected need not be a key: identifiers and joined words are too short to be told from random ones by these
tests alone. So each run also has a tail probability under the opposite hypothesis, that it is made of words: how much likelier
a uniform source makes it than a chain of letters with the corpus's letter pairs (and fixed rates of a change of case or class) bounds it, since a likelihood ratio
exceeds x with a probability of 1 / x at most. Within each encoding and band of lengths the Benjamini-Hochberg rule over all runs of the
corpus names those that are not words at a rate of false discoveries of LEVEL; a run that is named, and that the battery leaves, is a span of kind `random`.

Positions are code points, ends exclusive; they follow from the pieces between the matches, folded in blocks, so that a text with very many
matches is gone through once. Defined results: a null text is empty and has no spans; each row is a document of its own, repeated or without an id;
where spans begin at one place the kind listed first comes first; an empty table has no limits; columns other than id and text are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, documents

#: The base patterns (fixed values), and the length that a match, or its second group, must have.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 characters or more: a shorter first match takes its whole run
HEX = r"[0-9a-f]{24,}"  # as [0-9a-f]+ of 24 characters or more
ASSIGN_LEAST = 6
#: Runs that are tested, the level of false discoveries, the level at which the battery rejects a run, and how far tail probabilities are binned (powers of two).
RUN, LEVEL, ALPHA, BINS = r"[A-Za-z0-9+/_-]{20,}={0,2}", 0.01, 0.001, 64
#: Of a run made of words: chances to go from a letter, a digit or a sign to another class, and to change case between letters.
FROM_LETTER, FROM_DIGIT, FROM_SIGN, TURN = {"digit": 0.06, "sign": 0.08}, {"letter": 0.3, "sign": 0.1}, {"letter": 0.8, "digit": 0.15}, 0.15
#: Matches that are folded together.
TOGETHER = 256
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: name, pattern of the whole run, alphabet; the first that fits is taken. Words of one case are no encoding.
ENCODINGS = (
    ("none", f"[{_DIGITS}]+=*|[A-Z]?[a-z]+=*|[A-Z]+=*|[_/+-]+=*", ""),
    ("hex", "[0-9a-f]+=*", _DIGITS + "abcdef"),
    ("HEX", "[0-9A-F]+=*", _DIGITS + "ABCDEF"),
    ("base32", "[A-Z2-7]+=*", _UPPER + "234567"),
    ("base36", "[a-z0-9]+=*", _DIGITS + _LOWER),
    ("BASE36", "[A-Z0-9]+=*", _DIGITS + _UPPER),
    ("base62", "[A-Za-z0-9]+=*", _DIGITS + _UPPER + _LOWER),
    ("base64", "[A-Za-z0-9+/]+=*", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "[A-Za-z0-9_+/-]+=*", _UPPER + _LOWER + _DIGITS + "-_"),
)

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _running(rows: Column, start: Column, step, kind: str) -> Column:
    """What step(state, row) -> (state, items) gives over an array, in order: items are gathered in blocks, so that long arrays are not copied for each row."""
    none = F.array().cast(kind)

    def over(all_rows: Column) -> Column:
        def block(acc: Column, k: Column) -> Column:
            def one(a: Column, x: Column) -> Column:
                state, items = step(a["state"], x)
                return F.struct(state.alias("state"), F.concat(a["made"], items).alias("made"))

            done = F.aggregate(F.slice(all_rows, k * TOGETHER + 1, TOGETHER), F.struct(acc["state"].alias("state"), none.alias("made")), one)
            return F.transform(F.array(done), lambda d: F.struct(d["state"].alias("state"), F.concat(acc["blocks"], F.array(d["made"])).alias("blocks")))[0]

        blocks = F.sequence(F.lit(0), F.floor((F.size(all_rows) - 1) / TOGETHER).cast("int"))
        made = F.aggregate(blocks, F.struct(start.alias("state"), F.array().cast(f"array<{kind}>").alias("blocks")), block, lambda acc: F.flatten(acc["blocks"]))
        return F.when(F.size(all_rows) > 0, made).otherwise(none)

    return F.transform(F.array(rows), over)[0]


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """Spans of the matches whose group has `least` characters, in order."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    checked = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        begin = at + F.length(m["before"])
        end = begin + F.length(m["match"])
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return end, F.when(F.length(m["checked"]) >= least, span).otherwise(F.array().cast(_SPAN))

    zipped = F.arrays_zip(between.alias("before"), found.alias("match"), checked.alias("checked"))
    folded = _running(F.slice(zipped, 1, F.size(found)), F.lit(0), step, _SPAN)
    return F.when(F.regexp_like(text, F.lit(pattern)), folded).otherwise(F.array().cast(_SPAN))


def _free(base: Column, candidates: Column) -> Column:
    """The candidates that overlap no base span: one pass from the left for those that begin before, one from the right for those that begin after."""
    flagged = "array<struct<start:int,kind:int,end:int,hit:boolean>>"
    tell = lambda x, hit: F.array(F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), hit.alias("hit")))
    is_base = lambda x: x["kind"] < len(KINDS) - 1

    def right(reach: Column, x: Column) -> tuple[Column, Column]:
        return F.when(is_base(x), F.greatest(reach, x["end"])).otherwise(reach), tell(x, reach > x["start"])

    def left(reach: Column, x: Column) -> tuple[Column, Column]:
        return F.when(is_base(x), F.least(reach, x["start"])).otherwise(reach), tell(x, x["hit"] | (reach < x["end"]))

    there = _running(F.array_sort(F.concat(base, candidates)), F.lit(0), right, flagged)
    back = _running(F.reverse(there), F.lit((1 << 31) - 1), left, flagged)
    kept = F.transform(F.filter(back, lambda x: ~is_base(x) & ~x["hit"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.when((F.size(base) > 0) & (F.size(candidates) > 0), F.reverse(kept)).otherwise(candidates)


def _upper_tail(z: Column) -> Column:
    """Of the normal distribution, by a logistic with a cubic term."""
    x = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * x + 0.070566 * x * x * x))


def _tested(run: Column, pairs: Column, starts: Column) -> Column:
    """(encoding, band, bin): what the battery leaves of a run of characters, and its tail probability as words (minus its binary logarithm); -1 if the battery rejects it."""
    name, alphabet = F.lit("none"), F.lit("")
    for n, pattern, letters in reversed(ENCODINGS):
        fits = F.regexp_like(run, F.lit(f"^(?:{pattern})$"))
        name, alphabet = F.when(fits, F.lit(n)).otherwise(name), F.when(fits, F.lit(letters)).otherwise(alphabet)
    body = F.rtrim(run, F.lit("="))
    return F.transform(F.array(F.struct(name.alias("encoding"), alphabet.alias("alphabet"), body.alias("body"))), lambda r: _battery(r, _as_words(r["body"], pairs, starts)))[0]


def _as_words(body: Column, pairs: Column, starts: Column) -> Column:
    """The binary logarithm of the run's likelihood as words; pairs: of letter after letter (26 x 26), starts: of a letter that follows none."""
    log = lambda p: F.lit(math.log2(p))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(F.lower(c)) - 97
        letter, digit = (code >= 0) & (code < 26), F.ascii(c).between(48, 57)
        upper = F.ascii(c).between(65, 90)
        turned = F.when(a["upper"] & ~upper, log(0.5)).when(a["upper"] != upper, log(TURN)).otherwise(F.when(upper, log(0.5)).otherwise(log(1 - TURN)))
        here = F.when(letter, F.lit(1)).when(digit, F.lit(2)).otherwise(F.lit(3))
        after = F.get(pairs, a["code"] * 26 + code) + log(1 - sum(FROM_LETTER.values())) + turned
        fresh = F.get(starts, code) + log(0.5)
        own = F.when(letter, fresh).when(digit, log(0.1)).otherwise(log(0.25))
        move = {
            0: F.when(letter, log(0.8)).when(digit, log(0.15)).otherwise(log(0.05)),
            1: F.when(digit, log(FROM_LETTER["digit"])).otherwise(log(FROM_LETTER["sign"])),
            2: F.when(letter, log(FROM_DIGIT["letter"])).when(digit, log(1 - sum(FROM_DIGIT.values()))).otherwise(log(FROM_DIGIT["sign"])),
            3: F.when(letter, log(FROM_SIGN["letter"])).when(digit, log(FROM_SIGN["digit"])).otherwise(log(1 - sum(FROM_SIGN.values()))),
        }
        moved = F.when(a["here"] == 0, move[0]).when(a["here"] == 1, move[1]).when(a["here"] == 2, move[2]).otherwise(move[3])
        gain = F.when(letter & (a["here"] == 1), after).otherwise(moved + own)
        return F.struct((a["sum"] + gain).alias("sum"), here.alias("here"), code.alias("code"), upper.alias("upper"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("here"), F.lit(-1).alias("code"), F.lit(False).alias("upper"))
    return F.aggregate(F.split(body, ""), start, step, lambda a: a["sum"])


def _battery(r: Column, as_words: Column) -> Column:
    n, k = F.length(r["body"]).cast("double"), F.length(r["alphabet"]).cast("double")
    squares = F.aggregate(F.split(r["alphabet"], ""), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(r["body"], c)), F.lit(2.0)))
    df = k - 1
    chi = F.greatest(F.lit(0.0), k / n * squares - n)
    chi_p = _upper_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    values = F.transform(F.split(r["body"], ""), lambda c: (F.instr(r["alphabet"], c) - 1).cast("double"))
    moments = F.aggregate(
        values,
        F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("lag"), F.lit(0.0).alias("high"), F.lit(1.0).alias("runs")),
        lambda a, v: F.struct(
            v.alias("last"), (a["s"] + v).alias("s"), (a["ss"] + v * v).alias("ss"), (a["lag"] + F.coalesce(a["last"] * v, F.lit(0.0))).alias("lag"),
            (a["high"] + F.when(v >= k / 2, 1.0).otherwise(0.0)).alias("high"),
            (a["runs"] + F.when((a["last"] >= k / 2) != (v >= k / 2), 1.0).otherwise(0.0)).alias("runs"),
        ),
    )

    def rest(m: Column) -> Column:
        low = n - m["high"]
        expected = 2 * m["high"] * low / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        runs_p = F.when(spread > 0, 2 * _upper_tail(F.abs(m["runs"] - expected) / F.sqrt(spread))).otherwise(F.lit(0.001))
        mean = m["s"] / n
        variance = m["ss"] / n - mean * mean
        serial = (m["lag"] - (n - 1) * mean * mean) / n / variance
        serial_p = F.when(variance > 0, 2 * _upper_tail(F.abs(serial) * F.sqrt(n))).otherwise(F.lit(0.0))
        likelier = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(BINS)), -n * F.log2(k) - as_words))).cast("int")
        left = 3 * F.least(chi_p, runs_p, serial_p) >= ALPHA
        return F.struct(r["encoding"].alias("encoding"), F.least(F.lit(6), F.floor(F.log2(n / 20) * 2).cast("int")).alias("band"), F.when(left, likelier).otherwise(F.lit(-1)).alias("bin"))

    return F.when(r["alphabet"] != "", F.transform(F.array(moments), rest)[0])


def letter_pairs(docs: DataFrame, text_col: str = "text") -> tuple[list[float], list[float]]:
    """Binary logarithms of how often letters (a to z, of either case) follow each other in words, and begin them: over all words of all texts.

    Distinct words are counted first, so that at most 27 x 26 rows come from them to the driver."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("(?<![a-z0-9+/_=-])[a-z]++(?![a-z0-9+/_=-])"), F.lit(0))
    words = docs.select(F.explode(found).alias("w")).where(F.length("w") < 20).groupBy("w").count()
    letters = F.transform(F.sequence(F.lit(0), F.length("w") - 1), lambda i: F.struct(F.when(i > 0, F.ascii(F.substring("w", i, F.lit(1))) - 97).otherwise(F.lit(26)).alias("a"), (F.ascii(F.substring("w", i + 1, F.lit(1))) - 97).alias("b")))
    counts = [[0.5] * 26 for _ in range(27)]
    for r in words.select(F.explode(letters).alias("p"), "count").groupBy("p.a", "p.b").agg(F.sum("count").alias("n")).collect():
        counts[r.a][r.b] += r.n
    logs = [[math.log2(n / sum(row)) for n in row] for row in counts]
    return [x for row in logs[:26] for x in row], logs[26]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), letters: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """(doc_id, base: spans of the patterns, runs: what was tested beside them), and `carried`, a struct of the columns named. letters: `letter_pairs`, or those of `docs`."""
    pairs, starts = (F.array(*map(F.lit, x)) for x in letters or letter_pairs(docs, text_col))
    text = F.col("text")
    more = [F.struct(*(F.col(c) for c in carry)).alias("carried")] if carry else []
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
    base = held.select(
        "*",
        F.array_sort(F.concat(_spans(text, ASSIGN, 0, 2, ASSIGN_LEAST), _spans(text, ACCESS, 1), _spans(text, HEX, 2))).alias("base"),
        _spans(text, RUN, 3).alias("candidates"),
    )
    runs = F.transform(_free(F.col("base"), F.col("candidates")), lambda c: F.struct(c.alias("span"), _tested(F.substring(text, c["start"] + 1, c["end"] - c["start"]), pairs, starts).alias("test")))
    return base.select("doc_id", "base", runs.alias("runs"), *(["carried"] if carry else []))


def limits(scanned: DataFrame, level: float = LEVEL) -> dict[tuple[str, int], int]:
    """(encoding, band) -> the least bin whose runs are found not to be words; at most encodings x bands rows are collected."""
    tested = scanned.select(F.explode("runs").alias("r")).where(F.col("r.test").isNotNull()).select("r.test.*")
    counts = tested.groupBy("encoding", "band", "bin").count()
    group = Window.partitionBy("encoding", "band")
    beyond = group.orderBy(F.desc("bin"))
    ranked = counts.select("encoding", "band", "bin", F.sum("count").over(beyond).alias("rank"), F.sum("count").over(group).alias("all"))
    found = ranked.where((F.col("bin") >= 0) & (F.pow(F.lit(2.0), -F.col("bin")) <= level * F.col("rank") / F.col("all"))).groupBy("encoding", "band").agg(F.min("bin").alias("bin"))
    return {(r[0], r[1]): r[2] for r in found.collect()}


def spans(scanned: DataFrame, found: dict[tuple[str, int], int]) -> DataFrame:
    """scanned with its runs judged by what `limits` found: `spans` holds those of all kinds by start, then kind."""
    held = limits_map(found)
    stays = F.filter("runs", lambda x: x["test"].isNotNull() & (x["test"]["bin"] >= F.coalesce(F.try_element_at(held, F.concat_ws("/", x["test"]["encoding"], x["test"]["band"])), F.lit(BINS + 1))))
    return scanned.withColumn("spans", F.array_sort(F.concat("base", F.transform(stays, lambda x: x["span"])))).drop("runs")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans replaced by the mark."""

    def step(acc: Column, s: Column) -> Column:
        apart = F.concat(acc["made"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], apart).otherwise(acc["made"]).alias("made"))

    done = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("made")), step, lambda acc: F.concat(acc["made"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def limits_map(found: dict[tuple[str, int], int]) -> Column:
    pairs = [F.lit(v) for (encoding, band), least in sorted(found.items()) for v in (f"{encoding}/{band}", least)]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,int>")


def written(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    scanned = checkpoint(scan(documents(spark, sf_dir)))
    found = spans(scanned, limits(scanned))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
