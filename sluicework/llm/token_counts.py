"""Token counts by a compiled tokenizer.

A byte-pair tokenizer is compiled into one deterministic transducer, state by state as texts need
them. A state is the splitter's (which class of characters the open word has, a white-space character or a contraction's letter that waits for
the next) and, within the open word, the merger's: for each place where a vocabulary entry may
still end, the trie's node, the token before that place and the count there
against the count here. A transition carries the tokens it emits, which may be
negative when a longer token takes the place of shorter ones. That is enough
because the last token of every prefix is determined: it is the entry that stands as itself
beside the token before it. What waits at a text's end is in the state too.

A text longer than a block is cut into blocks, which are rows of their own. A block's state map says for the states that it may be entered in
which state it ends in and how many tokens it emits. Behind a blank that follows another
character the state is the same whatever came before, so if the characters before a block hold such a place, the map has one entry; in an
unbroken run it has all states that come up again and again in it. Maps compose associatively, by halves, and
the composition of all gives the text's count. Where a block turns out to be entered in a state that its map lacks, the text is counted from its
start in one task.

Defined results: a null text is empty and has no bytes and no tokens; a special string counts as one token, as the library's default has it (a text longer than a block
that holds one is counted in one task); repeated rows and rows without an id are counted each; columns other than id and text are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, emit, id_and_text, kept, texts

LIMIT = 1024
#: Characters of a block, and those before it that are looked at for its entry; states that a worker keeps before it compiles anew.
BLOCK, BEFORE, KEPT_STATES = 1 << 16, 512, 200_000
#: White space of the split pattern (fixed by Unicode's White_Space property).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Merger:
    """Bytes of a word -> how many tokens the merges leave."""

    def __init__(self, vocab: dict[str, int], merges: list, most: int = KEPT_STATES):
        letters = _byte_letters()
        self.most = most
        self.rank: dict[int, int] = {}  # 0 for a byte
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for at, pair in enumerate(merges, 1):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if k not in self.halves:
                self.halves[k], self.rank[k] = (i, j), at
            self.merge.setdefault((i, j), at)
        for word, i in vocab.items():
            if i not in self.halves and (len(word) > 1 or word not in letters):
                continue  # a special string, or an entry that no merge makes
            self.rank.setdefault(i, 0)
            node = 0
            for c in word:
                b = letters[c]
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                node = self.trie[node][b]
            self.token[node] = i
        self.beside: dict[tuple[int, int], bool] = {}
        self.start()

    def start(self) -> None:
        """Only the start state; others are compiled when first met."""
        self.states: dict[tuple, int] = {((0, -1, 0),): 0}
        self.keys: list[tuple] = [((0, -1, 0),)]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def _edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """(symbol, rank that made it, rank that takes it) along one edge of a token's tree."""
        out, until = [], float("inf")
        while True:
            out.append((token, self.rank[token], until))
            if token not in self.halves:
                return out
            until, token = self.rank[token], self.halves[token][side]

    def stand(self, a: int, b: int) -> bool:
        """Whether tokens a and b side by side are left as they are: no merge across them comes first.

        Two symbols at the border are both there between the later of the ranks that
        made them and the earlier of those that take them. At equal ranks the left pair is merged first.
        """
        if (known := self.beside.get((a, b))) is not None:
            return known
        ok = True
        right = self._edge(b, 0)
        for s, made_s, until_s in self._edge(a, 1):
            for t, made_t, until_t in right:
                r = self.merge.get((s, t))
                if r is not None and max(made_s, made_t) < min(until_s, until_t) and r < until_s and r <= until_t:
                    ok = False
        if len(self.beside) > 1_000_000:
            self.beside.clear()
        self.beside[a, b] = ok
        return ok

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        live, made = [], None
        for node, last, count in self.keys[state]:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            t = self.token[child]
            if t >= 0 and made is None and (last < 0 or self.stand(last, t)):
                made = (t, count + 1)
            if self.trie[child]:
                live.append((child, last, count))
        if made is None:
            raise ValueError("a byte has no token")
        token, emitted = made
        key = (*((n, last, c - emitted) for n, last, c in live), (0, token, 0))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        move = self.moves[state][byte] = (to, emitted)
        return move

    def feed(self, state: int, word: bytes) -> tuple[int, int]:
        """(state, tokens emitted) after more bytes of a word."""
        total = 0
        for b in word:
            move = self.moves[state].get(b) or self._compile(state, b)
            state = move[0]
            total += move[1]
        return state, total

    def known(self, key: tuple) -> int:
        """The state with this key."""
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        return self.states[key]


#: What an apostrophe where a word begins makes a word with (fixed by the split pattern).
_ONE, _TWO = {"s", "t", "m", "d"}, {"re", "ve", "ll"}
#: Modes of the splitter: nothing open; white space; a word of letters, numbers, others; an apostrophe alone; one with a letter that may begin a pair.
START, SPACE, LETTERS, NUMBERS, OTHERS, QUOTE, PAIR = "S", " ", "L", "N", "O", "Q", "P"
#: Beside its transitions, a state's own name and what is emitted where a text ends in it.
_NAME, _END = 0, 1


class Tokenizer:
    """Counts as the library gives them for a byte-level vocabulary with the usual split pattern.

    A compiled state is a table: character -> (table of the next state, tokens emitted).
    """

    def __init__(self, path: str, most: int = KEPT_STATES):
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger = Merger(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._pieces = Library.from_file(path).pre_tokenizer.pre_tokenize_str
        self.kind: dict[str, str] = {c: SPACE for c in SPACES}
        self.most = most
        self.restart()

    def restart(self) -> None:
        """Only the start state; others are compiled when first met."""
        self.merger.start()
        self.tables: dict[tuple, dict] = {}
        self.first = self._table((START, "", 0))

    def _kind(self, c: str) -> str:
        """Letters, numbers or others: what the split pattern takes a character for, asked once."""
        if c not in self.kind:
            alone = [k for k, beside in ((LETTERS, "a"), (NUMBERS, "1"), (OTHERS, "!")) if len(self._pieces(beside + c)) == 1]
            if not alone:
                raise ValueError(f"white space that the pattern does not list: {c!r}")
            self.kind[c] = alone[0]
        return self.kind[c]

    def _table(self, name: tuple[str, str, int]) -> dict:
        t = self.tables.get(name)
        if t is None:
            mode, waits, merged = name
            if mode == SPACE:  # the white space at a text's end is one word
                end = self.merger.feed(merged, waits.encode())[1]
            else:
                end = self.merger.feed(0, waits.encode())[1] if waits else 0
            t = self.tables[name] = {_NAME: name, _END: end}
        return t

    def _begun(self, c: str, blank: str = "") -> tuple[tuple[str, str, int], int]:
        """A word's first character, behind the blank that it takes in."""
        k = self._kind(c)
        merged, n = self.merger.feed(0, (blank + c).encode())
        return (QUOTE if c == "'" and not blank else k, "", merged), n

    def _stepped(self, name: tuple[str, str, int], c: str) -> tuple[tuple[str, str, int], int]:
        mode, waits, merged = name
        k = self._kind(c)
        if mode == SPACE:
            if k == SPACE:
                merged, n = self.merger.feed(merged, waits.encode())
                return (SPACE, c, merged), n
            if waits == " ":
                return self._begun(c, " ")
            n = self.merger.feed(0, waits.encode())[1]
            to, more = self._begun(c)
            return to, n + more
        n = 0
        if mode == PAIR:
            if waits + c in _TWO:
                return (START, "", 0), self.merger.feed(merged, (waits + c).encode())[1]
            mode = LETTERS  # the apostrophe stands alone, and a word of letters has begun
            merged, n = self.merger.feed(0, waits.encode())
        if k == SPACE:
            return (SPACE, c, 0), n
        if mode == QUOTE:
            if c in _ONE:
                return (START, "", 0), self.merger.feed(merged, c.encode())[1]
            if any(w[0] == c for w in _TWO):
                return (PAIR, c, merged), 0
            mode = OTHERS
        if mode == k:
            merged, more = self.merger.feed(merged, c.encode())
            return (k, "", merged), n + more
        to, more = self._begun(c)
        return to, n + more

    def _compile(self, table: dict, c: str) -> tuple[dict, int]:
        name, n = self._stepped(table[_NAME], c)
        move = table[c] = (self._table(name), n)
        return move

    def run(self, text: str, table: dict) -> tuple[dict, int]:
        """(state, tokens emitted) after a text."""
        total = 0
        for c in text:
            move = table.get(c) or self._compile(table, c)
            table = move[0]
            total += move[1]
        return table, total

    def count(self, text: str) -> int:
        if len(self.tables) > self.most or len(self.merger.keys) > self.most:
            self.restart()
        parts = [text]
        if self._specials and self._specials.search(text):
            parts = self._specials.split(text)
        total = len(parts) - 1
        for part in parts:
            table, n = self.run(part, self.first)
            total += n + table[_END]
        return total

    def _written(self, table: dict) -> str:
        """A state as any worker knows it."""
        mode, waits, merged = table[_NAME]
        return json.dumps([mode, waits, self.merger.keys[merged]])

    def _read(self, state: str) -> dict:
        mode, waits, key = json.loads(state)
        return self._table((mode, waits, self.merger.known(tuple(map(tuple, key)))))

    def state_map(self, before: str, text: str) -> dict[str, tuple[str, int]]:
        """State -> (state, tokens emitted) of a block, for the states that it may be entered in; before: characters before it, none at a text's start."""
        if len(self.tables) > self.most or len(self.merger.keys) > self.most:
            self.restart()
        entries = {id(self.first): self.first}
        if before:
            table, times, known = self.first, {}, False
            for i, c in enumerate(before):
                table = (table.get(c) or self._compile(table, c))[0]
                known = known or i > 0 and self._kind(c) == SPACE != self._kind(before[i - 1])
                n, _ = times.get(id(table), (0, None))
                times[id(table)] = (n + 1, table)
            entries = {id(table): table}
            if not known:
                entries |= {i: t for i, (n, t) in times.items() if n > 1}
        out = {}
        for table in entries.values():
            end, n = self.run(text, table)
            out[self._written(table)] = (self._written(end), n)
        return out

    def end(self, state: str) -> int:
        return self._read(state)[_END]


def composed(a: dict[str, tuple[str, int]], b: dict[str, tuple[str, int]]) -> dict[str, tuple[str, int]]:
    """The map of a, then b; entries of a that end in a state b does not know are lost."""
    return {s: (b[mid][0], n + b[mid][1]) for s, (mid, n) in a.items() if mid in b}


def scanned(maps: list[dict[str, tuple[str, int]]]) -> dict[str, tuple[str, int]]:
    """The composition of all maps, by halves."""
    while len(maps) > 1:
        maps = [composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def tokenizer(path: str) -> Tokenizer:
    """One compiled tokenizer for all tasks of a worker."""
    return kept(("tokenizer", path), lambda: Tokenizer(path))


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_MAPS = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("states", pa.list_(pa.string())), ("ends", pa.list_(pa.string())), ("emitted", pa.list_(pa.int64()))])
_KINDS = "doc_id long, n_bytes long, n_tokens long"


def _whole(docs: DataFrame, path: str) -> DataFrame:
    """Counts of texts read from start to end by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = tokenizer(path)
        return emit(((i, len(t.encode()), compiled.count(t)) for ids, ts in texts(batches) for i, t in zip(ids, ts, strict=True)), OUT)

    return docs.select("doc_id", "text").mapInArrow(run, _KINDS)


def block_maps(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """(key, block, states, ends, emitted): the state map of each block of each text. docs: key, text."""
    blocks = docs.select("key", "text", F.posexplode(F.sequence(F.lit(1), F.length("text"), F.lit(block))).alias("block", "at"))
    before = F.least(F.col("at") - 1, F.lit(BEFORE))
    cut = blocks.select("key", "block", before.alias("before"), F.substring("text", F.col("at") - before, before + block).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = tokenizer(path)

        def rows():
            for b in batches:
                for key, k, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    m = compiled.state_map(t[:n], t[n:])
                    yield key, k, list(m), [e for e, _ in m.values()], [n for _, n in m.values()]

        return emit(rows(), _MAPS, lambda r: 200 * len(r[2]))

    return cut.mapInArrow(run, "key long, block int, states array<string>, ends array<string>, emitted array<long>")


def _scan_counts(maps: DataFrame, path: str) -> DataFrame:
    """(key, n_tokens): each text's maps composed; null where a map lacked a state."""
    once = maps.groupBy("key", "block").agg(F.first(F.struct("states", "ends", "emitted")).alias("m"))  # texts that are the same have the same maps
    lists = once.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("maps"))
    out = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = tokenizer(path)

        def rows():
            for b in batches:
                for key, ms in zip(b.column("key").to_pylist(), b.column("maps").to_pylist(), strict=True):
                    whole = scanned([{s: (e, n) for s, e, n in zip(*(x["m"][c] for c in ("states", "ends", "emitted")), strict=True)} for x in ms])
                    yield (key, (end := next(iter(whole.values())))[1] + compiled.end(end[0])) if whole else (key, None)

        return emit(rows(), out)

    return lists.mapInArrow(run, "key long, n_tokens long")


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text."""
    path = path or vocabulary_path()
    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    held = id_and_text(docs, id_col, text_col)
    whole = F.length("text") <= block
    for s in special:
        whole = whole | F.contains("text", F.lit(s))
    long = held.where(~whole).withColumn("key", F.xxhash64("text"))
    known = _scan_counts(block_maps(long.select("key", "text"), path, block), path)
    found = long.join(known, "key", "left")
    missed = _whole(found.where("n_tokens is null").select("doc_id", "text"), path)
    return _whole(held.where(whole), path).unionByName(found.where("n_tokens is not null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens")).unionByName(missed)


def op8_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents."""
    return count_tokens(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
