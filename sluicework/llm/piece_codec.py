"""Encoding and decoding with a piece model through a table of distinct chunks.

No piece of such a model crosses a word's marker (U+2581): it stands only at a
piece's start or in a piece of markers alone. A text, with its dummy prefix, thus
falls into chunks of a run of markers and what follows; a merge never joins two
of them. Each distinct chunk is segmented once and its ids are joined
back by position; the same table holds each chunk's decoded surface.

Defined results: a null text is empty; an empty text has the end id alone; a very long text is one row like any other, its chunks looked up one by one;
repeated rows and rows without an id are encoded each; columns other than id and text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, emit, id_and_text, kept, texts

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Chunks that a worker's table holds before it starts anew; bounds memory, not what is encoded.
TABLE_CHUNKS = 400_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTable:
    """chunk (without its first marker) -> (ids in decimal, surface with the leading space)."""

    def __init__(self, path: str, most: int = TABLE_CHUNKS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most = most
        crossing = [p for p in map(self.sp.id_to_piece, range(self.sp.get_piece_size())) if MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK))]
        if crossing:
            raise ValueError(f"pieces cross word markers: {crossing[:3]}")
        self.lone = self.sp.piece_to_id(MARK)
        self.ids: dict[str, str] = {}
        self.surface: dict[str, str] = {}

    def split(self, text: str) -> list[str]:
        """The chunks of a text, each without its first marker."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def learn(self, chunks: set[str]) -> None:
        """Segments the chunks that the table lacks, each once."""
        new = [c for c in chunks if c not in self.ids]
        if len(self.ids) + len(new) > self.most:
            self.ids.clear()
            self.surface.clear()
            new = list(chunks)
        for c, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True):
            ids = ids if c else [self.lone]
            self.ids[c] = " ".join(map(str, ids))
            self.surface[c] = " " + self.sp.decode(ids) if c else " "

    def encode(self, text: str) -> tuple[list[str], str]:
        """(decimal ids with the end id, decoded text)."""
        chunks = self.split(text)
        self.learn(set(chunks))
        return self.joined(chunks)

    def joined(self, chunks: list[str]) -> tuple[list[str], str]:
        ids = [*map(self.ids.__getitem__, chunks), str(self.sp.eos_id())]
        return ids, "".join(map(self.surface.__getitem__, chunks))[1:]


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, path: str | None = None, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids joined by a space, decoded text), or the digests of the last two."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(("chunks", path), lambda: ChunkTable(path))

        def rows():
            for ids, ts in texts(batches):
                parts = [table.split(t) for t in ts]
                table.learn(set().union(*parts))
                for i, chunks in zip(ids, parts, strict=True):
                    made, decoded = table.joined(chunks)
                    joined = " ".join(made)
                    n = joined.count(" ") + 1
                    yield (i, n, sha256(joined.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()) if digest else (i, n, joined, decoded)

        return emit(rows(), _DIGEST if digest else OUT, None if digest else lambda r: len(r[2]) + len(r[3]) + 64)

    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_tokens long, {names[0]} string, {names[1]} string")


def op7_piece_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    return encode(documents(spark, sf_dir), digest=True)
