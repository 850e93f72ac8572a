"""Renames carried out by tasks: each moves the files of its rows, and says what became of each.

Outcomes are written to a folder once and read from there, so that reading them again moves nothing. A task that runs twice finds its files moved:
the source gone, and at the target a file with the hash of the plan.

Defined results: `RENOMEADO` if the file is at its target, `FALHOU: ` with the reason if it is not; rows that are not `PRONTO` stay as they are; a target that has
appeared since the plan was made is not overwritten; paths are below the root, and those that leave it fail; an empty plan gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship

READY, DONE = "PRONTO", "RENOMEADO"
_BLOCK = 1 << 20


def sha_of(fs: pafs.FileSystem, path: str) -> str:
    h = hashlib.sha256()
    with fs.open_input_stream(path) as f:
        while b := f.read(_BLOCK):
            h.update(b)
    return h.hexdigest()


def _place(root: str, relative: str | None) -> str:
    parts = (relative or "").split("/")
    if not relative or relative.startswith("/") or ".." in parts:
        raise OSError(f"unsafe path: {relative}")
    return f"{root.rstrip('/')}/{relative}"


def _is_file(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def move(fs: pafs.FileSystem, root: str, source: str | None, target: str | None, sha: str | None) -> str:
    """One file's outcome."""
    try:
        a, b = _place(root, source), _place(root, target)
        if _is_file(fs, b):
            if not _is_file(fs, a) and sha and sha_of(fs, b) == sha:  # an earlier attempt moved it
                return DONE
            raise OSError(f"target exists: {target}")
        if not _is_file(fs, a):
            raise OSError(f"no source: {source}")
        fs.create_dir(b.rpartition("/")[0], recursive=True)
        fs.move(a, b)
        return DONE
    except OSError as e:
        return f"FALHOU: {e}"


def carry_out(plan: DataFrame, root: str, folder: str) -> DataFrame:
    """(pos, source, target, status, sha) after the moves. plan: the same, with the files' hashes (`files.inventory`); root: the folder that paths are below, as a URI or path;
    folder: where outcomes are written."""
    spark = plan.sparkSession
    ship(spark)
    names = ["pos", "source", "target", "status", "sha"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for b in batches:
            told = [move(fs, base, r["source"], r["target"], r["sha"]) if r["status"] == READY else r["status"] for r in b.to_pylist()]
            yield b.set_column(b.schema.get_field_index("status"), "status", pa.array(told, pa.string()))

    rows = plan.select("pos", *(F.col(n).cast("string").alias(n) for n in names[1:]))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows.mapInArrow(run, kinds).write.mode("errorifexists").parquet(folder)
    return spark.read.parquet(folder)
