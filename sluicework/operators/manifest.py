"""The incremental manifest: reconciliation, decisions, invalidation, notes and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("ocr", "estrutura", "tabelas", "limpeza", "metadados")
#: Who consumes whose output.
DEPENDENTS = {"ocr": ("estrutura", "tabelas", "limpeza", "metadados"), "estrutura": ("tabelas", "limpeza", "metadados"), "tabelas": (), "limpeza": ("metadados",), "metadados": ()}


def reconcile(prev: DataFrame, now: DataFrame) -> DataFrame:
    """(id, status, old_id): new, unchanged, changed, renamed or removed. prev and now: id, sha.

    A new id whose sha is that of a missing one takes its row; of several with one sha each is used once, in order of ids.
    """
    missing = prev.join(now.select("id"), "id", "left_anti").where(F.coalesce("sha", F.lit("")) != "")
    fresh = now.join(prev.select("id"), "id", "left_anti")
    turn = F.row_number().over(Window.partitionBy("sha").orderBy("id"))
    pairs = fresh.withColumn("n", turn).join(missing.select(F.col("id").alias("old_id"), "sha", F.row_number().over(Window.partitionBy("sha").orderBy("id")).alias("n")), ["sha", "n"], "left").select("id", "old_id")
    both = prev.select("id", F.col("sha").alias("old_sha")).join(now, "id")
    kept = both.select("id", F.when((F.col("old_sha") != "") & (F.col("old_sha") != F.col("sha")), "changed").otherwise("unchanged").alias("status"), F.lit(None).cast("string").alias("old_id"))
    arrived = pairs.select("id", F.when(F.col("old_id").isNull(), "new").otherwise("renamed").alias("status"), "old_id")
    gone = prev.join(now.select("id"), "id", "left_anti").join(pairs.where("old_id is not null").select(F.col("old_id").alias("id")), "id", "left_anti")
    return kept.unionByName(arrived).unionByName(gone.select("id", F.lit("removed").alias("status"), F.lit(None).cast("string").alias("old_id")))


def versions(c: Column) -> Column:
    return F.map_filter(F.str_to_map(c, F.lit(";"), F.lit("=")), lambda k, v: v.isNotNull())


def version(c: Column, stage: str) -> Column:
    v = F.try_element_at(versions(c), F.lit(stage))
    return F.when(F.regexp_like(v, F.lit(r"^\d+$")), v.cast("int"))


def without_versions(c: Column, stages: list[str]) -> Column:
    """The map's text without some stages, in order of names."""
    kept = F.filter(F.array_sort(F.split(c, ";")), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*stages))
    return F.array_join(kept, ";")


def needs_run(state: Column, found: Column, current: int, forced: bool = False) -> Column:
    return F.lit(forced) | ~F.coalesce(state.isin("ok", "pulado"), F.lit(False)) | ~F.coalesce(found == current, F.lit(False))


def upsert_note(c: Column, stage: str, message: Column) -> Column:
    """The stage's own notes replaced by one, others kept."""
    kept = F.filter(F.split(c, r" \| "), lambda p: (p != "") & ~F.startswith(p, F.lit(f"[{stage}]")))
    return F.array_join(F.when(message != "", F.concat(kept, F.array(F.concat(F.lit(f"[{stage}] "), message)))).otherwise(kept), " | ")


def invalidate_after(rows: DataFrame, stage: str) -> DataFrame:
    """States of the stage's dependents back to pending."""
    return rows.withColumns({f"st_{d}": F.lit("pendente") for d in DEPENDENTS[stage]})


def invalidate_from(rows: DataFrame, stage: Column) -> DataFrame:
    """States of a stage and all after it in order back to pending, the stage being a column (null: none)."""
    first = F.array_position(F.array(*map(F.lit, STAGES)), stage)
    return rows.withColumns({f"st_{s}": F.when(first <= k, "pendente").otherwise(F.col(f"st_{s}")) for k, s in enumerate(STAGES, 1)})


def pending_reason() -> Column:
    """The first stage that has neither run nor been skipped."""
    return F.coalesce(*(F.when(~F.col(f"st_{s}").isin("ok", "pulado"), F.concat(F.lit(f"etapa {s} em '"), F.col(f"st_{s}"), F.lit("'"))) for s in STAGES), F.lit("?"))


def rename_plan(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(pos, source, target, status). pairs: pos, source, target; files: path."""
    there = files.select("path").distinct()
    rows = pairs.join(there.select(F.col("path").alias("source"), F.lit(True).alias("has_source")), "source", "left").join(there.select(F.col("path").alias("target"), F.lit(True).alias("has_target")), "target", "left")
    source, target = F.coalesce("has_source", F.lit(False)), F.coalesce("has_target", F.lit(False))
    open_ = source & ~target & (F.col("source") != F.col("target"))
    first = F.min(F.when(open_, F.col("pos"))).over(Window.partitionBy("target"))
    status = F.when(F.col("source") == F.col("target"), "JA_NO_PADRAO").when(~source & target, "DESTINO_JA_EXISTE").when(~source, "ORIGEM_AUSENTE").when(target, "DESTINO_JA_EXISTE").when(first < F.col("pos"), "DESTINO_DUPLICADO").otherwise("PRONTO")
    return rows.select("pos", "source", "target", status.alias("status"))


def verdict(rejects: Column, reviews: Column) -> Column:
    """Of two arrays of reasons."""
    return F.when(F.size(rejects) > 0, "reprovado").when(F.size(reviews) > 0, "revisar").otherwise("aprovado")


def needs_triage(route: Column, found: Column, current: int, integrity: Column, verifier: bool, forced: bool = False) -> Column:
    """Whether a document is diagnosed (again): forced, of another version, without a route, or never verified though a verifier is there."""
    unverified = F.coalesce(integrity, F.lit("")).isin("", "nao_verificado")
    return F.lit(forced) | ~F.coalesce(found == current, F.lit(False)) | F.coalesce(route, F.lit("")).isin("", "ERRO") | (F.lit(verifier) & unverified)


def in_order(rows: DataFrame, file: str = "arquivo_origem") -> DataFrame:
    """Rows by file whatever its case, then id: the order in which a manifest is written."""
    return rows.orderBy(F.lower(file), "id")


#: Endings of downloads that were broken off (fixed values).
PARTIAL = (".crdownload", ".part", ".partial", ".download", ".tmp")


def set_aside(files: DataFrame, endings: tuple[str, ...] = PARTIAL) -> DataFrame:
    """(path, target): broken downloads and where they are put."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*endings)).select("path", F.concat(F.lit("_descartar/"), name).alias("target"))


def renamed(plan: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The plan after its moves: what was ready is done, or failed with a reason. plan: pos, source, target, status; failed: source, reason."""
    rows = plan.join(failed, "source", "left") if failed is not None else plan.withColumn("reason", F.lit(None).cast("string"))
    done = F.when(F.col("reason").isNotNull(), F.concat(F.lit("FALHOU: "), "reason")).otherwise("RENOMEADO")
    return rows.withColumn("status", F.when(F.col("status") == "PRONTO", done).otherwise(F.col("status"))).drop("reason")


def follow(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """A manifest after renames: a moved document's row takes the new id, file and hash, ages all its stages and says so; a row that had the new id goes.

    rows: id, file, sha, note and st_ columns; moves: old_id, new_id, source, target, sha, of documents that were moved.
    """
    moved = moves.where("old_id != new_id").select("old_id", "new_id", F.regexp_extract("source", r"([^/]+)$", 1).alias("_name"), F.col("target").alias("_file"), F.col("sha").alias("_sha"))
    found = rows.join(moved, rows["id"] == moved["old_id"], "left")
    there = found.where("old_id is not null").select(F.col("new_id").alias("id")).distinct()
    kept = found.where("old_id is null").join(there, "id", "left_anti")
    hit = F.col("old_id").isNotNull()
    note = F.when(hit, upsert_note(F.col("note"), "renomear", F.concat(F.lit("renomeado de "), "_name"))).otherwise(F.col("note"))
    both = kept.unionByName(found.where("old_id is not null"))
    states = {c: F.when(hit, F.lit("pendente")).otherwise(F.col(c)) for c in rows.columns if c.startswith("st_")}
    return both.select(*(v.alias(k) for k, v in {**{c: F.col(c) for c in rows.columns}, "id": F.coalesce("new_id", "id"), "file": F.coalesce("_file", "file"), "sha": F.coalesce(F.nullif(F.col("_sha"), F.lit("")), "sha"), "note": note, **states}.items()))
