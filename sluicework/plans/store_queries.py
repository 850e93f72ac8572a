"""Queries over what is kept between runs: extracted curves, curves of other frequencies, moved files, names told apart, final texts and messages; each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..operators import kept_curves, manifest as mf, names, quality as qa
from ..sources import extractions, files, moves
from .adapters import frame, scratch, view, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with the oracle's SQL over the views."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views("duckdb", sql)
        return f

    return put


# --- extracted curves ------------------------------------------------------------------------------


@query("""SELECT user_id AS doc, CAST(count(DISTINCT event_id % 4) AS BIGINT) AS pages, CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS batches, min(event_id) AS first_curve,
 CAST(count(DISTINCT CASE WHEN event_id % 4 IN (SELECT b.event_id % 4 FROM events b WHERE b.user_id = e.user_id AND b.event_id % 3 = 0) THEN event_id % 4 END) AS BIGINT) AS first_pages FROM events e GROUP BY user_id""")
def q_extraction_append(spark, sf_dir):
    """Extracted curves added in two batches, the second twice: pages once, whichever batch shows them first."""
    folder = scratch(spark)
    events = frame(spark, sf_dir, "SELECT user_id, event_id, value, sha2(CAST(user_id AS STRING), 256) AS sha, CAST(event_id % 4 AS INT) AS page FROM events")
    documents = events.select("sha", F.concat(F.lit("scans/"), "user_id", F.lit(".pdf")).alias("origin"), F.lit(4).alias("page_count"), F.lit("1").alias("app_version")).distinct()
    pages = events.select("sha", "page").distinct().select("sha", "page", F.encode(F.concat_ws(":", "sha", "page"), "UTF-8").alias("picture"), F.lit(100).alias("width"), F.lit(100).alias("height"), F.lit(300).alias("dpi"))
    curves = events.select("sha", "page", F.col("event_id").alias("curve"), "user_id", F.array("value").alias("points"))
    for name, test in (("first", "curve % 3 = 0"), ("second", "curve % 3 <> 0"), ("second", "curve % 3 <> 0")):
        extractions.append(spark, folder, name, documents, pages, curves.where(test))
    shown = extractions.read(spark, folder, "pages").groupBy("sha").agg(F.count("*").alias("pages"), F.count_if(F.col("batch") == "first").alias("first_pages"))
    kept = extractions.read(spark, folder, "records").groupBy("sha").agg(F.first("user_id").alias("doc"), F.count("*").alias("records"), F.count_distinct("batch").alias("batches"), F.min("curve").alias("first_curve"))
    return kept.join(shown, "sha").join(extractions.read(spark, folder, "documents").select("sha"), "sha").select("doc", "pages", "records", "batches", "first_curve", "first_pages")


# --- curves of other frequencies -------------------------------------------------------------------

_KEPT = """WITH a AS (SELECT unit_id, 60e0 AS frequency, 0 AS turn FROM unit UNION ALL SELECT unit_id, 50e0, CASE WHEN unit_id % 4 = 0 THEN 4 ELSE 1 END FROM unit WHERE unit_id % 4 <> 2 UNION ALL SELECT unit_id, 55e0, 1 FROM unit UNION ALL SELECT unit_id, 45.5e0, 2 FROM unit WHERE unit_id % 2 = 0),
 s AS (SELECT unit_id, 1e0 - base_speed * poles / (120e0 * base_freq) AS s, base_freq FROM unit), r AS (SELECT a.*, (frequency / base_freq) / (1e0 - s + (frequency / base_freq) * s) AS r FROM a JOIN s USING (unit_id))
 SELECT unit_id, round(frequency, 6) AS frequency, CAST(turn AS BIGINT) AS turn, CAST(count(*) AS BIGINT) AS points, round(sum(q * r), 6) AS q, round(sum(h * r * r), 6) AS h,
 round(sum(CASE WHEN eta = 0 THEN 0e0 ELSE least(1e0, greatest(0e0, 1e0 - (1e0 - eta) * pow(r, -0.1e0))) END), 6) AS eta, round(sum(npsh * r * r), 6) AS npsh FROM r JOIN curve_pt USING (unit_id) GROUP BY unit_id, frequency, turn"""


@query(_KEPT)
def q_kept_curves(spark, sf_dir):
    """Curves at 50, 55 and 45.5 Hz made and kept, some taken away and made again: a turn makes only what is not kept."""
    units = view(spark, sf_dir, "unit")
    store = kept_curves.create(spark, f"kept_{uuid.uuid4().hex}", scratch(spark), view(spark, sf_dir, "curve_pt"), units, buckets=8)
    at = lambda rows, *f: rows.select("unit_id", F.explode(F.array(*map(F.lit, f))).alias("frequency"))
    kept_curves.at(store, at(units, 50.0, 55.0, 60.0), 1)
    kept_curves.at(store, at(units.where("unit_id % 2 = 0"), 45.5, 50.0000001), 2)
    kept_curves.remove(store, at(units.where("unit_id % 2 = 0"), 50.0), 3)
    kept_curves.at(store, at(units.where("unit_id % 4 = 0"), 50.0, 55.0), 4)
    rows = kept_curves.current(store).groupBy("unit_id", "frequency", "turn").agg(F.count("*").alias("points"), *(F.round(F.sum(c), 6).alias(c) for c in ("q", "h", "eta", "npsh")))
    return rows.withColumn("frequency", F.col("frequency").cast("double"))


# --- files -----------------------------------------------------------------------------------------

_EXT = "CASE s_suppkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' ELSE '.part' END"


def _written(spark: SparkSession, rows: DataFrame) -> str:
    """A folder with a file for each row (path, content), written by tasks."""
    folder = scratch(spark)
    ship(spark)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for r in b.to_pylist():
                place = f"{root}/{r['path']}"
                fs.create_dir(place.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(place) as f:
                    f.write(r["content"].encode())
            yield b.select(["path"])

    rows.select("path", "content").mapInArrow(put, "path string").write.mode("overwrite").format("noop").save()
    return folder


@query(f"SELECT lower(substr({_EXT}, 1)) AS ext, lower({_EXT}) = '.pdf' AS taken, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(s_name)) AS BIGINT) AS bytes, min(sha256(s_name)) AS least_sha FROM supplier WHERE s_suppkey % 10 <> 0 GROUP BY ALL")
def q_inventory_walk(spark, sf_dir):
    """Files below a folder, but for those in folders that begin with an underscore, by ending."""
    rows = frame(spark, sf_dir, f"SELECT concat(CASE WHEN s_suppkey % 10 = 0 THEN '_fora/' ELSE 'a/b/' END, CAST(s_suppkey AS STRING), {_EXT}) AS path, s_name AS content FROM supplier")
    found = files.inventory(spark, _written(spark, rows), {".pdf"})
    return found.groupBy("ext", "taken").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min("sha").alias("least_sha"))


_MAP = """SELECT s_suppkey AS pos, concat('in/', CAST(s_suppkey AS VARCHAR(12)), '.pdf') AS source, CASE WHEN s_suppkey % 9 = 0 THEN concat('in/', CAST(s_suppkey AS VARCHAR(12)), '.pdf') WHEN s_suppkey % 5 = 0 THEN concat('out/shared-', CAST(s_suppkey % 50 AS VARCHAR(12)), '.pdf')
 ELSE concat('out/', CAST(s_suppkey % 7 AS VARCHAR(12)), '/', CAST(s_suppkey AS VARCHAR(12)), '.pdf') END AS target, sha256(s_name) AS digest FROM supplier"""


@query(f"""WITH p AS ({_MAP}), j AS (SELECT *, pos % 6 <> 1 AS there FROM p), w AS (SELECT *, min(CASE WHEN there AND source <> target THEN pos END) OVER (PARTITION BY target) AS first FROM j),
 s AS (SELECT *, CASE WHEN source = target THEN 'JA_NO_PADRAO' WHEN NOT there THEN 'ORIGEM_AUSENTE' WHEN first < pos THEN 'DESTINO_DUPLICADO' WHEN pos % 8 = 2 THEN 'FALHOU' ELSE 'RENOMEADO' END AS status FROM w)
 SELECT pos, source, target, status, CASE WHEN status = 'RENOMEADO' THEN digest END AS moved, CASE WHEN there AND status <> 'RENOMEADO' AND NOT (pos % 8 = 2 AND status = 'FALHOU') THEN digest END AS stayed FROM s""")
def q_rename_apply(spark, sf_dir):
    """A rename map carried out on files by tasks; some are gone when their turn comes. What is where afterwards is read from the folder."""
    base = frame(spark, sf_dir, _MAP.replace("sha256(s_name)", "s_name").replace("AS VARCHAR(12)", "AS STRING"))
    root = _written(spark, base.where("pos % 6 <> 1").select(F.col("source").alias("path"), F.col("digest").alias("content")))
    relative = lambda c: F.regexp_extract(c, r"/((?:in|out)/.*)$", 1)
    there = files.inventory(spark, root, {".pdf"}).select(relative("path").alias("path"), "sha")
    plan = mf.rename_plan(base.select("pos", "source", "target"), there).join(there.select(F.col("path").alias("source"), "sha"), "source", "left")
    planned = scratch(spark)
    plan.write.parquet(planned)
    plan = spark.read.parquet(planned)
    _gone(plan.where("status = 'PRONTO' and pos % 8 = 2"), root)
    done = moves.carry_out(plan, root, scratch(spark))
    after = files.inventory(spark, root, {".pdf"}).select(relative("path").alias("path"), F.col("sha").alias("is"))
    rows = done.join(after.select(F.col("path").alias("target"), F.col("is").alias("at_target")), "target", "left").join(after.select(F.col("path").alias("source"), F.col("is").alias("at_source")), "source", "left")
    status = F.regexp_replace("status", "^FALHOU: no source: .*$", "FALHOU")
    return rows.select("pos", "source", "target", status.alias("status"), F.when(F.col("status") == moves.DONE, F.col("at_target")).alias("moved"), F.col("at_source").alias("stayed"))


def _gone(rows: DataFrame, root: str) -> None:
    """Takes the sources of some rows away, as others may between plan and move."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for b in batches:
            for source in b["source"].to_pylist():
                place = f"{base}/{source}"
                if fs.get_file_info(place).type == pafs.FileType.File:
                    fs.delete_file(place)
            yield b

    rows.select("source").mapInArrow(drop, "source string").write.mode("overwrite").format("noop").save()


# --- names and texts -------------------------------------------------------------------------------


@query(None)
def q_unique_names(spark, sf_dir):
    """Names of sheets told apart in each brand's workbook, in the order of its parts."""
    rows = frame(spark, sf_dir, "SELECT p_brand AS book, p_partkey AS pos, CASE WHEN p_partkey % 5 = 0 THEN concat(upper(p_type), '_', CAST(p_partkey % 4 AS STRING)) WHEN p_partkey % 17 = 0 THEN 'History' ELSE p_type END AS name FROM part")
    return names.unique(rows, ["book"], ["pos"], "name", scratch(spark))


_FINAL = """SELECT md.doc_id, name AS id, CASE WHEN md.doc_id % 5 = 0 THEN '' WHEN md.doc_id % 5 = 1 THEN 'cancelada' ELSE 'vigente' END AS status_doc, CASE md.doc_id % 3 WHEN 0 THEN 'deu+eng' WHEN 1 THEN '' ELSE 'por' END AS idioma_ocr, 'B' AS rota_efetiva,
 concat('normas/', name, '.pdf') AS arquivo_origem, CASE WHEN md.doc_id % 6 = 0 THEN '1234567890' ELSE md5(name) END AS sha256_origem, CAST(pages AS VARCHAR(9)) AS paginas, CASE WHEN md.doc_id % 2 = 0 THEN '' ELSE '91.5' END AS conf_ocr_media,
 CASE WHEN md.doc_id % 4 = 0 THEN 'pendente' ELSE 'ok' END AS st_limpeza, CASE WHEN md.doc_id % 7 = 0 THEN 'Cargas: vento' WHEN md.doc_id % 7 = 1 THEN '' END AS c_titulo, CASE WHEN md.doc_id % 9 = 0 THEN 'NBR 1:2' END AS c_codigo,
 CASE WHEN md.doc_id % 11 = 0 THEN replace(md, '<!-- p.', '<!-- q.') ELSE md END AS md FROM md JOIN doc_id_row ON md.doc_id = doc_id_row.doc_id"""
_QUOTE = "chr(39)"


@query(f"""WITH s AS ({_FINAL}), t AS (SELECT *, string_split(id, '-') AS t FROM s), p AS (SELECT *, t[1] AS issuer, CASE WHEN regexp_matches(t[2], '^(19|20)\\d{{2}}$') THEN '' ELSE regexp_replace(t[2], '^(.*?[A-Za-z]{{2}})(\\d)', '\\1 \\2') END AS code, CASE WHEN regexp_matches(t[2], '^(19|20)\\d{{2}}$') THEN 2 ELSE 3 END AS y,
   len(list_distinct(regexp_extract_all(md, '<!-- p\\.(\\d+) -->', 1))) AS marked, CAST(paginas AS INT) AS n, CASE WHEN status_doc = '' THEN 'nao_declarado' ELSE status_doc END AS st FROM t),
 f AS (SELECT *, CASE WHEN st_limpeza <> 'ok' THEN 'pendente' WHEN marked = 0 THEN 'falhou' ELSE 'ok' END AS state, concat('---', chr(10), 'id: ', id, chr(10), 'emissor: ', issuer, chr(10), 'codigo: ', CASE WHEN c_codigo IS NOT NULL THEN c_codigo WHEN code = '' THEN repeat({_QUOTE}, 2) ELSE code END, chr(10), 'ano: ', t[y], chr(10),
   'status: ', st, chr(10), 'idioma: ', CASE WHEN id LIKE '%-PT' THEN 'pt-BR' WHEN id LIKE '%-EN' THEN 'en' WHEN issuer = 'ABNT' THEN 'pt-BR' WHEN idioma_ocr = 'deu+eng' THEN 'de' WHEN idioma_ocr = 'por' THEN 'pt-BR' ELSE 'en' END, chr(10),
   'titulo: ', CASE WHEN c_titulo <> '' THEN concat({_QUOTE}, c_titulo, {_QUOTE}) ELSE array_to_string(list_filter(t[y + 1:], lambda x: x NOT IN ('PROJETO', 'CANCELADA', 'PT', 'EN', '2ED')), ' ') END, chr(10), 'rota: B', chr(10), 'origem: ', arquivo_origem, chr(10),
   'origem_sha256: ', CASE WHEN regexp_matches(sha256_origem, '^\\d+$') THEN concat({_QUOTE}, sha256_origem, {_QUOTE}) ELSE sha256_origem END, chr(10), 'paginas: ', n, chr(10), 'confianca_ocr: ', concat({_QUOTE}, CASE WHEN conf_ocr_media = '' THEN 'n/a' ELSE conf_ocr_media END, {_QUOTE}), chr(10), '---', chr(10), chr(10), md) AS final FROM p)
 SELECT doc_id, state, CASE WHEN state = 'ok' THEN sha256(final) END AS final_sha, CASE WHEN state = 'ok' THEN concat(marked, '/', n, ' paginas com ancora (', CAST(round_even(marked / CAST(n AS DOUBLE) * 100, 0) AS BIGINT), '%), status ', st) ELSE '' END AS summary,
 CASE state WHEN 'pendente' THEN 'aguarda limpar (etapa 5)' WHEN 'falhou' THEN 'documento sem ancora <!-- p.N -->: sem rastreabilidade norma -> item -> pagina'
   ELSE concat_ws('; ', CASE WHEN marked / CAST(n AS DOUBLE) < 0.9e0 THEN concat(n - marked, ' paginas sem ancora') END, CASE WHEN st = 'nao_declarado' THEN 'status nao declarado: ponha `status` no override' END, CASE WHEN coalesce(c_titulo, '') = '' THEN 'titulo derivado do nome do arquivo: ponha `titulo` no override' END) END AS warning FROM f""")
def q_front_whole(spark, sf_dir):
    """Final texts under their whole front matter, with the stage's states, summaries and warnings."""
    rows = qa.with_metadata(frame(spark, sf_dir, _FINAL))
    return rows.select("doc_id", "state", F.sha2("final", 256).alias("final_sha"), "summary", "warning")
