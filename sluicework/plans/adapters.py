"""Deterministic views of the star-schema tables in the shapes that the operators take.

One SQL text serves Spark and the oracle's dialect; `series(d, n)` is the only thing that differs.
Doubles are written with an exponent so that no engine reads them as decimals.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Fixed values of the synthetic bank: base flow, head and efficiency of each size; scales of each maker; standard motors in kW.
FLOWS = (4.0, 7.0, 12.0, 20.0, 35.0, 60.0, 95.0)
HEADS = (32.0, 30.0, 28.0, 25.0, 22.0, 18.0, 14.0)
ETAS = (0.55, 0.60, 0.65, 0.70, 0.74, 0.77, 0.80)
FLOW_SCALES, HEAD_SCALES, ETA_SHIFTS, SPEED_SHIFTS = (0.96, 1.00, 1.04), (1.05, 1.00, 0.96), (0.0, 0.015, 0.025), (-10.0, 0.0, 10.0)
MOTORS = (0.75, 1.1, 1.5, 2.2, 3.0, 4.0, 5.5, 7.5, 11.0, 15.0, 18.5, 22.0, 30.0, 37.0, 45.0, 55.0, 75.0)


def num(x: float) -> str:
    return f"{x!r}e0"


def series(d: str, n: int) -> str:
    return f"(SELECT explode(sequence(0, {n - 1})) AS i)" if d == "spark" else f"(SELECT unnest(range({n}))::INT AS i)"


def pick(column: str, values: tuple[float, ...]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {num(v)}" for k, v in enumerate(values)) + " END"


def ladder(power: str) -> str:
    """The least standard motor with 18 percent to spare, or the next five kW above 20 percent."""
    return "CASE " + " ".join(f"WHEN {num(v)} >= ({power}) * 1.18e0 THEN {num(v)}" for v in MOTORS) + f" ELSE ceil(({power}) * 1.2e0 / 5e0) * 5e0 END"


def ctes(d: str) -> dict[str, str]:
    """name -> SELECT of each view; later ones may use earlier ones."""
    return {
        "size_row": f"""SELECT s_suppkey AS unit_id, n_name AS maker, CAST(s_suppkey % 7 AS INT) AS size_class, CAST(s_nationkey % 3 AS INT) AS maker_class,
            {pick("s_suppkey % 7", FLOWS)} * {pick("s_nationkey % 3", FLOW_SCALES)} AS qbep,
            {pick("s_suppkey % 7", HEADS)} * {pick("s_nationkey % 3", HEAD_SCALES)} AS hbep,
            least(0.86e0, {pick("s_suppkey % 7", ETAS)} + {pick("s_nationkey % 3", ETA_SHIFTS)}) AS etabep,
            {pick("s_nationkey % 3", ETA_SHIFTS)} AS eta_shift, {pick("s_nationkey % 3", SPEED_SHIFTS)} AS speed_shift
            FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
        "unit": f"""SELECT unit_id, maker, size_class, maker_class, qbep, hbep, etabep,
            CASE WHEN size_class < 2 THEN 2 ELSE 4 END AS poles, 60e0 AS base_freq,
            CASE WHEN size_class < 2 THEN 3505e0 ELSE 1755e0 END + speed_shift AS base_speed,
            least(0.95e0, 0.8e0 + (size_class + 1) * 0.018e0 + eta_shift / 2e0) AS motor_eff,
            {ladder("qbep * 9.7850753700000012e-3 * hbep / etabep")} AS motor_kw,
            210e0 + qbep * 2.1e0 + (size_class + 1) * 5e0 AS submergence_mm, 145e0 + qbep * 0.7e0 AS axis_mm,
            CASE WHEN unit_id % 11 = 0 THEN NULL ELSE 2.2e0 END AS npsh_bep FROM size_row""",
        "curve_pt": f"""SELECT unit_id, i, qbep * (i * 0.05e0) AS q, hbep * (1.35e0 - 0.35e0 * pow(i * 0.05e0, 2)) AS h,
            etabep * greatest(0e0, 1e0 - pow(i * 0.05e0 - 1e0, 2)) AS eta,
            CASE WHEN unit_id % 11 = 0 THEN NULL ELSE 0.35e0 + 0.75e0 * (i * 0.05e0) + 1.1e0 * pow(i * 0.05e0, 2) END AS npsh
            FROM unit CROSS JOIN {series(d, 31)} AS steps""",
        "request": """SELECT CAST(substr(p_brand, 7) AS INT) * 100 + p_size AS req_id, 2e0 + 1.8e0 * p_size AS qref, 8e0 + max(p_partkey) % 25 AS href, 0.2e0 * (8e0 + max(p_partkey) % 25) AS hstat,
            CAST(min(p_partkey) % 1500 AS DOUBLE) AS altitude, 0.01e0 * (count(*) % 40) AS loss FROM part GROUP BY p_brand, p_size""",
        "system": """SELECT r_regionkey * 3 + k AS sys_id, r_name AS region, name, 10e0 + 9e0 * r_regionkey AS qnom,
            k * 1.7e0 + 0.4e0 * r_regionkey AS dg, k * 1.7e0 + 0.4e0 * r_regionkey + 11e0 + k AS amt
            FROM region CROSS JOIN (SELECT 0 AS k, 'minimum' AS name UNION ALL SELECT 1, 'nominal' UNION ALL SELECT 2, 'maximum') AS kinds""",
        "series_pt": ("SELECT user_id AS curve, unix_micros(CAST(ts AS TIMESTAMP)) AS at_us, value AS y FROM events" if d == "spark" else "SELECT user_id AS curve, epoch_us(ts) AS at_us, value AS y FROM events"),
        "series": """SELECT s.curve, CAST(s.at_us - t.t0 AS DOUBLE) / 1000000e0 AS x, s.y FROM series_pt s CROSS JOIN (SELECT min(at_us) AS t0 FROM series_pt) t""",
        "catalog": """SELECT p_partkey AS code, concat(p_brand, '-', CAST(p_size AS VARCHAR(12))) AS family, p_type AS material, p_brand AS type, p_name AS title, p_partkey AS line FROM part""",
        "items": """SELECT l_partkey AS code, CASE WHEN l_partkey % 13 = 0 THEN 0e0 ELSE sum(l_quantity) END AS quantity FROM lineitem GROUP BY l_partkey""",
        "doc_id_row": """SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'ABNT' WHEN 1 THEN 'DIN' WHEN 2 THEN 'ASCE' ELSE 'ISO' END, '-',
            CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('NBR', CAST(1000 + doc_id % 900 AS VARCHAR(12)), '-') END,
            CAST(1950 + doc_id % 75 AS VARCHAR(12)), '-', lower(source), '-', lang,
            CASE doc_id % 6 WHEN 0 THEN '-PT' WHEN 1 THEN '-EN' WHEN 2 THEN '-PROJETO' WHEN 3 THEN '-CANCELADA' ELSE '' END) AS name, lang, source FROM documents""",
        "prev_row": """SELECT doc_id, concat('doc-', CAST(doc_id AS VARCHAR(20))) AS id, md5(concat('v1-', CAST(doc_id AS VARCHAR(20)))) AS sha,
            CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'ERRO' WHEN 2 THEN 'C' WHEN 3 THEN 'B' ELSE 'A' END AS route,
            CASE doc_id % 3 WHEN 0 THEN 'triagem=1;ocr=1;estrutura=2' WHEN 1 THEN 'triagem=1' ELSE '' END AS versions,
            CASE doc_id % 5 WHEN 0 THEN 'pendente' WHEN 1 THEN 'falhou' ELSE 'ok' END AS st_ocr,
            CASE doc_id % 4 WHEN 0 THEN 'pendente' ELSE 'ok' END AS st_estrutura,
            CASE doc_id % 6 WHEN 0 THEN 'falhou' ELSE 'pulado' END AS st_tabelas,
            CASE doc_id % 8 WHEN 0 THEN 'pendente' ELSE 'ok' END AS st_limpeza,
            CASE doc_id % 9 WHEN 0 THEN 'pendente' ELSE 'ok' END AS st_metadados,
            CASE WHEN doc_id % 2 = 0 THEN 'manual note | [ocr] old message' ELSE '' END AS note,
            1 + doc_id % 40 AS pages FROM documents""",
        "known_row": "SELECT id, sha FROM prev_row WHERE doc_id % 20 <> 3",
        "stage_row": "SELECT p.*, 'visto' AS qa, d.text FROM prev_row p JOIN documents d ON p.doc_id = d.doc_id",
        "now_row": """SELECT CASE WHEN doc_id % 20 = 7 THEN concat('new-', CAST(doc_id AS VARCHAR(20))) ELSE concat('doc-', CAST(doc_id AS VARCHAR(20))) END AS id,
            CASE WHEN doc_id % 20 = 5 THEN md5(concat('v2-', CAST(doc_id AS VARCHAR(20)))) ELSE md5(concat('v1-', CAST(doc_id AS VARCHAR(20)))) END AS sha
            FROM documents WHERE doc_id % 20 <> 11""",
        "md": """SELECT doc_id, 1 + doc_id % 5 AS pages,
            concat_ws(chr(10), '4.1 Escopo geral do documento', '4.2 Premissas adotadas aqui', '4.3 Criterios de projeto usados', '4.5 Resultado final obtido', '4.8\u00a0Anexo normativo geral', '4.9 Anexo informativo geral', '20.6 MPa limite', '8.2 Estado limite geral ....... 30', '3.6 B8T codigo de material', 'x = 3.1 Valor escrito', text) AS src,
            concat_ws(chr(10), '# Documento', '<!-- p.1 -->', '## 4.1 Escopo geral do documento', CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '4.2 Premissas adotadas aqui' END, CASE WHEN doc_id % 4 = 0 THEN 'ver item 4.3, abaixo' ELSE '- 4.3 Criterios de projeto usados' END, '4.7 Resultado final obtido', 'conforme 4.8\u2003anexo', CASE WHEN doc_id % 2 = 0 THEN '- 4.9\u00a0Anexo informativo geral' END,
            'texto supor-', '  tar a carga', 'O  fator   parcial', '| a  b |', CASE WHEN doc_id % 2 = 0 THEN '<!-- p.2 -->' END, CASE WHEN doc_id % 7 = 0 THEN 'Exclusive copy of someone' END, '', '', '',
            '<!-- formula 1 -->', CASE WHEN doc_id % 2 = 0 THEN '![formula](f1.png)' END, CASE WHEN doc_id % 5 = 0 THEN '`2 s q =`' ELSE '`a = b + c`' END, '3 Generalidades', text) AS md FROM documents""",
        "md_line": (
            "SELECT doc_id, line_no, line FROM (SELECT doc_id, posexplode(split(md, '\\n')) AS (line_no, line) FROM md) AS l"
            if d == "spark"
            else "SELECT doc_id, CAST(unnest(range(len(string_split(md, chr(10))))) AS INT) AS line_no, unnest(string_split(md, chr(10))) AS line FROM md"
        ),
        "page": "SELECT conv_id AS doc, turn + 1 AS page, CASE WHEN conv_id % 4 = 0 AND turn > 1 THEN '' WHEN conv_id % 4 = 1 THEN concat(text, ' ', text, ' ', text, ' ', text) ELSE text END AS text FROM conversations",
        "judged": """SELECT doc_id, pages, src AS source, concat(CASE doc_id % 8 WHEN 0 THEN '' ELSE concat('---', chr(10), 'emissor: ABNT', chr(10), 'codigo: ', CASE WHEN doc_id % 8 = 1 THEN '' ELSE 'NBR 1' END, chr(10), 'ano: ', CASE WHEN doc_id % 8 = 2 THEN 'null' ELSE '1999' END, chr(10),
            'status: vigente', chr(10), 'idioma: en', chr(10), 'titulo: ', chr(39), 'A: b', chr(39), chr(10), 'rota: A', chr(10), 'origem_sha256: ab12', chr(10), 'paginas: 3', chr(10), 'confianca_ocr: ', chr(39), 'n/a', chr(39), chr(10), '---', chr(10)) END, md) AS md,
            CASE doc_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END AS route, CASE doc_id % 7 WHEN 0 THEN 'F' WHEN 1 THEN 'G+F' WHEN 2 THEN 'G' ELSE '' END AS extras,
            CASE doc_id % 4 WHEN 0 THEN '80.5' WHEN 1 THEN '' WHEN 2 THEN 'n/a' ELSE '91' END AS confidence, CASE WHEN doc_id % 3 = 0 THEN 'falhou' ELSE 'ok' END AS table_state,
            CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE CAST(doc_id % 5 AS VARCHAR(9)) END AS tables, doc_id % 2 AS n_low, doc_id % 6 AS layout_tables, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'nao_declarado' ELSE 'vigente' END AS status FROM md""",
        "triaged": """SELECT doc_id, text, (doc_id % 20) / 20e0 AS images, doc_id % 17 = 0 AS layer, CASE doc_id % 13 WHEN 0 THEN 'Acrobat 4.0 Capture' WHEN 1 THEN 'acrobat distiller 3.01' WHEN 2 THEN 'Acrobat Distiller 9' ELSE 'pdfTeX' END AS producer FROM documents""",
        "override": "SELECT doc_id, CASE WHEN quality = 0 THEN 'D' ELSE '' END AS route, CASE WHEN toxic = 1 THEN 'por' END AS language, CASE WHEN doc_id % 10 = 0 THEN 'X' WHEN doc_id % 10 = 1 THEN 'F' ELSE 'G' END AS extra FROM labels",
    }


def with_views(d: str, sql: str) -> str:
    """The query with the views that it needs in front."""
    all_views = ctes(d)
    needed: list[str] = []

    def visit(text: str, within: tuple[str, ...]) -> None:
        for name in all_views:
            if name not in within and name not in needed and re.search(rf"\b{name}\b", text):
                visit(all_views[name], (*within, name))
                needed.append(name)

    visit(sql, ())
    head = ", ".join(f"{n} AS ({all_views[n]})" for n in needed)
    if not head:
        return sql
    return f"WITH {head}, {sql[5:]}" if sql.lstrip().upper().startswith("WITH ") else f"WITH {head} {sql}"


def tables(spark: SparkSession, sf_dir: str, sql: str) -> None:
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


_SCRATCH: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads again: below the shared one that the cluster names, or a temporary one where all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _SCRATCH:
            _SCRATCH.append(tempfile.mkdtemp(prefix="sluicework-"))
            atexit.register(shutil.rmtree, _SCRATCH[0], ignore_errors=True)
        base = _SCRATCH[0]
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a query over the views."""
    full = with_views("spark", sql)
    tables(spark, sf_dir, full)
    return spark.sql(full)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frame(spark, sf_dir, f"SELECT * FROM {name}")
