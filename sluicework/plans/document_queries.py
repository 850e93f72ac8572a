"""Queries of the document, manifest, quality and bill-of-materials families, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import manifest as mf, materials as bom, quality as qa, stages, text as tx, validation as val
from ..operators.curves import held
from ..sources import files, workbooks
from ..streaming import capture
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


# --- bills of materials ---------------------------------------------------------------------------


@query("SELECT type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT family) AS BIGINT) AS families, min(line) AS first_line FROM catalog GROUP BY type")
def q_bom_scan(spark, sf_dir):
    """The catalogue written as workbooks, one a task, and its sheet read again under a schema."""
    workbooks.register(spark)
    path = scratch(spark)
    view(spark, sf_dir, "catalog").select("code", "family", "material", "type", "title", "line").write.format("workbook").option("sheet", "Catalogo").mode("append").save(path)
    rows = spark.read.format("workbook").schema("type string, family string, line bigint").option("sheet", "Catalogo").load(path)
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("family").alias("families"), F.min("line").alias("first_line"))


_BAD = """SELECT line, CASE WHEN code % 500 = 0 THEN 1 ELSE code END AS code, concat('C', CAST(CASE WHEN code % 700 = 0 THEN 7 ELSE code END AS VARCHAR(12))) AS client, CASE WHEN code % 333 = 0 THEN concat('#', family) ELSE family END AS family, material, type,
 CASE WHEN code % 250 = 0 THEN '  ' ELSE title END AS title, CASE WHEN code % 400 = 0 THEN '' ELSE concat('r', CAST(code % 2 AS VARCHAR(9))) END AS ref, type AS descr FROM catalog"""
_CELLS = """SELECT code AS line, CASE WHEN code % 90 = 1 THEN ' ' WHEN code % 90 = 2 THEN 'X1' ELSE CAST(code AS VARCHAR(12)) END AS code, CASE code % 50 WHEN 0 THEN 's' WHEN 1 THEN 'b' ELSE 'n' END AS kind,
 CASE code % 50 WHEN 2 THEN 'NaN' WHEN 3 THEN '-1.5' WHEN 4 THEN 'Infinity' WHEN 5 THEN NULL WHEN 6 THEN 'x' ELSE CAST(quantity AS VARCHAR(30)) END AS value FROM items"""
_REQUIRED, _SHARED = ("code", "client", "family", "material", "type", "title", "descr"), ("material", "type", "title", "ref", "descr")


@query(
    f"""WITH b AS ({_BAD}), t AS (SELECT line, {", ".join(f"trim(CAST({c} AS VARCHAR)) AS {c}" for c in ("code", "client", "family", "material", "type", "title", "ref", "descr"))} FROM b), c AS ({_CELLS}), n AS (SELECT *, trim(code) AS k, TRY_CAST(value AS DOUBLE) AS v FROM c) """
    + " UNION ALL ".join(
        [f"SELECT 'blank' AS problem, '{c}' AS field, CAST(line AS VARCHAR) AS key FROM t WHERE {c} = ''" for c in _REQUIRED]
        + [f"SELECT 'duplicate', '{c}', {c} FROM t WHERE {c} <> '' GROUP BY {c} HAVING count(*) > 1" for c in ("code", "client")]
        + [f"SELECT 'inconsistent', '{c}', family FROM t GROUP BY family HAVING count(DISTINCT {c}) > 1" for c in _SHARED]
        + ["SELECT DISTINCT 'illegal', 'family', family FROM t WHERE NOT regexp_matches(family, '^[A-Za-z0-9][A-Za-z0-9_-]*$')"]
        + ["SELECT 'blank', 'quantity', CAST(line AS VARCHAR) FROM n WHERE k = ''", "SELECT 'not_numeric', 'quantity', k FROM n WHERE kind <> 'n' OR v IS NULL", "SELECT 'not_finite', 'quantity', k FROM n WHERE kind = 'n' AND (isnan(v) OR isinf(v))"]
        + ["SELECT 'negative', 'quantity', k FROM n WHERE kind = 'n' AND NOT isnan(v) AND NOT isinf(v) AND v < 0", "SELECT 'duplicate', 'quantity', k FROM n WHERE k <> '' GROUP BY k HAVING count(*) > 1"]
    )
)
def q_bom_lint(spark, sf_dir):
    """Faults of a catalogue and of the quantities of an issue."""
    found = val.catalogue(frame(spark, sf_dir, _BAD), _REQUIRED, "code", "client", "family", _SHARED)
    return found.unionByName(val.quantities(frame(spark, sf_dir, _CELLS)))


def _chosen(spark, sf_dir) -> DataFrame:
    return bom.select(view(spark, sf_dir, "catalog"), view(spark, sf_dir, "items"))


@query("SELECT c.code, family, material, type, quantity FROM catalog c JOIN items i ON c.code = i.code WHERE quantity > 0")
def q_bom_select(spark, sf_dir):
    return _chosen(spark, sf_dir).select("code", "family", "material", "type", "quantity")


@query("SELECT material, type, family, CAST(count(*) AS BIGINT) AS n, min(line) AS first_line, string_agg(CAST(c.code AS VARCHAR), ',' ORDER BY line, c.code) AS codes FROM catalog c JOIN items i ON c.code = i.code WHERE quantity > 0 GROUP BY material, type, family")
def q_bom_tree(spark, sf_dir):
    return bom.families(_chosen(spark, sf_dir))


@query("""WITH f AS (SELECT DISTINCT family FROM catalog), img AS (SELECT DISTINCT lower(family) AS stem FROM catalog WHERE code % 3 = 0) SELECT f.family, CASE WHEN stem IS NULL THEN 'imgs/handler.jpg' ELSE concat('figs/', stem, '.pdf') END AS image, stem IS NULL AS warned FROM f LEFT JOIN img ON lower(f.family) = stem""")
def q_bom_image(spark, sf_dir):
    c = view(spark, sf_dir, "catalog")
    images = c.where("code % 3 = 0").select(F.lower("family").alias("stem")).distinct().withColumn("path", F.concat(F.lit("figs/"), "stem", F.lit(".pdf")))
    return bom.pictures(c.select("family").distinct(), images)


@query("SELECT code, quantity FROM items WHERE code NOT IN (SELECT code FROM catalog WHERE code % 6 <> 0)")
def q_unknown_codes(spark, sf_dir):
    return bom.unknown(view(spark, sf_dir, "catalog").where("code % 6 <> 0"), view(spark, sf_dir, "items"))


@query("SELECT code, replace(regexp_replace(regexp_replace(CAST(CAST(quantity / 8e0 AS DECIMAL(38,18)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), '.', ',') AS shown FROM items")
def q_quantity_format(spark, sf_dir):
    return view(spark, sf_dir, "items").select("code", tx.quantity(F.col("quantity") / 8).alias("shown"))


_TEX = "concat(p_name, ' & 50% of #', CAST(p_partkey AS VARCHAR(12)), '_{', p_brand, '}~^')"


@query(f"SELECT p_partkey AS code, replace(replace(replace(replace(replace(replace(replace(replace(replace({_TEX}, '{{', chr(1)), '}}', chr(2)), '&', '\\&'), '%', '\\%'), '#', '\\#'), '_', '\\_'), '~', '\\textasciitilde{{}}'), '^', '\\textasciicircum{{}}'), chr(1), '\\{{') AS half FROM part")
def q_latex_escape(spark, sf_dir):
    done = frame(spark, sf_dir, f"SELECT p_partkey AS code, {_TEX} AS t FROM part").select("code", tx.latex_escape(F.col("t")).alias("half"))
    return done.withColumn("half", F.expr(r"replace(half, '\\}', chr(2))"))


@query("SELECT DISTINCT family, concat('fam-', left(sha256(family), 16)) AS anchor FROM catalog")
def q_anchor_hash(spark, sf_dir):
    return view(spark, sf_dir, "catalog").select("family", tx.anchor_id("fam", F.col("family")).alias("anchor")).distinct()


_FILES = "SELECT concat('d/', CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END, CAST(doc_id % 50 AS VARCHAR(12))) AS stem, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'jpg' WHEN 3 THEN 'jpeg' ELSE 'txt' END AS ext, doc_id FROM documents"


@query(f"WITH f AS (SELECT *, CASE ext WHEN 'pdf' THEN 0 WHEN 'png' THEN 1 WHEN 'jpg' THEN 2 WHEN 'jpeg' THEN 3 END AS prio, concat(stem, '.', ext) AS path FROM ({_FILES})), r AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY prio, lower(path), path) AS n FROM f WHERE prio IS NOT NULL) SELECT lower(stem) AS stem, path FROM r WHERE n = 1")
def q_image_pick(spark, sf_dir):
    """The first file of each stem by kind, then name."""
    return bom.pick_images(frame(spark, sf_dir, _FILES).select(F.concat("stem", F.lit("."), "ext").alias("path")))


# --- ids ------------------------------------------------------------------------------------------

#: Accented letters of the corpus's languages, for the SQL alone (fixed values).
_ACCENTED, _PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
_ACCENT = f"translate({{0}}, '{_ACCENTED}', '{_PLAIN}')"
_SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _ACCENT.format("text") + ", '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9.]+', '-', 'g'), '-{2,}', '-', 'g'), '\\.{2,}', '.', 'g'), '^[-.]+|[-.]+$', '', 'g')"


@query(f"SELECT doc_id, {_SLUG} AS slug FROM documents")
def q_slug(spark, sf_dir):
    return frame(spark, sf_dir, "SELECT doc_id, text FROM documents").select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query("SELECT doc_id, regexp_matches(name, '^[A-Z]+-([A-Za-z0-9.-]+-)?(19|20)\\d{2}-[A-Za-z0-9][A-Za-z0-9.-]*$') AS fits FROM doc_id_row")
def q_name_lint(spark, sf_dir):
    return view(spark, sf_dir, "doc_id_row").select("doc_id", tx.name_fits(F.col("name")).alias("fits"))


@query("""WITH t AS (SELECT doc_id, string_split(name, '-') AS t FROM doc_id_row) SELECT doc_id, t[1] AS issuer, CASE WHEN regexp_matches(t[2], '^(19|20)\\d{2}$') THEN '' ELSE regexp_replace(t[2], '^(.*?[A-Za-z]{2})(\\d)', '\\1 \\2') END AS code, CASE WHEN regexp_matches(t[2], '^(19|20)\\d{2}$') THEN t[2] ELSE t[3] END AS year FROM t""")
def q_id_parts(spark, sf_dir):
    issuer, code, year = tx.id_parts(F.col("name"))
    return view(spark, sf_dir, "doc_id_row").select("doc_id", issuer.alias("issuer"), code.alias("code"), year.alias("year"))


_NAMED = "SELECT doc_id, name, CASE WHEN doc_id % 10 = 0 THEN 'fr' END AS curated FROM doc_id_row"


@query(f"WITH n AS ({_NAMED}), r AS (SELECT *, CASE WHEN name LIKE '%-PT' THEN 'por' WHEN name LIKE '%-EN' THEN 'eng' WHEN name LIKE 'ABNT%' THEN 'por' WHEN name LIKE 'DIN%' THEN 'deu+eng' ELSE 'eng' END AS recognised FROM n) SELECT doc_id, recognised, CASE WHEN curated IS NOT NULL THEN curated WHEN name LIKE '%-PT' THEN 'pt-BR' WHEN name LIKE '%-EN' THEN 'en' WHEN name LIKE 'ABNT%' THEN 'pt-BR' WHEN recognised = 'deu+eng' THEN 'de' ELSE 'en' END AS language FROM r")
def q_doc_language(spark, sf_dir):
    """The language that a text is recognised in, and that of the document, which may be curated."""
    c = F.col
    return frame(spark, sf_dir, _NAMED).withColumn("recognised", tx.language(c("name"))).select("doc_id", "recognised", qa.document_language(c("name"), c("recognised"), c("curated")).alias("language"))


@query("SELECT doc_id, CASE WHEN name LIKE '%-PT' OR name LIKE '%-EN' THEN 'traducao' WHEN name LIKE '%-PROJETO' THEN 'projeto' WHEN name LIKE '%-CANCELADA' THEN 'cancelada' ELSE '' END AS status FROM doc_id_row")
def q_doc_status(spark, sf_dir):
    return view(spark, sf_dir, "doc_id_row").select("doc_id", tx.status(F.col("name")).alias("status"))


@query("SELECT doc_id, concat(lower(source), ' ', lang) AS title FROM doc_id_row")
def q_doc_title(spark, sf_dir):
    return view(spark, sf_dir, "doc_id_row").select("doc_id", tx.title(F.col("name")).alias("title"))


# --- text -----------------------------------------------------------------------------------------

_REMOVED, _BLOCKED, _SPANS = ("^Exclusive copy", "^The "), (r"Exclusive[^\n]*", r"fator +parcial"), (r"\s*texto supor", r"supor|\ba\b")
_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_HIT = " OR ".join(f"regexp_matches({_STRIPPED.format('line')}, '{p}')" for p in _REMOVED)
_ANCHORED = "regexp_matches(line, '<!-- p\\.(\\d+) -->')"
_LAST = "line = '' AND line_no = max(line_no) OVER (PARTITION BY doc_id)"


def _md(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "md")


_CLEAN = f"WITH l AS (SELECT *, {_LAST} AS last FROM md_line), k AS (SELECT *, NOT {_ANCHORED} AND ({_HIT}) AS gone FROM l WHERE NOT last), t AS (SELECT *, len(regexp_extract_all(line, '{_SPANS[0]}')) + len(regexp_extract_all(regexp_replace(line, '{_SPANS[0]}', '', 'g'), '{_SPANS[1]}')) AS spans FROM k) "


@query(_CLEAN + "SELECT doc_id, CAST(count(*) AS INT) AS lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS INT) AS removed, CAST(sum(CASE WHEN gone THEN 0 ELSE spans END) AS INT) AS spans FROM t GROUP BY doc_id")
def q_clean_lines(spark, sf_dir):
    """Lines that go whole, and spans that go from within lines."""
    m = qa.cleaned(F.col("md"), _REMOVED, _SPANS)
    return _md(spark, sf_dir).select("doc_id", m["lines"].alias("lines"), m["removed"].alias("removed"), m["spans"].alias("spans"))


@query("SELECT doc_id, md5(regexp_replace(md, '([\\p{L}\\p{N}_])-[ \\t]*\\n[ \\t]*([a-zà-ÿ])', '\\1\\2', 'g')) AS digest, CAST(len(regexp_extract_all(md, '[\\p{L}\\p{N}_]-[ \\t]*\\n[ \\t]*[a-zà-ÿ]')) AS INT) AS joined FROM md")
def q_dehyphenate(spark, sf_dir):
    hits = F.regexp_count("md", F.lit(r"[\p{L}\p{N}_]-[ \t]*\n[ \t]*[a-zà-ÿ]"))
    return _md(spark, sf_dir).select("doc_id", F.md5(tx.dehyphenate(F.col("md"))).alias("digest"), hits.alias("joined"))


@query(
    "WITH j AS (SELECT doc_id, regexp_replace(md, '([\\p{L}\\p{N}_])-[ \\t]*\\n[ \\t]*([a-zà-ÿ])', '\\1\\2', 'g') AS t FROM md), l AS (SELECT doc_id, unnest(range(len(string_split(t, chr(10))))) AS i, unnest(string_split(t, chr(10))) AS line FROM j),"
    " c AS (SELECT doc_id, i, CASE WHEN regexp_matches(line, '\\S') THEN regexp_replace(line, '\\s+$', '') ELSE line END AS line FROM l),"
    " k AS (SELECT doc_id, i, CASE WHEN regexp_matches(line, '^\\s*(\\||`|<!--|!\\[|#)') OR regexp_matches(line, '<!-- p\\.(\\d+) -->') THEN line ELSE regexp_replace(line, '(\\S)[ \\t]{2,}(\\S)', '\\1 \\2', 'g') END AS line FROM c)"
    " SELECT doc_id, md5(concat(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY i), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), chr(10))) AS digest FROM k GROUP BY doc_id"
)
def q_clean_text(spark, sf_dir):
    """Texts with words joined, blanks collapsed, ends trimmed and blank lines squeezed."""
    return _md(spark, sf_dir).select("doc_id", F.md5(qa.cleaned(F.col("md"), (), headings=False)["text"]).alias("digest"))


_BLANK, _INK = "[\\s\\p{Z}\\x1c-\\x1f\\x{85}]", "[^\\s\\p{Z}\\x1c-\\x1f\\x{85}]"
_HEAD = f"^(?:[-*]{_BLANK}+)?([1-9]\\d?(?:\\.\\d{{1,3}})*){_BLANK}+([A-ZÀ-ÖØ-Ý][^=]{{0,199}})$"


@query(f"SELECT doc_id, line_no, concat(repeat('#', CAST(least(6, 1 + len(string_split(regexp_extract(line, '{_HEAD}', 1), '.'))) AS INT)), ' ', regexp_extract(line, '{_HEAD}', 1), ' ', regexp_extract(line, '{_HEAD}', 2)) AS heading FROM md_line WHERE regexp_matches(line, '{_HEAD}')")
def q_headings(spark, sf_dir):
    lines = _md(spark, sf_dir).select("doc_id", F.posexplode(F.split("md", "\n")).alias("line_no", "line"))
    return lines.withColumn("heading", tx.heading(F.col("line"))).where("heading != line").select("doc_id", "line_no", "heading")


@query(
    f"WITH h AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^#{{1,6}} \\S') THEN len(regexp_extract(line, '^(#{{1,6}}) ', 1)) ELSE least(6, 1 + len(string_split(regexp_extract(line, '{_HEAD}', 1), '.'))) END AS level FROM md_line WHERE regexp_matches(line, '^#{{1,6}} \\S') OR regexp_matches(line, '{_HEAD}'))"
    " SELECT h.doc_id, h.line_no, CAST(h.level AS INT) AS level, max(b.line_no) AS parent_line FROM h LEFT JOIN h b ON b.doc_id = h.doc_id AND b.line_no < h.line_no AND b.level < h.level GROUP BY ALL"
)
def q_section_tree(spark, sf_dir):
    """Each heading under the heading that it stands below, numbered items being headings too."""
    lines = _md(spark, sf_dir).select("doc_id", F.posexplode(F.split("md", "\n")).alias("line_no", "line"))
    return tx.sections(lines.withColumn("line", tx.heading(F.col("line"))))


@query("WITH a AS (SELECT doc_id, line_no, TRY_CAST(nullif(regexp_extract(line, '<!-- p\\.(\\d+) -->', 1), '') AS INT) AS p FROM md_line), f AS (SELECT doc_id, last_value(p IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS page FROM a) SELECT doc_id, coalesce(page, 0) AS page, CAST(count(*) AS BIGINT) AS lines FROM f GROUP BY ALL")
def q_page_ffill(spark, sf_dir):
    lines = _md(spark, sf_dir).select("doc_id", F.posexplode(F.split("md", "\n")).alias("line_no", "line"))
    p = F.nullif(F.regexp_extract("line", tx.ANCHOR, 1), F.lit("")).cast("int")
    filled = lines.select("doc_id", F.last(p, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)).alias("page"))
    return filled.groupBy("doc_id", F.coalesce("page", F.lit(0)).alias("page")).agg(F.count("*").alias("lines"))


@query("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(md, '<!-- p\\.(\\d+) -->', 1))) AS INT) AS anchors, round(len(list_distinct(regexp_extract_all(md, '<!-- p\\.(\\d+) -->', 1))) / CAST(pages AS DOUBLE), 6) AS coverage FROM md")
def q_anchor_coverage(spark, sf_dir):
    n = F.size(F.array_distinct(F.regexp_extract_all("md", F.lit(tx.ANCHOR), F.lit(1))))
    return _md(spark, sf_dir).select("doc_id", n.alias("anchors"), F.round(n / F.col("pages"), 6).alias("coverage"))


@query("SELECT doc_id, concat_ws('|', nullif(left(regexp_extract(md, 'Exclusive[^\\n]*', 0), 40), ''), nullif(left(regexp_extract(md, 'fator +parcial', 0), 40), '')) AS found FROM md")
def q_blocked_patterns(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.array_join(qa.blocked(F.col("md"), _BLOCKED), "|").alias("found"))


_REDACT = ("[0-9]{2}", "^view")


@query("WITH e AS (SELECT event_id, props AS t1, event_type AS o1, '' AS t2, event_type AS o2, CASE WHEN event_id % 2 = 0 THEN props END AS t3 FROM events) SELECT event_id, CASE WHEN regexp_matches(t1, '[0-9]{2}|^view') THEN '[redacted by a rule of the profile]' ELSE t1 END AS text, CASE WHEN regexp_matches(t1, '[0-9]{2}|^view') THEN '[redacted by a rule of the profile]' ELSE o1 END AS orig, t2 AS second_text, CASE WHEN regexp_matches(o2, '[0-9]{2}|^view') THEN '[redacted by a rule of the profile]' ELSE o2 END AS second_orig, CASE WHEN regexp_matches(t3, '[0-9]{2}|^view') THEN '[redacted by a rule of the profile]' ELSE t3 END AS third FROM e")
def q_json_redact(spark, sf_dir):
    """Layouts whose texts, or originals where there is no text, hit a rule: both fields go, boxes stay."""
    rows = frame(spark, sf_dir, "SELECT event_id, to_json(named_struct('texts', array(named_struct('text', props, 'orig', event_type, 'page', 1), named_struct('text', '', 'orig', event_type, 'page', 2), named_struct('text', CASE WHEN event_id % 2 = 0 THEN props END, 'orig', CAST(NULL AS STRING), 'page', 3)))) AS layout FROM events")
    texts = F.from_json("layout", "texts array<struct<text:string,orig:string,page:int>>")["texts"]
    done = rows.select("event_id", qa.redacted_layout(texts, _REDACT).alias("t"))
    at = lambda i, f: F.get("t", F.lit(i))[f]
    return done.select("event_id", at(0, "text").alias("text"), at(0, "orig").alias("orig"), at(1, "text").alias("second_text"), at(1, "orig").alias("second_orig"), at(2, "text").alias("third"))


_FURNITURE = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '3.2 Escopo' WHEN 1 THEN 'pagina 3' WHEN 2 THEN '4 Geral' ELSE '0.1 Nada' END AS a, CASE WHEN doc_id % 3 = 0 THEN 'body' ELSE 'furniture' END AS layer FROM documents"


@query(f"SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 4 IN (0, 2) AND layer = 'furniture' THEN concat('## ', a) END, '## 7 Fim') AS rescued FROM ({_FURNITURE})")
def q_title_rescue(spark, sf_dir):
    """Furniture that reads as a numbered title comes back as a heading."""
    item = lambda text, layer: F.struct(text.alias("text"), layer.alias("layer"))
    layout = F.array(item(F.col("a"), F.col("layer")), item(F.lit("7 Fim"), F.lit("furniture")), item(F.lit("8 Corpo"), F.lit("body")))
    return frame(spark, sf_dir, _FURNITURE).select("doc_id", F.array_join(qa.rescued_titles(layout), "|").alias("rescued"))


_ITEM = f"^(?:#{{1,6}}{_BLANK}+|[-*]{_BLANK}+)?([1-9]\\d?(?:\\.\\d{{1,3}})+){_BLANK}+([A-ZÀ-ÖØ-Ý]{_INK}*)"
_UNIT_LIST = ", ".join(f"'{u}'" for u in tx.UNITS)


def _items_sql(source: str, table: str = "md") -> str:
    return f"""SELECT doc_id, line_no, number AS item FROM (SELECT doc_id, line_no, line, trim(line) AS t, regexp_extract(line, '{_ITEM}', 1) AS number, regexp_replace(regexp_extract(line, '{_ITEM}', 2), '^[.,;:()]+|[.,;:()]+$', '', 'g') AS head,
      len(regexp_extract_all(regexp_replace(line, '{_ITEM}', '\\2'), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]')) AS letters FROM (SELECT doc_id, unnest(range(len(string_split({source}, chr(10)))))::INT AS line_no, unnest(string_split({source}, chr(10))) AS line FROM {table}))
      WHERE number <> '' AND NOT regexp_matches(t, '^(\\||`|<!--|!\\[)') AND NOT contains(t, ' = ') AND NOT regexp_matches(t, '\\.{{3,}}\\s*\\d*\\s*$|\\.{{5,}}') AND NOT regexp_matches(head, '^[A-Z0-9./-]{{2,}}$') AND head NOT IN ({_UNIT_LIST}) AND NOT contains(head, '/') AND letters >= 4"""


def _items(spark, sf_dir, source: str) -> DataFrame:
    lines = _md(spark, sf_dir).select("doc_id", F.posexplode(F.split(source, "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", tx.item(F.col("line")).alias("item")).where("item is not null")


@query(_items_sql("src"))
def q_numbered_items(spark, sf_dir):
    return _items(spark, sf_dir, "src")


@query(f"""WITH it AS ({_items_sql('md')}), p AS (SELECT DISTINCT doc_id, regexp_replace(item, '\\.\\d+$', '') AS parent, CAST(regexp_extract(item, '(\\d+)$', 1) AS INT) AS n FROM it), g AS (SELECT doc_id, parent, min(n) AS lo, max(n) AS hi, list(n) AS ns FROM p GROUP BY ALL HAVING count(*) >= 3),
 x AS (SELECT doc_id, parent, ns, CAST(unnest(range(lo, hi)) AS INT) AS missing FROM g) SELECT doc_id, parent, missing FROM x WHERE NOT list_contains(ns, missing)""")
def q_numbering_gaps(spark, sf_dir):
    found = held(held(_md(spark, sf_dir), items=qa.items(F.col("md"))), missing=qa.missing_numbers(F.col("items")))
    missing = found.select("doc_id", F.explode("missing").alias("m"))
    return missing.select("doc_id", F.regexp_replace("m", r"\.\d+$", "").alias("parent"), F.regexp_extract("m", r"(\d+)$", 1).cast("int").alias("missing"))


def _lost_sql(source: str, table: str) -> str:
    body = f"SELECT doc_id, array_to_string(list_filter(string_split(md, chr(10)), lambda x: NOT regexp_matches(x, '^{_BLANK}*[|`]')), chr(10)) AS body FROM {table}"
    return f"SELECT it.doc_id, item FROM (SELECT DISTINCT doc_id, item FROM ({_items_sql(source, table)})) it JOIN ({body}) b ON it.doc_id = b.doc_id WHERE NOT regexp_matches(body, concat('(^|[^\\d.])', replace(item, '.', '\\.'), '([\\s\\p{{Z}}\\x1c-\\x1f\\x{{85}}.)\\]:-]|$)'))"


@query(_lost_sql("src", "md"))
def q_lost_items(spark, sf_dir):
    """Items of the source that stand nowhere in the corpus as a token, tables and code left out."""
    found = held(_md(spark, sf_dir), lost=qa.lost_items(F.col("md"), F.col("src")))
    return found.select("doc_id", F.explode("lost").alias("item"))


_FORMULA = "<!-- formula[^\\n]*-->\\n(!\\[formula\\]\\([^)]+\\)\\n+)?`([^`\\n]+)`"


@query(f"WITH f AS (SELECT doc_id, regexp_extract_all(md, '{_FORMULA}', 2) AS t, regexp_extract_all(md, '{_FORMULA}', 1) AS i FROM md) SELECT doc_id, CAST(len(t) AS INT) AS total, CAST(len(list_filter(i, lambda x: x <> '')) AS INT) AS cropped, CAST(len(list_filter(t, lambda x: NOT contains(x, '=') OR trim(x) LIKE '%=')) AS INT) AS scrambled FROM f")
def q_formula_stats(spark, sf_dir):
    total, pictured, wrong = qa.formulas(F.col("md"))
    return _md(spark, sf_dir).select("doc_id", total.alias("total"), pictured.alias("cropped"), wrong.alias("scrambled"))


_COVER = "len(regexp_extract_all(md, '[\\p{L}\\p{N}_]'))"


def _wanted_sql(source: str, table: str, patterns: tuple) -> str:
    hit = " OR ".join(f"regexp_matches({_STRIPPED.format('x')}, '{p}')" for p in patterns)
    return f"SELECT doc_id, len(regexp_extract_all(array_to_string(list_filter(string_split({source}, chr(10)), lambda x: NOT ({hit})), chr(10)), '[\\p{{L}}\\p{{N}}_]')) AS wanted FROM {table}"


@query(f"WITH w AS ({_wanted_sql('src', 'md', _REMOVED)}) SELECT md.doc_id, CAST(wanted AS INT) AS wanted, round(CASE WHEN wanted > 0 THEN {_COVER} / CAST(wanted AS DOUBLE) ELSE 0e0 END, 6) AS coverage FROM md JOIN w ON md.doc_id = w.doc_id")
def q_text_coverage(spark, sf_dir):
    share, wanted = qa.coverage(F.col("md"), F.col("src"), _REMOVED)
    return _md(spark, sf_dir).select("doc_id", wanted.alias("wanted"), F.round(share, 6).alias("coverage"))


# --- triage ---------------------------------------------------------------------------------------

_PAGES = """SELECT doc, all_ - gone AS pages, below - gone AS blank, poor, round_even(1 - (below - gone) / CAST(all_ - gone AS DOUBLE), 2) AS with_text, CAST(round_even(chars / CAST(all_ - gone AS DOUBLE), 0) AS BIGINT) AS per_page FROM (SELECT doc, count(*) AS all_, sum(CASE WHEN n < 80 THEN 1 ELSE 0 END) AS below, sum(CASE WHEN n >= 80 AND n < 400 THEN 1 ELSE 0 END) AS poor, sum(n) AS chars,
 CASE WHEN arg_max(n, page) = 0 AND count(*) > 1 THEN 1 ELSE 0 END AS gone FROM (SELECT doc, page, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n FROM page) GROUP BY doc)"""


def _pages(spark, sf_dir) -> DataFrame:
    return qa.page_figures(view(spark, sf_dir, "page"))


@query(f"SELECT doc, CAST(pages AS BIGINT) AS pages, CAST(blank AS BIGINT) AS blank, CAST(poor AS BIGINT) AS poor, with_text, per_page FROM ({_PAGES})")
def q_triage_pages(spark, sf_dir):
    return _pages(spark, sf_dir)


_IMAGES = "SELECT l_orderkey AS doc, l_linenumber AS page, l_quantity * 30e0 AS width, l_quantity * 40e0 AS height, CASE WHEN l_linenumber % 5 = 4 THEN 0e0 ELSE 150e0 END AS x_ppi, 150e0 AS y_ppi FROM lineitem"
_SIZES = "SELECT o_orderkey AS doc, 1 + o_orderkey % 7 AS pages, 612e0 AS page_width, 792e0 AS page_height FROM orders"


@query(f"WITH i AS ({_IMAGES}), z AS ({_SIZES}), s AS (SELECT DISTINCT doc, greatest(1, CAST(round_even(1e0 + k * (pages - 1) / 4e0, 0) AS INT)) AS page FROM (SELECT doc, pages, unnest([0, 1, 2, 3, 4]) AS k FROM z)), m AS (SELECT i.doc, max((width / x_ppi * 72e0 / page_width) * (height / y_ppi * 72e0 / page_height)) AS m FROM i JOIN z ON i.doc = z.doc JOIN s ON s.doc = i.doc AND s.page = i.page WHERE x_ppi > 0 GROUP BY i.doc) SELECT z.doc, round_even(coalesce(m, 0e0), 2) AS images FROM z LEFT JOIN m ON z.doc = m.doc")
def q_image_coverage(spark, sf_dir):
    """The largest share of a page that a picture covers, over sampled pages."""
    return qa.image_coverage(frame(spark, sf_dir, _IMAGES), frame(spark, sf_dir, _SIZES))


_STOPS = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_TOK = "list_filter(regexp_extract_all(left(text, 400000), '[A-Za-zÀ-ÿ0-9]{3,}'), lambda x: regexp_matches(x, '[A-Za-zÀ-ÿ]'))"
_METRICS = f"""WITH t AS (SELECT doc_id, text, {_TOK} AS tok, layer, images, producer FROM triaged), m0 AS (SELECT doc_id, length(text) AS chars, len(tok) AS tokens, len(regexp_extract_all(left(text, 400000), '[\\x00-\\x08\\x0b\\x0e-\\x1f\\p{{Co}}]')) / CAST(greatest(1, length(left(text, 400000))) AS DOUBLE) AS ctrl0,
 len(list_filter(tok, lambda x: regexp_matches(x, '[a-zà-ÿ][A-ZÀ-Ý]|[A-Za-zÀ-ÿ]\\d|\\d[a-zà-ÿ]'))) / CAST(greatest(1, len(tok)) AS DOUBLE) AS dirty0, len(list_filter(tok, lambda x: lower(x) IN ({_STOPS}))) / CAST(greatest(1, len(tok)) AS DOUBLE) AS stop0, layer, images, producer FROM t),
 m AS (SELECT *, round_even(ctrl0, 3) AS ctrl, round_even(dirty0, 3) AS dirty, round_even(stop0, 3) AS stop FROM m0),
 g AS (SELECT *, dirty > 0.03e0 AND (images > 0.9e0 OR layer OR regexp_matches(producer, '(?i)Acrobat (4|5)\\.0|Acrobat Distiller (3|4|5)\\.|PDFWriter|Import Plug-in|Paper Capture')) AS suspicion FROM m) """
_ROUTE = "CASE WHEN (doc_id % 10) / 9e0 < 0.1e0 THEN 'C' WHEN ctrl > 0.02e0 OR dirty > 0.25e0 OR (tokens > 300 AND stop < 0.03e0) THEN 'D' WHEN (doc_id % 10) / 9e0 < 0.9e0 AND doc_id % 4 = 0 THEN 'E' WHEN chars > 2200 OR images > 0.9e0 THEN 'B' ELSE 'A' END"


def _metrics(spark, sf_dir) -> DataFrame:
    m = qa.text_figures(F.col("text"))
    return view(spark, sf_dir, "triaged").select("doc_id", F.length("text").alias("chars"), *(v.alias(k) for k, v in m.items()), "images", "layer", "producer")


@query(_METRICS + "SELECT doc_id, CAST(tokens AS INT) AS tokens, ctrl, dirty, stop FROM m")
def q_triage_text(spark, sf_dir):
    return _metrics(spark, sf_dir).select("doc_id", "tokens", "ctrl", "dirty", "stop")


def _routed(spark, sf_dir) -> DataFrame:
    with_text = F.when((F.col("doc_id") % 10 == 0), 0.0).when(F.col("doc_id") % 4 == 0, (F.col("doc_id") % 10) / 9.0).otherwise(1.0)
    c = F.col
    return _metrics(spark, sf_dir).withColumn("route", tx.route(with_text, c("ctrl"), c("dirty"), c("tokens"), c("stop"), c("chars"), c("images")))


@query(_METRICS + f"SELECT doc_id, {_ROUTE} AS route, suspicion, layer OR images > 0.9e0 OR suspicion OR {_ROUTE} IN ('C', 'D', 'E') AS review FROM g")
def q_triage_route(spark, sf_dir):
    """The route by limits on rounded figures, the suspicion of old recognised text, and whether eyes must see it."""
    c = F.col
    rows = _routed(spark, sf_dir).withColumn("suspicion", qa.suspected(c("dirty"), c("images"), c("layer"), c("producer")))
    return rows.select("doc_id", "route", "suspicion", qa.to_review(c("route"), c("images"), c("layer"), c("suspicion")).alias("review"))


_EFFECTIVE = _METRICS + f", r AS (SELECT g.doc_id, {_ROUTE.replace('doc_id', 'g.doc_id')} AS route, name FROM g JOIN doc_id_row ON g.doc_id = doc_id_row.doc_id), e AS (SELECT r.doc_id, coalesce(nullif(o.route, ''), r.route) AS route, coalesce(extra, '') AS extras, coalesce(nullif(o.language, ''), CASE WHEN name LIKE '%-PT' THEN 'por' WHEN name LIKE '%-EN' THEN 'eng' WHEN name LIKE 'ABNT%' THEN 'por' WHEN name LIKE 'DIN%' THEN 'deu+eng' ELSE 'eng' END) AS language, CASE WHEN name LIKE '%-PT' OR name LIKE '%-EN' THEN 'traducao' WHEN name LIKE '%-PROJETO' THEN 'projeto' WHEN name LIKE '%-CANCELADA' THEN 'cancelada' ELSE '' END AS status FROM r LEFT JOIN override o ON r.doc_id = o.doc_id) "


def _effective(spark, sf_dir) -> DataFrame:
    c = F.col
    o = view(spark, sf_dir, "override").select("doc_id", c("route").alias("o_route"), c("language").alias("o_language"), c("extra").alias("extras"))
    rows = _routed(spark, sf_dir).select("doc_id", "route").join(view(spark, sf_dir, "doc_id_row").select("doc_id", "name"), "doc_id").join(o, "doc_id", "left")
    return rows.select("doc_id", qa.decided(c("o_route"), c("route")).alias("route"), F.coalesce("extras", F.lit("")).alias("extras"), qa.decided(c("o_language"), tx.language(c("name"))).alias("language"), tx.status(c("name")).alias("status"))


@query(_EFFECTIVE + "SELECT doc_id, route, extras, language, status FROM e")
def q_effective_route(spark, sf_dir):
    """Route, extras, language and status; a curated value wins unless it is empty."""
    return _effective(spark, sf_dir)


@query(_EFFECTIVE + "SELECT route, language, CAST(count(*) AS BIGINT) AS docs, CAST(sum(1 + doc_id % 40) AS BIGINT) AS pages FROM e GROUP BY ALL")
def q_route_summary(spark, sf_dir):
    return _effective(spark, sf_dir).groupBy("route", "language").agg(F.count("*").alias("docs"), F.sum(1 + F.col("doc_id") % 40).alias("pages"))


@query("SELECT doc_id AS id, concat_ws(';', CASE WHEN extra NOT IN ('F', 'G') THEN 'extra' END, CASE WHEN language = 'por' AND doc_id % 3 = 0 THEN 'language' END, CASE WHEN doc_id % 11 = 0 THEN 'route' END) AS problems FROM override WHERE extra NOT IN ('F', 'G') OR (language = 'por' AND doc_id % 3 = 0) OR doc_id % 11 = 0")
def q_override_lint(spark, sf_dir):
    rows = frame(spark, sf_dir, "SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'Z' ELSE route END AS route, array('G', extra) AS extras, CASE WHEN language IS NOT NULL THEN array('eng', CASE WHEN doc_id % 3 = 0 THEN 'Por' ELSE language END) END AS language FROM override")
    return val.overrides(rows).where(F.size("problems") > 0).select("id", F.array_join("problems", ";").alias("problems"))


@query("SELECT doc_id, 'no document' AS problem FROM (SELECT doc_id + CASE WHEN doc_id % 9 = 0 THEN 100000000 ELSE 0 END AS doc_id FROM override) o WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = o.doc_id) UNION ALL SELECT doc_id, 'no override' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM override o WHERE o.doc_id + CASE WHEN o.doc_id % 9 = 0 THEN 100000000 ELSE 0 END = d.doc_id)")
def q_override_orphans(spark, sf_dir):
    o = frame(spark, sf_dir, "SELECT doc_id + CASE WHEN doc_id % 9 = 0 THEN 100000000 ELSE 0 END AS doc_id FROM override")
    d = frame(spark, sf_dir, "SELECT doc_id FROM documents")
    return o.join(d, "doc_id", "left_anti").withColumn("problem", F.lit("no document")).unionByName(d.join(o, "doc_id", "left_anti").withColumn("problem", F.lit("no override")))


@query("SELECT user_id, round(avg(CASE WHEN value >= 10 THEN value END), 4) AS mean, CAST(sum(CASE WHEN value >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events GROUP BY user_id")
def q_conf_mean(spark, sf_dir):
    v = F.when(F.col("value") >= 10, F.col("value"))
    return frame(spark, sf_dir, "SELECT user_id, value FROM events").groupBy("user_id").agg(F.round(F.avg(v), 4).alias("mean"), F.count(v).alias("n"))


@query("WITH k AS (SELECT doc_id, 1 + doc_id % 40 AS n, unnest([0, 1, 2, 3, 4]) AS k FROM documents), p AS (SELECT DISTINCT doc_id, greatest(1, CAST(round_even(1e0 + k * (n - 1) / 4e0, 0) AS INT)) AS p FROM k) SELECT doc_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS pages FROM p GROUP BY doc_id")
def q_page_sample(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT doc_id, 1 + doc_id % 40 AS n FROM documents")
    return d.select("doc_id", F.array_join(tx.page_sample(F.col("n")), ",").alias("pages"))


_RANGE = "CASE doc_id % 4 WHEN 0 THEN concat(CAST(1 + doc_id % 7 AS VARCHAR(9)), '-', CAST(4 + doc_id % 9 AS VARCHAR(9)), ', 3') WHEN 1 THEN '9,2,2' WHEN 2 THEN 'x-1' ELSE '0-2' END"


@query(f"""WITH p AS (SELECT doc_id, 1 + doc_id % 10 AS total, unnest(string_split({_RANGE}, ',')) AS part FROM documents WHERE doc_id % 4 <> 2), r AS (SELECT doc_id, total, unnest(range(CAST(string_split(trim(part), '-')[1] AS INT), CAST(string_split(trim(part), '-')[-1] AS INT) + 1)) AS p FROM p),
 d AS (SELECT DISTINCT doc_id, p FROM r WHERE p >= 1 AND p <= total), j AS (SELECT doc_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS pages FROM d GROUP BY doc_id) SELECT documents.doc_id, CASE WHEN documents.doc_id % 4 = 2 THEN NULL ELSE coalesce(pages, '') END AS pages FROM documents LEFT JOIN j ON documents.doc_id = j.doc_id""")
def q_page_ranges(spark, sf_dir):
    d = frame(spark, sf_dir, f"SELECT doc_id, CAST(1 + doc_id % 10 AS INT) AS total, {_RANGE} AS r FROM documents")
    return d.select("doc_id", F.array_join(tx.page_ranges(F.col("r"), F.col("total")), ",").alias("pages"))


# --- manifest -------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def q_hash(spark, sf_dir):
    return frame(spark, sf_dir, "SELECT doc_id, text FROM documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query(f"SELECT ext, ext IN ('pdf') AS taken, CAST(count(*) AS BIGINT) AS n FROM ({_FILES}) GROUP BY ALL")
def q_inventory_ext(spark, sf_dir):
    return frame(spark, sf_dir, _FILES).groupBy("ext").agg(F.count("*").alias("n")).withColumn("taken", F.col("ext").isin("pdf"))


def _prev(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "prev_row")


@query("SELECT id, sha AS sha256_origem, route AS rota_efetiva, note AS observacao, '' AS qa, CAST(doc_id AS VARCHAR) AS mine FROM prev_row")
def q_manifest_load(spark, sf_dir):
    """A manifest written as an older file and read again: columns that it lacks are empty, extra ones stay."""
    path = scratch(spark)
    _prev(spark, sf_dir).select("id", F.col("sha").alias("sha256_origem"), F.col("route").alias("rota_efetiva"), F.col("note").alias("observacao"), F.col("doc_id").cast("string").alias("mine")).write.option("header", True).option("escape", '"').csv(path)
    return files.manifest(spark, path).select("id", "sha256_origem", "rota_efetiva", "observacao", "qa", "mine")


@query("SELECT id, route FROM prev_row WHERE route IN ('B', 'C') AND doc_id % 2 = 1")
def q_manifest_filter(spark, sf_dir):
    return _prev(spark, sf_dir).where(F.col("route").isin("B", "C") & (F.col("doc_id") % 2 == 1)).select("id", "route")


@query("""WITH mi AS (SELECT p.id, p.sha, row_number() OVER (PARTITION BY sha ORDER BY id) AS n FROM known_row p WHERE id NOT IN (SELECT id FROM now_row)), fr AS (SELECT id, sha, row_number() OVER (PARTITION BY sha ORDER BY id) AS n FROM now_row WHERE id NOT IN (SELECT id FROM known_row)),
 pr AS (SELECT fr.id, mi.id AS old_id FROM fr LEFT JOIN mi USING (sha, n)) SELECT n.id, CASE WHEN p.sha <> n.sha THEN 'changed' ELSE 'unchanged' END AS status, NULL::VARCHAR AS old_id FROM now_row n JOIN known_row p ON p.id = n.id UNION ALL SELECT id, CASE WHEN old_id IS NULL THEN 'new' ELSE 'renamed' END, old_id FROM pr
 UNION ALL SELECT id, 'removed', NULL FROM mi WHERE id NOT IN (SELECT old_id FROM pr WHERE old_id IS NOT NULL)""")
def q_manifest_reconcile(spark, sf_dir):
    """What has come, gone, changed and moved since a manifest that lacks one document in twenty."""
    return mf.reconcile(view(spark, sf_dir, "known_row"), view(spark, sf_dir, "now_row"))


@query("SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'pendente' ELSE st_ocr END AS st_ocr, CASE WHEN doc_id % 3 <> 2 THEN 'pendente' ELSE st_estrutura END AS st_estrutura, CASE WHEN doc_id % 3 <> 2 THEN 'pendente' ELSE st_tabelas END AS st_tabelas, CASE WHEN doc_id % 3 <> 2 THEN 'pendente' ELSE st_limpeza END AS st_limpeza, CASE WHEN doc_id % 3 <> 2 THEN 'pendente' ELSE st_metadados END AS st_metadados FROM prev_row")
def q_invalidate(spark, sf_dir):
    stage = F.when(F.col("doc_id") % 3 == 0, "ocr").when(F.col("doc_id") % 3 == 1, "estrutura")
    return mf.invalidate_from(_prev(spark, sf_dir), stage).select("id", *(f"st_{s}" for s in mf.STAGES))


@query("SELECT id, st_estrutura NOT IN ('ok', 'pulado') OR versions NOT LIKE '%estrutura=2%' AS needed FROM prev_row")
def q_needs_run(spark, sf_dir):
    return _prev(spark, sf_dir).select("id", mf.needs_run(F.col("st_estrutura"), mf.version(F.col("versions"), "estrutura"), 2).alias("needed"))


@query("SELECT id, CASE WHEN st_ocr NOT IN ('ok', 'pulado') OR versions NOT LIKE '%ocr=1%' THEN 'run' ELSE 'skip' END AS action, CASE WHEN st_ocr NOT IN ('ok', 'pulado') OR versions NOT LIKE '%ocr=1%' THEN 'pendente' ELSE st_metadados END AS st_metadados FROM prev_row WHERE route IN ('B', 'C')")
def q_stage_plan(spark, sf_dir):
    """Filter, decide what must run, and age what depends on it."""
    rows = _prev(spark, sf_dir).where(F.col("route").isin("B", "C"))
    runs = mf.needs_run(F.col("st_ocr"), mf.version(F.col("versions"), "ocr"), 1)
    split = rows.withColumn("runs", runs)
    return mf.invalidate_after(split.where("runs"), "ocr").unionByName(split.where("not runs")).select("id", F.when(F.col("runs"), "run").otherwise("skip").alias("action"), "st_metadados")


def _measured(row: dict) -> stages.Done:
    """A stage for the query below: it fails on every tenth document, has nothing to do on empty ones, waits for longer ones, and ages one stage alone on every third."""
    n, text = row["doc_id"], row["text"] or ""
    if n % 10 == 4:
        raise ValueError(f"texto {n}")
    if not text:
        return stages.Done("pulado")
    if len(text) < 400:
        return stages.Done("pendente", "curto")
    return stages.Done("ok", f"{len(text)} caracteres", ("limpeza",)) if n % 3 == 0 else stages.Done("ok")


@query(
    """WITH r AS (SELECT *, st_estrutura NOT IN ('ok', 'pulado') OR versions NOT LIKE '%estrutura=2%' AS ran FROM stage_row),
 s AS (SELECT *, CASE WHEN NOT ran THEN st_estrutura WHEN doc_id % 10 = 4 THEN 'falhou' WHEN coalesce(text, '') = '' THEN 'pulado' WHEN length(text) < 400 THEN 'pendente' ELSE 'ok' END AS state FROM r),
 t AS (SELECT *, ran AND state = 'ok' AND doc_id % 3 <> 0 AS all_age, ran AND state = 'ok' AS some_age, CASE state WHEN 'falhou' THEN concat('ValueError: texto ', doc_id) WHEN 'pendente' THEN 'curto' WHEN 'ok' THEN CASE WHEN doc_id % 3 = 0 THEN concat(length(text), ' caracteres') ELSE '' END ELSE '' END AS said FROM s)
 SELECT id, ran, state AS st_estrutura, st_ocr, CASE WHEN all_age THEN 'pendente' ELSE st_tabelas END AS st_tabelas, CASE WHEN some_age THEN 'pendente' ELSE st_limpeza END AS st_limpeza, CASE WHEN all_age THEN 'pendente' ELSE st_metadados END AS st_metadados, CASE WHEN some_age THEN '' ELSE qa END AS qa,
 CASE WHEN NOT ran THEN versions ELSE array_to_string(list_filter([CASE WHEN state IN ('ok', 'pulado') THEN 'estrutura=2' END, CASE WHEN versions LIKE '%ocr=1%' THEN 'ocr=1' END, CASE WHEN versions LIKE '%triagem=1%' THEN 'triagem=1' END], lambda x: x IS NOT NULL), ';') END AS versions,
 CASE WHEN NOT ran OR said = '' THEN note WHEN note = '' THEN concat('[estrutura] ', said) ELSE concat(note, ' | [estrutura] ', said) END AS note FROM t"""
)
def q_stage_run(spark, sf_dir):
    """A stage run by a processor over all documents whose state asks for it; one in ten fails by itself."""
    done = stages.run_stage(view(spark, sf_dir, "stage_row"), "estrutura", 2, _measured, ["doc_id", "text"])
    return done.select("id", "ran", *(f"st_{s}" for s in mf.STAGES), "qa", "versions", "note")


@query("SELECT id, CASE WHEN st_ocr NOT IN ('ok', 'pulado') THEN concat('etapa ocr em ''', st_ocr, '''') WHEN st_estrutura NOT IN ('ok', 'pulado') THEN concat('etapa estrutura em ''', st_estrutura, '''') WHEN st_tabelas NOT IN ('ok', 'pulado') THEN concat('etapa tabelas em ''', st_tabelas, '''') WHEN st_limpeza NOT IN ('ok', 'pulado') THEN concat('etapa limpeza em ''', st_limpeza, '''') WHEN st_metadados NOT IN ('ok', 'pulado') THEN concat('etapa metadados em ''', st_metadados, '''') ELSE '?' END AS reason FROM prev_row")
def q_pending_reason(spark, sf_dir):
    return _prev(spark, sf_dir).select("id", mf.pending_reason().alias("reason"))


@query("SELECT route, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN st_ocr = 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM prev_row GROUP BY route")
def q_status_counts(spark, sf_dir):
    return _prev(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"), F.count_if(F.col("st_ocr") == "ok").alias("ok"))


@query("SELECT id, CASE WHEN note = '' THEN concat('[ocr] now ', st_ocr) ELSE concat('manual note | [ocr] now ', st_ocr) END AS note FROM prev_row")
def q_note_upsert(spark, sf_dir):
    return _prev(spark, sf_dir).select("id", mf.upsert_note(F.col("note"), "ocr", F.concat(F.lit("now "), "st_ocr")).alias("note"))


@query("SELECT id, CASE WHEN versions LIKE '%estrutura=2%' THEN 2 END AS estrutura, CASE WHEN versions = '' THEN '' ELSE 'triagem=1' END AS rest FROM prev_row")
def q_version_map(spark, sf_dir):
    return _prev(spark, sf_dir).select("id", mf.version(F.col("versions"), "estrutura").alias("estrutura"), mf.without_versions(F.col("versions"), ["ocr", "estrutura"]).alias("rest"))


_PAIRS = "SELECT doc_id AS pos, concat('f', CAST(doc_id AS VARCHAR(12))) AS source, CASE WHEN doc_id % 8 = 0 THEN concat('f', CAST(doc_id AS VARCHAR(12))) ELSE concat('g', CAST(CASE WHEN doc_id % 5 = 0 THEN doc_id / 50 - (doc_id % 50) / 50e0 ELSE doc_id END AS VARCHAR(30))) END AS target FROM documents"
_PAIRS = _PAIRS.replace("CASE WHEN doc_id % 5 = 0 THEN doc_id / 50 - (doc_id % 50) / 50e0 ELSE doc_id END", "CASE WHEN doc_id % 5 = 0 THEN doc_id % 50 ELSE doc_id END")
_THERE = "SELECT concat('f', CAST(doc_id AS VARCHAR(12))) AS path FROM documents WHERE doc_id % 6 <> 1 UNION ALL SELECT concat('g', CAST(doc_id AS VARCHAR(12))) FROM documents WHERE doc_id % 11 = 0"


@query(f"""WITH p AS ({_PAIRS}), f AS ({_THERE}), j AS (SELECT p.*, p.source IN (SELECT path FROM f) AS hs, p.target IN (SELECT path FROM f) AS ht FROM p), w AS (SELECT *, min(CASE WHEN hs AND NOT ht AND source <> target THEN pos END) OVER (PARTITION BY target) AS first FROM j)
 SELECT pos, source, target, CASE WHEN source = target THEN 'JA_NO_PADRAO' WHEN NOT hs AND ht THEN 'DESTINO_JA_EXISTE' WHEN NOT hs THEN 'ORIGEM_AUSENTE' WHEN ht THEN 'DESTINO_JA_EXISTE' WHEN first < pos THEN 'DESTINO_DUPLICADO' ELSE 'PRONTO' END AS status FROM w""")
def q_rename_plan(spark, sf_dir):
    """A rename map written and read as a file, in the order of its rows, against the files that are there."""
    path = scratch(spark)
    pairs = frame(spark, sf_dir, _PAIRS).select(F.col("pos").alias("n"), F.col("source").alias("Nome Atual"), F.col("target").alias("novo"))
    pairs.write.option("header", True).option("sep", ";").csv(path)
    return mf.rename_plan(files.rename_map(spark, path, order="n"), frame(spark, sf_dir, _THERE))


# --- guards and verdicts --------------------------------------------------------------------------


_FRONT = ", ".join(f"regexp_extract(head, '(?m)^{n}:[ \\t]*(.*?)[ \\t]*$', 1) IN ('', 'null', '~')" for n in qa.FRONT)


@query(
    f"""WITH lost AS (SELECT doc_id, count(*) AS lost FROM ({_lost_sql("source", "judged")}) GROUP BY doc_id), it AS ({_items_sql("md", "judged")}),
 p AS (SELECT DISTINCT doc_id, regexp_replace(item, '\\.\\d+$', '') AS parent, CAST(regexp_extract(item, '(\\d+)$', 1) AS INT) AS n FROM it), gaps AS (SELECT doc_id, sum(missing) AS gaps FROM (SELECT doc_id, parent, max(n) - min(n) + 1 - count(*) AS missing FROM p GROUP BY ALL HAVING count(*) >= 3) GROUP BY doc_id),
 want AS ({_wanted_sql("source", "judged", (*_REMOVED, *_BLOCKED))}),
 f AS (SELECT doc_id, regexp_extract_all(md, '{_FORMULA}', 2) AS t, regexp_extract_all(md, '{_FORMULA}', 1) AS i, regexp_extract(md, '(?s)^---\\n(.*?)---\\n', 1) AS head FROM judged),
 h AS (SELECT doc_id, len(t) AS total, len(list_filter(i, lambda x: x <> '')) AS pictured, len(list_filter(t, lambda x: NOT contains(x, '=') OR trim(x) LIKE '%=')) AS wrong, [{_FRONT}] AS fronts, regexp_extract(head, '(?m)^codigo:[ \\t]*(.*?)[ \\t]*$', 1) IN ('', 'null', '~') AS uncurated FROM f),
 j AS (SELECT judged.*, wanted, {_COVER} / CAST(greatest(1, wanted) AS DOUBLE) AS share, coalesce(lost, 0) AS lost, coalesce(gaps, 0) AS gaps, total, pictured, wrong, list_bool_or(fronts) AS no_front, uncurated, len(list_distinct(regexp_extract_all(md, '<!-- p\\.(\\d+) -->', 1))) AS anchors,
   regexp_matches(md, 'Exclusive[^\\n]*') OR regexp_matches(md, 'fator +parcial') AS hit, contains(extras, 'F') AS want_tables, coalesce(TRY_CAST(nullif(tables, '') AS INT), 0) AS n_tables FROM judged JOIN want USING (doc_id) JOIN h USING (doc_id) LEFT JOIN lost USING (doc_id) LEFT JOIN gaps USING (doc_id)),
 v AS (SELECT *, concat_ws(';', CASE WHEN wanted = 0 THEN 'no_source' END, CASE WHEN wanted > 0 AND share < 0.95e0 THEN 'coverage' END, CASE WHEN lost > 0 AND route IN ('A', 'B') THEN 'lost_items' END, CASE WHEN hit THEN 'blocked' END, CASE WHEN anchors = 0 THEN 'no_anchor' END, CASE WHEN no_front THEN 'front_matter' END,
   CASE WHEN want_tables AND (table_state <> 'ok' OR n_tables = 0) THEN 'no_tables' END) AS rejects,
   concat_ws(';', CASE WHEN lost > 0 AND route NOT IN ('A', 'B') THEN 'lost_items' END, CASE WHEN gaps BETWEEN 1 AND 50 THEN 'gaps' END, CASE WHEN gaps > 50 THEN 'fragmented' END, CASE WHEN pictured < total THEN 'unpictured' END, CASE WHEN total > 0 AND wrong / CAST(total AS DOUBLE) > 0.2e0 THEN 'scrambled' END,
   CASE WHEN anchors > 0 AND anchors / CAST(pages AS DOUBLE) < 0.9e0 THEN 'anchors' END, CASE WHEN uncurated THEN 'uncurated' END, CASE WHEN route IN ('C', 'D', 'E') AND TRY_CAST(confidence AS DOUBLE) < 85 THEN 'confidence' END, CASE WHEN want_tables AND table_state = 'ok' AND n_tables > 0 AND n_low > 0 THEN 'low_tables' END,
   CASE WHEN layout_tables > 0 AND table_state = 'ok' AND n_tables < layout_tables THEN 'fewer_tables' END, CASE WHEN status IN ('', 'nao_declarado') THEN 'no_status' END) AS reviews FROM j)
 SELECT doc_id, rejects, reviews, CASE WHEN rejects <> '' THEN 'reprovado' WHEN reviews <> '' THEN 'revisar' ELSE 'aprovado' END AS verdict, CAST(least(lost, 20) AS INT) AS lost, round_even(CASE WHEN wanted > 0 THEN share ELSE 0e0 END, 3) AS coverage FROM v"""
)
def q_qa_verdict(spark, sf_dir):
    """All rules and limits of the verdict, each reason by name."""
    rows = view(spark, sf_dir, "judged").withColumn("low_tables", F.when(F.col("n_low") > 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")))
    v = qa.judge(rows, _REMOVED, _BLOCKED)
    return v.select("doc_id", F.array_join("rejects", ";").alias("rejects"), F.array_join("reviews", ";").alias("reviews"), "verdict", F.size("lost").alias("lost"), "coverage")


@query(
    "WITH t AS (SELECT doc_id, name, lang, source, string_split(name, '-') AS t FROM doc_id_row), p AS (SELECT *, t[1] AS issuer, CASE WHEN regexp_matches(t[2], '^(19|20)\\d{2}$') THEN '' ELSE regexp_replace(t[2], '^(.*?[A-Za-z]{2})(\\d)', '\\1 \\2') END AS code, CASE WHEN regexp_matches(t[2], '^(19|20)\\d{2}$') THEN t[2] ELSE t[3] END AS year,"
    " CASE WHEN name LIKE '%-PT' OR name LIKE '%-EN' THEN 'traducao' WHEN name LIKE '%-PROJETO' THEN 'projeto' WHEN name LIKE '%-CANCELADA' THEN 'cancelada' ELSE 'nao_declarado' END AS status FROM t)"
    " SELECT doc_id, concat('---', chr(10), 'emissor: ', issuer, chr(10), 'codigo: ', CASE WHEN code = '' THEN concat(chr(39), chr(39)) ELSE code END, chr(10), 'ano: ', year, chr(10), 'status: ', status, chr(10), 'titulo: ', lower(source), ' ', lang, chr(10), 'confianca_ocr: ', chr(39), 'n/a', chr(39), chr(10), '---', chr(10)) AS front, CASE WHEN code = '' THEN 'codigo,paginas' ELSE 'paginas' END AS missing FROM p"
)
def q_front_matter(spark, sf_dir):
    """A front matter built from an id, and what is missing in it."""
    c = F.col
    issuer, code, year = tx.id_parts(c("name"))
    status = qa.decided(tx.status(c("name")), F.lit("nao_declarado"))
    front = qa.front_matter({"emissor": issuer, "codigo": code, "ano": year, "status": status, "titulo": tx.title(c("name")), "confianca_ocr": F.lit("n/a")})
    rows = view(spark, sf_dir, "doc_id_row").select("doc_id", front.alias("front"))
    return rows.select("doc_id", "front", F.array_join(qa.front_missing(F.concat("front", F.lit("text")), ("emissor", "codigo", "ano", "paginas")), ",").alias("missing"))


@query(_CLEAN + f"SELECT doc_id, CASE WHEN sum(CASE WHEN NOT gone AND regexp_matches(line, '\\S') THEN 1 ELSE 0 END) = 0 OR NOT bool_or({_ANCHORED}) THEN 'falhou' ELSE 'ok' END AS state, sum(CASE WHEN gone THEN 1e0 ELSE 0e0 END) / count(*) > 0.25e0 AS warned FROM t GROUP BY doc_id")
def q_clean_guard(spark, sf_dir):
    rows = qa.with_cleaned(_md(spark, sf_dir), "md", _REMOVED)
    state, warned = qa.clean_state(F.col("text"), F.col("lines"), F.col("removed"))
    return rows.select("doc_id", state.alias("state"), warned.alias("warned"))


@query("SELECT doc_id, CASE WHEN len(regexp_extract_all(md, '[\\p{L}\\p{N}_]')) / CAST(greatest(1, len(regexp_extract_all(src, '[\\p{L}\\p{N}_]'))) AS DOUBLE) < 0.5e0 THEN 'falhou' ELSE 'ok' END AS state, len(list_distinct(regexp_extract_all(md, '<!-- p\\.(\\d+) -->', 1))) < pages * 0.5e0 AS warned FROM md")
def q_structure_guard(spark, sf_dir):
    state, warned = qa.structure_state(F.col("md"), F.col("src"), F.col("pages"))
    return _md(spark, sf_dir).select("doc_id", state.alias("state"), warned.alias("warned"))


@query(f"SELECT doc, CASE WHEN per_page < 50 THEN 'falhou' ELSE 'ok' END AS state, per_page >= 50 AND (doc % 7 = 0 OR doc % 3 = 0) AS warned, CAST(greatest(300, 30 * pages + 120) AS BIGINT) AS time_limit FROM ({_PAGES})")
def q_ocr_guard(spark, sf_dir):
    """Pages, share of control characters and confidence decide; the last two are made from the id here."""
    control, confidence = F.when(F.col("doc") % 7 == 0, 0.011).otherwise(0.01), F.when(F.col("doc") % 3 == 0, 84.9).when(F.col("doc") % 3 == 1, 85.0)
    state, warned = qa.recognition_state(F.col("per_page"), control, confidence)
    return _pages(spark, sf_dir).select("doc", state.alias("state"), warned.alias("warned"), qa.time_limit(F.col("pages")).alias("time_limit"))


_INDEX = "SELECT l_orderkey AS doc, l_linenumber AS pos, concat('t', CAST(l_linenumber AS VARCHAR(9)), '.csv') AS arquivo, l_linenumber % 3 AS pagina, CASE WHEN l_linenumber % 4 = 0 THEN 'x' ELSE CAST(l_quantity * 2 AS VARCHAR(20)) END AS acuracia FROM lineitem"


@query(f"SELECT doc, string_agg(concat(arquivo, ' (p.', pagina, ', ', acuracia, ')'), '|' ORDER BY pos, concat(arquivo, ' (p.', pagina, ', ', acuracia, ')')) AS low FROM ({_INDEX}) WHERE TRY_CAST(acuracia AS DOUBLE) < 80 GROUP BY doc")
def q_table_lowacc(spark, sf_dir):
    """Indexes of tables written and read as files: those below the accuracy asked for, malformed rows left out."""
    path = scratch(spark)
    frame(spark, sf_dir, _INDEX).write.option("header", True).csv(path)
    return qa.low_tables(files.table_index(spark, path)).select("doc", F.array_join("low_tables", "|").alias("low"))


_LAYOUT = """concat('{"tables":[{"prov":[{"page_no":', CAST(1 + doc_id % 9 AS VARCHAR(9)), '},{"page_no":', CAST(1 + doc_id % 4 AS VARCHAR(9)), '}]},{"prov":[{"page_no":2}]}]}')"""


@query("WITH p AS (SELECT DISTINCT doc_id, unnest([1 + doc_id % 9, 1 + doc_id % 4, 2]) AS p FROM documents) SELECT doc_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS pages, 2 AS tables FROM p GROUP BY doc_id")
def q_json_pages(spark, sf_dir):
    rows = files.layout_pages(frame(spark, sf_dir, f"SELECT doc_id, {_LAYOUT} AS json FROM documents"))
    return rows.select("doc_id", F.array_join("pages", ",").alias("pages"), "tables")


# --- bank checks, cases, lookups -------------------------------------------------------------------


@query("SELECT s_suppkey AS id, 'metadata_only' AS side FROM supplier WHERE s_suppkey % 14 = 0 AND s_suppkey % 15 <> 0 UNION ALL SELECT s_suppkey, 'curves_only' FROM supplier WHERE s_suppkey % 15 = 0 AND s_suppkey % 14 <> 0")
def q_id_symdiff(spark, sf_dir):
    s = frame(spark, sf_dir, "SELECT s_suppkey AS id FROM supplier")
    return val.one_sided(s.where("id % 15 <> 0"), s.where("id % 14 <> 0"), "id", "metadata_only", "curves_only")


@query("SELECT p_name AS key, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def q_dup_keys(spark, sf_dir):
    return val.repeated(frame(spark, sf_dir, "SELECT p_name FROM part"), "p_name")


@query("SELECT s_suppkey AS id, trim(concat('  ', s_name, ' ')) AS name, TRY_CAST(CASE WHEN s_suppkey % 6 = 0 THEN 'n/a' ELSE CAST(s_nationkey AS VARCHAR) END AS DOUBLE) AS value FROM supplier")
def q_metadata_typed(spark, sf_dir):
    s = frame(spark, sf_dir, "SELECT s_suppkey AS id, concat('  ', s_name, ' ') AS name, CASE WHEN s_suppkey % 6 = 0 THEN 'n/a' ELSE CAST(s_nationkey AS STRING) END AS v FROM supplier")
    return s.select("id", F.regexp_replace("name", r"(?U)^\s+|\s+$", "").alias("name"), F.expr("try_cast(v AS DOUBLE)").alias("value"))


_META = "SELECT unit_id, CASE WHEN unit_id % 31 = 0 THEN 3 ELSE poles END AS poles, CASE WHEN unit_id % 47 = 0 THEN 0e0 ELSE base_freq END AS base_freq, CASE WHEN unit_id % 37 = 0 THEN 4000e0 ELSE base_speed END AS base_speed, CASE WHEN unit_id % 41 = 0 THEN 1.4e0 ELSE motor_eff END AS motor_eff, CASE WHEN unit_id % 43 = 0 THEN -1e0 WHEN unit_id % 44 = 0 THEN NULL ELSE motor_kw END AS motor_kw, CASE WHEN unit_id % 46 = 0 THEN 0e0 ELSE qbep END AS qbep, CASE WHEN unit_id % 48 = 0 THEN -1e0 ELSE npsh_bep END AS npsh_bep FROM unit"


@query(f"SELECT unit_id, concat_ws(';', CASE WHEN poles <= 0 OR poles % 2 <> 0 THEN 'poles' END, CASE WHEN base_freq <= 0 THEN 'frequency' END, CASE WHEN base_speed <= 0 OR base_speed >= 120e0 * base_freq / poles THEN 'speed' END, CASE WHEN motor_eff <= 0 OR motor_eff > 1 THEN 'efficiency' END, CASE WHEN motor_kw IS NULL OR motor_kw <= 0 THEN 'power' END, CASE WHEN qbep <= 0 THEN 'flow' END, CASE WHEN npsh_bep < 0 THEN 'npsh' END) AS problems FROM ({_META})")
def q_metadata_lint(spark, sf_dir):
    return val.metadata(frame(spark, sf_dir, _META)).select("unit_id", F.array_join("problems", ";").alias("problems"))


@query("SELECT CAST(unit_id AS VARCHAR) AS unit, CAST(count(*) AS BIGINT) AS points, round(min(q), 6) AS q0, round(max(q), 6) AS q1, CAST(count(npsh) AS BIGINT) AS with_npsh, round(sum(h), 4) AS h FROM curve_pt GROUP BY unit_id")
def q_scan_curves(spark, sf_dir):
    """Curves written as delimited files, a folder a unit, and read again, a lot of folders at a time: the driver knows the files of one lot, never of all."""
    path = scratch(spark)
    named = view(spark, sf_dir, "curve_pt").select(F.col("unit_id").alias("unit"), F.col("q").alias("Q"), F.col("h").alias("H"), F.col("eta").alias("Eta1"), F.col("npsh").alias("NPSH"))
    lots = max(1, -(-view(spark, sf_dir, "unit").count() // files.LOT))
    points = files.in_lots(named, "unit", lots, f"{path}/points")
    found = files.lots(points)
    for k in found:
        files.write_curves(points.where(F.col("lot") == k).drop("lot"), "unit", f"{path}/lot-{k}")
        with files.listed_in_tasks(spark):
            rows = files.curves(spark, f"{path}/lot-{k}")
        told = rows.groupBy("unit").agg(F.count("*").alias("points"), F.round(F.min("q"), 6).alias("q0"), F.round(F.max("q"), 6).alias("q1"), F.count("npsh").alias("with_npsh"), F.round(F.sum("h"), 4).alias("h"))
        told.write.mode("append").parquet(f"{path}/told")
    of = "unit string, points long, q0 double, q1 double, with_npsh long, h double"
    return spark.read.schema(of).parquet(f"{path}/told") if found else spark.createDataFrame([], of)


_CASES = "SELECT p_partkey AS case_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS temperature, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 0.5e0 END AS suction_loss, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 0.3e0 END AS vapor_head, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 2e0 END AS top_n, CASE p_partkey % 4 WHEN 0 THEN 'Manual' WHEN 1 THEN 'ABACUS' WHEN 2 THEN 'best' ELSE ' optimize' END AS mode, concat(' A', CAST(p_partkey % 7 AS VARCHAR(9)), ' ;; B', CAST(p_partkey % 5 AS VARCHAR(9)), ';') AS ids FROM part"


@query(f"SELECT case_id, coalesce(temperature, 20e0) AS temperature, coalesce(suction_loss, 0e0) AS suction_loss, coalesce(vapor_head, 0.26e0) AS vapor_head, CAST(coalesce(top_n, 3) AS INT) AS top_n, lower(trim(mode)) AS mode, concat('A', case_id % 7, '|B', case_id % 5) AS ids, CASE WHEN case_id % 4 = 2 THEN 'mode' ELSE '' END AS problem FROM ({_CASES})")
def q_case_parse(spark, sf_dir):
    rows = val.cases(frame(spark, sf_dir, _CASES))
    return rows.select("case_id", "temperature", "suction_loss", "vapor_head", F.col("top_n").cast("int").alias("top_n"), "mode", F.array_join("ids", "|").alias("ids"), F.coalesce("problem", F.lit("")).alias("problem"))


@query(f"SELECT case_id, name FROM (SELECT *, row_number() OVER (ORDER BY case_id) AS n FROM ({_CASES})) WHERE n = 7")
def q_pick_cases(spark, sf_dir):
    """The seventh case of its sheet."""
    return val.pick_cases(frame(spark, sf_dir, _CASES), 7, "case_id").select("case_id", "name")


@query("SELECT unit_id FROM unit WHERE unit_id IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)")
def q_manual_ids(spark, sf_dir):
    wanted = frame(spark, sf_dir, "SELECT l_suppkey AS unit_id FROM lineitem WHERE l_quantity >= 50")
    return view(spark, sf_dir, "unit").join(wanted, "unit_id", "left_semi").select("unit_id")


@query("SELECT event_id, conv_id AS doc, turn AS page, CAST(length(text) AS INT) AS chars FROM events JOIN conversations ON conv_id = user_id AND turn = event_id % 8")
def q_page_lookup(spark, sf_dir):
    e, p = frame(spark, sf_dir, "SELECT event_id, user_id AS doc, event_id % 8 AS page FROM events"), frame(spark, sf_dir, "SELECT conv_id AS doc, turn AS page, text FROM conversations")
    return e.join(p, ["doc", "page"]).select("event_id", "doc", "page", F.length("text").alias("chars"))


@query(
    "WITH RECURSIVE ev AS (SELECT user_id AS session, event_id AS seq, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, event_type) AS n FROM events),"
    " st AS (SELECT DISTINCT session, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS done, CAST([] AS BIGINT[]) AS undone, false AS locked FROM ev UNION ALL"
    " SELECT e.session, e.n, CASE WHEN locked THEN done WHEN kind = 'click' THEN list_append(done, seq) WHEN kind = 'view' AND len(done) > 0 THEN done[1:len(done) - 1] WHEN kind = 'purchase' AND len(undone) > 0 THEN list_append(done, undone[len(undone)]) WHEN kind = 'error' THEN CAST([] AS BIGINT[]) ELSE done END,"
    " CASE WHEN locked THEN undone WHEN kind IN ('click', 'error') THEN CAST([] AS BIGINT[]) WHEN kind = 'view' AND len(done) > 0 THEN list_append(undone, done[len(done)]) WHEN kind = 'purchase' AND len(undone) > 0 THEN undone[1:len(undone) - 1] ELSE undone END, locked OR kind = 'signup' FROM st JOIN ev e ON e.session = st.session AND e.n = st.n + 1),"
    " z AS (SELECT session, arg_max(done, n) AS done, arg_max(undone, n) AS undone, arg_max(locked, n) AS locked FROM st GROUP BY session) SELECT session, CAST(len(done) AS INT) AS points, CAST(len(undone) AS INT) AS undone, locked, CASE WHEN len(done) > 0 THEN done[len(done)] ELSE -1 END AS last FROM z"
)
def q_capture_fold(spark, sf_dir):
    """Each user's points after all clicks, undos, redos and discards in order of time."""
    return capture.fold(frame(spark, sf_dir, "SELECT user_id AS session, event_id AS seq, ts AS at, event_type AS kind FROM events"))


_KEPT_KIND = "CASE event_type WHEN 'click' THEN 'point' WHEN 'view' THEN 'undo' WHEN 'purchase' THEN 'redo' WHEN 'error' THEN 'discard' ELSE 'duplicate' END"


@query(
    "WITH RECURSIVE e AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id AS seq, " + _KEPT_KIND + " AS kind FROM events),"
    " st AS (SELECT DISTINCT session, 0::BIGINT AS n, 0 AS stage, []::BIGINT[] AS done, []::BIGINT[] AS undone FROM e UNION ALL SELECT st.session, e.n, CASE kind WHEN 'duplicate' THEN 4 WHEN 'discard' THEN 0 ELSE stage END,"
    " CASE WHEN kind IN ('duplicate', 'discard') THEN [] WHEN stage <> 4 THEN done WHEN kind = 'point' THEN list_append(done, seq) WHEN kind = 'undo' THEN done[:-2] WHEN kind = 'redo' AND len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END,"
    " CASE WHEN kind IN ('duplicate', 'discard') THEN [] WHEN stage <> 4 THEN undone WHEN kind = 'point' THEN [] WHEN kind = 'undo' AND len(done) > 0 THEN list_append(undone, done[-1]) WHEN kind = 'redo' THEN undone[:-2] ELSE undone END"
    " FROM st JOIN e ON e.session = st.session AND e.n = st.n + 1), z AS (SELECT session, max(n) AS events, arg_max(stage, n) AS stage, arg_max(done, n) AS done, arg_max(undone, n) AS undone FROM st GROUP BY session)"
    " SELECT session, events, CAST(stage AS INT) AS stage, CAST(len(done) AS INT) AS points, CAST(len(undone) AS INT) AS undone, CAST(done[-1] AS DOUBLE) AS last_x FROM z"
)
def q_capture_kept(spark, sf_dir):
    """Captures as state kept by key, over events that arrive in three runs of a stream; a duplicate starts a capture, a discard ends it."""
    folder = scratch(spark)
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    events = frame(spark, sf_dir, "SELECT user_id, ts, event_id, event_type FROM events").withColumn("seq", order)
    none = F.lit(None).cast("double")
    rows = events.select(F.col("user_id").alias("session"), "seq", F.expr(_KEPT_KIND).alias("kind"), F.col("event_id").cast("double").alias("x"), F.lit(0.0).alias("y"), none.alias("a"), none.alias("b"), F.ntile(3).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("run"))
    rows.write.partitionBy("run").parquet(f"{folder}/runs")  # numbered once, not once a run
    for k in (1, 2, 3):
        spark.read.schema(rows.drop("run").schema).parquet(f"{folder}/runs/run={k}").write.mode("append").parquet(f"{folder}/events")
        capture.caught_up(spark.readStream.schema(rows.drop("run").schema).parquet(f"{folder}/events"), folder)
    return capture.latest(spark, folder).select("session", "events", "stage", "points", "undone", "last_x")


@query("SELECT route, coalesce(lang, '?') AS lang, CAST(2 * grouping(route) + grouping(coalesce(lang, '?')) AS INT) AS level, CAST(count(*) AS BIGINT) AS n, CAST(sum(pages) AS BIGINT) AS pages FROM prev_row JOIN documents USING (doc_id) GROUP BY ROLLUP (route, coalesce(lang, '?'))")
def q_route_rollup(spark, sf_dir):
    """Documents and pages by route and language, by route, and in all; `level` tells a total from a group."""
    rows = frame(spark, sf_dir, "SELECT p.route, coalesce(d.lang, '?') AS lang, p.pages FROM prev_row p JOIN documents d ON p.doc_id = d.doc_id")
    return rows.rollup("route", "lang").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum("pages").alias("pages"))
