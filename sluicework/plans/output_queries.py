"""Queries over files that results become: each is written by its sink, read again and compared with SQL; and tables and texts that reports are laid out from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import curves, manifest as mf, quality as qa, text as tx
from ..sources import profiles, reports, sinks
from .adapters import frame, scratch, view, with_views
from .document_queries import _ACCENT

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


# --- common tables ---------------------------------------------------------------------------------

#: Curves of a common table: turnover by day of each priority, in a unit that leaves no sums halfway between two roundings; the middle one's days are the table's rows.
_PRIORITIES, _MAIN = ("p1", "p2", "p3", "p4", "p5"), "p3"
_DAILY = "SELECT concat('p', substr(o_orderpriority, 1, 1)) AS curve, CAST({} AS DOUBLE) AS x, 0.3183098861837907e0 * sum(o_totalprice) AS y FROM orders GROUP BY 1, 2"
_COMMON = f"""WITH p AS ({_DAILY.format("date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))")}), a AS (SELECT x FROM p WHERE curve = '{_MAIN}'), n AS (SELECT unnest([{", ".join(f"'{c}'" for c in _PRIORITIES)}]) AS curve),
 s AS (SELECT a.x, n.curve, lo.x AS x0, lo.y AS y0, hi.x AS x1, hi.y AS y1 FROM (a CROSS JOIN n) ASOF LEFT JOIN p lo ON lo.curve = n.curve AND a.x >= lo.x ASOF LEFT JOIN p hi ON hi.curve = n.curve AND a.x <= hi.x),
 v AS (SELECT x, curve, CASE WHEN x0 = x1 THEN y0 ELSE y0 + (x - x0) / (x1 - x0) * (y1 - y0) END AS y FROM s), t AS (SELECT x, {", ".join(f"max(CASE WHEN curve = '{c}' THEN y END) AS {c}" for c in _PRIORITIES)} FROM v GROUP BY x) """


def _common(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = frame(spark, sf_dir, _DAILY.format("datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01')"))
    return curves.common_table(daily, _MAIN, _PRIORITIES)


@query(_COMMON + "SELECT x, " + ", ".join(f"round({c}, 3) AS {c}" for c in _PRIORITIES) + " FROM t")
def q_common_table(spark, sf_dir):
    """Five curves at the days of one of them, a column each; null where a curve does not reach."""
    return _common(spark, sf_dir).withColumns({c: F.round(c, 3) for c in _PRIORITIES})


@query(_COMMON + f"SELECT CAST(count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in _PRIORITIES)}) AS BIGINT) AS n_rows, concat_ws(',', {', '.join(f'CASE WHEN bool_or({c} IS NULL) THEN {chr(39)}{c}{chr(39)} END' for c in _PRIORITIES)}) AS lacking FROM t")
def q_common_incomplete(spark, sf_dir):
    """How many rows of that table lack a value, and which columns do."""
    return curves.incomplete(_common(spark, sf_dir), _PRIORITIES).select(F.col("rows").alias("n_rows"), F.array_join("columns", ",").alias("lacking"))


# --- delimited files -------------------------------------------------------------------------------

#: Columns of a curve, cut to some digits in a way that is the same in every engine.
_SHOWN = {c: f"floor({c} * {k} + 0.5e0) / {k}" for c, k in (("q", "1e3"), ("h", "1e3"), ("eta", "1e6"), ("npsh", "1e6"))}


@query("SELECT " + ", ".join(f"coalesce(replace(CAST({v} AS VARCHAR), '.', ','), '') AS {c}" for c, v in _SHOWN.items()) + " FROM curve_pt")
def q_profile_file(spark, sf_dir):
    """Curves written in a profile's marks, semicolons and decimal commas, and read again as text."""
    path = scratch(spark)
    profile = profiles.Profile(("Q", "H", "Eta1", "NPSH"), ";", ",")
    points = view(spark, sf_dir, "curve_pt").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit_id")  # a table of units is one task's; numbers as text are not made there
    profiles.write_csv(points.select(*(F.expr(v).alias(c) for c, v in _SHOWN.items())), path, profile)
    rows = spark.read.option("header", True).option("sep", ";").schema("Q string, H string, Eta1 string, NPSH string").csv(path)
    return rows.select(*(F.coalesce(h, F.lit("")).alias(c) for h, c in zip(profile.headers, _SHOWN, strict=True)))


@query("""SELECT concat(regexp_replace(regexp_replace(concat(s_name, ' (', maker, ')'), '[^\\p{L}\\p{N}_-]+', '_', 'g'), '^_+|_+$', '', 'g'), '_', CAST(unit_id AS VARCHAR), '_raw') AS file, CAST(count(*) AS BIGINT) AS points,
 round(sum(10e0 + 5.017e0 * q), 3) AS px, round(sum(400e0 - 7.613e0 * h), 3) AS py, round(sum(q), 3) AS x, round(sum(h), 3) AS y FROM curve_pt JOIN unit USING (unit_id) JOIN supplier ON s_suppkey = unit_id GROUP BY 1""")
def q_raw_export(spark, sf_dir):
    """Points captured in pixels, brought to units by three known points and written, a folder a curve."""
    sql = "SELECT p.unit_id AS curve, concat(s_name, ' (', maker, ')') AS name, p.i, 10e0 + 5.017e0 * q AS px, 400e0 - 7.613e0 * h AS py FROM curve_pt p JOIN unit u ON p.unit_id = u.unit_id JOIN supplier ON s_suppkey = p.unit_id"
    known = [tuple(map(F.lit, k)) for k in ((10.0, 400.0, 0.0, 0.0), (511.7, 400.0, 100.0, 0.0), (10.0, 19.35, 0.0, 50.0))]
    path = scratch(spark)
    sinks.write_raw(sinks.raw_points(frame(spark, sf_dir, sql), curves.affine(known)), path, profiles.Profile(("px", "py", "X", "Y"), ";", ","))
    rows = spark.read.option("header", True).option("sep", ";").schema("px string, py string, X string, Y string, file string").csv(path)
    number = lambda c: F.replace(c, F.lit(","), F.lit(".")).cast("double")
    return rows.groupBy("file").agg(F.count("*").alias("points"), *(F.round(F.sum(number(F.col(c))), 3).alias(c.lower()) for c in ("px", "py", "X", "Y")))


_TITLED = "SELECT p_partkey AS code, concat(p_name, ' \"', p_brand, '\", ', CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END) AS title, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS price FROM part"


@query(_TITLED)
def q_result_file(spark, sf_dir):
    """A result with quotes, commas and nulls in its cells, written and read again."""
    path = scratch(spark)
    sinks.write_result(frame(spark, sf_dir, _TITLED), path)
    return spark.read.option("header", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).schema("code bigint, title string, price double").csv(path)


_LISTED = """SELECT concat('doc-', CAST(doc_id AS VARCHAR(20))) AS id, concat(CASE WHEN doc_id % 2 = 0 THEN upper(name) ELSE name END, CASE WHEN doc_id % 3 = 0 THEN ', part' ELSE '' END, '.pdf') AS arquivo_origem,
 CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'said "no", twice' ELSE 'plain' END AS observacao FROM doc_id_row"""


def _quoted(c: str) -> str:
    return f"CASE WHEN regexp_matches(coalesce({c}, ''), '[,\"]') THEN concat('\"', replace({c}, '\"', '\"\"'), '\"') ELSE coalesce({c}, '') END"


@query(f"""WITH l AS ({_LISTED}), t AS (SELECT 1 AS part, lower(arquivo_origem) AS low, id, concat_ws(',', {", ".join(map(_quoted, ("id", "arquivo_origem", "observacao")))}) AS line FROM l UNION ALL SELECT 0, '', '', 'id,arquivo_origem,observacao')
 SELECT CAST(row_number() OVER (ORDER BY part, low, id) AS BIGINT) AS place, line FROM t""")
def q_manifest_file(spark, sf_dir):
    """A manifest written in parts; put one behind the other they are one file, whose lines are numbered here. The mark in front is taken off by the reader; a test has its bytes."""
    path = scratch(spark)
    sinks.write_manifest(frame(spark, sf_dir, _LISTED), path, parts=4)
    rows = spark.read.option("lineSep", "\r\n").text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    held = rows.withColumn("in_part", F.row_number().over(Window.partitionBy("file").orderBy("start", "n")))
    sizes = held.groupBy("file").agg(F.count("*").alias("lines"))  # a row a part
    before = sizes.select("file", F.coalesce(F.sum("lines").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return held.join(before, "file").select((F.col("before") + F.col("in_part")).alias("place"), F.col("value").alias("line"))


_LOGGED = """SELECT s_suppkey AS pos, concat('in/"', CAST(s_suppkey AS VARCHAR(12)), '".pdf') AS source, concat('out/', s_name, '.pdf') AS target, CASE s_suppkey % 3 WHEN 0 THEN 'RENOMEADO' WHEN 1 THEN 'ORIGEM_AUSENTE' ELSE 'JA_NO_PADRAO' END AS status,
 CASE WHEN s_suppkey % 3 = 0 THEN md5(s_name) END AS sha FROM supplier"""
_BROKEN = "SELECT concat('in/', CAST(s_suppkey AS VARCHAR(12)), CASE s_suppkey % 4 WHEN 0 THEN '.PART' WHEN 1 THEN '.crdownload' WHEN 2 THEN '.pdf' ELSE '.tmp' END) AS path FROM supplier"


@query(f"""WITH l AS ({_LOGGED}), b AS ({_BROKEN}) SELECT 0 AS part, '' AS at, 'status,source,target,sha256' AS line
 UNION ALL SELECT 1, lpad(CAST(pos AS VARCHAR), 20, '0'), concat('"', status, '","', replace(source, '"', '""'), '","', target, '",', coalesce(sha, '')) FROM l
 UNION ALL SELECT 2, path, concat('"DOWNLOAD_PARCIAL","', path, '","_descartar/', substr(path, 4), '",') FROM b WHERE path NOT LIKE '%.pdf'""")
def q_rename_log(spark, sf_dir):
    """Lines of a log of renames, in the plan's order, and of broken downloads that are set aside."""
    lines = sinks.rename_log(frame(spark, sf_dir, _LOGGED), mf.set_aside(frame(spark, sf_dir, _BROKEN)))
    return lines.select("place.part", "place.at", "line")


# --- reports ---------------------------------------------------------------------------------------

_LISTS = "SELECT c.family, c.material, c.type, c.line, CAST(c.code AS VARCHAR(20)) AS code, concat(c.title, ' & 50%_', c.type, ' #1') AS title, i.quantity / 8e0 AS quantity FROM catalog c JOIN items i ON c.code = i.code WHERE i.quantity > 0"


def _tex(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&', '\\&'), '%', '\\%'), '#', '\\#'), '_', '\\_')"


@query(f"""WITH l AS ({_LISTS}), f AS (SELECT material, type, family, min(line) AS first, string_agg(concat({_tex("code")}, ' & ', {_tex("title")}, ' & ', replace(regexp_replace(regexp_replace(CAST(CAST(quantity AS DECIMAL(38,18)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), '.', ','), ' \\\\'), chr(10) ORDER BY line) AS body FROM l GROUP BY ALL)
 SELECT material, type, family, sha256(concat('\\section*{{', {_tex("family")}, '}}\\label{{fam-', left(sha256(family), 16), '}}', chr(10), CASE WHEN first % 2 = 0 THEN concat('\\includegraphics{{img/', CAST(first AS VARCHAR), '.pdf}}', chr(10)) ELSE concat('% no picture', chr(10)) END, '\\begin{{tabular}}{{llr}}', chr(10), body, chr(10), '\\end{{tabular}}', chr(10))) AS tex_sha FROM f""")
def q_latex_tables(spark, sf_dir):
    """Each family's rows with a quantity as a LaTeX table, in catalogue order."""
    rows = frame(spark, sf_dir, _LISTS).groupBy("material", "type", "family").agg(F.min("line").alias("first"), F.array_sort(F.collect_list(F.struct("line", "code", "title", "quantity"))).alias("rows"))
    pictured = rows.withColumn("image", F.when(F.col("first") % 2 == 0, F.concat(F.lit("img/"), F.col("first").cast("string"), F.lit(".pdf"))))
    return reports.family_tables(pictured).select("material", "type", "family", F.sha2("tex", 256).alias("tex_sha"))


_FIGURES = ("base_speed", "base_freq", "120e0 * base_freq / poles", "round(1e0 - base_speed * poles / (120e0 * base_freq), 6)")
_LETTERS = ("Y", "Z", "AA", "AB")


@query(" UNION ALL ".join([f"SELECT concat('U', CAST(unit_id AS VARCHAR)) AS sheet, '{a}18' AS ref, CAST({v} AS VARCHAR) AS value FROM unit" for a, v in zip(_LETTERS, _FIGURES, strict=True)] + [f"SELECT concat('U', CAST(unit_id AS VARCHAR)), concat('{a}', CAST(21 + i AS VARCHAR)), CAST({v} AS VARCHAR) FROM curve_pt WHERE {c} IS NOT NULL" for a, (c, v) in zip(_LETTERS, _SHOWN.items(), strict=True)]))
def q_report_cells(spark, sf_dir):
    """Every unit's curve laid out as the cells of its own sheet, over the columns Y to AB."""
    sheet = F.concat(F.lit("U"), F.col("unit_id").cast("string"))
    points = view(spark, sf_dir, "curve_pt").select("unit_id", "i", *(F.expr(v).alias(c) for c, v in _SHOWN.items()))
    state = frame(spark, sf_dir, f"SELECT unit_id, {', '.join(f'{v} AS {n}' for v, n in zip(_FIGURES, ('speed', 'frequency', 'synchronous', 'slip'), strict=True))} FROM unit")
    return reports.curve_cells(points, state, sheet, 24)


_REASONS = "SELECT concat('doc-', CAST(doc_id AS VARCHAR(20))) AS id, toxic = 1 AS r1, quality = 0 AND doc_id % 3 = 0 AS r2, quality = 0 AS v1, doc_id % 7 = 0 AS v2 FROM labels"
_RANK = "CASE verdict WHEN 'reprovado' THEN 0 WHEN 'revisar' THEN 1 ELSE 2 END"


@query(f"""WITH r AS ({_REASONS}), l AS (SELECT id, list_filter([CASE WHEN r1 THEN 'toxic' END, CASE WHEN r2 THEN 'thin' END], lambda x: x IS NOT NULL) AS rejects, list_filter([CASE WHEN v1 THEN 'low' END, CASE WHEN v2 THEN 'odd' END], lambda x: x IS NOT NULL) AS reviews FROM r),
 t AS (SELECT *, CASE WHEN len(rejects) > 0 THEN 'reprovado' WHEN len(reviews) > 0 THEN 'revisar' ELSE 'aprovado' END AS verdict FROM l), e AS (SELECT id, verdict, unnest(list_concat(rejects, reviews)) AS reason, unnest(range(len(rejects) + len(reviews))) AS k FROM t)
 SELECT 0 AS part, {_RANK} AS severity, '' AS id, 0 AS k, concat('- ', verdict, ': ', count(*)) AS line FROM t GROUP BY verdict UNION ALL SELECT 1, {_RANK}, id, 0, concat('| ', id, ' | ', verdict, ' | ', len(rejects), ' | ', len(reviews), ' |') FROM t UNION ALL SELECT 2, {_RANK}, id, CAST(k AS INT), concat('- ', id, ': ', reason) FROM e""")
def q_verdict_report(spark, sf_dir):
    """Lines of a report of verdicts: counts, a table by severity and id, and the reasons."""
    told = lambda *named: F.array_compact(F.array(*(F.when(F.col(c), F.lit(t)) for c, t in named)))
    rows = frame(spark, sf_dir, _REASONS).select("id", told(("r1", "toxic"), ("r2", "thin")).alias("rejects"), told(("v1", "low"), ("v2", "odd")).alias("reviews"))
    lines = reports.verdict_lines(rows.withColumn("verdict", mf.verdict(F.col("rejects"), F.col("reviews"))))
    return lines.select("part", F.col("place.a").alias("severity"), F.col("place.b").alias("id"), F.col("place.c").alias("k"), "line")


# --- names, numbers and predicates -----------------------------------------------------------------

_PLAIN = "regexp_replace(" + _ACCENT.format("text") + ", '[^\\x00-\\x7F]', '', 'g')"


@query(f"""WITH s AS (SELECT doc_id, left(regexp_replace(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 80) AS f, regexp_replace(regexp_replace({_PLAIN}, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS n FROM documents)
 SELECT doc_id, CASE WHEN coalesce(f, '') = '' THEN 'file' ELSE f END AS file, sha256(CASE WHEN coalesce(n, '') = '' THEN 'selecao' ELSE n END) AS name_sha FROM s""")
def q_file_names(spark, sf_dir):
    """Names of files made of whole texts: one that keeps letters of any script, one that every file system takes."""
    return frame(spark, sf_dir, "SELECT doc_id, text FROM documents").select("doc_id", tx.file_slug(F.col("text")).alias("file"), F.sha2(tx.safe_name(F.col("text")), 256).alias("name_sha"))


def _numbers(array: str) -> str:
    n = lambda d, k: f"CAST(1 + doc_id % {d} AS {k})"
    text = "VARCHAR(9)"
    return f"SELECT doc_id, {array}(concat('4.', {n(15, text)}), '4.9', '4.10', concat({n(12, text)}, '.1'), concat({n(5, text)}, '.2.', {n(11, text)}), {n(20, text)}) AS numbers FROM documents"


@query(f"WITH n AS ({_numbers('list_value')}) SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(numbers, lambda x: {{'k': list_transform(string_split(x, '.'), lambda p: CAST(p AS INT)), 's': x}})), lambda y: y.s), ' ') AS ordered FROM n")
def q_number_order(spark, sf_dir):
    """Dotted numbers in order of their parts."""
    return frame(spark, sf_dir, _numbers("array")).select("doc_id", F.array_join(qa.by_number(F.col("numbers")), " ").alias("ordered"))


_KNOWN = "SELECT id, route, CASE WHEN doc_id % 3 < 2 THEN 1 + doc_id % 2 END AS found, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'nao_verificado' WHEN 2 THEN NULL ELSE 'ok' END AS integrity FROM prev_row"


@query(f"WITH k AS ({_KNOWN}) SELECT id, coalesce(found, 0) <> 1 OR route IN ('', 'ERRO') AS without, coalesce(found, 0) <> 1 OR route IN ('', 'ERRO') OR coalesce(integrity, '') IN ('', 'nao_verificado') AS with_verifier, true AS forced FROM k")
def q_triage_again(spark, sf_dir):
    """Documents that are diagnosed again, without a verifier, with one, and forced."""
    c = F.col
    again = lambda verifier, forced=False: mf.needs_triage(c("route"), c("found"), 1, c("integrity"), verifier, forced)
    return frame(spark, sf_dir, _KNOWN).select("id", again(False).alias("without"), again(True).alias("with_verifier"), again(True, True).alias("forced"))
