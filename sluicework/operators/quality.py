"""Rules over whole documents: triage figures, cleaning, front matter, and the verdict on a converted text.

Each rule is a column expression over a document's own columns, so that a corpus is judged in one pass without
shuffling texts; only pages and pictures, which are rows of their own, are aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .curves import held

#: Where a text is cut into lines, and white space, as the rules take them (fixed values).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
#: Producers of scans with old recognised text (fixed values).
LEGACY = r"(?i)Acrobat (4|5)\.0|Acrobat Distiller (3|4|5)\.|PDFWriter|Import Plug-in|Paper Capture"
#: Fields of a front matter: those that must be there, and those that only a curator can add (fixed values).
FRONT, CURATED = ("emissor", "ano", "status", "idioma", "titulo", "rota", "origem_sha256", "paginas", "confianca_ocr"), ("codigo",)
#: Language of a document by that of its recognition (fixed values).
LANGUAGES = {"por": "pt-BR", "eng": "en", "deu": "de"}
#: A formula's comment, its picture if any, and its text (fixed values).
FORMULA = r"<!-- formula[^\n]*-->\n(!\[formula\]\([^)]+\)\n+)?`([^`\n]+)`"
REDACTED = "[redacted by a rule of the profile]"
SCANNED = ("C", "D", "E")


@dataclass(frozen=True)
class Limits:
    """When a document is rejected or reviewed."""

    coverage: float = 0.95
    confidence: float = 85.0
    scrambled: float = 0.20
    anchors: float = 0.9
    fragments: int = 50
    accuracy: float = 80.0


strip = tx.strip


def lines_of(c: Column) -> Column:
    """A text's lines; nothing follows a last line's end."""
    return tx.once(F.split(c, LINE_END, -1), lambda cut: F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut))


def broken(c: Column) -> Column:
    """A text cut at each of its breaks; between a carriage return and a line feed stands an empty line."""
    return F.split(c, f"[{_BREAKS}]", -1)


def any_hits(line: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.regexp_like(line, F.lit(p))
    return hit


def shown(items: Column, most: int, between: str = ", ") -> Column:
    """The first items, and dots if there are more."""
    return F.concat(F.array_join(F.slice(items, 1, most), between), F.when(F.size(items) > most, " ...").otherwise(""))


def characters(c: Column) -> Column:
    """Letters, digits and other characters of words."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", ""))


# --- triage -----------------------------------------------------------------------------------------


def page_figures(pages: DataFrame, key: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(key, pages, blank, poor, with_text, per_page): pages below 80 and below 400 characters, the share of others (2 places) and characters a page, rounded.

    A blank last page is what follows the last page's end, and not counted. One aggregation; no window over a document's pages.
    """
    n = F.length(strip(F.coalesce(F.col(text), F.lit(""))))
    made = pages.groupBy(key).agg(
        F.count("*").alias("all"), F.count_if(n < 80).alias("below"), F.count_if((n >= 80) & (n < 400)).alias("poor"), F.sum(n).alias("chars"), F.max(F.struct(F.col(page).alias("page"), n.alias("n"))).alias("last"),
    )
    gone = F.when((F.col("last.n") == 0) & (F.col("all") > 1), F.lit(1)).otherwise(F.lit(0))
    count, blank = F.col("all") - gone, F.col("below") - gone
    return made.select(key, count.alias("pages"), blank.alias("blank"), "poor", F.bround(1 - blank / count, 2).alias("with_text"), F.bround(F.col("chars") / count).cast("long").alias("per_page"))


def text_figures(c: Column) -> dict[str, Column]:
    """Shares of control characters, dirty tokens and stop words of a text's first 400,000 characters, to three places, and the number of tokens."""
    m = tx.triage(c)
    return {"tokens": m["tokens"], **{k: F.bround(m[f"frac_{k}"], 3) for k in ("ctrl", "dirty", "stop")}}


def image_coverage(images: DataFrame, sizes: DataFrame, key: str = "doc") -> DataFrame:
    """(key, images): the largest share of a page that a picture covers, over five pages spread evenly, to two places.

    images: key, page, width, height, x_ppi, y_ppi; sizes: key, pages, page_width, page_height in points.
    """
    seen = images.join(sizes, key).where(F.array_contains(tx.page_sample(F.col("pages").cast("int")), F.col("page").cast("int")) & (F.col("x_ppi") > 0) & (F.col("y_ppi") > 0))
    share = (F.col("width") / F.col("x_ppi") * 72 / F.col("page_width")) * (F.col("height") / F.col("y_ppi") * 72 / F.col("page_height"))
    most = seen.groupBy(key).agg(F.max(share).alias("m"))
    return sizes.select(key).join(most, key, "left").select(key, F.bround(F.greatest(F.lit(0.0), F.coalesce("m", F.lit(0.0))), 2).alias("images"))


def suspected(dirty: Column, images: Column, layer: Column, producer: Column) -> Column:
    """Old recognised text that reads well enough but is full of errors: a matter for eyes, not for a route."""
    return (dirty > 0.03) & ((images > 0.9) | layer | F.regexp_like(producer, F.lit(LEGACY)))


def to_review(route: Column, images: Column, layer: Column, suspicion: Column) -> Column:
    return layer | (images > 0.9) | suspicion | route.isin(*SCANNED)


def decided(curated: Column, found: Column) -> Column:
    """A curated value wins unless it is empty."""
    return F.coalesce(F.nullif(curated, F.lit("")), found)


def document_language(name: Column, recognised: Column, curated: Column) -> Column:
    """A curated language, that of a translation, of an issuer, or of the recognition's first language."""
    last = F.slice(F.split(name, "-"), F.greatest(F.lit(1), F.size(F.split(name, "-")) - 1), 2)
    first = F.get(F.split(F.coalesce(F.nullif(recognised, F.lit("")), F.lit("eng")), r"\+"), F.lit(0))
    known = F.lit("en")
    for k, v in LANGUAGES.items():
        known = F.when(first == k, v).otherwise(known)
    return F.coalesce(curated, F.when(F.array_contains(last, "PT"), "pt-BR").when(F.array_contains(last, "EN"), "en").when(F.startswith(name, F.lit("ABNT-")), "pt-BR").otherwise(known))


# --- cleaning ---------------------------------------------------------------------------------------


def cleaned(c: Column, lines: Sequence[str], spans: Sequence[str] = (), hyphens: bool = True, blanks: bool = True, headings: bool = True) -> dict[str, Column]:
    """text, and counts: lines, removed lines, removed spans. Lines with a page's anchor are never removed; what stays loses its spans and the blanks at its end."""
    kept = _kept(c, lines, spans)
    return {"text": _tidied(kept["kept"], spans, hyphens, blanks, headings), **{k: kept[k] for k in ("lines", "removed", "spans")}}


def with_cleaned(rows: DataFrame, text: str, lines: Sequence[str], spans: Sequence[str] = (), hyphens: bool = True, blanks: bool = True, headings: bool = True) -> DataFrame:
    """rows with what `cleaned` gives, in one pass: the lines that stay are found once, and the text is made of them."""
    rows = held(rows, _kept=_kept(F.col(text), lines, spans))
    return held(rows, text=_tidied(F.col("_kept.kept"), spans, hyphens, blanks, headings), **{k: F.col(f"_kept.{k}") for k in ("lines", "removed", "spans")}).drop("_kept")


def _cut(x: Column, spans: Sequence[str]) -> tuple[Column, Column]:
    """A line without its spans, and how many there were: each pattern sees what those before it have left."""
    n = F.lit(0)
    for p in spans:
        n, x = n + F.regexp_count(x, F.lit(p)), F.regexp_replace(x, p, "")
    return x, n


def _kept(c: Column, lines: Sequence[str], spans: Sequence[str]) -> Column:
    """kept: the lines that stay, with their spans; and the counts."""

    def told(all_lines: Column) -> Column:
        stays = lambda x: ~tx.once(strip(x), lambda bare: any_hits(bare, lines)) | tx.anchored(x)
        counted = lambda k: F.struct(
            k.alias("kept"), F.size(all_lines).alias("lines"), (F.size(all_lines) - F.size(k)).alias("removed"), (F.aggregate(k, F.lit(0), lambda a, x: a + _cut(x, spans)[1]) if spans else F.lit(0)).alias("spans"),
        )
        return tx.once(F.filter(all_lines, stays) if lines else all_lines, counted)

    return tx.once(lines_of(c), told)


def _tidied(kept: Column, spans: Sequence[str], hyphens: bool, blanks: bool, headings: bool) -> Column:
    """Lines without spans and blanks at their ends as a text, with words joined, blanks collapsed and headings marked."""
    without = lambda x: F.coalesce(F.nullif(F.rtrim(x, F.lit(tx.WHITE)), F.lit("")), x)  # noqa: E731  blank lines stay as they are
    text = F.array_join(F.transform(F.transform(kept, lambda x: _cut(x, spans)[0]) if spans else kept, without), "\n")
    if hyphens:
        text = tx.dehyphenate(text)

    def open_(x: Column) -> Column:
        """A line with what it becomes before it is looked at as a heading; none for lines that stay."""
        stays = F.regexp_like(x, F.lit(r"^\s*(?:[|`#]|<!--|!\[)")) | tx.anchored(x)
        return F.struct(x.alias("line"), F.when(~stays, tx.single_blanks(x) if blanks else x).alias("open"))

    formatted = F.transform(F.transform(lines_of(text), open_), lambda p: F.coalesce(tx.heading(p["open"]) if headings else p["open"], p["line"]))
    return tx.squeeze(F.array_join(formatted, "\n"))


def redacted_layout(layout: Column, patterns: Sequence[str]) -> Column:
    """The texts of a layout (array of struct<text, orig, ...>) with those that a pattern hits replaced, in both fields where they have a value; boxes and pages stay."""
    target = lambda t: F.coalesce(F.nullif(t["text"], F.lit("")), t["orig"], F.lit(""))
    hit = lambda t: (target(t) != "") & any_hits(target(t), patterns)
    put = lambda t, f: F.when(hit(t) & (F.coalesce(t[f], F.lit("")) != ""), F.lit(REDACTED)).otherwise(t[f])
    return F.transform(layout, lambda t: t.withField("text", put(t, "text")).withField("orig", put(t, "orig")))


def rescued_titles(layout: Column, furniture: str = "furniture") -> Column:
    """Texts outside the body that read as a numbered title, as headings; layout: array of struct<text, layer>."""
    numbered = F.filter(layout, lambda t: (t["layer"] == furniture) & F.regexp_like(t["text"], F.lit(r"^[1-9]\d?(?:\.\d{1,3})*\s+[A-ZÀ-ÖØ-Ý]")))
    return F.transform(numbered, lambda t: F.concat(F.lit("## "), t["text"]))


def clean_state(text: Column, lines: Column, removed: Column, limit: float = 0.25) -> tuple[Column, Column]:
    """(state, whether much was removed): empty results and lost anchors fail."""
    state = F.when(strip(text) == "", "falhou").when(~F.regexp_like(text, F.lit(tx.ANCHOR)), "falhou").otherwise("ok")
    return state, removed / F.greatest(lines, F.lit(1)) > limit


def structure_state(md: Column, source: Column, pages: Column, share: float = 0.5) -> tuple[Column, Column]:
    """(state, whether few pages have anchors): a conversion that loses half of the characters fails."""
    return F.when(characters(md) / F.greatest(F.lit(1), characters(source)) < share, "falhou").otherwise("ok"), F.size(anchors(md)) < pages * share


def recognition_state(per_page: Column, control: Column, confidence: Column, least: float = 50, limits: Limits = Limits()) -> tuple[Column, Column]:
    """(state, whether to look): text that is nearly absent fails; else control characters that are left and low confidence are looked at."""
    failed = per_page < least
    return F.when(failed, "falhou").otherwise("ok"), ~failed & ((control > 0.01) | F.coalesce(confidence < limits.confidence, F.lit(False)))


def time_limit(pages: Column) -> Column:
    return F.greatest(F.lit(300).cast("long"), 30 * pages + 120)


def integrity(code: Column, said: Column, path: Column | None = None) -> Column:
    """What a verifier found: `ok`, `avisos: ...`, `erro: ...` with its first message (120 characters, without the file's path) and how many more warnings there were, or `nao_verificado`."""
    told = F.transform(F.filter(lines_of(F.coalesce(said, F.lit(""))), lambda x: F.regexp_like(x, F.lit("(?i)error|warning"))), strip)
    more = F.size(F.filter(told, lambda x: F.regexp_like(x, F.lit("(?i)warning")))) - 1
    first = F.coalesce(F.get(told, F.lit(0)), F.lit(""))
    if path is not None:
        literal = F.concat(F.lit(r"\Q"), F.replace(path, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E:?[\s\x1c-\x1f]*"))
        first = F.when(F.coalesce(path, F.lit("")) == "", first).otherwise(F.regexp_replace(first, literal, F.lit("")))
    message = F.concat(first, F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" avisos)"))).otherwise(""))
    shown_ = F.left(message, F.lit(120))
    wrong = F.when(shown_ != "", shown_).otherwise(F.concat(F.lit("rc="), code.cast("string")))
    return F.when(code.isNull(), "nao_verificado").when(code == 0, "ok").when(code == 3, F.concat(F.lit("avisos: "), shown_)).otherwise(F.concat(F.lit("erro: "), wrong))


# --- items ------------------------------------------------------------------------------------------


def items(c: Column) -> Column:
    """Numbers of the numbered items that begin a text's lines, in order."""
    return _items(broken(c))


def _items(lines: Column) -> Column:
    """Few lines begin as an item does; only they are looked at in full."""
    return F.filter(F.transform(F.filter(lines, lambda x: F.regexp_like(x, F.lit(tx.ITEM))), tx.item), lambda x: x.isNotNull())


def lost_items(md: Column, source: Column) -> Column:
    """Items of the source that stand nowhere in the text as a token, in order. Table and code lines of the text do not count.

    The text's dotted numbers are drawn once, with all that each of them begins with; no item is searched by itself.
    """
    return _lost(broken(md), broken(source))


def _lost(lines: Column, source: Column) -> Column:
    table = lambda x: F.left(F.ltrim(x, F.lit(tx.WHITE)), F.lit(1)).isin("|", "`")
    body = F.concat(F.array_join(F.filter(lines, lambda x: ~table(x)), "\n"), F.lit("\n"))
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?U)(?<![\d.])\d[\d.]*[\s\x1c-\x1f)\]:-]?"), F.lit(0)))
    closed = F.array_distinct(F.transform(found, lambda f: F.regexp_replace(f, r"(?U)[\s\x1c-\x1f)\]:-]\z", ".")))

    def begun(run: Column) -> Column:
        parts = F.split(run, r"\.", -1)
        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).otherwise(F.array().cast("array<string>"))

    return F.array_except(_items(source), F.flatten(F.transform(closed, begun)))


def by_number(numbers: Column) -> Column:
    """Dotted numbers in order of their parts: 4.9 before 4.10."""
    return F.transform(F.array_sort(F.transform(numbers, lambda s: F.struct(F.transform(F.split(s, r"\."), lambda p: p.cast("int")).alias("k"), s.alias("s")))), lambda x: x["s"])


def missing_numbers(found: Column) -> Column:
    """Numbers absent between the least and the largest under parents with three or more, in order.

    Distinct numbers stand sorted by their parts, those of one parent beside each other, so that each is compared with its neighbour alone.
    """
    parts = lambda x: F.transform(F.split(x, r"\."), lambda p: p.cast("int"))
    split = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.struct(F.slice(parts(x), F.lit(1), F.size(F.split(x, r"\.")) - 1).alias("up"), F.element_at(parts(x), -1).alias("n")))))

    def told(all_: Column) -> Column:
        def after(x: Column, i: Column) -> Column:
            same = lambda j: F.coalesce(F.get(all_, j)["up"] == x["up"], F.lit(False)) & (j >= 0)
            three = same(i + 1) & (same(i + 2) | same(F.greatest(i - 1, F.lit(0))) & (i > 0))
            to = F.get(all_, i + 1)["n"]
            name = F.array_join(F.transform(x["up"], lambda p: p.cast("string")), ".")
            return F.when(three & (to > x["n"] + 1), F.transform(F.sequence(x["n"] + 1, to - 1), lambda n: F.concat(name, F.lit("."), n.cast("string")))).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(all_, after))

    return by_number(F.get(F.transform(F.array(split), told), F.lit(0)))


def formulas(md: Column) -> tuple[Column, Column, Column]:
    """(all, with a picture, out of order): a formula without an equals sign, or that ends in one, was read out of order."""
    texts, pictures = (F.regexp_extract_all(md, F.lit(FORMULA), F.lit(k)) for k in (2, 1))
    wrong = F.filter(texts, lambda x: ~F.contains(x, F.lit("=")) | F.endswith(strip(x), F.lit("=")))
    return F.size(texts), F.size(F.filter(pictures, lambda x: x != "")), F.size(wrong)


def blocked(md: Column, patterns: Sequence[str]) -> Column:
    """What each pattern hits first, cut to 40 characters."""
    return F.array_compact(F.array(*(F.when(F.regexp_like(md, F.lit(p)), F.left(F.regexp_substr(md, F.lit(p)), F.lit(40))) for p in patterns))) if patterns else F.array().cast("array<string>")


def anchors(md: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(md, F.lit(tx.ANCHOR), F.lit(1)), lambda p: p.try_cast("int")))


def coverage(md: Column, source: Column, removed: Sequence[str] = ()) -> tuple[Column, Column]:
    """(share, of how many): characters of the source that reached the text; lines that cleaning takes away are not asked for."""
    wanted = _wanted(broken(source), removed) if removed else characters(source)
    return F.when(wanted > 0, characters(md) / wanted).otherwise(F.lit(0.0)), wanted


def _wanted(lines: Column, removed: Sequence[str]) -> Column:
    return characters(F.array_join(F.filter(F.transform(lines, strip), lambda x: ~any_hits(x, removed)), "\n"))


# --- front matter -----------------------------------------------------------------------------------


#: Texts that a reader takes, or may take, for something else than a text: null, truth, numbers, dates and marks (fixed values).
_OTHER = (
    r"^(?:~|null|Null|NULL|yes|Yes|YES|no|No|NO|true|True|TRUE|false|False|FALSE|on|On|ON|off|Off|OFF|<<|=|n/a)$"
    r"|^[-+]?(?:0b[0-1_]+|0[0-7_]+|0|[1-9][0-9_]*|0x[0-9a-fA-F_]+|[1-9][0-9_]*(?::[0-5]?[0-9])+)$"
    r"|^(?:[-+]?[0-9][0-9_]*\.[0-9_]*(?:[eE][-+][0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?|[-+]?[0-9][0-9_]*(?::[0-5]?[0-9])+\.[0-9_]*|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$"
    r"|^\d{4}-\d\d?-\d\d?(?:(?:[Tt]|[ \t]+)\d\d?:\d\d:\d\d(?:\.\d*)?(?:[ \t]*(?:Z|[-+]\d\d?(?::\d\d)?))?)?$"
)
#: Texts with a sign that would begin or end something (fixed values).
_SIGNS = r"^[\s,\[\]{}#&*!|>'\"%@`]|^[-?:](?:\s|$)|^---|^\.\.\.|:(?:\s|$)|\s#|\s$"


def yaml_text(c: Column) -> Column:
    """A text as a value on a line: as it is where it reads as that text, else between quotes; breaks and control characters are escaped."""
    odd = F.regexp_like(c, F.lit(rf"[\x00-\x1f\x7f-\x9f\x{{2028}}\x{{2029}}\x{{feff}}]"))
    escaped = F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    for ch in "\x7f\x85\u2028\u2029\ufeff":
        escaped = F.replace(escaped, F.lit(ch), F.lit(f"\\u{ord(ch):04x}"))
    single = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(c.isNull(), "null").when(odd, escaped).when((c == "") | F.regexp_like(c, F.lit(_OTHER)) | F.regexp_like(c, F.lit(_SIGNS)), single).otherwise(c)


#: Fields of a front matter that are numbers (fixed values).
FRONT_NUMBERS = ("ano", "paginas")


def front_matter(fields: dict[str, Column], numbers: Sequence[str] = FRONT_NUMBERS) -> Column:
    """A block of `name: value` lines between dashes; texts that could be read as something else are quoted, null stays null. numbers: names whose values are numbers."""
    value = lambda k, c: F.coalesce(c.cast("string"), F.lit("null")) if k in numbers else yaml_text(c.cast("string"))
    return F.concat(F.lit("---\n"), *(F.concat(F.lit(f"{k}: "), value(k, c), F.lit("\n")) for k, c in fields.items()), F.lit("---\n"))


def front_fields(rows: DataFrame) -> dict[str, Column]:
    """The twelve fields of a document's front matter, by name and in order; those of a curator win.

    rows: id, status_doc, idioma_ocr, rota_efetiva, arquivo_origem, sha256_origem, paginas, conf_ocr_media, and the curator's c_emissor, c_codigo, c_ano, c_idioma, c_titulo where there are any.
    """
    c = F.col
    curated = lambda n: F.nullif(c(f"c_{n}").cast("string"), F.lit("")) if f"c_{n}" in rows.columns else F.lit(None).cast("string")
    issuer, code, year = tx.id_parts(c("id"))
    return {
        "id": c("id"), "emissor": F.coalesce(curated("emissor"), issuer), "codigo": F.coalesce(curated("codigo"), code), "ano": F.coalesce(curated("ano"), year).try_cast("int"),
        "status": F.coalesce(F.nullif(c("status_doc"), F.lit("")), F.lit("nao_declarado")), "idioma": document_language(c("id"), c("idioma_ocr"), c("c_idioma") if "c_idioma" in rows.columns else F.lit(None).cast("string")),
        "titulo": F.coalesce(curated("titulo"), tx.title(c("id"))), "rota": c("rota_efetiva"), "origem": c("arquivo_origem"), "origem_sha256": c("sha256_origem"),
        "paginas": F.coalesce(c("paginas").try_cast("int"), F.lit(0)), "confianca_ocr": F.coalesce(F.nullif(c("conf_ocr_media"), F.lit("")), F.lit("n/a")),
    }


def with_metadata(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """rows with the last stage's result: final (the text under its front matter), state, summary and warning.

    rows: what `front_fields` reads, md and st_limpeza. A text that has not been cleaned waits; one without a page's anchor fails; neither has a final text.
    """
    c = F.col
    fields = front_fields(rows)
    marked = held(rows, _marked=F.size(anchors(c("md"))), _pages=fields["paginas"], _status=fields["status"])
    share = c("_marked") / F.greatest(c("_pages"), F.lit(1))
    waits = (F.coalesce(c("st_limpeza"), F.lit("")) != "ok") | c("md").isNull()
    untitled = F.nullif(c("c_titulo"), F.lit("")).isNull() if "c_titulo" in rows.columns else F.lit(True)
    warnings = [
        F.when(share < limits.anchors, F.concat((c("_pages") - c("_marked")).cast("string"), F.lit(" paginas sem ancora"))),
        F.when(c("_status") == "nao_declarado", F.lit("status nao declarado: ponha `status` no override")), F.when(untitled, F.lit("titulo derivado do nome do arquivo: ponha `titulo` no override")),
    ]
    ok = ~waits & (c("_marked") > 0)
    text = F.concat(front_matter(fields), F.lit("\n"), F.regexp_replace(c("md"), r"(?U)^[\s\x1c-\x1f]+", ""))
    summary = F.concat(c("_marked").cast("string"), F.lit("/"), c("_pages").cast("string"), F.lit(" paginas com ancora ("), F.bround(share * 100).cast("long").cast("string"), F.lit("%), status "), c("_status"))
    none = "documento sem ancora <!-- p.N -->: sem rastreabilidade norma -> item -> pagina"
    done = {
        "final": F.when(ok, text), "state": F.when(waits, "pendente").when(ok, "ok").otherwise("falhou"), "summary": F.when(ok, summary).otherwise(""),
        "warning": F.when(waits, "aguarda limpar (etapa 5)").when(ok, F.array_join(F.array_compact(F.array(*warnings)), "; ")).otherwise(none),
    }
    return marked.withColumns(done).drop("_marked", "_pages", "_status")


#: Values of a front matter that stand for none (fixed values).
EMPTY = ("", "null", "~", "''", '""')


def front_head(md: Column) -> Column:
    """The lines of a front matter at a text's begin; empty without one."""
    return F.regexp_extract(md, r"(?s)\A---\n(.*?)---\n", 1)


def _bare(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)


def front_values(md: Column, names: Sequence[str]) -> Column:
    """(name -> value) of a front matter at a text's begin; null for what is not there, empty or null."""
    read = lambda h, n: F.when(~_bare(h, n).isin(*EMPTY), F.regexp_replace(_bare(h, n), r"^'(.*)'$|^\"(.*)\"$", "$1$2"))
    return F.get(F.transform(F.array(front_head(md)), lambda h: F.create_map(*(x for n in names for x in (F.lit(n), read(h, n))))), F.lit(0))


def front_missing(md: Column, names: Sequence[str]) -> Column:
    """Names without a value; all of them where there is no front matter. The head is drawn from the text once, and each name is one pattern over it."""
    return F.get(F.transform(F.array(front_head(md)), lambda h: F.array_compact(F.array(*(F.when(_bare(h, n).isin(*EMPTY), F.lit(n)) for n in names)))), F.lit(0))


# --- verdict ----------------------------------------------------------------------------------------

#: Columns that `judge` reads, beside the key.
JUDGED = ("md", "source", "route", "extras", "pages", "confidence", "table_state", "tables", "low_tables", "layout_tables", "status")


#: What a code says to its reader, with how many there are and the first of them (fixed values).
MESSAGES = {
    "no_source": "pdftotext nao devolveu texto do PDF de entrada", "coverage": "cobertura de texto {} < {}", "lost_items": "{} item(ns) do PDF ausentes no corpus: {}", "blocked": "texto bloqueado no corpus: {}",
    "no_anchor": "sem ancora <!-- p.N -->", "front_matter": "front-matter incompleto: {}", "no_tables": "rota F sem tabela extraida (etapa 4)", "gaps": "{} lacuna(s) na numeracao do corpus: {}",
    "fragmented": "numeracao do corpus muito fragmentada ({} lacunas): provavel ruido de OCR na numeracao", "unpictured": "{} de {} formulas sem recorte fiel",
    "scrambled": "{} de {} formulas com ordem de leitura suspeita ({}): confira pelos recortes", "anchors": "{} pagina(s) sem ancora", "uncurated": "front-matter sem {}: preencha no override",
    "confidence": "confianca media de OCR {} < {}", "low_tables": "{} tabela(s) com acuracia < {}: {}", "fewer_tables": "Docling viu {} tabelas, o Camelot extraiu {}", "no_status": "status do documento nao declarado no override",
}


def message(name: str, *values: Column | str | float) -> Column:
    """A code's message with its values put in."""
    parts = MESSAGES[name].split("{}")
    cells = [v.cast("string") if isinstance(v, Column) else F.lit(f"{v:g}" if isinstance(v, float) else v) for v in values]
    return F.concat(F.lit(parts[0]), *(x for v, p in zip(cells, parts[1:], strict=True) for x in (v, F.lit(p))))


def quoted(c: Column) -> Column:
    """A text between quotes: double ones where it holds a single one and no double one; breaks, tabs and backslashes are escaped."""
    plain = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for ch, told in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(ch), F.lit(told))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def judge(docs: DataFrame, removed: Sequence[str] = (), blocks: Sequence[str] = (), limits: Limits = Limits(), messages: bool = False) -> DataFrame:
    """docs with verdict, rejects and reviews (arrays of codes), coverage (3 places) and lost (the first 20 lost items); with messages also reject_notes and review_notes, what each code says.

    docs: JUDGED, where extras are joined by +, low_tables is an array of tables below the accuracy asked for, and tables is a text.
    Lost items reject documents with native text; where the numbering itself was recognised they call for review.
    """
    c = F.col
    cuts = [*removed, *blocks]
    docs = held(docs, _lines=broken(c("md")), _from=broken(c("source")))
    wanted = _wanted(c("_from"), cuts) if cuts else characters(c("source"))
    total, pictured, scrambled = formulas(c("md"))
    rows = held(docs, _wanted=wanted, _characters=characters(c("md")), _items=_items(c("_lines")), _lost=_lost(c("_lines"), c("_from")), _total=total, _pictured=pictured, _scrambled=scrambled, _anchors=F.size(anchors(c("md"))), _front=front_missing(c("md"), FRONT), _curated=front_missing(c("md"), CURATED), _blocked=blocked(c("md"), blocks)).drop("_lines", "_from")
    rows = held(rows, _gaps=missing_numbers(c("_items")), _share=F.when(c("_wanted") > 0, c("_characters") / c("_wanted")).otherwise(F.lit(0.0)))
    lost, native, scanned = F.size("_lost") > 0, c("route").isin("A", "B"), c("route").isin(*SCANNED)
    with_tables = F.array_contains(F.split(F.coalesce("extras", F.lit("")), r"\+"), "F")
    number = F.when(F.regexp_like("tables", F.lit(r"^\d+$")), c("tables").cast("int")).otherwise(F.lit(0))
    no_tables = (F.coalesce("table_state", F.lit("")) != "ok") | (F.coalesce(number, F.lit(0)) == 0)
    told = F.expr("try_cast(confidence AS DOUBLE)")
    code = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    rejects = [
        code(c("_wanted") == 0, "no_source"), code((c("_wanted") > 0) & (c("_share") < limits.coverage), "coverage"), code(lost & native, "lost_items"), code(F.size("_blocked") > 0, "blocked"),
        code(c("_anchors") == 0, "no_anchor"), code(F.size("_front") > 0, "front_matter"), code(with_tables & no_tables, "no_tables"),
    ]
    reviews = [
        code(lost & ~native, "lost_items"), code((F.size("_gaps") > 0) & (F.size("_gaps") <= limits.fragments), "gaps"), code(F.size("_gaps") > limits.fragments, "fragmented"),
        code(c("_pictured") < c("_total"), "unpictured"), code((c("_total") > 0) & (c("_scrambled") / F.greatest(c("_total"), F.lit(1)) > limits.scrambled), "scrambled"),
        code((c("_anchors") > 0) & (c("pages") > 0) & (c("_anchors") / F.greatest(c("pages"), F.lit(1)) < limits.anchors), "anchors"), code(F.size("_curated") > 0, "uncurated"),
        code(scanned & (told < limits.confidence), "confidence"), code(with_tables & ~no_tables & (F.size("low_tables") > 0), "low_tables"),
        code((c("layout_tables") > 0) & (c("table_state") == "ok") & (number < c("layout_tables")), "fewer_tables"), code(F.coalesce("status", F.lit("")).isin("", "nao_declarado"), "no_status"),
    ]
    rows = held(rows, rejects=F.array_compact(F.array(*rejects)), reviews=F.array_compact(F.array(*reviews)), coverage=F.bround("_share", 3), lost=F.slice("_lost", 1, 20))
    rows = rows.withColumn("verdict", F.when(F.size("rejects") > 0, "reprovado").when(F.size("reviews") > 0, "revisar").otherwise("aprovado"))
    if messages:
        whole = lambda x: F.concat(F.bround(x * 100).cast("long").cast("string"), F.lit("%"))
        said = {
            "coverage": (F.concat(F.format_string("%.1f", c("_share") * 100), F.lit("%")), f"{limits.coverage:.0%}"), "lost_items": (F.size("_lost"), shown(c("_lost"), 8)), "blocked": (F.array_join(F.transform("_blocked", quoted), ", "),),
            "front_matter": (F.array_join("_front", ", "),), "gaps": (F.size("_gaps"), shown(c("_gaps"), 8)), "fragmented": (F.size("_gaps"),), "unpictured": (c("_total") - c("_pictured"), c("_total")),
            "scrambled": (c("_scrambled"), c("_total"), whole(c("_scrambled") / F.greatest(c("_total"), F.lit(1)))), "anchors": (c("pages") - c("_anchors"),), "uncurated": (F.array_join("_curated", ", "),),
            "confidence": (F.bround(told).cast("long"), f"{limits.confidence:.0f}"), "low_tables": (F.size("low_tables"), limits.accuracy, F.array_join(F.slice("low_tables", 1, 5), ", ")), "fewer_tables": (c("layout_tables"), number),
        }
        table = F.create_map(*(x for n in MESSAGES for x in (F.lit(n), message(n, *said.get(n, ())))))
        rows = held(rows, _said=table).withColumns({f"{k}_notes": F.transform(f"{k}s", lambda n: F.try_element_at(F.col("_said"), n)) for k in ("reject", "review")})
    return rows.drop(*(n for n in rows.columns if n.startswith("_")))


def low_tables(index: DataFrame, key: str = "doc", limits: Limits = Limits()) -> DataFrame:
    """(key, low_tables): what an index of tables holds below the accuracy asked for, as `file (p.page, accuracy)`, in the index's order; rows that are malformed are skipped.

    index: key, pos, arquivo, pagina, acuracia.
    """
    low = index.where(F.expr("try_cast(acuracia AS DOUBLE)") < limits.accuracy)
    label = F.concat("arquivo", F.lit(" (p."), F.col("pagina").cast("string"), F.lit(", "), F.col("acuracia").cast("string"), F.lit(")"))
    return low.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", label.alias("t")))), lambda r: r["t"]).alias("low_tables"))
