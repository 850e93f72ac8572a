"""Text rules of technical documents as column expressions: ids, cleaning, numbered items, triage metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decomposed import ascii_folded

#: Stop words of the three languages (fixed values); tokens have three letters or more, so that shorter ones never count.
STOPWORDS = (
    "de", "da", "do", "das", "dos", "que", "para", "com", "ser", "uma", "nao", "por", "como", "deve", "devem",
    "the", "and", "for", "shall", "with", "this", "that", "are", "from", "not", "any", "which", "have", "been",
    "der", "die", "und", "des", "den", "fur", "mit", "ist", "nach", "bei",
)
#: Units that are no headings (fixed values).
UNITS = ("Pa", "kPa", "MPa", "GPa", "N", "kN", "MN", "Nm", "kgf", "kg", "g", "t", "mm", "cm", "m", "km", "in", "ft", "psi", "ksi", "bar", "Hz", "rpm", "W", "kW", "V", "A", "C", "K", "L", "s", "min", "h", "%")
#: Characters that LaTeX reads otherwise, and what stands for them (fixed values).
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "μ": r"\ensuremath{\mu}", "µ": r"\ensuremath{\mu}", "\n": " ", "\r": " "}
#: Qualifiers of ids, and the patterns of anchors, numbered items and headings (fixed values).
QUALIFIERS = {"PROJETO": "projeto", "CANCELADA": "cancelada", "PT": "traducao", "EN": "traducao"}
ANCHOR = r"<!-- p\.(\d+) -->"
ITEM = r"(?U)^(?:#{1,6}[\s\x1c-\x1f]+|[-*][\s\x1c-\x1f]+)?([1-9]\d?(?:\.\d{1,3})+)[\s\x1c-\x1f]+([A-ZÀ-ÖØ-Ý][^\s\x1c-\x1f]*)"
HEADING = r"(?U)^(?:[-*][\s\x1c-\x1f]+)?([1-9]\d?(?:\.\d{1,3})*)[\s\x1c-\x1f]+([A-ZÀ-ÖØ-Ý][^=]{0,199})$"


#: Characters that are white space to the rules: Unicode's, and the four separators of information (fixed values).
WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f reads it: within functions over arrays nothing else keeps a costly expression from being copied."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """A text without the white space at its ends, which alone are looked at."""
    return F.trim(c, F.lit(WHITE))


def plain(c: Column) -> Column:
    """What of a text's compatibility decomposition is ASCII: letters without accents, ligatures and forms taken apart."""
    return ascii_folded(c)


def slug(c: Column) -> Column:
    """A document id: runs of other characters become one dash, repeated dashes and dots one, none at the ends."""
    s = F.regexp_replace(plain(c), r"[^\p{Alnum}.]+", "-")  # letters and digits of ASCII alone, as one test a character
    return F.trim(F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), r"\.{2,}", "."), F.lit("-."))


def file_slug(c: Column, default: str = "file", most: int = 80) -> Column:
    """A file's name that keeps letters of any script; runs of other characters are an underscore, none at the ends.

    The begin of a text suffices where it gives more than is shown and does not end there; else the whole text is looked at.
    """
    marked = lambda t: F.ltrim(F.regexp_replace(t, r"[^\p{L}\p{N}_-]+", "_"), F.lit("_"))
    shown = once(marked(F.left(c, F.lit(16 * most))), lambda s: F.left(F.when(F.length(F.rtrim(s, F.lit("_"))) > most, s).otherwise(F.rtrim(marked(c), F.lit("_"))), F.lit(most)))
    return once(shown, lambda s: F.when(s == "", default).otherwise(F.coalesce(s, F.lit(default))))


def safe_name(c: Column, default: str = "selecao") -> Column:
    """A file's name that every file system takes: without accents, runs of other characters are a dash, none nor underscores at the ends."""
    s = F.trim(F.regexp_replace(plain(c), r"[^\p{Alnum}._-]+", "-"), F.lit("-_"))
    return once(s, lambda s: F.when(F.coalesce(s, F.lit("")) == "", default).otherwise(s))


def name_fits(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^[A-Z]+-([A-Za-z0-9.-]+-)?(19|20)\d{2}-[A-Za-z0-9][A-Za-z0-9.-]*$"))


def id_parts(c: Column) -> tuple[Column, Column, Column]:
    """(issuer, code, year): the first later part that is a year divides code and title; letters and digits of a code are set apart once."""
    t = F.split(c, "-")
    rest = F.slice(t, 2, 1000)
    year = F.coalesce(F.get(F.filter(rest, lambda p: F.regexp_like(p, F.lit(r"^(19|20)\d{2}$"))), F.lit(0)), F.lit(""))
    at = F.when(year != "", F.array_position(rest, year).cast("int")).otherwise(F.lit(1))
    code = F.array_join(F.slice(rest, F.lit(1), at - 1), "-")
    return F.get(t, F.lit(0)), F.regexp_replace(code, r"^(.*?[A-Za-z]{2})(\d)", "$1 $2"), year


def _last_two(c: Column) -> Column:
    t = F.split(c, "-")
    return F.slice(t, F.greatest(F.lit(1), F.size(t) - 1), 2)


def language(c: Column) -> Column:
    last = _last_two(c)
    issuer = F.get(F.split(c, "-"), F.lit(0))
    return F.when(F.array_contains(last, "PT"), "por").when(F.array_contains(last, "EN"), "eng").when(issuer == "ABNT", "por").when(issuer == "DIN", "deu+eng").otherwise("eng")


def status(c: Column) -> Column:
    first = F.get(F.filter(F.split(c, "-"), lambda t: t.isin(*QUALIFIERS)), F.lit(0))
    out = F.lit("")
    for k, v in QUALIFIERS.items():
        out = F.when(first == k, v).otherwise(out)
    return out


def title(c: Column) -> Column:
    """The words after the year, without qualifiers; the id itself if there are none."""
    t = F.split(c, "-")
    _, _, year = id_parts(c)
    begin = F.when(year != "", F.array_position(t, year).cast("int") + 1).otherwise(F.lit(2))
    words = F.filter(F.slice(t, begin, F.lit(1000)), lambda p: ~p.isin(*QUALIFIERS, "2ED"))
    out = F.replace(F.array_join(words, " "), F.lit("_"), F.lit(" "))
    return F.when(out == "", c).otherwise(out)


def numbered_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 0, line): no row for what follows a last newline."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"), F.col(text).alias("_t"))
    return lines.where(~((F.col("line") == "") & (F.col("line_no") == F.size(F.split("_t", "\n")) - 1))).drop("_t")


def protected(line: Column) -> Column:
    """A table, code, comment or image, or a line with a page's anchor."""
    return F.regexp_like(line, F.lit(r"^\s*(\||`|<!--|!\[)")) | anchored(line)


def anchored(line: Column) -> Column:
    """Whether a page's anchor is in a line; most lines do not even hold its begin."""
    return F.contains(line, F.lit("<!-- p.")) & F.regexp_like(line, F.lit(ANCHOR))


def keep_lines(lines: DataFrame, patterns: Sequence[str], line: str = "line") -> DataFrame:
    """Lines that no pattern hits; anchors are immune."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.regexp_like(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), F.lit(p))
    return lines.where(F.regexp_like(line, F.lit(ANCHOR)) | ~hit)


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, r"([\p{L}\p{N}_])-[ \t]*\n[ \t]*([a-zà-ÿ])", "$1$2")


def collapse(line: Column) -> Column:
    """Runs of blanks between words become one; protected lines and headings stay."""
    return F.when(protected(line) | F.regexp_like(line, F.lit(r"^\s*#")), line).otherwise(single_blanks(line))


def single_blanks(line: Column) -> Column:
    """Runs of blanks between words become one; a line without two blanks beside each other is not searched."""
    return F.when(F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")), F.regexp_replace(line, r"(?<=\S)[ \t]{2,}(?=\S)", " ")).otherwise(line)


def heading(line: Column) -> Column:
    """A numbered title as a heading; a line that does not begin as one stays unsearched."""
    number = F.regexp_extract(line, HEADING, 1)
    level = F.least(F.lit(6), F.size(F.split(number, r"\.")) + 1)
    begins = F.left(line, F.lit(1)).isin(*"-*123456789")
    return F.when(begins & (number != ""), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), number, F.lit(" "), F.regexp_extract(line, HEADING, 2))).otherwise(line)


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, parent_line) of each heading: the parent is the last heading before it of a lower level (null: none).

    lines: doc_id, line_no, line. For each level the last line that has it is carried along in one window over the document's
    headings; the nearest of those above a heading's own level is the top of the stack.
    """
    marks = F.length(F.regexp_extract("line", r"(?U)^(#{1,6})[\s\x1c-\x1f]+[^\s\x1c-\x1f]", 1))
    heads = lines.select("doc_id", "line_no", marks.alias("level")).where("level > 0")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = heads.withColumns({f"_{k}": F.last(F.when(F.col("level") == k, F.col("line_no")), ignorenulls=True).over(before) for k in range(1, 6)})
    return last.select("doc_id", "line_no", "level", F.greatest(*(F.when(F.col("level") > k, F.col(f"_{k}")) for k in range(1, 6))).alias("parent_line"))


def squeeze(c: Column) -> Column:
    return F.concat(strip(F.regexp_replace(c, r"\n{3,}", "\n\n")), F.lit("\n"))


def item(line: Column) -> Column:
    """The number of a numbered item that begins a line, or null: tables, formulas, contents, material codes and values with units are none."""
    t = strip(line)
    number, word = F.regexp_extract(line, ITEM, 1), F.regexp_extract(line, ITEM, 2)
    head = F.regexp_replace(word, r"^[.,;:()]+|[.,;:()]+$", "")
    letters = F.regexp_count(F.regexp_replace(line, ITEM, word), F.lit(r"[\p{L}\p{Nl}\p{No}]"))
    none = F.regexp_like(t, F.lit(r"^(\||`|<!--|!\[)")) | F.contains(t, F.lit(" = ")) | F.regexp_like(t, F.lit(r"(?U)\.{3,}\s*\d*\s*$|\.{5,}")) | (number == "") | F.regexp_like(head, F.lit("^[A-Z0-9./-]{2,}$")) | head.isin(*UNITS) | F.contains(head, F.lit("/")) | (letters < 4)
    return F.when(~none, number)


def tokens(c: Column, most: int = 400_000) -> Column:
    return F.filter(F.regexp_extract_all(F.left(c, F.lit(most)), F.lit("[A-Za-zÀ-ÿ0-9]{3,}"), F.lit(0)), lambda t: F.regexp_like(t, F.lit("[A-Za-zÀ-ÿ]")))


def triage(c: Column) -> dict[str, Column]:
    """Shares of control characters, of dirty tokens and of stop words, and the number of tokens."""
    t = tokens(c)
    n = F.greatest(F.lit(1), F.size(t))
    sample = F.left(c, F.lit(400_000))
    dirty = F.filter(t, lambda w: F.regexp_like(w, F.lit(r"[a-zà-ÿ][A-ZÀ-Ý]|[A-Za-zÀ-ÿ]\d|\d[a-zà-ÿ]")))
    stop = F.filter(t, lambda w: F.lower(w).isin(*STOPWORDS))
    control = F.regexp_count(sample, F.lit(r"[\x00-\x08\x0b\x0e-\x1f\p{Co}\p{Cn}]"))
    return {"frac_ctrl": control / F.greatest(F.lit(1), F.length(sample)), "frac_dirty": F.size(dirty) / n, "frac_stop": F.size(stop) / n, "tokens": F.size(t)}


def route(with_text: Column, ctrl: Column, dirty: Column, tokens_: Column, stop: Column, per_page: Column, images: Column) -> Column:
    corrupt = (ctrl > 0.02) | (dirty > 0.25) | ((tokens_ > 300) & (stop < 0.03))
    return F.when(with_text < 0.10, "C").when(corrupt, "D").when(with_text < 0.90, "E").when((per_page > 2200) | (images > 0.9), "B").otherwise("A")


def page_sample(n: Column, points: int = 5) -> Column:
    """Pages spread evenly from first to last; halves go to the even page."""
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.greatest(F.lit(1), F.bround(1 + k * (n - 1) / (points - 1)).cast("int")))
    return F.array_sort(F.array_distinct(at))


def page_ranges(c: Column, total: Column) -> Column:
    """Distinct sorted pages of '3-5,9' or 'all', held within 1 and the total; null if the text is none."""
    last = F.greatest(total, F.lit(1))

    def span(part: Column) -> Column:
        a = F.split(F.trim(part), "-")
        lo, hi = F.trim(F.get(a, F.lit(0))).cast("int"), F.trim(F.get(a, F.size(a) - 1)).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    valid = F.regexp_like(c, F.lit(r"^\s*\d+(\s*-\s*\d+)?(\s*,\s*\d+(\s*-\s*\d+)?)*\s*$"))
    pages = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(F.split(c, ","), span)), lambda p: (p >= 1) & (p <= last))))
    return F.when(F.lower(F.trim(c)) == "all", F.sequence(F.lit(1), last)).when(valid, pages)


def latex_escape(c: Column) -> Column:
    """Each character replaced once."""
    table = F.create_map(*(F.lit(x) for kv in LATEX.items() for x in kv))
    return F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")


def quantity(c: Column) -> Column:
    """A decimal without trailing zeros, with a comma."""
    return F.replace(F.regexp_replace(F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit("."), F.lit(","))


def anchor_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(c, 256), F.lit(16)))
