"""Text as columns: language, cleaning, tokens, identifiers, citations. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def detect_language(text: str | Column) -> Column:
    """``mixed`` with CJK and Latin letters, ``zh`` with CJK alone, else ``en``."""
    cjk, latin = F.regexp_count(_c(text), F.lit(CJK)), F.regexp_count(_c(text), F.lit("[A-Za-z]"))
    return F.when((cjk > 0) & (latin > 0), "mixed").when(cjk >= F.greatest(2 * latin, F.lit(1)), "zh").otherwise("en")


def normalize_text(text: str | Column) -> Column:
    """Words cut at a line end joined, all whitespace one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"(?U)-\n(\w)", "$1"), r"(?U)\s+", " "))


def basic_clean(text: str | Column) -> Column:
    """Hyphenated line ends joined, blanks collapsed by line, empty lines gone."""
    joined = F.regexp_replace(_c(text), r"(?U)(\w)-\n(\w)", "$1$2")
    lines = F.split(F.regexp_replace(joined, "\r\n?", "\n"), "\n")
    clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))
    return F.array_join(F.filter(clean, lambda x: x != ""), "\n")


def markdown_whitespace(text: str | Column) -> Column:
    """LF line ends, runs of blanks and tabs one blank, at most one empty line in a row, trimmed."""
    one = F.regexp_replace(F.regexp_replace(_c(text), "\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(one, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def fix_hyphenation(text: str | Column) -> Column:
    """Latin words cut at a line end joined."""
    return F.regexp_replace(_c(text), r"([A-Za-z]{2,})-\n([A-Za-z]{2,})", "$1$2")


def normalize_bullets(text: str | Column) -> Column:
    """Bullet characters become ``- ``, ``(n)`` and ``n)`` become ``n. ``, line by line."""

    def line(x: Column) -> Column:
        s = F.trim(x)
        dots = F.concat(F.lit("- "), F.regexp_replace(s, r"^[•·‣◦]\s*", ""))
        return F.when(F.regexp_like(s, F.lit("^[•·‣◦]")), dots).when(F.regexp_like(s, F.lit(r"^\(?[0-9]+\)|^[0-9]+\.\s+")), F.regexp_replace(s, r"^\(?([0-9]+)\)\s*", "$1. ")).otherwise(x)

    return F.array_join(F.transform(F.split(_c(text), "\n"), line), "\n")


def count_tokens(text: str | Column) -> Column:
    """CJK characters, words and single symbols."""
    return F.regexp_count(_c(text), F.lit(rf"(?U){CJK}|\w+|[^\w\s]"))


def tokenize(text: str | Column) -> Column:
    """Lower-cased ASCII words and single CJK characters."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(rf"([A-Za-z0-9_]+|{CJK})"), F.lit(1)), F.lower)


def stable_id(*parts: str | Column) -> Column:
    """24 hex digits of the SHA-256 of the parts; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws("||", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def cache_key(chunk_id: str | Column, model: str | Column, version: str | Column, text: str | Column) -> Column:
    """SHA-1 over chunk, model, prompt version and the SHA-1 of the text."""
    return F.sha1(F.concat_ws("||", _c(chunk_id), _c(model), _c(version), F.sha1(F.coalesce(_c(text), F.lit("")))))


def fallback_chunk_id(prefix: str, source: str | Column, page: str | Column, text: str | Column) -> Column:
    """An id for rows without one: prefix, hash of the source, page, start of the text's hash."""
    src, no = F.coalesce(_c(source), F.lit("unknown")), F.coalesce(_c(page).cast("string"), F.lit("0"))
    return F.concat_ws(":", F.lit(prefix), F.sha1(src), no, F.substring(F.sha1(F.coalesce(_c(text), F.lit(""))), 1, 12))


#: Molar masses in g/mol.
MOLAR_MASS = {"NH3": 17.031, "HCN": 27.025, "H2S": 34.081, "SO2": 64.066, "COS": 60.075, "benzene": 78.114, "phenol": 94.113}
STP_LITRES = 22.414


def convert_units(value: str | Column, kind: str, species: str | Column | None = None) -> Column:
    """One conversion by name: c_to_k, k_to_c, bar_to_mpa, atm_to_mpa, mol_percent_to_ppmv, ppmv_to_mol_percent and
    mg_nm3_to_ppmv (by species; null for an unknown one)."""
    v = _c(value)
    if kind == "mg_nm3_to_ppmv":
        mass = F.create_map(*[F.lit(x) for pair in MOLAR_MASS.items() for x in pair])
        return v * (F.lit(STP_LITRES) / F.try_element_at(mass, _c(species)))
    plain = {"c_to_k": v + 273.15, "k_to_c": v - 273.15, "bar_to_mpa": v * 0.1, "atm_to_mpa": v * 0.101325, "mol_percent_to_ppmv": v * 10000.0, "ppmv_to_mol_percent": v / 10000.0}
    return plain[kind]


def evidence_snippet(text: str | Column, start: Column, end: Column, window: int = 60) -> Column:
    """The text around [start, end), newlines as blanks, trimmed."""
    low = F.greatest(F.lit(0), start - window)
    return F.trim(F.translate(F.substr(_c(text), low + 1, F.least(F.length(_c(text)), end + window) - low), "\n", " "))


def format_citation(title: Column, source: Column, page_label: Column, page: Column, chunk_id: Column) -> Column:
    """``title — source (label or page) #chunk`` with long titles cut."""
    t = F.trim(F.coalesce(title, F.lit("")))
    short = F.when(F.length(t) > 60, F.concat(F.rtrim(F.substring(t, 1, 57)), F.lit("..."))).otherwise(t)
    head = F.when(t == "", F.lit("")).otherwise(F.concat(short, F.lit(" — ")))
    where = F.when(F.coalesce(page_label, F.lit("")) != "", F.concat(F.lit(" ("), page_label, F.lit(")")))
    where = where.when(page.isNotNull(), F.concat(F.lit(" (page "), (page + 1).cast("string"), F.lit(")"))).otherwise("")
    return F.concat(head, F.coalesce(source, F.lit("unknown")), where, F.lit(" #"), F.coalesce(chunk_id, F.lit("")))


def heading_citation(source: Column, heading: Column, chunk_id: Column) -> Column:
    """``source [heading] #chunk``."""
    mid = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(" ["), heading, F.lit("]"))).otherwise("")
    return F.concat(F.coalesce(source, F.lit("unknown")), mid, F.lit(" #"), F.coalesce(chunk_id, F.lit("")))
