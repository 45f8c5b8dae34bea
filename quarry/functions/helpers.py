"""Arrow helpers for what built-in functions cannot express: Unicode normalisation, HTML and ordered folds over lines and
sentences. Each is a small function of one text behind a pandas UDF."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CJK_END = re.compile(r"[一-鿿]$")
_TOKEN = re.compile(r"[一-鿿]|\w+|[^\w\s]")

# ---------------------------------------------------------------------------------------------------------------- text

#: Zero-width and direction characters, and blanks that are not ASCII.
INVISIBLE = [*range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, 0xFEFF]
BLANKS = [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
_DROP = dict.fromkeys(INVISIBLE) | dict.fromkeys(BLANKS, " ")


def nfkc(text: str) -> str:
    """NFKC without invisible characters; runs of blanks one blank, at most one empty line in a row."""
    text = unicodedata.normalize("NFKC", text).translate(_DROP)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text))


def merge_lines(text: str) -> str:
    """Lines joined to the one before unless that ends a sentence or this one starts something of its own."""
    out = [""]
    for line in (x.strip() for x in text.split("\n")):
        last = out[-1]
        ends = last.endswith(tuple(".!?:;。！？：；"))
        starts = re.match(r"(#|-|\*|\+|\d+[.)])\s+", line) or (line[:1].isupper() and last.endswith(")"))
        if line and last and not ends and not starts:
            out[-1] = last + ("" if _CJK_END.search(last) else " ") + line
        else:
            out.append(line)
    return "\n".join(out[1:])


#: Abbreviations whose stop ends no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "dr.", "mr.", "mrs.", "vs.", "fig.")


def sentences(text: str, min_len: int = 8) -> list[str]:
    """Pieces after a stop, an abbreviation with what follows, short pieces with the next one."""
    parts = [p.strip() for p in re.split(r"(?<=[.!?。！？；;:：])\s*", text.strip()) if p.strip()]
    whole: list[str] = []
    waiting = False
    for part in parts:
        if waiting:
            whole[-1] += " " + part
            waiting = False
        else:
            whole.append(part)
            waiting = part.lower().endswith(ABBREVIATIONS)
    out: list[str] = []
    for part in whole:
        if out and len(out[-1]) < min_len:
            out[-1] += ("" if _CJK_END.search(out[-1]) else " ") + part
        else:
            out.append(part)
    return out


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.title, self._in_title = [], None, False

    def handle_starttag(self, tag, attrs):
        self._in_title = tag == "title" and self.title is None

    def handle_endtag(self, tag):
        self._in_title = False

    def handle_data(self, data):
        if self._in_title and self.title is None:
            self.title = data.strip()
        self.text.append(data)


def html_text(html: str) -> tuple[str, str | None]:
    """(all text nodes, blanks collapsed; title)."""
    page = _Visible()
    page.feed(html)
    page.close()
    text = re.sub(r"-\n(\w)", r"\1", " ".join(page.text))
    return re.sub(r"\s+", " ", text).strip(), page.title or None


def is_json(text: str) -> bool:
    """Whether the whole text is one JSON value."""
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def tokens(text: str) -> int:
    """CJK characters, words and symbols."""
    return len(_TOKEN.findall(text))


def hashed_bag(text: str, dim: int = 128) -> np.ndarray:
    """Unit vector of token counts in ``dim`` buckets of the CRC-32."""
    v = np.zeros(dim)
    for t in re.findall(r"[一-鿿]|\w+", text.lower()):
        v[zlib.crc32(t.encode()) % dim] += 1
    return v / (np.linalg.norm(v) or 1.0)


def cut_paragraphs(text: str) -> list[dict]:
    """Blank-separated paragraphs with their lines (from 1; the blank line after one is its last) and the last ``#`` line so far."""
    lines = re.split("\r\n|[\n\r]", re.sub(r"(\r\n|\r|\n)$", "", text))
    out: list[dict] = []
    held: list[str] = []
    title, end = None, 0
    for no, raw in enumerate(lines, 1):
        line = raw.strip(" ")
        if line.startswith("#"):
            title = line
        if line:
            held.append(line)
        if held and (not line or no == len(lines)):
            out.append({"first": end + 1, "last": no, "title": title, "text": " ".join(held)})
            held, end = [], no
    return out


# ------------------------------------------------------------------------------------------------------------- columns


def _string(fn):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fn, na_action="ignore")

    return run


sanitize_unicode = _string(nfkc)
merge_wrapped_lines = _string(merge_lines)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("title", T.StringType())]))
def html_to_text(pages: pd.Series) -> pd.DataFrame:
    """text and title of an HTML page; null stays null."""
    return pd.DataFrame([(None, None) if h is None else html_text(h) for h in pages], columns=["text", "title"])


@F.pandas_udf(T.BooleanType())
def json_parses(texts: pd.Series) -> pd.Series:
    """Strict JSON; null is none."""
    return texts.map(lambda t: t is not None and is_json(t), na_action=None).astype(bool)


_PARAGRAPH = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])


@F.pandas_udf(T.ArrayType(_PARAGRAPH))
def paragraphs(texts: pd.Series) -> pd.Series:
    """Array of (first, last, title, text); null stays null."""
    return texts.map(cut_paragraphs, na_action="ignore")


def split_sentences(text, min_len: int = 8):
    """Array of sentences."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sentences(t, min_len), na_action="ignore")

    return run(text)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def lexical_embedding(texts: pd.Series) -> pd.Series:
    """128 hashed buckets of tokens at unit length; a blank text is the zero vector."""
    return texts.map(lambda t: hashed_bag(t or "").astype("float32").tolist(), na_action=None)
