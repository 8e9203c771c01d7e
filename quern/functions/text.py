"""Text functions: cleaning, tokenising, hashing. Column expressions unless the semantics need Python.

Python versions of the page functions' helpers stand beside the expressions; tests hold them against each other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode White_Space, which trims and blank tests use.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_SPACE_CLASS = r"[\t\n\x0B\x0C\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_INLINE_CLASS = _SPACE_CLASS.replace(r"\n", "")
#: What separates terms of a literal query, and of the plain tokenizer.
LEX_SEPARATORS = r'[ \t\n，。？！；、"“”]+'
PLAIN_SEPARATORS = r"[ \t\n，。？！；、]+"
#: Characters of which a token must consist to be indexed.
INDEXED = r"^[\x{4E00}-\x{9FFF}A-Za-z0-9'·θπαβγ]+$"
_CJK = r"[\x{4E00}-\x{9FFF}]"
#: Marks at the ends of a word.
_MARKS = r"[.,;:!?()\[\]{}\"“”，。？！；、：（）]"
_LATIN_TOKEN = rf"(?<![^\s]){_MARKS}*+([A-Za-z0-9'·θπαβγ]{{2,}}+){_MARKS}*+(?![^\s])"
#: What marks a reply as a refusal.
REFUSAL_MARKERS = ["没有找到", "未找到", "无法回答", "找不到", "抱歉", "没有相关", "未收录", "没有检索到", "不存在于", "not found"]


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^{_SPACE_CLASS}+|{_SPACE_CLASS}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(trimmed(text)) == 0, F.lit(True))


def normalize_text(text: Column) -> Column:
    """Line ends to LF, no-break space to space, no NUL; each line trimmed; runs of blank lines to one; trimmed."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\x00", "")
    out = F.regexp_replace(out, rf"(?md)^{_INLINE_CLASS}+|{_INLINE_CLASS}+$", "")
    return trimmed(F.regexp_replace(F.regexp_replace(out, "\xa0", " "), "\n{3,}", "\n\n"))


def clean_text(text: Column) -> Column:
    """One line without replacement characters, line ends and NUL, trimmed."""
    return trimmed(F.regexp_replace(text, "[�\n\r\x00]", ""))


def normalize_text_py(text: str) -> str:
    out: list[str] = []
    for line in re.sub("\r\n?", "\n", text).replace("\xa0", " ").replace("\x00", "").encode("utf-8", "ignore").decode().split("\n"):
        line = line.strip(SPACES)
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip(SPACES)


def clean_text_py(text: str) -> str:
    return re.sub("[�\n\r\x00]", "", text.encode("utf-8", "ignore").decode()).strip(SPACES)


def lex_terms(query: Column) -> Column:
    """Terms of a literal query: split at blanks and CJK punctuation, two characters or more."""
    return F.filter(F.transform(F.split(query, LEX_SEPARATORS), trimmed), lambda t: F.length(t) >= 2)


def plain_tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, PLAIN_SEPARATORS), trimmed), lambda t: F.length(t) >= 2)


#: Cuts a text (a Column) into words (an array of strings), as ``quern.functions.segment`` does.
Segment = Callable[[Column], Column]


def tokens(text: Column, segment: Segment | None = None) -> Column:
    """Index tokens in order: runs of letters and digits, and of each run of CJK characters the words that ``segment``
    finds, or overlapping pairs without one, which keep every two-character word findable.

    Tokens of one character, and those with a character that is never indexed, are left out. Texts without CJK
    characters, the most, need one pass of one pattern.
    """
    whole = F.coalesce(text, F.lit(""))
    latin = F.regexp_extract_all(whole, F.lit(_LATIN_TOKEN), F.lit(1))
    runs = F.regexp_extract_all(whole, F.lit(rf"{_CJK}+|[^\s{_CJK[1:]}+"), F.lit(0))
    if segment is not None:
        return F.when(F.rlike(whole, F.lit(_CJK)), F.filter(segment(whole), lambda t: (F.length(t) >= 2) & F.rlike(t, F.lit(INDEXED)))).otherwise(latin)
    pairs = F.transform(
        runs,
        lambda r: F.when(F.rlike(r, F.lit(f"^{_CJK}{{3,}}")), F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))).otherwise(
            F.array(F.regexp_replace(r, rf"^{_MARKS}+|{_MARKS}+$", ""))
        ),
    )
    mixed = F.filter(F.flatten(pairs), lambda t: (F.length(t) >= 2) & F.rlike(t, F.lit(INDEXED)))
    return F.when(F.rlike(whole, F.lit(_CJK)), mixed).otherwise(latin)


def search_string(text: Column, segment: Segment | None = None) -> Column:
    return F.array_join(tokens(text, segment), " ")


def snippet(text: Column, n: int = 200) -> Column:
    """The first ``n`` characters, and ``...`` if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def title_from_filename(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def infer_title(first_page: Column, info_title: Column | None = None) -> Column:
    """The document's own title if it isn't blank, else the first page's first line of 6 to 200 bytes, else empty."""
    lines = F.filter(F.split(normalize_text(first_page), "\n"), lambda x: (F.octet_length(x) > 5) & (F.octet_length(x) <= 200))
    found = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return found if info_title is None else F.when(is_blank(info_title), found).otherwise(trimmed(info_title))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def stable_id(*parts: Column) -> Column:
    """32 hexadecimal digits from the parts: the same in every attempt of a task."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256), 1, 32)


def is_pdf(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^./\\]*)$", 1)) == ".pdf"


def is_refusal(answer: Column) -> Column:
    return F.exists(F.array(*map(F.lit, REFUSAL_MARKERS)), lambda m: F.contains(answer, m))


def numbers(text: Column) -> Column:
    """All numbers of a text, as strings, commas between digits dropped first."""
    return F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))


def fold_quote_py(text: str, drop_replacement: bool = True) -> str:
    """A form in which quotes compare: NFKC, no white space, no hyphen between Latin letters, one dash, one tilde."""
    out = re.sub(r"\s+", "", unicodedata.normalize("NFKC", text))
    out = re.sub(r"(?<=[A-Za-z])-(?=[A-Za-z])", "", out)
    out = out.translate({0x2010: "-", 0x2011: "-", 0x2013: "-", 0x2014: "-", 0xFF5E: "~", 0x301C: "~"})
    return out.replace("�", "") if drop_replacement else out


@F.pandas_udf(T.StringType())
def fold_quote(text: pd.Series) -> pd.Series:
    """``fold_quote_py`` of a column; Spark has no NFKC of its own."""
    return text.map(fold_quote_py, na_action="ignore")


#: Delimiters around a formula, and arrow commands that may dangle at its end, the longer first.
_FENCES = [("$$", "$$"), ("$", "$"), ("\\[", "\\]"), ("\\(", "\\)")]
_TAILS = ["\\longrightarrow", "\\longleftarrow", "\\leftrightarrow", "\\rightarrow", "\\leftarrow"]


def clean_latex_py(reply: str) -> str:
    """A model's LaTeX without code fence, delimiters and a dangling arrow. Bare delimiters become nothing."""
    out = reply.strip(SPACES)
    if out.startswith("```"):
        body = out.split("\n")[1:]
        out = "\n".join(body[:-1] if body and body[-1].strip(SPACES).startswith("```") else body).strip(SPACES)
    peeled = True
    while peeled:
        peeled = False
        if out and not out.strip("$"):
            return ""
        for left, right in _FENCES:
            if len(out) >= len(left) + len(right) and out.startswith(left) and out.endswith(right):
                out, peeled = out[len(left) : len(out) - len(right)].strip(SPACES), True
                break
    for tail in _TAILS:
        if out.endswith(tail):
            return out.removesuffix(tail).strip(SPACES)
    return out


@F.pandas_udf(T.StringType())
def clean_latex(reply: pd.Series) -> pd.Series:
    return reply.map(clean_latex_py, na_action="ignore")
