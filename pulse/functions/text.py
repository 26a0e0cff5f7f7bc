"""Text expressions: words, labels, list literals, page tags."""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A run of characters between spaces: Unicode white space and the four information
# separators end a word, as in Python's ``str.split``.
WORD = r"(?U)[^\s\x1c-\x1f]+"

# The 179 English stop words of the common NLP word list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves "
    "he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only "
    "own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren "
    "aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma "
    "mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won "
    "won't wouldn wouldn't"
).split()


def fold(column: str | Column) -> Column:
    """Case-insensitive form of a label."""
    return F.lower(column)


def words(column: str | Column) -> Column:
    """Array of words, empty for blank text and null for null."""
    return F.regexp_extract_all(column, F.lit(WORD), F.lit(0))


def word_count(column: str | Column) -> Column:
    return F.regexp_count(column, F.lit(WORD))


def non_stop_word_count(column: str | Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Words outside the stop list, compared in lower case."""
    return count_non_stop(words(column), stop)


def count_non_stop(found: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Items of a word array outside the stop list."""
    return F.size(F.filter(found, lambda w: ~F.lower(w).isin(*stop)))


def unique_word_count(column: str | Column) -> Column:
    """Distinct words, case-sensitive."""
    return F.size(F.array_distinct(words(column)))


def split_list(column: str | Column) -> Column:
    """Split on commas; items keep their surrounding spaces."""
    return F.split(column, ",")


def label_part(column: str | Column, part: int, trim: bool = True) -> Column:
    """Part 0 (theme) or 1 (index) of a ``theme > index`` label.

    With ``trim`` the label is cut at ``>`` and parts are stripped; without, it
    is cut at ``" > "`` and taken as it stands.
    """
    pieces = F.split(column, ">" if trim else " > ")
    value = F.try_element_at(pieces, F.lit(part + 1))
    return F.trim(value) if trim else value


def join_label(theme: str | Column, index: str | Column) -> Column:
    """``theme > index`` with missing parts left empty."""
    return F.concat_ws(" > ", F.coalesce(theme, F.lit("")), F.coalesce(index, F.lit("")))


def join_text(first: str | Column, second: str | Column) -> Column:
    """Two texts with a space between; null when either is null."""
    return F.concat(first, F.lit(" "), second)


# One quoted string: single or double quotes, backslash escapes inside.
_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""


def first_literal_item(column: str | Column) -> Column:
    """First string of a list literal such as ``['a > b', 'c > d']``."""
    return _unquote(F.nullif(F.regexp_extract(column, _QUOTED, 0), F.lit("")))


def literal_items(column: str | Column) -> Column:
    """All strings of a list literal, without leaving the JVM."""
    return F.transform(F.regexp_extract_all(column, F.lit(_QUOTED), F.lit(0)), _unquote)


def _unquote(quoted: Column) -> Column:
    inner = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    return F.regexp_replace(inner, r"""\\(['"\\])""", "$1")


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_list_literal(texts: pd.Series) -> pd.Series:
    """List literal with any escape the language allows; prefer ``literal_items`` for plain ones."""
    return texts.map(lambda t: None if t is None else [None if v is None else str(v) for v in ast.literal_eval(t)])


def anchor(text: str | Column, link: str | Column) -> Column:
    """HTML link that opens in a new tab."""
    return F.concat(F.lit('<a target="_blank" href="'), link, F.lit('">'), text, F.lit("</a>"))


def thousands(column: str | Column, digits: int = 0) -> Column:
    """Number with thousands separators."""
    return F.format_number(column, digits)


def tag_attribute(html: str | Column, tag: str, attribute: str, where: tuple[str, str] | None = None) -> Column:
    """Value of ``attribute`` on the first ``tag`` of a page, or the first one with a given attribute value."""
    condition = rf"""[^>]*\b{where[0]}\s*=\s*["']?{_escape(where[1])}["'\s/>]""" if where else ""
    opened = F.regexp_extract(html, rf"(?is)<{tag}\b{condition}[^>]*>?", 0)
    found = lambda quote: F.regexp_extract(
        opened, rf"(?is)\b{attribute}\s*=\s*{quote}([^{quote}]*){quote}", 1
    )
    value = F.when(F.regexp_like(opened, F.lit(rf'(?is)\b{attribute}\s*=\s*"')), found('"')).when(
        F.regexp_like(opened, F.lit(rf"(?is)\b{attribute}\s*=\s*'")), found("'")
    )
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(character))
    return value


def extract_meta(html: str | Column, prop: str) -> Column:
    """``content`` of ``<meta property=…>``, null when the page has none."""
    return tag_attribute(html, "meta", "content", where=("property", prop))


def _escape(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_:-" else "\\" + c for c in text)
