"""Readable text of HTML as a chain of built-in functions; only numeric entities beyond ASCII leave the JVM."""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLOCKS = "p|div|li|tr|h[1-6]|table|ul|ol|section|article|header|footer|blockquote|pre|title"
#: Entities that texts use most; all others are decoded in Python.
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&bull;": "•", "&euro;": "€", "&trade;": "™"}
_ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


def unescaped(text: str) -> str:
    return _ENTITY.sub(lambda m: _html.unescape(m.group()), text)


@F.arrow_udf(StringType())
def _decode(texts: pa.Array) -> pa.Array:
    return pa.array([s if s is None else unescaped(s) for s in texts.to_pylist()], pa.string())


def decode_entities(text: Column) -> Column:
    """Each entity once, left to right; rows without other than the frequent ones stay in the JVM."""
    hard = has_rare_entities(text)
    return F.when(hard, _decode(F.when(hard, text))).otherwise(frequent_entities(text))


def has_rare_entities(text: Column) -> Column:
    return text.rlike(r"&(?!lt;|gt;|quot;|apos;|nbsp;|ndash;|mdash;|hellip;|lsquo;|rsquo;|ldquo;|rdquo;|bull;|euro;|trade;|amp;)(#|[A-Za-z]{2,31};)")


def frequent_entities(text: Column) -> Column:
    for entity, char in NAMED.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def html_to_text(html: Column, *, entities: bool = True) -> Column:
    """Comments, styles and scripts as a space; line breaks and block ends as line feeds; cells as tabs; tags gone."""
    s = F.coalesce(html, F.lit(""))
    s = F.regexp_replace(s, r"(?s)<!--.*?(?:-->|$)", " ")
    s = F.regexp_replace(s, r"(?is)<(style|script)\b[^>]*>.*?(?:</\1\s*>|$)", " ")
    s = F.regexp_replace(s, rf"(?i)<br\s*/?>|</(?:{BLOCKS})\s*>", "\n")
    s = F.regexp_replace(s, r"(?i)</t[dh]\s*>", "\t")
    s = F.regexp_replace(s, r"</?[A-Za-z!?][^>]*>", "")
    return decode_entities(s) if entities else s


def xml_to_text(xml: Column, *, breaks: str = "w:p|w:br|a:p|text:p|text:h|row", tabs: str = "w:tab|text:tab") -> Column:
    """Text of office XML: paragraphs end lines, tabs are tabs, tags go."""
    s = F.regexp_replace(F.coalesce(xml, F.lit("")), rf"</(?:{breaks})>|<(?:{breaks})\s*/>", "\n")
    s = F.regexp_replace(s, rf"<(?:{tabs})\b[^>]*/>", "\t")
    return decode_entities(F.regexp_replace(s, r"<[^>]*>", ""))


def first_tag(xml: Column, tag: str) -> Column:
    """Text of a tag's first element, empty without one."""
    return F.regexp_extract(F.coalesce(xml, F.lit("")), rf"(?s)<(?:[A-Za-z0-9]+:)?{tag}\b[^>]*>([^<]*)<", 1)


def attribute(xml: Column, name: str) -> Column:
    return F.regexp_extract(F.coalesce(xml, F.lit("")), rf"\b{name}=\"([^\"]*)\"", 1)


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), r"\s+", " "))


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
