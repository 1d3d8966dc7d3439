"""Text of XML by rules for each element, in one pass over its tags and texts.

A rule set names the elements whose text counts, those that are left out with all inside, and what an opening, a closing
or an empty element stands for. Markup need not be well formed: a closing tag without its opening one is as if it weren't
there, an element that is never closed lasts to the end, and a tag without its end is text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_PIECE = re.compile(r"<([^>]*)>|([^<]+)")
_NAME = re.compile(r"\s*([^\s/>]+)")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|lt|gt|amp|quot|apos);")
PARAGRAPH = "\x01"  # the end of a paragraph, which in a cell of a table doesn't end the line


@dataclass(frozen=True)
class Rules:
    text: frozenset[str] | None = None  # None: all texts count
    skip: frozenset[str] = frozenset()
    opens: dict[str, str] = field(default_factory=dict)
    closes: dict[str, str] = field(default_factory=dict)
    repeats: dict[str, tuple[str, str, int, int]] = field(default_factory=dict)  # element: (attribute, what it stands for, once less than its number or not, most)


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Elements of the office formats, and what they stand for.
WORD = Rules(_names("w:t w:delText"), _names("mc:Fallback"), {"w:tab": "\t", "w:br": "\n", "w:cr": "\n", "w:noBreakHyphen": "-"}, {"w:p": PARAGRAPH, "w:tc": "\t", "w:tr": "\n"})
DRAWING = Rules(_names("a:t p:text"), _names("mc:Fallback"), {"a:br": "\n"}, {"a:p": PARAGRAPH, "a:tc": "\t", "a:tr": "\n"})
_OPEN_SKIP = _names("office:automatic-styles office:font-face-decls office:scripts office:forms dc:creator dc:date meta:creator-initials table:named-expressions text:note-citation")
_OPEN_REPEATS = {"text:s": ("text:c", " ", 0, 100), "table:table-row": ("table:number-rows-repeated", "\n", 1, 10_000)}
OPEN = Rules(None, _OPEN_SKIP, {"text:tab": "\t", "text:line-break": "\n", "text:note": "\n"}, {"text:p": PARAGRAPH, "text:h": PARAGRAPH, "table:table-cell": "\t", "table:table-row": "\n"}, _OPEN_REPEATS)
OPEN_SHEET = Rules(None, _OPEN_SKIP, OPEN.opens | {"text:line-break": " "}, OPEN.closes | {"text:p": " ", "text:h": " "}, _OPEN_REPEATS)


def decoded(text: str) -> str:
    return _ENTITY.sub(lambda m: html.unescape(m[0]), text) if "&" in text else text


def by_rules(xml: str, rules: Rules) -> str:
    out: list[str] = []
    depth = {"text": 0, "skip": 0}
    for tag, text in _PIECE.findall(xml):
        if text:
            if not depth["skip"] and (rules.text is None or depth["text"]):
                out.append(decoded(text))
            continue
        if tag[:1] in "?!" or not (m := _NAME.match(tag, tag[:1] == "/")):
            continue
        name, closing, empty = m[1], tag[0] == "/", tag[-1] == "/"
        kind = "skip" if name in rules.skip else "text" if rules.text and name in rules.text else None
        if kind and not empty and (closing or kind == "skip" or not depth["skip"]):
            depth[kind] = max(0, depth[kind] + (-1 if closing else 1))
        if depth["skip"] or kind == "skip":
            continue
        if not closing and name in rules.opens:
            out.append(rules.opens[name])
        if not closing and name in rules.repeats:
            attribute, stands_for, less, most = rules.repeats[name]
            n = int((re.search(rf'\b{attribute}="(\d{{1,9}})"', tag) or ("", "1"))[1]) or 1
            out.append(stands_for * ((min(n, most) if not less else n if n <= most else less) - less))
        if (closing or empty) and name in rules.closes:
            out.append(rules.closes[name])
    return "".join(out)


def tidy(text: str) -> str:
    """Paragraphs end lines, but for those at the end of a cell; a row's last tab goes."""
    return re.sub(r"\t+\n", "\n", re.sub(f"{PARAGRAPH}(?=\t)", "", text).replace(PARAGRAPH, "\n"))


def rules_text(xml: Column, rules: Rules) -> Column:
    """by_rules of a column, tidied; null stays null."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if s is None else tidy(by_rules(s, rules)) for s in texts.to_pylist()], pa.string())

    return run(xml)
