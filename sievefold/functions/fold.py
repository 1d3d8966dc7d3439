"""Accent- and case-insensitive comparison form of text, kept one character to one where possible."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the matching rules see it (more than Java's \s, less than its Unicode class).
SPACE = r"[\t-\r    -     　﻿]"
#: Combining marks that canonical composition may join to the letter before.
MARKS = r"[̀-ͯ]"


@cache
def tables() -> tuple[str, str]:
    """Characters that fold to another one, and what they fold to.

    Every letter of the basic plane becomes its lower-case base letter; marks are removed for Latin,
    Greek and Cyrillic only, as decomposing other scripts would change their meaning.
    """
    source, target = [], []
    for code in range(0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)[0] if code < 0x590 or 0x1E00 <= code <= 0x1FFF else ch
        low = base.lower()
        low = low if len(low) == 1 else base
        if low != ch:
            source.append(ch)
            target.append(low)
    return "".join(source), "".join(target)


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def composed(text: Column) -> Column:
    """Canonical composition. Only rows with combining marks leave the JVM."""
    return F.when(text.rlike(MARKS), _compose(F.when(text.rlike(MARKS), text))).otherwise(text)


def fold_letters(text: Column) -> Column:
    """Folds character by character: places in the result are places in the composed text."""
    return F.translate(text, *tables())


def fold_text(text: Column, *, compose: bool = False) -> Column:
    """Folded, with every run of white space as one space, and trimmed; null folds to the empty string.

    compose is for inputs that may hold decomposed letters; it adds a Python step to the plan.
    """
    text = F.coalesce(text, F.lit(""))
    folded = fold_letters(composed(text) if compose else text)
    return F.trim(F.regexp_replace(folded, SPACE + "+", " "))


def display_text(text: Column) -> Column:
    """Control characters and the replacement character as spaces, runs collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\u0000- \u007f- �]+", " "))
