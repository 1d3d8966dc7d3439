"""Matching terms in documents: text terms (folded, overlapping), patterns, validators and hit records.

Input documents have id and text; terms have id, type (text or regex), value, wholeWord, validator, label
and listName. A hit row is (id, location, term_id, term, list, kind, count, values, truncated).
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import display_text, fold_text, tables
from ..functions.presets import LIKELY, PRESETS
from ..functions.validators import VALIDATORS

MAX_COUNT, MAX_VALUES, MAX_SAMPLES, CONTEXT = 100_000, 10, 3, 60
MAX_TERMS = 50_000
FEW_TERMS = 100  # up to here terms become expressions; beyond, an automaton
HIT = "id long, location string, term_id string, count long, values array<string>, truncated boolean"
LETTER = r"[\p{L}\p{N}]"


def term_error(value: str | None, kind: str = "text", validator: str | None = None) -> str | None:
    """What is wrong with a term, or None: it must not be blank, must compile and must not match nothing."""
    if not isinstance(value, str) or not value.strip():
        return "empty"
    if kind == "text":
        return None
    if kind != "regex":
        return "type"
    try:
        pattern = re.compile(value, re.IGNORECASE)
    except re.error:
        return "pattern"
    if pattern.match(""):
        return "matches-empty"
    if validator and validator not in VALIDATORS:
        return "validator"
    return None


def with_errors(terms: DataFrame) -> DataFrame:
    """terms (value, type, validator) with error: what makes a term unusable, null for a right one."""

    @F.pandas_udf("string")
    def errors(values: pd.Series, types: pd.Series, validators: pd.Series) -> pd.Series:
        return pd.Series([term_error(v or "", t, c) for v, t, c in zip(values, types, validators, strict=True)], dtype=object)

    return terms.withColumn("error", errors("value", "type", "validator"))


def distinct_terms(terms: DataFrame) -> DataFrame:
    """One term for each type, folded value (patterns: exact value), wholeWord and validator: the first by seq."""
    key = F.when(F.col("type") == "text", fold_text(F.col("value"))).otherwise(F.col("value"))
    keyed = terms.withColumn("_key", key).withColumn("_validator", F.coalesce("validator", F.lit("")))
    first = keyed.groupBy("type", "_key", "wholeWord", "_validator").agg(F.min_by(F.struct(*terms.columns), "seq").alias("t"))
    return first.select("t.*").orderBy("seq")


def quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text)


def overlapping_count(folded: Column, term: str, *, whole_word: bool = False) -> Column:
    """Occurrences of a folded term in a folded text, overlaps included.

    Whole words are checked only on sides where the term itself ends in a letter or digit.
    """
    body = quoted(term)
    before = f"(?<!{LETTER})" if whole_word and term[:1].isalnum() else ""
    after = f"(?!{LETTER})" if whole_word and term[-1:].isalnum() else ""
    return F.when(folded.contains(term), F.regexp_count(folded, F.lit(f"{before}(?={body}{after})"))).otherwise(0).cast("long")


def text_hits(docs: DataFrame, terms: list[tuple[str, str, bool]], *, location: str = "content", few: int = FEW_TERMS) -> DataFrame:
    """Counts of each text term (id, value, wholeWord) in each document; rows without a hit are left out.

    Few terms are look-ahead patterns over the folded column, inside the JVM; many share one automaton.
    """
    folded = docs.select("id", fold_text(F.col("text")).alias("folded"))
    if len(terms) <= few:
        counts = F.array(*(F.struct(F.lit(t).alias("term_id"), overlapping_count(F.col("folded"), plain_fold(v), whole_word=w).alias("count")) for t, v, w in terms))
        each = folded.select("id", F.explode(F.filter(counts, lambda x: x["count"] > 0)).alias("x"))
        each = each.select("id", "x.term_id", F.col("x.count").alias("count"))
    else:
        each = _automaton_hits(folded, terms)
    return each.select("id", F.lit(location).alias("location"), "term_id", F.least("count", F.lit(MAX_COUNT)).alias("count"), (F.col("count") > MAX_COUNT).alias("truncated"))


def plain_fold(value: str) -> str:
    """The folded form of a term, on the driver."""
    table = str.maketrans(*tables())
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", value).translate(table)).strip()


def _automaton_hits(folded: DataFrame, terms: list[tuple[str, str, bool]]) -> DataFrame:
    """(id, term_id, count) by one pass of an automaton that is built once in each task."""
    shared = folded.sparkSession.sparkContext.broadcast([(t, plain_fold(v), w) for t, v, w in terms])

    def run(batches):
        import ahocorasick

        automaton, by_value = ahocorasick.Automaton(), {}
        for t, v, w in shared.value:
            by_value.setdefault(v, []).append((t, w))
        for v, owners in by_value.items():
            automaton.add_word(v, (len(v), v[0].isalnum(), v[-1].isalnum(), owners))
        automaton.make_automaton()
        for b in batches:
            ids, names, counts = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen: dict[str, int] = {}
                for end, (size, first, last, owners) in automaton.iter(text):
                    start = end - size + 1
                    bounded = not (first and start and text[start - 1].isalnum()) and not (last and end + 1 < len(text) and text[end + 1].isalnum())
                    for t, whole in owners:
                        if bounded or not whole:
                            seen[t] = seen.get(t, 0) + 1
                ids += [doc] * len(seen)
                names += seen
                counts += seen.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["id", "term_id", "count"])

    return folded.mapInArrow(run, "id long, term_id string, count long")


def pattern_values(text: Column, pattern: str, validator: str | None = None, likely: str | None = None) -> Column:
    """Non-overlapping, non-empty matches from the left that the validator accepts, case-insensitively."""
    found = F.filter(F.regexp_extract_all(text, F.lit(f"(?iu){pattern}"), F.lit(0)), lambda v: F.length(v) > 0)
    if validator:
        found = F.filter(found, VALIDATORS[validator])
    if likely:
        found = F.when(text.rlike(f"(?iu){likely}"), found).otherwise(F.array().cast("array<string>"))
    return F.coalesce(found, F.array().cast("array<string>"))


def preset_hits(docs: DataFrame, presets: list[str] | None = None, *, location: str = "content") -> DataFrame:
    """Hits of preset patterns, one row for each document and preset with a match."""
    chosen = presets or list(PRESETS)
    columns = [pattern_values(F.col("text"), *PRESETS[p], LIKELY[p]).alias(p) for p in chosen]
    wide = docs.select("id", *columns)
    pairs = F.array(*(F.struct(F.lit(p).alias("term_id"), F.col(p).alias("found")) for p in chosen))
    each = wide.select("id", F.explode(F.filter(pairs, lambda x: F.size(x["found"]) > 0)).alias("x")).select("id", "x.*")
    return each.select("id", F.lit(location).alias("location"), "term_id", *hit_columns(F.col("found")))


def hit_columns(found: Column) -> list[Column]:
    """count (capped), the first distinct values as they are displayed, and whether the cap was passed."""
    values = F.slice(F.array_distinct(F.transform(found, lambda v: F.substring(display_text(v), 1, 200))), 1, MAX_VALUES)
    n = F.size(found).cast("long")
    return [F.least(n, F.lit(MAX_COUNT)).alias("count"), values.alias("values"), (n > MAX_COUNT).alias("truncated")]


def line_number(text: Column, start: Column) -> Column:
    """Line of the character at start (from 0): 1 + line feeds before it."""
    before = F.substring(text, F.lit(1), start)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def first_samples(text: Column, pattern: str) -> Column:
    """Up to three (before, match, after, line) of a pattern, with CONTEXT characters on either side."""
    gaps = F.split(text, f"(?iu){pattern}", MAX_SAMPLES + 1)
    found = F.slice(F.regexp_extract_all(text, F.lit(f"(?iu){pattern}"), F.lit(0)), 1, MAX_SAMPLES)

    def one(match: Column, k: Column) -> Column:
        start = F.aggregate(F.slice(gaps, 1, k + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice(found, 1, k), F.lit(0), lambda a, m: a + F.length(m))
        end = start + F.length(match)
        low = F.greatest(start - CONTEXT, F.lit(0))
        before = F.concat(F.when(low > 0, "…").otherwise(""), F.ltrim(_shown(F.substring(text, low + 1, start - low))))
        after = F.concat(F.rtrim(_shown(F.substring(text, end + 1, F.lit(CONTEXT)))), F.when(end + CONTEXT < F.length(text), "…").otherwise(""))
        return F.struct(before.alias("before"), F.substring(_shown(match), 1, 300).alias("match"), after.alias("after"), line_number(text, start).alias("line"))

    return F.transform(found, one)


def _shown(text: Column) -> Column:
    return F.regexp_replace(text, r"[\u0000- \u007f- �]+", " ")


def grouped_hits(groups: dict[str, DataFrame], terms: list[tuple[str, str, bool]]) -> DataFrame:
    """Text hits of several groups (name, content, subject, body, ...): segments of one location add up."""
    parts = [text_hits(df, terms, location=name) for name, df in groups.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id", "location", "term_id").agg(F.sum("count").alias("count"), F.bool_or("truncated").alias("truncated"))



def user_pattern_hits(docs: DataFrame, term_id: str, pattern: str, *, seconds: float = 30.0, location: str = "content") -> DataFrame:
    """Hits of a pattern that a person wrote, with a limit on the time per document; what was found until then stays.

    Matches are case-insensitive, from the left, not empty. truncated also tells of a limit that was hit.
    """

    def run(batches):
        import regex

        compiled = regex.compile(pattern, regex.IGNORECASE)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, values, cut = 0, {}, False
                try:
                    for m in compiled.finditer(unicodedata.normalize("NFC", text or ""), timeout=seconds):
                        if m.group():
                            n += 1
                            if len(values) < MAX_VALUES:
                                values[m.group()[:200]] = None
                            if n >= MAX_COUNT:
                                cut = True
                                break
                except TimeoutError:
                    cut = True
                if n or cut:
                    rows.append((doc, location, term_id, n, list(values), cut))
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["id", "location", "term_id", "count", "values", "truncated"])

    return docs.select("id", "text").mapInArrow(run, HIT)
