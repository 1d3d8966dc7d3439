"""Queries on text: folding, terms, patterns, validators, hit records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import display_text, fold_text
from ..functions.validators import VALIDATORS
from ..operators import matching as m
from ..operators import reports
from .catalog import query
from .views import table, view

FOLD = r"trim(regexp_replace(lower(strip_accents({})), '\s+', ' ', 'g'))"
#: The presets in the dialect of the SQL.
SQL_PRESETS = {
    "cpf": r"\b[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}\b",
    "pis": r"\b[0-9]{3}\.?[0-9]{5}\.?[0-9]{2}-?[0-9]\b",
    "email": r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b",
    "telefone": r"(?:\+55\s?)?(?:\([0-9]{2}\)\s?|\b[0-9]{2}(?:\s|-))9?[0-9]{4}(?:\s|-)[0-9]{4}\b",
    "cartao": r"\b(?:[0-9][ .-]?){12,18}[0-9]\b",
    "senha": r"(?i)\b(?:senha|password|passwd|pwd)\s*[:=]\s*\S+",
}
DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"


def weighted(d: str, weights: str, n: int) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: cast(substr({d}, i, 1) AS int) * ({weights})))"


SQL_VALID = {
    "cpf": "length({d}) = 11 AND length(replace({d}, substr({d}, 1, 1), '')) > 0 AND " + weighted("{d}", "11 - i", 9) + " * 10 % 11 % 10 = cast(substr({d}, 10, 1) AS int) AND " + weighted("{d}", "12 - i", 10) + " * 10 % 11 % 10 = cast(substr({d}, 11, 1) AS int)",
    "pis": "length({d}) = 11 AND length(replace({d}, substr({d}, 1, 1), '')) > 0 AND (11 - " + weighted("{d}", "[3, 2, 9, 8, 7, 6, 5, 4, 3, 2][i]", 10) + " % 11) % 11 % 10 = cast(substr({d}, 11, 1) AS int)",
    "cartao": "length({d}) BETWEEN 13 AND 19 AND substr({d}, 1, 1) BETWEEN '3' AND '6' AND length(replace({d}, substr({d}, 1, 1), '')) > 0 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][cast(substr(reverse({d}), i, 1) AS int) + 1] ELSE cast(substr(reverse({d}), i, 1) AS int) END)) % 10 = 0",
}


def found(preset: str, text: str = "text") -> str:
    every = f"regexp_extract_all({text}, '{SQL_PRESETS[preset]}')"
    return f"list_filter({every}, lambda v: {SQL_VALID[preset].format(d=DIGITS.format('v'))})" if preset in SQL_VALID else every


HITS = " UNION ALL ".join(f"SELECT id, '{p}' AS term_id, {found(p)} AS found FROM files" for p in SQL_PRESETS)
TERMS = (("t1", "Licença", True), ("t2", "the", False), ("t3", "the", True), ("t4", "ção", False), ("t5", "data", True))


@query(f"WITH hits AS ({HITS}) SELECT term_id, count(*) AS files, cast(sum(len(found)) AS bigint) AS occurrences, cast(0 AS bigint) AS in_name, count(*) AS in_content FROM hits WHERE len(found) > 0 GROUP BY term_id")
def a1_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = m.preset_hits(view(spark, sf_dir, "files"), list(SQL_PRESETS))
    return reports.by_term(hits)


@query(f"SELECT id, md5({FOLD.format('text')}) AS folded FROM files")
def m1_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").select("id", F.md5(fold_text(F.col("text")).cast("binary")).alias("folded"))


def _substring_counts(terms) -> str:
    one = "SELECT id, '{t}' AS term_id, cast((length(f) - length(replace(f, '{v}', ''))) / {n} AS bigint) AS count FROM folded"
    return " UNION ALL ".join(one.format(t=t, v=m.plain_fold(v), n=len(m.plain_fold(v))) for t, v, _ in terms)


PLAIN = (("p1", "the"), ("p2", "license"), ("p3", "você"), ("p4", "número"), ("p5", "señor"))


@query(f"WITH folded AS (SELECT id, {FOLD.format('text')} AS f FROM files), c AS ({_substring_counts([(t, v, False) for t, v in PLAIN])}) SELECT * FROM c WHERE count > 0")
def m2_text_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.text_hits(view(spark, sf_dir, "files"), [(t, v, False) for t, v in PLAIN]).select("id", "term_id", "count")


@query(
    f"""WITH folded AS (SELECT id, {FOLD.format("text")} AS f FROM files)
    SELECT id, cast(len(list_filter(range(1, length(f) + 1), lambda i: substr(f, i, 3) = 'ana')) AS bigint) AS count FROM folded WHERE contains(f, 'ana')"""
)
def m2_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.text_hits(view(spark, sf_dir, "files"), [("t", "ana", False)]).select("id", "count")


@query(
    f"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex({FOLD.format("text")}, '[^a-z]+')) AS word FROM benchmark) WHERE length(word) >= 6 AND NOT contains(substr(word, 2), substr(word, 1, 1))),
    folded AS (SELECT id, {FOLD.format("text")} AS f FROM files),
    c AS (SELECT word, cast((length(f) - length(replace(f, word, ''))) / length(word) AS bigint) AS n FROM folded, w WHERE contains(f, word))
    SELECT word, count(*) AS files, cast(sum(n) AS bigint) AS occurrences FROM c GROUP BY word"""
)
def m2_many_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(fold_text(F.col("text")), "[^a-z]+")).alias("word")).distinct()
    listed = words.where((F.length("word") >= 6) & ~F.expr("contains(substr(word, 2), substr(word, 1, 1))")).limit(m.MAX_TERMS + 1).collect()
    if len(listed) > m.MAX_TERMS:
        raise ValueError(f"more than {m.MAX_TERMS} terms in the list")
    hits = m.text_hits(view(spark, sf_dir, "files"), [(r["word"], r["word"], False) for r in listed], few=0)
    return hits.groupBy(F.col("term_id").alias("word")).agg(F.count("*").alias("files"), F.sum("count").alias("occurrences"))


@query(
    f"""WITH w AS (SELECT id, string_split_regex({FOLD.format("text")}, '[^\\p{{L}}\\p{{N}}]+') AS w FROM files),
    c AS (SELECT id, 'a' AS term_id, len(list_filter(w, lambda x: x = 'the')) AS count FROM w UNION ALL SELECT id, 'b', len(list_filter(w, lambda x: x = 'data')) FROM w UNION ALL SELECT id, 'c', len(list_filter(w, lambda x: x = 'que')) FROM w)
    SELECT id, term_id, cast(count AS bigint) AS count FROM c WHERE count > 0"""
)
def m3_whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.text_hits(view(spark, sf_dir, "files"), [("a", "The", True), ("b", "DATA", True), ("c", "quê", True)]).select("id", "term_id", "count")


@query(f"WITH hits AS ({HITS.replace('text', 'text').replace('FROM files', 'FROM files')}) SELECT id, term_id, cast(len(found) AS bigint) AS count, array_to_string(list_sort(list_distinct(found)), '|') AS values FROM hits WHERE len(found) > 0")
def m4_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = m.preset_hits(view(spark, sf_dir, "files"), list(SQL_PRESETS))
    return hits.select("id", "term_id", "count", F.array_join(F.array_sort("values"), "|").alias("values"))


def _candidates(width: int, factor: int) -> str:
    return f"SELECT o_orderkey AS id, lpad(cast(o_orderkey * {factor} % {10**width} AS string), {width}, '0') AS v FROM {{orders}}"


def _valid_query(name: str, preset: str, width: int, factor: int) -> None:
    source = _candidates(width, factor)
    # a long holds the products of keys up to 10^11, or else they are decimals
    wide = source if factor * 10**11 < 2**63 else source.replace("o_orderkey * ", "cast(o_orderkey AS decimal(19, 0)) * ")
    sql = f"WITH c AS ({source.format(orders='orders')}) SELECT id, v FROM c WHERE {SQL_VALID[preset].format(d='v')}"

    @query(sql, name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = spark.sql(wide, orders=table(spark, sf_dir, "orders"))
        return c.where(VALIDATORS[preset](F.col("v")))


_valid_query("v1_cpf", "cpf", 11, 9_876_541)
_valid_query("v3_card", "cartao", 16, 443_556_789_012_3)
_valid_query("v4_pis", "pis", 11, 7_654_321)

_W = {1: "[5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2][i]", 2: "[6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2][i]"}
_CNPJ = " AND ".join(f"(CASE WHEN s{k} % 11 < 2 THEN 0 ELSE 11 - s{k} % 11 END) = ascii(substr(v, {12 + k}, 1)) - 48" for k in (1, 2))


@query(
    f"""WITH c AS (SELECT o_orderkey AS id, concat(lpad(cast(o_orderkey * 98765431 % 1000000000000 AS string), 12, CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE '0' END), lpad(cast(o_orderkey % 100 AS string), 2, '0')) AS v FROM orders),
    s AS (SELECT *, list_sum(list_transform(range(1, 13), lambda i: (ascii(substr(v, i, 1)) - 48) * {_W[1]})) AS s1, list_sum(list_transform(range(1, 14), lambda i: (ascii(substr(v, i, 1)) - 48) * {_W[2]})) AS s2 FROM c)
    SELECT id, v FROM s WHERE {_CNPJ}"""
)
def v2_cnpj(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.lpad((F.col("o_orderkey") * 98765431 % 1000000000000).cast("string"), 12, F.when(F.col("o_orderkey") % 2 == 0, "B").otherwise("0"))
    v = F.concat(body, F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), v.alias("v")).where(VALIDATORS["cnpj"](F.col("v")))


@query("WITH p AS (SELECT id, substr(text, 1, instr(text, '.') - 1) AS p FROM files WHERE instr(text, '.') > 0) SELECT id, cast(length(p) - length(replace(p, chr(10), '')) + 1 AS bigint) AS line FROM p")
def m7_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").where(F.instr("text", ".") > 0).select("id", m.line_number(F.col("text"), F.instr("text", ".") - 1).alias("line"))


@query(
    f"""WITH g AS (SELECT id, 'name' AS location, {FOLD.format("name")} AS f FROM files UNION ALL SELECT id, 'content', {FOLD.format("text")} FROM files UNION ALL SELECT id, 'folder', {FOLD.format("folder")} FROM files),
    t AS (SELECT id, location, 'a' AS term_id, (length(f) - length(replace(f, 'doc', ''))) / 3 AS n FROM g UNION ALL SELECT id, location, 'b', (length(f) - length(replace(f, 'sub', ''))) / 3 FROM g)
    SELECT id, location, term_id, cast(n AS bigint) AS count FROM t WHERE n > 0"""
)
def m8_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files")
    groups = {"name": files.select("id", F.col("name").alias("text")), "content": files.select("id", "text"), "folder": files.select("id", F.col("folder").alias("text"))}
    return m.grouped_hits(groups, [("a", "DOC", False), ("b", "súb", False)]).select("id", "location", "term_id", "count")


@query("SELECT item_id AS id, CASE item_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 2 THEN 'matches-empty' WHEN 3 THEN 'ok' WHEN 4 THEN 'pattern' ELSE 'validator' END AS error FROM benchmark")
def m9_term_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term of each item's first word: as text, blank, as patterns that match nothing, digits, are broken, or name no validator."""
    word = F.concat(F.substring_index(F.regexp_replace("text", "[^A-Za-z ]", ""), " ", 1), F.lit("w"))
    kind = F.col("item_id") % 6
    value = F.when(kind == 0, word).when(kind == 1, "  ").when(kind == 2, F.concat(F.lit("("), word, F.lit(")*"))).when(kind == 3, F.concat(word, F.lit("[0-9]{3}"))).when(kind == 4, F.concat(F.lit("("), word)).otherwise(F.concat(word, F.lit("+")))
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), value.alias("value"), F.when(kind < 2, "text").otherwise("regex").alias("type"), F.when(kind == 3, "cpf").when(kind == 5, "nope").alias("validator"))
    return m.with_errors(terms).select("id", F.coalesce("error", F.lit("ok")).alias("error"))


@query(
    f"""WITH t AS (SELECT item_id AS seq, 'text' AS type, split_part(text, ' ', 1) AS value, item_id % 2 = 0 AS whole FROM benchmark)
    SELECT {FOLD.format("value")} AS value, whole, min(seq) AS seq FROM t GROUP BY 1, 2"""
)
def m10_distinct_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), F.lit("text").alias("type"), F.substring_index("text", " ", 1).alias("value"), (F.col("item_id") % 2 == 0).alias("wholeWord"), F.lit(None).cast("string").alias("validator"))
    return m.distinct_terms(terms).select(fold_text(F.col("value")).alias("value"), F.col("wholeWord").alias("whole"), "seq")


@query(r"SELECT id, md5(trim(regexp_replace(text, '[\x00-\x20\x7f-\x{a0}\x{fffd}]+', ' ', 'g'))) AS shown FROM files")
def m12_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").select("id", F.md5(display_text(F.col("text")).cast("binary")).alias("shown"))


_EMAIL = r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"
_SHOWN = r"regexp_replace({}, '[\x00-\x20\x7f-\x{{a0}}\x{{fffd}}]+', ' ', 'g')"


@query(
    f"""WITH f AS (SELECT id, text, regexp_extract_all(text, '{_EMAIL}')[1:3] AS m, string_split_regex(text, '{_EMAIL}') AS g FROM files WHERE contains(text, '@')),
    k AS (SELECT id, text, m, g, unnest(range(len(m))) AS nth FROM f),
    p AS (SELECT id, nth, text, m[nth + 1] AS own, list_sum(list_transform(g[1:nth + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:nth], lambda x: length(x))), 0) AS pos FROM k),
    e AS (SELECT *, greatest(pos - {{context}}, 0) AS low, pos + length(own) AS stop FROM p)
    SELECT id, nth::INT AS nth, concat(CASE WHEN low > 0 THEN '…' ELSE '' END, ltrim({_SHOWN.format("substr(text, (low + 1)::BIGINT, (pos - low)::BIGINT)")})) AS before, substr({_SHOWN.format("own")}, 1, 300) AS match,
      concat(rtrim({_SHOWN.format("substr(text, (stop + 1)::BIGINT, {context})")}), CASE WHEN stop + {{context}} < length(text) THEN '…' ELSE '' END) AS after,
      (length(substr(text, 1, pos::BIGINT)) - length(replace(substr(text, 1, pos::BIGINT), chr(10), '')) + 1)::BIGINT AS line FROM e""".replace("{context}", str(m.CONTEXT))
)
def m6_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of the first e-mail addresses; checked against plain Python in the tests."""
    from ..functions.presets import PRESETS

    files = view(spark, sf_dir, "files").where(F.col("text").contains("@"))
    each = files.select("id", F.posexplode(m.first_samples(F.col("text"), PRESETS["email"][0])).alias("nth", "x"))
    return each.select("id", "nth", "x.*")
