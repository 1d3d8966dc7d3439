"""Operator 9: secrets, told from copied examples by how many repositories and owners hold them; DataFrame functions only.

Base kinds are exact patterns. A further generator proposes long mixed-case strings with digits that touch no base
span. The 128-bit hashes of all candidates' values are counted over the whole corpus: rows of one value,
repository and owner are first made distinct (Spark pre-aggregates in each task), then distinct repositories and
owners are counted per value. A value that OWNERS owners of REPOSITORIES repositories or more hold is a copied example;
another looks live. Base spans stay either way; further spans are added only if they look live.

Whom a document belongs to is up to the caller: repository and owner name columns of docs. Without such columns the
query takes `source` as repository and (`source`, `lang`) as owner, so that its verdicts say how widely a value is
spread over sources and languages, not over people.

Null texts count as empty; a null repository or owner is one of its own. Repeated rows are counted once for their
owner, and each gives a row; rows of one doc_id give a row each. Very long texts cost time in proportion to their length. Values that are held equally
often get the same verdict. An empty table gives an empty result; other columns, whatever their names, are not read.
Documents without candidates take no part in the shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .spans import as_taken, best_apart, found, item, joined

#: Equal to the contract's patterns, and checks, in what they match from the left.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)$"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex")
#: A run of 24 characters or more with a digit and letters of both cases; it may follow the = of an assignment.
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_=-])"
OWNERS = 3  # owners from which on a value is a copied example,
REPOSITORIES = 2  # if so many repositories hold it, too: what one repository alone repeats is its own
ENTROPY_KINDS = 14  # different characters that a further candidate has at least


def base_spans(text: Column) -> dict[str, Column]:
    assign = found(text, ASSIGN, text.rlike(r"(?i:passw|secret|token|api_?key)"))
    value = lambda m: F.regexp_extract(m, VALUE, 1)
    assign = F.filter(assign, lambda x: F.length(value(x["m"])) >= 8)
    return {"assign": assign, "access": found(text, ACCESS, text.contains("AKIA")), "hex": found(text, HEX, text.rlike(HEX))}


def secret_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", repository: str = "source", owner: str = "lang", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256, spans, n_live, n_copied of every row of docs.

    An owner is a repository's owner: the pair of both columns counts. n_live and n_copied tell the
    candidates of all kinds apart.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), name(text).alias("body"), name(repository).alias("repo"), name(owner).alias("owner"))
    t = F.col("body")
    kinds = base_spans(t) | {"mixed": found(t, MIXED, t.rlike(r"[A-Za-z0-9+/_-]{24}"))}
    own = own.select("doc_id", "repo", "owner", *(c.alias(k) for k, c in kinds.items()))
    varied = F.filter("mixed", lambda x: F.size(F.array_distinct(F.split(x["m"], ""))) >= ENTROPY_KINDS)
    own = own.withColumn("mixed", varied)
    taken = F.concat(*map(as_taken, KINDS))
    apart = best_apart(taken, F.transform("mixed", lambda x: item(x, "mixed", taken=False)))
    own = own.withColumn("mixed", F.when(F.size("mixed") > 0, F.transform(apart, lambda x: F.struct(x["s"], x["e"], x["m"]))).otherwise(F.col("mixed")))

    def entries(order: int, kind: str) -> Column:
        value = (lambda m: F.regexp_extract(m, VALUE, 1)) if kind == "assign" else (lambda m: m)
        both = lambda v: F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit(1), v).alias("b"))
        return F.transform(F.col(kind), lambda x: F.struct(x["s"], F.lit(order).alias("o"), x["e"], F.lit(kind).alias("kind"), both(value(x["m"])).alias("value")))

    every = F.concat(*(entries(o, k) for o, k in enumerate((*KINDS, "mixed"))))
    own = own.select("doc_id", "repo", "owner", F.array_sort(every).alias("found"))
    # a name of 128 bits for the row, so that repeated rows share their verdicts
    own = stored(own.withColumns({"row": F.xxhash64("doc_id", "repo", "owner", "found"), "row2": F.xxhash64("found", "owner", "repo", "doc_id")}), "candidates")
    plain = own.where(F.size("found") == 0)
    some = own.where(F.size("found") > 0)
    each = some.select("row", "row2", "repo", "owner", F.posexplode("found").alias("nth", "x")).select("row", "row2", "repo", "owner", "nth", F.col("x.value").alias("value"))
    holders = each.select("value", "repo", "owner").distinct().groupBy("value", "repo").agg(F.count("*").alias("owners"))
    spread = holders.groupBy("value").agg(F.count("*").alias("repos"), F.sum("owners").alias("owners"))
    lives = ((F.col("owners") < owners) | (F.col("repos") < repositories)).alias("lives")
    # both aggregates are tables, so that the joins with them may be split where very many rows hold one value, or are one row
    spread = stored(spread.select("value", lives), "spread")
    used = stored(each.select("row", "row2", "nth", "value").distinct(), "used")
    verdicts = used.join(spread, "value").groupBy("row", "row2").agg(F.array_sort(F.collect_list(F.struct("nth", "lives"))).alias("v"))
    verdicts = stored(verdicts.select("row", "row2", F.col("v.lives").alias("lives")), "verdicts")
    judged = some.join(verdicts, ["row", "row2"]).select("doc_id", "found", "lives")
    return judged.unionByName(plain.select("doc_id", "found", F.array().cast("array<boolean>").alias("lives"))).select("doc_id", *_digest())


def _digest() -> list[Column]:
    base = F.filter("found", lambda x: x["o"] < len(KINDS))
    both = F.filter(F.arrays_zip("found", "lives"), lambda x: (x["found"]["o"] < len(KINDS)) | x["lives"])
    shown = F.transform(both, lambda x: x["found"])
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    n_live = F.size(F.filter("lives", lambda x: x)).cast("long")
    return [*map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(shown).alias("spans"), n_live.alias("n_live"), (F.size("found") - n_live).cast("long").alias("n_copied")]
