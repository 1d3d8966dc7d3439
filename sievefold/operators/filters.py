"""Filters, orders and pages of report rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import fold_text
from .matching import plain_fold

PAGE, LARGEST_PAGE = 50, 500


def equals(**wanted: str | None) -> Column:
    """Conjunction of column = value; a null column counts as empty, a value of None doesn't filter."""
    tests = [F.coalesce(F.col(k), F.lit("")) == v for k, v in wanted.items() if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def three_valued(column: Column, wanted: str | None) -> Column:
    """yes or no; null is neither."""
    if wanted is None:
        return F.lit(True)
    return F.coalesce(column == (wanted == "yes"), F.lit(False))


def searched(q: str | None, *columns: Column | str) -> Column:
    """Folded q in the folded columns joined by a bar; empty columns are left out."""
    if not q or not q.strip():
        return F.lit(True)
    parts = [F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns]
    return fold_text(F.concat_ws(" | ", *parts)).contains(plain_fold(q))


def deletion_state(status: Column, wanted: str | None) -> Column:
    """failed covers changed; kept covers everything but deleted and missing, rows without a status too."""
    s = F.coalesce(status, F.lit(""))
    return {"deleted": s == "deleted", "missing": s == "missing", "failed": s.isin("failed", "changed"), "kept": ~s.isin("deleted", "missing")}.get(wanted or "", F.lit(True))


def large_enough(size: Column, megabytes: float) -> Column:
    return size >= round(megabytes * 1048576)


def ordered(df: DataFrame, keys: dict[str, Column], sort: str | None, *, default: str, descending: bool = False, tie: str = "id") -> DataFrame:
    """By a key, or the default one if there is no such key; descending reverses ties too."""
    return df.orderBy(*order_of(keys, sort, default=default, descending=descending, tie=tie))


def order_of(keys: dict[str, Column], sort: str | None, *, default: str, descending: bool = False, tie: str = "id") -> list[Column]:
    key = keys.get(sort or "", keys[default])
    return [key.desc_nulls_last(), F.col(tie).desc()] if descending else [key.asc_nulls_first(), F.col(tie).asc()]


def page(df: DataFrame, number: int, *, size: int = PAGE) -> DataFrame:
    """A page of an ordered frame; sizes are held within 1 and LARGEST_PAGE, numbers from 1 on."""
    size = min(max(size, 1), LARGEST_PAGE)
    return df.offset((max(number, 1) - 1) * size).limit(size)


def pages(rows: int, size: int = PAGE) -> int:
    return max(1, -(-rows // size))


def any_prefix(path: Column, prefixes: Column) -> Column:
    """Whether path lies inside one of the folders (never beside one that merely starts alike)."""
    return F.exists(prefixes, lambda f: (f != "") & path.startswith(F.concat(f, F.lit("/"))))


def folder_key(path: Column, *, insensitive: bool = True) -> Column:
    p = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"[\\/]+", "/"), "^/+|/+$", "")
    return F.lower(p) if insensitive else p


def ancestors(path: Column) -> Column:
    """a, a/b, a/b/c of a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def outermost_folders(folders: DataFrame, *, owner: str = "repository", path: str = "path") -> DataFrame:
    """Folders without repeats and without those inside another one; an owner's root stands for all of it.

    Each folder looks its ancestors up by equality, so that no pair of folders is compared.
    """
    keyed = folders.select(owner, folder_key(F.col(path)).alias("key")).distinct()
    above = keyed.select(owner, "key", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("key")))).alias("up")).where("up <> key")
    inside = above.join(keyed.select(owner, F.col("key").alias("up")), [owner, "up"], "left_semi").select(owner, "key").distinct()
    return keyed.join(inside, [owner, "key"], "left_anti")


def in_folders(files: DataFrame, folders: DataFrame, *, owner: str = "repository", path: str = "path") -> DataFrame:
    """Files inside a chosen folder of their owner, by equality on their ancestors; without folders none."""
    keyed = folders.select(owner, folder_key(F.col("path")).alias("up")).where("up <> ''").distinct()
    paths = files.select(owner, F.col(path).alias("_path")).distinct()
    above = F.filter(ancestors(folder_key(F.col("_path"))), lambda u: u != folder_key(F.col("_path")))
    inside = paths.select(owner, "_path", F.explode(above).alias("up")).join(keyed, [owner, "up"], "left_semi").select(owner, "_path").distinct()
    return files.join(inside.withColumnRenamed(owner, "_owner"), (files[owner] == F.col("_owner")) & (files[path] == F.col("_path")), "left_semi")


def export_order() -> list[Column]:
    """The order of exports: repository, then path, without regard to case."""
    return [F.lower("repository"), F.lower("path"), F.col("id")]


def default_sort(*, retention: bool, types: bool, sort: str | None = None, descending: bool = False) -> tuple[str | None, bool]:
    """Sort key and direction: what was asked for; else the oldest first for retention, the largest first for types."""
    if sort:
        return sort, descending
    if types:
        return "size", True
    return ("oldest", descending) if retention else (None, descending)


def natural_key(text: Column) -> Column:
    """Sort key of a text in which runs of digits compare as numbers, of any length, and letters without case.

    A run is written as the number of its digits, without zeros in front, and the digits; between runs the text stays as it is.
    """
    pieces = F.regexp_extract_all(F.lower(text), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def key(piece: Column) -> Column:
        bare = F.ltrim(piece, F.lit("0"))
        return F.when(piece.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare).cast("string"), 9, "0"), bare)).otherwise(piece)

    return F.array_join(F.transform(pieces, key), "")


def trashed(path: Column, trash: list[str]) -> Column:
    """A folder and everything below it."""
    return reduce(lambda a, b: a | b, [(path == t) | path.startswith(t + "/") for t in trash], F.lit(False))
