"""Look-ups that complete report rows: last user, audit log, owners, the repository that holds a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import windows_path
from .filters import ancestors


def last_user(*sources: tuple[str, Column]) -> Column:
    """(user, source): the first source, in order, that names someone; blanks name nobody."""
    named = [F.when(F.trim(c) != "", F.struct(F.trim(c).alias("user"), F.lit(s).alias("source"))) for s, c in sources]
    return F.coalesce(*named, F.struct(F.lit(None).cast("string").alias("user"), F.lit("none").alias("source")))


def last_accesses(audit: DataFrame) -> DataFrame:
    """Per path: last access and last write, by time, then id. audit: path, at, id, user, writes.

    max_by combines in the tasks, so that a path with very many events is no hot group.
    """
    rank = F.struct("at", "id")
    who = F.struct("user", "at")
    kept = audit.groupBy(windows_path(F.col("path")).alias("path")).agg(F.max_by(who, rank).alias("seen"), F.max_by(F.when(F.col("writes"), who), F.when(F.col("writes"), rank)).alias("wrote"))
    return kept.select("path", F.col("seen.user").alias("last_user"), F.col("seen.at").alias("last_at"), F.col("wrote.user").alias("writer"), F.col("wrote.at").alias("written_at"))


def longest_prefix(items: DataFrame, roots: DataFrame, *, path: str = "path", root: str = "root") -> DataFrame:
    """items with the columns of the root that contains them most closely, nulls without one.

    Each distinct path looks its ancestors up by equality, so that the join can be hashed; the deepest hit stays.
    """
    name = [c for c in roots.columns if c != root]
    known = roots.select(F.col(root).alias("_root"), F.struct(*name).alias("_x"))
    ups = items.select(F.col(path).alias("_path")).distinct().select("_path", F.explode(ancestors(F.col("_path"))).alias("_root"))
    best = ups.join(known, "_root").groupBy("_path").agg(F.max_by(F.struct("_root", "_x"), F.length("_root")).alias("_b"))
    return items.join(best, items[path] == F.col("_path"), "left").select(*items.columns, F.col("_b._root").alias(root), *(F.col(f"_b._x.{c}").alias(c) for c in name))


def only_owner(items: DataFrame, holders: DataFrame, key: str, value: str) -> DataFrame:
    """value of the one holder of key; null if there is none or more than one."""
    single = holders.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
    return items.join(single, key, "left")


def unprotected(items: DataFrame, guards: DataFrame, *, path: str = "path") -> DataFrame:
    """items not inside a guard's folder, but for what lies in the guard's exceptions. guards: guard, except (array)."""
    ups = items.select("*", F.explode(ancestors(F.col(path))).alias("guard"))
    covered = ups.join(guards, "guard").where(~F.exists(F.coalesce("except", F.array().cast("array<string>")), lambda e: (F.col(path) == e) | F.col(path).startswith(F.concat(e, F.lit("/")))))
    return items.join(covered.select(path).distinct(), path, "left_anti")


def with_lookups(events: DataFrame, **tables: DataFrame) -> DataFrame:
    """events left-joined to a catalogue table for each key; a table has key and name, and a name is added as <key>_name."""
    for key, table in tables.items():
        names = table.select(F.col("key").alias(key), F.col("name").alias(f"{key}_name"))
        events = events.join(names, key, "left")
    return events
