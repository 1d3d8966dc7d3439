"""Scopes in cloud storage: libraries' folders, sites and what lies below them, accounts by alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import ancestors, folder_key

#: First parts of an address that belong to a site's content, not to its name.
CONTENT = ("shared documents", "documentos compartilhados", "documents", "documentos", "siteassets", "site assets", "sitepages", "pages", "lists", "style library", "_layouts", "_api", "_vti_bin")


def site_key(url: Column) -> Column:
    """Comparable address of a site: host and path without pages and libraries, lower-cased, decoded."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z]+://([^/]+)", 1))
    raw = F.regexp_extract(bare, r"^[A-Za-z]+://[^/]+/?(.*)$", 1)
    parts = F.filter(F.split(F.lower(F.coalesce(F.try_url_decode(raw), raw)), "/"), lambda s: s != "")
    first = F.when(F.get(parts, F.lit(0)).isin("sites", "teams"), 2).otherwise(0)
    # the first part that is content ends the name; a form ends it one part earlier
    ends = F.transform(parts, lambda s, i: F.when((i > first) & (s == "forms"), i - 1).when((i >= first) & (s.isin(*CONTENT) | s.endswith(".aspx")), i))
    size = F.coalesce(F.get(F.filter(ends, lambda e: e.isNotNull()), F.lit(0)), F.size(parts))
    name = F.array_join(F.slice(parts, F.lit(1), F.greatest(size, F.lit(0))), "/")
    key = F.when(name == "", F.concat(F.lit("https://"), host)).otherwise(F.concat(F.lit("https://"), host, F.lit("/"), name))
    return F.when(host == "", F.lower(F.regexp_replace(bare, "/+$", ""))).otherwise(key)


def site_ancestors(key: Column) -> Column:
    """The site and those that it lies below; collections (/sites/, /teams/) don't lie below the root site."""
    host = F.regexp_extract(key, r"^(https://[^/]+)", 1)
    path = F.regexp_replace(key, r"^https://[^/]+/?", "")
    below = F.transform(F.filter(ancestors(path), lambda p: p != ""), lambda p: F.concat(host, F.lit("/"), p))
    root = F.when(path.rlike("^(sites|teams)/"), F.array().cast("array<string>")).otherwise(F.array(host))
    return F.concat(root, below)


def covered_sites(items: DataFrame, sites: DataFrame, *, site: str = "site") -> DataFrame:
    """items of a listed site or one below it. sites: site."""
    listed = sites.select(site_key(F.col("site")).alias("_up")).distinct()
    # by distinct sites: numbers given to rows could differ from one computation to the next
    sites_of = items.select(F.col(site).alias("_site")).distinct()
    found = sites_of.select("_site", F.explode(site_ancestors(site_key(F.col("_site")))).alias("_up")).join(listed, "_up", "left_semi").select("_site").distinct()
    return items.join(found, items[site] == F.col("_site"), "left_semi")


def protected_sites(items: DataFrame, guards: DataFrame, *, site: str = "site") -> DataFrame:
    """items with protected: the site lies below a guarded one, or a guarded one below it."""
    keyed = items.withColumn("_key", site_key(F.col(site)))
    guard = guards.select(site_key(F.col("site")).alias("_guard")).distinct()
    keys = keyed.select("_key").distinct()
    below = keys.select("_key", F.explode(site_ancestors(F.col("_key"))).alias("_guard")).join(guard, "_guard", "left_semi").select("_key")
    above = guard.select(F.explode(site_ancestors(F.col("_guard"))).alias("_key")).join(keys, "_key", "left_semi")
    hit = below.unionByName(above).distinct().withColumn("protected", F.lit(True))
    return keyed.join(hit, "_key", "left").withColumn("protected", F.coalesce("protected", F.lit(False))).drop("_key")


def library_folders(specs: DataFrame, libraries: DataFrame) -> DataFrame:
    """(library, folder): where each chosen folder counts; folder '' is the whole library, library null every library.

    A folder that starts with a library's name counts in that one alone, any other in every library.
    specs: path; libraries: library.
    """
    names = libraries.select("library", folder_key(F.col("library")).alias("_name")).distinct()
    own = specs.select(folder_key(F.col("path")).alias("_key")).distinct().withColumn("_first", F.substring_index("_key", "/", 1))
    found = own.join(names, own["_first"] == names["_name"], "left")
    folder = F.when(F.col("library").isNull(), F.col("_key")).otherwise(F.expr("substr(_key, length(_first) + 2)"))
    return found.select("library", folder.alias("folder"))


def in_library_folders(items: DataFrame, scope: DataFrame, *, library: str = "library", folder: str = "folder") -> DataFrame:
    """items that lie in a folder of scope (of library_folders) or below it. Each distinct folder looks its ancestors up by equality."""
    places = items.select(F.col(library).alias("_library"), F.col(folder).alias("_folder")).distinct()
    ups = places.withColumn("_up", F.explode(F.array_union(F.array(F.lit("")), ancestors(folder_key(F.col("_folder"))))))
    there = scope.where("library is not null").select(F.col("library").alias("_library"), F.col("folder").alias("_up"))
    everywhere = scope.where("library is null").select(F.col("folder").alias("_up")).distinct()
    hit = ups.join(there, ["_library", "_up"], "left_semi").unionByName(ups.join(everywhere, "_up", "left_semi").select("_library", "_folder", "_up"))
    hit = hit.select("_library", "_folder").distinct()
    return items.join(hit, items[library].eqNullSafe(F.col("_library")) & items[folder].eqNullSafe(F.col("_folder")), "left_semi")


def covered_accounts(items: DataFrame, accounts: DataFrame) -> DataFrame:
    """items one of whose aliases (array) is a listed account. Distinct lists of aliases are looked up, so rows need no numbers."""
    listed = accounts.select(F.lower("account").alias("_alias")).distinct()
    lists = items.select("aliases").distinct()
    hit = lists.select("aliases", F.explode(F.transform("aliases", F.lower)).alias("_alias")).join(listed, "_alias", "left_semi").select(F.col("aliases").alias("_aliases")).distinct()
    return items.join(hit, items["aliases"] == F.col("_aliases"), "left_semi")


def chat_label(topic: Column, kind: Column, names: Column) -> Column:
    """Topic, or the people of a chat by its kind."""
    joined = F.array_join(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), ", ")
    some = joined != ""
    return (
        F.when(F.coalesce(topic, F.lit("")) != "", topic)
        .when(kind == "oneOnOne", F.when(some, joined).otherwise("Conversa"))
        .when(kind == "meeting", F.when(some, F.concat(F.lit("Reunião: "), joined)).otherwise("Reunião"))
        .otherwise(F.when(some, F.concat(F.lit("Grupo: "), joined)).otherwise("Conversa em grupo"))
    )
