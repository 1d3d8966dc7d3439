"""Queries that lay out reports: columns in the order and under the names that readers see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import matching
from .aggregates import files_with_users
from .catalog import query
from .views import view

#: Labels.
SOURCES = {"audit": "Auditoria do Windows", "metadata": "Metadados do arquivo", "owner": "Proprietário"}
STATES = {"deleted": "Excluído", "missing": "Não encontrado", "changed": "Alterado", "failed": "Falha"}
KINDS = {"local": "Pasta", "onedrive": "OneDrive", "sharepoint": "SharePoint", "mail": "E-mail"}
MODES = {"manual": "Manual", "auto": "Automática", "retention": "Retenção"}


def label(column: Column, labels: dict[str, str]) -> Column:
    out = F.coalesce(column, F.lit(""))
    for key, text in labels.items():
        out = F.when(column == key, F.lit(text)).otherwise(out)
    return out


def sql_label(column: str, labels: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE coalesce({column}, '') END"


_TIME = "coalesce(strftime({}, '%d/%m/%Y %H:%M:%S'), '')"


@query(
    f"""WITH f AS (SELECT *, CASE WHEN id % 10 = 0 THEN 'auditor' WHEN author <> '' THEN author WHEN owner <> '' THEN owner END AS u, CASE WHEN id % 10 = 0 THEN 'audit' WHEN author <> '' THEN 'metadata' WHEN owner <> '' THEN 'owner' ELSE '' END AS s FROM files)
    SELECT repository AS "Repositório", folder AS "Pasta", name AS "Arquivo", regexp_extract(lower(name), '^.+([.][^.]+)$', 1) AS "Extensão", round(size / 1024.0, 1) AS "Tamanho (KB)", {_TIME.format("created")} AS "Criado em", {_TIME.format("modified")} AS "Modificado em",
    coalesce(u, '') AS "Último usuário", {sql_label("s", SOURCES)} AS "Fonte do último usuário", coalesce(owner, '') AS "Proprietário", coalesce(author, '') AS "Autor", concat(folder, '/', name) AS "Caminho completo" FROM f"""
)
def p10_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files_with_users(spark, sf_dir)
    path = F.concat_ws("/", "folder", "name")
    columns = {
        "Repositório": F.col("repository"), "Pasta": t.parent_folder(path), "Arquivo": F.col("name"), "Extensão": t.extension(F.col("name")), "Tamanho (KB)": t.kilobytes(F.col("size")), "Criado em": t.csv_time(F.col("created")), "Modificado em": t.csv_time(F.col("modified")),
        "Último usuário": F.coalesce("last_user", F.lit("")), "Fonte do último usuário": label(F.nullif("last_source", F.lit("none")), SOURCES), "Proprietário": F.coalesce("owner", F.lit("")), "Autor": F.coalesce("author", F.lit("")), "Caminho completo": path,
    }
    return f.select(*(c.alias(n) for n, c in columns.items()))


@query(
    """WITH h AS (SELECT id, name, repository, regexp_extract_all(text, '(?i)\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}\\b') AS v FROM files)
    SELECT repository AS "Repositório", name AS "Arquivo", 'email' AS "Termo", 'content' AS "Encontrado em", cast(len(v) AS bigint) AS "Ocorrências", array_to_string(list_sort(list_distinct(v)), '; ') AS "Valores encontrados" FROM h WHERE len(v) > 0"""
)
def p10_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files")
    hits = matching.preset_hits(files, ["email"]).join(files.select("id", "name", "repository"), "id")
    return hits.select(F.col("repository").alias("Repositório"), F.col("name").alias("Arquivo"), F.col("term_id").alias("Termo"), F.col("location").alias("Encontrado em"), F.col("count").alias("Ocorrências"), F.array_join(F.array_sort("values"), "; ").alias("Valores encontrados"))


@query(
    f"""SELECT {_TIME.format("done_at")} AS "Quando", {sql_label("status", STATES)} AS "Situação", {sql_label("kind", KINDS)} AS "Tipo", coalesce(repository, '') AS "Repositório/Conexão", coalesce(policy, 'Sem política') AS "Política/Agendamento", {sql_label("mode", MODES)} AS "Origem", item AS "Item", round(size / 1024.0, 1) AS "Tamanho (KB)" FROM deletions"""
)
def p10_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "Quando": t.csv_time(F.col("done_at")), "Situação": label(F.col("status"), STATES), "Tipo": label(F.col("kind"), KINDS), "Repositório/Conexão": F.coalesce("repository", F.lit("")), "Política/Agendamento": F.coalesce("policy", F.lit("Sem política")),
        "Origem": label(F.col("mode"), MODES), "Item": F.col("item"), "Tamanho (KB)": t.kilobytes(F.col("size")),
    }
    return view(spark, sf_dir, "deletions").select(*(c.alias(n) for n, c in columns.items()))


@query(
    f"""SELECT source AS "Conexão", mailbox AS "Caixa", folder AS "Pasta", {_TIME.format("sent")} AS "Data", sender AS "Remetente", recipient AS "Destinatários", role AS "Assunto", round(length(text) / 1024.0, 1) AS "Tamanho (KB)" FROM messages"""
)
def p10_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"Conexão": "source", "Caixa": "mailbox", "Pasta": "folder", "Data": t.csv_time(F.col("sent")), "Remetente": "sender", "Destinatários": "recipient", "Assunto": "role", "Tamanho (KB)": t.kilobytes(F.length("text"))}
    return view(spark, sf_dir, "messages").select(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))


@query("SELECT id, name, repository FROM files")
def p11_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal fields, which start with an underscore, stay inside."""
    f = view(spark, sf_dir, "files").select("id", "name", "repository", F.lower("text").alias("_search"))
    return f.drop(*(c for c in f.columns if c.startswith("_")))
