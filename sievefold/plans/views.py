"""The library's inputs made from the test tables, in SQL that Spark and DuckDB both read.

Derived columns are deterministic stand-ins. Each view is a template over table names in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "files": """
        SELECT doc_id AS id, source AS repository, lang AS grp, text,
          concat('Doc', cast(doc_id AS string), CASE doc_id % 7 WHEN 0 THEN '.TXT' WHEN 1 THEN '.pdf' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '' WHEN 4 THEN '.mp3' WHEN 5 THEN '.docx' ELSE '.XYZ' END) AS name,
          concat('dir', cast(doc_id % 7 AS string), '/Sub ', cast(doc_id % 3 AS string)) AS folder,
          n_chars * 37 AS size,
          CASE WHEN doc_id % 13 = 0 THEN cast(NULL AS timestamp) WHEN doc_id % 17 = 0 THEN timestamp '1979-05-01 00:00:00' ELSE timestamp '2024-02-01 10:00:00' - interval '1' day * (doc_id * 37 % 5000) END AS modified,
          CASE WHEN doc_id % 5 = 0 THEN cast(NULL AS timestamp) ELSE timestamp '2024-01-20 08:00:00' - interval '1' day * (doc_id * 53 % 4000) END AS created,
          CASE WHEN doc_id % 4 = 0 THEN cast(NULL AS timestamp) ELSE timestamp '2024-01-25 09:30:00' - interval '1' day * (doc_id * 29 % 3000) END AS accessed,
          CASE WHEN doc_id % 6 = 0 THEN cast(NULL AS string) WHEN doc_id % 6 = 1 THEN '' ELSE concat('User', cast(doc_id % 11 AS string)) END AS author,
          CASE WHEN doc_id % 5 < 2 THEN cast(NULL AS string) ELSE concat('Owner', cast(doc_id % 4 AS string)) END AS owner,
          CASE doc_id % 9 WHEN 0 THEN 'partial' WHEN 1 THEN 'encrypted' WHEN 2 THEN 'skipped-size' WHEN 3 THEN 'empty' WHEN 4 THEN 'error' ELSE 'ok' END AS status
        FROM {documents}""",
    "messages": """
        SELECT conv_id * 1000 + turn AS id, concat('box', cast(conv_id % 9 AS string), '@empresa.com') AS mailbox,
          CASE conv_id % 5 WHEN 0 THEN 'Inbox' WHEN 1 THEN 'Inbox/Férias' WHEN 2 THEN 'Lixeira' WHEN 3 THEN 'Lixeira/2020' ELSE 'Sent' END AS folder,
          concat(role, cast(conv_id % 6 AS string), '@', CASE turn % 4 WHEN 0 THEN 'empresa.com' WHEN 1 THEN 'mail.Parceiro.com' WHEN 2 THEN 'outro.net' ELSE 'filial.empresa.com' END) AS sender,
          concat('cli', cast((conv_id + turn) % 10 AS string), '@', CASE (conv_id + turn) % 3 WHEN 0 THEN 'empresa.com' WHEN 1 THEN 'parceiro.com' ELSE 'x.outro.net' END) AS recipient,
          CASE WHEN conv_id % 4 = 0 THEN 'channel' ELSE 'chat' END AS scope, concat('team', cast(conv_id % 3 AS string)) AS team, role, text, conv_id, turn,
          concat('src', cast(conv_id % 2 AS string)) AS source,
          CASE WHEN turn % 3 = 0 THEN cast(NULL AS boolean) ELSE turn % 3 = 1 END AS attached,
          CASE WHEN (conv_id + turn) % 19 = 0 THEN cast(NULL AS timestamp) ELSE timestamp '2024-01-31 12:00:00' - interval '1' hour * (conv_id * 31 + turn * 7) END AS sent
        FROM {conversations}""",
    "deletions": """
        SELECT event_id AS seq, ts AS done_at, cast(user_id AS bigint) AS item, cast(event_id % 5 AS bigint) AS scan,
          CASE event_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'missing' WHEN 2 THEN 'changed' ELSE 'deleted' END AS status,
          CASE event_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'retention' ELSE 'auto' END AS mode,
          CASE WHEN event_id % 4 = 0 THEN cast(NULL AS string) ELSE concat('policy', cast(event_id % 3 AS string)) END AS policy,
          CASE WHEN event_id % 7 = 0 THEN cast(NULL AS string) ELSE concat('repo', cast(event_id % 4 AS string)) END AS repository,
          CASE event_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'onedrive' WHEN 2 THEN 'sharepoint' ELSE 'mail' END AS kind,
          CASE WHEN event_id % 11 = 0 THEN cast(NULL AS bigint) ELSE cast(floor(value * 100) AS bigint) END AS size
        FROM {events}""",
    "accounts": """
        SELECT c_custkey AS id, concat('C', cast(c_custkey AS string), '@', CASE c_nationkey % 3 WHEN 0 THEN 'empresa.com' WHEN 1 THEN 'vendas.empresa.com' ELSE 'fora.org' END) AS address,
          c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN cast(NULL AS boolean) ELSE c_acctbal >= 0 END AS enabled,
          CASE WHEN c_custkey % 8 = 0 THEN cast(NULL AS boolean) ELSE c_custkey % 3 = 0 END AS licensed,
          CASE c_custkey % 4 WHEN 0 THEN 'shared' ELSE 'user' END AS type, c_custkey % 4 AS n_aliases, concat('src', cast(c_nationkey % 2 AS string)) AS source, c_mktsegment AS department
        FROM {customer}""",
    "retained": """
        SELECT o_orderkey AS id, cast(o_orderdate AS timestamp) AS used, cast(round(o_totalprice) AS bigint) AS size, concat('box', cast(o_custkey % 50 AS string)) AS mailbox,
          o_orderpriority AS folder, concat('repo', cast(o_custkey % 5 AS string)) AS repository,
          CASE o_orderkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '' ELSE '.mp3' END AS extension,
          CASE WHEN o_orderkey % 9 = 0 THEN cast(NULL AS string) WHEN o_orderkey % 9 = 1 THEN '' ELSE concat('user', cast(o_custkey % 20 AS string)) END AS last_user
        FROM {orders}""",
    "rules": """
        SELECT cast(c_custkey AS bigint) AS rule, CASE c_custkey % 7 WHEN 0 THEN 'once' WHEN 1 THEN 'hourly' WHEN 2 THEN 'daily' WHEN 3 THEN 'weekly' ELSE 'monthly' END AS frequency,
          cast(timestamp '2026-01-01 00:00:00' + interval '1' day * (c_custkey * 13 % 90) AS date) AS start, cast(c_custkey * 30 % 1440 AS int) AS minute, cast(1439 - c_nationkey AS int) AS until_minute,
          cast(1 + c_custkey % 3 AS int) AS interval, cast(1 + c_custkey * 11 % 127 AS int) AS weekdays, c_custkey % 14 = 2 AS workdays_only,
          CASE c_nationkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'last-day' ELSE 'weekday' END AS monthly_mode, cast(1 + c_custkey % 31 AS int) AS month_day,
          cast(CASE c_custkey % 5 WHEN 0 THEN -1 ELSE c_custkey % 5 END AS int) AS week_of_month, cast(c_custkey * 3 % 7 AS int) AS weekday,
          CASE c_custkey % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'count' ELSE 'never' END AS ending,
          CASE WHEN c_custkey % 4 = 0 THEN cast(timestamp '2026-03-01 00:00:00' + interval '1' day * (c_custkey * 7 % 90) AS date) ELSE NULL END AS end_date,
          cast(CASE WHEN c_custkey % 4 = 1 THEN 1 + c_custkey % 9 ELSE NULL END AS int) AS count,
          CASE c_custkey % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN 'America/New_York' ELSE 'Europe/Lisbon' END AS zone
        FROM {customer}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = set(re.findall(r"{(\w+)}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """SQL for DuckDB with those views in front that it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ", ".join(f"{v} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[v])})" for v in used)
    sql = sql.strip()
    if not used:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql[15:]}"
    return f"WITH {ctes}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {ctes} {sql}"
