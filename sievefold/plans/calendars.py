"""Queries on recurrence rules: a rule for each customer, of every kind."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import describe
from ..operators import recurrence as r
from .catalog import query
from .views import view


def _days(span: str) -> str:
    """SQL for the days of every rule in a span (first and last day): CTE d (rule, day and the rule's columns)."""
    first, last = span.split(" .. ")
    return f"""a AS (SELECT *, greatest(start, {first}) AS first_day, CASE WHEN ending = 'date' AND frequency <> 'once' THEN least({last}, end_date) ELSE {last} END AS last_day FROM rules),
    e AS (SELECT *, cast(unnest(range(first_day::timestamp, (last_day + 1)::timestamp, interval '1' day)) AS date) AS day FROM a),
    d AS (SELECT * FROM e WHERE CASE frequency WHEN 'once' THEN day = start
      WHEN 'daily' THEN CASE WHEN workdays_only THEN isodow(day) <= 5 ELSE date_diff('day', start, day) % interval = 0 END
      WHEN 'hourly' THEN (weekdays >> dayofweek(day)) & 1 = 1
      WHEN 'weekly' THEN date_diff('day', date_trunc('week', start), date_trunc('week', day)) // 7 % interval = 0 AND (weekdays >> dayofweek(day)) & 1 = 1
      ELSE (year(day) * 12 + month(day) - year(start) * 12 - month(start)) % interval = 0 AND CASE monthly_mode WHEN 'last-day' THEN day = last_day(day)
        WHEN 'weekday' THEN dayofweek(day) = weekday AND CASE WHEN week_of_month = -1 THEN day(day) + 7 > day(last_day(day)) ELSE (day(day) + 6) // 7 = week_of_month END
        ELSE day(day) = least(month_day, day(last_day(day))) END END)"""


def _instants(span: str) -> str:
    """Adds CTE i (rule, at in UTC and the rule's columns)."""
    return f"""{_days(span)}, m AS (SELECT *, unnest(range(minute, CASE WHEN frequency = 'hourly' THEN until_minute ELSE minute END + 1, CASE WHEN frequency = 'hourly' THEN interval * 60 ELSE 60 END)) AS at_minute FROM d),
    i AS (SELECT DISTINCT rule, frequency, ending, count, timezone('UTC', timezone(zone, day::timestamp + to_minutes(at_minute))) AS "at" FROM m)"""


_SPAN = "date '2026-01-01' .. start + 120"


@query(f"WITH {_days(_SPAN)} SELECT rule, strftime(day, '%Y-%m-%d') AS day FROM d")
def r1_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of every rule up to 120 days after its start."""
    found = r.days_of(view(spark, sf_dir, "rules"), F.lit("2026-01-01").cast("date"), F.date_add("start", 120))
    return found.select("rule", F.date_format("day", "yyyy-MM-dd").alias("day"))


def _of_kind(where: str, name: str) -> None:
    @query(f"WITH {_days(_SPAN)} SELECT rule, count(*) AS days, strftime(min(day), '%Y-%m-%d') AS first, strftime(max(day), '%Y-%m-%d') AS last FROM d WHERE {where} GROUP BY rule", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = r.days_of(view(spark, sf_dir, "rules").where(where), F.lit("2026-01-01").cast("date"), F.date_add("start", 120))
        text = lambda c: F.date_format(c, "yyyy-MM-dd")
        return found.groupBy("rule").agg(F.count("*").alias("days"), text(F.min("day")).alias("first"), text(F.max("day")).alias("last"))


for _name, _where in {
    "r1_daily": "frequency = 'daily' AND NOT workdays_only",
    "r1_workdays": "frequency = 'daily' AND workdays_only",
    "r1_weekly": "frequency = 'weekly'",
    "r1_month_day": "frequency = 'monthly' AND monthly_mode = 'day'",
    "r1_last_day": "frequency = 'monthly' AND monthly_mode = 'last-day'",
    "r1_second_tuesday": "frequency = 'monthly' AND monthly_mode = 'weekday' AND week_of_month > 0",
    "r1_last_friday": "frequency = 'monthly' AND monthly_mode = 'weekday' AND week_of_month = -1",
    "r1_once": "frequency = 'once'",
}.items():
    _of_kind(_where, _name)

_AT = "strftime(\"at\", '%Y-%m-%d %H:%M')"


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias("at")


@query(f"WITH {_instants('start .. start + 10')} SELECT rule, {_AT} AS at FROM i WHERE frequency = 'hourly'")
def r2_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = view(spark, sf_dir, "rules").where("frequency = 'hourly'")
    return r.instants_of(rules, F.col("start"), F.date_add("start", 10)).select("rule", _text("at"))


@query(f"WITH {_instants(_SPAN)} SELECT rule, {_AT} AS at FROM i")
def r3_clock_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of rules in three zones, over the nights on which the clock skips an hour."""
    return r.instants_of(view(spark, sf_dir, "rules"), F.lit("2026-01-01").cast("date"), F.date_add("start", 120)).select("rule", _text("at"))


_AFTER = "timestamp '2026-02-15 12:00:00'"


@query(f"WITH {_instants('date ' + repr('2026-02-14') + ' .. date ' + repr('2026-02-14') + ' + 150')}, n AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY \"at\") AS nth FROM i WHERE \"at\" > {_AFTER}) SELECT rule, nth::INT AS nth, {_AT} AS at FROM n WHERE nth <= 3 AND (ending <> 'count' OR nth <= count) AND \"at\" < timestamp '2026-05-01'")
def r4_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next three runs of every rule that come before May."""
    found = r.upcoming_of(view(spark, sf_dir, "rules"), F.lit("2026-02-15 12:00:00").cast("timestamp"), 3, remaining=F.col("count"))
    return found.where(F.col("at") < F.lit("2026-05-01").cast("timestamp")).select("rule", "nth", _text("at"))


@query(f"WITH {_instants('date ' + repr('2026-02-14') + ' .. greatest(start, date ' + repr('2026-06-30') + ')')} SELECT rule, strftime(max(\"at\"), '%Y-%m-%d %H:%M') AS at FROM i WHERE \"at\" > {_AFTER} AND (ending = 'date' OR frequency = 'once') GROUP BY rule")
def r4_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = view(spark, sf_dir, "rules").where("ending = 'date' or frequency = 'once'")
    return r.last_runs(rules, F.lit("2026-02-15 12:00:00").cast("timestamp")).select("rule", _text("at"))


@query(f"WITH {_instants('date ' + repr('2026-02-14') + ' .. date ' + repr('2026-04-02'))}, c AS (SELECT rule, count(*) AS n FROM i WHERE \"at\" > {_AFTER} AND \"at\" <= timestamp '2026-04-01 12:00:00' GROUP BY rule) SELECT rules.rule, least(coalesce(n, 0), 100) AS runs FROM rules LEFT JOIN c USING (rule)")
def r4_count_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp")
    return r.counts_between(view(spark, sf_dir, "rules"), at("2026-02-15 12:00:00"), at("2026-04-01 12:00:00"), cap=100)


@query(
    """WITH b AS (SELECT rule, frequency, CASE rule % 5 WHEN 0 THEN 0 ELSE interval END AS interval, CASE rule % 6 WHEN 1 THEN 0 ELSE weekdays END AS weekdays, CASE rule % 9 WHEN 2 THEN 32 ELSE month_day END AS month_day, CASE rule % 8 WHEN 0 THEN NULL ELSE end_date END AS end_date, ending FROM rules)
    SELECT rule, concat_ws(',', CASE WHEN interval = 0 THEN 'interval' END, CASE WHEN weekdays = 0 AND frequency IN ('hourly', 'weekly') THEN 'weekdays' END, CASE WHEN month_day = 32 THEN 'month_day' END, CASE WHEN ending = 'date' AND end_date IS NULL THEN 'end' END) AS errors FROM b"""
)
def r5_rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules some of whose fields were made wrong, and what is wrong with each."""
    wrong = lambda n, at, value, name: F.when(F.col("rule") % n == at, F.lit(value)).otherwise(F.col(name))
    broken = view(spark, sf_dir, "rules").withColumns({"interval": wrong(5, 0, 0, "interval"), "weekdays": wrong(6, 1, 0, "weekdays"), "month_day": wrong(9, 2, 32, "month_day"), "end_date": wrong(8, 0, None, "end_date")})
    return r.rule_errors(broken).select("rule", F.array_join("errors", ",").alias("errors"))


_DAY = "strftime({}, '%d/%m/%Y')"
_CLOCK = "printf('%02d:%02d', {0} // 60, {0} % 60)"
_LISTED = "CASE WHEN len({0}) = 1 THEN {0}[1] ELSE concat(array_to_string({0}[1:len({0}) - 1], ', '), ' e ', {0}[len({0})]) END"


@query(
    f"""WITH c AS (SELECT *, list_filter([1, 2, 3, 4, 5], lambda d: (weekdays >> d) & 1 = 1) AS w, list_filter([6, 0], lambda d: (weekdays >> d) & 1 = 1) AS m, {_CLOCK.format("minute")} AS t, {_CLOCK.format("until_minute")} AS u,
        ['domingo', 'segunda', 'terça', 'quarta', 'quinta', 'sexta', 'sábado'] AS names FROM rules),
    n AS (SELECT *, len(w) + len(m) AS days, list_transform(w, lambda d: concat(names[d + 1], 's')) AS women, list_transform(m, lambda d: concat(names[d + 1], 's')) AS men, list_transform(list_concat(w, m), lambda d: names[d + 1]) AS short,
        CASE WHEN weekday BETWEEN 1 AND 5 THEN 'a' ELSE 'o' END AS g, CASE WHEN weekday BETWEEN 1 AND 5 THEN concat(names[weekday + 1], '-feira') ELSE names[weekday + 1] END AS one FROM c),
    p AS (SELECT *, CASE WHEN days = 7 THEN 'todos os dias' WHEN len(w) = 5 AND len(m) = 0 THEN 'de segunda a sexta' ELSE concat(CASE WHEN len(w) = 0 THEN '' WHEN len(w) = 1 THEN concat('às ', women[1], '-feiras') ELSE concat('às ', {_LISTED.format("women")}) END,
        CASE WHEN len(w) > 0 AND len(m) > 0 THEN ' e ' ELSE '' END, CASE WHEN len(m) = 0 THEN '' ELSE concat('aos ', {_LISTED.format("men")}) END) END AS phrase FROM n)
    SELECT rule, CASE WHEN frequency = 'once' THEN concat('Uma vez, em ', {_DAY.format("start")}, ' às ', t) ELSE concat(
      CASE frequency WHEN 'hourly' THEN concat(CASE WHEN interval = 1 THEN 'A cada hora' ELSE concat('A cada ', interval, ' horas') END, ', ', CASE WHEN t = '00:00' AND u = '23:59' THEN 'o dia todo' ELSE concat('das ', t, ' às ', u) END, CASE WHEN days < 7 THEN concat(', ', phrase) ELSE '' END)
        WHEN 'daily' THEN concat(CASE WHEN workdays_only THEN 'De segunda a sexta' WHEN interval = 1 THEN 'Todos os dias' ELSE concat('A cada ', interval, ' dias') END, ', às ', t)
        WHEN 'weekly' THEN concat(CASE WHEN interval > 1 THEN concat('A cada ', interval, ' semanas (', {_LISTED.format("short")}, ')') WHEN days = 1 THEN CASE WHEN len(w) = 1 THEN concat('Toda ', short[1], '-feira') ELSE concat('Todo ', short[1]) END ELSE concat(upper(phrase[1]), phrase[2:]) END, ', às ', t)
        ELSE concat(CASE WHEN interval = 1 THEN 'Todo mês' ELSE concat('A cada ', interval, ' meses') END, ', ', CASE monthly_mode WHEN 'last-day' THEN 'no último dia' WHEN 'weekday' THEN concat('n', g, ' ', CASE week_of_month WHEN 1 THEN 'primeir' WHEN 2 THEN 'segund' WHEN 3 THEN 'terceir' WHEN 4 THEN 'quart' ELSE 'últim' END, g, ' ', one) ELSE concat('no dia ', month_day, CASE WHEN month_day > 28 THEN ' (nos meses mais curtos, no último dia)' ELSE '' END) END, ', às ', t) END,
      CASE WHEN start > date '2026-02-15' THEN concat(', a partir de ', {_DAY.format("start")}) ELSE '' END,
      CASE ending WHEN 'date' THEN concat(', até ', {_DAY.format("end_date")}) WHEN 'count' THEN CASE WHEN count = 1 THEN ', uma única vez' ELSE concat(', ', count, ' execuções no total') END ELSE '' END) END AS words FROM p"""
)
def x27_rules_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.in_words(view(spark, sf_dir, "rules"), dt.date(2026, 2, 15)).select("rule", "words")
