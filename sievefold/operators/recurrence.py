"""Calendars from recurrence rules: days, times and instants as sequences that Spark explodes."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The longest a rule may pause, the most runs of one, and the largest intervals.
LONGEST_GAP, MOST_RUNS = 3700, 10_000
DAY = 86_400  # seconds
INTERVALS = {"hourly": 23, "daily": 365, "weekly": 52, "monthly": 24}


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    """frequency: once, hourly, daily, weekly or monthly. Weekdays count from Sunday = 0.

    monthly: day (clamped to the month's end), last-day, or weekday (week_of_month 1 to 4, -1 for the last).
    end: never, date (inclusive) or count. Times are of zone.
    """

    frequency: str
    start: dt.date
    time: str = "02:00"
    interval: int = 1
    until_time: str = "23:59"
    weekdays: tuple[int, ...] = field(default=(0, 1, 2, 3, 4, 5, 6))
    workdays_only: bool = False
    monthly_mode: str = "day"
    month_day: int = 1
    week_of_month: int = 1
    weekday: int = 1
    end: str = "never"
    end_date: dt.date | None = None
    count: int | None = None
    zone: str = "UTC"

    def __post_init__(self):
        checks = {
            "frequency": self.frequency in ("once", "hourly", "daily", "weekly", "monthly"),
            "time": all(len(t) == 5 and t[2] == ":" and t[:2].isdigit() and t[3:].isdigit() and int(t[:2]) < 24 and int(t[3:]) < 60 for t in (self.time, self.until_time)),
            "interval": 1 <= self.interval <= INTERVALS.get(self.frequency, 366),
            "weekdays": all(0 <= d <= 6 for d in self.weekdays) and (self.frequency not in ("hourly", "weekly") or bool(self.weekdays)),
            "monthly_mode": self.monthly_mode in ("day", "last-day", "weekday"),
            "month_day": 1 <= self.month_day <= 31,
            "week_of_month": self.week_of_month in (1, 2, 3, 4, -1),
            "end": self.end in ("never", "date", "count") and (self.end != "date" or self.end_date is not None) and (self.end != "count" or 1 <= (self.count or 0) <= MOST_RUNS),
        }
        wrong = [k for k, ok in checks.items() if not ok]
        if wrong:
            raise RuleError(", ".join(wrong))


#: Columns of a table of rules. Weekdays are a sum of powers of two, Sunday = 1; times are minutes of the day.
COLUMNS = "frequency string, start date, minute int, until_minute int, interval int, weekdays int, workdays_only boolean, monthly_mode string, month_day int, week_of_month int, weekday int, ending string, end_date date, count int, zone string"


def _minutes(time: str) -> int:
    return int(time[:2]) * 60 + int(time[3:])


def table_of(spark: SparkSession, *rules: Rule) -> DataFrame:
    """Rules as rows; rule numbers them from 0."""
    rows = [(k, r.frequency, r.start, _minutes(r.time), _minutes(r.until_time), r.interval, sum(1 << d for d in set(r.weekdays)), r.workdays_only, r.monthly_mode, r.month_day, r.week_of_month, r.weekday, r.end, r.end_date, r.count, r.zone) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, f"rule long, {COLUMNS}")


def _weekday(day: Column) -> Column:
    return F.dayofweek(day) - 1


def _fits(day: Column) -> Column:
    """Whether a day belongs to the rule of its row."""
    start, every = F.col("start"), F.col("interval")
    chosen = F.col("weekdays").bitwiseAND(F.pow(F.lit(2), _weekday(day)).cast("int")) > 0
    weeks = (F.datediff(F.trunc(day, "week"), F.trunc(start, "week")) / 7).cast("int")
    months = (F.year(day) - F.year(start)) * 12 + F.month(day) - F.month(start)
    number, last = F.dayofmonth(day), F.dayofmonth(F.last_day(day))
    nth = F.when(F.col("week_of_month") == -1, number + 7 > last).otherwise(F.ceil(number / 7) == F.col("week_of_month"))
    of_month = (
        F.when(F.col("monthly_mode") == "last-day", number == last)
        .when(F.col("monthly_mode") == "weekday", (_weekday(day) == F.col("weekday")) & nth)
        .otherwise(number == F.least(F.col("month_day"), last))
    )
    return (
        F.when(F.col("frequency") == "once", day == start)
        .when(F.col("frequency") == "daily", F.when(F.col("workdays_only"), _weekday(day).between(1, 5)).otherwise(F.datediff(day, start) % every == 0))
        .when(F.col("frequency") == "hourly", chosen)
        .when(F.col("frequency") == "weekly", (weeks % every == 0) & chosen)
        .otherwise((months % every == 0) & of_month)
    )


def _of_week() -> Column:
    return F.col("frequency").isin("hourly", "weekly")


def _with_candidates(rules: DataFrame, first: Column, last: Column) -> DataFrame:
    """rules with _begin and _stop (the span within which days count), _base (where a rule's periods begin in it) and _size: how many days may belong to
    the rule, one for each of its periods, or all days of its weeks."""
    start, begin, stop, base, every = F.col("start"), F.col("_begin"), F.col("_stop"), F.col("_base"), F.abs("interval")
    due = lambda passed: F.pmod(-passed, every)  # noqa: E731 periods from the first day's to the next one that counts
    weeks = (F.datediff(F.trunc(begin, "week"), F.trunc(start, "week")) / 7).cast("int")
    months = lambda a, b: (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
    each_day = (F.col("frequency") == "hourly") | ((F.col("frequency") == "daily") & F.col("workdays_only"))
    kinds = lambda once, day, daily, week, month: F.when(F.col("frequency") == "once", once).when(each_day, day).when(F.col("frequency") == "daily", daily).when(F.col("frequency") == "weekly", week).otherwise(month)
    spanned = rules.withColumns({"_begin": F.greatest(first, start), "_stop": F.when((F.col("ending") == "date") & (F.col("frequency") != "once"), F.least(last, F.col("end_date"))).otherwise(last)})
    based = spanned.withColumn("_base", kinds(start, begin, F.date_add(begin, due(F.datediff(begin, start))), F.date_add(F.trunc(begin, "week"), due(weeks) * 7), F.add_months(F.trunc(begin, "month"), due(months(begin, start)))))
    days = F.datediff(stop, base)
    size = kinds(F.lit(1), days + 1, F.floor(days / every) + 1, (F.floor(days / (every * 7)) + 1) * 7, F.floor(months(stop, base) / every) + 1)
    return based.withColumn("_size", F.when(stop >= begin, size).otherwise(0).cast("int"))


def _candidate(k: Column) -> Column:
    """The day at k, counted from 0, of those that may belong to the rule of a row of _with_candidates."""
    base, every, mode = F.col("_base"), F.abs("interval"), F.col("monthly_mode")
    month = F.add_months(base, k * every)
    end = F.last_day(month)
    of_month = (
        F.when(mode == "last-day", end)
        .when((mode == "weekday") & (F.col("week_of_month") == -1), F.date_sub(end, F.pmod(_weekday(end) - F.col("weekday"), F.lit(7))))
        .when(mode == "weekday", F.date_add(month, F.pmod(F.col("weekday") - _weekday(month), F.lit(7)) + (F.col("week_of_month") - 1) * 7))
        .otherwise(F.date_add(month, F.least(F.col("month_day"), F.dayofmonth(end)) - 1))
    )
    return (
        F.when(F.col("frequency") == "once", base)
        .when((F.col("frequency") == "hourly") | ((F.col("frequency") == "daily") & F.col("workdays_only")), F.date_add(base, k))
        .when(F.col("frequency") == "daily", F.date_add(base, k * every))
        .when(F.col("frequency") == "weekly", F.date_add(base, F.floor(k / 7).cast("int") * 7 * every + k % 7))
        .otherwise(of_month)
    )


def _belongs(day: Column) -> Column:
    return day.between(F.col("_begin"), F.col("_stop")) & _fits(day)


_SPAN = ("_begin", "_stop", "_base", "_size")


def _days_within(rules: DataFrame, first: Column, last: Column) -> DataFrame:
    """days_of with the columns of _with_candidates."""
    each = _with_candidates(rules, first, last).withColumn("_k", F.explode(F.when(F.col("_size") > 0, F.sequence(F.lit(0), F.col("_size") - 1))))
    return each.withColumn("day", _candidate(F.col("_k"))).where(_belongs(F.col("day"))).drop("_k")


def days_of(rules: DataFrame, first: Column, last: Column) -> DataFrame:
    """rules with day: a row for each day within [first, last] on which a rule applies. first and last are expressions of a rule's row.

    Only days that may belong to a rule are made: one for each of its periods, or those of its weeks."""
    return _days_within(rules, first, last).drop(*_SPAN)


def _by_copies(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules with a row of their own, and those that share their number with others, whose runs have to be told apart."""
    counted = rules.withColumn("_copies", F.count("*").over(Window.partitionBy("rule")))
    return counted.where("_copies = 1").drop("_copies"), counted.where("_copies > 1").drop("_copies")


def _minutes_of() -> Column:
    """The minutes of a day on which the rule of a row runs."""
    hourly = F.col("frequency") == "hourly"
    end, step = F.when(hourly, F.col("until_minute")).otherwise(F.col("minute")), F.when(hourly, F.col("interval") * 60).otherwise(60)
    return F.when(end >= F.col("minute"), F.sequence(F.col("minute"), end, step))


def _local(day: Column, minute: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + minute * 60)


def _own_instants(rules: DataFrame, first: Column, last: Column) -> DataFrame:
    """instants_of each row by itself, made and checked row by row. A time that the clock skips is left out where the one that it becomes is a run too.

    A zone is asked twice a day, not for each run: where it is as far ahead the day before as after the next day (no zone changes its clock twice within that time), it is so all day."""
    dated = _days_within(rules, first, last).withColumn("_midnight", F.unix_timestamp(F.col("day").cast("timestamp")))
    ahead = lambda days: F.col("_midnight") + days * DAY - F.unix_timestamp(F.to_utc_timestamp(F.timestamp_seconds(F.col("_midnight") + days * DAY), F.col("zone")))
    each = dated.withColumns({"_before": ahead(-1), "_after": ahead(2)}).withColumn("_ahead", F.when(F.col("_before") == F.col("_after"), F.col("_before"))).drop("_before", "_after").withColumn("_m", F.explode(_minutes_of()))
    local = F.col("_midnight") + F.col("_m") * 60
    each = each.withColumn("_local", F.timestamp_seconds(local)).withColumn("at", F.when(F.col("_ahead").isNotNull(), F.timestamp_seconds(local - F.col("_ahead"))).otherwise(F.to_utc_timestamp("_local", F.col("zone"))))
    shown = F.from_utc_timestamp("at", F.col("zone"))
    day = F.to_date(shown)
    past = F.unix_timestamp(shown) - F.unix_timestamp(day.cast("timestamp")) - F.col("minute") * 60  # seconds since the day's first run
    hourly = F.col("frequency") == "hourly"
    in_day = F.when(hourly, past.between(0, (F.col("until_minute") - F.col("minute")) * 60) & (past % (F.col("interval") * 3600) == 0)).otherwise(past == 0)
    twice = (shown != F.col("_local")) & in_day & _belongs(day)
    return each.where(F.col("_ahead").isNotNull() | ~F.coalesce(twice, F.lit(False))).drop("_m", "_local", "_midnight", "_ahead", "day", *_SPAN)


def instants_of(rules: DataFrame, first: Column, last: Column) -> DataFrame:
    """rules with at (UTC), strictly increasing in a rule: a local time that the clock skips becomes the next one, once.

    No run is shuffled but those of rules that share a number."""
    alone, shared = (_own_instants(r, first, last) for r in _by_copies(rules))
    return alone.unionByName(shared.dropDuplicates(["rule", "at"]))


#: Fixed value: days on which a rule may run and yet have no run of its own after an instant: those around the instant in any zone, and one that the clock skips.
SPARE_DAYS = 4


def upcoming_of(rules: DataFrame, after: Column, n: int, *, remaining: Column | None = None) -> DataFrame:
    """The next n runs of each rule after an instant (UTC), with nth from 1; at most as many as remain of a rule that ends by count.

    A rule's row makes its own runs, no more than n and those of the spare days; no run is shuffled but those of rules that share a number."""
    first = F.date_sub(F.to_date(after), 1)
    limit = F.lit(n) if remaining is None else F.when(F.col("ending") == "count", F.greatest(F.lit(0), F.least(F.lit(n), F.coalesce(remaining, F.lit(n))))).otherwise(n)
    alone, shared = (_next_runs(r, first, after, limit) for r in _by_copies(rules))
    merged = shared.dropDuplicates(["rule", "at"]).withColumn("nth", F.row_number().over(Window.partitionBy("rule").orderBy("at")))
    return alone.unionByName(merged.where(F.col("nth") <= F.col("_limit"))).drop("_limit")


def _next_runs(rules: DataFrame, first: Column, after: Column, limit: Column) -> DataFrame:
    """rules with at, nth and _limit: the next runs of each row by itself."""
    spanned = _with_candidates(rules, first, F.date_add(F.greatest(first, F.col("start")), LONGEST_GAP)).withColumn("_limit", limit)
    days, chosen = F.col("_limit") + SPARE_DAYS, F.bit_count(F.col("weekdays").bitwiseAND(127))
    enough = (
        F.when(_of_week(), F.when(chosen > 0, (F.ceil(days / chosen) + 1) * 7).otherwise(0))
        .when((F.col("frequency") == "daily") & F.col("workdays_only"), (F.ceil(days / 5) + 1) * 7)
        .when((F.col("monthly_mode") == "weekday") & (F.col("week_of_month") > 4), F.col("_size"))  # not in every month
        .otherwise(days + 1)
    )
    taken = spanned.withColumn("_size", F.least("_size", enough.cast("int")))
    candidates = F.when(F.col("_size") > 0, F.transform(F.sequence(F.lit(0), F.col("_size") - 1), _candidate))
    dated = taken.withColumn("_days", F.slice(F.filter(candidates, _belongs), F.lit(1), days)).withColumn("_minutes", _minutes_of())
    each = F.flatten(F.transform("_days", lambda d: F.transform("_minutes", lambda m: F.to_utc_timestamp(_local(d, m), F.col("zone")))))
    runs = dated.withColumn("_at", F.slice(F.array_sort(F.array_distinct(F.filter(each, lambda a: a > after))), F.lit(1), F.col("_limit")))
    numbered = runs.select(*rules.columns, "_limit", F.posexplode("_at").alias("_nth", "at"))
    return numbered.withColumn("nth", F.col("_nth") + 1).drop("_nth")


def counts_between(rules: DataFrame, after: Column, until: Column, *, cap: int = 1000) -> DataFrame:
    """rule and runs, the number of its runs after one instant up to another, at most cap; rules without any have none."""
    found = instants_of(rules, F.date_sub(F.to_date(after), 1), F.date_add(F.to_date(until), 1)).where((F.col("at") > after) & (F.col("at") <= until))
    counted = found.groupBy("rule").agg(F.count("*").alias("runs"))
    return rules.select("rule").join(counted, "rule", "left").select("rule", F.least(F.coalesce("runs", F.lit(0)), F.lit(cap)).cast("long").alias("runs"))


def last_runs(rules: DataFrame, after: Column) -> DataFrame:
    """rule and at, the last run after an instant of each rule that ends; rules that never end, or have ended, have no row."""
    dated = instants_of(rules.where("ending = 'date' and frequency <> 'once'"), F.date_sub(F.to_date(after), 1), F.col("end_date"))
    single = rules.where("frequency = 'once'")
    once = instants_of(single, F.date_sub(F.to_date(after), 1), F.greatest(F.col("start"), F.to_date(after)))
    ends = dated.select("rule", "at").unionByName(once.select("rule", "at")).where(F.col("at") > after).groupBy("rule").agg(F.max("at").alias("at"))
    counted = upcoming_of(rules.where("ending = 'count' and frequency <> 'once'"), after, MOST_RUNS, remaining=F.col("count"))
    return ends.unionByName(counted.groupBy("rule").agg(F.max("at").alias("at")))


def rule_errors(rules: DataFrame) -> DataFrame:
    """rules with errors: the names of the fields that make no rule, in order; an empty list for a right one."""
    checks = {
        "frequency": F.col("frequency").isin("once", "hourly", "daily", "weekly", "monthly"),
        "time": F.col("minute").between(0, 1439) & F.col("until_minute").between(0, 1439),
        "interval": F.col("interval").between(1, F.coalesce(F.get(F.filter(F.array(*(F.when(F.col("frequency") == k, F.lit(n)) for k, n in INTERVALS.items())), lambda n: n.isNotNull()), F.lit(0)), F.lit(366))),
        "weekdays": F.col("weekdays").between(F.when(F.col("frequency").isin("hourly", "weekly"), 1).otherwise(0), 127),
        "monthly_mode": F.col("monthly_mode").isin("day", "last-day", "weekday"),
        "month_day": F.col("month_day").between(1, 31),
        "week_of_month": F.col("week_of_month").isin(1, 2, 3, 4, -1),
        "end": F.col("ending").isin("never", "date", "count") & ((F.col("ending") != "date") | F.col("end_date").isNotNull()) & ((F.col("ending") != "count") | F.coalesce(F.col("count").between(1, MOST_RUNS), F.lit(False))),
    }
    wrong = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    return rules.withColumn("errors", wrong)


# one rule


def days(spark: SparkSession, rule: Rule, first: dt.date, last: dt.date) -> DataFrame:
    """Days within [first, last] on which the rule applies."""
    return days_of(table_of(spark, rule), F.lit(first), F.lit(last)).select("day")


def instants(spark: SparkSession, rule: Rule, first: dt.date, last: dt.date) -> DataFrame:
    return instants_of(table_of(spark, rule), F.lit(first), F.lit(last)).select("at")


def upcoming(spark: SparkSession, rule: Rule, after: dt.datetime, n: int, *, remaining: int | None = None) -> DataFrame:
    """The next n runs after an instant (UTC), at most as many as remain of a rule that ends by count."""
    return upcoming_of(table_of(spark, rule), F.lit(after), n, remaining=F.lit(remaining).cast("int")).select("at").orderBy("at")


def count_between(spark: SparkSession, rule: Rule, after: dt.datetime, until: dt.datetime, *, cap: int = 1000) -> int:
    return counts_between(table_of(spark, rule), F.lit(after), F.lit(until), cap=cap).first().runs


def last_run(spark: SparkSession, rule: Rule, after: dt.datetime) -> DataFrame:
    """The last run of a rule that ends, or no row."""
    return last_runs(table_of(spark, rule), F.lit(after)).select("at")
