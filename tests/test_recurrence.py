"""Runs of many rules at once against plain Python, and how much is made on the way to them."""

import datetime as dt
import random
from collections import defaultdict
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from sievefold.operators import recurrence as r

UTC = dt.UTC
FIRST, LAST, AFTER = dt.date(2026, 3, 1), dt.date(2026, 5, 20), dt.datetime(2026, 3, 7, 12, tzinfo=UTC)
ZONES = ("UTC", "America/New_York", "Europe/Lisbon", "Pacific/Kiritimati", "America/Havana")  # Havana's clock skips midnight


def rule_rows():
    rng, rows = random.Random(5), []
    for k in range(250):
        frequency = ("once", "hourly", "daily", "weekly", "monthly")[k % 5]
        ending = rng.choice(("never", "date", "count"))
        rows.append(
            (k if k < 240 else k - 10, frequency, dt.date(2025, 12, 1) + dt.timedelta(rng.randrange(130)), rng.choice((0, 30, 150, 1439, rng.randrange(1440))), rng.choice((1439, 600)), rng.randint(1, 3), rng.randint(1, 127),
             rng.random() < 0.4, rng.choice(("day", "last-day", "weekday")), rng.randint(1, 31), rng.choice((1, 2, 3, 4, -1)), rng.randrange(7), ending, FIRST + dt.timedelta(rng.randrange(60)) if ending == "date" else None, rng.randint(1, 6) if ending == "count" else None, rng.choice(ZONES))
        )
    return rows


def of_days(row, first, last):
    _, frequency, start, _, _, every, weekdays, workdays, mode, month_day, nth, weekday, ending, end, _, _ = row
    day = max(first, start)
    while day <= (min(last, end) if ending == "date" and frequency != "once" else last):
        of_week = day.isoweekday() % 7
        after = (day + dt.timedelta(1)).replace(day=1) if (day + dt.timedelta(1)).day == 1 else None
        final = after is not None
        month_end = ((day.replace(day=28) + dt.timedelta(4)).replace(day=1) - dt.timedelta(1)).day
        ok = {
            "once": day == start,
            "hourly": weekdays >> of_week & 1,
            "daily": of_week in range(1, 6) if workdays else (day - start).days % every == 0,
            "weekly": ((day - dt.timedelta(day.weekday())) - (start - dt.timedelta(start.weekday()))).days // 7 % every == 0 and weekdays >> of_week & 1,
            "monthly": ((day.year - start.year) * 12 + day.month - start.month) % every == 0
            and {"last-day": final, "weekday": of_week == weekday and (day.day + 7 > month_end if nth == -1 else (day.day + 6) // 7 == nth), "day": day.day == min(month_day, month_end)}[mode],
        }[frequency]
        if ok:
            yield day
        day += dt.timedelta(1)


def of_runs(row, first, last):
    """Instants of a rule; Python gives a local time that the clock skips the offset from before it, which moves it on by what is skipped."""
    minute, until, every, zone = row[3], row[4], row[5], ZoneInfo(row[15])
    minutes = range(minute, until + 1, every * 60) if row[1] == "hourly" else [minute]
    return {dt.datetime.combine(d, dt.time(m // 60, m % 60), zone).astimezone(UTC) for d in of_days(row, first, last) for m in minutes}


def by_rule(made):
    out = defaultdict(set)
    for row, runs in made:
        out[row[0]] |= runs
    return out


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(rule_rows(), f"rule long, {r.COLUMNS}")


def got(df):
    out = defaultdict(list)
    for row in df.select("rule", "at").collect():
        out[row.rule].append(row.at.replace(tzinfo=UTC))
    return {k: sorted(v) for k, v in out.items()}


def test_days(rules):
    found = {(x.rule, x.day, x.frequency, x.start) for x in r.days_of(rules, F.lit(FIRST), F.lit(LAST)).collect()}
    assert found == {(row[0], d, row[1], row[2]) for row in rule_rows() for d in of_days(row, FIRST, LAST)}


def test_upcoming_of_many(rules):
    """Also of rules that share a number: their runs are counted together."""
    n = 5
    found = r.upcoming_of(rules, F.lit(AFTER), n, remaining=F.lit(4))
    limit = {row[0]: 4 if row[12] == "count" else n for row in rule_rows()}
    own = {row[0] for row in rule_rows() if sum(x[0] == row[0] for x in rule_rows()) == 1}
    want = {k: sorted(a for a in v if a > AFTER)[: limit[k]] for k, v in by_rule((row, of_runs(row, dt.date(2026, 3, 5), dt.date(2028, 1, 1))) for row in rule_rows()).items()}
    made = got(found)
    assert {k: v for k, v in made.items() if k in own} == {k: v for k, v in want.items() if k in own and v}
    assert all(made[k] == v[: len(made[k])] and len(made[k]) >= min(4, len(v)) for k, v in want.items() if k not in own and v)
    assert [x.nth for x in found.where("rule = 2").orderBy("at").collect()] == list(range(1, len(made[2]) + 1))


def test_upcoming_makes_few_days(rules):
    """The next runs come from a few periods of each rule, not from all days of ten years."""
    after = F.lit(dt.datetime(2026, 3, 7, 12))
    spanned = r._with_candidates(rules, F.lit(FIRST), F.date_add(F.lit(FIRST), r.LONGEST_GAP))
    assert spanned.where("frequency = 'monthly'").agg(F.max("_size")).first()[0] <= r.LONGEST_GAP // 28
    plan = r.upcoming_of(rules, after, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan and plan.count("Deduplicate") <= 1


def test_instants_of_many(rules):
    """Local times that the clock skips count once; runs are not shuffled but those of rules that share a number."""
    found = r.instants_of(rules, F.lit(FIRST), F.lit(LAST))
    assert got(found) == {k: sorted(v) for k, v in by_rule((row, of_runs(row, FIRST, LAST)) for row in rule_rows()).items() if v}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(_copies" in plan


def test_clock_change_takes_rules_of_every_kind(spark, sf):
    from sievefold.plans import catalog, views

    catalog.load()
    rows = views.view(spark, sf, "rules").collect()
    want = {(row[0], f"{a:%Y-%m-%d %H:%M}") for row in rows for a in of_runs(row, dt.date(2026, 1, 1), row.start + dt.timedelta(120))}
    found = catalog.QUERIES["r3_clock_change"](spark, sf).collect()
    assert len(found) == len(want) and {(x.rule, x.at) for x in found} == want
    assert {row.frequency for row in rows if row.rule in {x.rule for x in found}} == {row.frequency for row in rows}


def test_zones_are_asked_by_day(rules):
    """Each run is reckoned from its day where the clock doesn't change nearby; those nights give the same runs as plain Python."""
    near = [row for row in rule_rows() if row[15] in ("America/New_York", "America/Havana")]
    first, last = dt.date(2026, 3, 6), dt.date(2026, 3, 10)  # the clock skips an hour on the 8th
    found = r.instants_of(rules.where("zone in ('America/New_York', 'America/Havana')"), F.lit(first), F.lit(last))
    assert got(found) == {k: sorted(v) for k, v in by_rule((row, of_runs(row, first, last)) for row in near).items() if v}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN isnotnull(_ahead" in plan
