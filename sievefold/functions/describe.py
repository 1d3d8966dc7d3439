"""Rules and policies in words (Portuguese, as reports show them)."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.recurrence import Rule

#: Weekdays from Sunday on, short forms and plurals; ordinals; units of age; criteria.
DAYS = ("domingo", "segunda-feira", "terça-feira", "quarta-feira", "quinta-feira", "sexta-feira", "sábado")
SHORT = ("domingo", "segunda", "terça", "quarta", "quinta", "sexta", "sábado")
PLURAL = ("domingos", "segundas", "terças", "quartas", "quintas", "sextas", "sábados")
ORDINAL = {1: "primeir", 2: "segund", 3: "terceir", 4: "quart", -1: "últim"}
UNITS = {"days": ("dia", "dias"), "months": ("mês", "meses"), "years": ("ano", "anos")}


def day(d: dt.date) -> str:
    return f"{d:%d/%m/%Y}"


def listed(words: list[str]) -> str:
    return " e ".join(filter(None, [", ".join(words[:-1]), *words[-1:]]))


def age(amount: int, unit: str) -> str:
    return f"{amount} {UNITS[unit][amount != 1]}"


def weekdays(chosen: tuple[int, ...]) -> str:
    """Grouped by grammatical gender: Monday to Friday are feminine."""
    if set(chosen) == set(range(7)):
        return "todos os dias"
    if set(chosen) == set(range(1, 6)):
        return "de segunda a sexta"
    women, men = [d for d in range(1, 6) if d in chosen], [d for d in (6, 0) if d in chosen]
    first = f"às {PLURAL[women[0]]}-feiras" if len(women) == 1 else f"às {listed([PLURAL[d] for d in women])}"
    return " e ".join([first] * bool(women) + [f"aos {listed([PLURAL[d] for d in men])}"] * bool(men))


def rule(r: Rule, *, today: dt.date) -> str:
    """A recurrence rule as a sentence."""
    at = f"às {r.time}"
    woman = 1 <= r.weekday <= 5
    if r.frequency == "once":
        return f"Uma vez, em {day(r.start)} {at}"
    if r.frequency == "hourly":
        span = "o dia todo" if (r.time, r.until_time) == ("00:00", "23:59") else f"das {r.time} às {r.until_time}"
        parts = ["A cada hora" if r.interval == 1 else f"A cada {r.interval} horas", span] + [weekdays(r.weekdays)] * (len(set(r.weekdays)) < 7)
    elif r.frequency == "daily":
        parts = ["De segunda a sexta" if r.workdays_only else "Todos os dias" if r.interval == 1 else f"A cada {r.interval} dias", at]
    elif r.frequency == "weekly" and r.interval > 1:
        parts = [f"A cada {r.interval} semanas ({listed([SHORT[d] for d in (1, 2, 3, 4, 5, 6, 0) if d in r.weekdays])})", at]
    elif r.frequency == "weekly":
        one = r.weekdays[0]
        phrase = weekdays(r.weekdays)
        parts = [f"{'Toda' if 1 <= one <= 5 else 'Todo'} {DAYS[one]}" if len(r.weekdays) == 1 else phrase[0].upper() + phrase[1:], at]
    else:
        on = {"last-day": "no último dia", "weekday": f"n{'oa'[woman]} {ORDINAL[r.week_of_month]}{'oa'[woman]} {DAYS[r.weekday]}", "day": f"no dia {r.month_day}" + " (nos meses mais curtos, no último dia)" * (r.month_day > 28)}
        parts = ["Todo mês" if r.interval == 1 else f"A cada {r.interval} meses", on[r.monthly_mode], at]
    parts += [f"a partir de {day(r.start)}"] * (r.start > today)
    if r.end == "date":
        parts.append(f"até {day(r.end_date)}")
    if r.end == "count":
        parts.append("uma única vez" if r.count == 1 else f"{r.count} execuções no total")
    return ", ".join(parts)


def in_words(rules: DataFrame, today: dt.date) -> DataFrame:
    """rules (a table as operators.recurrence makes it) with words, the sentence of each."""
    clock = lambda m: f"{m // 60:02}:{m % 60:02}"

    @F.pandas_udf("string")
    def words(rows: pd.DataFrame) -> pd.Series:
        out = []
        for r in rows.itertuples(index=False):
            chosen = tuple(d for d in range(7) if r.weekdays >> d & 1)
            end, count = (None if pd.isna(x) else x for x in (r.end_date, r.count))
            own = Rule(r.frequency, r.start, clock(r.minute), r.interval, clock(r.until_minute), chosen, bool(r.workdays_only), r.monthly_mode, r.month_day, r.week_of_month, r.weekday, r.ending, end, None if count is None else int(count), r.zone)
            out.append(rule(own, today=today))
        return pd.Series(out, dtype=object)

    return rules.withColumn("words", words(F.struct(*(c for c in rules.columns if c != "rule"))))
