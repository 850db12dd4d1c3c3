"""Display text: byte counts, durations, timestamps, fixed decimals, cut-offs.

The functions take a column or a SQL expression (best a plain column name). SQL expands
in place and stays inside generated code; a column is bound once through a lambda.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _apply(sql: Callable[[str], str], value: Column | str) -> Column:
    if isinstance(value, str):
        return F.expr(sql(value))
    return F.get(F.call_function("transform", F.array(value), F.expr(f"v -> {sql('v')}")), F.lit(0))


def bytes_sql(n: str) -> str:
    """Tenths are rounded half to even with integer shifts, so ties are exact."""
    steps = "".join(f" when abs({n}) < {1 << (10 * (p + 1))} then {p}" for p in range(1, len(BYTE_UNITS) - 1))
    power = f"(case{steps} else {len(BYTE_UNITS) - 1} end)"
    size, bits = f"cast(abs({n}) as bigint)", f"(10 * {power})"
    above = f"shiftright({size}, {bits})"
    rest = f"(10 * ({size} - shiftleft({above}, {bits})))"
    tenth = f"shiftright({rest}, {bits})"
    excess = f"(2 * ({rest} - shiftleft({tenth}, {bits})) - shiftleft(1L, {bits}))"
    tenths = f"(10 * {above} + {tenth} + case when {excess} > 0 or ({excess} = 0 and {tenth} % 2 = 1) then 1 else 0 end)"
    units = ", ".join(f"'{u}'" for u in BYTE_UNITS)
    scaled = f"format_string('%.1f %s', {tenths} / 10, element_at(array({units}), {power} + 1))"
    text = f"case when abs({n}) < 1024 then concat(cast(abs({n}) as bigint), ' B') else {scaled} end"
    return f"(case when {n} is null then '--' else concat(case when {n} < 0 then '-' else '' end, {text}) end)"


def duration_sql(ms: str) -> str:
    total = f"(cast(abs({ms}) as bigint) div 1000)"
    days, hours, minutes = f"({total} div 86400)", f"({total} % 86400 div 3600)", f"({total} % 3600 div 60)"
    parts = ", ".join(f"case when {n} > 0 then concat({n}, '{u}') end" for n, u in ((days, "d"), (hours, "h"), (minutes, "m")))
    seconds = f"case when {total} % 60 > 0 or {total} < 60 then concat({total} % 60, 's') end"
    sign = f"case when {ms} < 0 then '-' else '' end"
    return f"(case when {ms} is null then '--' when {ms} = 0 then '0s' else concat({sign}, concat_ws(' ', {parts}, {seconds})) end)"


def fixed_sql(value: str, digits: int) -> str:
    return f"format_string('%.{digits}f', bround(cast({value} as double), {digits}))"


def percent_sql(ratio: str) -> str:
    return f"concat({fixed_sql(f'({ratio}) * 100D', 0)}, '%')"


def format_bytes(n: Column | str) -> Column:
    """``1280`` -> ``1.2 KB``; whole bytes below 1 KB; null -> ``--``; sign kept in front."""
    return _apply(bytes_sql, n)


def format_duration(ms: Column | str) -> Column:
    """Milliseconds -> ``1d 2h 3m 4s`` without zero parts; null -> ``--``."""
    return _apply(duration_sql, ms)


def fixed(value: Column | str, digits: int) -> Column:
    """Fixed decimals, ties to even."""
    return _apply(lambda v: fixed_sql(v, digits), value)


def percent(ratio: Column | str) -> Column:
    return _apply(percent_sql, ratio)


def format_timestamp(ts: Column, as_of: Column) -> Column:
    """Clock time on the day of ``as_of``, else month, day and minute; null -> ``--``."""
    same_day = F.to_date(ts) == F.to_date(as_of)
    return (
        F.when(ts.isNull(), "--")
        .when(same_day, F.date_format(ts, "HH:mm:ss"))
        .otherwise(F.date_format(ts, "MMM dd HH:mm"))
    )


def ellipsis(text: str, limit: int) -> Column:
    """Column ``text`` cut to ``limit`` characters, the last three being dots."""
    return F.expr(f"case when length({text}) > {limit} then concat(substring({text}, 1, {limit - 3}), '...') else {text} end")
