"""Scalar functions: text, dates, amounts, missing and infinite values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .safe import c, day_number, epoch_seconds, ratio

# -- text ---------------------------------------------------------------------


def part(value: str | Column, sep: str, i: int) -> Column:
    """i-th piece (from 0) of a split; NULL when there is none."""
    return F.get(F.split(c(value), sep), i)


def first_token(value: str | Column) -> Column:
    return part(value, " ", 0)


def letters_only(value: str | Column) -> Column:
    return F.regexp_replace(c(value), r"[^\p{L}]", "")


def digits_only(value: str | Column) -> Column:
    return F.regexp_replace(c(value), r"[^\p{N}]", "")


def domain_prefix(domain: str | Column) -> Column:
    return part(F.coalesce(c(domain), F.lit("#")), r"\.", 0)


def domain_suffix(domain: str | Column, us: Sequence[str] = ("gmail", "net", "edu")) -> Column:
    """Last label of a domain; the US-only endings collapse to ``us``."""
    last = F.element_at(F.split(F.coalesce(c(domain), F.lit("nan")), r"\."), -1)
    return F.when(last.isin(*us), F.lit("us")).otherwise(last)


def size_pair(value: str | Column) -> tuple[Column, Column]:
    """Width and height of a ``WxH`` text."""
    p = [F.get(F.split(c(value), "x"), i).try_cast("double") for i in (0, 1)]
    return p[0], p[1]


def screen_columns(value: str | Column) -> list[Column]:
    w, h = size_pair(value)
    w, h = F.coalesce(w, F.lit(-1.0)), F.coalesce(h, F.lit(-1.0))
    return [
        w.alias("screen_width"),
        h.alias("screen_height"),
        (h > w).cast("int").alias("screen_type"),
        F.bround(ratio(h, w, 10), 2).alias("screen_ratio"),
    ]


def token_sentence(cols: Sequence[str], sep: str = " ") -> Column:
    """``col_value`` words of one row; a missing value prints as ``nan``."""
    return F.concat_ws(sep, *[F.concat(F.lit(f"{n}_"), F.coalesce(c(n).cast("string"), F.lit("nan"))) for n in cols])


# -- time ---------------------------------------------------------------------


def offset_to_timestamp(offset: str | Column, start: str, shift_seconds: int = -14400) -> Column:
    """Event time from a second offset; the shift is the local clock."""
    secs = c(offset).cast("long") + shift_seconds
    return F.timestamp_add("SECOND", secs, F.lit(start).cast("timestamp_ntz"))


def date_parts(ts: str | Column, base_year: int) -> list[Column]:
    """Calendar parts and running month, week and day numbers since ``base_year``."""
    t = c(ts)
    y = F.year(t)
    return [
        y.alias("year"),
        F.month(t).alias("month"),
        F.weekofyear(t).alias("week"),
        F.dayofyear(t).alias("day_of_year"),
        F.weekday(t).alias("day_week"),
        F.hour(t).alias("hour"),
        F.day(t).alias("day"),
        ((y - base_year) * 12 + F.month(t)).alias("dt_m"),
        ((y - base_year) * 52 + F.weekofyear(t)).alias("dt_w"),
        ((y - base_year) * 365 + F.dayofyear(t)).alias("dt_d"),
        (F.month(t) == 12).cast("int").alias("is_december"),
    ]


def half_hour(offset: str | Column) -> Column:
    """Hour of day in half-hour steps from raw seconds; the day fraction is cut to two digits first."""
    hundredths = F.floor(c(offset) * 100 / 86400)
    return F.floor(F.pmod(hundredths, F.lit(100)) * 48 / 100) / 2


# Upper bounds and names of the day zones.
DAY_ZONES = [
    (3.0, "0.0-3.0"),
    (6.0, "3.5-6.0"),
    (10.0, "6.5-10.0"),
    (17.0, "10.5-17.0"),
    (21.5, "17.5-21.5"),
]


def day_zone(half_hours: str | Column) -> Column:
    h = c(half_hours)
    out = None
    for top, name in DAY_ZONES:
        out = F.when(h <= top, F.lit(name)) if out is None else out.when(h <= top, F.lit(name))
    return out.otherwise(F.lit("22.0-23.5"))


def seconds_parts(offset: str | Column) -> list[Column]:
    """Day number, weekday number and hour from raw seconds."""
    s = c(offset).cast("long")
    day = F.floor(s / 86400)
    return [
        day.alias("day_no"),
        F.pmod(day, F.lit(7)).alias("dow_no"),
        F.pmod(F.floor(s / 3600), F.lit(24)).alias("hour_no"),
    ]


def add_days(d: str | Column, n: int | Column) -> Column:
    return F.date_add(c(d).cast("date"), n)


def add_hours(ts: str | Column, n: int | Column) -> Column:
    return F.timestamp_add("HOUR", F.lit(n) if isinstance(n, int) else n, c(ts))


def days_between(end: str | Column, start: str | Column) -> Column:
    return F.datediff(c(end), c(start))


def registration_date(ts: str | Column, age_days: str | Column) -> Column:
    """Event date minus the account age; the event date where the age is missing."""
    age = F.coalesce(c(age_days).cast("int"), F.lit(0))
    return F.date_sub(c(ts).cast("date"), age)


def whole_days(end: str | Column, start: str | Column) -> Column:
    """Whole days from ``start`` to ``end``, rounded down."""
    return F.floor((epoch_seconds(end) - epoch_seconds(start)) / 86400)


def _nth_weekday(y: Column, month: int, weekday: int, nth: int) -> Column:
    """Date of the nth weekday (Monday is 0) of a month."""
    first = F.make_date(y, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (nth - 1))


def _observed(y: Column, month: int, day: int) -> Column:
    """A fixed-date holiday moves to Friday or Monday from a weekend."""
    d = F.make_date(y, F.lit(month), F.lit(day))
    return F.date_add(d, F.when(F.weekday(d) == 5, -1).when(F.weekday(d) == 6, 1).otherwise(0))


def is_us_holiday(ts: str | Column) -> Column:
    """1 on a US federal holiday (ten holidays, observed dates), by rule instead of a table."""
    d = c(ts).cast("date")
    y = F.year(d)
    last_monday_may = F.date_sub(F.make_date(y, F.lit(5), F.lit(31)), F.weekday(F.make_date(y, F.lit(5), F.lit(31))))
    days = [
        _observed(y, 1, 1),
        _observed(y + 1, 1, 1),  # New Year on a Saturday is observed on 31 December
        _nth_weekday(y, 1, 0, 3),
        _nth_weekday(y, 2, 0, 3),
        last_monday_may,
        _observed(y, 7, 4),
        _nth_weekday(y, 9, 0, 1),
        _nth_weekday(y, 10, 0, 2),
        _observed(y, 11, 11),
        _nth_weekday(y, 11, 3, 4),
        _observed(y, 12, 25),
    ]
    return d.isin(*days).cast("int")


# -- amounts ------------------------------------------------------------------


def cents(x: str | Column) -> Column:
    return F.bround(c(x) - F.floor(c(x)), 2)


def amount_modulo(x: str | Column, n: int) -> Column:
    return F.pmod(c(x).cast("long"), F.lit(n))


def decimal_digits(x: str | Column, scale: int = 1000) -> Column:
    return ((c(x) - c(x).cast("long")) * scale).cast("long")


def round_even(x: str | Column, n: int = 0) -> Column:
    return F.bround(c(x), n)


def round_digits(value: str | Column, top: str | Column, bottom: str | Column) -> Column:
    """How many digits to keep: wide ranges keep none, short decimals two, long ones three.

    Numbers are read as printed, so the last digit counts.
    """
    v = c(value)
    whole = F.length(v.cast("long").cast("string"))
    printed = F.regexp_replace(v.cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
    decimals = F.length(printed) - whole - 1
    span = (c(top) - c(bottom)).cast("long")
    many = F.when(printed.endswith("0"), F.when(span > 10, 0).otherwise(2)).otherwise(1)
    return F.when(whole > 1, many).otherwise(F.when(decimals > 3, 3).otherwise(2))


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (1 + F.exp(-c(x)))


def log_odds(p: str | Column) -> Column:
    return F.ln(ratio(p, F.lit(1) - c(p)))


# -- missing and infinite -------------------------------------------------------


def missing_flag(x: str | Column) -> Column:
    return c(x).isNull().cast("int")


def fill_values(df: DataFrame, constants: Mapping[str, object] = {}, means: Sequence[str] = ()) -> DataFrame:
    """Fill with constants and with column means; all means come from one aggregate."""
    out = df
    if means:
        stats = df.agg(F.struct(*[F.avg(m).alias(m) for m in means]).alias("s"))
        out = out.withColumn("_s", stats.scalar())
        out = out.withColumns({m: F.coalesce(c(m).cast("double"), F.col(f"_s.{m}")) for m in means}).drop("_s")
    return out.withColumns({k: F.coalesce(c(k), F.lit(v)) for k, v in constants.items()}) if constants else out


def replace_inf(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """+inf becomes the column's largest finite value, -inf the smallest."""
    inf = float("inf")
    aggs = []
    for x in cols:
        finite = F.when(~F.isnan(x) & (c(x) < inf) & (c(x) > -inf), c(x))
        aggs += [F.max(finite).alias(f"{x}_hi"), F.min(finite).alias(f"{x}_lo")]
    out = df.withColumn("_s", df.agg(F.struct(*aggs).alias("s")).scalar())
    return out.withColumns(
        {
            x: F.when(c(x) == inf, F.col(f"_s.{x}_hi")).when(c(x) == -inf, F.col(f"_s.{x}_lo")).otherwise(c(x))
            for x in cols
        }
    ).drop("_s")


def day_age(ts: str | Column, released: str | Column) -> Column:
    return day_number(ts) - day_number(released)
