"""Columns that bring codes, days and numbers in foreign spellings to one form. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\r\n 　"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.btrim(column(c).cast("string"), F.lit(BLANKS))


def blank(c: Column | str) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(trimmed(c) == "", F.lit(True))


def market_code(c: Column | str, suffixes: tuple[str, ...] = ("SZ", "SH", "BJ")) -> Column:
    """``NNNNNN.XX`` in capitals, from any case, outer blanks and the prefixed form ``XXNNNNNN``; null where unreadable.

    A code in standard form, as nearly all are, costs one match.
    """
    raw, any_of = column(c).cast("string"), "|".join(suffixes)
    up = F.upper(trimmed(raw))
    return (
        F.when(raw.rlike(rf"^\d{{6}}\.({any_of})\z"), raw)
        .when(up.rlike(rf"^\d{{6}}\.({any_of})\z"), up)
        .when(up.rlike(rf"^({any_of})[.]?\d{{6}}\z"), F.concat(F.right(up, F.lit(6)), F.lit("."), F.left(up, F.lit(2))))
        .when(up.rlike(rf"^\d{{6}}({any_of})\z"), F.concat(F.left(up, F.lit(6)), F.lit("."), F.right(up, F.lit(2))))
    )


def index_code(c: Column | str) -> Column:
    """``NNNNNN.CSI`` in capitals, or null."""
    up = F.upper(trimmed(c))
    return F.when(up.rlike(r"^\d{6}\.CSI\z"), up)


EIGHT_DIGITS = r"^\d{8}\z"


def _day_of_digits(digits: Column) -> Column:
    """A DATE of eight digits; null where it isn't a real day. The year 0000 is none."""
    dashed = F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 2), F.lit("-"), F.substring(digits, 7, 2))
    return F.when(digits >= "0001", dashed.try_cast("date"))


def _digits_of_spelling(raw: Column) -> Column:
    text = trimmed(raw)
    return F.when(text.rlike(EIGHT_DIGITS), text).when(
        text.rlike(r"^\d{4}([-/.])\d{2}\1\d{2}\z"), F.concat(F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2))
    )


def real_day(c: Column | str) -> Column:
    """A DATE from ``YYYYMMDD`` or ``YYYY-MM-DD`` (also with ``/`` or ``.``); null where it isn't a real day.

    A year of two digits names no century and stays unreadable. A day in standard form, as nearly all are, costs one match.
    """
    raw = column(c).cast("string")
    return F.when(raw.rlike(EIGHT_DIGITS), _day_of_digits(raw)).otherwise(_day_of_digits(_digits_of_spelling(raw)))


def day_code(c: Column | str) -> Column:
    """``YYYYMMDD`` of a day in any readable spelling, null where it isn't a real day."""
    raw = column(c).cast("string")
    digits = _digits_of_spelling(raw)
    return F.when(raw.rlike(EIGHT_DIGITS), F.when(_day_of_digits(raw).isNotNull(), raw)).otherwise(F.when(_day_of_digits(digits).isNotNull(), digits))


def day_text(day: Column) -> Column:
    """``YYYYMMDD`` of a DATE."""
    return F.date_format(day, "yyyyMMdd")


def eight_digit_day(c: Column | str) -> Column:
    """True where the text as recorded is exactly eight digits of a real day."""
    c = column(c)
    return F.coalesce(c.rlike(EIGHT_DIGITS) & real_day(c).isNotNull(), F.lit(False))


def digits_of_number(c: Column | str) -> Column:
    """``1``, `` 1`` and ``1.0`` all come out as ``1``; null where it is no whole number."""
    number = trimmed(c).try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("bigint").cast("string"))


def effective_day(final: Column | str, first: Column | str) -> Column:
    """The day a report became known: the final announcement, or the first where that is null, empty or '0'."""
    return F.when(F.coalesce(trimmed(final).isin("", "0"), F.lit(True)), trimmed(first)).otherwise(trimmed(final))


def as_number(c: Column | str) -> Column:
    """A double without NaN: missing is null everywhere in the engine."""
    number = column(c).cast("double")
    return F.when(~F.isnan(number), number)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't use yet."""
    names, name = {x.lower() for x in df.columns}, stem
    while name.lower() in names:
        name += "_"
    return name


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"Column", "DataFrame", "F", "T", "annotations"}]
