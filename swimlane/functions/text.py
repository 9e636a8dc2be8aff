"""Names, labels and keys as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAME = r"(\d{2})_(\d+)dpf_([^_]+)_(\p{L}{3})_(\d{2})_(\p{L}{3})_(\d{4})_(\d{2})h(\d{2})min(\d{2})sec(?:_([^.]+))?"
NAME_FIELDS = "fish_id age line weekday day month year hour minute second extra".split()
_TEXT = {"line", "weekday", "month", "extra"}
#: Months by the first letters of their English and German names.
_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "mär": 3, "mae": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12}


def name_pattern(prefix: str = "", extension: str | None = None) -> str:
    """The whole-name pattern of one kind of file."""
    quote = lambda s: r"\Q" + s + r"\E" if s else ""
    return f"^{quote(prefix)}{NAME}" + (rf"\.{quote(extension)}$" if extension is not None else "")


def parse_name(name: Column, pattern: str = "^" + NAME) -> Column:
    """A struct of the name's fields; NULL where the name does not fit."""
    fields = []
    for n, f in enumerate(NAME_FIELDS, 1):
        part = F.regexp_extract(name, pattern, n)
        fields.append((F.nullif(part, F.lit("")) if f in _TEXT else part.cast("int")).alias(f))
    return F.when(name.rlike(pattern), F.struct(*fields))


def month_number(month: Column) -> Column:
    key = F.substring(F.lower(F.trim(month)), 1, 3)
    return F.create_map(*(F.lit(x) for pair in _MONTHS.items() for x in pair))[key]


def name_time(n: Column) -> Column:
    """The name's date and time; NULL for a month that is none."""
    return F.try_make_timestamp_ntz(n["year"], month_number(n["month"]), n["day"], n["hour"], n["minute"], n["second"])


def day_label(n: Column) -> Column:
    return F.concat_ws(".", n["day"].cast("string"), n["month"], n["year"].cast("string"))


def list_key(c: Column, digits: int | None = None) -> Column:
    """An array of numbers as text, ``[0.1, 0.2]``; rounded first if digits are given."""
    c = c if digits is None else F.transform(c, lambda x: F.round(x, digits))
    return c.cast("string")


def interaction(*parts: Column) -> Column:
    """The parts joined by `` | ``; NULL if one of them is."""
    missing = F.lit(False)
    for p in parts:
        missing = missing | p.isNull()
    return F.when(~missing, F.concat_ws(" | ", *(p.cast("string") for p in parts)))


def stars(p: Column) -> Column:
    """A p-value as asterisks, ``ns`` from 0.05 on."""
    return F.when(p < 1e-4, "****").when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 0.05, "*").otherwise("ns")


def element(c: Column, i: int, default=None) -> Column:
    """Array element i from 0, or the default."""
    return F.coalesce(F.try_element_at(c, F.lit(i + 1)), F.lit(default))


def term_name(term: Column, prefix: str) -> Column:
    """A model term without its prefix; NULL where it has another."""
    return F.when(term.startswith(prefix), F.substring(term, F.lit(len(prefix) + 1), F.length(term)))
