"""Date functions. Dates stay strings, checked by range and not by calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two written forms of a date.
ISO = r"(?U)\b\d{4}-\d{2}-\d{2}\b"
DAY_FIRST = r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b"


def in_range(iso: Column) -> Column:
    """Year 1900 to 2100, month 1 to 12, day 1 to 31, of a YYYY-MM-DD text."""
    year, month, day = (iso.substr(a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    return year.between(1900, 2100) & month.between(1, 12) & day.between(1, 31)


def dates_in_text(text: Column) -> Column:
    """All dates of a text: ISO ones first, then day-month-year ones; duplicates stay."""
    iso = F.regexp_extract_all(text, F.lit(ISO), 0)

    def turned(hit: Column) -> Column:
        part = F.split(hit, "[/-]")
        return F.concat_ws("-", part[2], F.lpad(part[1], 2, "0"), F.lpad(part[0], 2, "0"))

    other = F.transform(F.regexp_extract_all(text, F.lit(DAY_FIRST), 0), turned)
    return F.coalesce(F.filter(F.concat(iso, other), lambda d: F.coalesce(in_range(d), F.lit(False))), F.array().cast("array<string>"))


def filename_date(name: Column) -> Column:
    """The first date in a file name, dashed before underscored before plain; unchecked, null without one."""
    plain = F.regexp_extract(name, r"\d{8}", 0)
    forms = (
        F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}", 0),
        F.replace(F.regexp_extract(name, r"\d{4}_\d{2}_\d{2}", 0), F.lit("_"), F.lit("-")),
        F.regexp_replace(plain, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    )
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in forms))


def normalize_date(text: Column) -> Column:
    """The first date of a field; null for an empty one and for 0000-00-00."""
    return F.when((text != "") & (text != "0000-00-00"), F.get(dates_in_text(text), F.lit(0)))
