"""Date expressions. "Today" is always the explicit argument `as_of`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAME = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|"
    "Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)


def _date(year: Column, month: Column, day: Column) -> Column:
    """Date of three numbers, NULL when there is no such day."""
    return F.try_to_date(
        F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"
    )


def _group(c: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract(c, pattern, index)


def _number(c: Column, pattern: str, index: int) -> Column:
    return _group(c, pattern, index).try_cast("int")


def _month(c: Column, pattern: str, index: int) -> Column:
    names = F.array(*[F.lit(m) for m in MONTHS])
    key = F.substring(F.lower(_group(c, pattern, index)), 1, 3)
    return F.array_position(names, key).cast("int")


def parse_date(c: Column) -> Column:
    """Date from ISO, day-first numeric (swapped when impossible) or month-name text."""
    text = F.trim(c)
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    numeric = r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})"
    day_first = rf"(?i)(\d{{1,2}})\s+({MONTH_NAME})\s*,?\s*(\d{{4}})"
    month_first = rf"(?i)({MONTH_NAME})\s+(\d{{1,2}})\s*,?\s*(\d{{4}})"
    a, b, year = (_number(text, numeric, i) for i in (1, 2, 3))
    return F.coalesce(
        F.when(
            text.rlike(iso),
            _date(_number(text, iso, 1), _number(text, iso, 2), _number(text, iso, 3)),
        ),
        F.when(text.rlike(numeric), F.coalesce(_date(year, b, a), _date(year, a, b))),
        F.when(
            text.rlike(day_first),
            _date(
                _number(text, day_first, 3), _month(text, day_first, 2), _number(text, day_first, 1)
            ),
        ),
        F.when(
            text.rlike(month_first),
            _date(
                _number(text, month_first, 3),
                _month(text, month_first, 1),
                _number(text, month_first, 2),
            ),
        ),
    )


def coerce_date(c: Column) -> Column:
    """Entity rule for dates: four whole-text formats in order, else NULL."""
    text = F.trim(c)
    forms = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy"]
    return F.coalesce(*[F.try_to_date(text, form) for form in forms])


def days_until(c: Column, as_of: Column) -> Column:
    return F.datediff(c, as_of)


def is_overdue(due: Column, is_done: Column, as_of: Column) -> Column:
    return F.coalesce(~is_done & (due < as_of), F.lit(False))


def within_days(c: Column, as_of: Column, days: int) -> Column:
    """Both ends of the window count; NULL dates do not."""
    return F.coalesce(c.between(as_of, F.date_add(as_of, days)), F.lit(False))
