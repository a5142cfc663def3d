"""Cell conversion for workbook text.

Cells arrive as text. ``strict_*`` read the whole cell, ``leading_*`` only its numeric prefix.

Most cells are plain: digits (with spaces around or not), a day, text without outer blanks. These are told by a cheap test and
read by compiled expressions. Any other cell goes the general way, where intermediate results are held by a function over one
value (``_once``): as plain nested expressions they would be computed again at each mention. Both ways give the same; a row's
conversions hold such functions, so that Spark compiles them in parts, and not as one method that the JVM leaves to its interpreter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Number grammar of a cell prefix and of a whole cell, the white space a trim removes, date forms.
NUMBER_PREFIX = r"^[\s\u00a0\ufeff\u2028\u2029\p{Zs}]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
HEX_NUMBER = r"^0[xX][0-9a-fA-F]{1,15}$"
BLANK = r"[\s\u00a0\ufeff\u2028\u2029\p{Zs}]"
OUTER_SPACE = rf"^{BLANK}+|{BLANK}+$"
TIDY = r"^[!-~](?:[ -~]*[!-~])?\z"
ZONED_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}:?\d{2})$"
US_DAY = r"^\d{1,2}/\d{1,2}/\d{4}$"
ISO_DAY = r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"
PLAIN_NUMBER = r"^ *[+-]?[0-9]{1,300}(?:[.][0-9]{0,300})? *\z"  # casts pass over the spaces
PLAIN_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _tidied(cell: Column) -> Column:
    """``trimmed`` of a cell that costs nothing to mention; plain cells are told by one pass over them."""
    return F.when(cell.rlike(TIDY), cell).otherwise(F.regexp_replace(cell, OUTER_SPACE, ""))


def _outer_plain(cell: Column) -> Column:
    """Whether a cell surely begins and ends with a printable ASCII character, whatever stands between."""
    last = F.substring(cell, -1, 1)
    return (cell >= "!") & (cell < "\x7f") & (last >= "!") & (last < "\x7f")


def _trimmed_once(cell: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.transform(F.array(cell.cast("string")), _tidied), use), F.lit(0))


def trimmed(cell: Column) -> Column:
    """Outer white space of any kind removed."""
    return F.regexp_replace(cell, OUTER_SPACE, "")


def to_text(cell: Column) -> Column:
    """Trimmed text; an empty cell is NULL."""
    cell = cell.cast("string")
    slow = _trimmed_once(cell, lambda text: F.when(text != "", text))
    return F.when(cell.isNull() | _outer_plain(cell), cell).otherwise(slow)


def _whole_number(cell: Column) -> Column:
    """The whole cell as a finite number, decimal or hexadecimal; NULL for anything else."""
    def read(text: Column) -> Column:
        finite = _once(F.when(text.rlike(NUMBER), text).try_cast("double"), lambda x: F.when(F.abs(x) < float("inf"), x))
        return F.coalesce(finite, F.when(text.rlike(HEX_NUMBER), F.conv(F.substring(text, 3, 16), 16, 10).try_cast("double")))
    cell = cell.cast("string")
    return F.when(cell.rlike(PLAIN_NUMBER), cell.try_cast("double")).when(cell.isNotNull(), _trimmed_once(cell, read))


def strict_number(cell: Column, default: float = 0.0) -> Column:
    """The whole cell as a number; empty, not numeric or not finite gives ``default``."""
    return F.coalesce(_whole_number(cell), F.lit(float(default)))


def strict_integer(cell: Column, default: int = 0) -> Column:
    """``strict_number`` rounded to a whole number, halves towards plus infinity."""
    return F.floor(strict_number(cell, default) + F.lit(0.5))


def number_prefix(cell: Column) -> Column:
    """The text of the leading number, '0' if there is none."""
    found = F.regexp_extract(F.coalesce(cell, F.lit("")), NUMBER_PREFIX, 1)
    return _once(found, lambda text: F.when(text == "", F.lit("0")).otherwise(text))


def leading_number(cell: Column) -> Column:
    """The leading number of a cell, ``'12abc'`` -> 12; 0 if there is none."""
    return number_prefix(cell).cast("double")


def leading_money(cell: Column) -> Column:
    """``leading_number`` as an exact amount; NULL only if it does not fit the amount type."""
    amount = "decimal(18,4)"
    cell = cell.cast("string")
    plain = F.when(cell.isNull(), F.lit(0).cast(amount)).when(cell.rlike(PLAIN_NUMBER), cell.try_cast(amount))
    return plain.otherwise(number_prefix(cell).try_cast(amount))


def formula_number(result: Column, value: Column) -> Column:
    """A formula cell: its result, or its value where the result is empty or zero."""
    no_result = to_text(result).isNull() | (_whole_number(result) == 0)
    return leading_number(F.when(no_result, value).otherwise(result))


def whole_number(cell: Column) -> Column:
    """An integer column's cell; NULL when blank or not an integer."""
    cell = cell.cast("string")
    slow = _trimmed_once(cell, lambda text: text.try_cast("int"))
    return F.when(cell.rlike(PLAIN_NUMBER), cell.try_cast("int")).when(cell.isNotNull(), slow)


def to_day(cell: Column) -> Column:
    """The calendar day in UTC, NULL for anything unreadable.

    ISO dates and date-times and month/day/year are read. A time with an offset is moved to
    UTC first.
    """
    def read(text: Column) -> Column:
        utc = F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("date")
        return (
            F.when(text.rlike(ZONED_TIME), utc)
            .when(text.rlike(US_DAY), F.try_to_date(text, "M/d/yyyy"))
            .when(text.rlike(ISO_DAY), F.substring(text, 1, 10).try_cast("date"))
        )
    cell = cell.cast("string")
    return F.when(cell.rlike(PLAIN_DAY), cell.try_cast("date")).when(cell.isNotNull(), _trimmed_once(cell, read))
