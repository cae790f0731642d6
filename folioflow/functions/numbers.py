"""Number, date and radix functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The roman numerals.
ROMANS = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
LAST_SERIAL = 2958465


def byte_label(n: Column) -> Column:
    """Bytes as ``512 B``, ``2.0 KB``, ``150 MB``: one decimal under 100, up to GB."""
    def scaled(power: int, unit: str) -> Column:
        v = n / float(1024**power)
        return F.when(v >= 100, F.format_string(f"%.0f {unit}", v)).otherwise(F.format_string(f"%.1f {unit}", v))

    small = F.concat(n.cast("string"), F.lit(" B"))
    return F.when(n < 1024, small).when(n < 1024**2, scaled(1, "KB")).when(n < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def column_letters(n: Column) -> Column:
    """1 as A, 26 as Z, 27 as AA; other than positive numbers as they are. Seven letters reach beyond any int."""
    digits = F.aggregate(
        F.sequence(F.lit(1), F.lit(7)),
        F.struct(n.cast("long").alias("v"), F.lit("").alias("s")),
        lambda a, _: F.struct(
            F.when(a["v"] > 0, F.floor((a["v"] - 1) / 26)).otherwise(a["v"]).cast("long").alias("v"),
            F.when(a["v"] > 0, F.concat(F.char((65 + F.pmod(a["v"] - 1, F.lit(26))).cast("int")), a["s"])).otherwise(a["s"]).alias("s"),
        ),
    )["s"]
    return F.when(n > 0, digits).otherwise(n.cast("string"))


def column_index(letters: Column) -> Column:
    """A as 0, Z as 25, AA as 26, whatever the case."""
    signs = F.filter(F.split(F.upper(letters), ""), lambda s: s != "")
    return F.aggregate(signs, F.lit(0).cast("long"), lambda a, s: a * 26 + F.ascii(s) - 64) - 1


def roman(n: Column) -> Column:
    """1 to 3999 in roman numerals, others in digits."""
    text, left = F.lit(""), n
    for value, sign in ROMANS:
        text = F.concat(text, F.repeat(F.lit(sign), F.floor(left / value).cast("int")))
        left = F.pmod(left, F.lit(value))
    return F.when((n > 0) & (n < 4000), text).otherwise(n.cast("string"))


def list_number(n: Column, level: Column) -> Column:
    """Running numbers by level: digits, small letters, small roman, and again."""
    kind = F.pmod(level, F.lit(3))
    return F.when(kind == 0, n.cast("string")).when(kind == 1, F.lower(column_letters(n))).otherwise(F.lower(roman(n)))


def serial_date(serial: Column, from_1904: bool = False) -> Column:
    """A spreadsheet's day number as a timestamp; null outside the calendar."""
    days = F.when(F.lit(from_1904), F.lit(-24107)).when(serial < 61, F.lit(-25568)).otherwise(F.lit(-25569))
    millis = days * F.lit(86_400_000).cast("long") + F.floor(serial * 86_400_000 + 0.5).cast("long")
    return F.when((serial >= 0) & (serial <= LAST_SERIAL), F.timestamp_millis(millis))


def is_numeric_text(c: Column) -> Column:
    return c.rlike(r"^-?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$")


def numeric_value(c: Column) -> Column:
    return F.when(is_numeric_text(c), F.replace(c, F.lit(","), F.lit("")).cast("double"))


def half(v: Column) -> Column:
    """Rounded to the nearest half, halves away from zero."""
    return F.round(v * 2) / 2


def progress_label(share: Column, minutes: Column) -> Column:
    left = F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), F.pmod(minutes, F.lit(60)).cast("string"), F.lit(" min")))
    return F.concat(F.floor(share * 100).cast("string"), F.lit("% · about "), left, F.lit(" left"))


def relative_date(ts: Column, now: Column) -> Column:
    """Today with the time, Yesterday, a weekday within the week and for later days, else the date."""
    days = F.datediff(now, ts)
    return (
        F.when(days == 0, F.concat(F.lit("Today, "), F.date_format(ts, "h:mm a")))
        .when(days == 1, F.lit("Yesterday"))
        .when(days < 7, F.date_format(ts, "EEEE"))
        .when(F.year(ts) == F.year(now), F.date_format(ts, "MMM d"))
        .otherwise(F.date_format(ts, "MMM d, y"))
    )


def thousands(v: Column, decimals: int) -> Column:
    """Fixed decimals with commas; halves are rounded up from the decimal form of the number."""
    return F.format_string(f"%,.{decimals}f", v)


def percent(v: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f%%", v * 100)
