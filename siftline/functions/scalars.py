"""Text, number and range helpers as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def begins_with(text: Column, prefix: str) -> Column:
    return F.startswith(text, F.lit(prefix))


def ends_with(text: Column, suffix: str) -> Column:
    return F.endswith(text, F.lit(suffix))


def common_prefix(a: Column, b: Column) -> Column:
    """The length of what two texts begin with alike."""
    least = F.least(F.length(a), F.length(b))
    return F.size(F.filter(F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>")), lambda n: F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n)))


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)


def strip_trailing(text: Column, char: str) -> Column:
    return F.rtrim(text, F.lit(char))


def prefix_up_to(text: Column, char: str) -> Column:
    """What comes before the first ``char``; all of it without one."""
    return F.substring_index(text, char, 1)


def suffix_from(text: Column, char: str) -> Column:
    """What comes after the first ``char``; nothing without one."""
    return F.when(F.contains(text, F.lit(char)), F.substr(text, F.instr(text, F.lit(char)) + len(char))).otherwise(F.lit(""))


def search(text: Column, part: str) -> Column:
    """The place of the first ``part``, from 0; -1 for none."""
    return F.instr(text, F.lit(part)) - 1


def search_last(text: Column, part: str) -> Column:
    """The place of the last ``part``, from 0; -1 for none."""
    return F.when(F.contains(text, F.lit(part)), F.length(text) - F.instr(F.reverse(text), F.lit(part[::-1])) - len(part) + 1).otherwise(F.lit(-1))


def divided(text: Column, char: str) -> Column:
    """What comes before and after the first ``char``."""
    return F.struct(prefix_up_to(text, char).alias("before"), suffix_from(text, char).alias("after"))


def split(text: Column, char: str) -> Column:
    """The parts between the ``char``, empty ones too."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, "\\Q" + char + "\\E", -1))


def is_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def is_blank(text: Column) -> Column:
    return text.rlike(r"^\s*$")


def as_unsigned(text: Column, bits: int = 32) -> Column:
    """The number that digits stand for; null for other texts and for what ``bits`` can't hold."""
    value = F.when(is_digits(text), text.try_cast("decimal(38,0)"))
    return F.when(value < F.lit(str(1 << bits)).cast("decimal(38,0)"), value)


def as_double(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"), F.trim(text).cast("double"))


def to_base(value: Column, base: int) -> Column:
    return F.lower(F.conv(value.cast("string"), 10, base))


def from_base(text: Column, base: int) -> Column:
    return F.conv(text, base, 10).cast("long")


def lowest_bit(value: Column) -> Column:
    """The number of the least bit that is set, from 0; -1 for none."""
    return F.when(value == 0, F.lit(-1)).otherwise(F.bit_count(value.bitwiseAND(-value) - F.lit(1)).cast("int"))


def size_repr(value: Column) -> Column:
    """Bytes as a number with two decimals of the largest unit that fits."""
    out = F.concat(value.cast("string"), F.lit("b"))
    for k, unit in enumerate(("kb", "mb", "gb", "tb"), 1):
        out = F.when(value >= F.lit(1 << 10 * k), F.concat(F.format_string("%.2f", value / F.lit(float(1 << 10 * k))), F.lit(unit))).otherwise(out)
    return out


def dotted(value: Column, sign: str = ",") -> Column:
    """Whole numbers with a sign between groups of three digits."""
    return F.replace(F.format_number(value, 0), F.lit(","), F.lit(sign))


def time_repr(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_seconds(seconds), pattern)


def overlaps(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Whether two ranges, without their ends, share a place."""
    return (a_start < b_stop) & (b_start < a_stop)


def intersection(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """What two ranges share; null for nothing."""
    both = F.struct(F.greatest(a_start, b_start).alias("start"), F.least(a_stop, b_stop).alias("stop"))
    return F.when(overlaps(a_start, a_stop, b_start, b_stop), both)
