"""Column-to-column cleaning helpers (all stay in whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0

# Inclusive integer age bands and their column names.
AGE_BANDS = (
    ("age_le25", 0, 25),
    ("age_26_35", 26, 35),
    ("age_36_45", 36, 45),
    ("age_46_55", 46, 55),
    ("age_56_65", 56, 65),
)
# Upper edges of the right-closed age intervals.
AGE_EDGES = (0, 25, 35, 45, 55, 65, 200)


def text_id(column: Column) -> Column:
    return column.cast("string")


def number_or_null(column: Column) -> Column:
    value = column.try_cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def number_or_zero(column: Column) -> Column:
    return F.coalesce(number_or_null(column), F.lit(0.0))


def timestamp_or_null(column: Column) -> Column:
    return column.try_cast("timestamp_ntz")


def timestamp_literal(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _micros_of_day(moment: Column) -> Column:
    seconds = F.extract(F.lit("SECOND"), moment).cast("double")
    return (F.hour(moment) * 3600 + F.minute(moment) * 60 + seconds) * F.lit(1_000_000.0)


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from start to end, on the wall clock.

    Calendar days and time of day are read apart because a plain timestamp
    difference passes through the session time zone and its clock changes.
    """
    days = F.date_diff(end, start).cast("double")
    return days + (F.round(_micros_of_day(end)) - F.round(_micros_of_day(start))) / F.lit(MICROS_PER_DAY)


def whole_days_between(start: Column, end: Column) -> Column:
    return F.floor(days_between(start, end)).cast("double")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top/bottom with a zero denominator giving null."""
    return top / F.nullif(bottom, F.lit(0.0))


def ratio_or_zero(top: Column, bottom: Column, digits: int) -> Column:
    return F.round(F.coalesce(safe_ratio(top, bottom), F.lit(0.0)), digits)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def age_valid(age: Column) -> Column:
    return F.coalesce(age.between(14, 100), F.lit(False))


def age_clean(age: Column) -> Column:
    return F.when(age_valid(age), age).otherwise(F.lit(-1.0))


def age_band_flags(age: Column) -> dict[str, Column]:
    flags = {name: flag(age.between(low, high)) for name, low, high in AGE_BANDS}
    flags["age_gt65"] = flag(age > 65)
    return flags


def right_closed_bin(value: Column, edges, labels, include_lowest: bool = False) -> Column:
    """Label of the interval ``(a, b]`` holding the value; null outside."""
    result = None
    for index, label in enumerate(labels):
        low, high = edges[index], edges[index + 1]
        above = value >= low if include_lowest and index == 0 else value > low
        inside = above & (value <= high)
        result = F.when(inside, F.lit(label)) if result is None else result.when(inside, F.lit(label))
    return result


def gender_flags(gender: Column) -> dict[str, Column]:
    code = F.upper(F.coalesce(gender, F.lit("U")))
    flags = {f"gender_{value}": flag(code == value) for value in ("F", "M", "U")}
    flags["gender_other"] = flag(~code.isin("F", "M", "U"))
    return flags


def gender_code(gender: Column) -> Column:
    return F.when(gender == "M", 1).when(gender == "F", 0).otherwise(-1).cast("int")


def joint_key(treatment: Column, target: Column) -> Column:
    return F.concat_ws(":", treatment.cast("string"), target.cast("string"))


def class_transform(target: Column, treatment: Column) -> Column:
    return (target == treatment).cast("int")


def hash_order(key: Column, seed) -> Column:
    """Seeded, uniform, engine-independent ordering text for a key."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def hash_uniform(key: Column, seed, digits: int = 7) -> Column:
    """Uniform [0, 1) number from the first hex digits of the seeded md5; 13 fill a double."""
    return F.conv(F.substring(hash_order(key, seed), 1, digits), 16, 10).cast("double") / F.lit(float(16**digits))


def rounded(column: Column, digits: int) -> Column:
    """The double times 10^digits, rounded half away from zero, over 10^digits, as DuckDB's ``round`` has it.

    ``F.round`` decides by the double's shortest decimal, so values on half of the last digit
    can fall to the other side.
    """
    scale = F.lit(10.0**digits)
    return F.round(column * scale) / scale


def short_hash(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)
