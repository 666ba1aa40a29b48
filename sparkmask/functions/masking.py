"""Masking strategies as column expressions; every one stays in the JVM."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What masked output looks like.
UPPER, LOWER, DIGIT = "X", "x", "9"
KEY_MARK = "#"
KEY_JOIN = "-"
EMAIL_BEFORE, EMAIL_AFTER = "fakeemail", "@notreal.invalid"

#: Unicode classes by what replaces their characters.  Upper case goes first, as the second class leaves it out.
CLASSES = ((r"\p{Lu}", UPPER), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Mn}\p{Mc}]", LOWER), (r"\p{Nd}", DIGIT))


def scramble(value: Column) -> Column:
    """Letters to X or x, decimal digits to 9, marks to x, everything else as it is.

    Null stays null and the number of code points stays the same.  Letters beyond the basic plane are replaced too.
    """
    for pattern, by in CLASSES:
        value = F.regexp_replace(value, pattern, by)
    return value


def discriminator(keys: Sequence[Column], uuid: Sequence[bool] | None = None) -> Column:
    """The key's values as text, joined by '-'; a UUID is 32 lower-case digits.  Null if a key is null."""
    parts = [F.lower(F.replace(k.cast("string"), F.lit("-"), F.lit(""))) if u else k.cast("string") for k, u in zip(keys, uuid or [False] * len(keys), strict=True)]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit(KEY_JOIN), p)
    return joined


def scramble_unique(value: Column, key: Column) -> Column:
    """The scrambled value with its end overwritten by '#' and the key; the mark and key alone if they don't fit."""
    masked, tail = scramble(value), F.concat(F.lit(KEY_MARK), key)
    fits = F.length(masked) > F.length(tail)
    return F.when(value.isNull(), F.lit(None)).when(fits, F.concat(F.left(masked, F.length(masked) - F.length(tail)), tail)).otherwise(tail)


def generated_email(key: Column) -> Column:
    """An address made of the key alone; rows whose value was null get one too."""
    return F.concat(F.lit(EMAIL_BEFORE), key, F.lit(EMAIL_AFTER))


def constant(value, data_type) -> Column:
    """The same value for every row, rows with null included; None masks to null."""
    return F.lit(value).cast(data_type)
