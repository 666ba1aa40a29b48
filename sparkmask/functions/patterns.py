"""Shapes of personal data, and the tests that recognise masked output among them."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the sweep looks for, in order of report.  Digits are ASCII.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone-dashed": r"[0-9]{3}-[0-9]{3}-[0-9]{4}",
    "phone-parens": r"\([0-9]{3}\)\s*[0-9]{3}-[0-9]{4}",
    "phone-dotted": r"[0-9]{3}\.[0-9]{3}\.[0-9]{4}",
}
# How reports name the shapes and show them.
LABELS = {
    "email": ("email address", "name@example.com"),
    "ssn": ("Social Security number", "###-##-####"),
    "phone-dashed": ("phone number", "###-###-####"),
    "phone-parens": ("phone number", "(###) ###-####"),
    "phone-dotted": ("phone number", "###.###.####"),
}
#: Coarse tests that a store can apply first.  They miss a few values that the patterns find, such as a@b.co, so they
#: are used in compatible mode only.
PREFILTERS = {
    "email": r"(?s).@..*.\..",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone-dashed": r"[0-9]{3}-[0-9]{3}-[0-9]{4}",
    "phone-parens": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "phone-dotted": r"[0-9]{3}\.[0-9]{3}\.[0-9]{4}",
}
#: A character that each shape holds; looking for it first spares most values the pattern.
NEEDED = {"email": "@", "ssn": "-", "phone-dashed": "-", "phone-parens": "(", "phone-dotted": "."}
SCRAMBLED_CHARS = "[xX9]"
LETTERS_AND_DIGITS = r"[\p{L}\p{Nd}]"
WITH_KEY = r"(?s)^(.*)#[0-9-]+\z"
GENERATED_EMAIL = r"^fakeemail[0-9A-Za-z\-]+@notreal\.invalid\z"


def matches(value: Column, pattern: str) -> Column:
    """Whether the value holds the shape anywhere; false for null."""
    return F.coalesce(value.contains(NEEDED[pattern]) & value.rlike(PATTERNS[pattern]), F.lit(False))


def prefilter(value: Column) -> Column:
    """Whether any coarse test passes, as one predicate."""
    return F.coalesce(reduce(lambda a, b: a | b, [value.rlike(p) for p in PREFILTERS.values()]), F.lit(False))


def is_scrambled(value: Column) -> Column:
    """At least one of x, X and 9, and no other letter or decimal digit."""
    rest = F.regexp_replace(value, SCRAMBLED_CHARS, "")
    return F.coalesce(value.rlike(SCRAMBLED_CHARS) & ~rest.rlike(LETTERS_AND_DIGITS), F.lit(False))


def is_scrambled_with_key(value: Column) -> Column:
    """A scrambled part, then the last '#', then digits and hyphens."""
    return F.coalesce(value.rlike(WITH_KEY) & is_scrambled(F.regexp_extract(value, WITH_KEY, 1)), F.lit(False))


def is_generated_email(value: Column) -> Column:
    return F.coalesce(value.rlike(GENERATED_EMAIL), F.lit(False))


def is_known(value: Column, known: Iterable[str]) -> Column:
    """Exactly one of the constants that this run wrote."""
    known = sorted(set(known))
    return F.coalesce(value.isin(known), F.lit(False)) if known else F.lit(False)


def is_masked(value: Column, known: Iterable[str] = ()) -> Column:
    """Whether masking can have made the value; false for null."""
    return is_known(value, known) | is_scrambled(value) | is_scrambled_with_key(value) | is_generated_email(value)


def leaks(value: Column, pattern: str, known: Iterable[str] = (), compatible: bool = False) -> Column:
    """Whether the value still holds the shape and isn't masked output."""
    found = matches(value, pattern) & ~is_masked(value, known)
    return found & prefilter(value) if compatible else found
