"""Hints from column names: which columns sound like personal data."""

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words by what they say about a column, in order of decision.
SETTING_FIRST = "should send use is has can allow enable receive prefer attach include display show require auto".split()
NUMBER_OF = {
    "license": "professional license number",
    "licence": "professional license number",
    "account": "account number",
    "card": "payment card number",
}
ABOUT_THE_RECORD = "id ids type types count flag status code sent log key sequence sort order version format".split()
STRONG = {
    "ssn": "Social Security number",
    "dob": "date of birth",
    "birth": "birth details",
    "birthdate": "date of birth",
    "email": "email address",
    "phone": "phone number",
    "telephone": "phone number",
    "fax": "fax number",
    "address": "postal or email address",
    "street": "street address",
    "zip": "postal code",
    "postcode": "postal code",
    "password": "credential",
    "pwd": "credential",
    "passport": "identity document",
}
NAME_QUALIFIERS = "first last middle full maiden preferred given sur legal".split()
PERSON = "a person's name"
WEAK = {
    "name": "may be a person's name",
    "city": "part of an address",
    "county": "part of an address",
    "note": "free text \u2014 may contain anything",
    "notes": "free text \u2014 may contain anything",
    "comment": "free text \u2014 may contain anything",
    "comments": "free text \u2014 may contain anything",
    "remarks": "free text \u2014 may contain anything",
    "memo": "free text \u2014 may contain anything",
    "gender": "personal characteristic",
    "race": "personal characteristic",
    "ethnicity": "personal characteristic",
}


def tokens(name: Column) -> Column:
    """Words of a camel-case or snake-case name, lower-cased."""
    spaced = F.regexp_replace(name, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([\p{L}\p{Nd}])(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def hint(name: Column) -> Column:
    """struct(strength, kind) of a column name; null where nothing points to personal data."""
    t = tokens(name)

    def within(words) -> Column:
        return F.arrays_overlap(t, F.array(*[F.lit(w) for w in words]))

    def first(kinds: dict[str, str]) -> Column:
        found = F.filter(t, lambda w: w.isin(*kinds))
        return F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.element_at(found, 1)]

    def say(strength: str, kind: Column) -> Column:
        return F.struct(F.lit(strength).alias("strength"), kind.alias("kind"))

    nothing = F.lit(None).cast("struct<strength:string,kind:string>")
    return (
        F.when(F.size(t) == 0, nothing)
        .when(F.element_at(t, 1).isin(*SETTING_FIRST), nothing)
        .when(F.array_contains(t, "number") & within(NUMBER_OF), say("strong", numbered(t)))
        .when(within(ABOUT_THE_RECORD), nothing)
        .when(within(STRONG), say("strong", first(STRONG)))
        .when(F.array_contains(t, "name") & within(NAME_QUALIFIERS), say("strong", F.lit(PERSON)))
        .when(within(WEAK), say("weak", first(WEAK)))
        .otherwise(nothing)
    )


def numbered(t: Column) -> Column:
    """What the number in a name counts; the first of NUMBER_OF that the name holds."""
    return F.coalesce(*[F.when(F.array_contains(t, w), F.lit(kind)) for w, kind in NUMBER_OF.items()])


def words_of(name: str) -> list[str]:
    """tokens() for the driver."""
    out, previous = [""], ""
    for i, c in enumerate(name):
        if not (unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"):
            out.append("")
        else:
            following = name[i + 1 : i + 2]
            starts = unicodedata.category(c) == "Lu" and previous and (
                unicodedata.category(previous) in ("Ll", "Nd")
                or (unicodedata.category(previous)[0] == "L" and bool(following) and unicodedata.category(following) == "Ll")
            )
            out[-1:] = [out[-1], c] if starts else [out[-1] + c]
        previous = c if re.match(r"\w", c) and c != "_" else ""
    return [w.lower() for w in out if w]


def describe(name: str) -> tuple[str, str] | None:
    """hint() for the driver: (strength, kind) or None."""
    t = words_of(name)
    if not t or t[0] in SETTING_FIRST:
        return None
    if "number" in t:
        for w, kind in NUMBER_OF.items():
            if w in t:
                return "strong", kind
    if any(w in ABOUT_THE_RECORD for w in t):
        return None
    for w in t:
        if w in STRONG:
            return "strong", STRONG[w]
    if "name" in t and any(w in NAME_QUALIFIERS for w in t):
        return "strong", PERSON
    for w in t:
        if w in WEAK:
            return "weak", WEAK[w]
    return None
