import pytest
from pyspark.sql import functions as F

from sparkmask.functions import masking, names, patterns

SCRAMBLED = [
    ("Lovelace", "Xxxxxxxx"), ("ada", "xxx"), ("ADA", "XXX"), ("McDonald", "XxXxxxxx"), ("123-45-6789", "999-99-9999"), ("212-555-0100", "999-999-9999"),
    ("0", "9"), ("a.b-c_d e", "x.x-x_x x"), ("(212) 555-0100", "(999) 999-9999"), ("ada@example.invalid", "xxx@xxxxxxx.xxxxxxx"), ("éàü", "xxx"), ("ÉÀÜ", "XXX"),
    ("José", "Xxxxx"), ("李明", "xx"), ("שלום", "xxxx"), ("ǅ", "x"), ("٣٤", "99"), ("Ⅷ½²", "Ⅷ½²"), ("𝒜𠀀", "Xx"), ("", ""), (None, None), ("a\nB", "x\nX"),
]


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")


def ask(spark, values, expression):
    return [r["out"] for r in column(spark, values).select("id", expression(F.col("v")).alias("out")).orderBy("id").collect()]


def test_scramble(spark):
    assert ask(spark, [v for v, _ in SCRAMBLED], masking.scramble) == [w for _, w in SCRAMBLED]


def test_scramble_twice_is_once_and_keeps_length(spark):
    given = [v for v, _ in SCRAMBLED]
    once = ask(spark, given, masking.scramble)
    assert ask(spark, once, masking.scramble) == once
    assert [v and len(v) for v in given] == [v and len(v) for v in once]


@pytest.mark.parametrize(
    ("value", "keys", "out"),
    [("Lovelace", [42], "Xxxxx#42"), ("Li", [12345], "#12345"), ("alovelace", [1, 100], "xxx#1-100"), (None, [5], None), ("abc", [42], "#42"), ("abcd", [42], "x#42")],
)
def test_scramble_unique(spark, value, keys, out):
    df = spark.createDataFrame([(value, *keys)], "v string, " + ", ".join(f"k{i} int" for i in range(len(keys))))
    key = masking.discriminator([F.col(f"k{i}") for i in range(len(keys))])
    assert df.select(masking.scramble_unique(F.col("v"), key)).first()[0] == out


def test_scramble_unique_never_collides(spark):
    df = spark.range(1, 5001).select(F.col("id"), F.concat(F.lit("acct"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("v"))
    out = df.select(masking.scramble_unique(F.col("v"), F.col("id").cast("string")).alias("v"))
    assert out.distinct().count() == 5000
    assert out.where(~patterns.is_masked(F.col("v"))).count() == 0


def test_generated_email_ignores_the_value(spark):
    df = spark.createDataFrame([(15, None), (16, "x")], "k int, v string")
    assert [r[0] for r in df.select(masking.generated_email(F.col("k").cast("string"))).collect()] == ["fakeemail15@notreal.invalid", "fakeemail16@notreal.invalid"]


def test_uuid_key_loses_hyphens(spark):
    df = spark.createDataFrame([("00000000-0000-0000-0000-00000000000a", 7)], "u string, k int")
    assert df.select(masking.discriminator([F.col("u"), F.col("k")], [True, False])).first()[0] == "0" * 31 + "a-7"


CAUGHT = {
    "email": ["ada.lovelace@example.invalid", "Contact them at grace.hopper@example.invalid about it", "a@b.co"],
    "ssn": ["123-45-6789", "SSN on file: 234-56-7890."],
    "phone-dashed": ["212-555-0100", "Called from 212-555-0142 about enrollment."],
    "phone-parens": ["(212) 555-0100", "(212)555-0100"],
    "phone-dotted": ["212.555.0100"],
}
MISSED = ["Dev", "[redacted]", "2026-08-03", "12345", "", "2125550100", None]


@pytest.mark.parametrize("pattern", patterns.PATTERNS)
def test_patterns(spark, pattern):
    assert all(ask(spark, CAUGHT[pattern], lambda v: patterns.matches(v, pattern)))
    assert not any(ask(spark, MISSED, lambda v: patterns.matches(v, pattern)))


def test_prefilter_misses_what_the_patterns_find(spark):
    assert ask(spark, ["a@b.co", "(212)555-0100", "(212) 555-0100"], patterns.prefilter) == [False, False, True]
    assert ask(spark, ["a@b.co"], lambda v: patterns.leaks(v, "email")) == [True]
    assert ask(spark, ["a@b.co"], lambda v: patterns.leaks(v, "email", compatible=True)) == [False]


def test_masked_output_is_recognised(spark):
    yes = ["999-99-9999", "999-999-9999", "xxx@xxxxxxx.xxxxxxx", "Xxxxxxxx", "x", "Xxxxx#42", "xxx#1-100", "xxx#xx#-5", "fakeemail1@notreal.invalid", "fakeemail1-100@notreal.invalid", "Xxxx#", "dev@example.invalid"]
    no = [
        "123-45-6789", "212-555-0100", "999-99-9998", "xxx-xx-xxxy", "", None, "---", "()", "box 9", "Lovelace#42", "xxxx#alan", "#42", "#123-45-6789", "see fakeemail1@notreal.invalid",
        "fakeemaila.b@notreal.invalid", "dev@example.invalid.co", "see dev@example.invalid", "DEV@EXAMPLE.INVALID", "fakeemail1@notreal.invalid\n",
    ]
    assert all(ask(spark, yes, lambda v: patterns.is_masked(v, ["dev@example.invalid"])))
    assert not any(ask(spark, no, lambda v: patterns.is_masked(v, ["dev@example.invalid"])))
    assert ask(spark, ["dev@example.invalid"], patterns.is_masked) == [False]
    assert ask(spark, ["xxxx#", "4172"], patterns.is_scrambled_with_key) == [False, False]


STRONG = "SSN SSNLastFour DOB DateOfBirth PlaceOfBirth Email LoweredEmail HomePhone RegistrarFax MailingAddress MailingZip Password FirstName OtherLastNameUsed ContactMiddleName LastName LicenseNumber PhoneNumber".split()
NONE = (
    "KnownCapacity ShouldReceiveDisciplineNotificationEmails SendScoreTransferByFax SendCEDataByEmail UsePodEmailForLVNotifications AttachPhysicalFilesToCEEmail EmailType EmailTypeDescription EmailsId "
    "EmailSentLogId EmailSentDate AddressID AddressTypeID PasswordFormat LicenseStatusID LicenseType VeterinarianId CreatedUtc SortOrder ZipCode Address2 Emails"
).split() + [""]


def test_hints_on_both_sides(spark):
    given = STRONG + ["Name", "DisciplineNotes"] + NONE
    found = ask(spark, given, names.hint)
    assert [h and (h["strength"], h["kind"]) for h in found] == [names.describe(n) for n in given]
    assert [h and h["strength"] for h in found] == ["strong"] * len(STRONG) + ["weak"] * 2 + [None] * len(NONE)
    assert names.describe("DisciplineNotes")[1].startswith("free text")


@pytest.mark.parametrize(("name", "words"), [("MailingCity", ["mailing", "city"]), ("SSNLastFour", ["ssn", "last", "four"]), ("DOB", ["dob"]), ("mailing_city", ["mailing", "city"]), ("Address2", ["address2"])])
def test_words_of_names(spark, name, words):
    assert names.words_of(name) == words
    assert ask(spark, [name], names.tokens) == [words]


def test_random_names_give_the_same_words_on_both_sides(spark):
    import random

    rnd = random.Random(17)
    given = ["".join(rnd.choice("aAbBéÉß9_- .XyZıǅ٣") for _ in range(rnd.randrange(0, 12))) for _ in range(800)]
    assert ask(spark, given, names.tokens) == [names.words_of(n) for n in given]
