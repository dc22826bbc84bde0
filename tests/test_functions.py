"""Text and scalar functions against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import scalars, text
from newsloom.functions.taxonomy import pillar_of, scope_of
from newsloom.sources.adapters import DEMO


def one(spark, make, *values, kinds=None):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds or ["string"] * len(values)))
    return spark.createDataFrame([values], schema).select(make(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, expected",
    [
        (None, ""), ("", ""), ("<b>Hi</b>  there", "Hi there"), ("&amp;lt;b&amp;gt; x", "x"), ("a<!-- c\nd -->b", "a b"), ("<SCRIPT x>1\n2</script>y", "y"),
        ("– • Title —", "Title"), ("Body. Read more at example com. End", "Body. End"), ("cut [+1234 chars]", "cut"), ("(Reuters) - News", "News"), ("x &#999; y", "x y"), ("open <b", "open <b"),
    ],
)
def test_clean_markup(spark, given, expected):
    assert one(spark, text.clean_markup, given) == expected


@pytest.mark.parametrize("given, expected", [("BREAKING: Big  News!", "big news"), ("Just in: x", "x"), ("Привет", ""), (None, "")])
def test_normalise_title(spark, given, expected):
    assert one(spark, text.normalise_title, given) == expected


def test_truncate_and_sentences(spark):
    assert one(spark, lambda c: text.truncate_words(c, 2), "a b, c") == "a b…"
    assert one(spark, lambda c: text.truncate_words(c, 3), "a  b c") == "a  b c"
    assert one(spark, text.first_sentences, "Short. This one is long enough. And this one as well! Not this one here.") == "This one is long enough. And this one as well!"
    assert one(spark, text.word_count, " a\n b ") == 2


def test_restates_title(spark):
    assert one(spark, text.restates_title, "Big news today and more", "Big news today") is True
    assert one(spark, text.restates_title, "Today it was big they say news", "Big news today x") is True  # overlap of exactly 0.75
    assert one(spark, text.restates_title, "x", "short") is False
    assert one(spark, text.restates_title, "", "Some title here") is False


def test_fingerprint_ignores_case_and_marks(spark):
    assert one(spark, text.title_fingerprint, "Hello, World!") == one(spark, text.title_fingerprint, "hello world")


@pytest.mark.parametrize("seconds, expected", [(59, "59s"), (60, "1m"), (3599, "59m"), (3600, "1h"), (3660, "1h 1m")])
def test_duration(spark, seconds, expected):
    assert one(spark, scalars.duration_text, seconds, kinds=["long"]) == expected


def test_recency(spark):
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    value = lambda t: one(spark, lambda c: scalars.recency(c.cast("timestamp_ntz"), at), t)
    assert value("2024-01-31 00:00:00") == 1.0
    assert value(None) == 0.5
    assert value("2024-01-31 05:00:00") == 0.5
    assert value("2024-01-31 03:00:00") < 0


def test_tags(spark):
    assert one(spark, scalars.parsed_tags, "[bad") == []
    assert one(spark, lambda c: scalars.merged_tags(scalars.parsed_tags(c), F.lit(["b", "z"]), 3), '["a", "b", "a"]') == ["a", "b", "z"]


def test_classes(spark):
    assert one(spark, lambda a, b: pillar_of(a, b, DEMO), "x", "the minister and the market of license") == 1
    assert one(spark, lambda a, b: pillar_of(a, b, DEMO), "qq goal", "qq") == 9
    assert one(spark, lambda a, b: pillar_of(a, b, DEMO), None, None) == 1
    assert one(spark, lambda a, b: scope_of(a, b, DEMO), "the", "ing ung") == "local"


def test_a_text_is_looked_through_for_what_may_be_in_it_only(spark):
    """What one removal brings together, a later one still removes; texts without any of it stay."""
    given = ["READ<i>more at x. b", "a [<b>image 3] b", "(<b></b>AP) - x (AP) - y", "&amp;lt;b> c", "a &amp;amp; b", "no mark at all", "[\n] é • "]
    assert [one(spark, text.clean_markup, t) for t in given] == ["b", "a [ image 3] b", "( AP) - x y", "c", "a &amp; b", "no mark at all", "é"]


def test_opening_is_that_of_the_first_sentence(spark):
    for given in ("  One. Two", "x" * 200, "x" * 79 + ". y", "x" * 80 + " \n", " " * 3000 + "a b. c", "", "a" * 40 + "! " + "b" * 90):
        first = one(spark, text.sentences, given)[0][:80]
        assert one(spark, text.opening, given) == first
    assert one(spark, text.opening, None) == ""
