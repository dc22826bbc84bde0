"""Text functions: Column in, Column out. A null text counts as empty unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities in the order in which they are decoded, and boilerplate in the order in which it is removed.
ENTITIES = [
    ("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"),
    ("&#39;", "'"), ("&apos;", "'"), ("&rsquo;", "'"), ("&lsquo;", "'"),
    ("&rdquo;", '"'), ("&ldquo;", '"'), ("&ndash;", "-"), ("&mdash;", "—"),
    ("&hellip;", "..."), ("&#8217;", "'"), ("&#8216;", "'"), ("&#8220;", '"'),
    ("&#8221;", '"'), ("&#8211;", "-"), ("&#8212;", "—"),
]
BOILERPLATE = [
    "(?s)<!--.*?-->", "(?si)<script[^>]*>.*?</script>", "(?si)<style[^>]*>.*?</style>", "<[^>]+>",
    r"(?i)read more at\s+[^.\n]*\.?", r"(?i)continue reading[^.\n]*\.?", r"(?i)click here to\s+[^.\n]*\.?",
    r"(?i)copyright\s*©?\s*\d{4}[^.\n]*\.?", r"(?i)all rights reserved[^.\n]*\.?", r"(?i)follow us on\s+[^.\n]*\.?",
    r"(?i)subscribe to\s+[^.\n]*\.?", r"(?i)the post .+? appeared first on .+?\.", r"(?i)this article (?:originally|first) appeared on [^.\n]+\.?",
    r"(?i)\[image[^\]]*\]", r"(?i)\[video[^\]]*\]", r"(?i)\[\+\d+\s*chars?\]", r"\[+\s*\]+",
    r"(?i)\(reuters\)\s*[-–]?\s*", r"(?i)\(ap\)\s*[-–]?\s*", r"(?i)\(afp\)\s*[-–]?\s*", r"(?i)\(pti\)\s*[-–]?\s*", r"(?i)\(ians\)\s*[-–]?\s*",
]
#: Stretches of BOILERPLATE whose patterns all need the character, and one of the phrases if there are any (in lower case).
NEEDED = [
    (slice(0, 4), "<", ()),
    (slice(4, 13), "", ("read more at", "continue reading", "click here to", "copyright", "all rights reserved", "follow us on", "subscribe to", "appeared first on", "appeared on")),
    (slice(13, 17), "[", ()),
    (slice(17, 22), "(", ("(reuters)", "(ap)", "(afp)", "(pti)", "(ians)")),
]
#: What strip() takes for white space, and what clean_markup() takes off the ends (EDGES, once stretches are single spaces).
SPACE, EDGE_CHARACTERS = " \t\n\x0b\f\r", " -–—•*"
EDGES = r"^[\s\-–—•*]+|[\s\-–—•*]+$"
NEWS_PREFIX = r"^(breaking|update|updated|watch|exclusive|live|just in|news):\s*"
SENTENCE_END = r"(?<=[.!?])\s+"
CUT_ENDING = ",.;:"
ELLIPSIS = "…"


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(text, F.lit(SPACE))


def squeeze(text: Column) -> Column:
    """Each stretch of white space one space, none at the ends. Single spaces are not replaced by themselves."""
    return F.btrim(F.regexp_replace(text, r"[\t\n\x0B\f\r]\s*| \s+", " "), F.lit(" "))


def decode_entities(text: Column) -> Column:
    """Named and numeric entities replaced one after the other; other numeric ones become a space."""

    def decoded(given: Column) -> Column:
        out = given
        for entity, character in ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(character))
        return F.when(F.contains(given, F.lit("&")), F.regexp_replace(out, r"&#\d+;", " ")).otherwise(given)

    return bound(_or_empty(text), decoded)


def _without(patterns: slice, character: str, phrases: tuple[str, ...]) -> Callable[[Column], Column]:
    """Removes these of BOILERPLATE. A text that has nothing of what all of them need is looked through once and stays as it is."""

    def removed(given: Column) -> Column:
        out = given
        for pattern in BOILERPLATE[patterns]:
            out = F.regexp_replace(out, pattern, " ")
        needed = F.contains(given, F.lit(character)) if character else F.lit(True)
        if phrases:
            needed = needed & bound(F.lower(given), lambda lowered: F.exists(F.lit(list(phrases)), lambda p: F.contains(lowered, p)))
        return F.when(needed, out).otherwise(given)

    return removed


def clean_markup(text: Column) -> Column:
    """Readable text without markup, entities, feed boilerplate and bullets at the ends."""
    out = decode_entities(text)
    for patterns, character, phrases in NEEDED:
        out = bound(out, _without(patterns, character, phrases))
    return F.btrim(squeeze(out), F.lit(EDGE_CHARACTERS))


def normalise_title(title: Column) -> Column:
    """Lower-case ASCII letters, digits and single spaces; one leading news prefix is dropped."""
    bare = F.regexp_replace(F.lower(_or_empty(title)), NEWS_PREFIX, "")
    return squeeze(F.regexp_replace(bare, r"[^a-z0-9\s]", ""))


def title_fingerprint(title: Column) -> Column:
    """16 hex digits of the MD5 of the normalised title."""
    return F.substring(F.md5(normalise_title(title)), 1, 16)


def words(text: Column, most: int | None = None) -> Column:
    """The words; with `most` those up to that many, and one more element if there are more."""
    return F.filter(F.split(_or_empty(text), r"\s+", -1 if most is None else most + 2), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def token_set(title: Column) -> Column:
    """Distinct words of the normalised title."""
    return F.array_distinct(words(normalise_title(title)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def truncate_words(text: Column, most: int) -> Column:
    """The text if it has at most that many words, else its first ones and an ellipsis."""

    def cut(all_words: Column) -> Column:
        first = F.rtrim(F.array_join(F.slice(all_words, 1, most), " "), F.lit(CUT_ENDING))
        return F.when(F.size(all_words) > most, F.concat(first, F.lit(ELLIPSIS)))

    return bound(_or_empty(text), lambda t: F.coalesce(bound(words(t, most), cut), t))


def sentences(text: Column) -> Column:
    return F.split(strip(_or_empty(text)), SENTENCE_END)


def opening(text: Column, most: int = 80) -> Column:
    """The first characters of the first sentence.

    They are told from the beginning of the text where it has that many characters and others than white space behind them.
    """
    begun = F.regexp_extract(F.substring(_or_empty(text), 1, 16 * most), rf"(?s)^\s*+(.{{{most}}}).*?\S", 1)
    return F.substring(F.get(F.split(F.coalesce(F.nullif(begun, F.lit("")), strip(_or_empty(text))), SENTENCE_END), F.lit(0)), 1, most)


def joined_sentences(cut: Column, n: int = 2) -> Column:
    """The first n of these sentences that have more than ten characters."""
    kept = F.filter(F.transform(cut, strip), lambda s: F.char_length(s) > 10)
    return F.array_join(F.slice(kept, 1, n), " ")


def first_sentences(text: Column, n: int = 2) -> Column:
    """The first n sentences of more than ten characters."""
    return joined_sentences(sentences(text), n)


def restates_title(summary: Column, title: Column, threshold: float = 0.75) -> Column:
    """Whether a summary only says again what the title says."""

    def judged(s: Column, t: Column) -> Column:
        title_words = F.array_distinct(words(t))
        overlap = F.size(F.array_intersect(F.array_distinct(words(s)), title_words)) / F.greatest(F.size(title_words), F.lit(1))
        return (F.char_length(t) >= 8) & (s.startswith(t) | (overlap >= threshold))

    both = bound(normalise_title(summary), lambda s: bound(normalise_title(title), lambda t: judged(s, t)))
    return F.when((_or_empty(summary) == "") | (_or_empty(title) == ""), F.lit(False)).otherwise(both)


def slug(name: Column) -> Column:
    out = F.lower(name)
    for old, new in ((" ", "-"), ("&", "and"), ("+", "plus")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def local_part(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def strip_code_fence(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"^```(?:json)?\s*|\s*```$", ""))


def first_image(html: Column) -> Column:
    """The source of the first image that is an http address, else empty."""
    source = F.regexp_extract(_or_empty(html), r"<img[^>]+src=[\"']([^\"']+)[\"']", 1)
    return F.when(source.startswith("http"), source).otherwise(F.lit(""))
