"""Column functions on texts, forms and offsets. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = r"\s*([\p{L}\p{N}]+|[^\s])"
#: The first two tokens of a text, as groups; empty where there are fewer.
HEAD = rf"^{PIECE}(?:{PIECE})?"
ASCII_LETTER = "[a-zA-Z]"
ALNUM = r"[\p{L}\p{N}]"


def pieces(text: Column) -> Column:
    """The text cut into tokens, each with the white space before it."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def forms(text: Column) -> Column:
    """The tokens of a text."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(1))


def cuts(text: Column, most: int) -> Column:
    """The text cut after characters that are neither letter nor digit, so through no token, into parts of up to most characters; a longer run of letters and digits is one."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{0,{most - 1}}}[^\p{{L}}\p{{N}}]|[\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]?"), F.lit(0))


def strip_left(piece: Column) -> Column:
    return F.ltrim(piece, F.lit(" \t\n\x0b\f\r"))


def prefix_of(form: Column) -> Column:
    """Partition key of a form: its first letter a-z, or other."""
    first = F.lower(F.substring(form, 1, 1))
    return F.when(first.rlike("^[a-z]$"), first).otherwise("other")


def content_id(text: Column, digits: int = 8) -> Column:
    """The first hex digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, digits)


def source_url(url: Column, base: Column, title: Column) -> Column:
    """The given URL, or the base with the quoted title."""
    quoted = F.replace(F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("%2F"), F.lit("/"))
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(base, quoted))


def year_of(stamp: Column, markup: Column | None = None) -> Column:
    """Year of a date string; a year given in the page's header template wins."""
    plain = F.when(stamp.rlike("^[0-9]{4}"), F.substring(stamp, 1, 4).try_cast("int"))
    if markup is None:
        return plain
    return F.coalesce(F.regexp_extract(markup, r"\|\s*year\s*=\s*(\d{4})", 1).try_cast("int"), plain)


def char_offset(text: Column, byte_offset: Column) -> Column:
    """Characters before a byte offset; one that the offset cuts does not count."""
    raw = F.encode(text, "UTF-8")
    head = F.substring(raw, F.lit(1), byte_offset.cast("int"))
    lead = F.hex(F.substring(raw, byte_offset.cast("int") + 1, F.lit(1)))
    # chars of the head: all bytes but continuation bytes (80-BF)
    starts = F.length(F.regexp_replace(F.regexp_replace(F.hex(head), "(..)", "$1 "), "[89AB][0-9A-F] ", "")) / 3
    return (starts - F.when(lead.rlike("^[89AB]"), 1).otherwise(0)).cast("int")


def context(text: Column, at: Column, form: Column, around: int) -> Column:
    """The text from around characters before the form to as many after it."""
    start = F.greatest(at - around, F.lit(0))
    return F.substring(text, start + 1, at + F.char_length(form) + around - start)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def contexts(text: Column, around: int) -> Column:
    """(piece, left, form, right) of every token, with up to around characters of the text on each side.

    The sides are joined from the pieces near by, as every piece has a character at least; so the
    work on a text grows with its length alone.
    """
    n = F.lit(around)

    def of(ps: Column) -> Column:
        tail = F.substring(text, F.aggregate(ps, F.lit(1), lambda a, p: a + F.char_length(p)), n)
        near = F.struct(F.transform(ps, lambda p: F.right(p, n)).alias("ends"), F.concat(F.transform(ps, lambda p: F.left(p, n)), F.array(tail)).alias("starts"))

        def one(x: Column, p: Column, i: Column) -> Column:
            before = F.array_join(F.slice(x.ends, F.greatest(i - n, F.lit(0)) + 1, F.least(i, n)), "")
            left = F.right(F.concat(before, F.regexp_extract(p, r"^(\s*)", 1)), n)
            right = F.left(F.array_join(F.slice(x.starts, i + 2, n), ""), n)
            return F.struct(p.alias("piece"), left.alias("left"), strip_left(p).alias("form"), right.alias("right"))

        return let(near, lambda x: F.transform(ps, lambda p, i: one(x, p, i)))

    return let(pieces(text), of)


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def marked_context(text: Column, at: Column, form: Column, around: int, left: str, right: str, escape: bool = False) -> Column:
    """The context with marks around the form."""
    start = F.greatest(at - around, F.lit(0))
    n = F.char_length(form)
    own = escape_html if escape else (lambda x: x)
    parts = (F.substring(text, start + 1, at - start), F.substring(text, at + 1, n), F.substring(text, at + n + 1, F.lit(around)))
    return F.concat(own(parts[0]), F.lit(left), own(parts[1]), F.lit(right), own(parts[2]))


def surface(components: Column) -> Column:
    """Components joined by spaces, but none before one with an apostrophe or around a hyphen."""
    glue = lambda s, w: F.when(F.contains(w, F.lit("'")) | w.startswith("-") | s.endswith("-"), F.concat(s, w)).otherwise(F.concat(s, F.lit(" "), w))
    return F.aggregate(F.slice(components, F.lit(2), F.greatest(F.size(components) - 1, F.lit(0))), F.element_at(components, 1), glue)


def year_bucket(year: Column) -> Column:
    """Start of the year's bucket: single years from 2001, then 5, 10, 20 and 50."""
    w = bucket_width(year)
    return (F.floor(year / w) * w).cast("int")


def bucket_width(year: Column) -> Column:
    return F.when(year >= 2001, 1).when(year >= 1901, 5).when(year >= 1801, 10).when(year >= 1601, 20).otherwise(50)


def unit_hash(*key: Column) -> Column:
    """A number in (0, 1) from the md5 of the key."""
    digits = F.substring(F.md5(F.concat_ws("|", *key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + 1) / F.lit(float(2**52 + 1))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def grams(text: Column, n: int = 8) -> Column:
    """All windows of n words, each joined by a space."""
    w = words(text)
    none = F.array().cast("array<string>")
    # the words are bound to a variable, or each window would split the text again
    windows = lambda ws: F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.array_join(F.slice(ws, i + 1, F.lit(n)), " "))).otherwise(none)
    return F.element_at(F.transform(F.array(w), windows), 1)


#: The sentence that defines a derived form, by its relation to the base.
RELATIONS = {
    "plural": "Plural of {}.",
    "3sg_present": "Third-person singular present tense of {}.",
    "past_tense": "Past tense of {}.",
    "past_participle": "Past participle of {}.",
    "present_participle": "Present participle of {}.",
    "comparative": "Comparative form of {}.",
    "superlative": "Superlative form of {}.",
}


def morph_definition(relation: Column, base: Column) -> Column:
    """The definition of a derived form; an unknown relation is named as it is."""
    known = F.coalesce(*[F.when(relation == r, F.concat(F.lit(s.split("{}")[0]), base, F.lit("."))) for r, s in RELATIONS.items()])
    words = F.replace(relation, F.lit("_"), F.lit(" "))
    other = F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, F.lit(2), F.char_length(words))), F.lit(" of "), base, F.lit("."))
    return F.coalesce(known, other)


def chunks(text: Column, most: int) -> Column:
    """The text in pieces of up to most characters, cut after the last space that fits; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{most}}}\z|.{{0,{most - 1}}} |.{{1,{most}}}"), F.lit(0))


def sense_key(index: Column) -> Column:
    """The key, from 1, of a sense's place, from 0."""
    return (index + 1).cast("string")


def sense_index(key: Column) -> Column:
    """The place, from 0, of a key; null for one that is no number from 1."""
    n = F.trim(key).try_cast("int")
    return F.when(n >= 1, n - 1)


def content_int(text: Column) -> Column:
    """The first 8 bytes of the SHA-256, least significant first, as a signed integer."""
    h = F.sha2(text, 256)
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]), 16, -10).cast("long")


def rounded(x: Column, places: int) -> Column:
    """A double to some decimals as SQL engines round it: the scaled double, not its decimal digits, so 41 / 640 becomes 0.064062 and not 0.064063."""
    return F.round(x * 10.0**places) / 10.0**places


def number(x: Column) -> Column:
    """A share, a number from 0 to 1 with up to six decimals, as text: without an exponent down to 0.0001, below as in 1.2e-05."""
    n = F.round(x * 1_000_000).cast("long")
    plain = F.regexp_replace(x.cast("decimal(7,6)").cast("string"), "0+$", "")
    few = F.when(n < 10, F.concat(n.cast("string"), F.lit("e-06")))
    few = few.otherwise(F.concat(F.regexp_replace((n / 10).cast("decimal(3,1)").cast("string"), r"\.0$", ""), F.lit("e-05")))
    return F.when((n > 0) & (n < 100), few).when((n > 0) & (n < 1000), plain).otherwise(x.cast("string"))
