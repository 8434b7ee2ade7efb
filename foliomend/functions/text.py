"""Column functions over texts. All are built of Spark's own expressions, but for Unicode decomposition, which Spark lacks."""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed values.
PHRASES = ("of the", "in the", "to the", "is not", "there is")
ACCENTS = (("Collège", "Collége"), ("Bibliothèque", "Bibliothéque"), ("être", "étre"), ("rêve", "réve"), ("après", "aprés"), ("tekhnē", "tekhné"), ("askēsis", "askésis"))
GERMAN_VOTE = ("der", "die", "das", "und", "nicht", "von", "dem", "den", "ist")
ENGLISH_VOTE = ("the", "of", "and", "to", "in", "that", "is", "was")
ENGLISH = "the of and to in that is was for as with it not on be by this are from at or an".split()
FRENCH = "le la les des une dans qui pour pas sur est plus par ce cette au aux du ne se".split()
GERMAN = "der die das und ist nicht von mit dem den des ein eine im für auf als".split()
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("Ĳ", "IJ"), ("ĳ", "ij"))
DROPPED_GLYPH = ""
APOSTROPHES = "’‘ʼ′"

WORD = r"[A-Za-z]+"
_LETTER = r"\p{L}\p{N}_"
CJK = r"[\x{4E00}-\x{9FFF}]"
SPACE = r"(?U:[\s\x1c-\x1f])"
PAGE_ANCHOR = r"(?i)={3,}\s*(?:page|omnibus\s*p\.?)\s*\d+"
CID = r"\(cid:\d+\)"
GARBLED = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}\x{FFFD}\x00-\x08\x0E-\x1B\x80-\x84\x86-\x9F\p{Cn}\p{Cs}]"
BASE64 = r"(?=[A-Za-z0-9+/]{40,})(?=[^ ]*[0-9+/])[A-Za-z0-9+/]{40,}={0,2}"
CONTROL = r"[\x00-\x08\x0B\x0E-\x1F]"


def tokens(text: Column, least: int = 1) -> Column:
    """Runs of at least `least` letters A-Z, in order; null for a null text."""
    return F.regexp_extract_all(text, F.lit(f"[A-Za-z]{{{least},}}" if least > 1 else WORD), F.lit(0))


def words_at_boundaries(text: Column, least: int) -> Column:
    """Runs of letters A-Z that no other letter, figure or underscore touches, each physical line by itself."""
    return F.regexp_extract_all(text, F.lit(rf"(?<![{_LETTER}])[A-Za-z]{{{least},}}(?![{_LETTER}])"), F.lit(0))


def hyphenated_words(text: Column) -> Column:
    """In-line forms x-y of two runs of at least two letters A-Z each."""
    return F.regexp_extract_all(text, F.lit(rf"(?<![{_LETTER}])[A-Za-z]{{2,}}-[A-Za-z]{{2,}}(?![{_LETTER}])"), F.lit(0))


def occurrences(text: Column, literal: str) -> Column:
    """How often a literal string occurs, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / F.lit(len(literal))).cast("bigint")


def occurrences_of_all(text: Column, literals: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (occurrences(text, x) for x in literals))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, whole counting as 1 where it is 0."""
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def cjk_share(text: Column) -> Column:
    return share(matches(text, CJK), F.length(text))


def votes(lowered: Column, words: tuple[str, ...] | list[str]) -> Column:
    return F.size(F.filter(lowered, lambda w: w.isin(list(words)))).cast("bigint")


def lowered(array: Column) -> Column:
    return F.transform(array, F.lower)


def is_german(lowered_tokens: Column) -> Column:
    return votes(lowered_tokens, GERMAN_VOTE) > votes(lowered_tokens, ENGLISH_VOTE)


def phrase_density(text: Column, n_tokens: Column) -> Column:
    """Occurrences of the probe phrases among ten thousand tokens."""
    return share(occurrences_of_all(text, PHRASES), n_tokens) * 10000


def accents(text: Column) -> tuple[Column, Column]:
    """Right and misread forms of the accent probes."""
    return occurrences_of_all(text, tuple(a for a, _ in ACCENTS)), occurrences_of_all(text, tuple(b for _, b in ACCENTS))


def has_pages(text: Column) -> Column:
    return F.contains(text, F.lit("\f")) | text.rlike(PAGE_ANCHOR)


def expand_ligatures(text: Column) -> Column:
    """Ligature glyphs as letters, with the one space that an extractor left between the glyph and the rest of the word. A
    word that really ends in a ligature loses its space too: known and kept."""
    out = text
    for glyph, letters in (*LIGATURES, (DROPPED_GLYPH, "")):
        out = F.regexp_replace(out, f"{glyph}( (?=[{_LETTER}]))?", letters)
    return out


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _joined_lines(text: Column) -> Column:
    ends = F.lit(rf"[^\s\x1c-\x1f\x85\p{{Z}}]-\z")
    last = F.lit(rf"(?<![{_LETTER}])[\p{{L}}\p{{N}}]+[^{_LETTER}]*\z")
    first = F.lit(rf"^[^{_LETTER}]*[\p{{L}}\p{{N}}]+(?![{_LETTER}])")
    parts = lines(text)
    following = F.concat(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit(None).cast("string")))

    def piece(line: Column, after: Column) -> Column:
        joins = after.isNotNull() & F.regexp(line, ends) & F.regexp(line, last) & F.regexp(after, first)
        cut = F.substring(line, F.lit(1), F.length(line) - 1)
        return F.when(after.isNull(), line).when(joins, cut).otherwise(F.concat(line, F.lit("\n")))

    return F.array_join(F.zip_with(parts, following, piece), "")


def dehyphenate_lines(text: Column, across_pages: bool = True) -> Column:
    """Lines that end in a hyphen attached to a word are joined with the next if it begins with a word, the hyphen and the line
    break going together. With across_pages false, pages (form feeds, with the line breaks beside them) are taken one by one."""
    if across_pages:
        return _joined_lines(text)
    return F.array_join(F.transform(F.split(text, "\n?\f\n?", -1), _joined_lines), "\f")


def garble(text: Column) -> Column:
    """rate, garbled, total (characters that aren't white space) and cid of a text; blank and null texts have 0, 0, 0, false."""
    total = (F.length(text) - matches(text, SPACE)).cast("bigint")
    garbled = matches(text, GARBLED)
    some = F.coalesce(total > 0, F.lit(False))
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.when(some, garbled / total).otherwise(F.lit(0.0)).alias("rate"),
        F.when(some, garbled).otherwise(zero).alias("garbled"),
        F.when(some, total).otherwise(zero).alias("total"),
        F.when(some, text.rlike(CID)).otherwise(F.lit(False)).alias("cid"),
    )


def strip_furniture(text: Column) -> Column:
    """HTML comments, heading marks, table rows and link targets as spaces."""
    # fixed value: what counts as such
    return F.regexp_replace(text, r"(?md)<!--.*?-->|^#{1,6}\s|^\s*\|.*\|\s*$|\]\((?:https?://|www\.)[^)]*\)", " ")


def head_lines(heads: str) -> str:
    return rf"(?mdi)^[ \t]*\d*[ \t]*(?:{heads})[ \t]*\d*[ \t]*$"


def strip_heads(text: Column, heads: str) -> tuple[Column, Column]:
    """Text without whole lines that are one of the running heads, and how many there were."""
    return F.regexp_replace(text, head_lines(heads), ""), matches(text, head_lines(heads))


def cut_piece(text: Column, head: str | None, tail: str | None) -> tuple[Column, Column]:
    """The piece from the first head through the first tail, and whether it could be cut."""
    begin = F.locate(head, text) - 1 if head else F.lit(0)
    end = F.locate(tail, text) - 1 if tail else F.length(text)
    fine = (begin >= 0) & (end >= 0) & (end > begin)
    return F.when(fine, F.substring(text, begin + 1, end - begin + len(tail or ""))), F.coalesce(fine, F.lit(False))


# Fixed value.
HYPHENS = "\u2010\u2011\u2012\u2013\u2014\u00ad-"


def separator_class(separator: Column, most: int = 4) -> Column:
    """ok and hyphen of what stands between two tokens: a space, a hyphen, or a hyphen with a space on one side, whatever kind
    of hyphen and white space it is, in at most `most` characters."""
    even = F.translate(separator, HYPHENS + "\t\n\r", "-" * len(HYPHENS) + "   ")
    even = F.regexp_replace(even, " +", " ")
    return F.struct(((F.length(separator) <= most) & even.isin(" ", "-", " -", "- ")).alias("ok"), F.contains(even, F.lit("-")).alias("hyphen"))


def normalise(text: str) -> str:
    """Entities resolved, decomposed without marks, apostrophes straight."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", html.unescape(text)) if not unicodedata.combining(c))
    return plain.translate(dict.fromkeys(map(ord, APOSTROPHES), "'"))


@pandas_udf(StringType())
def normalised(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t if t.isascii() and "&" not in t else normalise(t))


_NORMAL_WORD = r"[A-Za-z][A-Za-z']*"


def normal_words(text: Column) -> Column:
    """Words of a normalised text: letters A-Z with apostrophes inside, none at the end."""
    found = F.regexp_extract_all(normalised(text), F.lit(_NORMAL_WORD), F.lit(0))
    return F.transform(found, lambda w: F.regexp_replace(w, "'+$", ""))


def normal_words_and_separators(plain: Column) -> Column:
    """w and sep of the words of a text that is normalised already: each word with what stands between it and the next, nothing
    after the last."""
    words, between = F.regexp_extract_all(plain, F.lit(_NORMAL_WORD), F.lit(0)), F.split(plain, _NORMAL_WORD, -1)
    after = F.concat(F.slice(between, F.lit(2), F.greatest(F.size(between) - 2, F.lit(0))), F.array(F.lit("")))
    return F.when(F.size(words) > 0, F.zip_with(words, after, lambda w, s: F.struct(F.regexp_replace(w, "'+$", "").alias("w"), s.alias("sep")))).otherwise(F.expr("cast(array() as array<struct<w string, sep string>>)"))


def stretches(text: Column, anchor: str, letters: str = WORD) -> Column:
    """page and words (in lower case) of the stretches between anchors, the page of the first being null."""
    numbers = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(anchor), F.lit(1)))
    words = lambda t: lowered(F.regexp_extract_all(t, F.lit(letters), F.lit(0)))
    return F.zip_with(numbers, F.split(text, anchor, -1), lambda n, t: F.struct(n.try_cast("int").alias("page"), words(t).alias("words")))


def adjacent(array: Column) -> Column:
    """Pairs (a, b) of neighbours of an array, in order, without a shuffle."""
    return F.when(F.size(array) > 1, F.zip_with(F.slice(array, F.lit(1), F.size(array) - 1), F.slice(array, F.lit(2), F.size(array) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.expr("array()").cast("array<struct<a:string,b:string>>"))
