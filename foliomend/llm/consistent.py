"""Problem 4: one consistent form of texts that look the same."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomend.runtime import BROADCAST_ROWS, filled, map_rows, stored

#: Parts that the texts of one form are split into before they are paired, at most one for so many texts.
CLASS_PART = 1_000

# Letters of the three scripts that look alike, Latin first.
_LOOK_ALIKE = {
    "CYRILLIC": ("AaBCcEeHhIiJjKMOoPpQqSsTWwXxYyd", "АаВСсЕеНһІіЈјКМОоРрԚԛЅѕТԜԝХхУуԁ"),
    "GREEK": ("ABEZHIKMNOoPTYXvu", "ΑΒΕΖΗΙΚΜΝΟοΡΤΥΧνυ"),
}
_TO_LATIN = {o: a for latin, other in _LOOK_ALIKE.values() for a, o in zip(latin, other)}
_FROM_LATIN = {script: dict(zip(*pair)) for script, pair in _LOOK_ALIKE.items()}
_OTHER_WAY = {
    "CYRILLIC": {g: c for g, a in zip(_LOOK_ALIKE["GREEK"][1], _LOOK_ALIKE["GREEK"][0]) if (c := _FROM_LATIN["CYRILLIC"].get(a))},
    "GREEK": {c: g for c, a in zip(_LOOK_ALIKE["CYRILLIC"][1], _LOOK_ALIKE["CYRILLIC"][0]) if (g := _FROM_LATIN["GREEK"].get(a))},
}
_LATIN = "A-Za-z\xaa\xba\xc0-\xd6\xd8-\xf6\xf8-ɏḀ-ỿ"
_GREEK = "Ͱ-ͽͿ-Ͽἀ-῿"
_CYRILLIC = "Ѐ-ԯᲀ-Ა"
_MIXED = re.compile(f"[{_LATIN}][{_CYRILLIC}{_GREEK}]|[{_CYRILLIC}][{_LATIN}{_GREEK}]|[{_GREEK}][{_LATIN}{_CYRILLIC}]").search
_OTHERS = re.compile(f"[{_CYRILLIC}{_GREEK}]").search
_WORDS = re.compile(r"[^\W\d_]+")
_SCRIPTS = {"LATIN": re.compile(f"[{_LATIN}]").findall, "CYRILLIC": re.compile(f"[{_CYRILLIC}]").findall, "GREEK": re.compile(f"[{_GREEK}]").findall}


@lru_cache
def _simple() -> dict[int, str | None]:
    """What stands for each character that has a plainer equal: spaces for spaces, nothing for what can't be seen, ordinary
    letters and digits for full-width ones and ligatures."""
    table: dict[int, str | None] = {}
    for code in range(0xA0, sys.maxunicode + 1):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Zs":
            table[code] = " "
        elif kind == "Cf" or char == "͏" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            table[code] = None
        elif kind[0] in "LN" and (form := unicodedata.decomposition(char)).startswith("<"):
            if 0xFF00 <= code <= 0xFF5E or form.startswith("<compat>") and "LIGATURE" in unicodedata.name(char, ""):
                table[code] = unicodedata.normalize("NFKC", char)
    return table


@lru_cache
def _simple_class() -> re.Pattern:
    """One class of all characters that _simple replaces."""
    codes = sorted(_simple())
    spans, begin = [], codes[0]
    for a, b in zip(codes, [*codes[1:], -1]):
        if b != a + 1:
            spans.append(f"\\U{begin:08x}-\\U{a:08x}")
            begin = b
    return re.compile(f"[{''.join(spans)}]")


def plain_form(text: str) -> str:
    """Composed accents, ordinary letters, digits and spaces, no invisible characters; look-alikes are left as they are."""
    if text.isascii():
        return text
    text = _simple_class().sub(lambda m: _simple()[ord(m.group())] or "", text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def proposals(word: str) -> list[str]:
    """Readings of a mixed-script word in one script: the dominant one, or each of several that have as many letters, Latin
    first. A word with a letter that no letter of that script looks like has no such reading."""
    counts = {script: len(find(word)) for script, find in _SCRIPTS.items()}
    most = max(counts.values())
    out = []
    for script in (s for s, n in counts.items() if n == most):
        if script == "LATIN":
            reading = "".join(_TO_LATIN.get(c, c) for c in word)
        else:
            reading = "".join(_FROM_LATIN[script].get(c) or _OTHER_WAY[script].get(c, c) for c in word)
        if sum(1 for s, find in _SCRIPTS.items() if find(reading)) == 1:
            out.append(reading)
    return out


def mixed_words(plain: str) -> set[str]:
    """The words of a text in plain form that have letters of more than one of the scripts."""
    if plain.isascii() or not _OTHERS(plain) or not _MIXED(plain):
        return set()
    return {w for w in _WORDS.findall(plain) if not w.isascii() and _MIXED(w)}


def repaired(plain: str, accepted: dict[str, str]) -> str:
    """A text in plain form with its mixed words replaced by the accepted readings."""
    if plain.isascii() or not _OTHERS(plain) or not _MIXED(plain):
        return plain
    return _WORDS.sub(lambda m: accepted.get(m.group(), m.group()), plain)


def accepted_readings(texts: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """word and reading of the mixed-script words of all texts whose reading is in the corpus's vocabulary: it occurs there
    as a word, or several different mixed words read the same. Of several readings the one that occurs is taken, Latin first."""
    spark = texts.sparkSession

    def propose(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for batch in batches:
            new: set[str] = set()
            for text in batch["text"]:
                if text and not text.isascii():
                    new |= mixed_words(plain_form(text))
            new -= seen
            seen = new if len(seen) > 500_000 else seen | new
            yield pd.DataFrame([(w, r, i) for w in sorted(new) for i, r in enumerate(proposals(w))], columns=["word", "reading", "choice"])

    proposed = stored(texts.mapInPandas(filled(propose), "word string, reading string, choice int").distinct())
    wanted = proposed.select("reading").distinct()
    n = proposed.count()
    if n <= limit:
        few = spark.sparkContext.broadcast(frozenset(r["reading"] for r in wanted.collect()))

        def found(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rest = set(few.value)
            for batch in batches:
                hits: set[str] = set()
                for text in batch["text"]:
                    if text and rest:
                        hits |= rest.intersection(_WORDS.findall(plain_form(text)))
                rest -= hits
                yield pd.DataFrame({"reading": sorted(hits)}, columns=["reading"])

        known = texts.mapInPandas(filled(found), "reading string").distinct()
    else:

        def words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"reading": sorted({w for text in batch["text"] if text for w in _WORDS.findall(plain_form(text))})}, columns=["reading"])

        known = wanted.join(texts.mapInPandas(filled(words), "reading string").distinct(), "reading", "left_semi")
    several = proposed.groupBy("reading").agg(F.count("*").alias("n")).where("n > 1").select("reading")
    vocabulary = known.unionByName(several).distinct()
    return proposed.join(vocabulary, "reading", "left_semi").groupBy("word").agg(F.min_by("reading", "choice").alias("reading"))


def consistent_texts(spark: SparkSession, df: DataFrame, key: str = "file_id", text: str = "text", with_text: bool = True, limit: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of df: key, form (a 128-bit digest of the consistent form), stored (one of the text as it is) and
    with_text the consistent text itself.

    Null texts give nulls. Blank and empty texts have forms like others, with blank true. Case, accents, punctuation,
    quotation marks and line breaks are kept. limit: readings up to which they are sent to every worker; beyond it each row
    gets its own by a join on a number that it is given once, with the same result. Rows with a null key are rows like others."""
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    accepted = stored(accepted_readings(source.select("text"), limit))
    key_type = source.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, form string, stored string, blank boolean" + (", text string" if with_text else "")

    def row(key: object, text: str | None, readings: dict[str, str]) -> tuple:
        if text is None:
            return (key, *(None,) * (3 + with_text))
        new = repaired(plain_form(text), readings)
        own = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()
        form = own if new == text else hashlib.blake2b(new.encode("utf-8", "replace"), digest_size=16).hexdigest()
        return (key, form, own, not new.strip(), *([new] if with_text else []))

    if accepted.count() <= limit:
        sent = spark.sparkContext.broadcast({r["word"]: r["reading"] for r in accepted.collect()})

        def run(batches: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for batch in batches:
                yield [row(k, t, sent.value) for k, t in zip(batch["key"], batch["text"])]

        return map_rows(source, run, schema).withColumnRenamed("key", key)
    source = stored(source.withColumn("__id", F.monotonically_increasing_id()))

    def mixed(batches: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield [(i, w) for i, t in zip(batch["__id"], batch["text"]) if t for w in mixed_words(plain_form(t))]

    own = map_rows(source.select("__id", "text"), mixed, "__id bigint, word string").join(accepted, "word")
    own = own.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("word", "reading"))).alias("readings"))

    def run_own(batches: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield [row(k, t, dict(r or ())) for k, t, r in zip(batch["key"], batch["text"], batch["readings"])]

    return map_rows(source.join(own, "__id", "left").select("key", "text", "readings"), run_own, schema).withColumnRenamed("key", key)


def equal_classes(forms: DataFrame, key: str = "file_id") -> DataFrame:
    """One row for each file whose text isn't blank: key, form (the class), stored, representative (the least key of the class
    with the same text as stored) and texts (how many different stored texts the class has). Linear in the files, whatever the
    size of a class; the links are those between rows of one form and different stored."""
    files = stored(forms.where("not blank and form is not null").select(key, "form", "stored").distinct())
    texts = files.groupBy("form", "stored").agg(F.min(key).alias("representative"))
    classes = texts.groupBy("form").agg(F.count("*").alias("texts"))
    return files.join(texts, ["form", "stored"]).join(classes, "form").select(key, "form", "stored", "representative", "texts")


def equal_pairs(forms: DataFrame, key: str = "file_id", part: int = CLASS_PART) -> DataFrame:
    """file_a < file_b of the files whose texts aren't blank, have the same form and differ as stored, that is all links of
    equal_classes; only this result is as long as it has to be.

    Each file of a class of more than one text goes to one of the class's parts on the one side and to all of them on the other,
    so that a large class is spread over as many tasks. Files with the same stored text are never paired. Repeated rows of a
    file count once."""
    files = stored(equal_classes(forms, key).where("texts > 1").select(F.col(key).alias("file"), "form", "stored"))
    sizes = files.groupBy("form").agg((F.floor(F.count("*") / part) + 1).cast("int").alias("parts"))
    files = files.join(sizes, "form")
    one = files.withColumn("p", F.pmod(F.xxhash64("file"), F.col("parts")).cast("int")).select("form", "p", F.col("file").alias("file_a"), F.col("stored").alias("one"))
    other = files.select("form", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.col("file").alias("file_b"), F.col("stored").alias("other"))
    return one.join(other, ["form", "p"]).where("file_a < file_b and one <> other").select("file_a", "file_b")
