"""Problem 5: text quality statistics of each file and its form: prose, list, table or junk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomend.llm.lookup import Rest
from foliomend.runtime import map_rows, one_row_per

#: Words of common_words that a worker holds in memory; a larger table is looked up in a file, with the same result.
COMMON_WORDS_IN_MEMORY = 50_000
#: Share of lines or paragraphs that are there already from which on a text may be boilerplate, the share of its letters that its
#: commonest three words then cover, and the share of repeated lines that, with few ends of sentences, is enough by itself.
REPEATED, COVERED, MOSTLY_REPEATED, FEW_ENDS = 0.5, 0.15, 0.8, 0.5
#: Times that a line comes, and share of the lines it makes up, from which on it is boilerplate in any text.
BOILERPLATE_TIMES, BOILERPLATE_SHARE = 4, 0.1

_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*").findall
ANCHOR = re.compile(r"\s*(?:\f+|\f*\s*=+\s*[^=\n]{0,40}?\d+\s*=+|\f*\s*[-–]{2,}\s*(?:page|p\.)\s*\d+\s*[-–]{2,}|\f*\s*\[(?:page|p\.)\s*\d+\])\s*", re.I).fullmatch
_BARE = re.compile(r"[\s\d\W_ivxlcdmIVXLCDM]{1,14}|p\.\s*\w{1,6}").fullmatch
_GAPS = re.compile(r"\t+| {2,}|\s*[|;]\s*").split
_BULLET = re.compile(r"(?:[-*•·–—▪◦‣+]|\(?\d{1,3}[.)]|[a-z]\))\s+\S").match
_LEADER = re.compile(r".*(?:\.{4,}|(?:\. ){3,}|…{2,}|_{4,})\s*\w+$").fullmatch
_GLOSS = re.compile(r"[^\s:][^:.,;]{0,30}:\s+\S[^:]{0,70}").fullmatch
_INDEX = re.compile(r"[^\d,]{2,45}(?:,\s*(?:see |siehe |voir )?\d+(?:\s?[-–]\s?\d+)?){1,40}[.,;]?").fullmatch
_PAGES = re.compile(r"(?:\d+(?:\s?[-–]\s?\d+)?,\s*)*\d+(?:\s?[-–]\s?\d+)?[.,;]?").fullmatch
_BIBLIO = re.compile(r"[^\W\d_][\w'’-]*,\s(?:[^\W\d_]\.[\s-]?)+.*").fullmatch
_CID = re.compile(r"\(cid:\d+\)")
_ENDS = (".", "!", "?", "…", ":", ";", "”", "»", "\"", "'", "’", ")", "。", "！", "？")
_VOWELS = re.compile(r"[aeiouyà-öø-ÿœͰ-῿一-鿿]", re.I).search
_CODED = re.compile(r"(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])(?=[^0-9]*[0-9])[A-Za-z0-9+/=]{20,}").fullmatch


#: Signs that may make a line something else than plain running text.
_SPECIAL = re.compile(r"[\t|;:_{}<>\\^~#%*+=/]").search
_OPENING = frozenset("“„«‘’'\"(¿¡")
_FIGURES = re.compile(r"\d+").sub
_BLANK = re.compile(r"\n\s*\n").split
_READABLE = re.compile(r"[^\W_]").search
_SIGNS = re.compile(r"[^\w\s.,;|—–-]").findall


def line_kind(line: str, common: frozenset[str] | Rest) -> str:
    """prose, list, table or junk for one line; '' for blank lines, page anchors and lines that are only a page number."""
    s = line.strip()
    if not s:
        return ""
    # a line that begins like a sentence and has a common word among different ones is prose
    if (s[0].isalpha() or s[0] in _OPENING) and not s[-1].isdigit() and not s[-2:-1].isdigit() and s[1:2] != ")" and "  " not in s and "..." not in s and ". . ." not in s and not _SPECIAL(s):
        tokens = s.lower().split()
        if len(tokens) > 3 and not common.isdisjoint(tokens) and 2 * len(set(tokens)) > len(tokens) and not ("," in tokens[0] + tokens[1] + tokens[2] and _BIBLIO(s)):
            return "prose"
    if ANCHOR(s) or _BARE(s):
        return ""
    n = len(s)
    if not _READABLE(s):
        return "junk"  # signs alone, such as rows of dashes, are no items of a list
    if "(cid:" in s and sum(map(len, _CID.findall(s))) > 0.4 * n or len(_SIGNS(s)) > 0.25 * n:
        return "junk"
    if _BULLET(s) or ("..." in s or ". . ." in s or "……" in s or "____" in s) and _LEADER(s) or _INDEX(s) or _GLOSS(s) or _BIBLIO(s):
        return "list"
    fields = _GAPS(s) if "  " in s or "\t" in s or ";" in s or "|" in s else [s]
    if len(fields) >= 3 and sum(1 for x in fields if len(x) <= 24) >= 0.8 * len(fields) and (len(fields) > 3 or any(x[:1].isdigit() or x in ("-", "—", "–", "") for x in fields)):
        return "table"
    if len(fields) == 2 and fields[1][:1].isdigit() and len(fields[0]) <= 24:
        return "table"
    words = _WORDS(s)
    letters = sum(map(len, words))
    if not words or letters < 0.55 * n:
        return "junk"
    if n >= 30 and _CODED(s):
        return "junk"
    if len(words) >= 4 and Counter(words).most_common(1)[0][1] > 0.6 * len(words):
        return "junk"
    if sum(1 for w in words if len(w) >= 3 and not _VOWELS(w)) > 0.4 * len(words):
        return "junk"
    return "prose"


def repeated_ngram_share(words: list[str], n: int = 3) -> float:
    """Share of the letters of the text that its most frequent n-gram of words covers."""
    if len(words) < n + 1:
        return 0.0
    grams = Counter(zip(*(words[i:] for i in range(n))))
    gram, times = max(grams.items(), key=lambda x: (x[1], x[0]))
    return times * sum(map(len, gram)) / max(1, sum(map(len, words))) if times > 1 else 0.0


def _there_already(items: list[str]) -> float:
    return 1 - len(set(items)) / len(items) if items else 0.0


class Measures:
    """What the form of a text hangs on, worked out as far as it is asked for."""

    def __init__(self, text: str, common: frozenset[str] | Rest) -> None:
        self.text, self.common = text, common
        self.lines = [s for x in text.split("\n") if (s := x.strip())]
        # but for figures, so that boilerplate with a page's number in it comes again
        self.plain = _FIGURES("#", "\n".join(self.lines)).split("\n")
        self.times = Counter(self.plain)
        self.repeated_lines = 1 - len(self.times) / len(self.plain) if self.lines else 0.0
        self._words: list[str] | None = None
        self._paragraphs: float | None = None
        self._ngram: float | None = None

    @property
    def words(self) -> list[str]:
        if self._words is None:
            self._words = [w.lower() for w in _WORDS(self.text)]
        return self._words

    @property
    def duplicate_lines(self) -> float:
        return _there_already(self.lines)

    @property
    def duplicate_paragraphs(self) -> float:
        if self._paragraphs is None:
            self._paragraphs = _there_already([p for x in _BLANK(self.text) if (p := x.strip())]) if self.repeated_lines else 0.0
        return self._paragraphs

    @property
    def ngram(self) -> float:
        if self._ngram is None:
            self._ngram = repeated_ngram_share(self.words)
        return self._ngram

    @property
    def ends(self) -> float:
        return sum(1 for s in self.lines if s.endswith(_ENDS)) / max(1, len(self.lines))

    def boilerplate(self) -> bool:
        """Whether what comes again in the text is boilerplate: much of it does, and few words cover much of it, or nearly all
        does and its lines aren't sentences."""
        if max(self.repeated_lines, self.duplicate_paragraphs) >= REPEATED and self.ngram >= COVERED:
            return True
        return self.repeated_lines >= MOSTLY_REPEATED and self.ends < FEW_ENDS

    def kinds(self) -> tuple[Counter, int]:
        """Kinds of the lines with text, and how many lines that are. Lines that look like prose but are boilerplate are junk."""
        kinds = [line_kind(s, self.common) for s in self.lines]
        counts = Counter(kinds)
        n = len(self.lines) - counts.pop("", 0)
        if self.repeated_lines:
            least, share = (2, 0.0) if self.boilerplate() else (BOILERPLATE_TIMES, BOILERPLATE_SHARE)
            for (_, k), times in Counter(zip(self.plain, kinds)).items():
                if k == "prose" and times >= least and times >= share * n:
                    counts["prose"] -= times
                    counts["junk"] += times
        return counts, n

    def form(self) -> tuple[str | None, float]:
        """The form of the text, null without lines to go by, and the share of its lines that are prose."""
        counts, n = self.kinds()
        if not n:
            return None, 0.0
        share = counts["prose"] / n
        return "prose" if share > 0.5 else max(("junk", "table", "list"), key=lambda k: counts[k]), share


def form_of(text: str | None, common: frozenset[str] | Rest) -> str | None:
    """Form of a text; null for null, empty and blank texts and for those that hold nothing but anchors and page numbers."""
    if not text or text.isspace():
        return None
    m = Measures(text, common)
    # lines that come once can't be boilerplate: with prose in half of all lines among them, the rest changes nothing
    once = m.lines if not m.repeated_lines else [s for s, p in zip(m.lines, m.plain) if m.times[p] == 1]
    need = len(m.lines) // 2 + 1
    for i, s in enumerate(once):
        if line_kind(s, common) == "prose":
            need -= 1
            if not need:
                return "prose"
        if need > len(once) - i - 1:
            break
    return m.form()[0]


def statistics(text: str, common: frozenset[str] | Rest) -> dict:
    """Quality statistics of one text that isn't null; shares of nothing are 0."""
    m = Measures(text, common)
    form, prose = m.form()
    solid = len("".join(text.split()))
    signs = sum(n for c, n in Counter(text).items() if not (c.isspace() or c.isalnum()))
    return {
        "words": len(m.words),
        "mean_word_length": sum(map(len, m.words)) / max(1, len(m.words)),
        "symbol_ratio": signs / max(1, solid),
        "end_punctuation_share": m.ends,
        "common_word_share": sum(n for w, n in Counter(m.words).items() if w in common) / max(1, len(m.words)),
        "duplicate_line_share": m.duplicate_lines,
        "duplicate_paragraph_share": m.duplicate_paragraphs,
        "top_ngram_share": m.ngram,
        "prose_share": prose,
        "form": form,
    }


STATISTICS = "file_id bigint, words bigint, mean_word_length double, symbol_ratio double, end_punctuation_share double, common_word_share double, duplicate_line_share double, duplicate_paragraph_share double, top_ngram_share double, prose_share double, form string"


def common_set(common_words: DataFrame) -> frozenset[str] | Rest:
    """The words of common_words, in lower case; null words are left out."""
    words = common_words.select(F.lower("w").alias("key")).where("key is not null").distinct()
    rows = words.limit(COMMON_WORDS_IN_MEMORY + 1).collect()
    if len(rows) > COMMON_WORDS_IN_MEMORY:
        return Rest.of(words.sparkSession, words.withColumn("n", F.lit(1).cast("bigint")))
    return frozenset(r["key"] for r in rows)


def once_each(parts: list[DataFrame]) -> DataFrame:
    """file_id and text of the rows of all parts, each file_id of a part once."""
    return reduce(DataFrame.unionByName, (one_row_per(p, "file_id").select("file_id", "text") for p in parts))


def quality_statistics(spark: SparkSession, parts: list[DataFrame], common_words: DataFrame) -> DataFrame:
    """One row for each file_id of each of `parts` (file_id, text) with its statistics and form.

    Files with a null text have null statistics and form; empty and blank texts have zeros and a null form. A repeated
    file_id gives one row; rows with a null file_id all stay. Other columns aren't read."""
    words = spark.sparkContext.broadcast(common_set(common_words))
    names = [x.split()[0] for x in STATISTICS.split(", ")][1:]

    def run(batches: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            found = ((i, statistics(t, words.value) if t is not None else {}) for i, t in zip(batch["file_id"], batch["text"]))
            yield [(i, *(s.get(n) for n in names)) for i, s in found]

    return map_rows(once_each(parts), run, STATISTICS)


def file_forms(spark: SparkSession, parts: list[DataFrame], common_words: DataFrame) -> DataFrame:
    """file_id and form of the files of all parts that have one; rows as in quality_statistics."""
    words = spark.sparkContext.broadcast(common_set(common_words))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield [(i, form) for i, t in zip(batch["file_id"], batch["text"]) if (form := form_of(t, words.value))]

    return map_rows(once_each(parts), run, "file_id bigint, form string")
