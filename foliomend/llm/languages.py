"""Problem 1: language of each document and of each passage, by rank-order profiles of character n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomend.runtime import map_rows

#: n-grams kept in a language's profile; also the distance of one that isn't in it.
PROFILE = 800
#: The labelled sample that profiles are trained on: files for each language, and characters up to which a file is taken.
TRAINING_FILES, TRAINING_CHARS = 60, 20_000
#: Common words of each language that profiles are trained on, those whose hashes come first if there are more.
TRAINING_WORDS = 5_000
#: Sentences in a row that make a passage.
PASSAGE = 2
#: Letters that a stretch between two sentence ends must have to count as a sentence; one Chinese character counts as three.
SENTENCE_LETTERS = 12
#: What a change of language between two sentences costs, in n-grams found at no rank.
SWITCH = 6.0

_SIZES = (1, 2, 3, 4)
_BITS = 20
_DIGIT = re.compile(r"\d").search
_ANCHOR = re.compile(r"(?m)^[ \t\r]*(?:={2,}[^\n]*={2,}|[-–\[(]?[ \t]*(?:p\.[ \t]*)?\d{1,4}[ \t]*[-–\])]?)[ \t\r]*$|\f")
_ENDS = re.compile(r"(?<=[.!?…])[\"”»’')\]“]*\s+|(?<=[Ͱ-Ͽ];)[\"”»’')\]]*\s+|(?<=[。！？])[」』”）]*\s*|\n[ \t\r]*\n\s*")


@lru_cache
def _folds() -> np.ndarray:
    """Lower-case letter of each character of the basic plane, 0 for all that are no letters."""
    table = np.zeros(1 << 16, np.uint32)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else code
    return table


def sentences(text: str) -> list[str]:
    """Stretches of a text between sentence ends or blank lines, without page anchors and bare page numbers, composed."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "=" in text or "\f" in text or _DIGIT(text):
        text = _ANCHOR.sub(" ", text)
    return [s for s in _ENDS.split(text) if s and not s.isspace()]


@dataclass
class Grams:
    """Distinct n-grams of segments: segment, hashed n-gram, how often; sorted by segment."""

    segment: np.ndarray
    gram: np.ndarray
    count: np.ndarray
    letters: np.ndarray  # of each segment; a Chinese character counts as three


def grams(segments: list[str]) -> Grams:
    """The n-grams of 1 to 4 characters of the words of each segment, a word's ends being part of them."""
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    code = np.frombuffer(" ".join([*segments, ""]).encode("utf-32-le", "replace"), np.uint32)
    code = np.where(code < 1 << 16, _folds()[np.minimum(code, (1 << 16) - 1)], 0)
    seg = np.repeat(np.arange(len(segments)), lengths + 1)
    space = code == 0
    han = (code >= 0x4E00) & (code <= 0x9FFF)
    letters = np.bincount(seg, np.where(han, 3, ~space), minlength=len(segments))
    keep = ~(space & np.concatenate([[True], space[:-1]]))
    code, seg = code[keep].astype(np.int64), seg[keep]
    # one space before each segment's first word, and the one that follows each word
    code = np.concatenate([[0], code])
    seg = np.concatenate([seg[:1], seg]) if len(seg) else np.zeros(1, np.int64)
    space = code == 0
    keys = []
    h = np.zeros(len(code), np.int64)
    for n in range(1, max(_SIZES) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * 1_000_003 + code[n - 1 :]
        # letters inside, ends may be the space beside a word; the segment is that of the second character
        ok = ~space[:m] if n == 1 else ~(space[:m] & space[n - 1 :]) if n == 2 else np.ones(m, bool)
        for inner in range(1, n - 1):
            ok &= ~space[inner : inner + m]
        hashed = ((h ^ (h >> 17)) * 0x9E3779B1 + n * 7919 >> 7) & ((1 << _BITS) - 1)
        owner = seg[(0 if n == 1 else 1) :][:m]
        keys.append((owner[ok] << _BITS) | hashed[ok])
    key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    return Grams(key >> _BITS, key & ((1 << _BITS) - 1), count, letters)


class Profiles:
    """Rank of each n-gram in each language's profile."""

    def __init__(self, languages: list[str], ranked: list[np.ndarray]) -> None:
        self.languages, self.ranked = languages, ranked
        self._table: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        return self.languages, self.ranked

    def __setstate__(self, state: tuple) -> None:
        self.languages, self.ranked = state
        self._table = None

    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = np.full((1 << _BITS, len(self.languages)), 4 * PROFILE, np.int16)
            for i, order in enumerate(self.ranked):
                self._table[order, i] = np.arange(len(order))
        return self._table

    def distances(self, g: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Out-of-place distance of each segment to each language in units of PROFILE (that is, of n-grams found nowhere), and
        each segment's number of distinct n-grams. n-grams equally frequent in a segment share their mean rank."""
        n = len(g.letters)
        if not len(g.segment):
            return np.zeros((n, len(self.languages))), np.zeros(n)
        # the different counts, numbered; beyond twice the profile's length a rank is as far away as one found nowhere
        number = np.cumsum(np.bincount(g.count) > 0) - 1
        count, k = number[g.count], int(number[-1]) + 1
        times = np.bincount(g.segment * k + count, minlength=n * k).reshape(n, k)
        above = times[:, ::-1].cumsum(1)[:, ::-1] - times
        rank = np.minimum(above + (times - 1) // 2, 2 * PROFILE).astype(np.int16)[g.segment, count]
        away = self.table()[g.gram]
        away -= rank[:, None]
        np.abs(away, out=away)
        np.minimum(away, PROFILE, out=away)
        start = np.concatenate([[0], np.nonzero(np.diff(g.segment))[0] + 1])
        out = np.zeros((n, len(self.languages)))
        out[g.segment[start]] = np.add.reduceat(away, start, axis=0, dtype=np.int32) / PROFILE
        return out, np.bincount(g.segment, minlength=n).astype(float)


def _ranked(segment_language: np.ndarray, g: Grams, n: int, seeds: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    language = segment_language[g.segment]
    for i in range(n):
        mine = language == i
        weight = np.bincount(g.gram[mine], g.count[mine], minlength=1 << _BITS) + 0.5 * seeds[i]
        top = np.argsort(-weight, kind="stable")[:PROFILE]
        out.append(top[weight[top] > 0])
    return out


def train(texts: list[tuple[str, str]], common: dict[str, list[str]], rounds: int = 3) -> Profiles:
    """Profiles from labelled texts (label, text), some labels being wrong and some texts mixed, and from each language's
    common words: a first set of profiles as labelled, then each round keeps what the last one's profiles confirm."""
    languages = sorted({*common, *(label for label, _ in texts)})
    at = {x: i for i, x in enumerate(languages)}
    seeds = []
    for x in languages:
        s = grams(common.get(x, []))
        seeds.append(np.bincount(s.gram, s.count, minlength=1 << _BITS).astype(float))
    parts = [(at[label], s) for label, text in texts for s in sentences(text)]
    label = np.array([i for i, _ in parts], np.int64)
    g = grams([s for _, s in parts])
    profiles = Profiles(languages, _ranked(label, g, len(languages), seeds))
    for _ in range(rounds if parts else 0):
        away, n = profiles.distances(g)
        best = away.argmin(1)
        sure = (np.sort(away, 1)[:, 1] - away.min(1) > 0.08 * n) & (g.letters >= SENTENCE_LETTERS) if len(languages) > 1 else np.ones(len(best), bool)
        profiles = Profiles(languages, _ranked(np.where(sure, best, -1), g, len(languages), seeds))
    return profiles


@dataclass
class Passage:
    language: str
    begin: int  # first sentence, from 0
    sentences: int
    confidence: float


def _path(cost: np.ndarray) -> np.ndarray:
    """Cheapest course of languages over the sentences, a change costing SWITCH."""
    n, k = cost.shape
    total, back = cost[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        change = total.argmin()
        jump = total[change] + SWITCH
        stay = total <= jump
        back[i] = np.where(stay, np.arange(k), change)
        total = np.where(stay, total, jump) + cost[i]
    path = np.empty(n, np.int64)
    path[-1] = total.argmin()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


#: Characters whose n-grams are in memory at once.
BLOCK = 100_000


def _scored(segments: list[str], profiles: Profiles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances, numbers of n-grams and letters of segments, worked out in blocks of bounded size."""
    away, n, letters, block, size = [], [], [], [], 0
    for i, s in enumerate(segments):
        block.append(s)
        size += len(s)
        if size >= BLOCK or i == len(segments) - 1:
            g = grams(block)
            d, k = profiles.distances(g)
            away.append(d)
            n.append(k)
            letters.append(g.letters)
            block, size = [], 0
    if not away:
        return np.zeros((0, len(profiles.languages))), np.zeros(0), np.zeros(0)
    return np.concatenate(away), np.concatenate(n), np.concatenate(letters)


def passages(texts: list[str], profiles: Profiles) -> list[list[Passage]]:
    """The runs of sentences in one language of each text, in order. Stretches too short for a sentence belong to no run and
    don't count; they don't break one either."""
    parts = [sentences(t) for t in texts]
    away, n, letters = _scored([s for p in parts for s in p], profiles)
    real = letters >= SENTENCE_LETTERS
    out, at = [], 0
    for p in parts:
        end = at + len(p)
        keep = np.nonzero(real[at:end])[0] + at
        at = end
        if not len(keep):
            out.append([])
            continue
        cost = away[keep]
        best = cost.argmin(1)
        course = best if (best == best[0]).all() else _path(cost)
        edges = [0, *(np.nonzero(np.diff(course))[0] + 1).tolist(), len(course)]
        found = []
        for a, b in zip(edges, edges[1:]):
            sums = cost[a:b].sum(0)
            mine = sums[course[a]]
            others = np.delete(sums, course[a])
            margin = (others.min() - mine) / max(1.0, n[keep[a:b]].sum()) if len(others) else 1.0
            found.append(Passage(profiles.languages[course[a]], a, b - a, float(np.clip(4 * margin, 0, 1))))
        out.append(found)
    return out


def label_key(column: str) -> F.Column:
    """A stored label without spaces around it, case and a suffix after - or _."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), r"(?s)[-_].*$", "")


def labelled(df: DataFrame, lang_labels: DataFrame, label: str = "lang") -> DataFrame:
    """df with meant, the code of lang_labels that its label means, or null. lang_labels is a fixed table of a few rows."""
    known = lang_labels.where("label is not null and lang is not null").groupBy(F.col("label").alias("__label")).agg(F.min("lang").alias("meant"))
    return df.withColumn("__key", label_key(label)).join(known, F.col("__key") == F.col("__label"), "left").drop("__key", "__label")


def trained_profiles(files: DataFrame, common_words: DataFrame, per_language: int = TRAINING_FILES, chars: int = TRAINING_CHARS) -> Profiles:
    """Profiles from a bounded sample of the labelled files (file_id, text, meant): of each language the per_language files of
    up to `chars` characters whose hashed ids come first, and from up to TRAINING_WORDS common words of each. Languages
    without labelled files have profiles of their common words alone."""
    fit = files.where(F.col("meant").isNotNull() & F.col("file_id").isNotNull() & F.length("text").between(1, chars))
    order = Window.partitionBy("meant").orderBy(F.xxhash64("file_id"), "file_id")
    chosen = fit.select("file_id", "meant").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    rows = fit.join(F.broadcast(chosen.select("file_id", "meant")), ["file_id", "meant"]).dropDuplicates(["file_id"]).orderBy("file_id").select("meant", "text").collect()
    common: dict[str, list[str]] = {}
    words = common_words.where("w is not null and lang is not null").select("lang", "w").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("w"), "w")))
    for r in words.where(F.col("n") <= TRAINING_WORDS).orderBy("lang", "w").collect():
        common.setdefault(r["lang"], []).append(r["w"])
    return train([(r["meant"], r["text"]) for r in rows], common)


def file_passages(spark: SparkSession, files: DataFrame, lang_labels: DataFrame, common_words: DataFrame) -> DataFrame:
    """file_id, meant, lang, begin (first sentence, from 0), sentences and confidence of each run of sentences in one language
    of each file (file_id, text, lang).

    Null, empty and blank texts and those of page anchors alone give no rows. A repeated row gives its runs once more; rows
    with a null file_id keep theirs. Confidence is how much further the next language is, between 0 and 1."""
    source = labelled(files.select("file_id", "text", "lang"), lang_labels).select("file_id", "text", "meant")
    profiles = spark.sparkContext.broadcast(trained_profiles(source, common_words))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            texts, begin, size = [t or "" for t in batch["text"]], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BLOCK or i == len(texts) - 1:
                    found = zip(batch["file_id"][begin : i + 1], batch["meant"][begin : i + 1], passages(texts[begin : i + 1], profiles.value))
                    yield [(k, m, x.language, x.begin, x.sentences, x.confidence) for k, m, runs in found for x in runs]
                    begin, size = i + 1, 0

    return map_rows(source, run, "file_id bigint, meant string, lang string, begin int, sentences int, confidence double")


def other_languages(runs: DataFrame, least: int = PASSAGE) -> DataFrame:
    """file_id and lang of each language other than the labelled one in which a file has a passage of `least` sentences."""
    return runs.where((F.col("sentences") >= least) & ~F.col("lang").eqNullSafe(F.col("meant"))).select("file_id", "lang").distinct()


def file_languages(runs: DataFrame) -> DataFrame:
    """file_id, lang and confidence of each file: the language of most of its sentences, ties going to the first code; its
    confidence is that of its runs, weighted by sentences, times its share. Repeated rows of a file count once."""
    parts = runs.dropDuplicates(["file_id", "begin"]).groupBy("file_id", "lang").agg(F.sum("sentences").alias("n"), F.sum(F.col("sentences") * F.col("confidence")).alias("c"))
    best = parts.groupBy("file_id").agg(F.max_by("lang", F.struct("n", F.translate("lang", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))).alias("lang"), F.sum("n").alias("all"), F.max_by("c", F.struct("n", F.translate("lang", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))).alias("c"))
    return best.select("file_id", "lang", (F.col("c") / F.col("all")).alias("confidence"))
