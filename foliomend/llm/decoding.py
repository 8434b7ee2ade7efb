"""Problem 8: text decoded in a wrong encoding. Adjacent character pairs are scored by the mutual information they carry in the
corpus, improbable runs are isolated as maximum-scoring segments, and inverse mappings are tested inside those runs only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomend.runtime import filled, map_rows, stored

#: A pair must make up this share of all pairs to be sent to the workers, so that at most 1 / PAIR_SHARE pairs can be.
PAIR_SHARE = 1e-6
#: Bits: a pair whose part of the corpus's mutual information is below 2 ** -PROBABLE counts as improbable.
PROBABLE = 13.0
#: Encodings that texts are taken for, and those that they are in. Names of Python's codecs.
TAKEN_FOR = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "iso8859-7", "koi8-r", "cp866", "cp1254", "iso8859-2", "iso8859-5")
WRITTEN_IN = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "cp866", "cp1253", "iso8859-5", "iso8859-7", "gb18030", "big5")
WIDE_TAKEN_FOR = ("gb18030", "big5", "shift_jis", "euc_kr")
#: Times that a text may have been decoded wrongly one after another.
ROUNDS = 3
#: Bits that the pairs of a run must gain on average before a rewriting between single-byte encodings is believed. UTF-8 needs
#: less, as its sequences hardly arise by chance, the longer ones least.
GAIN, GAIN_UTF8, GAIN_UTF8_LONG = 3.0, 0.5, -2.5
#: Share of a run's bytes that may be none of an East Asian encoding's, or of its characters none of UTF-8's.
DROPPED = 0.15
#: Bits that a pair with capitals may be rarer than the same in small letters.
CASE = 4.0
#: Bits that a maximum-scoring segment must have to be tested at all.
LEAST_SCORE = 1.0

_WIDTH = 21
_BEYOND = re.compile(r"[^\x00-\x7f]{2,}").sub
_SPAN = re.compile(r"(?s).?[^\x00-\x7f](?:[\x00-\x7f]{0,3}[^\x00-\x7f])*.?").finditer
_LOST = re.compile("[\x80-\x9f�]").search
#: Characters above this one are in none of the single-byte encodings.
_HIGHEST = "\u25ff"
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_WIDE = re.compile(r"(?:[\x81-\xfe][\x40-\x7e\x80-\xfe])+")


def _count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ascii_pairs = np.zeros(128 * 128, np.int64)
    other: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([k for k, _ in other]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([n for _, n in other])).astype(np.int64)

    for batch in batches:
        # U+0000 stands between texts; pairs with it are left out
        text = "\0".join(t for t in batch["text"] if t)
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        a, b = code[:-1], code[1:]
        plain = (a < 128) & (b < 128)
        ascii_pairs += np.bincount(a[plain] * 128 + b[plain], minlength=128 * 128)
        rest = ~plain
        if rest.any():
            other.append(np.unique((a[rest].astype(np.int64) << _WIDTH) | b[rest], return_counts=True))
            if len(other) >= 64:
                other = [merged()]
    at = np.nonzero(ascii_pairs)[0]
    keys, n = [(at // 128 << _WIDTH) | at % 128], [ascii_pairs[at]]
    if other:
        k, c = merged()
        keys.append(k)
        n.append(c)
    keys, n = np.concatenate(keys), np.concatenate(n)
    real = ((keys >> _WIDTH) != 0) & ((keys & (1 << _WIDTH) - 1) != 0)
    yield pd.DataFrame({"pair": keys[real], "n": n[real]})


def without_garbling(text: str) -> str:
    """text with U+0000 for each sequence beyond ASCII that is well-formed UTF-8 taken for one of the encodings, and that isn't
    of cased letters only, as words are."""
    if text.isascii():
        return text
    out = _BEYOND(lambda m: _masked(m.group()), text)
    return text if out == text else out


@lru_cache(100_000)
def _masked(run: str) -> str:
    out = list(run)
    for encoding in TAKEN_FOR:
        if not _begins(encoding)(run):
            continue
        for hit in _UTF8.finditer(run.translate(_table(encoding))):
            if any(unicodedata.category(c) not in ("Lu", "Ll") for c in run[hit.start() : hit.end()]):
                out[hit.start() : hit.end()] = "\0" * (hit.end() - hit.start())
    return "".join(out)


def pair_counts(df: DataFrame, text: str = "text", read: Callable[[], Callable[[str], str]] | None = None) -> DataFrame:
    """a, b (code points) and n of every adjacent pair of characters of all texts; null and one-character texts have none. read:
    gives each worker what texts are passed through first."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = read() if read else None
        return _count(pd.DataFrame({"text": [first(t) for t in b["text"]]}) for b in batches) if first else _count(batches)

    pairs = df.select(F.col(text).alias("text")).where("text is not null").mapInPandas(filled(run), "pair bigint, n bigint")
    pairs = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.select(F.shiftright("pair", _WIDTH).alias("a"), F.col("pair").bitwiseAND((1 << _WIDTH) - 1).alias("b"), "n")


class PairModel:
    """log2 of the share of each pair above PAIR_SHARE, and by how many bits it is improbable (negative: probable)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, share: np.ndarray, part: np.ndarray) -> None:
        pairs = [chr(x) + chr(y) for x, y in zip(a, b)]
        self.log_share = dict(zip(pairs, np.log2(share).tolist()))
        self.improbable = dict(zip(pairs, np.clip(-np.log2(np.maximum(part, 1e-9)) - PROBABLE, -6, 8).tolist()))
        # lost characters and control characters are none that anything was written in, however often they come
        for pair in filter(_LOST, pairs):
            del self.log_share[pair], self.improbable[pair]
        pairs = list(self.log_share)
        self.floor = float(np.log2(PAIR_SHARE)) - 1
        # capitals are as probable as their small letters, but CASE bits: titles set in capitals are rare, not improbable
        for pair in pairs:
            if pair.islower():
                for other in {pair.upper(), pair[0].upper() + pair[1]}:
                    if len(other) == 2 and other != pair:
                        self.log_share[other] = max(self.log_share.get(other, -99.0), self.log_share[pair] - CASE)
                        self.improbable[other] = min(self.improbable.get(other, 8.0), self.improbable[pair] + CASE / 2)

    def shares(self, text: str) -> list[float]:
        """log2 shares of the pairs of a text that have a character beyond ASCII; of all pairs if there is none."""
        get, floor = self.log_share.get, self.floor
        if text.isascii():
            return [get(a + b, floor) for a, b in pairwise(text)]
        return [get(a + b, floor) for a, b in pairwise(text) if a > "\x7f" or b > "\x7f"]

    def bits(self, text: str) -> list[float]:
        get = self.improbable.get
        return [get(a + b, 8.0) for a, b in pairwise(text)]


def pair_model(counts: DataFrame) -> PairModel:
    """The model of the pair counts; only pairs above PAIR_SHARE leave Spark, at most 1 / PAIR_SHARE of them."""
    counts = stored(counts)
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    if not total:
        empty = np.empty(0)
        return PairModel(empty, empty, empty, empty)
    left = counts.groupBy("a").agg(F.sum("n").alias("n_a"))
    right = counts.groupBy("b").agg(F.sum("n").alias("n_b"))
    kept = counts.where(F.col("n") >= PAIR_SHARE * total).join(left, "a").join(right, "b")
    share = F.col("n") / float(total)
    information = share * F.log2(share / ((F.col("n_a") / float(total)) * (F.col("n_b") / float(total))))
    pdf = kept.select("a", "b", share.alias("share"), information.alias("part")).toPandas()
    return PairModel(pdf["a"], pdf["b"], pdf["share"].to_numpy(), pdf["part"].to_numpy())


def maximal_segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximum-scoring segments (begin, end) of a sequence, none of which gains by being lengthened or shortened."""
    found: list[list[float]] = []  # begin, end, total before the segment, total at its end
    total = 0.0
    for i, score in enumerate(scores):
        if score <= 0:
            total += score
            continue
        new = [i, i + 1, total, total + score]
        total += score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(x[0]), int(x[1])) for x in found]


class _Bytes(dict):
    """Translation of an encoding's upper half to characters with its bytes' numbers, of all else beyond ASCII to U+0100. A
    byte that the encoding leaves open stands for the control character of its number, as lenient decoders have it."""

    def __init__(self, encoding: str) -> None:
        super().__init__({i: i for i in range(128)})
        for byte in range(128, 256):
            try:
                self[ord(bytes([byte]).decode(encoding))] = byte
            except UnicodeDecodeError:
                self[byte] = byte

    def __missing__(self, code: int) -> int:
        return 0x100


@lru_cache
def _table(encoding: str) -> _Bytes:
    return _Bytes(encoding)


@lru_cache
def _begins(encoding: str) -> Callable[[str], re.Match | None]:
    """A search for a UTF-8 sequence's first two bytes taken for an encoding, which tells most runs that hold none."""
    chars = {byte: re.escape(chr(code)) for code, byte in _table(encoding).items() if byte > 127}
    return re.compile("[" + "".join(chars.get(b, "") for b in range(0xC2, 0xF5)) + "][" + "".join(chars.get(b, "") for b in range(0x80, 0xC0)) + "]").search


@lru_cache
def _repertoire(encoding: str) -> frozenset[str]:
    """The characters of an encoding."""
    return frozenset(chr(code) for code, byte in _table(encoding).items() if byte < 256)


def _replaced(run: str, hits: list[tuple[int, int, str]]) -> tuple[str, list[int]]:
    """run with the stretches of hits replaced, and the places of the new characters in it."""
    out, places, at, length = [], [], 0, 0
    for begin, end, char in hits:
        out += [run[at:begin], char]
        length += begin - at
        places.append(length)
        length += 1
        at = end
    return "".join(out) + run[at:], places


def _utf8_forms(before: str, run: str, after: str, model: PairModel) -> Iterator[tuple[str, float]]:
    """run with the UTF-8 sequences put right that it shows when taken for bytes of one encoding after another, and the gain
    that each must have. A sequence of known pairs that would become a character in none isn't one, but by chance."""
    get, floor = model.log_share.get, model.floor
    for encoding in TAKEN_FOR:
        if not _begins(encoding)(run):
            continue
        got = run.translate(_table(encoding))
        if not _UTF8.search(got):
            continue
        hits = []
        for hit in _UTF8.finditer(got):
            try:
                hits.append((hit.start(), hit.end(), hit.group().encode("latin-1").decode("utf-8")))
            except UnicodeDecodeError:
                continue
        form, places = _replaced(run, hits)
        old, new = before + run + after, before + form + after
        kept = []
        for (begin, end, char), place in zip(hits, places):
            if char < "\U00010000":
                i, j = place + len(before), begin + len(before)
                beside = [p for p in (new[max(0, i - 1) : i + 1], new[i : i + 2]) if len(p) > 1]
                unknown = [p for p in beside if p not in model.log_share]
                if end - begin == 2 and encoding not in ("cp1252", "latin-1") and any(c.isalpha() for p in unknown for c in p if c != char):
                    continue
                if len(unknown) == len(beside):
                    if end - begin == 2:
                        continue
                    mine = [get(a + b, floor) for a, b in pairwise(old[max(0, j - 1) : end + len(before) + 1])]
                    if sum(mine) > (floor + 2) * len(mine):
                        continue
            kept.append((begin, end, char))
        if kept:
            twos = sum(end - begin == 2 for begin, end, _ in kept)
            yield _replaced(run, kept)[0], GAIN_UTF8_LONG if twos < len(kept) else GAIN_UTF8 - min(1.0, 0.5 * (twos - 1))


def _utf8_chains(before: str, run: str, after: str, model: PairModel, rounds: int = ROUNDS) -> Iterator[tuple[str, float]]:
    """_utf8_forms, and those of what they give, for texts decoded wrongly several times over."""
    for form, gain in _utf8_forms(before, run, after, model):
        yield form, gain
        if rounds > 1 and not form.isascii():
            for deeper, more in _utf8_chains(before, form, after, model, rounds - 1):
                yield deeper, min(gain, more) - 0.5


def _byte_forms(before: str, run: str, after: str, model: PairModel) -> Iterator[tuple[str, float]]:
    """run read again in another encoding than the one it was taken for, where all its characters allow it."""
    if max(run) > _HIGHEST:
        return
    seen = {run}
    for taken in TAKEN_FOR:
        if not _repertoire(taken).issuperset(run):
            continue
        got = run.translate(_table(taken))
        raw = got.encode("latin-1")
        for written in WRITTEN_IN:
            if written not in ("gb18030", "big5"):
                try:
                    form = raw.decode(written)
                except UnicodeDecodeError:
                    continue
            elif sum(c > 127 for c in raw) > 1:
                form = _WIDE.sub(lambda m, e=written: m.group().encode("latin-1").decode(e, "ignore"), got)
                if len(form.encode(written, "ignore")) < (1 - DROPPED) * len(raw):
                    continue
            else:
                continue
            if form in seen:
                continue
            seen.add(form)
            gain = GAIN
            if len(form) == len(run):
                changed = [i for i, (x, y) in enumerate(zip(run, form)) if x != y]
                i = changed[0]
                if len(changed) == 1 and run[i].isupper() and not (run[i - 1] if i else before).isalpha():
                    # one capital at a word's beginning proves little, and nothing if it would become another letter
                    if form[i].isalpha():
                        continue
                    gain = 2 * GAIN
            yield form, gain


def _wide_forms(before: str, run: str, after: str, model: PairModel) -> Iterator[tuple[str, float]]:
    """UTF-8 that was taken for an East Asian encoding."""
    if max(run) < "\u2e80":
        return
    for taken in WIDE_TAKEN_FOR:
        try:
            form = run.encode(taken).decode("utf-8", "replace")
        except UnicodeEncodeError:
            continue
        if form.count("\ufffd") <= DROPPED * len(form):
            yield form, 0.5


class Decoder:
    """Finds wrongly decoded runs and puts them right, remembering short spans."""

    def __init__(self, model: PairModel) -> None:
        self.model = model
        self.memory: dict[str, tuple[bool, str]] = {}
        self.tested: dict[tuple[str, str, str], str | None] = {}

    def _best(self, before: str, run: str, after: str) -> str | None:
        """The inverse mapping of a run between two characters that makes it most probable by the corpus, if it gains enough."""
        known = self.tested.get((before, run, after), run)
        if known is not run:
            return known
        shares, floor = self.model.shares, self.model.floor
        own = shares(before + run + after)
        if not own:  # a single character with nothing beside it
            return None
        mean, least = sum(own) / len(own), min(own)
        best: tuple[float, str] | None = None
        for forms in (_utf8_chains, _wide_forms, _byte_forms):
            for form, gain in forms(before, run, after, self.model):
                if not form or _LOST(form) and not _LOST(run):
                    continue
                new = shares(before + form + after)
                if not new:
                    continue
                m = sum(new) / len(new)
                if gain < 0 and m < floor + 1 and max(form) < "\U00010000":
                    gain = GAIN_UTF8  # what no text of the corpus has needs more than a well-formed sequence
                if m >= mean + gain and (best is None or m > best[0]) and (forms is not _byte_forms or min(new) >= least - 1 and len(new) > 1 and new.count(floor) <= (0.05 if max(form) > "\u2e7f" else 0.2) * len(new)):
                    best = m, form
            if best and best[0] > floor + 6:  # well known pairs; else another family may read better still
                break
        found = best[1] if best else None
        if len(run) <= 24:
            if len(self.tested) >= 200_000:
                self.tested.clear()
            self.tested[before, run, after] = found
        return found

    def span(self, text: str) -> tuple[bool, str]:
        """Whether a span holds wrongly decoded characters, and its best reading."""
        found, out, at = False, [], 0
        bits = self.model.bits(f"{text}\0" if len(text) == 1 else text)
        if not bits or max(bits) <= 0:
            return False, text
        for begin, end in maximal_segments(bits):
            if sum(bits[begin:end]) < LEAST_SCORE:
                continue
            end += 1  # pairs to characters
            while begin > at and text[begin - 1] > "\x7f":
                begin -= 1
            while end < len(text) and text[end] > "\x7f":
                end += 1
            if begin < at:
                if end <= at:
                    continue
                begin = at
            run = text[begin:end]
            if run.isascii():
                continue
            found |= bool(_LOST(run))
            for _ in range(ROUNDS):
                form = self._best(text[begin - 1 : begin] if begin else "", run, text[end : end + 1])
                if form is None:
                    break
                found, run = True, form
            out += [text[at:begin], run]
            at = end
        return found, "".join(out) + text[at:]

    def read(self, text: str) -> tuple[bool, str]:
        """Whether a text holds wrongly decoded characters anywhere, and the text with what could be put right."""
        if text.isascii():
            return False, text
        found, out, at = False, [], 0
        for hit in _SPAN(text):
            span = hit.group()
            if span in self.memory:
                bad, form = self.memory[span]
            else:
                bad, form = self.span(span)
                if len(span) <= 24:
                    if len(self.memory) >= 300_000:
                        self.memory.clear()
                    self.memory[span] = bad, form
            found |= bad
            if form != span:
                out += [text[at : hit.start()], form]
                at = hit.end()
        return found, "".join(out) + text[at:] if out else text


def decoded(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row for each row of df: key, garbled (whether the text holds characters that come from decoding in a wrong
    encoding), and with_text the text as far as it could be restored, and restored (whether no lost characters are left).

    Null texts give garbled false and a null text; empty and ASCII texts come back as they are. Repeated keys and equal texts
    each keep their row. The pair statistics cover all texts of df, as far as they can be restored."""
    source = df.select(F.col(key), F.col(text).alias("text"))
    # garbling must not count for itself: once without what looks like it, then with the texts as these counts restore them
    rough = spark.sparkContext.broadcast(pair_model(pair_counts(source, read=lambda: without_garbling)))

    def restorer() -> Callable[[str], str]:
        decoder = Decoder(rough.value)
        return lambda text: text if text.isascii() or without_garbling(text) is text else decoder.read(text)[1]

    model = spark.sparkContext.broadcast(pair_model(pair_counts(source, read=restorer)))
    schema = f"`{key}` {source.schema[0].dataType.simpleString()}, garbled boolean" + (", text string, restored boolean" if with_text else "")

    def run(batches: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        decoder = Decoder(model.value)
        for batch in batches:
            found = ((k, *(decoder.read(t) if t else (False, t))) for k, t in zip(batch[key], batch["text"]))
            yield [(k, x, t, bool(x and not _LOST(t))) if with_text else (k, x) for k, x, t in found]

    return map_rows(source, run, schema)
