"""Problem 2: noise of scanned pages. Running heads, page numbers, words cut at line ends, and misrecognised characters, which a
noisy channel puts right: confusions of characters times n-grams of words, decoded by Viterbi over the candidates of a line."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from heapq import heappop, heappush
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomend.llm.forms import ANCHOR, common_set, form_of, once_each
from foliomend.llm.lookup import Rest, RestText
from foliomend.runtime import filled, map_rows, small_side, stored

#: Occurrences from which on a word or a pair of words is known.
LEAST = 3
#: Words, pairs and n-grams of characters that a worker holds in memory; the rest is looked up in a file, with the same result.
WORDS_IN_MEMORY, PAIRS_IN_MEMORY = 400_000, 4_000_000
#: n-grams of characters in the model of words never met: those of a share of at least one in so many.
GRAMS = 1_000_000
#: Files of the older collection from which on a word of the lexicon counts as known.
LEXICON_FILES = 3
#: Different words that must show a confusion that isn't listed, and how much more frequent than the misread ones the right ones are.
LEARNED_WORDS, LEARNED_RATIO = 20, 50
#: Chance that a word's place is taken by a word never met: in small letters, as a name, and with signs or figures inside.
NEW_WORD, NEW_NAME, NEW_SIGNS = 2e-9, 2e-7, 1e-13
#: Chance that a word's place is taken by any word never met.
NEW = 0.02
#: Chance of one certain number.
NEW_NUMBER = 1e-5
#: Advantage in log chance that a reading the corpus doesn't know must have over what stands there.
UNHEARD = 1.5
#: Weight of the pair in a word's probability; the rest is the word's own.
PAIR_WEIGHT = 0.5

# What is read (first) for what is printed (second).
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("f", "t"), ("+", "t"), ("o", "a"), ("0", "o"), ("O", "0"), ("0", "O"), ("1", "l"), ("l", "1"), ("!", "i"), ("í", "i"), ("l", "I"), ("1", "i"), ("1", "I"),
    ("5", "s"), ("5", "S"), ("6", "b"), ("8", "B"), ("b", "h"), ("q", "g"), ("F", "E"), ("ri", "n"), ("n", "ri"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("U", "ll"),
    ("h", "fi"), ("h", "li"), ("|", "l"), ("I", "l"), ("tl", "ti"), ("u", "n"), ("n", "u"), ("a", "o"), ("9", "g"), ("in", "m"), ("d", "cl"),
)
#: Spelling that no confusion changes, but those of capitals F and E: i for the slim letters, c, o and g for their likes, and
#: broad letters as what they are read for.
_SHAPE = str.maketrans({**dict.fromkeys("ilrtf1!+|íI", "i"), **dict.fromkeys("nuhb68", "ii"), "m": "iii", "e": "c", "d": "ci", "a": "o", "0": "o", "5": "s", "q": "g", "9": "g", "w": "vv"})
#: Chance of each confusion before the corpus has said, and the weight of that in characters read.
PRIOR, PRIOR_WEIGHT = 2e-4, 20_000.0

_EDGE = ".,;:?!()[]{}<>“”„«»‘’'\"…—–-*|/\\§°·•¿¡"
_NUMBER = r"\d{1,4}|(?=[ivxlcdm]{1,8}\b)m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})|(?=[^\s]*\d)[\dlIOoSBi|!]{2,4}"
_FOLIO = re.compile(rf"(?:[-–—(\[|·•]\s*)?(?:pp?\.\s*|pag\.\s*|S\.\s*)?(?P<n>{_NUMBER})(?:\s*[-–—)\]|·•])?", re.I).fullmatch
_HEAD_LEFT = re.compile(rf"(?:[-–—(\[]\s*)?(?P<n>{_NUMBER})(?:\s*[-–—)\]])?(?:\s*[|·•—–]\s*|\s+)(?P<h>[^\W\d_].*)", re.I | re.S).fullmatch
_HEAD_RIGHT = re.compile(rf"(?P<h>[^\W\d_].*?)(?:\s*[|·•—–]\s*|\s+)(?:[-–—(\[]\s*)?(?P<n>{_NUMBER})(?:\s*[-–—)\]])?", re.I | re.S).fullmatch
_SMALL = frozenset("of and the in on to for a an de la le les des du et l d y el los las del un una der die das und von des dem den il lo gli i della di e o os as da do dos em van het een en".split())
_LAST = re.compile(r"([^\W_](?:[^\W_]|[!+|])*)-$").search
_FIRST = re.compile(r"[“„«(]?((?:[^\W_]|[!+|](?=[^\W_]))+)").match
_ROUGH = (("rn", "m"), ("in", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("fi", "h"), ("li", "h"), ("ll", "u"))
_CLASSES = str.maketrans({"0": "o", "a": "o", "c": "e", "f": "e", "t": "e", "+": "e", "l": "i", "1": "i", "!": "i", "í": "i", "|": "i", "5": "s", "b": "h", "6": "h", "q": "g", "8": "h"})


def rough(head: str) -> str:
    """A head with what scanning mixes up made equal, for telling that two lines are the same head."""
    s = "".join(head.lower().split())
    for a, b in _ROUGH:
        s = s.replace(a, b)
    return s.translate(_CLASSES)


_STOPS = re.compile(r"[.,;:?!\t=]").search
_LEFT_NUMBER = re.compile(r"[-–—(\[]?\s*[\dlIOoSBi|!ivxlcdmIVXLCDM]{1,8}(?:\s*[-–—)\]])?\s*[|·•—–\s]").match
_RIGHT_NUMBER = re.compile(r"[|·•—–\s][-–—(\[]?\s*[\dlIOoSBi|!ivxlcdmIVXLCDM]{1,8}(?:\s*[-–—)\]])?\Z").search
_WIDE_GAP = re.compile(r"\s*[|·•—–]\s*\d|\d\s*[|·•—–]|\d\s{2,}|\s{2,}\d").search


def _title(head: str) -> bool:
    """Whether a line is set like a title: all its words but small ones begin with a capital, or with what is read for one."""
    words = head.split()
    if not words or not _capital(words[0]) or _STOPS(head[:-1].replace("!", "i", 1)) or head[-1] in ".,;:":
        return False
    return all(_capital(w) or w.lower().split("’")[0] in _SMALL or len(w) < 3 or "’" in w for w in words)


def _capital(w: str) -> bool:
    return w[0].isupper() or w[0] in "0158“«’'" and not w.isdigit() or w[0] in "li|" and w[1:2].isupper()


@dataclass(slots=True)
class Line:
    """A line with what it is: text, blank, anchor, head or folio."""

    text: str
    kind: str = "text"


def layout(text: str) -> list[Line]:
    """The lines of a text with their kinds. A head comes at least twice in the text, with or without page numbers, or once
    with one; a title that comes once without one is text. Heads that aren't set like titles must also stand at a page's edge,
    and come with a page number somewhere, or end before the line is full wherever they come."""
    lines, folios, heads, plain = [], [], [], []
    for raw in text.split("\n"):
        s = raw.strip(" \t\r\f")
        if not s:
            lines.append(Line(raw, "anchor" if "\f" in raw else "blank"))
            continue
        line = Line(raw)
        lines.append(line)
        first, last = s[0], s[-1]
        if (first == "=" or "\f" in raw or first in "-[") and ANCHOR(s):
            line.kind = "anchor"
            continue
        if (len(s) <= 14 or "  " in s and len(s) - s.count(" ") <= 14) and _FOLIO(s):
            folios.append(line)
            continue
        if last in ".,;" or last == "-" and s[-2:-1] != " ":
            continue
        m = _HEAD_LEFT(s) if not first.isalpha() or first in "ivxlcdmIVXLCDlOoSB" and _LEFT_NUMBER(s) else None
        if m is None or not _title(m["h"]) or m["h"][:1].islower():
            right = _HEAD_RIGHT(s) if not last.isalpha() or last in "ivxlcdmIVXLCDMlOoSB" and _RIGHT_NUMBER(s) else None
            m = right if right is not None or m is None or not m["h"][:1].isupper() else m
        if m is not None and len(m["h"]) > 3 and len(m["h"].split()) > 1 and not any(c.isdigit() and c not in "0158" for c in m["h"]):
            h = m["h"]
            if _title(h):
                heads += [(line, rough(h), True), (line, rough(s), False)]
                continue
            if h[0].isupper() and not _STOPS(h):
                plain.append((len(lines) - 1, rough(h), True, s))
                continue
        if first.isupper() or not first.isalpha():
            if _title(s):
                heads.append((line, rough(s), False))
            elif first.isupper() and not _STOPS(s):
                plain.append((len(lines) - 1, "", False, s))
    times: Counter = Counter()
    for key, _ in {(key, id(line)) for line, key, _ in heads}:
        times[key] += 1
    for line, key, numbered in heads:
        if len(key) > 3 and (times[key] > 1 or numbered):
            line.kind = "head"
    for line in folios:
        line.kind = "folio"
    if plain:
        _plain_heads(lines, plain)
    return lines


def _plain_heads(lines: list[Line], plain: list[tuple[int, str, bool, str]]) -> None:
    """Marks the heads among lines that begin with a capital and have no stops: place, key, whether with a number, and the line."""
    kinds = [x.kind for x in lines]
    edge = lambda i: i == 0 or i == len(kinds) - 1 or kinds[i - 1] != "text" or kinds[i + 1] != "text"
    plain = [(i, key or rough(s), numbered, s) for i, key, numbered, s in plain if edge(i)]
    times = Counter(key for _, key, _, _ in plain)
    numbered_keys = {key for _, key, numbered, _ in plain if numbered and times[key] > 1}
    width = 0
    for i, key, numbered, s in plain:
        if times[key] < 2:
            if numbered and _WIDE_GAP(s):
                lines[i].kind = "head"
            continue
        if key not in numbered_keys:
            if not width:
                width = max((len(x.text.strip()) for x in lines if x.kind == "text"), default=0)
            after = next((x.text.split() for x in lines[i + 1 :] if x.kind == "text"), None)
            if after is None or len(s.split()) < 2 or len(s) + 1 + len(after[0]) > 0.8 * width:
                continue
        lines[i].kind = "head"


def _core(chunk: str) -> str:
    return chunk.strip(_EDGE)


class Grams:
    """Log chances of the characters of words, by their last three: n-grams of the corpus's different words."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.total = sum(n for g, n in counts.items() if len(g) == 1) or 1
        self.memory: dict[str, float] = {}

    def __getstate__(self) -> dict[str, int]:
        return self.counts

    def __setstate__(self, counts: dict[str, int]) -> None:
        self.__init__(counts)

    def chance(self, gram: str) -> float:
        """Chance of a gram's last character after the others, each order leaning on the shorter one."""
        if len(gram) == 1:
            return (self.counts.get(gram, 0) + 0.01) / (self.total + 10)
        n = self.counts.get(gram[:-1], 0)
        return (self.counts.get(gram, 0) + 2.0 * self.chance(gram[1:])) / (n + 2.0)

    def logs(self, word: str, begin: int = 0, end: int | None = None) -> list[float]:
        """Log chance of each character of a folded word between marks, the end mark's being the last; or of those from begin
        to before end."""
        s, memory, out = f"\2{word}\3", self.memory, []
        for i in range(begin + 2, len(s) + 1 if end is None else min(end + 2, len(s) + 1)):
            gram = s[max(0, i - 4) : i]
            log = memory.get(gram)
            if log is None:
                if len(memory) > 500_000:
                    memory.clear()
                log = memory[gram] = math.log(self.chance(gram))
            out.append(log)
        return out

    @staticmethod
    def folded(word: str) -> str:
        """word in small letters, but for capitals inside, which no word has."""
        return word.lower() if word.isupper() else word[:1].lower() + word[1:]

    @staticmethod
    def of(words: Iterable[str]) -> Counter:
        """How often words have each gram of one to four characters. Marks at the ends count only as a word's beginning."""
        out: Counter = Counter()
        for w in words:
            s = f"\2{w}\3"
            out.update(s[i : i + n] for n in (1, 2, 3, 4) for i in range(len(s) - n + 1))
        return out


@dataclass
class Channel:
    """Words and pairs of the corpus, and how often characters are confused."""

    words: dict[str, int]
    total: float
    granted: dict[str, int]  # files of the older collection that hold a word of its lexicon
    pairs: tuple[np.ndarray, np.ndarray] | dict[tuple[str, str], int] = field(default_factory=dict)
    chance: dict[tuple[str, str], float] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    kept: float = 0.0  # occurrences from which on words are in words
    rest: Rest | None = None  # the other words "w", the parts of words "l", "r" and "c", the lexicon's words "g" and their parts "a"
    rest_pairs: Rest | None = None  # the other pairs "p"
    rest_shapes: RestText | None = None  # the other words by their shape

    def __post_init__(self) -> None:
        self.attested: dict[str, int] = {}  # the parts of a compound are known as often as it is
        for word, files in self.granted.items():
            for part in {word, *word.split("-")}:
                self.attested[part] = max(self.attested.get(part, 0), files)
        self.fine: set[str] = set()
        self.memory: dict[str, list[tuple[str, float]]] = {}
        self.word_memory: dict[str, list[tuple[str, float]]] = {}
        self.rest_memory: dict[str, int] = {}
        self._prefixes: tuple[Counter, Counter] | None = None
        self.model = Grams(self.grams)
        self.confusions = list(self.chance) or list(CONFUSIONS)
        self.log = {pair: math.log(self.chance.get(pair, PRIOR)) for pair in self.confusions}
        self.by_read: dict[str, list[tuple[str, str, str, float]]] = {}
        for (read, printed), log in self.log.items():
            self.by_read.setdefault(read[0], []).append((read, printed, printed.lower(), log))
        self.greatest = max(self.log.values())
        self.last = ("", 0.0)  # the word that was last asked for by unknown
        # confusions that change the shape are tried one by one before words are looked up by it
        self.loose = [(r, p) for r, p in self.confusions if r.lower().translate(_SHAPE) != p.lower().translate(_SHAPE)]
        self.shapes: dict[str, list[str]] = {}
        for w in self.words.keys() | self.granted.keys():
            self.shapes.setdefault(w.translate(_SHAPE), []).append(w)
        if isinstance(self.pairs, dict):
            self.ids, self.codes, self.times = {}, None, None
        else:
            self.ids = {w: i for i, w in enumerate(self.words)}
            self.codes, self.times = self.pairs

    def __getstate__(self) -> tuple:
        return self.words, self.total, self.granted, self.pairs, self.chance, self.grams, self.kept, self.rest, self.rest_pairs, self.rest_shapes

    def __setstate__(self, state: tuple) -> None:
        self.words, self.total, self.granted, self.pairs, self.chance, self.grams, self.kept, self.rest, self.rest_pairs, self.rest_shapes = state
        self.__post_init__()

    def looked_up(self, key: str) -> int:
        """The number of a key that isn't in memory."""
        rest = self.rest_pairs if key[0] == "p" else self.rest
        if rest is None:
            return 0
        n = self.rest_memory.get(key)
        if n is None:
            if len(self.rest_memory) > 500_000:
                self.rest_memory.clear()
            n = self.rest_memory[key] = rest(key)
        return n

    def pair(self, before: str, word: str) -> int:
        if self.codes is None:
            n = self.pairs.get((before, word), 0)
        else:
            a, b, n = self.ids.get(before, -1), self.ids.get(word, -1), 0
            if a >= 0 and b >= 0:
                code = a << 32 | b
                i = int(self.codes.searchsorted(code))
                n = int(self.times[i]) if i < len(self.codes) and self.codes[i] == code else 0
        return n or (self.looked_up(f"p{before} {word}") if self.rest_pairs else 0)

    def occurrences(self, word: str) -> int:
        return self.words.get(word) or (self.looked_up("w" + word) if self.rest else 0)

    def is_granted(self, word: str) -> bool:
        return word in self.granted or bool(self.rest and self.looked_up("g" + word))

    def files(self, word: str) -> int:
        """Files of the older collection that hold a word or a compound of it."""
        return self.attested.get(word) or (self.looked_up("a" + word) if self.rest else 0)

    def known(self, word: str) -> bool:
        return word in self.words or word in self.granted or bool(self.rest and (self.looked_up("w" + word) or self.looked_up("g" + word)))

    def count(self, word: str) -> float:
        return self.occurrences(word) or (1.0 if self.is_granted(word) else 0.0)

    def alike(self, low: str) -> list[str]:
        """The known words of a word's shape."""
        shape = low.translate(_SHAPE)
        out = self.shapes.get(shape, [])
        if self.rest_shapes is not None and (more := self.rest_shapes.text(shape)):
            out = list({*out, *more.split(" ")})
        return out

    def explained(self, read: str, word: str) -> tuple[float, str, list[tuple[str, str]]] | None:
        """The best way by which word (in small letters) may be read as read, in any number of confusions: its log chance, the
        word with the capitals that stand there, and the confusions. None if there is none."""
        n, m = len(read), len(word)
        best: dict[tuple[int, int], tuple[float, str, list]] = {(0, 0): (0.0, "", [])}
        heap = [(0, 0)]
        while heap:
            at = heappop(heap)
            i, j = at
            log, form, how = best.pop(at)
            if i == n:
                if j == m:
                    return log, form, how
                continue
            steps = []
            if j < m and read[i].lower() == word[j]:
                steps.append((i + 1, j + 1, log, form + read[i], how))
            for r, p, low, chance in self.by_read.get(read[i], ()):
                if word.startswith(low, j) and read.startswith(r, i):
                    steps.append((i + len(r), j + len(p), log + chance, form + p, [*how, (r, p)]))
            for x, y, *state in steps:
                if m - y > 2 * (n - x) or n - x > 2 * (m - y):
                    continue
                old = best.get((x, y))
                if old is None:
                    heappush(heap, (x, y))
                if old is None or state[0] > old[0]:
                    best[x, y] = tuple(state)
        return None

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """Known words that word may be a misreading of, with the log chance of their confusions, however many."""
        low = word.lower()
        found: dict[str, float] = {}
        wanted = [v for v in self.alike(low) if v != low]
        for read, printed in self.loose:
            at = word.find(read)
            while at >= 0:
                wanted += [v for v in self.alike((word[:at] + printed + word[at + len(read) :]).lower()) if v != low]
                at = word.find(read, at + 1)
        for v in wanted:
            if v.isalpha() and (hit := self.explained(word, v)) and hit[1] != word:
                found[hit[1]] = max(hit[0], found.get(hit[1], -99.0))
        return list(found.items())

    def unknown(self, word: str) -> float:
        """Log chance of a word that the corpus doesn't know."""
        if not word.replace("’", "").replace("-", "").isalpha():
            return math.log(NEW_SIGNS)
        if self.last[0] != word:
            log = math.log(NEW_NAME if word[0].isupper() and not word.isupper() else NEW_WORD)
            # a long word, or one unlike the language's, is the less probable for being a certain one among all new ones
            self.last = word, min(log, math.log(NEW) + sum(self.model.logs(self.model.folded(word)))) if self.grams else log
        return self.last[1]

    def readings(self, chunk: str) -> list[tuple[str, float]]:
        """Readings of a piece between spaces that are better than, or near, the one that stands there: the reading and its
        advantage in log chance. Empty where the piece is fine as it is."""
        if chunk in self.memory:
            return self.memory[chunk]
        out = self._readings(chunk)
        if len(self.memory) > 300_000:
            self.memory.clear()
            self.fine.clear()
        self.memory[chunk] = out
        if not out:
            self.fine.add(chunk)
        return out

    def _readings(self, chunk: str) -> list[tuple[str, float]]:
        core = chunk.strip(_EDGE)
        start = chunk.find(core)
        if start > 0 and chunk[start - 1] == "!" and len(core) > 1:
            start, core = start - 1, "!" + core
        if start > 0 and chunk[start - 1] == "|" and len(core) > 1:
            start, core = start - 1, "|" + core
        if start + len(core) < len(chunk) and chunk[start + len(core)] in "|" and len(core) > 2:
            core += chunk[start + len(core)]
        if len(core) < 2 or core.isdigit():
            return []
        out = []
        at = start
        for part in re.split(r"([’'\-–—/.,])", core):
            if len(part) > 1 and not part.isdigit():
                for reading, gain in self._word(part):
                    out.append((chunk[:at] + reading + chunk[at + len(part) :], gain))
            at += len(part)
        return out

    def _word(self, word: str) -> list[tuple[str, float]]:
        out = self.word_memory.get(word)
        if out is None:
            if len(self.word_memory) > 300_000:
                self.word_memory.clear()
            out = self.word_memory[word] = self._new_word(word)
        return out

    def _new_word(self, word: str) -> list[tuple[str, float]]:
        low = word.lower()
        if not any(c.isalpha() for c in word):
            return []
        n, files = self.occurrences(low), self.files(low)
        out = []
        if not word.isalpha():
            letters = sum(c.isalpha() for c in word)
            figures = sum(c.isdigit() for c in word)
            if figures and len(word) > 2 and (number := word.translate(_AS_FIGURES)).isdigit():
                gain = math.log(NEW_NUMBER) + sum(self.log.get((a, b), math.log(PRIOR)) for a, b in zip(word, number) if a != b) - self.unknown(word)
                return [(number, gain)] if gain > -4.0 else []
            if figures > 1 and letters <= figures or any(c not in "0156890!+|" and not c.isalpha() for c in word):
                return []
        for form, log in self.candidates(word):
            other = self.count(form.lower())
            # a word that is known itself is a misreading only if the confusion explains how often it stands there, in this
            # collection and the older one; else the pairs must outweigh its own frequency
            explained = n + files <= 3 * (other + self.files(form.lower())) * math.exp(log) + 2 * (bool(n) + bool(files))
            gain = math.log(other / self.total) + log - (self.unknown(word) if explained else math.log(max(n, files) / self.total))
            if gain > (-4.0 if explained else -8.0):
                out.append((form, gain))
        if not n and not files and (not out or max(gain for _, gain in out) < 0):
            out += self._unheard(word)
        return out

    def _unheard(self, word: str) -> list[tuple[str, float]]:
        """The reading of a word that the corpus doesn't know whose printed form is unknown too, if there is a better one: the
        same channel, with n-grams of characters in place of the word's frequency."""
        if not self.grams or len(word) < 4:
            return []
        form, total = word, 0.0
        fold = self.model.folded
        while True:
            costs = list(accumulate((-x for x in self.model.logs(fold(form))), initial=0.0))
            n, upper = len(costs) - 1, form.isupper()
            best: tuple[float, str] | None = None
            for i, c in enumerate(form):
                # what a change can gain is at most what its surroundings cost
                if costs[min(i + 5, n)] - costs[i] + self.greatest < UNHEARD or c not in self.by_read:
                    continue
                for read, printed, _, log in self.by_read[c]:
                    if costs[min(i + len(read) + 3, n)] - costs[i] + log < UNHEARD or not form.startswith(read, i):
                        continue
                    new = form[:i] + printed + form[i + len(read) :]
                    if new.isupper() == upper:  # only the characters that the change touches, and three after them
                        gain = sum(self.model.logs(fold(new), i, i + len(printed) + 3)) + costs[min(i + len(read) + 3, n)] - costs[i] + log
                    else:
                        gain = sum(self.model.logs(fold(new))) + costs[n] + log
                    if gain > UNHEARD and (best is None or gain > best[0]):
                        best = gain, new
            if best is None:
                break
            total, form = total + best[0], best[1]
        return [(form, total)] if form != word and form.isalpha() else []

    def prefixes(self) -> tuple[Counter, Counter]:
        """Of the words in memory: how many known words begin (or, with a - before it, end) with a part, the rest being a word too; and how many
        known compounds have it before (or after) their hyphen."""
        if self._prefixes is None:
            whole, cut = Counter(), Counter()
            for w in self.words:
                head, _, tail = w.partition("-")
                if tail:
                    cut[head] += 1
                    cut["-" + tail] += 1
                    continue
                for i in range(2, len(w) - 2):
                    if w[i:] in self.words:
                        whole[w[:i]] += 1
                        if i > 2 and w[:i] in self.words:
                            whole["-" + w[i:]] += 1
            self._prefixes = whole, cut
        return self._prefixes

    def joined(self, a: str, b: str) -> str:
        """hyphen if a and b, cut at a line's end, are one word without the hyphen; compound if the hyphen is the word's own."""
        a, b = a.lower(), b.lower()
        one, two = self.count(a + b), self.count(f"{a}-{b}")
        if one or two:
            return "hyphen" if one >= two else "compound"
        if not (self.count(a) and self.count(b)) or min(len(a), len(b)) < 3:
            return "hyphen"
        whole, cut = self.prefixes()
        of_cut = cut[a] + cut["-" + b] + self.looked_up("c" + a) + self.looked_up("c-" + b)
        return "compound" if of_cut > whole[a] + whole["-" + b] + self.looked_up("l" + a) + self.looked_up("r" + b) else "hyphen"

    def transition(self, before: str, word: str) -> float:
        n = self.occurrences(before) if before else 0
        pair = self.pair(before, word) / n if n else 0.0
        single = max(self.count(word), 0.01) / self.total
        return math.log(PAIR_WEIGHT * pair + (1 - PAIR_WEIGHT) * single) - math.log(single)

    def decode(self, chunks: list[str], left: list[str] | None = None, right: list[str] | None = None) -> list[str]:
        """The most probable reading of a line: Viterbi over the candidate readings of its pieces. left and right are what stands
        before and after it."""
        wide, shift = [*(left or []), *chunks, *(right or [])], len(left or [])
        fine, out, i = self.fine, list(chunks), 0
        # fragments of a split word aren't misread
        options = {k: more for k, c in enumerate(chunks) if c not in fine and (more := self.readings(c)) and not self._split(wide, k + shift)}
        while i < len(chunks):
            if i not in options:
                i += 1
                continue
            # pieces with readings in a row, between two that are as they are
            states, begin = [(0.0, [_core(chunks[i - 1]).lower()] if i else [""], [])], i
            while i < len(chunks):
                new = []
                for reading, gain in [(chunks[i], 0.0), *options.get(i, ())]:
                    word = _core(reading).lower()
                    new.append(max(((log + gain + (self.transition(words[-1], word) if words[-1] else 0.0), [*words, word], [*taken, reading]) for log, words, taken in states), key=lambda s: s[0]))
                states = new
                i += 1
                if i - 1 not in options:
                    break
            best = max(states, key=lambda s: s[0])[2]
            out[begin : begin + len(best)] = best
        return out

    def _split(self, chunks: list[str], i: int) -> bool:
        """Whether a piece is a part of a word that was split in two to four, by what stands around it."""
        near = [_core(c).lower() for c in chunks[max(0, i - 3) : i + 4]]
        at = min(i, 3)
        if not near[at].isalpha():
            return False
        for a in range(max(0, at - 3), at + 1):
            for b in range(at + 1, min(a + 4, len(near)) + 1):
                if b - a > 1 and (word := "".join(near[a:b])) and len(word) > 4 and self.known(word):
                    return True
        return False


_AS_FIGURES = str.maketrans({"l": "1", "I": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "b": "6", "i": "1", "!": "1", "|": "1", "q": "9", "Z": "2"})


@dataclass(slots=True)
class Reading:
    """A line of text: its place among the lines, its pieces as they stand and as they are read. A word cut at the line's end is
    its last piece as a whole, cut after so many characters; what stood of it in the next line isn't among that one's pieces."""

    place: int
    pieces: list[str]
    read: list[str]
    cut: int = 0
    following: int = -1  # place of the line that the rest of the cut word stands in
    compound: bool = False  # the last piece is cut after a hyphen of its own


def read_lines(lines: list[Line], channel: Channel, every: bool = True) -> Iterator[Reading]:
    """The lines of a layout's text as the channel reads them, each by Viterbi with its neighbours beside it; without every, only
    those that are cut or may be misread."""
    bodies = [(i, line.text.split()) for i, line in enumerate(lines) if line.kind == "text"]
    carried, fine = False, channel.fine
    for k, (i, pieces) in enumerate(bodies):
        after = bodies[k + 1][1] if k + 1 < len(bodies) else []
        if carried:
            pieces = pieces[1:]
        carried, cut, compound = False, 0, False
        if pieces and after and pieces[-1][-1] == "-" and (m := _LAST(pieces[-1])) and (n := _FIRST(after[0])):
            if channel.joined(m[1], n[1]) == "hyphen":
                cut, carried = len(pieces[-1]) - 1, True
                pieces = [*pieces[:-1], pieces[-1][:-1] + after[0]]
            else:
                compound = True
        if not fine.issuperset(pieces) and any(channel.readings(c) for c in pieces if c not in fine):
            read = channel.decode(pieces, bodies[k - 1][1][-3:] if k else [], after[carried : carried + 3])
        elif every or cut:
            read = pieces
        else:
            continue
        yield Reading(i, pieces, read, cut, bodies[k + 1][0] if cut else -1, compound)


def faults(text: str, channel: Channel) -> Iterator[tuple[int, str]]:
    """Line numbers from 1 and faults of a prose text."""
    lines = layout(text)
    for i, line in enumerate(lines):
        if line.kind in ("head", "folio"):
            yield i + 1, line.kind
    misread: set[int] = set()
    for r in read_lines(lines, channel, every=False):
        if r.cut:
            yield r.place + 1, "hyphen"
        if r.read is r.pieces or r.read == r.pieces:
            continue
        wrong = [a != b for a, b in zip(r.pieces, r.read)]
        if r.cut and wrong.pop():
            piece, new = r.pieces[-1], r.read[-1]
            same = next((i for i, (a, b) in enumerate(zip(piece, new)) if a != b), min(len(piece), len(new)))
            end = next((i for i, (a, b) in enumerate(zip(piece[::-1], new[::-1])) if a != b), 0)
            if same < r.cut:
                misread.add(r.place)
            if len(piece) - end > r.cut:
                misread.add(r.following)
        if any(wrong):
            misread.add(r.place)
    yield from ((i + 1, "misread") for i in sorted(misread))


def repaired(text: str, channel: Channel) -> str:
    """Continuous paragraphs of a prose text: without heads, page numbers and anchors, cut words whole, misread ones put right.
    A paragraph goes on over a page's end if it stops without an end mark there."""
    lines = layout(text)
    read = {r.place: r for r in read_lines(lines, channel)}
    paragraphs: list[list[str]] = [[]]
    furniture = blank = compound = False
    for i, line in enumerate(lines):
        if line.kind != "text":
            furniture |= line.kind != "blank"
            blank |= line.kind == "blank"
            continue
        words, last = list(read[i].read), paragraphs[-1]
        open_ = bool(last) and (compound or last[-1][-1] not in ".!?…:”»\"’)")
        if last and words and (blank or furniture) and not (furniture and open_) and (blank or not open_) and not compound:
            last = []
            paragraphs.append(last)
        furniture = blank = False
        if compound and words:
            words[0] = last.pop() + words[0]
        compound = read[i].compound
        last += words
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


# -- the corpus ---------------------------------------------------------------------------------------------------------


def _words_of(text: str) -> list[str]:
    """Words of a text for counting; pieces cut at a line's end are left out with what follows them."""
    out: list[str] = []
    skip = False
    for line in text.split("\n"):
        chunks = line.split()
        if not chunks:
            continue
        if skip:
            del chunks[0]
        skip = bool(chunks) and chunks[-1][-1] == "-" and len(chunks[-1]) > 1
        if skip:
            del chunks[-1]
        out += chunks
    return out


def _count_words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    raw: Counter = Counter()

    def out() -> pd.DataFrame:
        clean: Counter = Counter()
        for chunk, n in raw.items():
            core = _core(chunk).lower()
            if core:
                for part in {core, *core.split("’"), *(core.split("-") if core.count("-") == 1 else ())}:
                    if part and part.replace("-", "a").replace("’", "a").isalpha():
                        clean[part] += n
        return pd.DataFrame({"w": list(clean), "n": list(clean.values())})

    for batch in batches:
        for text in batch["text"]:
            if text:
                raw.update(_words_of(text))
            if len(raw) > 1_000_000:
                yield out()
                raw.clear()
    yield out()


#: Words whose pairs are made up at once.
BLOCK = 1_000_000


class _PairCounter:
    """Pairs of known words, and confusions in words with one reading: kind, a, b, n."""

    def __init__(self, channel: Channel) -> None:
        self.channel = channel
        self.names = list(channel.words)
        self.known = {w: i for i, w in enumerate(self.names)}
        self.forget()

    def forget(self) -> None:
        """Empties the memory of pieces; piece 0 is the end of a text."""
        self.ids: dict[str, int] = {"": 0}
        self.word, self.odd = [-1], [False]
        self.codes: list[int] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.names = self.names[: len(self.channel.words)]
        self.known = {w: i for w, i in self.known.items() if i < len(self.names)}

    def add(self, text: str) -> None:
        chunks = _words_of(text)
        for chunk in set(chunks).difference(self.ids):
            core = _core(chunk).lower()
            i = self.known.get(core, -1)
            if i < 0 and self.channel.rest and self.channel.looked_up("w" + core):
                i = self.known[core] = len(self.names)
                self.names.append(core)
            self.ids[chunk] = len(self.word)
            self.word.append(i)
            # known words may be frequent misreadings of far more frequent ones
            self.odd.append(i < 0 or bool(_confusions(self.channel, {chunk: 1})))
        self.codes += map(self.ids.__getitem__, chunks)
        self.codes.append(0)

    def flush(self, printed: Counter) -> None:
        """Counts the pairs and confusions of what was added."""
        code = np.array(self.codes, np.int64)
        self.codes = []
        times = np.bincount(code, minlength=len(self.word))
        chunks = list(self.ids)
        printed.update(_confusions(self.channel, {chunks[i]: int(times[i]) for i in np.nonzero(np.array(self.odd) & (times > 0))[0]}))
        word = np.array(self.word, np.int64)[code]
        both = (word[:-1] >= 0) & (word[1:] >= 0)
        self.pairs.append(np.unique(word[:-1][both] << 32 | word[1:][both], return_counts=True))
        if len(self.pairs) >= 16:
            self.pairs = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([k for k, _ in self.pairs]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([c for _, c in self.pairs]), len(keys)).astype(np.int64)

    def frame(self) -> pd.DataFrame:
        keys, n = self.merged()
        names = np.array(self.names, object)
        return pd.DataFrame({"kind": "pair", "a": names[keys >> 32], "b": names[keys & 0xFFFFFFFF], "n": n})


def _count_pairs(channel: Channel, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counter, printed = _PairCounter(channel), Counter()
    for batch in batches:
        for text in batch["text"]:
            if text:
                counter.add(text)
            if len(counter.codes) > BLOCK:
                counter.flush(printed)
                if len(counter.ids) > 500_000:
                    yield counter.frame()
                    counter.forget()
    counter.flush(printed)
    yield counter.frame()
    yield pd.DataFrame([("confusion", a, b, n) for (a, b), n in printed.items()], columns=["kind", "a", "b", "n"])


def _confusions(channel: Channel, odd: dict[str, int]) -> Counter:
    """How often each confusion explains the pieces of odd: those with one reading that is far more frequent, and that the older
    collection doesn't know. However often a misreading comes, it counts, so that larger collections give the same chances."""
    out: Counter = Counter()
    for chunk, n in odd.items():
        core = _core(chunk)
        if len(core) < 4 or not (core.islower() or not core.isalpha()):
            continue
        low = core.lower()
        alike = channel.alike(low)
        if len(alike) < 2 and (not alike or alike[0] == low) or channel.is_granted(core):
            continue
        times = max(n, channel.occurrences(low))
        found: dict[str, tuple[str, str]] = {}
        for v in alike:
            if v != low and v.isalpha() and channel.count(v) > 50 * times and (hit := channel.explained(core, v)) and len(hit[2]) == 1:
                found.setdefault(v, hit[2][0])
        if len(found) == 1:
            out[next(iter(found.values()))] += n
    return out


def _shaped(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"key": [w.translate(_SHAPE) for w in batch["w"]], "w": batch["w"]})


def _word_facts(words: DataFrame, bound: float) -> DataFrame:
    """key and n of the words (w, n) under the bound, "w", and what they add to the counts by part of Channel.prefixes: "l" and
    "r" the two parts of words, "c" those of compounds."""
    words = words.withColumn("rare", F.col("n") < bound)
    rare = words.where("rare")
    parts = words.where("not contains(w, '-') and length(w) > 4").select("rare", "w", F.explode(F.sequence(F.lit(2), F.length("w") - 3)).alias("i"))
    parts = parts.select("rare", "i", F.expr("substring(w, 1, i)").alias("head"), F.expr("substring(w, i + 1)").alias("tail"))
    parts = parts.join(words.select(F.col("w").alias("tail"), F.col("rare").alias("rare_tail")), "tail")
    parts = parts.join(words.select(F.col("w").alias("head"), F.col("rare").alias("rare_head")), "head", "left")
    left = parts.where("rare or rare_tail").select(F.concat(F.lit("l"), "head").alias("key"))
    right = parts.where("i > 2 and rare_head is not null and (rare or rare_tail or rare_head)").select(F.concat(F.lit("r"), "tail").alias("key"))
    cut = rare.where("contains(w, '-')").select(F.expr("substring(w, 1, instr(w, '-') - 1)").alias("head"), F.expr("substring(w, instr(w, '-') + 1)").alias("tail")).where("tail <> ''")
    cut = cut.select(F.explode(F.array(F.concat(F.lit("c"), "head"), F.concat(F.lit("c-"), "tail"))).alias("key"))
    keys = left.unionByName(right).unionByName(cut)
    return rare.select(F.concat(F.lit("w"), "w").alias("key"), "n").unionByName(keys.groupBy("key").agg(F.count("*").alias("n")))


def learned_confusions(words: DataFrame, granted: DataFrame) -> list[tuple[str, str]]:
    """Confusions that the words (w, n) show and the list doesn't have: what stands in place of what in rare words that are, but
    for that place inside them, the most frequent word of their frame, in LEARNED_WORDS different words or more. Words of granted
    (w) are right as they are. At most as many as there are pairs of two letters; a handful in practice."""
    plain = words.where("length(w) > 4 and not contains(w, '-') and not contains(w, '’')")

    def framed(df: DataFrame) -> DataFrame:
        spans = df.select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w") - 2)).alias("i")).select("w", "n", "i", F.explode(F.array(F.lit(1), F.lit(2))).alias("l")).where("i + l < length(w)")
        return spans.select("w", "n", F.expr("concat(substring(w, 1, i), '\\u0001', substring(w, i + l + 1))").alias("frame"), F.expr("substring(w, i + 1, l)").alias("sub"))

    frequent = framed(plain.where(F.col("n") >= LEARNED_RATIO)).groupBy("frame").agg(F.max_by(F.struct("w", "sub", "n"), F.struct("n", "w")).alias("best"))
    frequent = stored(frequent)
    rare = framed(plain.join(granted.select("w"), "w", "left_anti"))
    hits = rare.join(small_side(frequent, frequent.count()), "frame").where(F.col("best.n") >= F.col("n") * LEARNED_RATIO).select("w", F.col("sub").alias("read"), F.col("best.sub").alias("printed"))
    edges = "left(read, 1) <> left(printed, 1) and right(read, 1) <> right(printed, 1)"
    found = hits.where(edges).groupBy("read", "printed").agg(F.countDistinct("w").alias("n")).where(F.col("n") >= LEARNED_WORDS).orderBy("read", "printed").collect()
    return [(r["read"], r["printed"]) for r in found if (r["read"], r["printed"]) not in CONFUSIONS]


def _grams(words: DataFrame) -> dict[str, int]:
    """The n-grams of one to four characters of the different words (w), those of a share of one in GRAMS or more."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(Grams.of(p for w in batch["w"] for p in re.split("[-’]", w) if p))
        yield pd.DataFrame({"g": list(counts), "n": list(counts.values())})

    grams = stored(words.select("w").mapInPandas(filled(run), "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n")))
    total = grams.where("length(g) = 1").agg(F.sum("n").alias("n")).first()["n"] or 0
    kept = grams.where(F.col("n") >= total / GRAMS).toPandas()
    return dict(zip(kept["g"], kept["n"].astype(int).tolist()))


def channel_of(spark: SparkSession, texts: DataFrame, lexicon: DataFrame) -> Channel:
    """The channel of a corpus (text) and of an older lexicon (w, df)."""
    older = stored(lexicon.where((F.col("df") >= LEXICON_FILES) & F.col("w").isNotNull()).groupBy(F.lower("w").alias("w")).agg(F.max("df").cast("bigint").alias("n")))
    words = stored(texts.mapInPandas(filled(_count_words), "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")))
    known = words.where(F.col("n") >= LEAST)
    sizes = words.agg(F.sum("n").alias("total"), F.count_if(F.col("n") >= LEAST).alias("known")).first()
    total = sizes["total"] or 1
    bound = float(LEAST) if sizes["known"] <= WORDS_IN_MEMORY else max(LEAST, total / WORDS_IN_MEMORY)
    few = older.count() <= WORDS_IN_MEMORY
    kept = known.where(F.col("n") >= bound).toPandas()
    granted = {r["w"]: r["n"] for r in older.collect()} if few else {}
    facts, shapes = [], []
    if bound > LEAST:
        facts.append(_word_facts(known, bound))
        shapes.append(known.where(F.col("n") < bound).select("w"))
    if not few:
        parts = older.select("n", F.explode(F.array_distinct(F.concat(F.array("w"), F.split("w", "-")))).alias("w")).groupBy("w").agg(F.max("n").alias("n"))
        facts += [older.select(F.concat(F.lit("g"), "w").alias("key"), "n"), parts.select(F.concat(F.lit("a"), "w").alias("key"), "n")]
        shapes.append(older.select("w"))
    rest = Rest.of(spark, reduce(DataFrame.unionByName, facts)) if facts else None
    by_shape = RestText.of(spark, reduce(DataFrame.unionByName, shapes).distinct().mapInPandas(filled(_shaped), "key string, w string").groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("w")), " ").alias("value"))) if shapes else None
    confusions = [*CONFUSIONS, *learned_confusions(words, older)]
    channel = Channel(dict(zip(kept["w"], kept["n"].astype(int).tolist())), float(total), granted, {}, dict.fromkeys(confusions, PRIOR), _grams(words), bound, rest, None, by_shape)
    sent = spark.sparkContext.broadcast(channel)
    pairs = stored(texts.mapInPandas(filled(lambda it: _count_pairs(sent.value, it)), "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).where(f"kind = 'confusion' or n >= {LEAST}"))
    both = pairs.where("kind = 'pair'")
    many = both.count()
    least = max(bound, LEAST if many <= PAIRS_IN_MEMORY else total / PAIRS_IN_MEMORY)
    frequent = both.where(F.col("n") >= least).select("a", "b", "n").toPandas()
    ids = {w: i for i, w in enumerate(channel.words)}
    codes = frequent["a"].map(ids).to_numpy(np.int64) << 32 | frequent["b"].map(ids).to_numpy(np.int64)
    order = np.argsort(codes)
    rest_pairs = Rest.of(spark, both.where(F.col("n") < least).select(F.concat(F.lit("p"), "a", F.lit(" "), "b").alias("key"), "n")) if len(frequent) < many else None
    seen = {(r["a"], r["b"]): r["n"] for r in pairs.where("kind = 'confusion'").collect()}
    signs = sorted({p for _, p in confusions})
    times = [F.coalesce(F.sum(F.col("n") * (F.length("w") - F.length(F.replace("w", F.lit(p.lower())))) / len(p)), F.lit(0.0)) for p in signs]
    letters = dict(zip(signs, known.agg(*times).first()))
    chance = {(r, p): (seen.get((r, p), 0) + PRIOR * PRIOR_WEIGHT) / (letters[p] + PRIOR_WEIGHT) for r, p in confusions}
    return replace(channel, pairs=(codes[order], frequent["n"].to_numpy(np.int64)[order]), chance=chance, rest_pairs=rest_pairs)


def _channel(spark: SparkSession, parts: list[DataFrame], lexicon: DataFrame) -> tuple[DataFrame, Channel]:
    files = once_each(parts)
    return files, channel_of(spark, files.select("text"), lexicon)


def _of_prose(spark: SparkSession, parts: list[DataFrame], lexicon: DataFrame, common_words: DataFrame, work: Callable[[str, Channel], Iterable[tuple]], schema: str) -> DataFrame:
    """file_id and what work gives of each prose file."""
    files, channel = _channel(spark, parts, lexicon)
    sent, words = spark.sparkContext.broadcast(channel), spark.sparkContext.broadcast(common_set(common_words))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield [(i, *row) for i, t in zip(batch["file_id"], batch["text"]) if form_of(t, words.value) == "prose" for row in work(t, sent.value)]

    return map_rows(files, run, schema)


def line_faults(spark: SparkSession, parts: list[DataFrame], lexicon: DataFrame, common_words: DataFrame) -> DataFrame:
    """file_id, line_no and fault of each line of the prose files of all parts (file_id, text).

    Null, empty and blank texts and files that are no prose have none. A repeated file counts once; rows with a null file_id
    each count. Counts of words, pairs and confusions cover all files."""
    return _of_prose(spark, parts, lexicon, common_words, faults, "file_id bigint, line_no int, fault string")


def repaired_texts(spark: SparkSession, parts: list[DataFrame], lexicon: DataFrame, common_words: DataFrame) -> DataFrame:
    """file_id and text of the prose files of all parts as continuous paragraphs; the rows are those of line_faults."""
    return _of_prose(spark, parts, lexicon, common_words, lambda text, channel: [(repaired(text, channel),)], "file_id bigint, text string")
