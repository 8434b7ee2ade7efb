import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliomend.functions import text as T

ODD = ["", " ", None, "ﬁ eld staﬀ went ﬂ", "a\x1cb\x85c d", "Collège élan über", "x" * 40, "\f===== page 3 =====\n", "一二三 the", "(cid:12) �\x01"]


def column(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", expr.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_tokens_are_runs_of_plain_letters(spark):
    assert column(spark, ["Collège d'été, C3PO", "", None], T.tokens(F.col("text"))) == [["Coll", "ge", "d", "t", "C", "PO"], [], None]
    assert column(spark, ["a bc d"], T.tokens(F.col("text"), 2)) == [["bc"]]


def test_boundaries_know_accented_letters(spark):
    assert column(spark, ["Collège élan über plain_x well"], T.words_at_boundaries(F.col("text"), 3)) == [["well"]]
    assert column(spark, ["well-known fact, a-b, ab-cd-ef, é-xy-ab"], T.hyphenated_words(F.col("text"))) == [["well-known", "ab-cd", "xy-ab"]]


def test_occurrences_do_not_overlap(spark):
    assert column(spark, ["aaaa", "", None], T.occurrences(F.col("text"), "aa")) == [2, 0, None]


def test_ligatures_take_their_space_along(spark):
    want = []
    table = dict(T.LIGATURES)
    for t in ODD:
        want.append(None if t is None else re.sub("([ﬀ-ﬆĲĳ])( (?=\\w))?", lambda m: table.get(m[1], ""), t).replace("", "") if t else t)
    assert column(spark, ODD, T.expand_ligatures(F.col("text"))) == want


def joined(text):
    lines, out = text.split("\n"), []
    for a, b in zip(lines, [*lines[1:], None]):
        words = re.findall(r"\w+", a), re.findall(r"\w+", b or "")
        fine = b is not None and len(a) > 1 and a[-1] == "-" and not a[-2].isspace() and all(words) and words[0][-1].isalnum() and words[1][0].isalnum()
        out.append(a[:-1] if fine else a if b is None else a + "\n")
    return "".join(out)


@pytest.mark.parametrize("seed", range(3))
def test_lines_are_joined_as_by_hand(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["ab", "é", "-", " -", "--", "\n", " ", "x_", "_", "\r\n", "3", "."]) for _ in range(40)) for _ in range(60)] + ["em -\nword", "deliber-\nation", "a-"]
    assert column(spark, texts, T.dehyphenate_lines(F.col("text"))) == [joined(t) for t in texts]


def test_pages_may_be_kept_apart(spark):
    text = "one-\n\f\ntwo-\nthree"
    assert column(spark, [text], T.dehyphenate_lines(F.col("text"), False)) == ["one-\ftwothree"]
    assert column(spark, [None, ""], T.dehyphenate_lines(F.col("text"))) == [None, ""]


def garble(text):
    if not text or not text.strip():
        return (0.0, 0, 0, False)
    solid = [c for c in text if not c.isspace()]
    bad = [c for c in solid if 0xE000 <= ord(c) <= 0xF8FF or ord(c) >= 0xF0000 or c == "�" or ord(c) < 32 or 0x80 <= ord(c) <= 0x9F or unicodedata.category(c) in ("Cn", "Cs")]
    return (len(bad) / len(solid), len(bad), len(solid), bool(re.search(r"\(cid:\d+\)", text)))


def test_garble_counts_what_no_extractor_could_map(spark):
    texts = [*ODD, "a\x9b", "\x0b\x1c \x85"]
    assert [tuple(x) for x in column(spark, texts, T.garble(F.col("text")))] == [garble(t) for t in texts]


def test_separators(spark):
    seps = [" ", "-", "‑", " -", "- ", "-\n", "\n ", "-\n ", " - ", "", "--", ", ", "     "]
    got = [tuple(x) for x in column(spark, seps, T.separator_class(F.col("text")))]
    assert [s for s, (ok, _) in zip(seps, got) if ok] == [" ", "-", "‑", " -", "- ", "-\n", "\n ", "-\n "]


def test_normalised_words(spark):
    texts = ["Fouc&amp;ault’s ﬁeld’ café", "", None, "'s o'"]
    want = ["Fouc&ault's field' cafe", "", None, "'s o'"]
    assert column(spark, texts, T.normalised(F.col("text"))) == want
    assert T.normalise("&lt;é") == html.unescape("&lt;") + "e"
    assert column(spark, texts, T.normal_words(F.col("text"))) == [["Fouc", "ault's", "field", "cafe"], [], None, ["s", "o"]]


def test_heads_pieces_and_furniture(spark):
    text = "12 The Head\nbody The Head here\n  the head 13 \nend"
    rest, n = T.strip_heads(F.col("text"), "The Head")
    assert column(spark, [text], rest) == ["\nbody The Head here\n\nend"] and column(spark, [text], n) == [2]
    piece, fine = T.cut_piece(F.col("text"), "body", "here")
    assert column(spark, [text, "none"], piece) == ["body The Head here", None] and column(spark, [text, "none"], fine) == [True, False]
    assert column(spark, ["# x\n| a | b |\nkeep [l](http://x)"], T.strip_furniture(F.col("text"))) == [" x\n \nkeep [l "]


def test_pairs_of_neighbours(spark):
    got = column(spark, ["a b c", "a", "", None], T.adjacent(T.tokens(F.col("text"))))
    assert [[tuple(p) for p in x] if x else x for x in got][:3] == [[("a", "b"), ("b", "c")], [], []]


def test_german_vote_is_a_majority(spark):
    assert column(spark, ["der die the", "der the", ""], T.is_german(T.lowered(T.tokens(F.col("text"))))) == [True, False, False]


def test_the_dropped_glyph_takes_one_space_with_it(spark):
    g = T.DROPPED_GLYPH
    df = spark.createDataFrame([(f"a{g} b", 1), (f"a{g}  b", 2), (f"a{g} .", 3), (f"{g}", 4)], "t string, i int")
    assert [r["x"] for r in df.orderBy("i").select(T.expand_ligatures(F.col("t")).alias("x")).collect()] == ["ab", "a  b", "a .", ""] and ord(g) == 0xF0A0


def test_words_with_what_stands_after_them(spark):
    df = spark.createDataFrame([("The reader’s arith-\nmetic, e'' go",), ("",), ("..",), ("one",)], "t string")
    got = [[(x["w"], x["sep"]) for x in r["x"]] for r in df.select(T.normalised("t").alias("t")).select(T.normal_words_and_separators(F.col("t")).alias("x")).collect()]
    assert got == [[("The", " "), ("reader's", " "), ("arith", "-\n"), ("metic", ", "), ("e", " "), ("go", "")], [], [], [("one", "")]]
