import itertools

import pytest

from foliomend.llm import consistent as C
from foliomend.llm import forms

BASE = "The catalogue of Pelshick was read in the café; “fine” office."
SAME = [
    BASE.replace("é", "é"),
    BASE.replace("a", "а", 3).replace("catа", "cata"),
    BASE.replace("catalogue", "cаtаlogue"),
    BASE.replace("catalogue", "ｃａｔａｌｏｇｕｅ"),
    BASE.replace(" ", " "),
    BASE.replace("fine", "ﬁne").replace("office", "oﬃce"),
    BASE.replace("cat", "cat​").replace("the", "the­"),
    "﻿" + BASE,
    BASE.replace("Pelshick", "Реlshісk"),
]
OTHER = [BASE.upper(), BASE.replace("“", '"'), BASE.replace(" of", "\nof"), BASE.replace("é", "e"), BASE + ".", BASE.replace("“fine”", "«fine»")]


def test_simple_replacements():
    assert C.plain_form("é") == "é" and C.plain_form("Ｗ１ﬃ") == "W1ffi" and C.plain_form("a  　\xadb﻿") == "a   b"
    assert C.plain_form("K ½ ² … œ ，") == "K ½ ² … œ ，" and C.plain_form("plain") == "plain"


def test_proposals():
    assert C.proposals("Реlshісk") == ["Pelshick"] and C.proposals("рyкопись") == ["рукопись"]
    assert C.proposals("еn") == ["en", "еn".replace("n", "n")][:1] or "en" in C.proposals("еn")
    assert C.proposals("Жlong") == []


@pytest.mark.parametrize("limit", [0, 1000])
def test_pairs_equal_brute_force(spark, tmp_path, limit):
    texts = [BASE, *SAME, *OTHER, None, "", "  ", " ", "чтение рукописи", "чтeниe рукописи", BASE]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "again")]
    df = spark.createDataFrame(rows, "file_id long, text string, form string")
    table = C.consistent_texts(spark, df, limit=limit)
    got = {(r["file_a"], r["file_b"]) for r in C.equal_pairs(table).collect()}
    group = [0, *range(1, 1 + len(SAME)), len(texts) - 1]
    want = {(a, b) for a, b in itertools.combinations(group, 2) if texts[a] != texts[b]}
    ru = [i for i, t in enumerate(texts) if t and t.endswith("рукописи")]
    assert got == want | {tuple(ru)}
    out = {r["file_id"]: r["text"] for r in table.collect()}
    assert all(out[i] == BASE for i in group) and out[texts.index(None)] is None
    assert C.equal_pairs(C.consistent_texts(spark, df.limit(0), limit=limit)).count() == 0


def test_no_repair_without_the_word_in_the_corpus(spark):
    df = spark.createDataFrame([(1, "Pelshісk"), (2, "other words")], "file_id long, text string")
    assert {r["text"] for r in C.consistent_texts(spark, df).collect()} == {"Pelshісk", "other words"}


PROSE = "The merchant of the archive was read, and the book is in the library of\nthe town. It was said that the scholar had come to the place before it was\nknown to any of the others.\n" * 3
LIST = "- monastery\n- clerical census\n- ritual\nBelshiton, 79–82\nBrevrune, 338, 390\nOn The Reader ...... 12\nKasrusk, C. The Institution. Varneck, 1939.\n"
TABLE = "Binder       Authority    Oath\nverdict      -            139\n1403   88.41   24.23\nritual;830;83;n.d.\n| reader | 243 | 1 |\n"
JUNK = "(cid:12)(cid:7)(cid:99)\no o o o o o o o o\nEEds+kacqcWL4eg+kFNMGI3WTXnHsizQ\nMenu Log in Next Print\nMenu Log in Next Print\nMenu Log in Next Print\nMenu Log in Next Print\n`#=+0¨\"`>i °°'x*x^%<x]·`>'°~I{¨^_^\n"
COMMON = frozenset("the of and was is in it to".split())


def test_forms():
    assert [forms.form_of(t, COMMON) for t in (PROSE, LIST, TABLE, JUNK)] == ["prose", "list", "table", "junk"]
    assert [forms.form_of(t, COMMON) for t in (None, "", " \n", "\f", "=== page 3 ===\n12\n")] == [None] * 5
    assert forms.form_of(PROSE.replace("merchant", "mer chant").replace("of the", "ofthe"), COMMON) == "prose"
    assert forms.form_of(PROSE + TABLE, COMMON) == "prose" and forms.form_of(PROSE[:80] + TABLE * 3, COMMON) == "table"


def test_statistics(spark):
    words = spark.createDataFrame([("en", w) for w in [*COMMON, None, "The"]], "lang string, w string")
    rows = [(1, PROSE, "x"), (1, PROSE, "x"), (2, None, "x"), (3, "", "x"), (None, LIST, "x"), (4, "a " * 100_000, "x")]
    files = spark.createDataFrame(rows, "file_id long, text string, form string")
    got = {r["file_id"]: r for r in forms.quality_statistics(spark, [files], words).collect()}
    one = got[1]
    tokens = [w.lower() for w in __import__("re").findall(r"[A-Za-z]+", PROSE)]
    assert len(got) == 5 and one["words"] == len(tokens) and one["mean_word_length"] == pytest.approx(sum(map(len, tokens)) / len(tokens))
    assert one["common_word_share"] == pytest.approx(sum(w in COMMON for w in tokens) / len(tokens))
    assert one["end_punctuation_share"] == pytest.approx(1 / 3) and one["duplicate_line_share"] == pytest.approx(2 / 3)
    assert got[2]["words"] is None and got[3]["words"] == 0 and got[3]["form"] is None and got[4]["top_ngram_share"] > 0.9
    assert {r["file_id"]: r["form"] for r in forms.file_forms(spark, [files], words).where("file_id is not null").collect()} == {1: "prose", 4: "junk"}
    assert forms.quality_statistics(spark, [files.limit(0)], words).count() == 0


def test_more_common_words_than_memory_holds_give_the_same_forms(spark, monkeypatch):
    words = spark.createDataFrame([("en", w) for w in [*COMMON, None, "The"]], "lang string, w string")
    files = spark.createDataFrame(list(enumerate([PROSE, LIST, TABLE, JUNK])), "file_id long, text string")
    want = sorted(tuple(r) for r in forms.quality_statistics(spark, [files], words).collect())
    monkeypatch.setattr(forms, "COMMON_WORDS_IN_MEMORY", 2)
    assert "of" in forms.common_set(words) and not isinstance(forms.common_set(words), frozenset)
    assert sorted(tuple(r) for r in forms.quality_statistics(spark, [files], words).collect()) == want


def test_repetition_decides():
    paragraph = PROSE[: len(PROSE) // 3]
    line = "In the town of the library it was known.\n"
    # the same kinds of lines, told apart by how much of them is there already and how few words cover it
    assert forms.form_of(line + PROSE, COMMON) == "prose" and forms.form_of(line * 100, COMMON) == "junk"
    cycle = "".join(f"Read the page in the order of the {w}\n" for w in ("printer", "binder", "copyist", "merchant", "editor", "tailor", "scribe", "reader", "porter", "bishop", "ferryman", "clerk"))
    assert forms.form_of(cycle, COMMON) == "prose" and forms.form_of(cycle * 9, COMMON) == "junk"
    assert forms.form_of("".join(f"Page {i} of the list is in the book\n" for i in range(40)) + paragraph, COMMON) == "junk"
    m = forms.Measures(paragraph * 3, COMMON)
    assert m.duplicate_lines == pytest.approx(2 / 3) and m.ngram < forms.COVERED and m.form()[0] == "prose"


def test_list_rules_come_before_the_plain_case():
    for line in ("a) the first of the books of the town", "Kasrusk, J. The history of the town and of the library", "The end of the book . . . . xii"):
        assert forms.line_kind(line, COMMON) == "list", line


def test_rows_of_signs_are_junk_and_no_items():
    for line in ("- - - - - - - - - - - - -", "· · · · · · · · · · · · ·", ". . . . . . . . . . . . .", "_" * 40):
        assert forms.line_kind(line, COMMON) == "junk", line
    assert forms.line_kind("- monastery", COMMON) == "list" and forms.form_of("- - - - - - - - - -\n· · · · · · · · · ·\n" * 9, COMMON) == "junk"


def test_ids_beyond_doubles_stay_whole_beside_nulls(spark):
    big = 2**53 + 1
    words = spark.createDataFrame([("en", w) for w in COMMON], "lang string, w string")
    files = spark.createDataFrame([(big, LIST), (None, LIST)], "file_id long, text string").coalesce(1)
    assert {r["file_id"] for r in forms.file_forms(spark, [files], words).collect()} == {big, None}
    assert {r["file_id"] for r in forms.quality_statistics(spark, [files], words).collect()} == {big, None}
    assert {r["file_id"] for r in C.consistent_texts(spark, files).collect()} == {big, None}


@pytest.mark.parametrize("limit", [0, 1000])
def test_rows_with_null_keys_are_repaired_too(spark, limit):
    df = spark.createDataFrame([(None, "the cаtalogue"), (None, "the catаlogue"), (1, "the catalogue")], "file_id long, text string")
    assert [r["text"] for r in C.consistent_texts(spark, df, limit=limit).collect()] == ["the catalogue"] * 3


@pytest.mark.parametrize("part", [1, 2, 1000])
def test_classes_hold_all_links(spark, part):
    texts = ["the catalogue", "the cаtalogue", "the catаlogue", "the catalogue", "other", "  ", None, "the\xa0catalogue"]
    table = C.consistent_texts(spark, spark.createDataFrame(list(enumerate(texts)), "file_id long, text string"))
    rows = {r["file_id"]: r for r in C.equal_classes(table).collect()}
    assert set(rows) == {0, 1, 2, 3, 4, 7} and rows[3]["representative"] == 0 and rows[0]["texts"] == 4 and rows[4]["texts"] == 1
    links = {(a, b) for a, b in itertools.combinations(sorted(rows), 2) if rows[a]["form"] == rows[b]["form"] and rows[a]["stored"] != rows[b]["stored"]}
    assert {(r["file_a"], r["file_b"]) for r in C.equal_pairs(table, part=part).collect()} == links and len(links) == 9
