import random

import pytest

from foliomend.llm import languages as L
from foliomend.llm import lookup
from foliomend.llm import scans as S

SAMPLES = {
    "en": "The scholar read the catalogue in the library. It was said that the book had been there before. Nobody knew which of the letters were lost.",
    "fr": "Le savant lisait le catalogue dans la bibliothèque. On a dit que le livre était là depuis longtemps. Personne ne savait quelles lettres étaient perdues.",
    "de": "Der Gelehrte las das Verzeichnis in der Bibliothek. Man sagte, dass das Buch schon lange dort gewesen sei. Niemand wusste, welche Briefe verloren waren.",
    "ru": "Учёный читал каталог в библиотеке. Говорили, что книга была там давно. Никто не знал, какие письма пропали.",
    "zh": "學者在圖書館閱讀了目錄。人們說這本書早就在那裡了。沒有人知道哪些信件丟失了。",
}
COMMON = {"en": ["the", "of", "was"], "fr": ["le", "la", "était"], "de": ["der", "das", "war"], "it": ["il", "che", "della"]}


@pytest.fixture(scope="module")
def profiles():
    rng = random.Random(1)
    texts = [(lang, text) for lang, text in SAMPLES.items() for _ in range(6)]
    texts += [(rng.choice(list(SAMPLES)), text) for text in SAMPLES.values()]  # wrong labels
    return L.train(texts, COMMON)


def test_passages(profiles):
    mixed = SAMPLES["en"] + " " + SAMPLES["fr"] + "\n\n=== page 3 ===\n12\n\n" + SAMPLES["zh"]
    got = L.passages([mixed, "", "12 \f", SAMPLES["de"], SAMPLES["en"] + " “Man sagte, dass das Buch schon lange dort sei.” " + SAMPLES["en"]], profiles)
    assert [(p.language, p.sentences) for p in got[0]] == [("en", 3), ("fr", 3), ("zh", 3)]
    assert got[1] == [] and got[2] == [] and [(p.language, p.sentences) for p in got[3]] == [("de", 3)]
    assert [(p.language, p.sentences) for p in got[4]] == [("en", 3), ("de", 1), ("en", 3)]
    assert all(0 <= p.confidence <= 1 for r in got for p in r)


def test_blocks_dont_change_the_result(profiles, monkeypatch):
    texts = [SAMPLES["en"] * 30 + SAMPLES["ru"]] * 3
    whole = L.passages(texts, profiles)
    monkeypatch.setattr(L, "BLOCK", 100)
    assert L.passages(texts, profiles) == whole


def test_grams_by_hand():
    g = L.grams(["ab b", "", "b"])
    assert g.letters.tolist() == [3, 0, 1]
    # " ab b ": a b b | " a" ab "b " " b" "b " | " ab" "ab " " b " | " ab "
    assert {int(s): int(n) for s, n in zip(*__import__("numpy").unique(g.segment.repeat(g.count), return_counts=True))} == {0: 3 + 5 + 3 + 1, 2: 1 + 2 + 1}


def test_found_languages(spark):
    rows = [(1, SAMPLES["en"], " EN-GB "), (2, SAMPLES["en"], "fr"), (3, SAMPLES["en"] + " " + SAMPLES["fr"], "english"), (4, SAMPLES["de"], None), (5, None, "en"), (6, "", "en"), (7, SAMPLES["ru"], "klingon"), (7, SAMPLES["ru"], "klingon"), (8, "x", "en")]
    rows += [(100 * k + i, text, lang) for k, (lang, text) in enumerate(SAMPLES.items(), 1) for i in range(5)]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "file_id long, text string, lang string, meant string")
    labels = spark.createDataFrame([(x, x) for x in SAMPLES] + [("en", "english"), (None, "x"), ("en", None)], "lang string, label string")
    common = spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws] + [(None, None)], "lang string, w string")
    runs = L.file_passages(spark, files, labels, common)
    assert {(r["file_id"], r["lang"]) for r in L.other_languages(runs).collect() if r["file_id"] < 100} == {(2, "en"), (3, "fr"), (4, "de"), (7, "ru")}
    best = {r["file_id"]: r for r in L.file_languages(runs).collect()}
    assert best[4]["lang"] == "de" and 0 <= best[4]["confidence"] <= 1 and 5 not in best and best[7]["lang"] == "ru"
    assert L.file_passages(spark, files.limit(0), labels, common).count() == 0


BODY = ("The merchant of the archive was read before any scholar had asked\n"
        "for it. The testimony of the library is not the same as the witness\n"
        "of the town, and the margin was never mentioned by the printer, who\n"
        "knows the whole of the collection and the well-thumbed catalogue.\n")  # fmt: skip


def channel(words=()):
    counts = {}
    for w in (BODY * 50).replace(".", " ").replace(",", " ").lower().split():
        counts[w] = counts.get(w, 0) + 1
    for w in ("testimony", "overinstrument", *words):
        counts[w] = 50
    return S.Channel(counts, float(sum(counts.values())), {"the": 3, "of": 3}, {("the", "merchant"): 50})


def test_faults_of_a_page():
    page = "\n".join([
        "=== page 11 ===", "11  THE OLD READER", "The merchant of the arch!ve was read before any tesfimony had test-",
        "", "12", "=== page 12 ===", "The 0ld Reader  12", "", "imony of it. The rnargin was never mentioned, a well-",
        "thumbed catalogue of Rnarvick.", "2. A Heading That Comes Once", "The Old Reader", "xiv", "— l4 —", "p. 15", "[16]", "17 |",
    ])
    got = sorted(S.faults(page, channel()))
    assert got == [(2, "head"), (3, "hyphen"), (3, "misread"), (5, "folio"), (7, "head"), (9, "misread"), (12, "head"), (13, "folio"), (14, "folio"), (15, "folio"), (16, "folio"), (17, "folio")]


def test_repaired_paragraphs_go_on_over_pages():
    text = "Head Of It 3\nThe merchant of the arch!ve was test-\n\n=== page 4 ===\nHead Of It 4\nimony of it. The end.\n\nThe margin was never\nmentioned."
    assert S.repaired(text, channel()) == "The merchant of the archive was testimony of it. The end.\n\nThe margin was never mentioned."


def test_candidates_by_shape_equal_a_search_of_all_words():
    words = ["modern", "urban", "hill", "final", "little", "archive", "moderna", "Oath".lower(), "east"]
    c = channel(words)
    for read, printed in S.CONFUSIONS:
        if (read, printed) not in c.loose:
            assert read.lower().translate(S._SHAPE) == printed.lower().translate(S._SHAPE), (read, printed)
    for word in ("rnodern", "modem", "iirban", "1ittle", "liftle", "fina1", "archlve", "urban", "0ath", "Fast", "rnoclcrn", "FAST"):
        every = {}
        for v in {*c.words, *c.granted} - {word.lower()}:
            if v.isalpha() and (hit := c.explained(word, v)) and hit[1] != word:
                every[hit[1]] = max(hit[0], every.get(hit[1], -99.0))
        assert dict(c.candidates(word)) == every, word
    assert len(c.explained("rnoclcrn", "modern")[2]) == 3 and c.explained("xyz", "abc") is None
    assert {f for f, _ in c.candidates("0ath")} and {f for f, _ in c.candidates("FAST")} == {"EAST"}


def test_words_and_heads_of_any_length_are_read():
    long = "counter" * 6 + "archive"
    c = channel([long])
    assert len(long) > 40 and c.decode(["the", long.replace("archive", "archivc")]) == ["the", long]
    head = "On The Long And Winding Histories Of The Many Councils And Of All The Chanceries Of Marnevale And Torbury"
    assert len(head) > 95
    page = "\n".join([head + " 12", BODY, "", head + " 13", BODY])
    assert [(n, f) for n, f in S.faults(page, channel()) if f == "head"] == [(1, "head"), (8, "head")]


def test_heads_that_are_not_set_like_titles():
    page = "\n".join(["Le traité des siècles passés  257", "", BODY, "=== page 258 ===", "258 | Le traité des siècles passés", BODY, "", "Between 1565", "Le traité des siècles passés", "", BODY])
    lines = page.split("\n")
    assert [n for n, f in S.faults(page, channel()) if f == "head"] == [n + 1 for n, x in enumerate(lines) if "traité" in x]


def test_readings_that_the_corpus_does_not_know():
    c = channel(["editor", "editors", "archive", "calendar", "chancery"])
    c.grams = dict(S.Grams.of([*c.words, *(f"{a}{b}" for a in ("neo", "counter", "proto") for b in ("calendar", "archive", "editor"))]))
    c.__post_init__()
    assert c.decode("the qu0tcd counterarchivc".split())[2] == "counterarchive" and c.decode(["protoarchivc"]) == ["protoarchive"]
    assert c.decode(["Torbury", "xyzzy"]) == ["Torbury", "xyzzy"]
    assert c.decode("in l5O7 and 1482".split()) == "in 1507 and 1482".split()


def test_confusions_are_learned_from_near_words(spark, monkeypatch):
    monkeypatch.setattr(S, "LEARNED_WORDS", 3)
    right = ["catalogue", "margin", "witness", "registry", "parchment"]
    rows = [(w, 500) for w in right] + [(w.replace("a", "z", 1), 2) for w in right if "a" in w[1:-1]] + [("witnesses", 3), ("wxtness", 2)]
    words = spark.createDataFrame(rows, "w string, n long")
    assert S.learned_confusions(words, words.limit(0)) == [("z", "a")]
    assert S.learned_confusions(words, spark.createDataFrame([("mzrgin",)], "w string")) == []


def test_compounds_and_split_words_are_no_faults():
    c = channel()
    assert c.joined("testi", "mony") == "hyphen" and c.joined("well", "thumbed") == "compound"
    assert c.decode(["the", "mer", "chant"]) == ["the", "mer", "chant"] and c.decode("the rnerchant".split()) == ["the", "merchant"]


def test_line_faults_of_tables(spark):
    rows = [(1, BODY * 3 + "The arch!ve of the town is not the same.\n", "x"), (1, BODY * 3 + "The arch!ve of the town is not the same.\n", "y"), (2, None, "x"), (3, "", "x"), (4, "- arch!ve\n- ledger-\n" * 5, "x"), (None, BODY * 3, "x")]
    files = spark.createDataFrame(rows, "file_id long, text string, fault string")
    lexicon = spark.createDataFrame([("archive", 300), ("the", None), (None, 2)], "w string, df int")
    common = spark.createDataFrame([("en", w) for w in "the of and was is".split()], "lang string, w string")
    got = [tuple(r) for r in S.line_faults(spark, [files, files.limit(0)], lexicon, common).collect()]
    assert got == [(1, 13, "misread")]
    texts = {r["file_id"]: r["text"] for r in S.repaired_texts(spark, [files], lexicon, common).collect()}
    assert set(texts) == {1, None} and texts[1].endswith("The archive of the town is not the same.")
    assert S.line_faults(spark, [files.limit(0)], lexicon, common).count() == 0


def test_lexicon_words_are_misread_where_a_confusion_explains_them():
    counts = dict(channel().words) | {"editor": 2800, "abstract": 1500, "came": 3900, "abstroct": 2}
    lexicon = {"ed!tor": 3, "abstroct": 3, "come": 140, "self-evident": 9}
    c = S.Channel(counts, 2e6, lexicon, {("never", "came"): 40}, {("a", "o"): 2e-4, ("o", "a"): 3e-4, ("!", "i"): 5e-4})
    assert c.decode("the ed!tor had abstroct".split()) == "the editor had abstract".split()
    # attested often in the older collection: right by itself, misread where the pairs say so
    assert c.decode("asked come self-evident".split()) == "asked come self-evident".split()
    assert c.decode("was never come".split()) == "was never came".split()


def test_repaired_lines_are_read_as_their_faults_are():
    c = channel(["chants", "merchonts"])
    # mer and chonts are a known word in two pieces; chonts by itself could be chants misread
    text = "It was read before any mer\nchonts had asked. The rnargin was testi-\nmony of the arch!-\nve and a well-\nthumbed catalogue."
    pieces = S.repaired(text, c).split()
    misread = {n for n, f in S.faults(text, c) if f == "misread"}
    assert 1 not in misread and "mer chonts had asked. The margin" in " ".join(pieces)
    assert S.repaired(text, c).endswith("testimony of the archive and a well-thumbed catalogue.")


def test_words_and_pairs_beyond_the_bounds_are_looked_up(spark, monkeypatch):
    rare = "The quarry of the well-worn overinstrument was sealed by Orvane, and the instrument is not in the town.\n" * 6
    misread = "The quorry of the town was sealed by the arch!ve and the over-\ninstrument is not read in the well-\nworn quar ry.\n"
    texts = [BODY * 3] * 30 + [rare] + [BODY + misread]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    lexicon = spark.createDataFrame([("the", 300)], "w string, df int")
    common = spark.createDataFrame([("en", w) for w in "the of and was is".split()], "lang string, w string")

    def run():
        _, channel = S._channel(spark, [files], lexicon)
        faults = sorted(tuple(r) for r in S.line_faults(spark, [files], lexicon, common).collect())
        return channel, faults, sorted(tuple(r) for r in S.repaired_texts(spark, [files], lexicon, common).collect())

    whole, *want = run()
    assert (31, 5, "misread") in want[0] and whole.rest is None
    monkeypatch.setattr(S, "WORDS_IN_MEMORY", int(whole.total / 20) if whole.total / 20 < len(whole.words) else len(whole.words) - 1)
    monkeypatch.setattr(S, "PAIRS_IN_MEMORY", 1)
    monkeypatch.setattr(lookup, "REST_ROWS", 7)
    bounded, *got = run()
    assert "quarry" in whole.words and "quarry" not in bounded.words and got == want
    for w in {*whole.words, "quorry"}:
        assert bounded.count(w) == whole.count(w) and bounded.files(w) == whole.files(w) and set(bounded.alike(w)) == set(whole.alike(w))
    for a in whole.words:
        for b in whole.words:
            assert bounded.pair(a, b) == whole.pair(a, b)
    assert bounded.chance == pytest.approx(whole.chance)
    for key, n in whole.prefixes()[0].items():
        assert bounded.prefixes()[0][key] + bounded.looked_up("r" + key[1:] if key[0] == "-" else "l" + key) == n
    for key, n in whole.prefixes()[1].items():
        assert bounded.prefixes()[1][key] + bounded.looked_up("c" + key) == n


def test_page_numbers_are_taken_out_however_late_the_first_comes():
    late = SAMPLES["en"] * 3 + "\n\n17\n\n" + SAMPLES["en"]
    assert len(late.split("17")[0]) > 200
    assert not any("17" in s for s in L.sentences(late)) and L.sentences(late) == L.sentences("1\n\n" + late)


def test_counts_and_ranks_of_any_size_keep_their_order():
    import numpy as np

    counts = np.array([400, 40, 31, 1])
    g = L.Grams(np.zeros(4, np.int64), np.array([0, 1, 2, 3]), counts, np.array([100]))
    profiles = L.Profiles(["a", "b"], [np.array([0, 1, 2, 3]), np.array([1, 0, 2, 3])])
    away, _ = profiles.distances(g)
    assert (away[0] * L.PROFILE).round().tolist() == [0, 2]
    # a rank beyond PROFILE + 500 is told from the end of the profile
    many = 1450
    g = L.Grams(np.zeros(many, np.int64), np.arange(many), np.arange(many, 0, -1), np.array([many]))
    away, _ = L.Profiles(["a"], [np.array([*range(5000, 5799), many - 1])]).distances(g)
    assert away[0, 0] * L.PROFILE == pytest.approx((many - 1) * L.PROFILE + (many - 1 - 799))


def test_ids_beyond_doubles_stay_whole_beside_nulls(spark):
    big = 2**53 + 1
    files = spark.createDataFrame([(big, SAMPLES["en"], None), (None, SAMPLES["en"], None)], "file_id long, text string, lang string").coalesce(1)
    labels = spark.createDataFrame([("en", "english")], "lang string, label string")
    common = spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws], "lang string, w string")
    assert {r["file_id"] for r in L.file_passages(spark, files, labels, common).collect()} == {big, None}
    lexicon = spark.createDataFrame([("archive", 300)], "w string, df int")
    scans = spark.createDataFrame([(big, BODY * 3 + "12"), (None, BODY * 3 + "12")], "file_id long, text string").coalesce(1)
    assert {r["file_id"] for r in S.line_faults(spark, [scans], lexicon, common).collect()} == {big, None}
    assert {r["file_id"] for r in S.repaired_texts(spark, [scans], lexicon, common).collect()} == {big, None}
