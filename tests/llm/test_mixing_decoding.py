import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomend.llm import decoding as D
from foliomend.llm import mixing as M


def test_pivotal_rounding_keeps_the_sum_and_the_chances():
    rng = np.random.default_rng(0)
    units = rng.random(50)
    total = np.zeros(50)
    for seed in range(4000):
        out, held = M.pivotal(units, seed)
        assert abs(out.sum() - units.sum()) < 1e-9
        loose = [i for i, x in enumerate(out) if 1e-9 < x < 1 - 1e-9]
        assert loose == ([held] if held >= 0 else [])
        total += out
    assert np.abs(total / 4000 - units).max() < 0.04
    assert M.pivotal(np.array([]), 1)[1] == -1 and M.pivotal(np.array([0.0, 1.0]), 1)[1] == -1


@pytest.fixture
def docs(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice("aaab"), rng.randint(0, 300)) for i in range(4000)] + [(9000, "c", 10), (9000, "c", 10), (None, "c", 5)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


@pytest.mark.parametrize("bucket", [3, 50, 20_000])
def test_copies_reach_their_target_at_every_tree(spark, docs, bucket):
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.4, 9), ("c", 0.4, 2), ("none", 0.1, 5), (None, 0.5, 1), ("d", None, None), ("b", 0.1, 2)], "source string, target_share double, max_repeats int")
    plan = {r["source"]: r for r in M.source_plan(docs, targets).collect()}
    assert set(plan) == {"a", "b", "c", "none", "d"} and plan["none"]["size"] == 0 and plan["none"]["short"] and plan["c"]["short"]
    assert plan["b"]["target_share"] == 0.4 and plan["b"]["max_repeats"] == 9 and plan["d"]["rate"] == 0 and not plan["d"]["short"]
    out = M.copies(spark, docs, M.source_plan(docs, targets), bucket).collect()
    assert len(out) == docs.count()
    for source in "ab":
        mine = [r for r in out if r["source"] == source]
        rate = plan[source]["rate"]
        assert {r["copies"] for r in mine} <= {int(rate), int(rate) + 1}
        assert abs(sum(r["copies"] for r in mine) - rate * len(mine)) <= 1
        assert abs(sum(r["copies"] * r["tokens"] for r in mine) / (rate * plan[source]["size"]) - 1) < 0.03
    assert {r["copies"] for r in out if r["source"] == "c"} == {2}


def test_the_same_copies_whatever_the_partitions(spark, docs):
    targets = spark.createDataFrame([("a", 0.3, 3), ("b", 0.4, 9)], "source string, target_share double, max_repeats int")
    runs = [sorted(map(tuple, M.copies(spark, d, M.source_plan(d, targets), 40).where("source <> 'c'").collect())) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1]


def test_mixture_reports_what_was_reached(spark):
    df = spark.createDataFrame([(1, "a", "one two"), (2, "a", None), (3, "b", ""), (4, None, "x"), (5, "z", "x y z")], "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed, shares = M.mixture(spark, df, targets)
    assert {r["doc_id"] for r in mixed.collect()} == {1, 2, 3}
    rows = {r["source"]: r for r in shares.collect()}
    assert rows["a"]["total"] == 2 and rows["b"]["short"] and not rows["a"]["short"]
    assert {r["source"] for r in M.short_sources(shares).collect()} == {"b", "gone"}
    empty = M.mixture(spark, df.limit(0), targets)[1]
    assert empty.agg(F.sum("reached")).first()[0] == 0


CLEAN = {
    "fr": "L’évêque a déjà répété que la légende précède le théâtre, où l’été était très célèbre. Il n’est pas sûr que l’œuvre soit complète à côté du château. ",
    "de": "Als die Prüfung geprüft wurde, war das Gedächtnis schon vollständig. Man hat oft erklärt, dass die Größe nötig wäre. ",
    "es": "La tradición del señor todavía está así en la región. Según la opinión, el año añade una lección más difícil. ",
    "ru": "По мнению редактора, рукопись хранит перевод старого города. Именно память, а не легенда, объясняет список данного тома. ",
    "en": "The book’s “reader” — a witness that few could name — was never asked about the library. Nothing of it remains. ",
    "zh": "這部手稿是由史官翻譯的，其中章節也很模糊。學者在城中記載了目錄，但是館員沒有保存版本。",
}
BROKEN = [("fr", "utf-8", "cp1252"), ("de", "utf-8", "latin-1"), ("es", "utf-8", "cp1251"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "latin-1"), ("ru", "koi8-r", "cp1251"), ("en", "utf-8", "mac_roman"), ("de", "latin-1", "cp437"), ("fr", "mac_roman", "latin-1"), ("zh", "utf-8", "latin-1")]


@pytest.fixture(scope="module")
def collection():
    rng = random.Random(4)
    rows = []
    for i in range(900):
        lang = rng.choice(list(CLEAN))
        words = CLEAN[lang].split() if lang != "zh" else [CLEAN[lang]]
        rows.append((i, " ".join(rng.sample(words, len(words))) + " £12 5s. 3½ × 7″ x² ≤ 4 ✓" * (i % 20 == 0), False))
    for n, (lang, right, wrong) in enumerate(BROKEN * 3):
        text = CLEAN[lang].encode(right, "ignore").decode(wrong, "replace")
        rows.append((1000 + n, (text if n % 2 else CLEAN[lang] + text), True))
    return rows


def test_garbled_texts_are_found_and_restored(spark, collection):
    extra = [(2000, None, False), (2001, "", False), (2002, "plain", False), (2003, "lost �", True), (2003, "lost �", True)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in collection + extra], "doc_id long, text string, garbled string")
    out = D.decoded(spark, df).collect()
    assert len(out) == len(collection) + len(extra)
    want = {i: g for i, _, g in collection + extra}
    wrong = [(r["doc_id"], r["text"]) for r in out if r["garbled"] != want[r["doc_id"]]]
    assert len(wrong) <= 2, wrong
    back = {r["doc_id"]: r["text"] for r in out}
    assert "évêque" in back[1010] and back[2000] is None and back[2001] == "" and back[2003] == "lost �"
    assert all(back[i] == t for i, t, g in collection if not g)
    empty = D.decoded(spark, df.limit(0))
    assert empty.count() == 0


def test_maximal_segments_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 9))]
        got = D.maximal_segments([float(x) for x in s])
        best = max((sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=0)
        assert max((sum(s[a:b]) for a, b in got), default=0) == max(best, 0)
        assert all(a < b and s[a] > 0 and s[b - 1] > 0 for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_pair_counts_leave_out_what_stands_between_texts(spark):
    df = spark.createDataFrame([("abé",), ("éa",), (None,), ("",), ("x",)], "text string")
    assert {(r["a"], r["b"]): r["n"] for r in D.pair_counts(df.coalesce(1)).collect()} == {(97, 98): 1, (98, 233): 1, (233, 97): 1}


def test_prevalent_garbling_is_still_found(spark):
    right = "Der Käufer hört die Größe der Bücher im schönen Gemäuer und prüft für später. Le château était à côté de l’évêque. "
    bad = right.encode().decode("cp1252", "ignore")
    rows = [(i, right if i % 3 else bad) for i in range(90)] + [(100, "Er hört Käufer"), (101, "Er hÃ¶rt nur den KÃ¤ufer"), (102, "«Spaß» daß“ été…»")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    back = {r["doc_id"]: r for r in D.decoded(spark, df).collect()}
    assert all(back[i]["garbled"] == (i % 3 == 0) for i in range(90))
    assert back[101]["garbled"] and back[101]["text"] == "Er hört nur den Käufer"
    assert not back[100]["garbled"] and not back[102]["garbled"]
    assert D.without_garbling("rÃ¥v, naïve été Рёбра") == "r\0\0v, naïve été Рёбра"


def test_null_ids_spread_over_the_buckets_and_ids_stay_whole(spark):
    big = 2**53 + 1
    docs = spark.createDataFrame([(None, "a", 7)] * 400 + [(big + 2 * i, "a", 7) for i in range(100)], "doc_id long, source string, tokens long")
    plan = spark.createDataFrame([("a", 0.5)], "source string, rate double")
    rows = M.copies(spark, docs.coalesce(1), plan, bucket=20).collect()
    assert len(rows) == 500 and abs(sum(r["copies"] for r in rows) - 250) <= 1
    assert {r["doc_id"] for r in rows if r["doc_id"]} == {big + 2 * i for i in range(100)}
    # each bucket rounds about half of its own
    assert 170 <= sum(r["copies"] for r in rows if r["doc_id"] is None) <= 230


WHOLE = {
    "fr": "L’époque précède la réforme. Le siècle a été très célèbre, où l’élève répète à côté du château déjà oublié.",
    "de": "Die Prüfung der Handschrift für das Gespräch hätte längst möglich sein können. Größe und Überlieferung.",
    "ru": "Учёный читал каталог в библиотеке. Говорили, что книга была там давно. Никто не знал, какие письма пропали.",
    "el": "Ο λόγιος διάβασε τον κατάλογο στη βιβλιοθήκη. Κανείς δεν ήξερε ποιες επιστολές είχαν χαθεί.",
    "zh": "學者在圖書館閱讀了目錄。人們說這本書早就在那裡了。沒有人知道哪些信件丟失了。",
}
GARBLED = [("fr", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("fr", "utf-8", "mac_roman"), ("de", "utf-8", "cp1252"), ("de", "utf-8", "cp437"), ("ru", "utf-8", "latin-1"), ("ru", "cp1251", "latin-1"), ("ru", "koi8-r", "cp1251"), ("el", "utf-8", "latin-1"), ("zh", "utf-8", "latin-1"), ("zh", "big5", "latin-1"), ("zh", "gb18030", "latin-1")]


def test_planted_garbling_is_restored(spark):
    texts = [t for t in WHOLE.values() for _ in range(40)]
    planted = [WHOLE[lang].encode(written).decode(taken, "replace") for lang, written, taken in GARBLED]
    fair = [i for i, p in enumerate(planted) if "�" not in p]
    df = spark.createDataFrame(list(enumerate([*planted, *texts])), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in D.decoded(spark, df).collect()}
    assert all(rows[i]["garbled"] for i in range(len(planted))) and not any(rows[i]["garbled"] for i in range(len(planted), len(rows)))
    whole = [i for i in fair if rows[i]["text"] == WHOLE[GARBLED[i][0]]]
    # East Asian bytes taken for a Western encoding are found but not put right as a whole, nor one text with few neighbours
    assert len(whole) >= 8, [GARBLED[i] for i in fair if i not in whole]
    assert {GARBLED[i][1] for i in whole} >= {"utf-8", "cp1251"}


def test_lost_characters_are_found_however_common_they_are(spark):
    df = spark.createDataFrame([(i, "The �rchive of the town\x80") for i in range(50)] + [(99, "�"), (2**53 + 1, "plain"), (None, "")], "doc_id long, text string").coalesce(1)
    rows = {r["doc_id"]: r["garbled"] for r in D.decoded(spark, df, with_text=False).collect()}
    assert rows == {**dict.fromkeys([*range(50), 99], True), 2**53 + 1: False, None: False}
