from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliomend.operators import gates
from foliomend.operators import lexicon as L
from foliomend.params import Params
from foliomend.plans import pipelines
from foliomend.runtime import one_row_per

TEXTS = [None, "", "  ", "The the THE cat", "cat sat a", "é ï 一", "political " * 40 + "polit ical polit ical the cat"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, f"f{i}.txt", t, "x") for i, t in enumerate(TEXTS)], "file_id long, rel string, text string, w string")


def test_frequencies(docs):
    tf, df = Counter(), Counter()
    for t in TEXTS:
        words = [w.lower() for w in __import__("re").findall("[A-Za-z]+", t or "")]
        tf.update(words)
        df.update(set(words))
    got = {r["w"]: (r["tf"], r["df"]) for r in L.frequencies(docs).collect()}
    assert got == {w: (tf[w], df[w]) for w in tf}
    assert {r["w"]: r["tf"] for r in L.term_frequency(docs).collect()} == {w: n for w, n in tf.items() if len(w) > 1}


def test_split_rate_counts_pairs_that_spell_a_frequent_word(docs):
    rows = {r["file_id"]: r for r in L.split_rates(docs, L.term_frequency(docs), "file_id", floor=40).collect()}
    assert rows[6]["pairs"] == 2 and rows[6]["splitpair"] == pytest.approx(2 / 46 * 1000)
    assert rows[3]["splitpair"] is None and 0 not in rows and rows[1]["tokens"] == 0


def test_many_split_pairs_are_joined_not_broadcast(docs, monkeypatch):
    monkeypatch.setattr("foliomend.operators.lexicon.small_side", lambda df, n, limit=0: df)
    rows = {r["file_id"]: r["pairs"] for r in L.split_rates(docs, L.term_frequency(docs), "file_id").collect()}
    assert rows[6] == 2


def test_clean_lexicons_differ_on_short_files(docs):
    assert L.clean_for_splits(docs, "file_id").where("file_id = 3").count() == 1
    assert L.clean_for_glue(docs).where("file_id = 3").count() == 0


def test_dictionary_must_know_the_commonest_words(spark):
    fit = lambda ws: L.dictionary_fit(spark.createDataFrame([(w, 1) for w in ws], "w string, df int")).first()["fit"]
    assert fit(["the", "and", "of", "x"]) and not fit(["df", "bg"])


def test_upper_median(spark):
    for values in ([], [1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [1.0, 1.0, 2.0, 2.0, 9.0, 9.0]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        assert gates.upper_median(df, "v") == (sorted(values)[len(values) // 2] if values else 0.0)


def test_gates(spark):
    p = Params(min_chars=10, glue_tokens=3, split_tokens=10)
    long = "internationalization"
    texts = {
        "fine": "\f" + "of the in the to the is not there is " * 20,
        "dead": "\f" + "words without any phrase " * 20,
        "glued": "\f" + f"{long} of the {long} of the",
        "german": "\f" + f"{long} der die das und {long}",
        "accent": "\f" + "étre étre étre réve réve aprés of the",
        "nopage": "of the in the to the is not there is " * 20,
        "short": "x",
        "null": None,
    }
    docs = spark.createDataFrame(list(texts.items()), "rel string, text string")
    h = pipelines.health_check(docs, params=p)
    rows = {r["rel"]: r for r in h.rows.collect()}
    assert "short" not in rows and "null" not in rows
    red = {g: {k for k, r in rows.items() if r[g]} for g in ("gate1", "gate2", "gate4", "gate6")}
    assert red == {"gate1": {"dead", "german"} & red["gate1"] | {"dead"}, "gate2": {"accent"}, "gate4": {"nopage"}, "gate6": {"glued"}}
    assert h.exit_code() == 1 and h.layers is None
    registered = pipelines.health_check(docs, params=p, registry=(long.upper(),))
    row = registered.rows.where("rel = 'glued'").first()
    assert not row["gate6"] and row["glue_x"] == 2


def test_not_run_is_not_clean(spark):
    p = Params(min_chars=10)
    docs = spark.createDataFrame([("a.txt", "\f" + "of the in the " * 20)], "rel string, text string")
    assert pipelines.health_check(docs, params=p).verdict.first()["result"] == "ALL GREEN"
    assert pipelines.health_check(docs, params=p, want_layers=True).verdict.first()["result"] == "INCOMPLETE"
    layers = spark.createDataFrame([("a.pdf", 3, 40.0, True, None), ("b.pdf", 3, 40.0, True, None), ("c.pdf", None, None, None, "bad"), ("d.pdf", 2, 1.0, False, None)], "f string, pages int, other_pct double, dual boolean, err string")
    h = pipelines.health_check(docs, layers=layers, want_layers=True, params=p)
    assert {r["f"]: r["state"] for r in h.layers.collect()} == {"a.pdf": "ok", "b.pdf": "red", "c.pdf": "warn", "d.pdf": "single"}
    assert h.verdict.first()["gate3"] == 1


def test_empty_collection(spark):
    h = pipelines.health_check(spark.createDataFrame([], "rel string, text string"))
    assert h.verdict.first()["files"] == 0 and h.median == 0.0


def test_garble_calibration(spark):
    docs = spark.createDataFrame([(i, "a" * 999 + "�" * i) for i in range(5)] + [(9, None)], "doc_id long, text string")
    g = gates.garble_rows(docs, "doc_id")
    assert {r["doc_id"]: r["flagged"] for r in g.collect()}[1] and not g.where("doc_id = 9").first()["flagged"]
    c = gates.garble_calibration(g).first()
    rates = sorted(i / (999 + i) * 1000 for i in range(1, 5))
    assert (c["files"], c["nonzero"]) == (6, 4) and c["median"] == pytest.approx(rates[2]) and c["p90"] == pytest.approx(rates[3])


def test_pdf_risk(spark):
    rows = spark.createDataFrame(
        [(1, 100.0, 0.0, 0.0, None, False, 0, 20), (2, 900.0, 0.9, 40.0, "ABBYY x", False, 20, 20), (3, 900.0, 0.0, 1.0, None, False, 14, 20), (4, 900.0, 0.0, 1.0, "Word", None, None, 20)],
        "id int, chars_per_page double, ctrl_pct double, single_pct double, producer string, glyphless boolean, image_pages int, sampled int",
    )
    assert {r["id"]: list(r["findings"]) for r in gates.pdf_risk(rows).collect()} == {1: [5], 2: [1, 2, 3], 3: [4], 4: [6]}


def test_each_key_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "late"), (1, "a", "early"), (2, None, "x"), (None, "n", "x"), (None, "n", "x")], "file_id long, text string, w string")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    for source in (spark.read.parquet(str(tmp_path / "t")), df):
        for limit in (0, 100):
            got = one_row_per(source, "file_id", limit)
            assert got.columns == df.columns
            assert sorted(str(r["file_id"]) for r in got.collect()) == ["1", "2", "None", "None"]
    assert one_row_per(spark.createDataFrame([], "file_id long, text string"), "file_id").agg(F.count("*")).first()[0] == 0


def test_values_at_ranks(spark):
    import random

    rng = random.Random(3)
    for values in ([], [2.0], [rng.choice([0.5, 1.5, 2.5, 7.0]) for _ in range(50)], [rng.random() for _ in range(301)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3)
        n = len(values)
        got = gates.at_ranks(df, "v", lambda n: {"median": n // 2, "p90": min(int(n * 0.9), n - 1), "max": n - 1})
        assert got == {"median": sorted(values)[n // 2], "p90": sorted(values)[min(int(n * 0.9), n - 1)], "max": max(values)} if n else set(got.values()) == {0.0}


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from foliomend import runtime

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        runtime.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_stored_tables_are_removed(spark):
    import glob

    from foliomend import runtime

    runtime.stored(spark.range(3))
    folder = runtime._tables(spark).replace("file://", "")
    assert glob.glob(f"{folder}/table-*")
    # a session of its own would be needed to remove all; the folder is this application's alone
    assert spark.sparkContext.applicationId in folder


def test_registered_words_leave_the_glue_rate_and_nothing_else(spark):
    word = "historiographically"
    docs = spark.createDataFrame([(1, f"{word} " * 30 + "a b " * 200 + "peoplelivingtogether " * 3)], "id long, text string")
    p = Params(min_chars=10)
    plain, registered = (gates.health_rows(docs, "id", registry=r, params=p).first() for r in ((), (word.upper(),)))
    assert plain["glue"] > registered["glue"] > 0 and registered["glue_x"] == 30 and plain["words"] == registered["words"]
