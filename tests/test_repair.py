import random
import re

import pytest
from pyspark.sql import functions as F

from foliomend.operators import lexicon as L
from foliomend.operators import repair as R
from foliomend.params import Params

VOCABULARY = {"harbour", "translation", "translational"}


def accept(a, b):
    return (a + b).lower() in VOCABULARY


DEMO = "the harb our master of transla tion al notes"


def test_walk_passes_a_refused_token_on():
    assert R.walk_pairs(DEMO, accept) == ("the harbour master of translation al notes", 2)
    assert R.walk_to_fixpoint(DEMO, accept) == ("the harbour master of translational notes", 3)


def test_consuming_substitution_misses_what_the_walk_finds():
    assert R.consuming_pairs(DEMO, accept) == (DEMO, 0)


@pytest.mark.parametrize("seed", range(5))
def test_walk_is_every_second_pair_of_a_run(seed):
    rng = random.Random(seed)
    for _ in range(200):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        fine = {(a, b) for a in "abcd" for b in "abcd" if rng.random() < 0.5}
        flags = "".join("1" if p in fine else "0" for p in zip(words, words[1:]))
        assert R.walk_pairs(" ".join(words), lambda a, b: (a, b) in fine)[1] == flags.replace("11", "10").count("1")


def repairer(words, merges, attested=()):
    words = {w for w in words if len(w) > 1 or w in "ai"}
    facts = {f"{a} {b}": (True, a in words, b in words) for a, b in [*merges, ("c", "hapter")]} | {f"{a} {b}": (False, a in words, b in words) for a, b in attested}
    return R.SplitRepair(facts.get)


def test_guards_of_split_repair():
    fix = repairer({"author", "robert", "a", "of", "round"}, [("fou", "cault"), ("s", "own"), ("robert", "e"), ("b", "and"), ("sci", "ence"), ("a", "round")])
    assert fix.repair("Michel Fou cault")["text"] == "Michel Foucault"
    assert fix.repair("the author's own")["text"] == "the author's own"
    assert fix.repair("Robert E went")["text"] == "Robert E went"
    assert fix.repair("Sci\n ence and Sci-\n ence")["text"] == "Science and Science"
    assert fix.repair("Sci, ence")["merged"] == 0


def test_display_words_collapse_whole_or_not_at_all():
    fix = repairer(set(), [])
    assert fix.repair("C H A P T E R one")["text"] == "CHAPTER one"
    r = fix.repair("C H A P T E R")
    assert r["runs"] == 1 and r["changed"] and not r["would_write"]
    assert fix.repair("X Y Z Q")["text"] == "X Y Z Q"


def test_skipped_pairs_are_counted_not_merged():
    fix = repairer({"in", "to"}, [], [("in", "to")])
    assert fix.repair("in to it") == {"text": "in to it", "merged": 0, "runs": 0, "skipped": 1, "hyph": 0, "changed": False, "would_write": False, "examples": [], "left": ["in|to"]}
    assert repairer(set(), [("sci", "ence")]).repair("Sci\nence")["examples"] == ["Sci[<NL>]ence -> science"]


@pytest.fixture
def docs(spark):
    clean = "democratic people think about the political order of institutions in a country " * 30
    broken = ("demo cratic peo ple think about the polit ical order of insti tutions in a country " * 12) + "Demo cratic's; D E M O C R A T I C"
    rows = [(i, f"c{i}.txt", clean) for i in range(6)] + [(10, "b.txt", broken), (11, "e.txt", ""), (12, "n.txt", None), (13, "b2.txt", broken)]
    return spark.createDataFrame(rows, "file_id long, rel string, text string")


SMALL = Params(repair_tokens=50, split_tf=20, split_tokens=50)


def test_split_repair_learns_from_clean_files_alone(docs):
    out = {r["file_id"]: r for r in R.repair_splits(docs, "file_id", params=SMALL).collect()}
    fixed = out[10]
    assert "demo cratic" not in fixed["text"] and "institutions" in fixed["text"] and fixed["text"].endswith("Democratic's; DEMOCRATIC")
    assert not out[0]["changed"] and not out[11]["changed"] and 12 not in out and out[10]["text"] == out[13]["text"]
    assert fixed["would_write"] and fixed["hyph"] == 0


def test_too_large_a_table_is_joined_with_the_same_result(docs):
    one = {r["file_id"]: r["text"] for r in R.repair_splits(docs, "file_id", params=SMALL).collect()}
    two = {r["file_id"]: r["text"] for r in R.repair_splits(docs, "file_id", params=SMALL, limit=0).collect()}
    assert one == two


def test_targets(docs):
    assert {r["file_id"] for r in R.split_targets(docs, "file_id", params=SMALL).collect()} == {10, 13}
    assert {r["file_id"] for r in R.split_targets(docs, "file_id", names=("C1.", ), params=SMALL).collect()} == {1}


def test_hyphen_decisions(spark):
    docs = spark.createDataFrame([(1, "deliberation deliberation deliberation decision-making decision-making\n x decision-\nmaking deliber-\nation foo-\r\nbar"), (2, None), (3, "")], "file_id long, text string")
    plain, hyph = L.dehyphenation_lexicons(docs)
    judged = R.judged_sites(R.hyphen_sites(docs, "file_id"), plain, hyph)
    assert [(r["a"], r["b"], r["verdict"]) for r in judged.orderBy("pos").collect()] == [("decision", "making", "HYPH"), ("deliber", "ation", "JOIN"), ("foo", "bar", "SKIP")]
    out = {r["file_id"]: r for r in R.dehyphenated(docs, judged, "file_id").collect()}
    assert out[1]["text"].endswith("x decision-making deliberation foo-\r\nbar") and out[1]["changed"]
    assert out[2]["text"] is None and out[3]["text"] == "" and not out[3]["changed"]
    assert {r["verdict"]: r["n"] for r in R.hyphen_totals(judged).collect()} == {"HYPH": 1, "JOIN": 1, "SKIP": 1}


def test_segments_prefer_few_long_pieces():
    log = {w: p for w, p in {"may": -3.0, "warehouse": -7.0, "ware": -5.0, "house": -5.0, "carefully": -7.0}.items()}
    assert R.segment("Maywarehousecarefully", log) == ["May", "warehouse", "carefully"]
    assert R.segment("warehouse", log) is None
    assert R.segment("xyz", log) is None


def test_piece_lexicon_knows_artifacts_from_compounds(spark):
    clean = spark.createDataFrame([("of", 90, 9), ("the", 99, 10), ("ofthe", 3, 2), ("under", 70, 7), ("stand", 70, 7), ("understand", 60, 6), ("rareword", 1, 1)], "w string, tf long, df long")
    rows = {r["w"]: r for r in R.piece_lexicon(clean, 10).collect()}
    assert rows["ofthe"]["glued"] and not rows["ofthe"]["piece"] and not rows["understand"]["glued"] and rows["understand"]["piece"]
    assert not rows["of"]["piece"] and not rows["rareword"]["keep"] and rows["ofthe"]["keep"] is False


@pytest.fixture
def glued(spark):
    clean = "people living together understand institutions without knowing evidence " * 60
    bad = ("peoplelivingtogether understand withoutknowingevidence institutions " * 100) + "environmentalistically"
    rows = [(i, f"c{i}", clean) for i in range(5)] + [(7, "bad", bad), (8, "n", None), (9, "e", "")]
    return spark.createDataFrame(rows, "file_id long, rel string, text string")


@pytest.mark.parametrize("limit", [0, 1000])
def test_unglue(glued, limit):
    p = Params(unglue_tokens=100)
    targets = R.unglue_targets(glued, "file_id", params=p)
    assert [(r["file_id"], r["skip_reason"]) for r in targets.collect()] == [(7, None)]
    row = R.unglue(glued, "file_id", targets=targets, params=p, limit=limit).first()
    assert row["cut"] == 200 and row["kept"] == 1 and row["text"].startswith("people living together understand without knowing evidence")
    assert row["text"].endswith("environmentalistically")


def test_unglue_skips(spark):
    p = Params(glue_tokens=3, unglue_tokens=10)
    long = "peoplelivingtogether "
    code = ("Ab9/" * 12 + " ") * 20
    rows = [("g", long + "der die das und " * 5), ("s", long + "a b c"), ("omnibus/x", long * 20), ("c", long * 20 + code)]
    docs = spark.createDataFrame(rows, "rel string, text string")
    got = {r["rel"]: r["skip_reason"] for r in R.unglue_targets(docs, "rel", excluded=("omnibus",), params=p).collect()}
    assert got == {"g": "german", "s": "small", "omnibus/x": "excluded", "c": "base64"}


def test_ladder_reaches_a_fixpoint():
    tf = {"deliberation": 60, "political": 60, "order": 5, "understanding": 100}
    text = "deliber-\nation.  polit ical; polit\nical. under standing well-known well-known well-known well-\nknown"
    out = R.ladder(text, lambda w: tf.get(w, 0))
    assert out == "deliberation. political; political. understanding well-known well-known well-known well-known"
    assert R.ladder(out, lambda w: tf.get(w, 0)) == out


def test_a_substitution_that_consumes_is_kept_and_the_walk_is_offered():
    tf = {"political": 60}
    text = "the polit ical"
    assert R.ladder(text, lambda w: tf.get(w, 0)) == "the polit ical"
    assert R.ladder(text, lambda w: tf.get(w, 0), walk=True) == "the political"


@pytest.mark.parametrize("limit", [0, 100_000])
def test_acceptance_of_fresh_extractions(spark, limit):
    p = Params(split_tokens=20, split_tf=20)
    good = "the political order of the country " * 20
    bad = "the polit ical order of the country " * 20
    docs = spark.createDataFrame([(1, bad), (2, bad), (3, bad), (4, bad + "一" * 50)], "id long, text string").withColumn("text", F.when(F.col("id") == 4, F.concat(F.lit("一"), "text")).otherwise(F.col("text")))
    fresh = spark.createDataFrame([(1, good), (2, good[:200]), (4, good)], "id long, text string")
    lexicon = L.term_frequency(docs.unionByName(spark.createDataFrame([(9, good * 30)], "id long, text string")))
    got = {r["id"]: (r["status"], r["why"]) for r in R.reextracted(docs, fresh, "id", lexicon, params=p, limit=limit).collect()}
    assert got[1] == ("done", None) and got[2][0] == "reocr" and got[3] == ("nopdf", "no PDF") and got[4] == ("reocr", "CJK file")




LONG = "insti tut ion al ism was polit ical and de mo cra ti za tion came; C O N S T I T U T I O N A L of it"


def lexicon_rows():
    words = {"institutionalism": 900, "institutional": 90, "institution": 60, "political": 80, "democratization": 400, "constitutional": 50}
    words |= {w[:i]: 21 + len(w) - i for w in ("institutionalism", "democratization") for i in range(6, len(w))}
    return [(w, n, 1) for w, n in words.items()]


@pytest.mark.parametrize("params", [R.DEFAULTS, Params(display_run=3, repair_passes=9, max_separator=6), Params(repair_passes=1)])
def test_facts_by_broadcast_and_by_rounds_repair_alike(spark, params):
    table = R.merge_table(spark.createDataFrame(lexicon_rows(), "w string, tf long, df long"), 100, params)
    docs = spark.createDataFrame([(None, LONG), (None, LONG + " again polit -  ical"), (1, ""), (2, "A B C is polit\nical"), (3, None)], "id long, text string")
    run = lambda limit: sorted(tuple(r) for r in R.resolved(docs.fillna(-1, ["id"]), "id", "text", R.split_facts(table), lambda t, look: R.SplitRepair(look, params).repair(t), R._REPAIRED, limit).collect())
    both = run(10**6), run(0)
    assert both[0] == both[1] and len(both[0]) == 4
    nulls = R.resolved(docs, "id", "text", R.split_facts(table), lambda t, look: R.SplitRepair(look, params).repair(t), R._REPAIRED, 0)
    assert sum(r["merged"] > 0 for r in nulls.where("id is null").collect()) == 2


@pytest.mark.parametrize("limit", [0, 100_000])
@pytest.mark.parametrize("walk", [False, True])
def test_chains_of_any_length_in_a_fresh_extraction(spark, limit, walk):
    words = {"ab": 1, "cd": 1, "ef": 1, "gh": 1, "ij": 1, "kl": 1, "abcd": 60, "efgh": 60, "ijkl": 60, "abcdefgh": 5000, "abcdefghijkl": 90_000}
    docs = spark.createDataFrame([(1, "x"), (None, "x")], "id long, text string")
    fresh = spark.createDataFrame([(1, "ab cd ef gh ij kl"), (None, "ab cd ef gh ij kl")], "id long, text string")
    lexicon = spark.createDataFrame(list(words.items()), "w string, tf long")
    got = R.reextracted(docs, fresh, "id", lexicon, walk=walk, limit=limit).where("id = 1").first()
    assert got["text"] == R.ladder("ab cd ef gh ij kl", lambda w: words.get(w, 0), walk=walk) == "abcdefghijkl"


def test_words_too_rare_to_count_change_nothing():
    rng = random.Random(4)
    least = R.least_that_counts()
    assert least == 3
    for _ in range(300):
        parts = [rng.choice(["abc", "de", "fgh", "ij"]) for _ in range(8)]
        text = "".join(p + rng.choice([" ", "-\n", "\n", "  "]) for p in parts)
        forms = {"".join(parts[i:j]) for i in range(8) for j in range(i + 1, 9)}
        tf = {w: rng.choice([0, 1, 2, 3, 9, 29, 30, 50, 400]) for w in forms}
        assert R.ladder(text, lambda w: tf.get(w, 0)) == R.ladder(text, lambda w: n if (n := tf.get(w, 0)) >= least else 0)


@pytest.mark.parametrize("limit", [0, 1000])
def test_walks_over_a_table(spark, limit):
    docs = spark.createDataFrame([(1, DEMO), (None, DEMO), (2, "é harb our"), (3, None)], "id long, text string")
    pairs = spark.createDataFrame([("harb", "our"), ("transla", "tion"), ("translation", "al")], "a string, b string")
    texts = lambda walk: sorted((r["text"], r["joins"]) for r in R.joined_pairs(docs, pairs, "id", walk=walk, limit=limit).collect())
    assert texts("once") == [("the harbour master of translation al notes", 2)] * 2 + [("é harbour", 1)]
    assert texts("fixpoint") == [("the harbour master of translational notes", 3)] * 2 + [("é harbour", 1)]
    assert texts("consuming") == [(DEMO, 0)] * 2 + [("é harbour", 1)]


def test_consuming_pairs_know_no_word_boundaries():
    assert R.consuming_pairs("éharb our", accept) == ("éharbour", 1)


def test_a_filter_refuses_no_name_it_holds(spark):
    from foliomend.operators import lookup

    names = [f"{a} {b}" for a in ("of", "été", "x" * 50, "") for b in map(str, range(300))]
    bits = lookup.filter_of(spark.createDataFrame([(n,) for n in names], "name string"))
    assert all(lookup.may_hold(bits, n) for n in names) and len(bits) == lookup.FILTER_BITS // 8
    assert sum(lookup.may_hold(bits, f"other {i}") for i in range(2000)) < 20


@pytest.mark.parametrize("limit", [0, 1000])
def test_split_counts_by_both_ways(spark, limit):
    docs = spark.createDataFrame([(1, "demo cratic Demo cratic order"), (None, "demo cratic"), (None, ""), (2, None)], "id long, text string")
    pairs = spark.createDataFrame([("demo", "cratic", True), ("cratic", "order", False)], "a string, b string, rough boolean")
    got = sorted((r["tokens"], r["pairs"], r["rough_pairs"]) for r in L.split_counts(docs, pairs, "id", limit=limit).collect())
    assert got == [(0, 0, 0), (2, 1, 1), (5, 3, 2)]
