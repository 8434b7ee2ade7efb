import pytest

from foliomend.functions.text import normalise
from foliomend.operators import pages as P
from foliomend.operators import witness as W

LEXICON = {"the": 700, "and": 700, "of": 700, "where": 600, "letters": 500, "book": 504, "binding": 480, "bookbinding": 65, "any": 600, "body": 400, "anybody": 500, "arithmetic": 300, "chronology": 40, "c": 3}
FILLER = "a quiet reader kept every key of the mill and told the miller about it in the cold of the winter"


def words_seps(text):
    import re

    t = normalise(text)
    found = list(re.finditer(r"[A-Za-z][A-Za-z']*", t))
    return [(m[0].rstrip("'"), t[m.end() : n.start()] if n else "") for m, n in zip(found, [*found[1:], None])]


def compare(a, b):
    first, second = W.Reading(), W.Reading()
    for page, text in a.items():
        first.words[page] = [w for w, _ in words_seps(text)]
        first.seps[page] = []
    for page, text in b.items():
        second.words[page] = [w for w, _ in words_seps(text)]
        second.seps[page] = [s for _, s in words_seps(text)]
    return W.Comparison(first, second, lambda w: LEXICON.get(w, 0)).run()


PAGES_A = {1: "whereletters " + FILLER, 2: "C hronology " + FILLER, 3: "arithmetic and anybody " + FILLER, 4: "bookbinding " + FILLER, 5: FILLER}
PAGES_B = {1: "where letters " + FILLER, 2: "Chronology " + FILLER, 3: "arith-\nmetic and any-\nbody " + FILLER, 4: "book-\nbinding " + FILLER, 5: FILLER + " nobody in the town had seen the ferry leave or the boats return from the island"}


def test_kinds_of_disagreement():
    done = compare(PAGES_A, PAGES_B)
    by = lambda bucket: {" ".join(r.x).lower() for r in done.rows if r.bucket == bucket}
    assert {"whereletters", "bookbinding"} <= by("a_glue") and "c hronology" in by("a_split")
    assert done.counts["join_ok"] >= 2 and sum(r.bucket == "a_missing" for r in done.rows) == 1


def frames(spark, a, b):
    rows_a = [(1, p, [w for w, _ in words_seps(t)]) for p, t in a.items()]
    rows_b = [(1, p, words_seps(t)) for p, t in b.items()]
    return spark.createDataFrame(rows_a, "file_id long, page int, words array<string>"), spark.createDataFrame(rows_b, "file_id long, page int, words array<struct<w:string,sep:string>>")


@pytest.mark.parametrize("limit", [0, 1000])
def test_furniture_is_counted_not_reported(spark, limit):
    lexicon = spark.createDataFrame([*LEXICON.items(), ("the", 3), (None, 1), ("x", None)], "w string, df int")
    stamp = {p: "Lent by the county archive on this very day " + FILLER for p in range(1, 5)}
    a, b = frames(spark, stamp, {p: FILLER for p in range(1, 5)})
    empty = spark.createDataFrame([(1, 9, None), (None, 1, ["x"])], "file_id long, page int, words array<string>")
    rows, counters = W.compared_pages(a.unionByName(a).unionByName(empty), b, lexicon, limit=limit)
    totals = {(r["kind"], r["name"]): r["n"] for r in W.bucket_totals(rows, counters).collect()}
    assert totals["counter", "furniture_runs"] == 4 and totals["bucket", "a_extra"] == 0 and len(totals) == 16


def test_wrong_table_is_refused(spark):
    a, b = frames(spark, {1: FILLER}, {1: FILLER})
    with pytest.raises(ValueError):
        W.compared_pages(a, b, spark.createDataFrame([("df", 1)], "w string, df int"))


def test_alignment(spark):
    body = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 2
    a = f"preface\n== page 139 ==\n12 The Head\n{body}sails e on\nTHE HEAD 13\nthe rest"
    b = f"junk BEGIN preface The Head\n{body}sails on the rest END junk"
    df = spark.createDataFrame([(1, a, b), (2, a, "nothing of it"), (3, a, b * 3), (4, None, None), (5, a, a)], "id long, text_a string, text_b string")
    out = W.aligned(df, "id", heads="the head", b_head="BEGIN", b_tail="END", offset=100).collect()
    one = [r for r in out if r["id"] == 1]
    assert any(r["a"] == "e" and r["page"] == 139 and r["printed"] == 239 for r in one)
    assert {r["id"]: r["status"] for r in out if r["id"] in (2, 4, 5)} == {2: "uncut", 4: "uncut", 5: "uncut"}
    plain = {r["id"]: r["status"] for r in W.aligned(df, "id").collect()}
    assert plain[3] == "ratio" and plain[5] == "ok" and plain[4] == "ratio"


def test_scan_decisions(spark):
    layer = spark.createDataFrame([(1, 1000, 34), (2, 1000, 15), (3, 1000, 100), (4, 150, 9)], "id int, words long, bad long")
    ocr = spark.createDataFrame([(1, 1000, 21), (2, 1000, 16), (3, 1000, 90), (4, 900, 9)], "id int, words long, bad long")
    assert {r["id"]: r["verdict"] for r in W.switch_decisions(layer, ocr, "id").collect()} == {1: "switch", 2: "keep", 3: "keep", 4: "too few"}


def test_non_words(spark):
    known = spark.createDataFrame([(w,) for w in ("politicians", "modem", "speak", "political", "order", None)], "w string")
    docs = spark.createDataFrame([(1, "Politicians speak polit ical order, ord-\ner"), (2, "pohticians modem"), (3, ""), (4, None)], "id int, text string")
    got = {r["id"]: (r["words"], r["bad"]) for r in W.non_words(docs, known, "id").collect()}
    assert got == {1: (4, 0), 2: (2, 1), 3: (0, 0)}


def test_pages_between_anchors(spark):
    text = "front === Page 1 === one === page 2 ===two\n=== page 1 === again"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "none")], "id int, text string")
    assert {(r["page"], r["text"].strip()) for r in P.page_texts(docs, "id").collect()} == {(1, "again"), (2, "two")}
    lined = spark.createDataFrame([(1, "front words\n== page 7 ==\nOn it == page 8 == x\n")], "id int, text string")
    got = [(r["page"], list(r["words"])) for r in P.words_with_pages(lined, "id").orderBy("ord").collect()]
    assert got == [(None, ["front", "words"]), (7, ["on", "it", "page", "x"])]


def test_longest_rise():
    assert [[5, 1, 2, 9, 3][i] for i in P.longest_rise([5, 1, 2, 9, 3])] == [1, 2, 3]
    assert P.longest_rise([]) == []


def test_contents_at_the_front_are_left_out(spark):
    rows = [(1, 10 * i, p) for i, p in enumerate([1, 20, 40, 60, 80, 99, 1, 2, 3, 4, 5, 6])] + [(2, 0, 1), (2, 5, 2)]
    got = P.after_contents(spark.createDataFrame(rows, "id int, pos long, page int"), "id").orderBy("id", "pos").collect()
    assert [(r["id"], r["page"], r["raw"], r["dropped"]) for r in got] == [(1, p, 12, 6) for p in range(1, 7)] + [(2, 1, 2, 0), (2, 2, 2, 0)]


def test_head_hits_are_those_of_a_search(spark):
    import re

    heads = ["THE HEAD", "On (Other) Things"]
    texts = ["12 THE HEAD and 1234 THE HEAD\r\n7  THE HEAD 8 é9 THE HEAD\rOn (Other) Things 44x On (Other) Things\n45", "THE HEAD", "", None, "3 THE HEAD 4 THE HEAD 5"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = set()
    for i, t in enumerate(texts):
        t = (t or "").replace("\r\n", "\n").replace("\r", "\n")
        for h in map(re.escape, heads):
            want |= {(i, m.start(), int(m[1])) for p in (rf"\b(\d{{1,3}})\s+{h}", rf"{h}\s+(\d{{1,3}})\b") for m in re.finditer(p, t)}
    assert {tuple(r) for r in P.head_hits(df, "id", heads).collect()} == want and len(want) > 6
    assert P.head_hits(df, "id", []).count() == 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_two_witnesses_from_texts(spark, limit):
    lexicon = spark.createDataFrame(list(LEXICON.items()), "w string, df long")
    mark = "=== page {} ===\n{}\n"
    a = "".join(mark.format(p, t) for p, t in PAGES_A.items())
    docs = spark.createDataFrame([(1, a), (2, "no anchors"), (3, None)], "file_id long, text string")
    pages = spark.createDataFrame([(1, p, t) for p, t in PAGES_B.items()] + [(1, 9, None)], "file_id long, page int, text string")
    rows, counters, warnings = W.second_witness(docs, pages, "file_id", lexicon=lexicon, limit=limit)
    found = {(r["bucket"], " ".join(r["x"]).lower()) for r in rows.collect()}
    assert {("a_glue", "whereletters"), ("a_glue", "bookbinding"), ("a_split", "c hronology")} <= found
    assert {r["counter"]: r["n"] for r in counters.collect()}["join_ok"] >= 2
    assert tuple(warnings.first()) == (3, True, 2)


def test_a_table_without_common_words_can_be_no_dictionary(spark):
    docs = spark.createDataFrame([(1, "=== page 1 ===\nzebra")], "file_id long, text string")
    with pytest.raises(ValueError):
        W.second_witness(docs, docs.withColumn("page", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)), "file_id")


def test_words_run_together_are_found_at_their_beginnings():
    j = W.Joined(["The", "ferry", "man", "the", "ferryman"])
    assert list(j.spelled("ferryman", 4)) == [["ferry", "man"]] and list(j.spelled("theferryman", 2)) == [["the", "ferryman"]]
    assert list(j.spelled("theferryman", 3)) == [["The", "ferry", "man"], ["the", "ferryman"]] and list(W.Joined([]).spelled("x", 3)) == []


@pytest.mark.parametrize("limit", [0, 1000])
def test_non_words_by_both_ways(spark, limit):
    known = spark.createDataFrame([(w,) for w in ("politicians", "modem", "speak", "political", "order", None)], "w string")
    docs = spark.createDataFrame([(None, "Politicians speak polit ical order, ord-\ner"), (None, "pohticians modem"), (3, "")], "id int, text string")
    assert sorted((r["words"], r["bad"]) for r in W.non_words(docs, known, "id", limit=limit).collect()) == [(0, 0), (2, 1), (4, 0)]


def test_anchors_are_written_only_through_the_gates(spark):
    good = "contents HEAD 40 HEAD 90\n" + "".join(f"{i} HEAD " + "x" * 500 + "\r\n" for i in range(1, 20))
    few = "1 HEAD a 2 HEAD b"
    docs = spark.createDataFrame([(1, good), (2, few), (3, None), (4, "")], "id int, text string")
    kept = P.recovered_anchors(docs, "id", ["HEAD"])
    gates = P.anchor_gates(kept, "id")
    assert {r["id"]: r["passed"] for r in gates.collect()} == {1: True, 2: False}
    out = P.anchored(docs, kept, gates, "id").collect()
    assert len(out) == 1 and out[0]["text"].count("===== page ") == gates.where("id = 1").first()["kept"]
    assert "\n===== page 5 =====\n5 HEAD" in out[0]["text"]


def test_headed_texts_are_whole(spark, tmp_path):
    from foliomend import catalogue

    rows = [(1, "abcde" * 901 + "the end"), (2, "short"), (3, ""), (4, None), (5, "x" * 500)]
    spark.createDataFrame([(i, "r", t) for i, t in rows], "file_id long, rel string, text string").write.parquet(f"{tmp_path}/healthy.parquet")
    got = {r["file_id"]: r["text"] for r in catalogue._headed(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 5} and got[1].count("THE RUNNING HEAD") == 10
    assert got[2] == "1 THE RUNNING HEAD short\n" and got[5] == "1 THE RUNNING HEAD " + "x" * 500 + "\n"
    assert "".join(line.split(" HEAD ")[1] for line in got[1].splitlines()) == rows[0][1]
    gates = {r["file_id"]: r["passed"] for r in catalogue.recovered_anchors(spark, str(tmp_path)).collect()}
    assert gates == {1: True, 2: False, 5: False}
    docs = catalogue._headed(spark, str(tmp_path))
    kept = P.recovered_anchors(docs, "file_id", ["THE RUNNING HEAD"])
    whole = P.anchored(docs, kept, P.anchor_gates(kept, "file_id"), "file_id").collect()
    assert [(r["file_id"], "the end" in r["text"]) for r in whole] == [(1, True)]
    digests = [(r["file_id"], r["text"]) for r in catalogue.anchored_texts(spark, str(tmp_path)).collect()]
    assert digests == [(1, __import__("hashlib").md5(whole[0]["text"].encode()).hexdigest())]
