import os

import pytest

from foliomend.operators import lexicon as L
from foliomend.sources import files, pdf, sinks, synthetic
from foliomend.streaming import health


@pytest.fixture
def tree(tmp_path):
    for rel, content in {"a.txt": b"one\r\ntwo", "sub/b.TXT": b"caf\xc3\xa9 \xff", "_x/c.txt": b"no", "_d.txt": b"no", "e.md": b"no"}.items():
        (tmp_path / "in" / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / rel).write_bytes(content)
    return tmp_path


def test_text_tree(spark, tree):
    got = {r["rel"]: r["text"] for r in files.text_tree(spark, str(tree / "in")).collect()}
    assert got == {"a.txt": "one\ntwo", "sub/b.TXT": "café �"}
    raw = {r["rel"]: r["text"] for r in files.text_tree(spark, str(tree / "in"), fold_newlines=False).collect()}
    assert raw["a.txt"] == "one\r\ntwo"
    (tree / "in" / ".h.txt").write_bytes(b"hidden")
    every = {r["rel"]: r["text"] for r in files.text_tree(spark, str(tree / "in"), skip_underscored=False).collect()}
    assert files.listed_files(spark, [str(tree / "in" / "_d.txt")]).first()["text"] == "no"
    assert every == got | {"_x/c.txt": "no", "_d.txt": "no", ".h.txt": "hidden"}
    (tree / "none").mkdir()
    assert files.text_tree(spark, str(tree / "none"), skip_underscored=False).count() == 0


def test_head_lists_and_dictionaries(spark, tmp_path):
    (tmp_path / "heads").write_text(" The Head \n\nOther\n")
    assert files.running_heads(spark, str(tmp_path / "heads")) == ["The Head", "Other"]
    assert {r["w"] for r in files.dictionary(spark, str(tmp_path / "heads")).collect()} == {"the head", "other"}


def test_first_backup_stays_and_inputs_are_never_written_over(spark, tmp_path):
    originals = spark.createDataFrame([("a", "one"), ("b", "two"), ("d/a", "three")], "rel string, text string")
    fixed = spark.createDataFrame([("a", "ONE", True, True), ("b", "two!", True, False)], "rel string, text string, changed boolean, would_write boolean")
    version, backup = str(tmp_path / "v1"), str(tmp_path / "backup")
    assert sinks.apply_repairs(spark, originals, fixed, version, backup) == 1
    assert {r["rel"]: r["text"] for r in spark.read.parquet(version).collect()} == {"a": "ONE", "b": "two", "d/a": "three"}
    assert sinks.write_backup(spark, spark.createDataFrame([("a", "later")], "rel string, text string"), backup) == 0
    assert [r["text"] for r in spark.read.parquet(backup).collect()] == ["one"]
    with pytest.raises(Exception, match="exist"):
        sinks.write_version(originals, version)
    sinks.write_preview(fixed, str(tmp_path / "preview"))
    assert spark.read.parquet(str(tmp_path / "preview")).count() == 2


def test_missing_tools_are_all_named():
    assert set(pdf.missing()) <= {"pymupdf", "tesseract"}
    if pdf.library() is None:
        assert pdf.layers(None, "x") is None and pdf.page_texts(None, "x") is None and pdf.probes(None, "x") is None


def test_pages_become_one_text_in_order(spark):
    pages = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a"), ("f", 10, None)], "f string, page int, text string")
    assert pdf.anchored_texts(pages).first()["text"] == "\n===== page 1 =====\na\n===== page 2 =====\nb\n===== page 10 =====\n"


def test_damage_on_purpose_is_the_same_every_time(spark):
    passage = "the political consequences of institutions matter because people remember evidence\n" * 30
    clean = synthetic.build_clean(passage)
    assert clean.count("===== page") == 5 and clean.startswith("\n===== page 1 =====\n")
    docs = spark.createDataFrame([(1, clean), (2, clean), (3, None)], "id long, text string")
    one = {r["id"]: r["text"] for r in synthetic.split_words(docs, "id").collect()}
    two = {r["id"]: r["text"] for r in synthetic.split_words(docs.repartition(3), "id").collect()}
    assert one == two and one[1] != clean and one[1].replace(" ", "") == clean.replace(" ", "") and one[3] is None
    glued = {r["id"]: r["text"] for r in synthetic.glue_spans(docs, "id").collect()}
    assert len(glued[1]) < len(clean) and glued[1].replace(" ", "") == clean.replace(" ", "")


def test_streaming_measures_equal_a_batch_run(spark, tmp_path):
    docs = spark.createDataFrame([(i, "political " * 30 + "polit ical order " * i) for i in range(1, 6)], "doc_id long, text string")
    for i in range(2):
        docs.where(f"doc_id % 2 = {i}").write.mode("append").parquet(str(tmp_path / "in"))
    pairs = L.split_pairs(L.term_frequency(docs))
    stream = health.incoming(spark, str(tmp_path / "in"), docs, 1)
    for _ in range(2):  # the second start finds nothing new
        health.write_measures(stream, "doc_id", str(tmp_path / "out"), str(tmp_path / "cp"), pairs).awaitTermination()
    got = {r["doc_id"]: (r["tokens"], r["pairs"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: (30 + 3 * i, i) for i in range(1, 6)}
    assert len(os.listdir(tmp_path / "out")) >= 2


def test_late_and_repeated_documents(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "2024-01-02 00:00:00"), (1, "2024-01-01 00:00:00", "2024-01-03 00:00:00"), (2, "2024-01-01 00:00:00", "2024-03-01 00:00:00"), (3, None, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "doc_id long, s string, r string").selectExpr("doc_id", "timestamp(s) as scanned_at", "timestamp(r) as received_at")
    df.write.parquet(str(tmp_path / "in"))
    out = health.late_and_repeated(health.incoming(spark, str(tmp_path / "in"), df))
    q = out.writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["doc_id"], r["late"]) for r in spark.table("late").collect()} == {(1, False), (2, True), (3, False)}


class Document:
    """As much of a PDF library's document as the sources ask for."""

    def __init__(self, pages):
        self.pages, self.page_count, self.metadata = pages, len(pages), {"producer": "ABBYY", "creator": None}

    def __getitem__(self, i):
        from types import SimpleNamespace

        fonts, spans = self.pages[i]
        block = {"type": 0, "lines": [{"spans": [{"font": f, "text": t} for f, t in spans]}]}
        return SimpleNamespace(get_fonts=lambda full: [(0, 0, 0, f) for f in fonts], get_text=lambda kind: {"blocks": [block, {"type": 1}]} if kind == "dict" else "".join(t for _, t in spans), get_images=lambda: [1] if i % 2 else [])

    def get_page_fonts(self, i):
        return [(0, 0, 0, f) for f in self.pages[i][0]]


def test_layers_by_their_fonts(spark):
    from foliomend.sources import pdf

    dual = Document([(["GlyphLessFont", "Times"], [("GlyphLessFont", "a" * 80), ("Times", "b" * 20)])] * 40)
    hidden = Document([(["GlyphLessFont"], [("GlyphLessFont", "a" * 50)])] * 3)
    plain = Document([(["Times"], [("Times", "b")])] * 2)
    rows = [(f, *r) for f, doc in (("dual", dual), ("hidden", hidden), ("plain", plain), ("empty", Document([]))) for r in pdf._font_rows(doc)]
    assert len({r for r in rows if r[0] == "dual" and r[2] == "named"}) == 2 and sum(r[0] == "dual" and r[2] == "named" for r in rows) == 22
    fonts = spark.createDataFrame([*rows, ("broken", None, None, None, None, "no PDF")], "f string, pages int, kind string, font string, chars long, err string")
    got = {r["f"]: (r["pages"], r["other_pct"], r["dual"], r["err"]) for r in pdf.layers_of(fonts).collect()}
    assert got == {"dual": (40, 20.0, True, None), "hidden": (3, 0.0, False, None), "broken": (None, None, None, "no PDF")}


def test_probed_pages(spark):
    from foliomend.sources import pdf

    doc = Document([(["GlyphLessFont"], [("x", f"{i} ")]) for i in range(45)])
    rows = [("f", *r) for r in pdf._probe_rows(doc)]
    out = pdf.probed(spark.createDataFrame(rows[::-1], "f string, place int, text string, images boolean, hidden boolean, maker string")).first()
    assert out["sampled"] == 20 and out["text"].startswith("0 2 4 ") and out["glyphless"] and out["image_pages"] == 0 and out["producer"] == "ABBYY"
    assert out["chars_per_page"] == len(out["text"]) / 20 and pdf.evenly(0, 20, 20) == [] and pdf.evenly(45, 20, 20) == list(range(0, 40, 2))


def test_the_queue_is_written_as_it_is(spark, tmp_path):
    from foliomend.sources import sinks

    ladder = spark.createDataFrame([("a", "done", 7.123, 1.0, None), ("b", "nopdf", 9.0, None, "no PDF")], "rel string, status string, sp0 double, sp1 double, why string")
    sinks.write_queue(ladder, f"{tmp_path}/queue")
    got = {r["rel"]: r for r in spark.read.json(f"{tmp_path}/queue").collect()}
    assert got["a"]["sp0"] == 7.12 and got["a"]["status"] == "done" and got["b"]["why"] == "no PDF"


def test_a_corpus_damaged_on_purpose_is_found_out(spark):
    from foliomend.operators import lexicon as L
    from foliomend.params import Params
    from foliomend.sources import synthetic

    passage = "The patient archivist described every catalogue of the institution and compared several documents with another witness before anybody published them in the country.\n" * 20
    docs = synthetic.corpus(spark, passage, 10)
    rows = {r["rel"]: r for r in L.split_rates(docs, L.term_frequency(docs), "rel", params=Params(split_tf=20)).collect()}
    glue = {r["rel"]: r["g"] for r in docs.select("rel", L.glue_rate(docs["text"]).alias("g")).collect()}
    assert rows["healthy.txt"]["splitpair"] == 0 and rows["wordsplit-damaged.txt"]["splitpair"] > 5 and glue["glued-damaged.txt"] > 3 and glue["healthy.txt"] == 0
