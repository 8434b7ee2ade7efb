"""The registered queries over the engine's own operators, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomend.functions import text as T
from foliomend.operators import gates, pages, repair, witness
from foliomend.operators import lexicon as L
from foliomend.params import Params
from foliomend.plans import pipelines
from foliomend.runtime import one_row_per, stored
from foliomend.sources import pdf, sinks, synthetic

#: These collections' files are shorter than the books that the defaults were made for.
SHORT = Params(min_chars=2000, split_tokens=300, repair_tokens=300, unglue_tokens=300)
CORPORA = ("healthy", "wordsplit_damaged", "glued_damaged")

#: Long words that the registry query takes for real ones, and the letters from which on it takes words for glued.
REGISTRY, REGISTRY_LETTERS = ("interpolation", "sprachgeschichte", "ecclesiastical"), 13

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "rel", "text")


def digested(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with the digests of text columns in their place."""
    return rows.withColumns({c: F.md5(F.col(c).cast("binary")) for c in columns})


def files(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """The files of the corpora, each file_id once."""
    parts = [one_row_per(table(spark, d, n), "file_id").select("file_id", "rel", "text") for n in names or CORPORA]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- gates --------------------------------------------------------------------------------------------------------------


def glue_rate(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    rows = documents(spark, d).where("text is not null").select("doc_id", "text", T.lowered(T.tokens(t)).alias("__t"))
    rows = rows.select("doc_id", F.size("__t").cast("bigint").alias("tokens"), F.size(F.filter("__t", lambda w: F.length(w) >= 18)).cast("bigint").alias("long_tokens"), L.glue_rate(t).alias("glue"), T.is_german(F.col("__t")).alias("german"), T.cjk_share(t).alias("cjk"))
    red = F.coalesce((F.col("glue") >= 3.0) & ~F.col("german") & (F.col("cjk") <= 0.05), F.lit(False))
    return rows.withColumn("red", red)


def phrase_density(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, d).where("text is not null").select("doc_id", T.occurrences_of_all(t, T.PHRASES).alias("phrases"), T.phrase_density(t, F.size(T.tokens(t))).alias("density"))


def accent_misreads(spark: SparkSession, d: str) -> DataFrame:
    good, bad = T.accents(F.col("text"))
    rows = documents(spark, d).where("text is not null").select("doc_id", good.alias("good"), bad.alias("bad"))
    ratio = F.when(F.col("good") + F.col("bad") >= 5, F.col("bad") / F.greatest(F.col("good") + F.col("bad"), F.lit(1)) * 100)
    return rows.withColumn("ratio", ratio).withColumn("red", F.coalesce(F.col("ratio") > 50, F.lit(False)))


def page_anchor_gate(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", T.has_pages(F.col("text")).alias("page_ok"))


def _health(spark: SparkSession, d: str) -> pipelines.Health:
    return pipelines.health_check(files(spark, d), "file_id", params=SHORT)


def health_rows(spark: SparkSession, d: str) -> DataFrame:
    return _health(spark, d).rows


def health_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _health(spark, d).verdict.drop("gate3", "not_run")


def health_report(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen worst files of gate 5."""
    return pipelines.report(_health(spark, d).rows, "sp", "gate5", 15, "file_id")


def health_registry(spark: SparkSession, d: str) -> DataFrame:
    """Glue rates with long words known to be real."""
    rows = gates.health_rows(files(spark, d), "file_id", registry=tuple(w.upper() for w in REGISTRY), params=replace(SHORT, glue_letters=REGISTRY_LETTERS))
    return rows.select("file_id", "words", "glue", "glue_x")


def _fonts(spark: SparkSession, d: str) -> DataFrame:
    """The pages of the first witness as if set in fonts: those of some volumes in a hidden one, with some pages in another; one
    page in fifty can't be read."""
    f = F.concat(F.lit("scan-"), F.col("file_id").cast("string"), F.lit(".pdf"))
    hidden = (F.col("file_id") % 3 > 0) & ((F.col("page") % 4 > 0) | (F.col("file_id") % 3 == 1))
    pages_ = table(spark, d, "pages_a").where("words is not null").dropDuplicates(["file_id", "page"])
    rows = pages_.select(f.alias("f"), F.lit(9).alias("pages"), F.when(hidden, "GlyphLessFont").otherwise("Garamond").alias("font"), F.length(F.array_join("words", "")).cast("bigint").alias("chars"), F.when(F.col("page") % 50 == 0, "broken").alias("err"))
    return rows.withColumn("kind", F.explode(F.array(F.lit("named"), F.lit("set"))))


def hidden_layers(spark: SparkSession, d: str) -> DataFrame:
    """Gate 3 over the fonts of pages, against the health rows of the texts of the same names."""
    texts = files(spark, d, "healthy").withColumn("rel", F.concat(F.lit("scan-"), F.col("file_id").cast("string"), F.lit(".txt")))
    rows, median = gates.gate_flags(gates.health_rows(texts, "rel", params=SHORT), SHORT)
    return gates.hidden_layers(pdf.layers_of(_fonts(spark, d)), rows, median, params=SHORT)


def garble_report(spark: SparkSession, d: str) -> DataFrame:
    """The forty flagged documents of the highest rates."""
    return pipelines.report(garble_rate(spark, d), "rate", "flagged", 40, "doc_id")


def garble_rate(spark: SparkSession, d: str) -> DataFrame:
    return gates.garble_rows(documents(spark, d), "doc_id")


def garble_calibration(spark: SparkSession, d: str) -> DataFrame:
    return gates.garble_calibration(garble_rate(spark, d))


def probe(spark: SparkSession, d: str) -> DataFrame:
    return gates.probe_rows(documents(spark, d), "doc_id")


def pdf_risk(spark: SparkSession, d: str) -> DataFrame:
    """Texts of documents as if of up to twenty pages each, some with control characters, some with their letters set apart, with
    makers, fonts and images that hang on the number."""
    i, t = F.col("doc_id"), F.col("text")
    text = F.when(i % 13 == 0, F.concat(t, F.repeat(F.lit("\x01"), (F.length(t) / 50).cast("int")))).when(i % 17 == 0, F.regexp_replace(t, "([A-Za-z])", "$1 ")).otherwise(t)
    rows = gates.probe_rows(documents(spark, d).select("doc_id", text.alias("text")), "doc_id")
    rows = rows.withColumns({
        "chars_per_page": F.col("chars") / (1 + i % 20).cast("double"),
        "producer": F.when(i % 7 == 0, "ABBYY FineReader 12").when(i % 7 == 1, "Press Suite"),
        "glyphless": i % 11 == 0,
        "image_pages": (i % 12).cast("int"),
        "sampled": F.lit(11),
    })
    return gates.pdf_risk(rows).select("doc_id", F.array_join(F.transform("findings", lambda x: x.cast("string")), ",").alias("findings"))


# -- lexicons -----------------------------------------------------------------------------------------------------------


def lexicon_tf(spark: SparkSession, d: str) -> DataFrame:
    return L.term_frequency(documents(spark, d))


def lexicon_top(spark: SparkSession, d: str) -> DataFrame:
    return L.term_frequency(documents(spark, d)).orderBy(F.desc("tf"), "w").limit(50)


def lexicon_tf_df(spark: SparkSession, d: str) -> DataFrame:
    return L.frequencies(files(spark, d, "healthy"))


def lexicon_df_normal(spark: SparkSession, d: str) -> DataFrame:
    words = T.lowered(T.normal_words(F.col("text")))
    return L.document_frequency(files(spark, d, "healthy").where("text is not null"), "file_id", words)


def split_rate(spark: SparkSession, d: str) -> DataFrame:
    docs = files(spark, d)
    return L.split_rates(docs, L.term_frequency(docs), "file_id", params=SHORT)


def clean_for_splits(spark: SparkSession, d: str) -> DataFrame:
    return L.clean_for_splits(files(spark, d), "file_id", params=SHORT).select("file_id")


def clean_for_glue(spark: SparkSession, d: str) -> DataFrame:
    return L.clean_for_glue(files(spark, d)).select("file_id")


def words_and_separators(spark: SparkSession, d: str) -> DataFrame:
    """The words of the damaged files with what stands after each, as digests."""
    plain = files(spark, d, "wordsplit_damaged").where("text is not null").select("file_id", T.normalised(F.col("text")).alias("t"))
    rows = plain.select("file_id", T.normal_words_and_separators(F.col("t")).alias("x"))
    joined = F.array_join(F.transform("x", lambda x: F.concat(x["w"], F.lit("|"), x["sep"])), "\x02")
    return rows.select("file_id", F.size("x").cast("bigint").alias("words"), F.md5(joined.cast("binary")).alias("digest"))


def separators(spark: SparkSession, d: str) -> DataFrame:
    """What stands between neighbouring tokens of the damaged files, by kind."""
    between = F.filter(F.split("text", T.WORD, -1), lambda x: x != "")
    rows = files(spark, d, "wordsplit_damaged").where("text is not null").select(F.explode(between).alias("sep")).select(T.separator_class(F.col("sep")).alias("c"))
    return rows.groupBy("c.ok", "c.hyphen").agg(F.count("*").alias("n"))


def hyphen_lexicons(spark: SparkSession, d: str) -> DataFrame:
    plain, hyphenated = L.dehyphenation_lexicons(files(spark, d))
    return plain.select(F.lit("plain").alias("kind"), "w", "tf").unionByName(hyphenated.select(F.lit("hyphenated").alias("kind"), F.col("h").alias("w"), "tf"))


# -- repairs ------------------------------------------------------------------------------------------------------------


def ligatures(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a ligature or the glyph that is dropped, as digests of what they become."""
    glyphs = "[" + "".join(g for g, _ in T.LIGATURES) + T.DROPPED_GLYPH + "]"
    rows = documents(spark, d).where(F.col("text").rlike(glyphs)).select("doc_id", T.expand_ligatures(F.col("text")).alias("text"))
    return rows.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def joined_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d, "wordsplit_damaged").where("text is not null")
    return digested(rows.select("file_id", T.dehyphenate_lines(F.col("text")).alias("whole"), T.dehyphenate_lines(F.col("text"), False).alias("by_page")), "whole", "by_page")


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = files(spark, d)
    plain, hyphenated = L.dehyphenation_lexicons(docs)
    return docs, repair.judged_sites(repair.hyphen_sites(docs, "file_id"), plain, hyphenated)


def hyphen_sites(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)[1].select("file_id", "pos", "a", "b", "plain_tf", "hyphen_tf", "verdict")


def hyphen_totals(spark: SparkSession, d: str) -> DataFrame:
    return repair.hyphen_totals(_judged(spark, d)[1])


def dehyphenated(spark: SparkSession, d: str) -> DataFrame:
    docs, judged = _judged(spark, d)
    return digested(repair.dehyphenated(docs.where("text is not null"), stored(judged), "file_id"), "text")


def dehyphenation_report(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.changes_report(pipelines.dehyphenation_run(files(spark, d), "file_id")[0], key="file_id")


def _walked(spark: SparkSession, d: str, walk: str) -> DataFrame:
    docs = files(spark, d, "wordsplit_damaged")
    pairs = L.split_pairs(L.term_frequency(docs), SHORT)
    return digested(repair.joined_pairs(docs, pairs, "file_id", walk=walk), "text")


def pair_walk(spark: SparkSession, d: str) -> DataFrame:
    """One walk over each text that joins every split pair of the lexicon."""
    return _walked(spark, d, "once")


def pair_walk_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """Walks until nothing changes."""
    return _walked(spark, d, "fixpoint")


def pair_walk_consuming(spark: SparkSession, d: str) -> DataFrame:
    """The counter-example, whose refused pairs use up both words."""
    return _walked(spark, d, "consuming")


def merge_table(spark: SparkSession, d: str) -> DataFrame:
    clean = L.clean_for_splits(files(spark, d), "file_id", params=SHORT)
    lexicon = stored(L.frequencies(clean))
    return repair.merge_table(lexicon, clean.count(), SHORT)


def split_targets(spark: SparkSession, d: str) -> DataFrame:
    return repair.split_targets(files(spark, d), "file_id", params=SHORT)


def split_targets_named(spark: SparkSession, d: str) -> DataFrame:
    """Files named by a part of their name, whatever their rate."""
    return repair.split_targets(files(spark, d), "file_id", names=("OMNIBUS", " -1"), params=SHORT)


def split_repair(spark: SparkSession, d: str) -> DataFrame:
    return digested(pipelines.split_repair_run(files(spark, d), "file_id", params=SHORT).drop("examples", "left"), "text")


def piece_lexicon(spark: SparkSession, d: str) -> DataFrame:
    clean = L.clean_for_glue(files(spark, d))
    return repair.piece_lexicon(stored(L.frequencies(clean)), clean.count())


def unglue_targets(spark: SparkSession, d: str) -> DataFrame:
    return repair.unglue_targets(files(spark, d), "file_id", excluded=("omnibus",), params=SHORT)


def unglued(spark: SparkSession, d: str) -> DataFrame:
    return digested(pipelines.unglue_run(files(spark, d), "file_id", params=SHORT)[0].drop("examples", "left"), "text")


def _reextracted(spark: SparkSession, d: str) -> DataFrame:
    """The ladder for the split files, the texts of the glued ones standing in for fresh extractions of the same places."""
    split = files(spark, d, "wordsplit_damaged")
    fresh = files(spark, d, "glued_damaged").select((F.col("file_id") - 3_000_000).alias("file_id"), "text")
    return repair.reextracted(split, fresh, "file_id", L.term_frequency(files(spark, d)), params=SHORT)


def reextraction(spark: SparkSession, d: str) -> DataFrame:
    return digested(_reextracted(spark, d), "text")


def reocr_queue(spark: SparkSession, d: str) -> DataFrame:
    """The queue as it is written."""
    return sinks.queue_rows(_reextracted(spark, d).withColumn("rel", F.concat(F.lit("scan-"), F.col("file_id").cast("string"))))


# -- pages and witnesses ------------------------------------------------------------------------------------------------


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    return digested(pages.page_texts(files(spark, d), "file_id"), "text")


def page_words(spark: SparkSession, d: str) -> DataFrame:
    rows = pages.words_with_pages(files(spark, d, "healthy"), "file_id")
    return rows.select("file_id", "ord", "page", F.size("words").cast("bigint").alias("words"), F.md5(F.array_join("words", " ").cast("binary")).alias("digest"))


def _headed(spark: SparkSession, d: str) -> DataFrame:
    """Healthy texts, whole, in stretches of up to 500 characters, each after a number and a running head."""
    return files(spark, d, "healthy").where("length(text) > 0").select("file_id", F.expr("array_join(transform(sequence(0, cast(ceil(length(text) / 500) as int) - 1), i -> concat(cast(i + 1 as string), ' THE RUNNING HEAD ', substring(text, i * 500 + 1, 500), '\n')), '')").alias("text"))


def recovered_anchors(spark: SparkSession, d: str) -> DataFrame:
    return pages.anchor_gates(pages.recovered_anchors(_headed(spark, d), "file_id", ["THE RUNNING HEAD"]), "file_id")


def anchored_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = _headed(spark, d)
    kept = stored(pages.recovered_anchors(docs, "file_id", ["THE RUNNING HEAD"]))
    return digested(pages.anchored(docs, kept, pages.anchor_gates(kept, "file_id"), "file_id"), "text")


def _compared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return witness.compared_pages(table(spark, d, "pages_a"), table(spark, d, "pages_b"), table(spark, d, "lexicon"))


def disagreements(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d)[0]


def disagreement_totals(spark: SparkSession, d: str) -> DataFrame:
    return witness.bucket_totals(*_compared(spark, d))


def second_witness(spark: SparkSession, d: str) -> DataFrame:
    """Texts with page anchors against the same pages with the line-end hyphens and ligatures decided, from text to buckets."""
    docs, judged = _judged(spark, d)
    other = repair.dehyphenated(docs.where("text is not null"), stored(judged), "file_id")
    read = pages.page_texts(other, "file_id", plain=False).withColumn("text", T.expand_ligatures(F.col("text")))
    return witness.bucket_totals(*witness.second_witness(docs, read, "file_id")[:2])


def disagreement_report(spark: SparkSession, d: str) -> DataFrame:
    """The first sixty rows of each bucket."""
    return pipelines.disagreement_report(_compared(spark, d)[0])


def heads_and_piece(spark: SparkSession, d: str) -> DataFrame:
    """Texts without the lines of a running head, with how many there were, and a piece cut out of each between two words."""
    t = F.col("text")
    rest, heads = T.strip_heads(t, "the catalogue|on catalogues|le catalogue")
    piece, fine = T.cut_piece(t, "the ", " of")
    rows = files(spark, d).where("text is not null").select("file_id", rest.alias("rest"), heads.alias("heads"), piece.alias("piece"), fine.alias("cut"))
    return digested(rows, "rest", "piece")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """Each file against itself with its line-end hyphens decided."""
    docs, judged = _judged(spark, d)
    other = repair.dehyphenated(docs, stored(judged), "file_id").select("file_id", F.col("text").alias("text_b"))
    return witness.aligned(docs.select("file_id", F.col("text").alias("text_a")).join(other, "file_id"), "file_id", heads="the catalogue|on catalogues", offset=-10)


def non_words(spark: SparkSession, d: str) -> DataFrame:
    return witness.non_words(files(spark, d, "wordsplit_damaged"), table(spark, d, "lexicon").select("w"), "file_id")


def switch_decisions(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "lexicon").select("w")
    layer = witness.non_words(files(spark, d, "wordsplit_damaged"), words, "file_id")
    ocr = witness.non_words(files(spark, d, "glued_damaged"), words, "file_id").withColumn("file_id", F.col("file_id") - 3_000_000)
    return witness.switch_decisions(layer, ocr, "file_id")


def damaged_on_purpose(spark: SparkSession, d: str) -> DataFrame:
    docs = files(spark, d, "healthy").where("text is not null")
    split, glued = synthetic.split_words(docs, "file_id"), synthetic.glue_spans(docs, "file_id")
    return digested(split.withColumnRenamed("text", "split").join(glued.withColumnRenamed("text", "glued"), "file_id"), "split", "glued")


_QUERIES: tuple[Query, ...] = (
    glue_rate, phrase_density, accent_misreads, page_anchor_gate, health_rows, health_verdict, health_report, health_registry, hidden_layers, garble_rate, garble_report, garble_calibration, probe, pdf_risk,
    lexicon_tf, lexicon_top, lexicon_tf_df, lexicon_df_normal, split_rate, clean_for_splits, clean_for_glue, words_and_separators, separators, hyphen_lexicons,
    ligatures, joined_lines, hyphen_sites, hyphen_totals, dehyphenated, dehyphenation_report, pair_walk, pair_walk_fixpoint, pair_walk_consuming, merge_table, split_targets, split_targets_named, split_repair, piece_lexicon, unglue_targets, unglued, reextraction, reocr_queue,
    page_texts, page_words, recovered_anchors, anchored_texts, disagreements, disagreement_totals, disagreement_report, second_witness, heads_and_piece, aligned, non_words, switch_decisions, damaged_on_purpose,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from foliomend.oracle import SQL

    return dict(SQL)
