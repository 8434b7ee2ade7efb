"""Health rows and the gates over them. A null means not measurable, never 0, and no gate fires on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomend.functions import text as T
from foliomend.operators import lexicon as L
from foliomend.params import DEFAULTS, Params
from foliomend.runtime import stored


def health_rows(docs: DataFrame, key: str, text: str = "text", lexicon: DataFrame | None = None, registry: tuple[str, ...] = (), params: Params = DEFAULTS) -> DataFrame:
    """One row for each document of min_chars characters or more: chars, words, cjk, glue, glue_x, de, phrase, acc_good,
    acc_bad, acc_ratio, page_ok and, with a lexicon, sp.

    registry: long words known to be real; they leave the numerator of glue only. Null texts and shorter ones give no row.
    All but sp is one projection without a shuffle."""
    real = [w.lower() for w in registry]
    body = docs.where(F.length(text) >= params.min_chars).select(F.col(key), F.col(text).alias("text"))
    t = F.col("text")
    good, bad = T.accents(t)
    rows = body.select(key, "text", T.lowered(T.tokens(t)).alias("__t")).select(
        key,
        F.length("text").cast("bigint").alias("chars"),
        F.size("__t").cast("bigint").alias("words"),
        T.cjk_share(t).alias("cjk"),
        F.size(F.filter("__t", lambda w: F.length(w) >= params.glue_letters)).cast("bigint").alias("__long"),
        F.size(F.filter("__t", lambda w: (F.length(w) >= params.glue_letters) & w.isin(real))).cast("bigint").alias("glue_x") if real else F.lit(0).cast("bigint").alias("glue_x"),
        T.is_german(F.col("__t")).alias("de"),
        T.phrase_density(t, F.size("__t")).alias("phrase"),
        good.alias("acc_good"),
        bad.alias("acc_bad"),
        T.has_pages(t).alias("page_ok"),
    )
    rows = rows.withColumn("glue", F.when(F.col("words") >= params.glue_tokens, (F.col("__long") - F.col("glue_x")) / F.greatest("words", F.lit(1)) * 1000))
    seen = F.col("acc_good") + F.col("acc_bad")
    rows = rows.withColumn("acc_ratio", F.when(seen >= params.accent_evidence, F.col("acc_bad") / F.greatest(seen, F.lit(1)) * 100)).drop("__long")
    if lexicon is None:
        return rows.withColumn("sp", F.lit(None).cast("double"))
    return rows.join(L.split_rates(body, lexicon, key, "text", params=params).select(key, F.col("splitpair").alias("sp")), key, "left")


def at_ranks(df: DataFrame, column: str, ranks: Callable[[int], dict[str, int]]) -> dict[str, float]:
    """The values at the ranks (from 0) that ranks gives for the number of values that aren't null; 0 for each without any.

    Distinct values are put in ranges; each range's number of rows comes to the driver, and the ranks are then looked for in
    the few ranges that hold them, each in a task of its own."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ordered = stored(counted.repartitionByRange(F.col(column)).withColumn("part", F.spark_partition_id()))
    sums = ordered.groupBy("part").agg(F.sum("n").alias("n"), F.min(column).alias("low")).orderBy("low").collect()
    wanted = ranks(sum(r["n"] for r in sums))
    if not sums:
        return dict.fromkeys(wanted, 0.0)
    at, before = {}, 0
    for r in sums:
        at |= {name: (r["part"], rank - before) for name, rank in wanted.items() if before <= rank < before + r["n"]}
        before += r["n"]
    upto = F.sum("n").over(Window.partitionBy("part").orderBy(column))
    running = ordered.where(F.col("part").isin([p for p, _ in at.values()])).withColumn("upto", upto)
    row = running.agg(*(F.min(F.when((F.col("part") == p) & (F.col("upto") > k), F.col(column))).alias(name) for name, (p, k) in at.items())).first()
    return {name: float(row[name]) for name in at}


def upper_median(df: DataFrame, column: str) -> float:
    """The value at floor(n / 2) of the sorted values that aren't null, 0 without any."""
    return at_ranks(df, column, lambda n: {"median": n // 2})["median"]


def gate_flags(rows: DataFrame, params: Params = DEFAULTS) -> tuple[DataFrame, float]:
    """health_rows with a flag for each gate over text: gate1 phrases dead against the upper median of the Latin files, gate2
    accents misread, gate4 no page anchors, gate5 split words, gate6 glued words; and that median."""
    rows = stored(rows)
    latin = F.col("cjk") <= params.cjk_limit
    median = upper_median(rows.where(latin), "phrase")
    no = F.lit(False)
    return rows.select(
        "*",
        (latin & (F.col("phrase") < F.lit(median * params.phrase_dead))).alias("gate1"),
        F.coalesce(F.col("acc_ratio") > params.accent_red, no).alias("gate2"),
        (~F.col("page_ok")).alias("gate4"),
        (latin & F.coalesce(F.col("sp") >= params.split_red, no)).alias("gate5"),
        (latin & ~F.col("de") & F.coalesce(F.col("glue") >= params.glue_red, no)).alias("gate6"),
    ), median


def hidden_layers(layers: DataFrame | None, rows: DataFrame, median: float, key: str = "rel", params: Params = DEFAULTS) -> DataFrame | None:
    """Gate 3: state of each PDF of layers (f, pages, other_pct, dual, err) against the health row of the text of the same
    name: ok, red, single or warn. None, that is not run, if there are no layers to look at."""
    if layers is None:
        return None
    stem = lambda c: F.regexp_replace(c, r"\.[^.]{3}$", "")
    texts = rows.select(stem(F.col(key)).alias("__stem"), "phrase")
    joined = layers.withColumn("__stem", stem(F.col("f"))).join(texts, "__stem", "left").drop("__stem")
    clean = F.coalesce(F.col("phrase") >= median * params.phrase_clean, F.lit(False))
    state = F.when(F.col("err").isNotNull(), "warn").when(~F.coalesce("dual", F.lit(False)), "single").when(clean, "ok").otherwise("red")
    return joined.withColumn("state", state)


def verdict(flags: DataFrame, layers: DataFrame | None = None, wanted: bool = False) -> DataFrame:
    """One row: files, findings of each gate, findings in all, not_run and result: ALL GREEN, FINDINGS, or INCOMPLETE where a
    gate that was wanted didn't run and the others found nothing."""
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).alias(c)
    out = flags.agg(F.count("*").alias("files"), *(n(f"gate{i}") for i in (1, 2, 4, 5, 6)))
    red = layers.where("state = 'red'").count() if layers is not None else 0
    out = out.withColumn("gate3", F.lit(red).cast("bigint") if layers is not None else F.lit(None).cast("bigint"))
    out = out.withColumn("findings", sum((F.col(f"gate{i}") for i in (1, 2, 4, 5, 6)), F.lit(red)))
    out = out.withColumn("not_run", F.lit(1 if wanted and layers is None else 0))
    return out.withColumn("result", F.when(F.col("findings") > 0, "FINDINGS").when(F.col("not_run") > 0, "INCOMPLETE").otherwise("ALL GREEN"))


def garble_rows(docs: DataFrame, key: str, text: str = "text", params: Params = DEFAULTS) -> DataFrame:
    """key, rate, garbled, total, cid and flagged of each document."""
    g = docs.select(F.col(key), T.garble(F.col(text)).alias("g")).select(key, "g.*")
    return g.withColumn("flagged", F.col("cid") | (F.col("rate") * 1000 >= params.garble_flag))


def garble_calibration(garbled: DataFrame) -> DataFrame:
    """One row: files, nonzero, nonzero_pct, cid_files and the upper median, p90 and greatest of the rates above 0 in per mille
    (0 if there are none)."""
    garbled = stored(garbled)
    rates = garbled.where("rate > 0").select((F.col("rate") * 1000).alias("r"))
    picks = at_ranks(rates, "r", lambda n: {"median": n // 2, "p90": min(int(n * 0.9), n - 1), "max": n - 1})
    counts = garbled.agg(F.count("*").alias("files"), F.coalesce(F.sum((F.col("rate") > 0).cast("bigint")), F.lit(0)).alias("nonzero"), F.coalesce(F.sum(F.col("cid").cast("bigint")), F.lit(0)).alias("cid_files"))
    return counts.select("*", (T.share(F.col("nonzero"), F.col("files")) * 100).alias("nonzero_pct"), *(F.lit(v).alias(k) for k, v in picks.items()))


def probe_rows(docs: DataFrame, key: str, text: str = "text", params: Params = DEFAULTS) -> DataFrame:
    """What the risk probe of a PDF's text measures: chars, words, ctrl_pct (over the first control_head characters), single_pct and
    lang, the vote of the function words of three languages, French winning ties, even of zeros."""
    latin = F.regexp_extract_all(F.col(text), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))
    head = F.substring(F.col(text), F.lit(1), F.lit(params.control_head))
    body = docs.where(F.col(text).isNotNull()).select(F.col(key), F.col(text), T.lowered(latin).alias("__w"), head.alias("__h"))
    body = body.select(
        key,
        F.length(text).cast("bigint").alias("chars"),
        F.size("__w").cast("bigint").alias("words"),
        (T.share(T.matches(F.col("__h"), T.CONTROL), F.length("__h")) * 100).alias("ctrl_pct"),
        (T.share(F.size(F.filter("__w", lambda w: F.length(w) == 1)), F.size("__w")) * 100).alias("single_pct"),
        T.votes(F.col("__w"), T.ENGLISH).alias("en"),
        T.votes(F.col("__w"), T.FRENCH).alias("fr"),
        T.votes(F.col("__w"), T.GERMAN).alias("de"),
    )
    lang = F.when(F.col("words") == 0, "en").when(F.col("fr") >= F.greatest("en", "de"), "fr").when(F.col("de") >= F.greatest("en", "fr"), "de").otherwise("en")
    return body.withColumn("lang", lang)


# Fixed values.
OCR_PRODUCERS = ("clearscan", "paper capture", "abbyy", "finereader", "tesseract", "ocrmypdf")


def pdf_risk(probes: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """findings (an array) of each probe: 5 alone for a pure image; else 1 broken character map, 2 letters placed one by one, 3
    an old recognition, 4 images on most pages if none of these; 6 if there is nothing to say.

    probes: probe_rows with chars_per_page, producer, glyphless, image_pages and sampled; null metadata say nothing."""
    producer = F.lower(F.coalesce("producer", F.lit("")))
    old = F.coalesce("glyphless", F.lit(False))
    for name in OCR_PRODUCERS:
        old = old | F.contains(producer, F.lit(name))
    three = F.array_compact(F.array(F.when(F.col("ctrl_pct") > params.control_percent, 1), F.when(F.col("single_pct") > params.single_percent, 2), F.when(old, 3)))
    images = (F.coalesce("image_pages", F.lit(0)) >= F.col("sampled") * params.image_share) & (F.col("chars_per_page") > params.image_page_chars)
    found = F.when(F.col("chars_per_page") < params.image_chars, F.array(F.lit(5))).when(F.size(three) > 0, three).when(F.coalesce(images, F.lit(False)), F.array(F.lit(4))).otherwise(F.array(F.lit(6)))
    return probes.withColumn("findings", found)
