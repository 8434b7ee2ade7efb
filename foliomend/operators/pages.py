"""Pages: text between anchors, the page of each word, and printed page numbers won back from running heads."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomend.functions import text as T
from foliomend.params import DEFAULTS, Params
from foliomend.runtime import map_rows

# Fixed values.
ANCHOR = r"(?i)={3,}\s*page\s+(\d+)\s*={3,}"
LINE_ANCHOR = r"(?md)^=+\s*page\s+(\d+)\s*=+\s*$"


def page_texts(docs: DataFrame, key: str, text: str = "text", plain: bool = True) -> DataFrame:
    """key, page and text of each page: what stands between an anchor and the next. What comes before the first is dropped; of
    anchors with the same number the last counts. With plain, furniture is taken out."""
    numbers = F.regexp_extract_all(F.col(text), F.lit(ANCHOR), F.lit(1))
    between = F.split(text, ANCHOR, -1)
    found = F.zip_with(numbers, F.slice(between, F.lit(2), F.size(between)), lambda n, t: F.struct(n.alias("n"), t.alias("t")))
    pages = docs.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(found).alias("ord", "x"))
    pages = pages.select(key, F.expr("try_cast(x.n as int)").alias("page"), "ord", F.col("x.t").alias("text")).where("page is not null")
    last = pages.groupBy(key, "page").agg(F.max_by("text", "ord").alias("text"))
    return last.withColumn("text", T.strip_furniture(F.col("text"))) if plain else last


def words_with_pages(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ord (of the stretch between anchor lines), page and words (in lower case) in reading order; the page of what comes
    before the first anchor is null. An anchor is a whole line of it. Words stay in one array for each stretch, so that
    filling the page forward needs neither a window nor a shuffle."""
    out = docs.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(T.stretches(F.col(text), LINE_ANCHOR)).alias("ord", "x"))
    return out.select(key, "ord", "x.page", "x.words")


def plain_line_ends(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def head_hits(docs: DataFrame, key: str, heads: list[str], text: str = "text") -> DataFrame:
    """key, pos (characters from 0 of the text with plain line ends) and page of each spot where a number of up to three figures
    stands before or after a head: before it, the place of the number, after it, the place of the head.

    Only the lengths of what stands between the hits leave a text's row; places are their running sums."""
    t, out = F.col("__t"), []
    source = docs.where(F.col(text).isNotNull()).select(F.col(key), plain_line_ends(F.col(text)).alias("__t"))
    for i, head in enumerate(heads):
        quoted, space = re.escape(head), f"{T.SPACE}+"
        for side, pattern in enumerate((rf"(?<![{T._LETTER}])([0-9]{{1,3}}){space}{quoted}", rf"{quoted}{space}([0-9]{{1,3}})(?![{T._LETTER}])")):
            whole, number = (F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) for group in (0, 1))
            spots = F.zip_with(F.slice(F.split(t, pattern, -1), F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("w"), number.alias("n")), lambda b, x: F.struct(F.length(b).alias("before"), F.length(x["w"]).alias("long"), x["n"].cast("int").alias("page")))
            out.append(source.select(key, F.lit(2 * i + side).alias("kind"), F.posexplode(spots).alias("at", "x")).select(key, "kind", "at", "x.*"))
    order = Window.partitionBy(key, "kind").orderBy("at")
    ends = F.sum(F.col("before") + F.col("long")).over(order)
    empty = source.select(key, F.lit(0).alias("pos"), F.lit(0).alias("page")).limit(0)
    return reduce(DataFrame.unionByName, out).select(key, (ends - F.col("long")).alias("pos"), "page") if out else empty


def after_contents(hits: DataFrame, key: str, params: Params = DEFAULTS) -> DataFrame:
    """hits with raw (how many the document has), dropped (how many stand in the contents at its front) and without those. The
    body begins at the first of toc_run hits that rise strictly over at most toc_span pages, or at once."""
    order = Window.partitionBy(key).orderBy("pos", "page")
    page = lambda k: F.lead("page", k).over(order) if k else F.col("page")
    n = params.toc_run
    rises = reduce(lambda x, y: x & y, (page(k) < page(k + 1) for k in range(n - 1)), F.lit(True))
    begins = rises & (page(n - 1) - page(0) <= params.toc_span)
    placed = hits.select("*", (F.row_number().over(order) - 1).alias("at"), begins.alias("begins"))
    all_ = Window.partitionBy(key)
    placed = placed.select("*", F.count("*").over(all_).cast("int").alias("raw"), F.coalesce(F.min(F.when(F.col("begins"), F.col("at"))).over(all_), F.lit(0)).alias("dropped"))
    return placed.where(F.col("at") >= F.col("dropped")).drop("begins")


def longest_rise(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        before.append(ends[k - 1] if k else -1)
        tops[k : k + 1] = [v]
        ends[k : k + 1] = [i]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def recovered_anchors(docs: DataFrame, key: str, heads: list[str], text: str = "text", params: Params = DEFAULTS) -> DataFrame:
    """key, pos, page of the anchors kept of each document, and raw and dropped of it: hits beside running heads, without the
    contents at the front, and of the rest a longest rising run. pos counts characters of the text with plain line ends. Keys
    are taken to be unique; a document's hits, not its text, come to one task."""
    body = after_contents(head_hits(docs, key, heads, text), key, params)
    lists = body.groupBy(key, "raw", "dropped").agg(F.array_sort(F.collect_list(F.struct("at", "pos", "page"))).alias("hits"))
    key_type = lists.schema[key].dataType.simpleString()

    def run(batches: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = zip(batch[key], batch["raw"], batch["dropped"], batch["hits"])
            yield [(k, hits[i]["pos"], hits[i]["page"], raw, dropped) for k, raw, dropped, hits in rows for i in longest_rise([h["page"] for h in hits])]

    return map_rows(lists, run, f"`{key}` {key_type}, pos bigint, page int, raw int, dropped int")


def anchor_gates(kept: DataFrame, key: str, params: Params = DEFAULTS) -> DataFrame:
    """One row for each document: kept, raw, dropped, coverage, pages_rise, places_rise, corr, gap and passed, all four gates
    with at least anchors_least anchors."""
    order = Window.partitionBy(key).orderBy("pos", "page")
    steps = kept.withColumn("dp", F.col("page") - F.lag("page").over(order)).withColumn("dx", F.col("pos") - F.lag("pos").over(order))
    out = steps.groupBy(key).agg(
        F.count("*").alias("kept"),
        F.max("raw").alias("raw"),
        F.max("dropped").alias("dropped"),
        (F.count("*") / (F.max("page") - F.min("page") + 1)).alias("coverage"),
        F.coalesce(F.min("dp") > 0, F.lit(True)).alias("pages_rise"),
        F.coalesce(F.min("dx") > 0, F.lit(True)).alias("places_rise"),
        F.coalesce(F.corr(F.col("pos").cast("double"), F.col("page").cast("double")), F.lit(0.0)).alias("corr"),
        F.coalesce(F.max("dp"), F.lit(0)).alias("gap"),
    )
    out = out.withColumn("corr", F.when(F.isnan("corr"), 0.0).otherwise(F.col("corr")))
    passed = (F.col("kept") >= params.anchors_least) & F.col("pages_rise") & F.col("places_rise") & (F.col("corr") > params.anchor_corr) & (F.col("gap") <= params.anchor_gap)
    return out.withColumn("passed", passed)


def anchored(docs: DataFrame, kept: DataFrame, gates: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and text with anchors written where the gates passed; other documents don't come out. The text is put together from
    the stretches between anchors."""
    good = kept.join(gates.where("passed").select(key), key, "left_semi")
    marks = good.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "page"))).alias("m"))
    rows = docs.select(F.col(key), plain_line_ends(F.col(text)).alias("__t")).join(marks, key)
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("m", lambda x: x["pos"]))
    ends = F.concat(F.transform("m", lambda x: x["pos"]), F.array(F.length("__t").cast("bigint")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("__t"), (a + 1).cast("int"), (b - a).cast("int")))
    heads = F.concat(F.array(F.lit("")), F.transform("m", lambda x: F.concat(F.lit("\n===== page "), x["page"].cast("string"), F.lit(" =====\n"))))
    return rows.select(key, F.array_join(F.zip_with(heads, pieces, lambda h, p: F.concat(h, p)), "").alias("text"))
