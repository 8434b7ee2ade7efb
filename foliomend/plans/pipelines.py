"""Whole runs: health check, and repairs with their measures before and after."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomend.operators import gates, repair
from foliomend.operators import lexicon as L
from foliomend.params import DEFAULTS, Params
from foliomend.runtime import stored


@dataclass
class Health:
    """Rows with their flags, the upper median of the phrase density, gate 3's rows (None: not run) and the verdict."""

    rows: DataFrame
    median: float
    layers: DataFrame | None
    verdict: DataFrame

    def exit_code(self) -> int:
        """0 where nothing was found and everything wanted was run, else 1."""
        return int(self.verdict.first()["result"] != "ALL GREEN")


def health_check(docs: DataFrame, key: str = "rel", text: str = "text", layers: DataFrame | None = None, want_layers: bool = False, registry: tuple[str, ...] = (), params: Params = DEFAULTS) -> Health:
    """The six gates over a collection. want_layers: whether the gate over PDF layers was asked for; without layers it then
    counts as not run, and the result can't be ALL GREEN."""
    lexicon = stored(L.term_frequency(docs, text, 2))
    rows, median = gates.gate_flags(gates.health_rows(docs, key, text, lexicon, registry, params), params)
    rows = stored(rows)
    third = gates.hidden_layers(layers, rows, median, key, params)
    return Health(rows, median, third, gates.verdict(rows, third, want_layers))


def report(rows: DataFrame, column: str, flag: str, top: int, key: str = "rel") -> DataFrame:
    """The `top` worst flagged rows by a column, ties by key; counts elsewhere stay whole."""
    return rows.where(flag).orderBy(F.desc(column), key).limit(top).select(key, column)


def changes_report(fixed: DataFrame, top: int = 8, key: str = "rel") -> DataFrame:
    """The texts with the most line-end hyphens decided, of dehyphenation_run."""
    return fixed.where("changed").orderBy(F.desc(F.col("join") + F.col("hyph")), key).limit(top).select(key, "join", "hyph", "skip")


def disagreement_report(rows: DataFrame, top: int = 60, key: str = "file_id") -> DataFrame:
    """The first `top` rows of each bucket by key, page and words; their totals are bucket_totals', which stay whole."""
    order = Window.partitionBy("bucket").orderBy(key, "page", F.array_join("x", " "), F.array_join("y", " "))
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top).drop("n")


def learned_from(sources: int, least: int) -> dict[str, int | bool]:
    """How many sound files a lexicon was learned from, and whether that is too few to trust it without a look."""
    return {"sources": sources, "least": least, "few": sources < least}


def split_repair_run(docs: DataFrame, key: str = "rel", text: str = "text", names: tuple[str, ...] = (), params: Params = DEFAULTS) -> DataFrame:
    """The repaired texts of the targets with splitpair before (sp0) and after (sp1), and sources, the clean files that the repairs
    were learned from, with few if they are fewer than sources_repair. The lexicon is learned once, and the texts measured once."""
    rough = stored(L.term_frequency(docs, text, 1))
    measured = stored(L.split_measures(docs, key, text, params, rough))
    targets = stored(repair.split_targets(docs, key, text, names, params=params, measured=measured))
    fixed = stored(repair.repair_splits(docs, key, text, params, targets, measured=measured))
    after = L.split_rates(fixed, rough.where("length(w) > 1"), key, "text", params.repair_tokens, params).select(key, F.col("splitpair").alias("sp1"))
    said = learned_from(L.clean_keys(measured, key, params).count(), params.sources_repair)
    rows = fixed.join(targets.withColumnRenamed("splitpair", "sp0"), key).join(after, key, "left")
    return rows.withColumn("sources", F.lit(said["sources"]).cast("bigint")).withColumn("few", F.lit(said["few"]))


def unglue_run(docs: DataFrame, key: str = "rel", text: str = "text", excluded: tuple[str, ...] = (), params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The repaired texts of the targets with glue before and after, sources and few as in split_repair_run, and the targets left
    alone with their reasons."""
    targets = stored(repair.unglue_targets(docs, key, text, excluded, params=params))
    clean = stored(L.clean_for_glue(docs, text, params).select(F.col(text).alias("text")))
    said = learned_from(clean.count(), params.sources_repair)
    fixed = repair.unglue(docs, key, text, targets, params, clean=clean).withColumn("glue1", L.glue_rate(F.col("text"), params))
    fixed = fixed.withColumn("sources", F.lit(said["sources"]).cast("bigint")).withColumn("few", F.lit(said["few"]))
    return fixed.join(targets.select(key, F.col("glue").alias("glue0")), key), targets.where("skip_reason is not null")


def dehyphenation_run(docs: DataFrame, key: str = "rel", text: str = "text", params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The texts with line-end hyphens decided, and the totals by verdict."""
    plain, hyphenated = L.dehyphenation_lexicons(docs, text)
    judged = stored(repair.judged_sites(repair.hyphen_sites(docs, key, text), plain, hyphenated, params))
    return repair.dehyphenated(docs, judged, key, text), repair.hyphen_totals(judged)
