"""Queries of the training-data problems, over whole tables; SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliomend.llm import consistent, decoding, encoder, forms, languages, mixing, scans, terms


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _damaged(spark: SparkSession, d: str) -> list[DataFrame]:
    return [_table(spark, d, "wordsplit_damaged"), _table(spark, d, "glued_damaged")]


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return languages.file_passages(spark, _table(spark, d, "healthy"), _table(spark, d, "lang_labels"), _table(spark, d, "common_words"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.other_languages(_runs(spark, d))


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages.file_languages(_runs(spark, d))


def p1_passages(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).drop("meant").distinct()


def _noise(spark: SparkSession, d: str, work: Callable[..., DataFrame]) -> DataFrame:
    return work(spark, _damaged(spark, d), _table(spark, d, "lexicon"), _table(spark, d, "common_words"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _noise(spark, d, scans.line_faults)


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    return _noise(spark, d, scans.repaired_texts)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    counts = terms.term_counts(_table(spark, d, "healthy"))
    return terms.marked_terms(counts).where("mark is not null").select("term", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(terms.term_counts(_table(spark, d, "healthy")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consistent.equal_pairs(consistent.consistent_texts(spark, _table(spark, d, "healthy"), with_text=False))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """The form of each file with its class's representative, membership in place of pairs."""
    return consistent.equal_classes(consistent.consistent_texts(spark, _table(spark, d, "healthy"), with_text=False))


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    return consistent.consistent_texts(spark, _table(spark, d, "healthy")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return forms.file_forms(spark, _damaged(spark, d), _table(spark, d, "common_words")).where("form <> 'prose'")


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    return forms.quality_statistics(spark, _damaged(spark, d), _table(spark, d, "common_words"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoder.encode_ids(_table(spark, d, "documents"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(spark, _table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(_mixture(spark, d)[1])


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return decoding.decoded(spark, _table(spark, d, "documents"), with_text=False).where("garbled").select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return decoding.decoded(spark, _table(spark, d, "documents"))


_TERMS = """
with files as (select file_id, any_value(text) as text from healthy group by file_id),
tokens as (select file_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as term from files where text is not null),
n as (select count(*) as n from files where text is not null),
counts as (select term, count(*) as occurrences, count(distinct file_id) as files from tokens group by term)
select term, occurrences, files, case when files <= 2 then 'rare' when files > n.n * 0.5 then 'common' end as mark
from counts, n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_languages, p1_passages, p2_found, p2_texts, p3_found, p3_terms, p4_found, p4_classes, p4_texts, p5_found, p5_statistics, p6_ids, p7_found, p7_shares, p7_mix, p8_found, p8_restored)}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_terms": _TERMS,
        "p3_found": f"select term, mark from ({_TERMS}) where mark is not null",
    }
