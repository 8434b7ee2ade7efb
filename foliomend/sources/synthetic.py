"""Damage on purpose, the same on every run and every cluster: it hangs on a hash of the document and of the word's place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PIECES = r"[A-Za-z]+|[^A-Za-z]+"


def _number(*parts: Column) -> Column:
    """A number of 32 bits that hangs on the parts alone: the beginning of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("bigint")


def _chance(*parts: Column) -> Column:
    """A number from 0 to 1 that hangs on the parts alone."""
    return F.pmod(_number(*parts), F.lit(1_000_000)) / 1_000_000.0


def build_clean(passage: str, cycles: int = 10, every: int = 2) -> str:
    """A passage again and again, with a page anchor before every `every`-th time."""
    return "".join((f"\n===== page {i // every + 1} =====\n" if i % every == 0 else "") + passage for i in range(cycles))


def split_words(docs: DataFrame, key: str, text: str = "text", share: float = 0.07, least: int = 6, seed: int = 42) -> DataFrame:
    """key and text with about `share` of the words of `least` letters or more split by a space: after the first letter in three
    of ten cases, else after the third to fifth."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(_PIECES), F.lit(0))

    def damage(piece: Column, i: Column) -> Column:
        hit = F.regexp(piece, F.lit(f"^[A-Za-z]{{{least},}}$")) & (_chance(F.col(key), i, F.lit(seed)) < share)
        first = _chance(F.col(key), i, F.lit(seed + 1)) < 0.3
        third = (3 + F.pmod(_number(F.col(key), i, F.lit(seed + 2)), (F.least(F.lit(5), F.length(piece) - 2) - 2).cast("bigint"))).cast("int")
        cut = F.when(first, F.lit(1)).otherwise(third)
        return F.when(hit, F.concat(F.substring(piece, F.lit(1), cut), F.lit(" "), F.substring(piece, cut + 1, F.length(piece)))).otherwise(piece)

    return docs.select(F.col(key), F.array_join(F.transform(pieces, damage), "").alias("text"))


def glue_spans(docs: DataFrame, key: str, text: str = "text", share: float = 0.05, least: int = 18, seed: int = 43) -> DataFrame:
    """key and text with about `share` of the spans of three or four words that have `least` letters or more run together."""
    span = r"(?:[A-Za-z]+ ){2,3}[A-Za-z]+"
    spans, between = F.regexp_extract_all(F.col(text), F.lit(span), F.lit(0)), F.split(text, span, -1)

    def damage(s: Column, i: Column) -> Column:
        glued = F.replace(s, F.lit(" "), F.lit(""))
        return F.when((F.length(glued) >= least) & (_chance(F.col(key), i, F.lit(seed)) < share), glued).otherwise(s)

    put = F.concat(F.transform(spans, damage), F.array(F.lit("")))
    return docs.select(F.col(key), F.array_join(F.flatten(F.zip_with(between, put, lambda a, b: F.array(a, b))), "").alias("text"))


def corpus(spark: SparkSession, passage: str, cycles: int = 10) -> DataFrame:
    """rel and text of a sound file made of a passage, and of its two damaged forms."""
    clean = spark.createDataFrame([("healthy.txt", build_clean(passage, cycles))], "rel string, text string")
    split = split_words(clean, "rel").withColumn("rel", F.lit("wordsplit-damaged.txt"))
    glued = glue_spans(clean, "rel").withColumn("rel", F.lit("glued-damaged.txt"))
    return clean.unionByName(split).unionByName(glued)
