"""Lexicons learned from the corpus at run time. Each is (w, tf) or (w, tf, df); a missing word counts as 0."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomend.functions import text as T
from foliomend.operators.lookup import Look, resolved
from foliomend.params import DEFAULTS, Params
from foliomend.runtime import BROADCAST_ROWS, small_side, stored


def term_frequency(docs: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """w and tf over all texts, of runs of `least` letters or more, in lower case. Null and empty texts add nothing."""
    words = docs.select(F.explode(T.tokens(F.col(text), least)).alias("w"))
    return words.groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """w and df: in how many rows of docs a word of the array column is. Made distinct within the row, so nothing is shuffled
    but the words' partial counts; repeated keys must have been dropped before."""
    return docs.select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").agg(F.count("*").alias("df"))


def frequencies(docs: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """w, tf and df over all texts in one pass and one shuffle: a text's words are sorted, so that the first of each counts for
    df, and only partial counts of words leave a task."""
    # the sorted words stand in a projection of their own, so that they are worked out once for each text
    texts = docs.where(F.length(text) > 0).select(F.sort_array(T.lowered(T.tokens(F.col(text), least))).alias("s"))
    marked = F.zip_with("s", F.concat(F.array(F.lit("")), F.col("s")), lambda w, p: F.struct(w.alias("w"), (w != p).cast("bigint").alias("new")))
    words = texts.select(F.explode(marked).alias("x")).select("x.w", "x.new").where("w is not null")
    return words.groupBy("w").agg(F.count("*").alias("tf"), F.sum("new").alias("df"))


def split_pairs(lexicon: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """a, b (lower case) of all pairs that count as one split word: the joined form has at least split_letters letters, occurs
    split_tf times, and more than split_ratio times as often as either part.

    Worked out from the lexicon alone, by cutting each frequent word at each place, not from the texts' pairs: as many rows as
    the frequent words have letters."""
    joined = lexicon.where((F.length("w") >= params.split_letters) & (F.col("tf") >= params.split_tf))
    cuts = joined.select("w", "tf", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("k"))
    cuts = cuts.select("tf", F.substring("w", F.lit(1), F.col("k")).alias("a"), F.expr("substring(w, k + 1)").alias("b"))
    a = lexicon.select(F.col("w").alias("a"), F.col("tf").alias("tf_a"))
    b = lexicon.select(F.col("w").alias("b"), F.col("tf").alias("tf_b"))
    both = cuts.join(a, "a", "left").join(b, "b", "left").fillna(0, ["tf_a", "tf_b"])
    return both.where(F.col("tf") > params.split_ratio * F.greatest("tf_a", "tf_b")).select("a", "b")


def split_counts(docs: DataFrame, pairs: DataFrame, key: str, text: str = "text", limit: int = BROADCAST_ROWS) -> DataFrame:
    """key, tokens and pairs (adjacent tokens that are a split pair) of each row of docs with a text, and rough_pairs of those
    pairs that have rough set, if pairs has that column. The texts stay in their rows, and the pairs are looked up."""
    rough = "rough" in pairs.columns
    facts = pairs.select(F.concat_ws(" ", "a", "b").alias("name"), *(["rough"] if rough else []))
    token = re.compile(T.WORD).findall

    def kernel(text: str, look: Look) -> dict:
        low = [t.lower() for t in token(text)]
        seen: dict[str, tuple | None] = {}
        n = of_rough = 0
        for name in map(" ".join, zip(low, low[1:])):
            if name not in seen:
                seen[name] = look(name)
            if (fact := seen[name]) is not None:
                n += 1
                of_rough += rough and fact[0]
        return {"tokens": len(low), "pairs": n, "rough_pairs": of_rough}

    return resolved(docs, key, text, facts, kernel, "tokens bigint, pairs bigint" + (", rough_pairs bigint" if rough else ""), limit)


def split_rates(docs: DataFrame, lexicon: DataFrame, key: str, text: str = "text", floor: int | None = None, params: Params = DEFAULTS) -> DataFrame:
    """key, tokens, pairs and splitpair (per mille of the tokens; null below the floor of tokens, split_tokens if not given)."""
    floor = params.split_tokens if floor is None else floor
    counts = split_counts(docs, split_pairs(lexicon, params), key, text)
    rate = F.when(F.col("tokens") >= floor, F.col("pairs") / F.greatest("tokens", F.lit(1)) * 1000)
    return counts.withColumn("splitpair", rate)


def split_measures(docs: DataFrame, key: str, text: str = "text", params: Params = DEFAULTS, lexicon: DataFrame | None = None) -> DataFrame:
    """key, tokens, pairs, rough_pairs and cjk of each row of docs with a text, in one pass: adjacent tokens that are split pairs
    by the lexicon of two letters and more, and those that are by the rough one too, which counts single letters. lexicon: the
    rough one, if it was learned already."""
    rough = stored(term_frequency(docs, text, 1)) if lexicon is None else lexicon
    pairs = split_pairs(rough.where("length(w) > 1"), params).join(split_pairs(rough, params).withColumn("rough", F.lit(True)), ["a", "b"], "left").fillna(False, ["rough"])
    counts = split_counts(docs, pairs, key, text)
    shares = docs.where(F.col(text).isNotNull()).select(key, T.cjk_share(F.col(text)).alias("cjk"))
    return counts.join(shares, key)


def clean_keys(measured: DataFrame, key: str, params: Params = DEFAULTS) -> DataFrame:
    """key of the rows that a repair lexicon may learn from, by split_measures: little Chinese, few split pairs by the rough
    lexicon. Short files have no measurable rate and count as clean."""
    rate = F.when(F.col("tokens") >= params.repair_tokens, F.col("rough_pairs") / F.greatest("tokens", F.lit(1)) * 1000)
    return measured.where((F.coalesce("cjk", F.lit(0.0)) <= params.cjk_limit) & (F.coalesce(rate, F.lit(0.0)) < params.split_clean)).select(key)


def clean_for_splits(docs: DataFrame, key: str, text: str = "text", params: Params = DEFAULTS) -> DataFrame:
    """The rows of docs that clean_keys names."""
    keys = stored(clean_keys(split_measures(docs, key, text, params), key, params))
    return docs.where(F.col(text).isNotNull()).join(small_side(keys, keys.count()), key, "left_semi")


def glue_rate(text: Column, params: Params = DEFAULTS) -> Column:
    """Tokens of glue_letters letters or more, per mille; null below glue_tokens tokens."""
    n = T.matches(text, T.WORD)
    return F.when(n >= params.glue_tokens, T.matches(text, f"[A-Za-z]{{{params.glue_letters},}}") / n * 1000)


def clean_for_glue(docs: DataFrame, text: str = "text", params: Params = DEFAULTS) -> DataFrame:
    """The rows of docs that an unglue lexicon may learn from: little Chinese and a measurable, low glue rate; short files are
    left out, other than in clean_for_splits."""
    return docs.where((F.coalesce(T.cjk_share(F.col(text)), F.lit(0.0)) <= params.cjk_limit) & (glue_rate(F.col(text), params) < params.glue_clean))


def dehyphenation_lexicons(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(w, tf) of plain words of three letters or more, and (h, tf) of in-line hyphenated forms, both in lower case."""
    plain = docs.select(F.explode(T.words_at_boundaries(F.col(text), 3)).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("tf"))
    hyphenated = docs.select(F.explode(T.hyphenated_words(F.col(text))).alias("h")).groupBy(F.lower("h").alias("h")).agg(F.count("*").alias("tf"))
    return plain, hyphenated


def dictionary_fit(frequency: DataFrame) -> DataFrame:
    """One row: fit, whether the table knows the words the, and and of; any other table would call every word damage."""
    return frequency.where(F.col("w").isin("the", "and", "of")).agg((F.countDistinct("w") == 3).alias("fit"))
