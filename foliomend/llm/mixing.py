"""Problem 7: mixing sources to target weights, by pivotal dependent rounding of each document's number of copies."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomend.llm.encoder import TOKENIZER_DIR, token_counts
from foliomend.runtime import small_side, stored

#: Units that one task rounds; a source of more is split into that many buckets, whose residuals meet in the next level.
BUCKET = 20_000


def pivotal(units: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Rounds probabilities to 0 or 1, all but one at most: two units at a time give and take mass, so that one becomes
    integral and the expectation of each stays. Returns the units with the decided ones at 0 or 1, and the place of the one
    left between (-1: none). The sum of the units doesn't change."""
    out = units.astype(float).copy()
    chance = np.random.default_rng(seed).random(len(out)).tolist()
    values, held = out.tolist(), -1
    for i, b in enumerate(values):
        if b <= 0.0 or b >= 1.0:
            continue
        if held < 0:
            held = i
            continue
        a = values[held]
        total = a + b
        if total < 1.0:
            keeps = chance[i] * total < a  # the held unit takes all, with probability a / total
            values[held if keeps else i], values[i if keeps else held] = total, 0.0
            held = held if keeps else i
        else:
            full = chance[i] * (2.0 - total) < 1.0 - b  # the held unit becomes 1, with probability (1 - b) / (2 - total)
            rest = total - 1.0
            values[held if full else i], values[i if full else held] = 1.0, rest
            held = i if full else held
            if rest < 1e-12:
                values[held], held = 0.0, -1
    if held >= 0 and values[held] > 1.0 - 1e-12:
        values[held], held = 1.0, -1
    return np.array(values), held


def _rounded(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One bucket of one source: neighbours in size exchange mass, so that the tokens come close to their target too."""
    table = table.sort_by([("tokens", "ascending"), ("doc_id", "ascending"), ("salt", "ascending")])
    source, bucket = (k.as_py() for k in key)
    seed = zlib.crc32(repr((str(source), int(bucket), table["level"][0].as_py())).encode())
    units, _ = pivotal(table["unit"].to_numpy(), seed)
    return table.set_column(table.schema.get_field_index("unit"), "unit", pa.array(units))


def copies(spark: SparkSession, docs: DataFrame, plan: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, source, tokens and copies of each row of docs (doc_id, source, tokens) whose source is in plan (source, rate).

    Every row gets the whole part of its source's rate, and its fraction is rounded by a reduction tree: buckets of a source
    leave one residual unit each, these are rounded in the next level, and the last one of a source by its own probability.
    The order of rows, partitions and lost executors don't change the result. Rows with a null doc_id are rows like others, told
    apart by a number that is written down with them, so that they spread over the buckets too."""
    ways = plan.select("source", "rate", F.floor("rate").cast("int").alias("base"), (F.col("rate") - F.floor("rate")).alias("unit"))
    sources = ways.count()
    rows = docs.join(small_side(ways, sources), "source").withColumn("base", F.when(F.col("unit") > 1 - 1e-12, F.col("base") + 1).otherwise(F.col("base")))
    rows = rows.withColumn("unit", F.when(F.col("unit").between(1e-12, 1 - 1e-12), F.col("unit")).otherwise(0.0))
    counts = rows.where("unit > 0").groupBy("source").agg(F.count("*").alias("n"))
    rows = stored(rows.join(small_side(counts, sources), "source", "left").withColumn("buckets", F.ceil(F.coalesce("n", F.lit(1)) / bucket)).select("doc_id", "source", "tokens", "base", "unit", "buckets", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("salt")))
    whole = rows.where("unit = 0").select("doc_id", "source", "tokens", F.col("base").alias("copies"))
    open_ = rows.where("unit > 0")
    most = open_.agg(F.max("buckets").alias("m")).first()["m"]
    done = [whole]
    if most:
        schema = "doc_id bigint, source string, tokens bigint, base int, unit double, buckets bigint, salt bigint, level int, bucket bigint"
        level = 0
        while True:
            slot = F.pmod(F.xxhash64("doc_id", "tokens", "salt", F.lit(level)), F.col("buckets")).alias("bucket")
            level_rows = open_.select("doc_id", "source", "tokens", "base", "unit", "buckets", "salt", F.lit(level).alias("level"), slot)
            rounded = stored(level_rows.groupBy("source", "bucket").applyInArrow(_rounded, schema))
            decided = (F.col("unit") == 0) | (F.col("unit") == 1)
            done.append(rounded.where(decided).select("doc_id", "source", "tokens", (F.col("base") + F.col("unit").cast("int")).alias("copies")))
            open_ = rounded.where(~decided).withColumn("buckets", F.ceil(F.col("buckets") / bucket))
            if most <= 1:
                break
            most, level = math.ceil(most / bucket), level + 1
        # one unit of each source is left at most; a hash of its document decides it by its probability
        coin = F.pmod(F.xxhash64("source", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
        done.append(open_.select("doc_id", "source", "tokens", (F.col("base") + (coin < F.col("unit")).cast("int")).alias("copies")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def source_plan(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, size, documents, total, rate and short of each source of targets.

    rate is the number of copies that gives the target share of total, the sum of the sizes of all sources of targets, at most
    max_repeats; short marks a source that falls short of its target even at max_repeats. A source without documents has size
    0; documents without tokens are used max_repeats times. Null shares count as 0 and null repeats as 1; a repeated source has its greatest share and repeats; a null source and
    documents of other sources count nowhere."""
    wanted = targets.where("source is not null").groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    sizes = docs.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("documents"))
    plan = wanted.join(sizes, "source", "left").fillna(0, ["size", "documents"])
    plan = stored(plan)
    total = plan.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    target = F.col("target_share") * F.lit(total)
    most = F.col("size") * F.col("max_repeats")
    rate = F.when(target > 0, F.least(target / F.greatest("size", F.lit(1e-9)), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return plan.withColumn("total", F.lit(total)).withColumn("rate", rate).withColumn("short", most < target)


def sized_documents(df: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id, source and tokens of the documents of the sources of targets, worked out once and written to the shared folder."""
    names = targets.select("source").where("source is not null").distinct()
    known = df.select("doc_id", "source", "text").join(small_side(names, names.count()), "source", "left_semi")
    return stored(token_counts(known, keep=("doc_id", "source"), name=tokenizer, directory=directory))


def mixture(spark: SparkSession, df: DataFrame, targets: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """The copies of each document and the shares that were reached: source, target_share, max_repeats, size, documents, total,
    rate, short, reached (tokens with copies), copies, least and most copies of one document, and reached_share of all reached."""
    docs = sized_documents(df, targets)
    plan = source_plan(docs, targets)
    mixed = stored(copies(spark, docs, plan, bucket))
    reached = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.sum("copies").alias("copies"), F.min("copies").alias("least_copies"), F.max("copies").alias("most_copies"))
    shares = stored(plan.join(reached, "source", "left").fillna(0, ["reached", "copies", "least_copies", "most_copies"]))
    all_ = shares.agg(F.sum("reached").alias("r")).first()["r"] or 0
    return mixed, shares.withColumn("reached_share", F.col("reached") / F.lit(float(all_)) if all_ else F.lit(0.0))


def short_sources(shares: DataFrame) -> DataFrame:
    """source of those whose documents the rounding gave max_repeats copies each, and that fall short all the same."""
    full = (F.col("documents") == 0) | (F.col("least_copies") == F.col("max_repeats"))
    return shares.where(full & F.col("short")).select("source")
