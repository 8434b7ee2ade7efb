"""Gates over documents as they arrive. A document's own measures need no state; the lexicon and the median they are held
against are those of the last batch run over the whole collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliomend.functions import text as T
from foliomend.operators import lexicon as L
from foliomend.params import DEFAULTS, Params


def incoming(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder, with the columns of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def measured(stream: DataFrame, key: str, text: str = "text", params: Params = DEFAULTS) -> DataFrame:
    """key, tokens, glue, german, cjk and page_ok of each document with a text. Without state, so it runs on a stream as on a
    table."""
    t = F.col(text)
    low = T.lowered(T.tokens(t))
    return stream.where(t.isNotNull()).select(F.col(key), F.size(low).cast("bigint").alias("tokens"), L.glue_rate(t, params).alias("glue"), T.is_german(low).alias("german"), T.cjk_share(t).alias("cjk"), T.has_pages(t).alias("page_ok"))


def write_measures(stream: DataFrame, key: str, target: str, checkpoint: str, pairs: DataFrame | None = None, text: str = "text", params: Params = DEFAULTS) -> StreamingQuery:
    """Starts a query that measures what has arrived and writes it as Parquet, a folder for each micro-batch, so that a batch
    that is run again replaces itself. pairs: split pairs of the collection's lexicon; with them each document has splitpair."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = measured(batch, key, text, params)
        if pairs is not None:
            counts = L.split_counts(batch, pairs, key, text).select(key, "pairs")
            rate = F.when(F.col("tokens") >= params.split_tokens, F.col("pairs") / F.greatest("tokens", F.lit(1)) * 1000)
            rows = rows.join(counts, key, "left").withColumn("splitpair", rate)
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_and_repeated(stream: DataFrame, scanned: str = "scanned_at", received: str = "received_at", key: str = "doc_id", late: str = "30 days") -> DataFrame:
    """Documents once each, by key within the watermark, with late where they arrived more than `late` after they were scanned."""
    out = stream.withWatermark(received, late).dropDuplicatesWithinWatermark([key])
    return out.withColumn("late", F.coalesce(F.col(received) > F.col(scanned) + F.expr(f"interval {late}"), F.lit(False)))
