"""Problem 3: frequency of every distinct term, by last-seen counters."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomend.runtime import filled, one_row_per, stored

_RUN = re.compile("[A-Za-z]+").findall
#: Terms a partition holds before it hands on its counters; only memory depends on it, results don't.
FLUSH_TERMS = 500_000


class LastSeen:
    """Counters of terms over records given one after another: each term keeps its occurrences, its records and the last
    record it was seen in, so that no record needs a set of its terms."""

    def __init__(self) -> None:
        self.occurrences: dict[str, int] = {}
        self.records: dict[str, int] = {}
        self.last: dict[str, int] = {}

    def add(self, record: int, text: str) -> None:
        occurrences, records, last = self.occurrences, self.records, self.last
        # lower() of other letters (the Kelvin sign) may give A-Z letters, so only runs of A-Z are put in lower case
        for term in _RUN(text.lower()) if text.isascii() else map(str.lower, _RUN(text)):
            if term not in last:
                occurrences[term] = records[term] = 1
                last[term] = record
            else:
                occurrences[term] += 1
                if last[term] != record:
                    records[term] += 1
                    last[term] = record


def _partial(batches: Iterable[pd.DataFrame], flush: int) -> Iterator[pd.DataFrame]:
    seen, record = LastSeen(), 0

    def out() -> pd.DataFrame:
        terms = list(seen.records)
        return pd.DataFrame({"term": terms, "occurrences": list(seen.occurrences.values()), "files": list(seen.records.values())})

    for batch in batches:
        for text in batch["text"]:
            if text is None:
                continue
            record += 1
            seen.add(record, text)
            if len(seen.last) >= flush:
                yield out()
                seen = LastSeen()
    yield out()
    yield pd.DataFrame({"term": [None], "occurrences": [0], "files": [record]})


def term_counts(df: DataFrame, key: str = "file_id", text: str = "text", flush: int = FLUSH_TERMS) -> DataFrame:
    """term, occurrences, files of every run of A-Z letters (in lower case), and one row with a null term whose files is the
    number of records with a text that isn't null.

    A record is counted once however often its key is repeated. Null texts count nowhere; empty and blank ones count as
    records without terms. Records never cross partitions, so the counters of partitions add up exactly, and a term that
    is in every record sends one row a partition through the shuffle. An empty table gives the null row only, or nothing."""
    source = one_row_per(df, key).select(F.col(text).alias("text"))
    partial = source.mapInPandas(filled(lambda it: _partial(it, flush)), "term string, occurrences bigint, files bigint")
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("files").alias("files"))


def marked_terms(counts: DataFrame, rare: int = 2, common: float = 0.5) -> DataFrame:
    """counts of term_counts with a mark: rare in at most `rare` files, common in more than the share `common` of the files
    with text, else null. Rare wins where both hold, as in collections of three files or fewer."""
    counts = stored(counts)
    n = counts.where("term is null").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).first()["n"]
    mark = F.when(F.col("files") <= rare, "rare").when(F.col("files") > F.lit(n * common), "common")
    return counts.where("term is not null").withColumn("mark", mark)
