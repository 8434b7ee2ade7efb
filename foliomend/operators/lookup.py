"""Kernels over whole texts that look names up in a table of facts: sent to every worker if it is small, else asked for by joins,
with the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomend.runtime import BROADCAST_ROWS, map_rows, stored

Look = Callable[[str], tuple | None]
Kernel = Callable[[str, Look], dict]

#: Bits of a filter of names, and bits that each name sets: eight megabytes, whatever the number of names.
FILTER_BITS, FILTER_HASHES = 1 << 26, 3
_BLOCK = 32_768  # bits of one of Spark's bitmaps


def filter_of(names: DataFrame) -> bytes:
    """A Bloom filter of the names (name), put together by the executors: names that it refuses are surely not among them."""
    h = F.xxhash64("name")
    first, step = h.bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    place = F.explode(F.array(*((first + step * i).bitwiseAND(FILTER_BITS - 1) + 1 for i in range(FILTER_HASHES))))
    blocks = names.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in blocks.collect():
        at = (r["b"] - 1) * _BLOCK // 8
        out[at : at + _BLOCK // 8] = r["bits"]
    return bytes(out)


def may_hold(bits: bytes, name: str) -> bool:
    h = xxhash.xxh64_intdigest(name.encode("utf-8", "replace"), seed=42)
    first, step = h & FILTER_BITS - 1, h >> 32 | 1
    for i in range(FILTER_HASHES):
        p = first + step * i & FILTER_BITS - 1
        if not bits[p >> 3] >> (p & 7) & 1:
            return False
    return True


def resolved(docs: DataFrame, key: str, text: str, facts: DataFrame, kernel: Kernel, schema: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """key and the columns of schema that kernel(text, look) gives for each row of docs with a text. look(name) is the row of facts
    (name, and other columns) of that name as a tuple of the others, or None.

    Beyond limit rows of facts, texts get a number and the kernel is run in rounds: what it asks for is joined with the facts,
    and texts that asked are run again with the answers, until none asks for anything new. Names that a filter of fixed size
    refuses aren't asked for. Null and repeated keys are rows like others."""
    source = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    spark, names = docs.sparkSession, [x.split()[0] for x in schema.split(", ")]
    typed = f"`{key}` {source.schema['__key'].dataType.simpleString()}, {schema}"
    facts = stored(facts)
    values = [c for c in facts.columns if c != "name"]
    if facts.count() <= limit:
        sent = spark.sparkContext.broadcast({r["name"]: tuple(r[c] for c in values) for r in facts.collect()})

        def run(batches: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for batch in batches:
                found = ((k, kernel(t, sent.value.get)) for k, t in zip(batch["__key"], batch["__text"]))
                yield [(k, *(r[n] for n in names)) for k, r in found]

        return map_rows(source, run, typed)
    bits = spark.sparkContext.broadcast(filter_of(facts))
    source = stored(source.withColumn("__id", F.monotonically_increasing_id()))

    def asking(batches: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for i, k, t, given in zip(batch["__id"], batch["__key"], batch["__text"], batch["__given"]):
                known = {g["name"]: tuple(g[c] for c in values) if g["there"] else None for g in given or ()}
                ask: set[str] = set()

                def look(name: str) -> tuple | None:
                    if name not in known:
                        known[name] = None
                        if may_hold(bits.value, name):
                            ask.add(name)
                    return known[name]

                r = kernel(t, look)
                rows.append((i, sorted(ask), k, *(None if ask else r[n] for n in names)))
            yield rows

    answer = F.struct("name", F.col("there").isNotNull().alias("there"), *values)
    none = F.expr(f"cast(null as array<struct<name string, there boolean, {', '.join(f'{c} {facts.schema[c].dataType.simpleString()}' for c in values)}>>)" if values else "cast(null as array<struct<name string, there boolean>>)")
    done, asked, open_ = [], [], source.withColumn("__given", none)
    while True:
        out = stored(map_rows(open_, asking, f"__id bigint, __ask array<string>, {typed}"))
        done.append(out.where("size(__ask) = 0").select(key, *names))
        asked.append(out.where("size(__ask) > 0").select("__id", F.explode("__ask").alias("name")))
        if asked[-1].isEmpty():
            return reduce(DataFrame.unionByName, done)
        again = asked[-1].select("__id").distinct()
        wanted = reduce(DataFrame.unionByName, asked).join(again, "__id", "left_semi")
        given = wanted.join(facts.withColumn("there", F.lit(True)), "name", "left").groupBy("__id").agg(F.collect_list(answer).alias("__given"))
        open_ = source.join(given, "__id")
