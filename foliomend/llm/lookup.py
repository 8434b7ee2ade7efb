"""Tables that are too large for a worker's memory, as sorted files on every worker's disk. What is in memory and what is in such
a file never changes a result."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomend.runtime import filled, shared_dir, stored

#: Rows of such a file that the driver takes at once.
REST_ROWS = 1_000_000
#: Bits of a key's digest by which a worker's memory tells most keys that aren't in the file.
FIRST_BITS = 22


def _digests(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        raw = b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "replace")) for k in batch["key"])
        both = np.frombuffer(raw, "<i8").reshape(-1, 2)
        yield pd.DataFrame({"d": both[:, 0], "e": both[:, 1]} | {c: batch[c].to_numpy() for c in batch.columns if c != "key"})


class Rest:
    """Numbers by key in a file that every worker has on its disk. Keys are known by 128 bits; their first 64 are sorted. Only
    the pages of the file that are asked for are read."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.columns: list[np.ndarray] | None = None

    def __getstate__(self) -> str:
        return self.name

    def __setstate__(self, name: str) -> None:
        self.__init__(name)

    def _open(self) -> None:
        table = np.load(SparkFiles.get(self.name), mmap_mode="r")
        self.columns = [np.asarray(column) for column in table]
        # most keys asked for are none of the file's, as their first bits tell
        bits = np.zeros(1 << FIRST_BITS, np.uint8)
        for at in range(0, table.shape[1], REST_ROWS):
            bits[self.columns[0][at : at + REST_ROWS] >> np.uint64(64 - FIRST_BITS)] = 1
        self.bits = bits.tobytes()

    def place(self, key: str) -> int:
        """The row of a key, -1 if it isn't in the file."""
        if self.columns is None:
            self._open()
        raw = xxhash.xxh3_128_digest(key.encode("utf-8", "replace"))
        first = int.from_bytes(raw[:8], "little")
        if not self.bits[first >> 64 - FIRST_BITS]:
            return -1
        firsts, seconds = self.columns[:2]
        i = int(firsts.searchsorted(np.uint64(first)))
        while i < len(firsts) and firsts[i] == first:
            if seconds[i] == int.from_bytes(raw[8:], "little"):
                return i
            i += 1
        return -1

    def __call__(self, key: str) -> int:
        i = self.place(key)
        return int(self.columns[2][i]) if i >= 0 else 0

    def __contains__(self, key: str) -> bool:
        return self.place(key) >= 0

    def isdisjoint(self, keys: Iterable[str]) -> bool:
        return not any(k in self for k in keys)

    @classmethod
    def of(cls, spark: SparkSession, facts: DataFrame) -> Rest | None:
        """The file of facts (key, n). The driver writes it in parts of a bounded number of rows; None if there are no facts."""
        facts = stored(facts.mapInPandas(filled(_digests), "d bigint, e bigint, n bigint"))
        rows = facts.count()
        if not rows:
            return None
        name, path = _new_file(spark)
        table = np.lib.format.open_memmap(path, "w+", np.uint64, (3, rows))
        at = 0
        for part in _in_order(facts, rows):
            for row, column in enumerate(("d", "e", "n")):
                table[row, at : at + len(part)] = part[column].to_numpy(np.int64).view(np.uint64)
            at += len(part)
        table.flush()
        del table
        spark.sparkContext.addFile(path)
        return cls(name)


class RestText(Rest):
    """As Rest, with a string for each key, in a second file."""

    def _open(self) -> None:
        super()._open()
        self.blob = np.memmap(SparkFiles.get(f"{self.name}.text"), np.uint8, "r")

    def text(self, key: str) -> str:
        i = self.place(key)
        if i < 0:
            return ""
        at, size = int(self.columns[2][i]), int(self.columns[3][i])
        return self.blob[at : at + size].tobytes().decode()

    @classmethod
    def of(cls, spark: SparkSession, facts: DataFrame) -> RestText | None:
        """The files of facts (key, value)."""
        facts = stored(facts.mapInPandas(filled(_digests), "d bigint, e bigint, value string"))
        rows = facts.count()
        if not rows:
            return None
        name, path = _new_file(spark)
        table = np.lib.format.open_memmap(path, "w+", np.uint64, (4, rows))
        at = begin = 0
        with open(f"{path}.text", "wb") as blob:
            for part in _in_order(facts, rows):
                raw = [v.encode() for v in part["value"]]
                sizes = np.fromiter(map(len, raw), np.uint64, len(raw))
                ends = begin + np.cumsum(sizes, dtype=np.uint64)
                columns = (part["d"].to_numpy(np.int64).view(np.uint64), part["e"].to_numpy(np.int64).view(np.uint64), ends - sizes, sizes)
                for row, column in enumerate(columns):
                    table[row, at : at + len(part)] = column
                blob.write(b"".join(raw))
                at += len(part)
                begin = int(ends[-1]) if len(raw) else begin
        table.flush()
        del table
        for p in (path, f"{path}.text"):
            spark.sparkContext.addFile(p)
        return cls(name)


def _new_file(spark: SparkSession) -> tuple[str, str]:
    """Name and path of a file that the driver writes and hands out by SparkContext.addFile: in the shared folder, or where that
    is no file system that Python can write to, in a folder of the driver's, whence Spark copies it to the executors."""
    name = f"rest-{uuid.uuid4().hex}.npy"
    shared = urlparse(shared_dir(spark))
    if shared.scheme == "file":
        folder = shared.path
        os.makedirs(folder, exist_ok=True)
    else:
        folder = tempfile.mkdtemp(prefix="foliomend-")
    return name, os.path.join(folder, name)


def _in_order(facts: DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    """The facts by the first 64 bits of their keys, part after part, told apart by the first 32 of them."""
    parts = -(-rows // REST_ROWS)
    for k in range(parts):
        begin, end = (k << 32) // parts, (k + 1 << 32) // parts
        part = facts.where(F.shiftrightunsigned("d", 32).between(begin, end - 1)).toPandas()
        yield part.iloc[np.argsort(part["d"].to_numpy(np.int64).view(np.uint64))]
