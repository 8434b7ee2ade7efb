"""Problem 6: byte-pair encoding with a public tokenizer's vocabulary, by a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("FOLIOMEND_TOKENIZERS", "/opt/tokenizers")
#: Words whose ids a worker remembers; beyond it the memory is emptied, which changes no result.
MEMORY = 400_000
_NONE = 1 << 60

# White space as Unicode's property of that name has it; Python's \s also takes the separators U+001C to U+001F.
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# A token never crosses such a piece's ends: a word with the one space before it, or white space up to the last one.
_PIECES = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+").findall
# The published pattern of byte-level BPE: contractions, letters, digits, other signs, white space.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class SegmentTree:
    """Minima over leaves; each leaf holds rank * width + position of the pair that starts there, so that the root is the
    leftmost of the pairs of lowest rank."""

    __slots__ = ("size", "node")

    def __init__(self, keys: list[int]) -> None:
        size = 1
        while size < len(keys):
            size *= 2
        self.size = size
        node = self.node = [_NONE] * size + keys + [_NONE] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a <= b else b

    def root(self) -> int:
        return self.node[1]

    def set(self, leaf: int, key: int) -> None:
        node, i = self.node, leaf + self.size
        node[i] = key
        while i > 1:
            i >>= 1
            a, b = node[2 * i], node[2 * i + 1]
            low = a if a <= b else b
            if node[i] == low:
                return
            node[i] = low


class _Memory(dict):
    """Ids of words met before; long pieces aren't kept, and a full memory is emptied."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        out = self.make(word)
        if len(self) >= MEMORY:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


class BytePairEncoder:
    """Ids of texts by a rank table. ranks: bytes of a token to its id, a lower id being merged first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import regex

        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.token = {i: b for b, i in ranks.items()}
        self.ranks = ranks
        self.pair: dict[tuple[int, int], int] = {}
        self.split = regex.compile(_PATTERN).findall
        self.memory = _Memory(self.word)

    def rank(self, a: int, b: int) -> int:
        got = self.pair.get((a, b))
        if got is None:
            got = self.pair[a, b] = self.ranks.get(self.token[a] + self.token[b], -1)
            if len(self.pair) > MEMORY:
                self.pair.clear()
        return got

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: while the root has a mergeable pair, merge it and update the two pairs beside it."""
        ids = [self.byte_id[b] for b in piece]
        n, rank = len(ids), self.rank
        if n < 2:
            return ids
        keys = [(r * n + i if (r := rank(ids[i], ids[i + 1])) >= 0 else _NONE) for i in range(n - 1)]
        tree = SegmentTree(keys)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (key := tree.root()) != _NONE:
            merged, i = divmod(key, n)
            j = after[i]
            k = after[j]
            ids[i], ids[j] = merged, -1
            after[i] = k
            if j < n - 1:
                tree.set(j, _NONE)
            if k < n:
                before[k] = i
                r = rank(merged, ids[k])
                tree.set(i, r * n + i if r >= 0 else _NONE)
            else:
                tree.set(i, _NONE)
            if (p := before[i]) >= 0:
                r = rank(ids[p], merged)
                tree.set(p, r * n + p if r >= 0 else _NONE)
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        """Ids of a piece between two white spaces, as 32-bit integers."""
        out = array("i")
        for piece in self.split(word):
            # lone surrogates can't be in Spark's strings; "replace" only guards other callers
            out.extend(self.merge(piece.encode("utf-8", "replace")))
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, as 32-bit integers in the machine's order."""
        return b"".join(map(self.memory.__getitem__, _PIECES(text)))


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", directory: str | None = TOKENIZER_DIR) -> BytePairEncoder:
    """The encoder of a .tiktoken rank file; one for each Python worker. Without a directory, of the file that Spark handed out."""
    file = f"{name}.tiktoken"
    with open(SparkFiles.get(file) if directory is None else f"{directory}/{file}", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return BytePairEncoder(ranks)


def _mapper(name: str, count: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, None).encode
        for batch in batches:
            columns = batch.columns
            text = columns[-1].to_pylist()
            ids = [encode(t) if t else b"" for t in text]
            sizes = [len(x) // 4 for x in ids]
            if count:
                last = pa.array(sizes, pa.int64())
            else:
                values = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(ids))])
                last = pa.ListArray.from_arrays(pa.array(accumulate(sizes, initial=0), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*columns[:-1], last], names=[*batch.schema.names[:-1], "tokens" if count else "ids"])

    return run


def _encoded(df: DataFrame, text: str, keep: list[str], name: str, directory: str, count: bool) -> DataFrame:
    # only the driver needs to see the folder; executors get the file from it
    df.sparkSession.sparkContext.addFile(f"{directory}/{name}.tiktoken")
    source = df.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    out = "tokens bigint" if count else "ids array<int>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), out])
    return source.mapInArrow(_mapper(name, count), schema)


def encode_ids(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """The columns `keep` and ids, the token ids of the text as stored, without special tokens.

    Null and empty texts give the empty list; blank text is ordinary text; strings that look like special tokens are ordinary
    text. Rows are neither dropped nor merged; other columns, whatever their names, aren't read."""
    return _encoded(df, text, list(keep), name, directory, False)


def token_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """As encode_ids, with tokens, the number of ids, in place of the ids."""
    return _encoded(df, text, list(keep), name, directory, True)
