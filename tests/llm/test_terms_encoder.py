import base64
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomend.llm import encoder as E
from foliomend.llm import terms

TEXTS = [None, "", "  ", "The the thé Kelvin", "a A b", "a" * 70_000 + " the", "c\na", "The the thé Kelvin"]


def brute(texts):
    occ, files = Counter(), Counter()
    for t in texts:
        words = [w.lower() for w in re.findall("[A-Za-z]+", t or "")]
        occ.update(words)
        files.update(set(words))
    return {w: (occ[w], files[w]) for w in occ}


@pytest.mark.parametrize("flush", [1, 10**6])
def test_last_seen_counters_equal_sets(spark, tmp_path, flush):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(4, "a A b", "y", 2)]  # file 4 comes twice
    df = spark.createDataFrame(rows, "file_id long, text string, term string, files int")
    df.repartition(3).write.parquet(str(tmp_path / "h"))
    for source in (df, spark.read.parquet(str(tmp_path / "h"))):
        counts = terms.term_counts(source, flush=flush)
        got = {r["term"]: (r["occurrences"], r["files"]) for r in counts.collect()}
        assert got.pop(None) == (0, 7)
        assert got == brute(TEXTS)
        marks = {r["term"]: r["mark"] for r in terms.marked_terms(counts).collect()}
        assert marks["b"] == "rare" and marks["the"] is None and marks["elvin" if "elvin" in marks else "kelvin"] == "rare"


def test_common_terms_and_empty_tables(spark):
    df = spark.createDataFrame([(i, "the") for i in range(5)] + [(9, "x")], "file_id long, text string")
    assert {r["term"]: r["mark"] for r in terms.marked_terms(terms.term_counts(df)).collect()} == {"the": "common", "x": "rare"}
    empty = spark.createDataFrame([], "file_id long, text string")
    assert terms.marked_terms(terms.term_counts(empty)).count() == 0


def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


ODD = ["", " ", "  \n\n x", "a\x1cb\x1d c", "it's DON'T 　x\xa0y", "a" * 3000, "<|endoftext|> hi", "a \n  b\t\tc  ", "1234 ½ Ⅷ x_y", "這部目錄是由學者重抄的" * 40, "é" * 500, "​ x   y", "\x00\x01", "👩‍👩‍👧 ok"]


def test_ids_equal_a_public_implementation():
    encode, mine = reference(), E.encoder()
    rng = random.Random(1)
    made = ["".join(rng.choice("ab eé\n\t\xa0'sd1一,. ") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in ODD + made:
        assert np.frombuffer(mine.encode(t), "i4").tolist() == encode(t), repr(t)


def test_segment_tree_gives_the_leftmost_lowest_pair():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 20):
        keys = [rng.randrange(50) * n + i for i in range(n)]
        tree = E.SegmentTree(list(keys))
        for _ in range(50):
            assert tree.root() == min(keys)
            i = rng.randrange(n)
            keys[i] = E._NONE if rng.random() < 0.2 else rng.randrange(50) * n + i
            tree.set(i, keys[i])


def test_merging_by_the_tree_equals_merging_by_search():
    with open(f"{E.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = E.BytePairEncoder(ranks)
    rng = random.Random(3)
    for _ in range(200):
        piece = bytes(rng.choice(b"theaning ing") for _ in range(rng.randint(1, 40)))
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 40), i))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert enc.merge(piece) == [ranks[p] for p in parts]


def test_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(E, "MEMORY", 3)
    with open(f"{E.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    small, text = E.BytePairEncoder(ranks), "the quick brown fox jumps over the lazy dog " * 3
    assert small.encode(text) == E.encoder().encode(text)


def test_encoding_of_a_table(spark):
    rows = [(i, t, "ids?") for i, t in enumerate([None, *ODD])] + [(None, "x", "ids?")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in E.encode_ids(df).collect()}
    encode = reference()
    assert got == {0: []} | {i + 1: encode(t) for i, t in enumerate(ODD)} | {None: encode("x")}
    sizes = {r["doc_id"]: r["tokens"] for r in E.token_counts(df).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert E.encode_ids(df.limit(0)).agg(F.count("*")).first()[0] == 0
