"""Repeated passages and the FM-index against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest

from quotelake.llm import passage_dedup
from quotelake.llm.fm_index import FmIndex, WaveletMatrix
from quotelake.llm.passage_dedup import remove_repeats


def by_hand(rows, width):
    """(doc_id, n_words, n_removed, kept) of rows (doc_id, text)."""
    first = defaultdict(lambda: float("inf"))
    split = [((t or "").encode().split(), float("inf") if i is None else i) for i, t in rows]
    for words, i in split:
        for k in range(len(words) - width + 1):
            key = tuple(words[k:k + width])
            first[key] = min(first[key], i)
    out = []
    for (words, i), (doc_id, _) in zip(split, rows):
        gone = {k + j for k in range(len(words) - width + 1) if first[tuple(words[k:k + width])] < i for j in range(width)}
        out.append((doc_id, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def texts_of(rng, n):
    """Texts that share passages of many lengths, with repetition, odd white space and letters."""
    words = ["a", "b", "Ä", "é", "x1", "(", "the", "of", "\xa0", "\x1c"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
                 for _ in range(rng.randint(0, 5))]
        out.append(rng.choice([" ", "\n", " \t ", "\x0b"]).join(parts))
    return out


@pytest.mark.parametrize("width, frequent, shard", [(13, 1000, 500_000), (13, 3, 50), (3, 1000, 20), (6, 0, 100)])
def test_repeats_by_hand(spark, monkeypatch, width, frequent, shard):
    monkeypatch.setattr(passage_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(passage_dedup, "SHARD_WORDS", shard)
    rng = random.Random(width + frequent)
    texts = texts_of(rng, 80) + [None, "", " \n ", "a " * 400, "a " * 900, "one two", "b a " * 200]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(None, texts[0]), (None, texts[1]), (5, texts[5]), (5, texts[6]), (-4, texts[7]), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id LONG, text STRING, doc STRING, at INT")
    got = remove_repeats(docs.repartition(3), width)
    assert found(got) == by_hand(rows, width)
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(s.start < s.end for s in r.spans)


def test_given_documents_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(remove_repeats(docs)) == by_hand([(r.doc_id, r.text) for r in docs.collect()], 13)


def test_empty_table_and_long_text(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id LONG, text STRING")).collect() == []
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, "new " + long)], "doc_id LONG, text STRING")
    assert {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeats(docs).collect()} == {
        1: (300_000, 0), 2: (300_001, 300_000)}


def test_wavelet_matrix_counts():
    rng = np.random.default_rng(2)
    for alphabet, n in [(2, 1), (5, 64), (300, 1000), (3, 0)]:
        symbols = rng.integers(0, alphabet, n)
        tree = WaveletMatrix(symbols, alphabet)
        c, at = np.repeat(np.arange(alphabet), n + 1), np.tile(np.arange(n + 1), alphabet)
        assert tree.rank(c, at).tolist() == [int((symbols[:i] == s).sum()) for s, i in zip(c, at)]


@pytest.mark.parametrize("width", [1, 4, 13])
def test_matching_statistics(width):
    rng = random.Random(width)
    held = [[rng.randint(1, 4) for _ in range(rng.randint(1, 30))] for _ in range(12)]
    asked = [[rng.randint(0, 6) for _ in range(rng.randint(0, 30))] for _ in range(40)] + held
    flat = lambda lists: (np.array([x for s in lists for x in s], np.int32), np.array([len(s) for s in lists]))
    index = FmIndex(*flat(held), width)
    length, low, high = index.matches(*flat(asked))
    k = 0
    for own in asked:
        for i in range(len(own)):
            for size in range(min(width, len(own) - i), -1, -1):
                hits = sum(s[j:j + size] == own[i:i + size] for s in held for j in range(len(s) - size + 1))
                if size == 0 or hits:
                    break
            assert length[k] == size and (size == 0 or high[k] - low[k] == hits)
            k += 1
