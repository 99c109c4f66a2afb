"""Sequences are gapless, whole, and few."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quotelake.llm import packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n, want", [
    (1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2500, [(0, 452), (452, 1024), (1476, 1024)])])
def test_only_the_first_piece_is_short(n, want):
    assert packing.cut_pieces(n, 1024) == want


def test_the_knapsack_finds_the_best_configuration():
    prices = np.zeros(11)
    prices[[3, 4, 7]] = [3.1, 4.5, 7.2]
    assert packing.best_configuration(prices, 10) == {3: 2, 4: 1}


@pytest.mark.parametrize("seed", range(4))
def test_plans_cover_every_piece_once_and_no_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.geometric(0.004 * (seed + 1), 3000), 1024)
    need = Counter(sizes.tolist())
    plan = packing.solve(need)
    got = Counter()
    for config, times in plan:
        assert sum(s * t for s, t in config.items()) <= 1024
        for s, t in config.items():
            got[s] += t * times
    assert got == need
    used = sum(t for _, t in plan)
    counts = np.bincount(sizes, minlength=1025)
    assert used <= sum(t for _, t in packing.best_fit(counts, 1024)) * 1.002
    assert used <= -(-int(sizes.sum()) // 1024) * 1.02


def test_work_depends_on_lengths_not_on_counts():
    small = packing.solve({400: 10, 600: 10, 300: 7})
    big = packing.solve({400: 10 ** 12, 600: 10 ** 12, 300: 7 * 10 ** 11})
    assert len(big) <= len(small) + 3
    assert packing.solve({}) == []


def demand(**counts):
    need = np.zeros(1025, np.int64)
    for size, times in counts.items():
        need[int(size[1:])] = times
    return need


@pytest.mark.parametrize("counts, optimum", [
    ({"n600": 1000}, 1000), ({"n512": 1000}, 500), ({"n400": 1000, "n600": 1000}, 1000), ({"n341": 3000, "n700": 10}, 1010)])
def test_the_program_nears_its_optimum_and_its_bound_is_below(counts, optimum):
    need = demand(**counts)
    amounts, bound = packing.fractional(need, 1024)
    assert bound <= optimum + 1e-6
    covered = np.zeros(1025)
    for config, amount in amounts.items():
        assert sum(s * t for s, t in config) <= 1024 and amount > 0
        for s, t in config:
            covered[s] += amount * t
    sizes = np.arange(1025)
    assert (covered @ sizes) == pytest.approx(need @ sizes)
    assert sum(amounts.values()) <= optimum * 1.05


def test_the_bound_is_feasible_and_the_average_is_close_to_it():
    rng = np.random.default_rng(5)
    need = np.bincount(np.minimum(rng.geometric(0.006, 200000), 1023), minlength=1025)
    amounts, bound = packing.fractional(need, 1024)
    assert int(need @ np.arange(1025)) / 1024 <= bound + 1e-6 <= sum(amounts.values()) * 1.001
    assert sum(amounts.values()) <= bound * 1.005


def test_weights_decide_the_plan():
    rng = np.random.default_rng(6)
    need = np.bincount(np.minimum(rng.geometric(0.006, 5000), 1023), minlength=1025)
    right = packing.fractional(need, 1024, steps=60)[0]
    frozen = packing.fractional(need, 1024, steps=60, rate=0.0)[0]
    wrong = packing.fractional(need, 1024, steps=60, first=np.ones(1025))[0]  # every length worth the same
    left = [int(packing.rounded(a, need)[1] @ np.arange(1025)) for a in (right, frozen, wrong)]
    assert set(right) != set(frozen) and set(right) != set(wrong)
    assert left[0] < left[1] and left[0] < left[2]  # what rounding leaves: right weights cover the demand most evenly


def test_rounding_takes_whole_sequences_and_no_more_than_there_is():
    need = demand(n400=10, n600=10)
    plan, rest = packing.rounded({((600, 1), (400, 1)): 8.4, ((400, 2),): 2.2, ((600, 1),): 1.6}, need)
    assert plan == [({600: 1, 400: 1}, 8), ({400: 2}, 1), ({600: 1}, 2)] and not rest.any()


def test_packed_rows(spark):
    rows = [(i, "word " * (i * 37 % 700)) for i in range(60)] + [(3, "again"), (None, None), (70, ""), (71, "z" * 9000)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id LONG, text STRING, length INT").repartition(5)
    got = packing.pack(docs, BYTE).collect()
    tokenizer = Tokenizer.from_file(BYTE)
    want = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    whole = Counter()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(n * c for (_, n), c in want.items())
    assert sum(r.length for r in got) == total and len(sequences) <= total // 1024 + 2
    for (i, n), c in want.items():
        if i != 3:
            whole[i, n] += sum(r.length for r in got if r.doc_id == i) // n
    assert all(whole[k] == c for k, c in want.items() if k[0] != 3)
    assert packing.pack(docs.limit(0), BYTE).collect() == []
