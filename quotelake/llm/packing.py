"""Packing token pieces into sequences by a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits one sequence. The program asks for the fewest configurations, in
fractions, that cover every length as often as it occurs. Multiplicative weights solve it: a length's weight falls as its
demand gets covered, a knapsack dynamic program prices configurations under these weights, steps take configurations
whose price is close to the best, and the steps of the second half are averaged. The averaged solution is rounded to
whole sequences, and what rounding leaves is packed best-fit. Every pricing also bounds the program from below. All of this
sees only the histogram, at most one number per length. Pieces then find their sequence by their rank among equal lengths.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelake.llm.chunked import encoder, slices
from quotelake.llm.tables import keep

CAPACITY = 1024
STEPS = 300  # pricings of the program
RATE = 0.1  # how fast a weight falls with the covered share of its length's demand
SLACK = 0.005  # share of the best price that a configuration may lack
BATCH = 32  # configurations taken at the prices of one pricing
PIECES = ("doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT, block INT, nth BIGINT")


def cut_pieces(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length): full pieces, the first one shorter if need be."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n_tokens, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Pieces of every document, with `block` (the task) and `nth` (place among the equal lengths of the block)."""

    def cut(batches):
        block, seen, tail = TaskContext.get().partitionId(), Counter(), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(text):
                rows = []
                for doc, raw in zip(ids[a:b], encoder(tokenizer).encode(text[a:b])):
                    raw += tail
                    for k, (start, size) in enumerate(cut_pieces(len(raw) // 4, capacity)):
                        crc = zlib.crc32(raw[4 * start:4 * (start + size)])
                        rows.append((doc, k, start, size, crc, block, seen[size]))
                        seen[size] += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(cut, PIECES)


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """By room, the highest total price of lengths that fit, and one length of such a choice (0: the room stays short)."""
    total, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        values = prices[1:room + 1] + total[room - 1::-1]
        best = int(values.argmax())
        if prices[best + 1] > 0 and values[best] > total[room - 1]:
            total[room], pick[room] = values[best], best + 1
        else:
            total[room] = total[room - 1]
    return total, pick


def read_off(total: np.ndarray, pick: np.ndarray, prices: np.ndarray, room: int, free: np.ndarray,
             found: Counter | None = None) -> Counter:
    """A choice of the table that adds to `found` and takes no length more often than `free` says; where the table's own
    length is used up, the best of the others."""
    found = Counter() if found is None else found
    while room > 0:
        size = int(pick[room])
        if size and found[size] >= free[size]:
            spent = np.array([s for s, t in found.items() if t >= free[s]], np.int64)
            values = np.where((prices[1:room + 1] > 0) & (free[1:room + 1] > 0),
                              prices[1:room + 1] + total[room - 1::-1], -1.0)
            values[spent[spent <= room] - 1] = -1.0
            size = int(values.argmax()) + 1
            size = size if values[size - 1] > total[room - 1] * (1 - SLACK) else 0
        if size:
            found[size] += 1
            room -= size
        else:
            room -= 1
    return found


def best_configuration(prices: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths of the highest total price that fits. `prices` by length, 0 for lengths not wanted."""
    return read_off(*knapsack(prices, capacity), prices, capacity, np.full(capacity + 1, capacity + 1))


def fractional(need: np.ndarray, capacity: int, steps: int = STEPS, rate: float = RATE,
               first: np.ndarray | None = None) -> tuple[dict[tuple, float], float]:
    """The program by multiplicative weights: configurations with their amounts, and a lower bound of the optimum.

    Prices are duals: a length's share of a sequence (or `first`) times its weight, exp(-rate * covered share of its
    demand). Each step prices by one dynamic program and takes up to `BATCH` configurations, those of the least covered
    lengths first, whose price lacks at most `SLACK` of the best; a step moves no length by more than its demand. Any
    prices divided by the best configuration's price are feasible duals, which gives the bound. Amounts are the average over the
    second half of the steps, scaled to the whole demand in tokens.
    """
    sizes, span = np.flatnonzero(need), np.arange(capacity + 1)
    start = span / capacity if first is None else first
    cover, amounts, bound, since = np.zeros(capacity + 1), Counter(), 0.0, None

    def take(config, moved):
        amount = min(need[s] * (1 - moved[s]) / t for s, t in config.items())
        for s, t in config.items():
            share = moved[s] + amount * t / need[s]
            moved[s] = 1 if share > 1 - 1e-9 else share
        if since is not None:
            amounts[tuple(sorted(config.items(), reverse=True))] += amount

    for step in range(steps):
        if step == steps // 2:
            since = cover.copy()
        prices = np.where(need > 0, start * np.exp(-rate * (cover - cover[sizes].min())), 0)
        total, pick = knapsack(prices, capacity)
        bound = max(bound, float(need @ prices) / total[capacity])
        own = prices[sizes] + total[capacity - sizes]
        near = sizes[own >= total[capacity] * (1 - SLACK)]
        moved, taken, best = np.zeros(capacity + 1), 0, (0.0, None)
        for size in near[np.argsort(cover[near], kind="stable")][:2 * BATCH].tolist():
            if moved[size] == 1:
                continue
            config = read_off(total, pick, prices, capacity - size, np.where(moved < 1, need, 0), Counter({size: 1}))
            price = sum(prices[s] * t for s, t in config.items())
            best = max(best, (price, config), key=lambda b: b[0])
            if price >= total[capacity] * (1 - SLACK):
                take(config, moved)
                taken += 1
            if taken == BATCH:
                break
        if not taken:  # the table takes lengths more often than they occur; of those that don't, the best one seen
            take(best[1], moved)
        cover += moved
    tokens = need * span
    scale = float(tokens.sum()) / max(float(tokens @ (cover - since)), 1e-12)
    return {config: amount * scale for config, amount in amounts.items()}, bound


def rounded(amounts: dict[tuple, float], need: np.ndarray) -> tuple[list[tuple[dict, int]], np.ndarray]:
    """Whole sequences along the running total of the amounts, largest first, never more than is left of a length;
    and what they leave."""
    rest, plan, running = need.copy(), [], 0.0
    for config, amount in sorted(amounts.items(), key=lambda c: (-c[1], c[0])):
        running += amount
        copies = min(int(running), *(int(rest[s]) // t for s, t in config))
        if copies:
            running -= copies
            for s, t in config:
                rest[s] -= t * copies
            plan.append((dict(config), copies))
        running = min(running, 1.0)
    return plan, rest


def fill(config: Counter, left: np.ndarray, room: int) -> Counter:
    """Add the largest lengths of `left` that still fit, until nothing does."""
    while room:
        fit = np.flatnonzero(left[:room + 1])
        if not len(fit):
            break
        size = int(fit[-1])
        times = min(int(left[size]), room // size)
        config[size] += times
        left[size] -= times
        room -= times * size
    return config


def best_fit(need: np.ndarray, capacity: int) -> list[tuple[dict, int]]:
    """Largest first, then always the largest length that still fits; a configuration repeats while all its parts last.

    Every step uses up a length, so the number of configurations is at most that of lengths, whatever the counts.
    """
    need, out = need.copy(), []
    while need.any():
        config = fill(Counter(), need.copy(), capacity)
        repeat = min(int(need[s]) // t for s, t in config.items())
        for s, t in config.items():
            need[s] -= t * repeat
        out.append((dict(config), repeat))
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict, int]]:
    """(configuration, how often): covers every length exactly as often as it occurs. Work doesn't grow with counts."""
    need = np.zeros(capacity + 1, np.int64)
    for size, times in histogram.items():
        need[size] = times
    plan = []
    if need[capacity]:
        plan.append(({capacity: 1}, int(need[capacity])))  # full pieces fill a sequence each
        need[capacity] = 0
    if need.any():
        whole, rest = rounded(fractional(need, capacity)[0], need)
        plan += whole + best_fit(rest, capacity)
    return plan


def places(plan: list[tuple[dict, int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, copies in one sequence, first offset), ascending in rank."""
    out, used, sequence = {}, Counter(), 0
    for config, times in plan:
        offset = 0
        for size in sorted(config, reverse=True):
            out.setdefault(size, []).append((used[size], sequence, config[size], offset))
            used[size] += times * config[size]
            offset += size * config[size]
        sequence += times
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and gives one piece of the end id; null and repeated ids are
    packed row by row as they come; other columns are ignored; an empty table gives no rows. Only
    documents of more than `capacity` tokens are cut. Encoding runs once; everything after it moves rows of numbers.
    """
    pieces = keep(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    counts = pieces.groupBy("block", "length").count()
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    where = places(solve(histogram, capacity))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("block", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["block", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            sizes, starts = np.unique(length[order], return_index=True)
            for size, rows in zip(sizes.tolist(), np.split(order, starts[1:])):
                table = where[size]
                hit = table[np.searchsorted(table[:, 0], rank[rows], "right") - 1]
                at = rank[rows] - hit[:, 0]
                sequence[rows] = hit[:, 1] + at // hit[:, 2]
                offset[rows] = hit[:, 3] + at % hit[:, 2] * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(assign, "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT, "
                                     "sequence_id BIGINT, offset BIGINT")
