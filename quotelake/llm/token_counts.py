"""How many tokens byte-pair merging leaves of a text, without making any.

Each piece of a text is a linked list of symbols and a heap of adjacent pairs by
merge rank. The lowest-rank leftmost pair is popped and merged until none is
left; the count is the number of initial symbols minus the merges.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.chunked import Memo, chunks, pieces, slices, splits_at_space
from quotelake.llm.tables import per_worker


def symbols_left(symbols: list[str], ranks: dict) -> int:
    """Symbols of one piece minus its merges. `ranks` maps a pair to its place in the merge list."""
    n = len(symbols)
    if n < 2:
        return n
    value, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(value, value[1:])) if (r := ranks.get((a, b))) is not None]
    heapify(heap)
    left = n
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if value[i] != a or j >= n or value[j] != b:
            continue  # one of the two was merged meanwhile
        value[i], value[j] = a + b, None
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((value[i], value[k]))) is not None:
                heappush(heap, (r, i, value[i], value[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((value[h], value[i]))) is not None:
            heappush(heap, (r, h, value[h], value[i]))
    return left


class TokenCounter:
    """Counts for a byte-level merge file of the tokenizers library; the library only cuts chunks into pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if not splits_at_space(spec):
            raise ValueError("a byte-level merge file without normalizer or prefix blank is needed")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.memo = Memo(lambda key: sum(symbols_left(list(p), self.ranks) for p in pieces(key, self.cut)))

    def count(self, texts: list[str]) -> list[int]:
        get, out = self.memo.__getitem__, []
        for text in texts:
            parts = self.added.split(text) if self.added else [text]  # an added token is one token
            out.append(sum(sum(map(get, chunks(p))) for p in parts if p) + len(parts) - 1)
        return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit`).

    A null text counts as empty; null and repeated ids are returned as they come, other
    columns are ignored, an empty table gives no rows. One pass, no shuffle.
    """

    def count(batches):
        counter = per_worker(("counter", tokenizer), lambda: TokenCounter(tokenizer))
        for batch in batches:
            ids, text = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(text):
                part = text[a:b]
                n = counter.count(part)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(t.encode()) for t in part], pa.int64()),
                     pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(count, "doc_id BIGINT, n_bytes BIGINT, n_tokens BIGINT, over_limit BOOLEAN")
