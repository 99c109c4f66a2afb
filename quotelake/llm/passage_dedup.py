"""Passages that an earlier document holds already, found with FM-indexes over shards of the corpus and removed.

A window of `width` words goes to the shard of its anchor, the five-word gram with the smallest hash in it. Equal windows
have equal anchors, so they meet in one shard, whatever surrounds them. Neighbouring windows of one anchor travel as one
stretch of words. Only anchors of two documents and more travel at all; equal stretches are merged to one with the
smallest document id; windows of very frequent anchors travel one by one and are dealt by all their words, so no
shard grows with one phrase.

Each shard is an FM-index over its stretches. All stretches stream past it; where the matching statistics
reach the width, the interval of suffixes holds every occurrence, and its smallest document is the first.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.chunked import slices
from quotelake.llm.fm_index import FmIndex
from quotelake.llm.tables import drop, keep

GRAM = 5  # words of an anchor
STRETCH = 64  # windows of a stretch at most; only repetition makes long ones
FREQUENT = 1000  # documents from which on the windows of an anchor travel one by one
SHARD_WORDS = 500_000  # words from which on an index is built; the stretches of one anchor stay together
NO_ID = (1 << 63) - 1  # rows without an id rank behind all others
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(texts: list) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words of each text, 64-bit hashes of all words, number of words of each text)."""
    words = [(t or "").encode().split() for t in texts]  # bytes: white space of ASCII only
    n = np.array([len(w) for w in words], np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(n.sum()))
    return words, hashes, n


def _roll(hashes: np.ndarray, size: int) -> np.ndarray:
    total = np.full(max(len(hashes) - size + 1, 0), size, np.uint64)
    for k in range(size):
        total = (total ^ (total >> np.uint64(29))) * _ODD + hashes[k:k + len(total)]
    total = (total ^ (total >> np.uint64(32))) * _ODD
    return total ^ (total >> np.uint64(29))


def anchors(hashes: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, text number, anchor) of each window of `width` words that lies in one text."""
    gram = min(GRAM, width)
    low = _roll(hashes, gram)
    reach, want = 1, width - gram + 1  # the smallest of `want` neighbouring grams, by doubling
    while reach < want:
        step = min(reach, want - reach)
        low = np.minimum(low[:len(low) - step], low[step:])
        reach += step
    text = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(text[:len(low)] == text[width - 1:]) if len(low) else np.zeros(0, np.int64)
    return inside, text[inside], low[inside].view(np.int64)


def stretches(start: np.ndarray, text: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of runs of neighbouring windows with one anchor, `STRETCH` at most."""
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
    at = np.flatnonzero(fresh)
    since = np.arange(len(start)) - np.repeat(at, np.diff(np.append(at, len(start))))
    at = np.flatnonzero(since % STRETCH == 0)
    return at, np.diff(np.append(at, len(start)))


def _list_array(values: np.ndarray, counts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                                    pa.array(values, kind))


def document_anchors(texts: DataFrame, width: int) -> DataFrame:
    """(doc, text_key, anchors): the distinct anchors of each document."""

    def find(batches):
        for batch in batches:
            text = batch.column(2).to_pylist()
            for a, b in slices(text):
                _, hashes, n = _hashes(text[a:b])
                _, owner, anchor = anchors(hashes, n, width)
                order = np.lexsort((anchor, owner))
                owner, anchor = owner[order], anchor[order]
                fresh = np.ones(len(owner), bool)
                fresh[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1])
                counts = np.bincount(owner[fresh], minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     _list_array(anchor[fresh], counts, pa.int64())], ["doc", "text_key", "anchors"])

    return texts.mapInArrow(find, "doc BIGINT, text_key BIGINT, anchors ARRAY<BIGINT>")


def shared_anchors(found: DataFrame) -> DataFrame:
    """(doc, text_key, anchors, frequent): of each document the anchors that another document has too.

    `frequent` lists those of them that many documents have.
    """
    each = found.select("doc", "text_key", F.explode("anchors").alias("anchor"))
    shared = keep(each.groupBy("anchor").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")).where("low < high").select(
        "anchor", (F.col("n") > FREQUENT).alias("many")), "shared-anchors")
    mine = each.join(shared, "anchor").groupBy("doc", "text_key").agg(
        F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("many"), F.col("anchor"))).alias("frequent"))
    mine = keep(mine, "document-anchors")
    drop(shared)
    return mine


def _cut(texts: DataFrame, width: int) -> DataFrame:
    """(doc, text_key, route, part, start, words) of texts with their shared anchors: stretches and where they lie.

    `route` deals stretches to shards; with `part`, a hash of all words, it names their content in 128 bits.
    """

    def cut(batches):
        for batch in batches:
            docs, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            text = batch.column(2).to_pylist()
            for a, b in slices(text):
                words, hashes, n = _hashes(text[a:b])
                start, owner, anchor = anchors(hashes, n, width)
                asked, many = (_members(owner, anchor, batch.column(i).slice(a, b - a)) for i in (3, 4))
                at, count = stretches(start[asked & ~many], owner[asked & ~many], anchor[asked & ~many])
                first = start[asked & ~many][at]
                route = anchor[asked & ~many][at]
                # windows of frequent anchors one by one
                alone = start[asked & many]
                all_words = _roll(hashes, width).view(np.int64)
                first, count = np.concatenate([first, alone]), np.concatenate([count, np.ones(len(alone), np.int64)])
                route = np.concatenate([route, all_words[alone]])
                base = np.cumsum(n) - n
                mine = np.searchsorted(np.cumsum(n), first, "right")
                inner = first - base[mine]
                # all words joined once; a stretch is a slice of that
                joined = b" ".join(chain.from_iterable(words))
                edge = np.concatenate([[0], np.cumsum(np.fromiter(
                    map(len, chain.from_iterable(words)), np.int64, int(n.sum())) + 1)])
                content = [joined[x:y] for x, y in zip(
                    edge[first].tolist(), (edge[first + count + width - 1] - 1).tolist())]
                part = np.fromiter(map(xxhash.xxh3_64_intdigest, content), np.uint64, len(content)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[a:b][mine]), pa.array(keys[a:b][mine]), pa.array(route), pa.array(part),
                     pa.array(inner), pa.array(content, pa.binary())],
                    ["doc", "text_key", "route", "part", "start", "words"])

    return texts.mapInArrow(
        cut, "doc BIGINT, text_key BIGINT, route BIGINT, part BIGINT, start BIGINT, words BINARY")


def _members(owner: np.ndarray, anchor: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Which anchors are in the list of their text."""
    at = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]].astype(np.int64)
    holder = np.repeat(np.arange(len(lists)), np.diff(at))
    known, number = np.unique(np.concatenate([values, anchor]), return_inverse=True)
    pairs = number.astype(np.int64) * max(len(lists), 1)
    return np.isin(pairs[len(values):] + owner, pairs[:len(values)] + holder)


def first_documents(words: list[bytes], docs: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each stretch of words, given the first document of each: the first document of each of its windows.

    One FM-index over all stretches, which then stream past it.
    """
    lengths = np.array([w.count(b" ") + 1 for w in words], np.int64)
    flat = b" ".join(words).split(b" ")
    alphabet = {w: i for i, w in enumerate(dict.fromkeys(flat), 1)}
    symbols = np.fromiter(map(alphabet.__getitem__, flat), np.int32, len(flat))
    index = FmIndex(symbols, lengths, width)
    matched, low, _ = index.matches(symbols, lengths)
    number, starts = index.classes(width)
    first = np.minimum.reduceat(docs[index.owner[index.suffixes]], starts[:-1])
    ends = np.cumsum(lengths)
    found = first[number[low]]
    found[matched < width] = NO_ID
    return [found[e - k:e - width + 1] for e, k in zip(ends.tolist(), lengths.tolist())]


def search_shards(contents: DataFrame, width: int) -> DataFrame:
    """(route, part, first): for distinct stretches (route, part, words, doc) the first document of each window."""

    def search(batches):
        held, size = [], 0

        def flush():
            rows = list(zip(*held))
            first = first_documents(rows[2], np.array(rows[3], np.int64), width)
            counts = np.array([len(f) for f in first])
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
                 _list_array(np.concatenate(first), counts, pa.int64())], ["route", "part", "first"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SHARD_WORDS and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += row[2].count(b" ") + 1
        if held:
            yield flush()

    dealt = contents.select("route", "part", "words", "doc").repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(search, "route BIGINT, part BIGINT, first ARRAY<BIGINT>")


def _without(texts: DataFrame, width: int) -> DataFrame:
    def remove(batches):
        for batch in batches:
            text = batch.column(1).to_pylist()
            for a, b in slices(text):
                hits, rows = batch.column(2).slice(a, b - a).to_pylist(), []
                for t, starts in zip(text[a:b], hits):
                    words = (t or "").encode().split()
                    if starts:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, np.asarray(starts) + width, -1)
                        gone = (np.cumsum(edge) > 0).astype(np.int8)
                        turns = np.flatnonzero(np.diff(gone, prepend=0)).tolist()
                        kept = [w for w, g in zip(words, gone.tolist()) if not g]
                        spans = [{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2])]
                    else:
                        kept, spans = words, []
                    rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode(), spans))
                n, lost, kept, spans = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(lost, pa.int64()),
                     pa.array(kept, pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return texts.mapInArrow(
        remove, "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, kept STRING, spans ARRAY<STRUCT<start: BIGINT, end: BIGINT>>")


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept, spans.

    A word goes when a window of `width` words that covers it also starts in a document with a smaller id. `kept` are
    the words that stay, joined by one blank; `spans` are the ranges of words that went (end exclusive).
    Windows are judged on the input. A null text counts as empty and has no words. Rows without an id rank
    behind all others and are equal among each other; rows of one id take nothing from one another, so repeated rows
    come out alike. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"),
                        F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    by_text = ["doc", "text_key"]
    found = keep(document_anchors(texts, width), "anchors")
    shared = shared_anchors(found)
    drop(found)
    places = keep(_cut(texts.join(shared, by_text).select(*by_text, "text", "anchors", "frequent"), width),
                  "stretches", "zstd")
    drop(shared)
    contents = places.groupBy("route", "part").agg(F.first("words").alias("words"), F.min("doc").alias("doc"))
    first = keep(search_shards(contents, width), "first-documents", "zstd")
    earlier = F.filter(F.transform("first", lambda f, i: F.when(f < F.col("doc"), F.col("start") + i)),
                       lambda at: at.isNotNull())
    hits = places.select(*by_text, "route", "part", "start").join(first, ["route", "part"]).select(
        *by_text, earlier.alias("at")).where(F.size("at") > 0)
    hits = keep(hits.groupBy(*by_text).agg(F.flatten(F.collect_set("at")).alias("at")), "repeats")
    drop(places, first)
    rest = texts.join(hits, by_text, "left").select("doc", "text", "at")
    out = _without(rest, width)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
