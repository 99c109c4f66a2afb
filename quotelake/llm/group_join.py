"""Near duplicates by a grouped prefix join on word shingles, exact at its threshold.

Two sets that are similar enough share a member of their prefixes, the first
members in one order of all shingles, rare ones first. Documents with equal sets
become one class; classes of equal prefix and size become one group, and only groups enter the
index of prefixes. A row stays in the index only if its list holds a partner for it by size and place. Group pairs are
filtered by size, position and bits, expanded to members, and verified on whole sets. Links are followed to components.

Short lists are compared in full. A long one never becomes all its pairs at once: while these lists still hold many
pairs of different components, each group is compared with the most promising pivot of its lists
and the components grow; lists of one component leave. What is left is compared in full, so nothing is lost,
but first by a few pairs for each pair of components, since one link makes all others of it needless.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.chunked import slices
from quotelake.llm.tables import drop, keep

BUCKETS = 1 << 17  # of shingle counts that make the order; any order gives the same result
SLOTS = 1 << 23  # bits of the filter for documents whose sets are needed
SHORT = 8  # rows of a list that is compared in full at once
PAIRS_PER_ROW = 2  # pairs of different components that a row of a long list may still stand for
PIVOTS = 4  # groups of each list that may be compared with in a round
SLICE_CHARS = 2_000_000  # characters of a batch whose sets are in a worker's memory at once
TRIES = 4  # pairs that are compared first for two components
SHRINK = 0.95  # a round has to bring the components in all lists below this share, or the rest is compared in full
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93,
        0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]  # odd multipliers, one for each place


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit numbers. Fewer words than `size` make one shingle."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space of ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for place in range(width):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(_MIX[place % len(_MIX)])
        total += hashes[place:place + len(total)]
    total = (total ^ (total >> np.uint64(32))) * np.uint64(_MIX[0])
    return np.unique(total ^ (total >> np.uint64(29)))


def prefix_length(n: int, percent: int) -> int:
    """How many of a set's first members any similar enough set must meet."""
    return n - -(-percent * n // 100) + 1 if n else 0


def similar(both, size_a, size_b, percent: int):
    return (100 + percent) * both >= percent * (size_a + size_b)


BITS = [f"bits{i}" for i in range(8)]
MARKED = 256  # first members of a set that have bits


def rare_first(members: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The members of a set in the one order of all shingles."""
    return members[np.lexsort((members, counts[(members & np.uint64(BUCKETS - 1)).astype(np.int64)]))]


def bit_words(members: np.ndarray) -> list[int]:
    """512 bits: one for each member, by parts of its number that decide nothing else."""
    words = np.zeros(len(BITS), np.uint64)
    np.bitwise_or.at(words, ((members >> np.uint64(46)) & np.uint64(7)).astype(np.int64),
                     np.uint64(1) << ((members >> np.uint64(40)) & np.uint64(63)))
    return words.view(np.int64).tolist()


def bucket_counts(texts: DataFrame, size: int) -> np.ndarray:
    """Shingle counts over all documents in a fixed number of buckets. Each task adds up its own first."""

    def add_up(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, size) & np.uint64(BUCKETS - 1)
                total += np.bincount(found.astype(np.int64), minlength=BUCKETS) if len(found) > BUCKETS // 8 else 0
                if len(found) <= BUCKETS // 8:
                    np.add.at(total, found.astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sums = texts.mapInArrow(add_up, "bucket INT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)  # at most BUCKETS rows came to the driver
    counts[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return counts


def _signature(found: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(raw[:8], signed=True), int.from_bytes(raw[8:], signed=True)


def set_rows(texts: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(doc_id, text_key, n, s1, s2, prefix): size, 128-bit signature and prefix of each document's set."""

    def describe(batches):
        for batch in batches:
            texts_of = batch.column(1).to_pylist()
            for a, b in slices(texts_of, SLICE_CHARS):
                rows = []
                for text in texts_of[a:b]:
                    found = shingle_set(text, size)
                    ordered = rare_first(found, counts)
                    first = ordered[:prefix_length(len(found), percent)]
                    marks = bit_words(ordered[:MARKED])
                    rows.append((len(found), *_signature(found), *marks, first.view(np.int64)))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(columns[0], pa.int32()),
                     *(pa.array(c, pa.int64()) for c in columns[1:-1]), pa.array(columns[-1], pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "n", "s1", "s2", *BITS, "prefix"])

    return texts.mapInArrow(
        describe, "doc_id BIGINT, text_key BIGINT, n INT, s1 BIGINT, s2 BIGINT, "
                  + ", ".join(f"{b} BIGINT" for b in BITS) + ", prefix ARRAY<BIGINT>")


def _slot(column):
    return F.pmod(F.xxhash64(column), F.lit(SLOTS))


def front_length(n: int) -> int:
    """How many of a set's first members are compared before whole sets are."""
    return min(n, n // 4 + 64)


def front(ordered: np.ndarray) -> np.ndarray:
    """Half of each of a set's first members, distinct and sorted."""
    return np.unique((ordered[:front_length(len(ordered))] >> np.uint64(32)).astype(np.uint32)).view(np.int32)


class _Sets(NamedTuple):
    """Names (cid, doc, s1, s2) of classes, and sets (doc_id, slot, s1, s2, n, front, members) of those and a few more."""

    ids: DataFrame
    cut: DataFrame


def _slots(docs: DataFrame) -> np.ndarray:
    """A bit filter of fixed size for the ids in `doc`."""
    slot = _slot(F.col("doc")) + 1
    maps = docs.groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()  # SLOTS / 32768 rows at most
    bits = np.zeros(SLOTS // 8, np.uint8)
    for row in maps:
        bits[(row["at"] - 1) * 4096:row["at"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _hits(slots, bits: np.ndarray) -> pa.Array:
    slots = slots.to_numpy()
    return pa.array(np.flatnonzero(bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1))


def _sets_for(pairs: DataFrame, texts: DataFrame, classes: DataFrame, size: int, counts: np.ndarray) -> _Sets:
    """Whole sets of the classes in pairs (a, b), each from the text of one document, where they were cut.

    A bit filter keeps other documents from being cut into shingles. The sets stay in their files until it is known which
    have a likely partner.
    """
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    ids = keep(wanted.join(classes.select("cid", "doc", "s1", "s2"), "cid"), "wanted")
    bits = _slots(ids)

    def cut(batches):
        seen = set()
        for batch in batches:
            hit = _hits(batch.column(2), bits)
            docs, slots, texts_of = batch.column(0).take(hit), batch.column(2).take(hit), batch.column(1).take(hit).to_pylist()
            for a, b in slices(texts_of, SLICE_CHARS):
                rows, at = [], []
                for i in range(a, b):
                    found = shingle_set(texts_of[i], size)
                    name = _signature(found)
                    if (docs[i].as_py(), name) not in seen:  # a repeated row is cut once by a task
                        seen.add((docs[i].as_py(), name))
                        at.append(i)
                        rows.append((*name, len(found), front(rare_first(found, counts)), found.view(np.int64)))
                columns, at = list(zip(*rows)) or [()] * 5, pa.array(at, pa.int64())
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [docs.take(at), slots.take(at), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    ["doc_id", "slot", "s1", "s2", "n", "front", "members"])

    return _Sets(ids, keep(texts.select("doc_id", "text", _slot(F.col("doc_id")).alias("slot")).mapInArrow(
        cut, "doc_id BIGINT, slot BIGINT, s1 BIGINT, s2 BIGINT, n INT, front ARRAY<INT>, members ARRAY<BIGINT>"), "sets"))


def _meet(named: DataFrame, cut: DataFrame, what: str) -> DataFrame:
    """Pairs with the size and with `what` of both sides."""
    for side in ("a", "b"):
        one = cut.select(F.col("doc_id").alias("at"), F.col("s1").alias(f"s1_{side}"), F.col("s2").alias(f"s2_{side}"),
                         F.col("n").alias(f"n_{side}"), F.col(what).alias(f"of_{side}"))
        named = named.join(one, [f"s1_{side}", f"s2_{side}"]).where(F.col("at").eqNullSafe(F.col(f"doc_{side}"))).drop("at")
    return named


def _likely(percent: int):
    """Whether pairs can be similar by the fronts of both sides. Never false for a pair that is.

    The front that ends first in the order has its common members in the other front; behind it only the rest of its set can
    be common. Values that the other front lacks stand for a member each, at least.
    """
    n_a, n_b = F.col("n_a"), F.col("n_b")
    f_a, f_b = (F.least(n, F.floor(n / 4) + 64) for n in (n_a, n_b))
    common = F.size(F.array_intersect("of_a", "of_b"))
    inside = F.least(f_a - F.size("of_a"), f_b - F.size("of_b")) + common
    return similar(inside + F.greatest(n_a - f_a, n_b - f_b), n_a, n_b, percent)


def _similar_pairs(pairs: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose whole sets are similar enough. Fronts travel first, and whole sets for likely pairs alone."""
    named = pairs
    for side in ("a", "b"):
        named = named.join(sets.ids.select(
            F.col("cid").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("doc", "s1", "s2"))), side)
    named = named.select(*pairs.columns, *(f"{c}_{side}" for side in "ab" for c in ("doc", "s1", "s2")))
    likely = keep(_meet(named, sets.cut, "front").where(_likely(percent)).select(*named.columns).distinct(), "likely")
    bits = _slots(likely.select(F.col("doc_a").alias("doc")).union(likely.select("doc_b")))

    def only(batches):
        for batch in batches:
            yield batch.take(_hits(batch.column(1), bits))

    columns = ["doc_id", "slot", "s1", "s2", "n", "members"]
    cut = sets.cut.select(*columns).mapInArrow(only, sets.cut.select(*columns).schema)
    both = F.size(F.array_intersect("of_a", "of_b"))
    found = _meet(likely, cut, "members").where(similar(both, F.col("n_a"), F.col("n_b"), percent))
    links = keep(found.select(*pairs.columns).distinct(), "links")
    drop(likely)
    return links


def verify(pairs: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int,
           counts: np.ndarray) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""
    pairs = keep(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    sets = _sets_for(pairs, texts, classes, size, counts)
    links = _similar_pairs(pairs, sets, percent)
    drop(pairs, *sets)
    return links


def _rooted(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b, root_a, root_b) of different components, after their roots have been joined by `labels`."""
    for side in ("root_a", "root_b"):
        up = labels.select(F.col("node").alias(side), F.col("root").alias("up"))
        pairs = pairs.join(up, side, "left").withColumn(side, F.coalesce("up", side)).drop("up")
    return pairs.where("root_a <> root_b").select(
        "a", "b", F.least("root_a", "root_b").alias("root_a"), F.greatest("root_a", "root_b").alias("root_b"))


def _links_between(pairs: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int,
                   counts: np.ndarray) -> DataFrame:
    """Verified links among pairs (a, b, root_a, root_b, share): enough of them for all components.

    Two components are first tried with a few pairs, likely ones first. Those that a link has joined need no other pair; the
    pairs of all others are compared in full.
    """
    pairs = keep(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    sets = _sets_for(pairs, texts, classes, size, counts)
    part = F.pmod(F.xxhash64("a", "b"), F.lit(TRIES))
    chosen = [F.max_by(F.struct("a", "b"), F.struct(part == i, "share", "a", "b")) for i in range(TRIES)]
    tried = keep(pairs.groupBy("root_a", "root_b").agg(F.array_distinct(F.array(*chosen)).alias("p")).select(
        "root_a", "root_b", F.explode("p").alias("p")).select("p.*", "root_a", "root_b"), "tried")
    first = _similar_pairs(tried, sets, percent)
    labels = components(first.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    rest = keep(_rooted(pairs.join(tried, ["a", "b"], "left_anti"), labels).select("a", "b"), "rest")
    links = first.select("a", "b").union(_similar_pairs(rest, sets, percent))
    drop(pairs, *sets, tried, labels, rest)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links (a, b) with the smallest node it is connected to.

    Nodes hang themselves under their smallest neighbour, paths are halved until flat, and the links
    between roots are what the next round works on; their number falls by half at least.
    """
    def ordered(df, a, b):
        return df.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).where("low < high").distinct()

    left = keep(ordered(links, "a", "b"), "contracted")
    nodes = left.select(F.col("low").alias("node")).union(left.select("high")).distinct()
    labels = keep(nodes.select("node", F.col("node").alias("root")), "labels")
    while not left.isEmpty():
        hooks, old = left.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("up")), ()
        while True:
            up = hooks.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            new = keep(hooks.join(up, "up", "left").select(
                "node", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved")), "hooks")
            drop(*old)
            hooks, old = new.select("node", "up"), (new,)
            if new.where("moved").isEmpty():
                break
        step = hooks.select(F.col("node").alias("root"), "up")
        old = (*old, labels, left)
        labels = keep(labels.join(step, "root", "left").select(
            "node", F.coalesce("up", "root").alias("root")), "labels")
        low = hooks.select(F.col("node").alias("low"), F.col("up").alias("low_up"))
        high = hooks.select(F.col("node").alias("high"), F.col("up").alias("high_up"))
        moved = left.join(low, "low", "left").join(high, "high", "left").select(
            F.coalesce("low_up", "low").alias("x"), F.coalesce("high_up", "high").alias("y"))
        left = keep(ordered(moved, "x", "y"), "contracted")
        drop(*old)
    return labels


def _shared():
    """The most members that rows a and b of one list can have in common, by the bits of their first `MARKED` members.

    Members whose bit the other side lacks are not common, and behind the marked part that ends first in the order only
    the rest of its own set can be.
    """
    n_a, n_b = F.col("n_a"), F.col("n_b")
    marked = {"a": F.least(n_a, F.lit(MARKED)), "b": F.least(n_b, F.lit(MARKED))}

    def common(one, other):
        lacking = [F.bit_count(F.col(f"{b}_{one}").bitwiseAND(F.bitwise_not(F.col(f"{b}_{other}")))) for b in BITS]
        return marked[one] - sum(lacking)

    return F.least(common("a", "b"), common("b", "a")) + F.greatest(n_a - marked["a"], n_b - marked["b"])


def _placed(percent: int):
    """By sizes, and by place, since the first common member has all others behind it."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    behind = F.least(n_a - F.col("pos_a"), n_b - F.col("pos_b"))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & similar(behind, n_a, n_b, percent)


def _fits(percent: int):
    """Whether rows a and b of one list can belong to a similar pair. Never false for a pair that is similar.

    By what `_placed` says, and by what can be `shared`.
    """
    return (_placed(percent) & (F.col("root_a") != F.col("root_b"))
            & similar(F.col("shared"), F.col("n_a"), F.col("n_b"), percent))


_ROW = ["gid", "n", "pos", *BITS, "root"]


def _side(lists: DataFrame, name: str) -> DataFrame:
    return lists.select("token", *(F.col(c).alias(f"{c}_{name}") for c in _ROW))


def _close(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(gid_a, gid_b, root_a, root_b, share) of rows that may be similar; the higher the share, the likelier."""
    met = _side(left, "a").join(_side(right, "b"), "token").withColumn("shared", _shared()).where(_fits(percent))
    return met.select("gid_a", "gid_b", "root_a", "root_b", (F.col("shared") / (F.col("n_a") + F.col("n_b"))).alias("share"))


def _met(index: DataFrame, percent: int) -> DataFrame:
    """The rows (token, gid, n, pos) that have a possible partner in their list by size and place.

    Sizes fall in bands such that similar sets lie in one band or in neighbouring ones. The smaller set of a similar pair meets the
    other in the first part of its prefix, which is `early`. A list is told by three masks of bands, so that a frequent
    token is summed up before the shuffle; bands that share a bit only let more rows stay.
    """
    step = max(math.log(100 / percent) * 1.001, 0.001)  # wider than the ratio, against rounding
    n, band = F.col("n").cast("bigint"), F.floor(F.log("n") / F.lit(step))
    rows = index.withColumns({"early": similar(n - F.col("pos"), n, n, percent), "band": band}).withColumns({
        "own": F.expr("shiftleft(1L, int(band % 64))"), "above": F.expr("shiftleft(1L, int((band + 1) % 64))"),
        "below": F.expr("shiftleft(1L, int((band + 63) % 64))")})
    lists = rows.groupBy("token").agg(
        F.count("*").alias("df"), F.bit_or("own").alias("some"), F.bit_xor("own").alias("odd"),
        F.bit_or(F.when(F.col("early"), F.col("own")).otherwise(0)).alias("first")).where("df > 1 AND first <> 0")
    even = F.col("some").bitwiseAND(F.bitwise_not(F.col("odd")))

    def has(mask, band):
        return mask.bitwiseAND(F.col(band)) != 0

    some, first = F.col("some"), F.col("first")
    twice = has(even, "own") | (F.col("df") > F.bit_count(some) + F.bit_count(even))  # or unknown
    larger = F.col("early") & (twice | has(some, "above"))
    smaller = has(first, "below") | has(first, "own") & twice
    return rows.join(lists, "token").where(larger | smaller).select("token", "gid", "n", "pos")


def _near(lists: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(gid_a, gid_b, share): all pairs of short lists that may be similar, gid_a < gid_b. Bits travel with pairs, not with rows."""
    def side(name):
        return lists.select("token", *(F.col(c).alias(f"{c}_{name}") for c in ("gid", "n", "pos")))

    def bits(name):
        return groups.select(F.col("gid").alias(f"gid_{name}"), F.col("n").alias(f"n_{name}"),
                             *(F.col(c).alias(f"{c}_{name}") for c in BITS))

    pairs = side("a").join(side("b"), "token").where("gid_a < gid_b").where(_placed(percent)).select(
        "gid_a", "gid_b").distinct()
    marked = pairs.join(bits("a"), "gid_a").join(bits("b"), "gid_b").withColumn("shared", _shared())
    return marked.where(similar(F.col("shared"), F.col("n_a"), F.col("n_b"), percent)).select(
        "gid_a", "gid_b", (F.col("shared") / (F.col("n_a") + F.col("n_b"))).alias("share"))


def _with_root(rows: DataFrame, labels: DataFrame, gid: str = "gid", root: str = "root") -> DataFrame:
    return rows.join(labels.select(F.col("node").alias(gid), F.col("root").alias(root)), gid, "left").withColumn(
        root, F.coalesce(root, gid))


def _links(texts: DataFrame, classes: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Verified links (a, b) between classes: enough of them for all components."""
    keyed = classes.where("n > 0").select(
        "cid", "n", F.xxhash64(F.lit(1), "prefix").alias("g1"), F.xxhash64(F.lit(2), "prefix").alias("g2"), *BITS)
    by_prefix = ["n", "g1", "g2", *BITS]  # what the index and its filters go by
    many = keyed.groupBy(*by_prefix).agg(F.min("cid").alias("gid"), F.count("*").alias("size")).where("size > 1")
    members = keep(keyed.join(many, by_prefix).select("gid", "cid").where("gid <> cid"), "members")
    links = verify(members.select(F.col("gid").alias("a"), F.col("cid").alias("b")), texts, classes, size, percent, counts)
    # members not linked to the first of their group stand for themselves
    groups = classes.where("n > 0").select(F.col("cid").alias("gid"), "n", "prefix", *BITS).join(
        links.select(F.col("b").alias("gid")), "gid", "left_anti")
    marks = groups.drop("prefix")
    index = keep(_met(groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token")), percent), "index")
    sizes = index.groupBy("token").agg(F.count("*").alias("df"))
    near = keep(_near(index.join(sizes.where(F.col("df").between(2, SHORT)).select("token"), "token"), marks, percent), "near")
    inside = links.select(F.col("a").alias("gid"), F.col("b").alias("cid"))
    # members are not in the index, so each group is a root
    lists = keep(index.join(sizes.where(F.col("df") > SHORT).select("token"), "token").join(
        marks.select("gid", *BITS), "gid").withColumn("root", F.col("gid")), "lists")
    drop(index)
    labels, before, tried = None, None, []
    for turn in range(64):
        parts = lists.groupBy("token", "root").count().groupBy("token").agg(
            F.sum("count").alias("all"), F.sum(F.col("count") * F.col("count")).alias("own"),
            F.count("*").alias("roots"))
        rows, pairs, roots = parts.where("roots > 1").agg(
            F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2),
                                                           F.lit(0.0)), F.coalesce(F.sum("roots"), F.lit(0))).first()
        if turn and (pairs <= PAIRS_PER_ROW * rows or roots > SHRINK * before):
            break  # few pairs, or pivots bring no more: compare what is left in full
        before = roots
        chosen = [F.min_by("gid", F.xxhash64(F.lit(PIVOTS * turn + i), "gid")) for i in range(PIVOTS)]
        pivots = lists.groupBy("token").agg(F.array_distinct(F.array(*chosen)).alias("p")).select(
            "token", F.explode("p").alias("gid")).join(lists, ["token", "gid"])
        close = _close(pivots, lists, percent).select("gid_a", "gid_b", "share")
        best = (close if turn else close.union(near)).groupBy("gid_b").agg(
            F.max_by("gid_a", F.struct("share", "gid_a")).alias("gid_a"))
        tried.append(keep(best.select(
            F.least("gid_a", "gid_b").alias("a"), F.greatest("gid_a", "gid_b").alias("b")).distinct(), "tried"))
        links = keep(links.union(verify(tried[-1], texts, classes, size, percent, counts)), "links")
        old = (lists,) if labels is None else (lists, labels)
        labels = components(links)
        joined = keep(_with_root(lists.drop("root"), labels), "joined")
        still = joined.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        lists = keep(joined.join(still.select("token"), "token", "left_semi"), "lists")
        drop(joined, *old)
    apart = _with_root(_with_root(near, labels, "gid_a", "root_a"), labels, "gid_b", "root_b").where("root_a <> root_b")
    close = _close(lists, lists, percent).where("gid_a < gid_b").unionByName(apart).select(
        "gid_a", "gid_b", F.least("root_a", "root_b").alias("root_a"), F.greatest("root_a", "root_b").alias("root_b"),
        "share").distinct()
    # groups to members: a group without further members stands for its first alone
    of_a = inside.select(F.col("gid").alias("gid_a"), F.col("cid").alias("more_a"))
    of_b = inside.select(F.col("gid").alias("gid_b"), F.col("cid").alias("more_b"))
    roots = ["root_a", "root_b", "share"]
    more = close.join(of_a, "gid_a").select("gid_b", F.col("more_a").alias("a"), *roots)
    wide = close.select("gid_b", F.col("gid_a").alias("a"), *roots).union(more).join(of_b, "gid_b").select(
        "a", F.col("more_b").alias("b"), *roots).union(more.select("a", F.col("gid_b").alias("b"), *roots))
    # only the first of groups have been compared before; what is left of those was found dissimilar
    before = reduce(DataFrame.union, tried).withColumnsRenamed({"a": "gid_a", "b": "gid_b"}).distinct()
    new = close.join(before, ["gid_a", "gid_b"], "left_anti").select(
        F.col("gid_a").alias("a"), F.col("gid_b").alias("b"), *roots)
    links = links.union(_links_between(new.union(wide), texts, classes, size, percent, counts))
    drop(lists, near, labels, members, *tried)
    return links


def labelled(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n, root, component_id) by row. `root` names the component; rows without words have none."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                        F.xxhash64(text_col).alias("text_key"))
    counts = bucket_counts(texts, size)
    rows = keep(set_rows(texts, size, percent, counts), "rows")
    classes = keep(rows.where("n > 0").groupBy("s1", "s2").agg(
        F.min("doc_id").alias("doc"), *(F.first(c).alias(c) for c in ("n", *BITS, "prefix"))).withColumn(
        "cid", F.monotonically_increasing_id()), "classes")
    labels = components(_links(texts, classes, size, percent, counts))
    rooted = keep(classes.select("s1", "s2", "cid", "doc").join(
        labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = keep(rooted.join(smallest, "root").select("s1", "s2", "root", "component_id"), "named")
    drop(rooted, classes, labels)
    plain = rows.drop("prefix", *BITS)
    linked = plain.where("n > 0").join(named, ["s1", "s2"]).drop("s1", "s2")
    alone = plain.where("n = 0").select(
        "doc_id", "text_key", "n", F.lit(None).cast("bigint").alias("root"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Words are lower-cased in A-Z; sets link when 100 * common >= percent * union. A document without words
    (empty or null) is linked with nothing. Repeated rows and equal sets are one class, whatever their number. Null ids
    don't count as the smallest; a component of null ids only has a null id. Other columns are
    ignored; an empty table gives no rows.
    """
    return labelled(docs, size, percent, id_col, text_col).select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """One document of each component, with all columns: the smallest id (null last), then the smallest text key.

    Documents without words all stay. Rows repeated with id and text are one document; they stay or go together.
    """
    rows = keep(labelled(docs, size, percent, id_col, text_col).where("root IS NOT NULL").select(
        "doc_id", "text_key", "root"), "labelled")
    first = rows.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first"))
    gone = rows.join(first, "root").where(~(
        F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))).select(
        "doc_id", "text_key").distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("bigint").alias("id"),
                      F.xxhash64(text_col).alias("key"))  # apart from the names of other columns
    return row.join(gone, row.id.eqNullSafe(gone.doc_id) & (row.key == gone.text_key), "left_anti").select("row.*")
