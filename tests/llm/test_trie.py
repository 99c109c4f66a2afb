"""The trie of conversations against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quotelake.llm import conversation_trie as trie

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, depth STRING, rep LONG"


def by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    inner = {n[:-1] for n in members if n}
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        ends = sorted(c for c in convs if len(whole[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(len(n) == len(node) + 1 for n in below), sum(n not in inner for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                        "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


@pytest.mark.parametrize("block, ids", [(4096, 50_000), (2, 2)])
def test_trie_by_hand(spark, monkeypatch, block, ids):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "IDS", ids)
    rng = random.Random(block)
    rows = []
    for c in [*range(0, 30), *range(100, 140), 205, 1003, 4_000_000_017]:
        for turn in range(rng.choice([1, 1, 2, 3, 9])):
            rows.append((c, turn, rng.choice(["user", None]), rng.choice(["hi", "ho", "", None, "é👩‍🚀"]), "x", 1))
    rows += [(7, None, "user", "first", "x", 1), (None, 1, "user", "lost", "x", 1), (300, 0, "u", "same", None, None)]
    rows += [(301, 3, "u", "again", None, None)] * 4  # repeated rows are turns of their own
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(trie.conversation_trie(docs)) == by_hand(rows)


def test_given_conversations_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found(trie.conversation_trie(docs)) == by_hand([(r.conv_id, r.turn, r.role, r.text) for r in docs.collect()])


def test_turnless_and_empty(spark):
    assert found(trie.conversation_trie(spark.createDataFrame([], SCHEMA))) == []
    short = [(c, 0, "u", "only", None, None) for c in range(401, 430)]  # no base: up to h own turns are lost
    assert found(trie.conversation_trie(spark.createDataFrame(short, SCHEMA))) == by_hand(short)


def test_one_conversation_in_many_parts(spark):
    rows = [(0, i, "user", f"t{i % 7}", None, None) for i in range(9000)]
    got = found(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(6)))
    assert len(got) == 9001 and sum(r[5] for r in got) == 9001 and max(r[1] for r in got) == 9000
