"""Exact and near copies against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quotelake.llm import block_naming, group_join
from quotelake.llm.block_naming import drop_exact_duplicates, exact_duplicates
from quotelake.llm.group_join import components, drop_near_duplicates, near_duplicates, shingle_set


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    return sorted(((i, max((x for x in groups[fold(t)] if x is not None), default=None), len(groups[fold(t)]))
                   for i, t in rows), key=str)


@pytest.mark.parametrize("size", [1, 4, 64])
def test_block_names_find_equal_texts(spark, size):
    rng = random.Random(size)
    base = ["".join(rng.choice("aAbÄä ") for _ in range(rng.randint(0, 40))) for _ in range(25)]
    rows = [(i, rng.choice(base)) for i in range(90)] + [
        (200, None), (201, ""), (None, "ab"), (202, "AB"), (5, "twice"), (5, "TWICE"), (203, "Ä"), (204, "ä")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id LONG, text STRING, name STRING").repartition(4)
    got = exact_duplicates(docs, size).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == exact_by_hand(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({fold(t) for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)
    stays = drop_exact_duplicates(docs, size)
    assert stays.columns == docs.columns
    assert sorted(fold(r.text) for r in stays.collect()) == sorted({fold(t) for _, t in rows})


def test_shared_keys_are_noticed(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id LONG, text STRING")
    right = block_naming._key
    monkeypatch.setattr(block_naming, "_key", lambda b, seed: F.struct(
        F.octet_length(b).cast("long").alias("a"), F.lit(0).cast("long").alias("b")) if seed < 2 else right(b, seed))
    assert all(r.group_size == 1 for r in exact_duplicates(docs, 64).collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert exact_duplicates(docs).collect() == [] and near_duplicates(docs).collect() == []
    assert drop_exact_duplicates(docs).collect() == [] and drop_near_duplicates(docs).collect() == []


def sets_by_hand(text, size):
    words = fold(text).split() if text else []
    if not words:
        return frozenset()
    k = min(size, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def near_by_hand(rows, size, percent):
    sets = [sets_by_hand(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    small = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        small[root(k)].append(i)
    return sorted((i, len(sets[k]), min(small[root(k)])) for k, (i, _) in enumerate(rows))


def near_rows(seed, copies=14, bases=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(bases):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
        if rng.random() < 0.5:
            words[1:1] = passage
        for _ in range(rng.randint(1, copies)):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    texts += ["", "one", "ONE", "a b", "a  b", "b a", "one two three"]
    return [(i + 1, t) for i, t in enumerate(texts)] + [(1000, texts[0].upper()), (1001, "")]


@pytest.mark.parametrize("seed, size, percent, pairs", [(1, 4, 85, 2), (2, 4, 85, 0), (3, 5, 80, 0), (4, 5, 80, 2)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, size, percent, pairs):
    monkeypatch.setattr(group_join, "PAIRS_PER_ROW", pairs)
    rows = near_rows(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id LONG, text STRING, n INT").repartition(3)
    got = near_duplicates(docs, size, percent)
    want = near_by_hand(rows, size, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
    stays = drop_near_duplicates(docs, size, percent)
    assert stays.columns == docs.columns
    assert sorted(r.doc_id for r in stays.collect()) == sorted(i for i, n, c in want if i == c)


def test_a_big_group_of_near_copies(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(300):
        own = list(words)
        own[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert {r.component_id for r in near_duplicates(docs, 4, 80).collect()} == {0}


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text + " t1"), (None, None), (6, None)],
                                 "doc_id LONG, text STRING")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, 4, 85).collect()), key=str)
    assert got == sorted([(None, 27, 4), (4, 27, 4), (4, 27, 4), (9, 28, 4), (None, 0, None), (6, 0, 6)], key=str)
    assert sorted(str(r.doc_id) for r in drop_near_duplicates(docs, 4, 85).collect()) == ["4", "4", "6", "None"]


@pytest.mark.parametrize("links, want", [
    ([], {}), ([(5, 5)], {}), ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
    ([(9, 3), (3, 7), (1, 2), (2, 1)], {9: 3, 3: 3, 7: 3, 1: 1, 2: 1}),
    ([(i, i ^ 1) for i in range(20)] + [(i, i + 10) for i in range(0, 10, 2)],
     {i: min(i & ~1, (i & ~1) % 10) for i in range(20)})])
def test_components_of_links(spark, links, want):
    df = spark.createDataFrame(links, "a LONG, b LONG")
    assert {r.node: r.root for r in components(df).collect()} == want


def test_sets_ignore_case_of_ascii_only():
    assert (shingle_set("The END of É", 4) == shingle_set("the end of É", 4)).all()
    assert (shingle_set("a b", 4) != shingle_set("b a", 4)).all()
    assert len(shingle_set(" \n", 4)) == len(shingle_set(None, 4)) == 0


def test_near_misses_are_seldom_compared_in_full(spark, monkeypatch):
    rng = random.Random(4)
    words, counted, write = [f"v{i}" for i in range(60)], [], group_join.keep
    rows = []
    for i in range(300):
        own = list(words)
        own[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(own)))

    def keep(df, name, *more):
        kept = write(df, name, *more)
        if name == "pairs":
            counted.append(kept.count())
        return kept

    monkeypatch.setattr(group_join, "keep", keep)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, 4, 85).collect())
    assert got == near_by_hand(rows, 4, 85)
    assert sum(counted) < 10 * len(rows)  # of 44,850


@pytest.mark.parametrize("seed, size, percent, short", [(5, 4, 85, 0), (6, 4, 85, 2), (7, 5, 80, 100), (8, 1, 50, 2), (9, 2, 100, 8)])
def test_short_and_long_lists_give_the_same(spark, monkeypatch, seed, size, percent, short):
    monkeypatch.setattr(group_join, "SHORT", short)
    rows = near_rows(seed, bases=6)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    got = near_duplicates(docs, size, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_by_hand(rows, size, percent)


def test_rows_without_a_partner_leave_the_index(spark, monkeypatch):
    counted, write = [], group_join.keep

    def keep(df, name, *rest):
        kept = write(df, name, *rest)
        if name == "index":
            counted.append(kept.count())
        return kept

    monkeypatch.setattr(group_join, "keep", keep)
    passage = " ".join(f"p{i}" for i in range(30))  # in all texts, whose lengths are too different for a link
    rows = [(k, passage + " " + " ".join(f"d{k}w{i}" for i in range(30 * (3 ** k - 1)))) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert sorted(r.component_id for r in near_duplicates(docs, 4, 85).collect()) == [0, 1, 2, 3, 4]
    assert counted == [0]


def test_no_pair_is_compared_twice(spark, monkeypatch):
    compared, right = [], group_join._similar_pairs

    def similar_pairs(pairs, sets, percent):
        compared.extend((min(p.a, p.b), max(p.a, p.b)) for p in pairs.select("a", "b").collect())
        return right(pairs, sets, percent)

    monkeypatch.setattr(group_join, "_similar_pairs", similar_pairs)
    rows = []
    for k in range(5):  # two texts just below the threshold, and a third one above it
        words = [f"d{k}w{i}" for i in range(200)]
        near = words[:]
        near[50], near[100], near[150], near[199] = (f"d{k}x{i}" for i in range(4))
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join([*words, "end"]))]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = near_duplicates(docs, 4, 88).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_by_hand(rows, 4, 88)
    assert compared and len(compared) == len(set(compared))


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_no_similar_pair_leaves_the_index(spark, percent):
    rng = random.Random(percent)
    rows = []
    for token in range(150):
        for gid in range(rng.choice([1, 2, 2, 3, 5])):
            n = rng.choice([1, 2, 4, 17, 20, 100, 117, 118, 200, 400]) + rng.randint(0, 1)
            rows.append((token, 10 * token + gid, n, rng.randint(0, group_join.prefix_length(n, percent) - 1)))
    index = spark.createDataFrame(rows, "token LONG, gid LONG, n INT, pos INT")
    stays = {(r.token, r.gid) for r in group_join._met(index, percent).collect()}
    for t, g, n, pos in rows:
        partners = [(m, at) for u, h, m, at in rows if u == t and h != g and 100 * min(n, m) >= percent * max(n, m)
                    and group_join.similar(min(n - pos, m - at), n, m, percent)]
        assert not partners or (t, g) in stays
    assert len(stays) < len(rows)


def near_misses(groups=6):
    """Pairs with a passage of all texts, some words of their own, and ends that other texts have too: the first rare
    shingles are common ones, and bits miss part of the rest. Only the first pair is similar."""
    passage, rows = [f"p{i}" for i in range(340)], []
    for k in range(groups):
        both = [f"g{k}w{i}" for i in range(24)]
        ends = [[f"e{k}x{i}" for i in range(36)], [f"e{k}{'y' if k else 'x'}{i}" for i in range(36)]]
        ends[1][-1] += "z"
        rows += [" ".join(passage + both + end) for end in ends]
        rows += [" ".join(both[-3:] + end + [f"f{k}{s}{i}" for i in range(700)]) for s, end in enumerate(ends)]
    return list(enumerate(rows))


def test_whole_sets_travel_for_likely_pairs_alone(spark, monkeypatch):
    counted, write = [], group_join.keep

    def keep(df, name, *rest):
        kept = write(df, name, *rest)
        if name in ("pairs", "likely"):
            counted.append((name, kept.count()))
        return kept

    monkeypatch.setattr(group_join, "keep", keep)
    rows = near_misses()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id LONG, text STRING"), 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_by_hand(rows, 4, 85)
    pairs, likely = (sum(n for name, n in counted if name == kind) for kind in ("pairs", "likely"))
    assert 1 <= likely < pairs


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_fronts_miss_no_similar_pair(spark, percent):
    rng, rows = random.Random(percent), []
    counts = group_join.np.array([rng.randrange(5) for _ in range(group_join.BUCKETS)])
    for _ in range(150):
        low = 1 << rng.choice([8, 34, 63])  # small numbers share their upper halves
        both = {rng.randrange(low) for _ in range(rng.choice([3, 100, 900]))}
        n = rng.choice([0, len(both) // 12, len(both) // 6, len(both) // 3])
        sets = [group_join.np.array(sorted(both | {rng.randrange(low) for _ in range(n)}), "u8") for _ in range(2)]
        fronts = [group_join.front(group_join.rare_first(s, counts)).tolist() for s in sets]
        rows.append((len(sets[0]), len(sets[1]), len(set(sets[0].tolist()) & set(sets[1].tolist())), *fronts))
    pairs = spark.createDataFrame(rows, "n_a INT, n_b INT, both INT, of_a ARRAY<INT>, of_b ARRAY<INT>")
    found = pairs.select("n_a", "n_b", "both", group_join._likely(percent).alias("likely")).collect()
    alike = [group_join.similar(r.both, r.n_a, r.n_b, percent) for r in found]
    assert any(alike) and all(r.likely for r, same in zip(found, alike) if same)
    assert percent < 80 or not all(r.likely for r in found)


def test_what_rounds_compared_is_joined_once(spark, monkeypatch):
    """A crowd of near misses takes several rounds; their pairs leave by one join, before groups are expanded."""
    joined, rng = [], random.Random(11)
    words = [f"v{i}" for i in range(90)]
    rows = []
    for i in range(60):
        own = words[:]
        for at in rng.sample(range(90), rng.randint(1, 3)):
            own[at] = f"x{i}a{at}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    monkeypatch.setattr(group_join, "PAIRS_PER_ROW", 0)
    kind = type(docs)
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None, f=kind.join: joined.append((on, how)) or f(
        self, other, on, how))
    got = near_duplicates(docs, 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_by_hand(rows, 4, 85)
    assert sum(how == "left_anti" and on in (["a", "b"], ["gid_a", "gid_b"]) for on, how in joined) <= 2
