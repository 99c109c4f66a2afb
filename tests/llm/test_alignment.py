"""Token alignment against plain counting, and its runs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quotelake.llm import spill_runs, token_alignment
from quotelake.llm.chunked import byte_alphabet
from quotelake.llm.spill_runs import RunCounter, merge, pack, pack_sorted, unpack, unpack_sorted
from quotelake.llm.token_alignment import align_tokenizers, cut_chunks, pair_counts
from test_tokens import odd_texts

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id LONG, text STRING, radix STRING, run LONG"
ODD = ["", None, " ", "  ", "\n", "\n\n", " \n x", "a\n b", "a \n", "foo ", "▁", "x▁y z", "x ▁", "<s> </s> <unk>", "<|endoftext|> x",
       "tab\there", "nbsp\xa0here", "　wide", "a\x00b", "ﬁ①", "é", "👩‍🚀 hi", "a" * 500, "word " * 300, "é" * 200]


def by_hand(texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, sha) in order, and the counts of pairs."""
    tok, sp, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    tok.encode_special_tokens = True
    seen, counts = [], Counter()
    for text in texts:
        if not text:
            seen.append(None)
            continue
        ids_a = tok.encode(" " + text, add_special_tokens=False).ids
        ids_b = sp.encode(text)
        of_a = [bytes(letters[c] for c in tok.id_to_token(i)) for i in ids_a]
        of_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i)
                else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            seen.append(None)
            continue

        def spans(parts):
            end, out = 0, []
            for p in parts:
                out.append((end, end + len(p)))
                end += len(p)
            return out

        at_a, at_b = spans(of_a), spans(of_b)
        cover = defaultdict(list)
        for j, (x, y) in enumerate(at_b):
            for k in range(x, y):
                cover[k].append(j)
        links = [(ids_b[j], ids_a[i]) for i, (x, y) in enumerate(at_a) for j in sorted({j for k in range(x, y) for j in cover[k]})]
        cuts = sorted({y for _, y in at_a} & {y for _, y in at_b})
        groups, low = [], 0
        for high in cuts:
            groups.append(",".join(str(i) for i, (x, _) in zip(ids_a, at_a) if low <= x < high) + "|"
                          + ",".join(str(i) for i, (x, _) in zip(ids_b, at_b) if low <= x < high))
            low = high
        counts.update(links)
        seen.append((ids_a, ids_b, groups, links))
    top = defaultdict(int)
    for (b, _), n in counts.items():
        top[b] = max(top[b], n)
    rows = []
    for one in seen:
        if one is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = one
            rows.append((len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[0]] for x in links),
                         sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows, counts, top


def answers(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                        "groups_sha256")) for r in df.collect()), key=str)


@pytest.mark.parametrize("buffer", [500, 3_000_000])
def test_counts_by_hand(spark, monkeypatch, buffer):
    monkeypatch.setattr(token_alignment, "BUFFER", buffer)
    texts = ODD + odd_texts()[::9] + ["the same row", "the same row"]
    rows, counts, top = by_hand(texts)
    ids = [None, 1, 1, *range(3, len(texts))]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in zip(ids, texts)], SCHEMA).repartition(3)
    assert answers(align_tokenizers(docs, A, B)) == sorted(((i, *r) for i, r in zip(ids, rows)), key=str)
    if buffer == 500:
        got = {(r.b, r.a): (r.n_links, r.is_best) for r in pair_counts(docs, A, B).collect()}
        assert got == {x: (n, n == top[x[0]]) for x, n in counts.items()}


def test_given_documents_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, _, _ = by_hand([t for _, t in rows])
    assert answers(align_tokenizers(docs, A, B)) == sorted(((i, *r) for (i, _), r in zip(rows, want)), key=str)


def test_empty_table(spark):
    assert align_tokenizers(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_chunks_join_and_memo_forgets(monkeypatch):
    monkeypatch.setattr(token_alignment, "MEMO", 20)
    aligner = token_alignment.Aligner(A, B)
    texts = [t for t in odd_texts()[:400] if t]
    assert all("".join(cut_chunks(" " + t)) == " " + t for t in texts)
    for k in range(0, 400, 40):
        part = texts[k:k + 40]
        assert list(aligner.documents(part)) == [aligner.whole(t) for t in part]
    long = "verylong" * 200_000
    assert next(aligner.documents([long])) == aligner.whole(long)


def test_runs(monkeypatch):
    monkeypatch.setattr(spill_runs, "FRAME", 7)
    monkeypatch.setattr(spill_runs, "FAN_IN", 3)
    rng, counter, want, runs = random.Random(1), RunCounter(), Counter(), []
    for _ in range(40):
        own = Counter({rng.randrange(200) + (1 << 40): rng.randrange(1, 9) for _ in range(rng.randrange(30))})
        codes = np.array(sorted(own), np.uint64)
        run = pack_sorted([(codes, np.array([own[int(c)] for c in codes], np.uint64))])
        assert [int(c) for f, _ in unpack_sorted(run) for c in f] == sorted(own)
        counter.add(run)
        runs.append(run)
        want += own
    for codes, sums in (counter.totals(), tuple(np.concatenate(c) for c in zip(*merge([unpack_sorted(r) for r in runs])))):
        assert dict(zip(codes.tolist(), sums.tolist())) == want and (np.diff(codes.astype(np.int64)) > 0).all()
    assert RunCounter().totals()[0].tolist() == []
    columns = [np.arange(20), np.arange(20)[::-1]]
    assert [np.concatenate(c).tolist() for c in zip(*unpack(pack(columns), 2))] == [c.tolist() for c in columns]
