"""Encoding, counting and decoding against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quotelake.llm.bpe_stream import Decoder, MergeList, StreamCodec, Transducer, byte_alphabet, encode_word
from quotelake.llm.chunked import ChunkEncoder, chunks
from quotelake.llm.token_counts import TokenCounter, symbols_left, token_counts
from quotelake.llm.token_store import read_token_store, token_digests, write_token_store

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
LETTERS = " \t\n\r\x85\xa0　\x1c\x1f'sdtrevml0129,.!?<>|/weéÉñßİσΣ́你好😀‍\x00ABCxyz"


def odd_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("aeiothns'") for _ in range(rng.randint(0, 90))) for _ in range(600)]
    return texts + [
        "", " ", "\n\n a\n", "  a", "a  ", "<|endoftext|>", "a <|endoftext|> b<|startoftext|>c", "<|ENDOFTEXT|>",
        "a" * 3000, "ab" * 2000, "é" * 400, "e</w>", "</w></w>", "it's we'll I'D", "x" * 70 + " " + "y" * 200]


def test_chunks_join_to_the_text():
    for text in odd_texts():
        assert "".join(chunks(text)) == text


def test_chunked_encoding_is_the_librarys():
    texts = odd_texts()
    want = [e.ids for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ChunkEncoder(BYTE).encode(texts)] == want
    assert TokenCounter(BYTE).count(texts) == [len(x) for x in want]


def test_memo_forgets_without_changing_results():
    small, big = ChunkEncoder(BYTE), ChunkEncoder(BYTE)
    small.memo.size = 5
    texts = odd_texts()[:200]
    assert [small.encode([t])[0] for t in texts] == big.encode(texts)


def test_heap_merges_the_lowest_rank_first():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2}
    assert symbols_left(list("abc"), ranks) == 1
    assert symbols_left(list("aab"), {("a", "a"): 0}) == 2
    assert symbols_left([], ranks) == 0


def test_transducer_is_the_librarys():
    texts = odd_texts()
    tokenizer, codec = Tokenizer.from_file(WORD), StreamCodec(WORD)
    for text, (ids, decoded) in zip(texts, codec.round_trip(texts)):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), text
        assert decoded == tokenizer.decode(want, skip_special_tokens=False)


def test_transducer_keeps_a_short_buffer_and_emits_before_the_end():
    codec = StreamCodec(WORD)
    machine, word, most, early = Transducer(codec.merges), "ab" * 4000, 0, []
    for i, c in enumerate(word):
        out = machine.push(c, i == len(word) - 1)
        most = max(most, len(machine.text))
        early += out
        if i == len(word) // 2:
            assert early
    assert most < 6 * codec.merges.lookahead
    assert [codec.merges.vocab[t] for t in early] == encode_word(word, codec.merges)


def test_merges_out_of_training_order_are_refused():
    with pytest.raises(ValueError, match="training order"):
        MergeList({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")])


def test_decoder_waits_for_whole_characters():
    stand_in = {b: c for c, b in byte_alphabet().items()}
    names = {i: stand_in[b] for i, b in enumerate("é😀".encode())}
    machine = Decoder(names, byte_alphabet())
    assert [machine.push(i) for i in range(6)] == ["", "é", "", "", "", "😀"]
    assert machine.push(0) == "" and machine.end() == "�"


def test_store_reads_back_what_was_written(spark, tmp_path):
    rows = [(3, "three  words\n"), (1, None), (2, ""), (None, "no id"), (7, "x" * 5000), (3, "three again"), (9, "é 你好")]
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id LONG, text STRING, n_tokens INT, block STRING")
    path = str(tmp_path / "store")
    write_token_store(docs, path, BYTE)
    stored = read_token_store(spark, path)
    tokenizer = Tokenizer.from_file(BYTE)
    want = {(i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows}
    assert {(r.doc_id, tuple(r.ids)) for r in stored.collect()} == want
    digests = sorted(token_digests(stored).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in digests]
    assert ids == [None, 1, 2, 3, 3, 7, 9]
    at = 0
    for r in digests:
        assert r.start == at
        at += r.n_tokens
    crc = {zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in want}
    assert {r.ids_crc32 for r in digests} == crc


def test_store_is_indexed_and_pruned(spark, tmp_path):
    from pyarrow import orc

    path = str(tmp_path / "store")
    write_token_store(spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text"), path, BYTE)
    files = sorted(tmp_path.glob("store/*.orc"))
    spans = []
    for f in files:
        ids = orc.ORCFile(str(f)).read(columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids)
        spans.append((ids[0], ids[-1]))
        assert b"" != f.read_bytes()
    assert all(a[1] < b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))
    some = read_token_store(spark, path, [17, 3999, 12345])
    assert sorted(r.doc_id for r in some.collect()) == [17, 3999]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan
    jvm = spark._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration()
    reader = jvm.org.apache.orc.OrcFile.createReader(
        jvm.org.apache.hadoop.fs.Path(str(files[0])), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    kinds = {s.getKind().toString() for s in reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds


def test_counts_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (1, "", "x"), (None, "é", "x"), (2, "a " * 600, "x")], "doc_id LONG, text STRING, n_bytes STRING")
    got = {(r.doc_id, r.n_bytes, r.over_limit) for r in token_counts(docs, BYTE).collect()}
    assert got == {(1, 0, False), (None, 2, False), (2, 1200, True)}
