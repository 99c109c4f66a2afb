"""The stages against plain Python on small tables, and rows of every odd kind."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quotelake.llm.line_rules import measure
from quotelake.llm.pseudonyms import Pseudonyms
from test_copies import fold, near_by_hand

PROSE = "The river runs past the old mill and turns north, where nobody has built a house for many long years near {}."


def by_hand(rows):
    """Rows (doc_id, text) with distinct ids, through all stages but the last."""
    rows = [(i, t) for i, t in rows if measure(t or "")[-1]]
    last = {}
    for i, t in rows:
        last[fold(t)] = max(i, last.get(fold(t), i))
    rows = [(i, t) for i, t in rows if last[fold(t)] == i]
    rows = [(i, t) for (i, t) in rows if (i, i) in {(a, c) for a, _, c in near_by_hand(rows, 5, 80)}]
    names = Pseudonyms(corpus_pipeline.KEY)
    return [(i, names.mask(t)[0]) for i, t in rows]


def test_all_stages_by_hand(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in source.collect()]
    want = dict(by_hand(rows))
    docs = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.schema
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before.names
    assert {r.doc_id: r.text for r in docs.collect()} == want
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    sizes = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass_all_stages(spark, empty):
    text, other = PROSE.format("here"), "A wholly different report tells of nine small boats that left the harbour before dawn, "\
        "carried salt and timber to islands nobody else had mapped, and came home in autumn; write to {}."
    rng = random.Random(4)
    long = ". ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(9)) for _ in range(900)) + "."
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, other.format("a@b.example.com")), (5, long), (6, long + " Again.")]
    extra = spark.createDataFrame([] if empty else [(i, t, None, "s", 5, "x", "y", "z") for i, t in [*rows, (None, text + " Again.")]],
                                  "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, sequence_id STRING, "
                                  "_stays STRING, _gone STRING")
    from quotelake.llm.tables import keep

    docs = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, ""), name)
        assert docs.columns == extra.columns
    kept = docs.collect()
    want = {} if empty else dict(by_hand(rows[1:]))
    assert {r.doc_id: r.text for r in kept} == want and set(want) == (set() if empty else {1, 4, 5})
    assert {(r._stays, r._gone, r.sequence_id) for r in kept} <= {("y", "z", "x")}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in out} == set(want)


def test_stage_names_and_entry():
    import __spark_entry__ as entry

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "pii", "best_fit_packing"]
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
