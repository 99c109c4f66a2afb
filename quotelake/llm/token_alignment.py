"""Which tokens of two tokenizers cover the same bytes, and how often each pair does over the corpus.

Texts are encoded chunk by chunk (chunks begin at a blank or line end behind a character that is none; both
tokenizers always have a border there). Two tokens are linked when their bytes overlap. Each task collects links in a
buffer, sorts them by (side B, side A, document), deals them by radix of the B token, and writes per radix a zstd run
of pairs with their counts; the documents behind the pairs stay with the task's rows. A radix merges its runs by a
heap, sees each B token's pairs side by side and so its maximum, and streams to every run the totals of the run's own
pairs. These meet the documents of the run again, which add them up.
"""

from __future__ import annotations

import array
import hashlib
import os
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.chunked import MEMO_CHARS, SPACES, byte_alphabet, slices
from quotelake.llm.spill_runs import RunCounter, pack, pack_sorted, unpack, unpack_sorted
from quotelake.llm.tables import keep, per_worker

BUFFER = 3_000_000  # links a task holds before it writes runs
RADIXES = 64  # parts of the B vocabulary; a radix holds the totals of its own pairs
DOC_BITS = 16  # documents of a buffer, at most
SIDE_BITS = 20  # of a B token within its radix
MEMO = 400_000  # chunks of one generation of the memo
_CUT = re.compile(f"(?<=[^{SPACES}])(?=[ \n])")
_BLANK = "▁"


def cut_chunks(text: str) -> list[str]:
    """A text that starts with a blank, cut at blanks and line ends that follow other characters."""
    words = text.split()
    if text.count(" ") + text.count("\n") == len(words) == len(text) - sum(map(len, words)) and "\0" not in text:
        # one blank or line end in front of every word, the common case
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]
    return _CUT.split(text)


class Aligner:
    """Links of chunks, remembered. `entry` is (tokens of A, tokens of B, groups, links, groups as text)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_alphabet()
        self.a_bytes = [self._a_bytes(self.a.id_to_token(i) or "", letters) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.bits, self.side = max(len(self.a_bytes) - 1, 1).bit_length(), SIDE_BITS
        if self.bits > 20 or len(pieces) > RADIXES << SIDE_BITS:
            raise ValueError("vocabularies of more than a million tokens don't fit into the codes of pairs")
        self.blank = self.b.piece_to_id(_BLANK)
        self.free = all(_BLANK not in p.lstrip(_BLANK) and "\n" not in p for p in pieces)
        self.young, self.old = {}, {}

    @staticmethod
    def _a_bytes(token, letters):
        return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def align(self, ids_a, ids_b, text: str):
        """The entry of one stretch of text, or None where the bytes of a side are not the text."""
        raw = text.encode()
        bytes_a, bytes_b = [self.a_bytes[i] for i in ids_a], [self.b_bytes[i] for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return None
        links, groups, i, j, bits = array.array("q"), [], 0, 0, self.bits
        end_a, end_b, first_a, first_b = len(bytes_a[0]), len(bytes_b[0]), 0, 0
        while True:
            links.append(ids_b[j] << bits | ids_a[i])
            if end_a == end_b:
                i, j = i + 1, j + 1
                groups.append(",".join(map(str, ids_a[first_a:i])) + "|" + ",".join(map(str, ids_b[first_b:j])))
                first_a, first_b = i, j
                if i == len(ids_a):
                    break
                end_a, end_b = end_a + len(bytes_a[i]), end_b + len(bytes_b[j])
            elif end_a < end_b:
                i += 1
                end_a += len(bytes_a[i])
            else:
                j += 1
                end_b += len(bytes_b[j])
        return len(ids_a), len(ids_b), len(groups), links.tobytes(), ";".join(groups)

    def _encode_b(self, found: list[str]):
        """Ids of chunks: the library puts a blank in front, which stands for a chunk's own where it has one."""
        ids = self.b.encode([c[1:] if c[0] == " " else c for c in found], num_threads=1)
        return [[self.blank] if c == " " else x if c[0] == " " else x[1:] for c, x in zip(found, ids)]

    def learn(self, texts_of_chunks):
        """Entries of all chunks of some texts; what was asked for lately stays remembered."""
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        seen = set().union(*texts_of_chunks) if texts_of_chunks else set()
        here = {c: self.old[c] for c in seen if c in self.old and c not in self.young}
        self.young.update(here)
        missing = [c for c in seen if c not in self.young]
        fresh = {}
        if missing:
            in_a = self.a.encode_batch_fast(missing, add_special_tokens=False)
            for c, x, y in zip(missing, in_a, self._encode_b(missing)):
                fresh[c] = self.align(x.ids, y, c)
        self.young.update((c, e) for c, e in fresh.items() if len(c) <= MEMO_CHARS)
        return fresh

    def whole(self, text: str):
        return self.align(self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), " " + text)

    def documents(self, texts: list):
        """Per text: (tokens of A, of B, groups, links as bytes, groups as text), or None for no tokens."""
        cut = [cut_chunks(" " + t) if t and self.free else [] for t in texts]
        fresh = self.learn(cut)
        get = self.young.get
        for text, own in zip(texts, cut):
            entries = [get(c) or fresh.get(c) for c in own]
            if text and (not entries or None in entries):
                yield self.whole(text)
            elif not entries:
                yield None
            else:
                a, b, groups, links, told = zip(*entries)
                yield sum(a), sum(b), sum(groups), b"".join(links), ";".join(told)


BODY = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
RUNS = ("run BIGINT, radix INT, pairs BINARY, " + ", ".join(f"{c} ARRAY<BIGINT>" for c in BODY)
        + ", groups_sha256 ARRAY<STRING>, behind ARRAY<BINARY>")


def _radix_code(b, a, bits: int, side: int):
    """(radix of B, the rest of B, A) as one number: ascending codes are side-major within a radix."""
    return ((b % RADIXES) << side | b // RADIXES) << bits | a


def _write_run(run: int, aligner: Aligner, rows: list) -> pa.RecordBatch:
    """Rows of one buffer: per radix the pairs with their counts, and one row with the documents behind them."""
    sizes = np.array([len(r[5]) // 8 for r in rows], np.int64)
    link = np.frombuffer(b"".join(r[5] for r in rows), "<i8")
    code = _radix_code(link >> aligner.bits, link & ((1 << aligner.bits) - 1), aligner.bits, aligner.side)
    key = np.sort(code << DOC_BITS | np.repeat(np.arange(len(rows)), sizes))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(key)))  # of a pair in a document
    key = key[at]
    pair = key >> DOC_BITS
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    codes, totals = pair[first], np.add.reduceat(times, first) if len(first) else first
    edges = np.searchsorted(codes >> (aligner.side + aligner.bits), np.arange(RADIXES + 1))
    radixes = [r for r in range(RADIXES) if edges[r] < edges[r + 1]]
    pairs = [pack_sorted([(codes[edges[r]:edges[r + 1]], totals[edges[r]:edges[r + 1]])]) for r in radixes]
    behind = [pack([np.diff(np.append(first, len(pair)))]), pack([key & ((1 << DOC_BITS) - 1), times])]
    n = len(radixes)
    columns = [pa.array([None] * n + [list(c)], pa.list_(pa.int64())) for c in list(zip(*rows))[:5]]
    return pa.RecordBatch.from_arrays(
        [pa.array([run] * (n + 1), pa.int64()), pa.array([*radixes, -1], pa.int32()), pa.array([*pairs, None], pa.binary()),
         *columns, pa.array([None] * n + [[r[6] for r in rows]], pa.list_(pa.string())),
         pa.array([None] * n + [behind], pa.list_(pa.binary()))],
        ["run", "radix", "pairs", *BODY, "groups_sha256", "behind"])


def _aligner(path_a: str, path_b: str) -> Aligner:
    return per_worker(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


def write_runs(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Runs of pairs by radix and, with radix -1, the documents of each run. Texts are encoded once."""

    def write(batches):
        aligner, run, rows, held = _aligner(path_a, path_b), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(text):
                for doc_id, entry in zip(ids[a:b], aligner.documents(text[a:b])):
                    if entry is None:
                        rows.append((doc_id, 0, 0, 0, 0, b"", ""))
                    else:
                        n_a, n_b, groups, links, told = entry
                        rows.append((doc_id, n_a, n_b, groups, len(links) // 8, links,
                                     hashlib.sha256(told.encode()).hexdigest()))
                        held += len(links) // 8
                    if held >= BUFFER or len(rows) == 1 << DOC_BITS:
                        yield _write_run(run, aligner, rows)
                        run, rows, held = run + 1, [], 0
        if rows:
            yield _write_run(run, aligner, rows)

    return texts.mapInArrow(write, RUNS)


def _grouped(batches, key: int):
    """Rows of Arrow batches, one by one, with a sign of whether the key column has changed."""
    last = object()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield row, row[key] != last
            last = row[key]


def _best(codes: np.ndarray, totals: np.ndarray, bits: int) -> np.ndarray:
    """Whether a pair's total is the highest of its B token. Codes lie side by side for each B token."""
    if not len(codes):
        return np.zeros(0, bool)
    side = codes >> np.uint64(bits)
    at = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
    return totals == np.repeat(np.maximum.reduceat(totals, at), np.diff(np.append(at, len(codes))))


def radix_totals(runs: DataFrame, bits: int, use, schema: str) -> DataFrame:
    """Count the pairs of each radix by merging its runs, then let `use` see the totals.

    `use(radix, codes, totals, best, runs)` yields record batches; `runs` gives (run, its pairs) again, from a
    file of the task that goes with it. A run holds a pair once, however many documents it has, so no B token is too
    frequent; in memory are a few runs and the totals of one radix.
    """
    dealt = runs.where("radix >= 0").select("radix", "run", "pairs").repartition("radix").sortWithinPartitions("radix")

    def count(batches):
        def finish():
            codes, totals = counter.totals()
            spill.seek(0)
            yield from use(radix, codes, totals, _best(codes, totals, bits), replay())

        def replay():
            while head := spill.read(16):
                run, size = np.frombuffer(head, "<i8").tolist()
                yield run, spill.read(size)

        counter = spill = radix = None
        for row, fresh in _grouped(batches, 0):
            if fresh:
                if counter:
                    yield from finish()
                    spill.close()
                counter, spill, radix = RunCounter(), tempfile.TemporaryFile(), row[0]
            counter.add(row[2])
            spill.write(np.array([row[1], len(row[2])], "<i8").tobytes() + row[2])
        if counter:
            yield from finish()
            spill.close()

    return dealt.mapInArrow(count, schema)


def _answers(radix, codes, totals, best, runs):
    """For each run the totals of its own pairs, in their order."""
    for run, pairs in runs:
        own = np.concatenate([c for c, _ in unpack_sorted(pairs)])
        at = np.searchsorted(codes, own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([run], pa.int64()), pa.array([radix], pa.int32()),
             pa.array([pack([totals[at], best[at]])], pa.binary())], ["run", "radix", "answer"])


def _sum_up(joined: DataFrame) -> DataFrame:
    def add(batches):
        for row, _ in _grouped(batches, 0):
            lists, shas, behind, answers = row[1:6], row[6], row[7], row[8]
            n = len(shas)
            best_links, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if answers:
                parts = [f for _, answer in sorted((x["radix"], x["answer"]) for x in answers) for f in unpack(answer, 2)]
                totals, best = (np.concatenate(c) for c in zip(*parts))
                docs_of_pair = np.concatenate([f[0] for f in unpack(behind[0], 1)]).astype(np.int64)
                ends, done = np.cumsum(docs_of_pair), 0
                for doc, times in unpack(behind[1], 2):
                    pair = np.searchsorted(ends, np.arange(done, done + len(doc)), "right")
                    done += len(doc)
                    doc, times = doc.astype(np.int64), times.astype(np.int64)
                    np.add.at(count_sum, doc, times * totals[pair].astype(np.int64))
                    np.add.at(best_links, doc, times * best[pair].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in lists), pa.array(best_links), pa.array(count_sum),
                 pa.array(shas, pa.string())], [*BODY, "n_best", "count_sum", "groups_sha256"])

    return joined.mapInArrow(add, ", ".join(f"{c} BIGINT" for c in [*BODY, "n_best", "count_sum"]) + ", groups_sha256 STRING")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Side A is a byte-level file of the tokenizers library, side B a sentencepiece model; both read a blank and the text,
    without special tokens. A text that is null or empty, or whose tokens of either side don't spell it, has no
    tokens: zeros and an empty string. Null and repeated ids are returned as they come, repeated rows each count
    in the corpus; other columns are ignored; an empty table gives no rows.
    """
    bits = _sizes(path_a, path_b)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    runs = keep(write_runs(texts, path_a, path_b), "alignment-runs")
    answers = radix_totals(runs, bits, _answers, "run BIGINT, radix INT, answer BINARY").groupBy("run").agg(
        F.collect_list(F.struct("radix", "answer")).alias("answers"))  # one of each radix
    bodies = runs.where("radix < 0").select("run", *BODY, "groups_sha256", "behind")
    return _sum_up(bodies.join(answers, "run", "left"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(b, a, n_links, is_best): how many links of the corpus hold each pair of ids; the highest of each B id is marked.

    Rows, nulls and ties as in `align_tokenizers`; ties are all marked.
    """
    bits = _sizes(path_a, path_b)

    def tell(radix, codes, totals, best, runs):
        b, a = codes >> np.uint64(bits), codes & np.uint64((1 << bits) - 1)
        for at in range(0, len(codes), 100_000):
            part = slice(at, at + 100_000)
            high = b[part].astype(np.int64) & ((1 << SIDE_BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(high * RADIXES + radix), pa.array(a[part].astype(np.int64)),
                 pa.array(totals[part].astype(np.int64)), pa.array(best[part])], ["b", "a", "n_links", "is_best"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    runs = keep(write_runs(texts, path_a, path_b), "alignment-runs")
    return radix_totals(runs, bits, tell, "b BIGINT, a BIGINT, n_links BIGINT, is_best BOOLEAN")


def _sizes(path_a: str, path_b: str) -> int:
    """Bits of the A side, as the workers' aligners have them."""
    return Aligner(path_a, path_b).bits
