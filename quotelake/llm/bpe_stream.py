"""Byte-pair encoding as a streaming transducer, and decoding as a byte-to-text state machine.

Two facts carry the encoder. A sequence of tokens is the encoding of a string
exactly if every two neighbours encode to themselves: the first merge across any
border would also happen between these two alone. So the last token of every
prefix is fixed by the token before it. And whatever symbols follow, the token
over the next one starts within the longest token's reach. Where the chains of
tokens from all borders in reach have met, the tokens before are stable and leave the
buffer.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.chunked import MEMO_CHARS, SPACES, Memo, byte_alphabet, in_byte_alphabet, latin_word, slices
from quotelake.llm.tables import per_worker

PAIRS = 500_000  # verdicts on neighbouring tokens that a worker remembers
LETTERS = 300_000  # pieces that a worker remembers


class MergeList:
    """Vocabulary and merges, with the lookahead that suffices for them.

    `end` is the suffix that the last symbol of a word carries (empty: none).
    Merges must be in training order: both parts of a merge are single symbols or made by
    earlier merges. Then a token's own merges happen by rank, and whether two
    neighbours stay apart can be read off the symbols at their common border.
    """

    def __init__(self, vocab: dict[str, int], merges, end: str = ""):
        self.vocab, self.end = vocab, end
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.lookahead = max((self.symbols(t) for t in vocab), default=1)
        made = set()
        for a, b in self.ranks:
            if any(self.symbols(x) > 1 and x not in made for x in (a, b)):
                raise ValueError("merges are not in training order")
            made.add(a + b)
        self.left_edges, self.right_edges, self.verdicts = {}, {}, {}
        self.names = {i: t for t, i in vocab.items()} | {-1: ""}
        self.final_vocab = {t.removesuffix(end): i for t, i in vocab.items() if t.endswith(end)} if end else vocab

    def verdict(self, key) -> bool:
        """`neighbours` by ids, remembered up to a bound."""
        if len(self.verdicts) >= PAIRS:
            self.verdicts.clear()
        found = self.verdicts[key] = self.neighbours(self.names[key[0]], self.names[key[1]], key[2])
        return found

    def symbols(self, token: str) -> int:
        return len(token) - (len(self.end) if self.end and token.endswith(self.end) else 0)

    def merged(self, symbols: list[str]) -> list[list[str]]:
        """Plain merging of a short run, lowest rank first and leftmost first; all states on the way."""
        states = [list(symbols)]
        while len(states[-1]) > 1:
            last = states[-1]
            rank, i = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(last, last[1:])))
            if rank == len(self.ranks):
                break
            states.append([*last[:i], last[i] + last[i + 1], *last[i + 2:]])
        return states

    def edges(self, token: str, final: bool):
        """(symbol, rank of the merge that takes it up) along the left and the right border; None for no token."""
        symbols = list(token)
        if final and self.end:
            symbols = list(token.removesuffix(self.end))
            symbols[-1] += self.end
        states = self.merged(symbols)
        if states[-1] != [token]:
            return None, None
        sides = []
        for at, mate in ((0, 1), (-1, -2)):
            side = []
            for s, t in zip(states, states[1:]):
                if s[at] != t[at]:
                    pair = (s[at], s[mate]) if at == 0 else (s[mate], s[at])
                    side.append((s[at], self.ranks[pair]))
            sides.append([*side, (token, len(self.ranks))])
        return sides

    def left_edge(self, token: str, final: bool):
        key = token, final
        if key not in self.left_edges:
            self.left_edges[key], self.right_edges[key] = self.edges(token, final)
        return self.left_edges[key]

    def neighbours(self, left: str, right: str, final: bool) -> bool:
        """Whether `left` and `right` stay as they are side by side (`left` empty: at the start of a word).

        A pair across the border merges if it ranks before what takes up its left symbol, and not after what takes
        up its right symbol (of two equal pairs the left one goes first).
        """
        edge = self.left_edge(right, final)
        if edge is None or not left:
            return edge is not None
        get = self.ranks.get
        for x, x_until in self.right_edges[left, False]:
            for y, y_until in edge:
                r = get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True


class Transducer:
    """Feed the symbols of one word; tokens come out as soon as no continuation can change them."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.text, self.tokens, self.starts = "", [""], [0]  # by border: the token that ends there, and its start

    def push(self, symbol: str, final: bool = False) -> list[str]:
        m = self.merges
        self.text += symbol
        i = len(self.text)
        vocab, tokens, suffix = m.vocab, self.tokens, m.end if final else ""
        for start in range(max(0, i - m.lookahead), i):
            token = self.text[start:i] + suffix
            if token in vocab and m.neighbours(tokens[start], token, final):
                self.tokens.append(token)
                self.starts.append(start)
                break
        else:
            raise ValueError(f"no token ends at {symbol!r}")
        if final:
            return self._leave(i)
        return self._leave(self._met(i)) if i >= 2 * m.lookahead else []

    def _met(self, i: int) -> int:
        """The border that the chains from all borders in reach have in common."""
        borders = set(range(max(0, i - self.merges.lookahead + 1), i + 1))
        while len(borders) > 1:
            last = max(borders)
            borders.remove(last)
            borders.add(self.starts[last])
        return borders.pop()

    def _leave(self, border: int) -> list[str]:
        out, at = [], border
        while at:
            out.append(self.tokens[at])
            at = self.starts[at]
        if border:
            self.text = self.text[border:]
            self.tokens = self.tokens[border:]
            self.starts = [max(0, s - border) for s in self.starts[border:]]
        return out[::-1]


def encode_word(symbols: str, merges: MergeList) -> list[int]:
    """The ids of one piece given in the byte alphabet.

    A piece within the first two reaches leaves nothing before its end, so it goes without the buffer.
    """
    last, vocab = len(symbols) - 1, merges.vocab
    if last >= 2 * merges.lookahead:
        machine = Transducer(merges)
        return [vocab[t] for i, s in enumerate(symbols) for t in machine.push(s, i == last)]
    reach, verdict, known = merges.lookahead, merges.verdict, merges.verdicts
    ids, starts = [-1], [0]  # by border: the token that ends there, and its start
    for i in range(1, last + 2):
        final = i > last
        table = merges.final_vocab if final else vocab
        for start in range(0 if i <= reach else i - reach, i):
            token = table.get(symbols[start:i])
            if token is not None:
                key = (ids[start], token, final)
                fits = known.get(key)
                if verdict(key) if fits is None else fits:
                    ids.append(token)
                    starts.append(start)
                    break
        else:
            raise ValueError(f"no token ends at {symbols[i - 1]!r}")
    out, at = [], last + 1
    while at:
        out.append(ids[at])
        at = starts[at]
    return out[::-1]


class Decoder:
    """Ids to text one at a time. `bytes_of` maps the byte alphabet; without it tokens are joined by blanks."""

    def __init__(self, names: dict[int, str], bytes_of: dict[str, int] | None = None):
        self.names, self.bytes_of, self.started = names, bytes_of, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, token: int) -> str:
        name = self.names[token]
        if self.bytes_of is None:
            blank, self.started = " " * self.started, True
            return blank + name
        if any(c not in self.bytes_of for c in name):  # an added token is text, not bytes
            return self.utf8.decode(b"", True) + name
        return self.utf8.decode(bytes(self.bytes_of[c] for c in name))

    def end(self) -> str:
        return self.utf8.decode(b"", True)


class StreamCodec:
    """Encoding and decoding of a merge file whose pieces never hold white space.

    The library's normalizer and pre-tokenizer cut a word into pieces; merging and
    decoding are done here. Words are remembered up to a bound.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        tokenizer = Tokenizer.from_file(path)
        self.normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.lower = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        model = spec["model"]
        self.merges = MergeList(
            model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
            model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(
            re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.names = {i: t for t, i in (model["vocab"] | self.added).items()}
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no decoder for {kind}")
        self.bytes_of = byte_alphabet() if kind else None
        self.spaced = re.compile(f"[^{SPACES}]+")
        self.letters: dict[str, list[int]] = {}
        self.memo = Memo(self._word)

    def _word(self, word: str):
        ids = [i for piece in self._pieces(word) for i in self._piece(piece)]
        return " ".join(map(str, ids)), self.decode(ids)

    def _piece(self, piece: str) -> list[int]:
        """Words that differ in case or marks share their letters, so these are remembered too."""
        found = self.letters.get(piece)
        if found is None:
            if len(self.letters) >= LETTERS:
                self.letters.clear()
            found = encode_word(piece, self.merges)
            if len(piece) <= MEMO_CHARS:
                self.letters[piece] = found
        return found

    def _pieces(self, word: str) -> list[str]:
        plain = latin_word(word) if self.lower else None
        if plain is None:
            return [p for p, _ in self.cut(self.normalize(word)) if p]
        return [p for p in (in_byte_alphabet(plain[0].lower()), plain[1]) if p]

    def words(self, text: str) -> list[str]:
        return self.spaced.findall(text) if re.search("[\x1c-\x1f]", text) else text.split()

    def decode(self, ids) -> str:
        machine = Decoder(self.names, self.bytes_of)
        return "".join(map(machine.push, ids)) + machine.end()

    def round_trip(self, texts: list[str]) -> list[tuple[str, str]]:
        """Per text its ids in decimal, joined by blanks, and what they decode to."""
        get, out = self.memo.__getitem__, []
        for text in texts:
            found = []
            for k, part in enumerate(self.special.split(text) if self.special else [text]):
                found += [(str(self.added[part]), part)] if k % 2 else map(get, self.words(part))
            found = [f for f in found if f[0]]
            ids = " ".join([f[0] for f in found])
            out.append((ids, " ".join([f[1] for f in found]) if self.bytes_of is None
                        else self.decode(map(int, ids.split()))))
        return out


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded whole text.

    A null text counts as empty; null and repeated ids are returned as they come, other
    columns are ignored, an empty table gives no rows. One pass, no shuffle.
    """

    def digest(batches):
        codec = per_worker(("codec", tokenizer), lambda: StreamCodec(tokenizer))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            ids, text = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(text):
                done = codec.round_trip(text[a:b])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([x.count(" ") + 1 if x else 0 for x, _ in done], pa.int64()),
                     pa.array([sha(x) for x, _ in done]), pa.array([sha(y) for _, y in done])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(digest, "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING")
