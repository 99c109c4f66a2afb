"""The tokenizers library over whole texts, one word at a time with a bounded memo.

A byte-level pre-tokenizer never lets a piece run from a character into the white
space after it. So a text cut in front of every run of white space gives the same
ids, chunk by chunk, as in one call; a chunk the worker has met before costs one
dictionary lookup. Texts that hold an added token, and tokenizers of another
build, go through the library in one call.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys

from quotelake.llm.tables import per_worker

# The White_Space characters of Unicode.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_PLAIN = re.compile("([ \n]?)([A-Za-z]+)([.,;:!?]?)")  # by far the most chunks
MEMO = 600_000  # chunks a worker remembers
MEMO_CHARS = 60  # longer chunks are not remembered


def chunks(text: str) -> list[str]:
    """Cut in front of every run of white space; the parts join to the text again."""
    words = text.split()
    blanks = len(words) - 1
    if text.count(" ") + text.count("\n") == blanks == len(text) - sum(map(len, words)) and "\0" not in text:
        # single blanks and line ends between words, the common case
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return _CHUNK.findall(text)


def splits_at_space(spec: dict) -> bool:
    """Whether chunks of such a tokenizer file are independent."""
    pre = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True) and not any(
                t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_STAND_IN = {b: c for c, b in byte_alphabet().items()}


def in_byte_alphabet(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_STAND_IN)


def latin_word(body: str) -> tuple[str, str] | None:
    """(letters, one mark or nothing) of a plain Latin word, which every pattern here cuts in this way; else None.

    Only letters below U+0250 count: they are letters in all versions of Unicode, composed, and lower-cased one by one.
    """
    if body.isalpha():
        letters, mark = body, ""
    elif body and body[-1] in ".,;:!?" and body[:-1].isalpha():
        letters, mark = body[:-1], body[-1]
    else:
        return None
    return (letters, mark) if letters.isascii() or max(letters) < "\u0250" and "\u0130" not in letters else None


class Memo(dict):
    """Values of chunks, made when first asked for; forgets everything when full, and never keeps long chunks."""

    def __init__(self, make, size=MEMO):
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.size:
                self.clear()
            self[key] = value
        return value


def pieces(chunk: str, cut) -> list[str]:
    """Pieces of a chunk in the byte alphabet; `cut` is the library's pre-tokenizer, for all but plain words."""
    blank = chunk.startswith(" ")
    word = latin_word(chunk[blank:])
    if word is None:
        return [p for p, _ in cut(chunk)]
    first = in_byte_alphabet(" " * blank + word[0])
    return [first, word[1]] if word[1] else [first]


def _packed(ids) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class ChunkEncoder:
    """`encode(texts)` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.by_chunk = splits_at_space(json.load(file))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(self.chunk)
        if self.by_chunk:
            self.cut, self.merge = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
            self.mark = {c: _packed([t.id for t in self.merge(in_byte_alphabet(c))]) for c in "\n.,;:!?"} | {"": b""}

    def chunk(self, text: str) -> bytes:
        """One chunk: the library's model over its pieces. A line end, an ASCII word and a mark are a piece each."""
        plain = _PLAIN.fullmatch(text)
        if plain:
            blank, letters, mark = plain.groups()
            if blank == " ":
                return _packed([t.id for t in self.merge("\u0120" + letters)]) + self.mark[mark]
            return self.mark[blank] + _packed([t.id for t in self.merge(letters)]) + self.mark[mark]
        return _packed([t.id for p in pieces(text, self.cut) for t in self.merge(p)])

    def whole(self, texts):
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self.whole(texts)
        get = self.memo.__getitem__
        return [b"" if not t else self.whole([t])[0] if any(a in t for a in self.added) else b"".join(map(get, chunks(t)))
                for t in texts]


def encoder(path: str) -> ChunkEncoder:
    return per_worker(("encoder", path), lambda: ChunkEncoder(path))


def slices(texts: list, chars: int = 8_000_000):
    """Cut a batch into runs of about so many characters, so that a batch of long texts stays small in memory."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t or "") > chars:
            yield start, i
            start, total = i, 0
        total += len(t or "")
    if start < len(texts):
        yield start, len(texts)
