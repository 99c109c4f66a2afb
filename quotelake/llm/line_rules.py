"""Line-first cleaning: rules fail single lines, and documents that lose too much text with them are rejected.

Lines fail for navigation (link bars and runs of short lines without a mark), symbol noise, shouting (marks or
capitals), boilerplate, a missing sentence end, and repetition of an earlier line or within the line.
"""

from __future__ import annotations

import re
from itertools import count
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.chunked import slices

_SYMBOLS = b"#*$%&|<>"
WINDOW = 8  # words of a repeated window
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words in repeated windows
MAX_BARS = 20  # percent of a line's words that are bars
MAX_SYMBOLS = 10  # percent of a line's word characters that are symbols
MAX_SHOUTS = 30  # percent of a line's words that end in !!
CAPITALS = 10, 60  # A-Z and a-z of a line from which their share of capitals counts, and its limit in percent
MAX_REPEAT_LINE = 50  # percent of a line's words that repeat the word before
LONG_LINE = 100  # words without any sentence mark
PROSE_LINE = 10  # words from which a line has to end with a sentence mark,
SPARSE = 40  # if it has fewer than one mark for so many words and the next line doesn't go on in lower case
MENU_WORDS, MENU_LINES = 4, 3  # words of an unmarked line, and such lines in a row, that make a menu
MAX_LOST = 50  # percent of word characters in failed lines
BOILERPLATE = [b"lorem ipsum", b"all rights reserved", b"cookie policy", b"privacy policy", b"terms of use",
               b"enable javascript"]
STOPS, COMMAS, CLOSING, SEPARATORS = ".!?:;…。！？；：", ",、，", "\"')]”’»", ">»›•·"


def _any(characters: str) -> bytes:
    """A pattern for one of some characters in UTF-8."""
    return b"(?:" + b"|".join(re.escape(c.encode()) for c in characters) + b")"


_STOP, _MARK = re.compile(_any(STOPS)), re.compile(_any(STOPS + COMMAS))
_END = re.compile(_any(STOPS) + _any(CLOSING) + rb"*\Z")
_GOES_ON = re.compile(r"[ \t\v\f\r]*[a-zß-öø-ÿ]")
_BETWEEN = {c.encode() for c in SEPARATORS}
_NOT_CAPITAL, _NOT_LETTER = (bytes(i for i in range(256) if not chr(i).isascii() or not test(chr(i)))
                             for test in (str.isupper, str.isalpha))


def _code_points(raw: bytes) -> int:
    """Characters of the words of some UTF-8 text."""
    return len(b"".join(raw.split()).decode())


def line_fails(words: list[bytes], line: bytes, after: bytes = b"") -> bool:
    """Whether a line with words fails one of the rules that look at it and, for a sentence that goes on, at the line after."""
    n = len(words)
    bars = words.count(b"|") if b"|" in line else 0
    if not _BETWEEN.isdisjoint(words):
        bars += sum(w in _BETWEEN for w in words[1:])  # the first may open an item of a list
    if 100 * bars > MAX_BARS * n:
        return True
    symbols = len(line) - len(line.translate(None, _SYMBOLS))
    if symbols and 100 * symbols > MAX_SYMBOLS * _code_points(line):
        return True
    if b"!!" in line and 100 * sum(w.endswith(b"!!") for w in words) > MAX_SHOUTS * n:
        return True
    letters = len(line.translate(None, _NOT_LETTER))
    if letters >= CAPITALS[0] and 100 * len(line.translate(None, _NOT_CAPITAL)) > CAPITALS[1] * letters:
        return True
    if n > 1 and 100 * sum(map(eq, words, words[1:])) > MAX_REPEAT_LINE * (n - 1):
        return True
    if n > LONG_LINE and not _STOP.search(line):
        return True
    if (n >= PROSE_LINE and not _END.search(words[-1]) and SPARSE * len(_STOP.findall(line)) < n
            and not _GOES_ON.match(after.decode())):
        return True
    low = line.lower()
    return any(phrase in low for phrase in BOILERPLATE)


def menu_lines(lines: list[bytes], words: list[list[bytes]]) -> set[int]:
    """Places of lines in runs of short lines without a mark; lines without words don't part a run."""
    found, run = set(), []
    for i, own in enumerate(words):
        if not own:
            continue
        if len(own) <= MENU_WORDS and not _MARK.search(lines[i]):
            run.append(i)
            if len(run) == MENU_LINES:
                found.update(run)
            elif len(run) > MENU_LINES:
                found.add(i)
        else:
            run = []
    return found


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window that occurs twice or more. Windows get exact integer names by pairing names of halves."""
    if len(words) <= window:
        return 0
    ids = dict(zip(dict.fromkeys(words), count()))
    names = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    size = 1
    while size < window:
        pairs = names[:-size] * len(words) + names[size:]
        names = np.unique(pairs, return_inverse=True)[1].reshape(-1)
        size *= 2
    again = np.bincount(names)[names] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _line_verdicts(raw: bytes):
    """(line, words, whether it equals an earlier line, whether it fails) in order."""
    seen, lines = set(), raw.split(b"\n")
    split = [line.split() for line in lines]
    menus = menu_lines(lines, split)
    for i, (line, words) in enumerate(zip(lines, split)):
        again = bool(words) and line in seen
        seen.add(line)
        after = lines[i + 1] if i + 1 < len(lines) else b""
        yield line, words, again, bool(words) and (again or i in menus or line_fails(words, line, after))


def measure(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept)."""
    raw = text.encode()
    words = raw.split()  # of bytes: cuts at the white space of ASCII only
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    again = lost = 0
    for line, _, repeated, fails in _line_verdicts(raw):
        again += repeated
        if fails:
            lost += _code_points(line)
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED * len(words)
    return (len(words), chars, len(raw) - len(raw.translate(None, _SYMBOLS)), again, repeats, lost, failed,
            not failed and 100 * lost <= MAX_LOST * chars)


def clean_lines(text: str | None) -> str | None:
    """The text without its failed lines."""
    if text is None:
        return None
    return b"\n".join(line for line, _, _, fails in _line_verdicts(text.encode()) if not fails).decode()


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept"]
_TYPES = [pa.int64()] * 6 + [pa.bool_()] * 2
_SCHEMA = ", ".join(f"{f} {'BOOLEAN' if t == pa.bool_() else 'BIGINT'}" for f, t in zip(FIELDS, _TYPES))


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the measures of `measure`, base_failed and kept.

    A null text has no words and fails; null and repeated ids are returned as they come,
    other columns are ignored, an empty table gives no rows. One pass, no shuffle.
    """

    def judge(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(text):
                found = [measure(t or "") for t in text[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), *(pa.array(c, t) for c, t in zip(zip(*found), _TYPES))],
                    ["doc_id", *FIELDS])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(judge, f"doc_id BIGINT, {_SCHEMA}")


def keep_clean(docs: DataFrame, text_col: str = "text", strip: bool = False) -> DataFrame:
    """The rows that the rules keep, with all their columns; `strip` also takes the failed lines out of their texts.

    A null, empty or short text is not kept; repeated rows stay or go together; ids and other columns are not looked
    at and may have any name; an empty table gives no rows.
    """
    at = docs.columns.index(text_col)

    def sift(batches):
        for batch in batches:
            text = batch.column(at).to_pylist()
            good = [measure(t or "")[-1] for t in text]
            batch = batch.filter(pa.array(good, pa.bool_()))
            if strip:
                lines = pa.array([clean_lines(t) for t, g in zip(text, good) if g], batch.schema.field(at).type)
                batch = batch.set_column(at, batch.schema.field(at), lines)
            yield batch

    return docs.mapInArrow(sift, docs.schema)
