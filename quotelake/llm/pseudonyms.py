"""Personal data to keyed pseudonyms of the same format.

Validated values (checksums, calendar, ranges) are permuted by a Feistel network
within the set of valid values of their format. The permutation depends only on
the key and the kind, so equal values stay linked across documents and different ones stay apart.
"""

from __future__ import annotations

import datetime
import hmac
import re
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "iban", "date", "ip", "ssn", "phone", "card"]
ROUNDS = 8
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_FIND = re.compile(r"""
    (?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)
  | (?P<iban>(?<!\w)[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
  | (?P<date>(?<![\w.-])\d{4}-\d\d-\d\d(?:(?![\w-])|(?=[Tt]\d\d))|(?<![\w./])\d{1,2}(?P<mark>[./])\d{1,2}(?P=mark)\d{4}(?!\w|[./]\d))
  | (?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))
  | (?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))
  | (?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)
      |(?<!\w)(?:\(\d{3}\)[ ]?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w))
  | (?P<card>(?<!\w)\d(?:[ -]?\d){12,18}(?!\w))""", re.VERBOSE)

# the formats one by one, for what begins at a place where the longest match is no valid value
_EACH = {kind: re.compile(part, re.VERBOSE) for kind, part in zip(KINDS, re.split(r"\n  \| (?=\(\?P<)", _FIND.pattern))}
_CARD_SHAPE = re.compile(r"\d+|(?:\d{4}[ -])+\d{1,4}|\d{4}[ -]\d{6}[ -]\d{4,5}")  # how a card number is grouped
_IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in cs.split(",")}


def luhn_digit(digits: str) -> str:
    """The digit that completes a Luhn number."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_digits(country: str, body: str) -> str:
    """The two check digits of an account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


class Pseudonyms:
    """The permutations of one key."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tag: str, number: int, value: int, size: int) -> int:
        mac = hmac.digest(self.key, f"{tag}|{number}|{size}|{value}".encode(), "sha256")
        extra = b"" if size < 1 << 128 else b"".join(
            hmac.digest(self.key, mac + bytes([i]), "sha256") for i in range(size.bit_length() // 256 + 1))
        return int.from_bytes(mac + extra) % size

    def feistel(self, tag: str, value: int, left: int, right: int) -> int:
        """A permutation of range(left * right): the halves take turns in shifting each other."""
        a, b = divmod(value, right)
        for number in range(ROUNDS):
            if number % 2:
                b = (b + self._round(tag, number, a, right)) % right
            else:
                a = (a + self._round(tag, number, b, left)) % left
        return a * right + b

    def below(self, tag: str, value: int, size: int, valid=lambda _: True) -> int:
        """A permutation of the valid numbers below `size`: walk on until one is met."""
        left = isqrt(size - 1) + 1
        right = -(-size // left)
        while True:
            value = self.feistel(tag, value, left, right)
            if value < size and valid(value):
                return value

    def characters(self, tag: str, text: str) -> str:
        """Letters and digits permuted within their alphabets; case, marks and other characters stay in place."""
        low = text.lower() if len(text.lower()) == len(text) else text
        places = [(i, a) for i, c in enumerate(low) for a in _ALPHABETS if c in a]
        sizes = [len(a) for _, a in places]
        value = 0
        for i, a in places:
            value = value * len(a) + a.index(low[i])
        half = len(sizes) // 2
        shape = "".join(str(_ALPHABETS.index(a)) for _, a in places)
        value = self.feistel(f"{tag}|{shape}", value, prod(sizes[:half]), prod(sizes[half:]))
        out = list(low)
        for i, a in reversed(places):
            value, k = divmod(value, len(a))
            out[i] = a[k]
        return "".join(c.upper() if o.isupper() and len(c.upper()) == 1 else c for c, o in zip(out, text))

    def email(self, text: str) -> str:
        name, _, top = text.rpartition(".")
        return self.characters("email", name) + "." + top

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        country, body = plain[:2], plain[4:]
        if not 15 <= len(plain) <= 34 or plain[2:4] != iban_digits(country, body):
            return None
        body = self.characters("iban|" + country, body).upper()
        return _refill(text, country + iban_digits(country, body) + body, str.isalnum)

    def date(self, text: str) -> str | None:
        parts = re.split(r"[./-]", text)
        orders = [(0, 1, 2)] if "-" in text else [(2, 1, 0), (2, 0, 1)]  # day first, else month first
        for y, m, d in orders:
            try:
                day = datetime.date(int(parts[y]), int(parts[m]), int(parts[d])).toordinal()
            except ValueError:
                continue
            near = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()
            inside = near[0] <= day < near[1]  # dates of our time stay in our time
            new = datetime.date.fromordinal(1 + self.below(
                f"date{inside}", day - 1, datetime.date.max.toordinal(), lambda v: (near[0] <= v + 1 < near[1]) == inside)
                if not inside else near[0] + self.below("date", day - near[0], near[1] - near[0]))
            if "-" in text:
                return new.isoformat()
            mark = "/" if "/" in text else "."
            out = {y: f"{new.year:04d}", m: f"{new.month:02d}", d: f"{new.day:02d}"}
            return mark.join(out[i] for i in range(3))
        return None

    def ip(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255:
            return None
        value = self.feistel("ip", int.from_bytes(bytes(parts)), 1 << 16, 1 << 16)
        return ".".join(map(str, value.to_bytes(4)))

    def ssn(self, text: str) -> str | None:
        def valid(v):
            area, group, serial = v // 1_000_000, v // 10_000 % 100, v % 10_000
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        value = int(text.replace("-", ""))
        if not valid(value):
            return None
        return _refill(text, f"{self.below('ssn', value, 10 ** 9, valid):09d}", str.isdigit)

    def phone(self, text: str) -> str | None:
        code = re.match(r"\+\d{1,3}(?=\D)", text)  # the country stays where it stands apart
        code = code.group() if code else "+" if text[0] == "+" else ""
        digits = "".join(c for c in text[len(code):] if c.isdigit())
        if not 6 <= len(digits) <= 15:
            return None
        return code + _refill(text[len(code):], self.characters("phone|" + code, digits), str.isdigit)

    def card(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        body = self.characters("card", digits[:-1])
        return _refill(text, body + luhn_digit(body), str.isdigit)

    def mask(self, text: str) -> tuple[str, list[int]]:
        """The text with pseudonyms, and how many values of each kind it held."""
        found = dict.fromkeys(KINDS, 0)
        if "@" not in text and not any(d in text for d in _ALPHABETS[0]):
            return text, list(found.values())
        out, last, pos = [], 0, 0
        while match := _FIND.search(text, pos):
            kind, end, new = self._value(text, match)
            if new is None:
                pos = match.start() + 1
                continue
            found[kind] += 1
            out += text[last:match.start()], new
            last = pos = end
        return "".join(out) + text[last:], list(found.values())

    def _value(self, text: str, match: re.Match) -> tuple[str | None, int, str | None]:
        """(kind, end, pseudonym) of the valid value that begins where `match` does; it may be shorter or of another kind."""
        at = match.start()
        first = next(i for i, k in enumerate(KINDS) if match[k] is not None)
        for kind in KINDS[first:]:
            longest = match if kind == KINDS[first] else _EACH[kind].match(text, at)
            for end in self._ends(text, kind, longest) if longest else ():
                new = getattr(self, kind)(text[at:end])
                if new is not None:
                    return kind, end, new
        return None, at, None

    def _ends(self, text: str, kind: str, match: re.Match):
        """Where a value of a kind that begins with `match` may end, the best first."""
        at, end = match.span()
        borders = [i for i in range(end, at, -1) if i == end or text[i - 1].isalnum() and not (text[i].isalnum() or text[i] == "_")]
        if kind == "iban":
            size = _IBAN_LENGTHS.get(text[at:at + 2])
            own = [i for i in borders if len(text[at:i].replace(" ", "")) == size]
            return [*own, *(i for i in borders if size is None or i == end)]
        if kind == "card":
            return self._card_ends(text, at, borders)
        if kind == "phone":
            # it ends before a card number that goes on behind it, or that made it too long
            fits = self.phone(match[0]) is not None
            for i in range(at + 1, end):
                card = self._card_at(text, i) if text[i].isdigit() else None
                if card and (card > end or not fits):
                    borders = [b for b in borders if b < i]
                    break
            return borders
        return [end]

    def _card_ends(self, text: str, at: int, borders: list[int]):
        """Ends of a card number: of one that is grouped as such first, of others if none of those begins inside."""
        shaped = [i for i in borders if _CARD_SHAPE.fullmatch(text, at, i)]
        yield from shaped
        for i in borders:
            if i not in shaped and not any(self._card_at(text, j) for j in range(at + 1, i) if text[j].isdigit()):
                yield i

    def _card_at(self, text: str, at: int) -> int | None:
        """The end of the valid card number, grouped as such, that begins at a place."""
        match = _EACH["card"].match(text, at)
        ends = range(match.end(), at, -1) if match else ()
        return next((i for i in ends if (i == len(text) or not (text[i].isalnum() or text[i] == "_"))
                     and _CARD_SHAPE.fullmatch(text, at, i) and self.card(text[at:i]) is not None), None)


def _refill(form: str, characters: str, takes) -> str:
    """Put characters into the places of a form that `takes` names; the rest of the form stays."""
    new = iter(characters)
    return "".join(next(new) if takes(c) else c for c in form)


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The rows with their whole texts masked; all other columns as they are.

    Null texts stay null; repeated rows, null ids and any further columns pass through; an empty
    table gives no rows. One pass, no shuffle.
    """
    at = docs.columns.index(text_col)

    def mask(batches):
        names = Pseudonyms(key)
        for batch in batches:
            new = [None if t is None else names.mask(t)[0] for t in batch.column(at).to_pylist()]
            field = batch.schema.field(at)
            yield batch.set_column(at, field, pa.array(new, field.type))

    return docs.mapInArrow(mask, docs.schema)


def pseudonym_report(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the masked text, and n_<kind> for each kind; a null text stays null with counts of 0."""

    def mask(batches):
        names = Pseudonyms(key)
        for batch in batches:
            done = [(None, [0] * len(KINDS)) if t is None else names.mask(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()),
                 *(pa.array([n[i] for _, n in done], pa.int32()) for i in range(len(KINDS)))],
                ["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(mask, "doc_id BIGINT, text STRING, " + ", ".join(f"n_{k} INT" for k in KINDS))
