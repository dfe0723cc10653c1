"""PII by format-preserving Feistel pseudonyms (operator 7).

Personal numbers, dates and mail addresses are found by form, *validated* (Luhn
and mod-97 check digits, calendar, octets, number plans), turned into a number
of the set of all valid values of that form, and permuted in this set by a keyed
Feistel network. Form, punctuation and check digits are right again afterwards.
Equal values get equal pseudonyms in every document and in every spelling, and
whoever has the key can undo it. What does not validate stays as it is.

The network has ``ROUNDS`` rounds over two halves of nearly equal size, with
keyed BLAKE2b as round function and the form as tweak; numbers beyond the set
walk on until they are in it. So it is a permutation of the set, not a hash:
different values never share a pseudonym. Sets of few values (a mail address of
one letter) hide little; a value may by chance be its own pseudonym.

Each row is worked on alone: nothing is shuffled, so no key can be hot.

Defined results. Null stays null, empty texts stay empty, with nothing found.
Repeated rows get equal results. Extra columns are ignored by ``pseudonyms`` and
kept by ``pseudonymised``. Texts of any length are read whole.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prefix

ROUNDS = 10
MEMO = 1 << 17
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "mail")
NUMBERS = re.compile(r"""
    (?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?:\ [0-9A-Z]{4}){2,7}(?:\ [0-9A-Z]{1,3})?)(?![0-9A-Za-z]))
  | (?P<phone>(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9A-Za-z])
       |(?<![0-9A-Za-z+])(?:\([2-9][0-9]{2}\)\ ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z]))
  | (?P<date>(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})
       (?![0-9A-Za-z]|[./-][0-9]))
  | (?P<ssn>(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9]))
  | (?P<card>(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}(?P<a>[ -])[0-9]{4}(?P=a)[0-9]{4}(?P=a)[0-9]{1,7}|[0-9]{4}(?P<b>[ -])[0-9]{6}(?P=b)[0-9]{4,5})
       (?![0-9A-Za-z]))
  | (?P<ip>(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9]))
    """, re.X)
MAIL = re.compile(r"(?<![\w.%+-])(?P<mail>[\w%+-](?:[\w.%+-]*[\w%+-])?)(?=@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})")
DIGITS = re.compile(r"[0-9]")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Feistel:
    """Keyed permutations of 0 .. n - 1, one for each n and tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, n: int, i: int, half: int) -> int:
        size = (half.bit_length() + 7) // 8
        data = b"%b|%d|%d|" % (tweak, n, i) + half.to_bytes(size, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "big")

    def permute(self, value: int, n: int, tweak: bytes, back: bool = False) -> int:
        if n < 2:
            return value
        b = isqrt(n - 1) + 1
        a = -(-n // b)
        while True:
            left, right = divmod(value, b)
            for i in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)):
                sign = -1 if back else 1
                if i % 2:
                    right = (right + sign * self._round(tweak, n, i, left)) % b
                else:
                    left = (left + sign * self._round(tweak, n, i, right)) % a
            value = left * b + right
            if value < n:
                return value


def spelled(form: str, digits: str) -> str:
    """``form`` with its digits replaced, in order."""
    it = iter(digits)
    return DIGITS.sub(lambda _: next(it), form)


def luhn(digits: str) -> int:
    """The check digit behind ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + (i % 2 == 0))
        total += v - 9 * (v > 9)
    return -total % 10


def _mixed(chars: str, move: Callable[[int, int], int]) -> str:
    """Move a string among all of its pattern: ASCII letters stay letters of
    their case, digits digits, all else itself."""
    sizes = [10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 1 for c in chars]
    value, n = 0, 1
    for c, s in zip(chars, sizes):
        value = value * s + (0 if s == 1 else int(c) if s == 10 else LETTERS.index(c.lower()))
        n *= s
    value, out = move(value, n), []
    for c, s in zip(reversed(chars), reversed(sizes)):
        value, x = divmod(value, s)
        out.append(c if s == 1 else str(x) if s == 10 else LETTERS[x] if c.islower() else LETTERS[x].upper())
    return "".join(reversed(out))


def card(text: str, move) -> str | None:
    d = "".join(DIGITS.findall(text))
    if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    k = len(d) - 2      # the first digit says what kind of card it is and stays
    body = d[0] + str(move(int(d[1:-1]), 10 ** k)).zfill(k)
    return spelled(text, body + str(luhn(body)))


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(text: str, move) -> str | None:
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34 or _mod97(s[4:] + s[:4]) != 1:
        return None
    body = _mixed(s[4:], move)
    out = iter(s[:2] + f"{98 - _mod97(body + s[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(out) for c in text)


def ssn(text: str, move) -> str | None:
    a, g, s = int(text[:3]), int(text[4:6]), int(text[7:])
    if not 1 <= a <= 899 or a == 666 or not g or not s:
        return None
    x = move(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999)
    x, s = divmod(x, 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def phone(text: str, move) -> str | None:
    d = "".join(DIGITS.findall(text))
    if text[0] != "+":      # of the North American plan: first digits of area and exchange are 2 to 9
        first = [int(d[0]) - 2, int(d[3]) - 2]
        x = move(((first[0] * 8 + first[1]) * 10000 + int(d[1:3] + d[4:6])) * 10000 + int(d[6:]), 64 * 10 ** 8)
        x, line = divmod(x, 10000)
        x, mid = divmod(x, 10000)
        a, e = divmod(x, 8)
        return spelled(text, f"{a + 2}{mid // 100:02d}{e + 2}{mid % 100:02d}{line:04d}")
    if not 8 <= len(d) <= 15 or text.count("(") != text.count(")"):
        return None
    lead = re.match(r"\+([0-9]{1,3})(?![0-9])", text)       # a country code that is set apart stays
    k = len(lead[1]) if lead else 1
    return spelled(text, d[:k] + str(move(int(d[k:]), 10 ** (len(d) - k))).zfill(len(d) - k))


def ip(text: str, move) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    x = move(int.from_bytes(bytes(parts), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _days(late: bool) -> np.ndarray:
    """The days of FIRST to LAST; with ``late`` those after the 12th of a month."""
    days = np.arange(FIRST, LAST + 1)
    return np.array([x for x in days.tolist() if datetime.date.fromordinal(x).day > 12]) if late else days


DAYS: dict[bool, np.ndarray] = {}


def date(text: str, move) -> str | None:
    order = "ymd" if text[4] == "-" else "dmy" if text[2] == "." else "mdy" if int(text[:2]) <= 12 else "dmy"
    late = order == "dmy" and text[2] == "/"        # else it would be read as month first
    try:
        part = dict(zip(order, map(int, re.split(r"[./-]", text))))
        day = datetime.date(part["y"], part["m"], part["d"]).toordinal()
    except ValueError:
        return None
    if not FIRST <= day <= LAST:
        return None
    if late not in DAYS:
        DAYS[late] = _days(late)
    days = DAYS[late]
    new = datetime.date.fromordinal(int(days[move(int(np.searchsorted(days, day)), len(days))]))
    part = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return text[4 if order == "ymd" else 2].join(part[x] for x in order)


def mail(text: str, move) -> str | None:
    return _mixed(text, move)


FORMS = {"card": card, "iban": iban, "ssn": ssn, "phone": phone, "ip": ip, "date": date, "mail": mail}


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back, self.memo = Feistel(key), back, {}

    def value(self, kind: str, text: str) -> str | None:
        """The pseudonym of a value, or None if it does not validate."""
        got = self.memo.get((kind, text), 0)
        if got == 0:
            # The tweak has what stays: kind, and for mail what is neither letter nor digit and which letters are capital.
            tweak = kind if kind != "mail" else kind + re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", DIGITS.sub("9", text)))
            if kind in ("card", "iban"):
                tweak += text[0] if kind == "card" else text[:2]
            got = FORMS[kind](text, lambda x, n: self.feistel.permute(x, n, tweak.encode(), self.back))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[kind, text] = got
        return got

    def rewritten(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many values of each kind it had."""
        found = dict.fromkeys(KINDS, 0)

        def swap(m: re.Match) -> str:
            kind = m.lastgroup        # the last group to close is the outermost
            new = self.value(kind, m[0])
            if new is None:
                return m[0]
            found[kind] += 1
            return new

        text = NUMBERS.sub(swap, text)
        return (MAIL.sub(swap, text) if "@" in text else text), found


def _rewriter(key: bytes, back: bool):
    fields = ", ".join(f"n_{k} long" for k in KINDS)

    @F.pandas_udf(f"text string, {fields}")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = Pseudonyms(key, back)
        for texts in batches:
            rows = []
            for t in texts:
                new, found = (t, dict.fromkeys(KINDS, 0)) if not t else p.rewritten(t)
                rows.append((new, *found.values()))
            yield pd.DataFrame(rows, columns=["text", *(f"n_{k}" for k in KINDS)])

    return rewrite.asNondeterministic()


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the rewritten text, n_replaced, and n_<kind> for each kind, of every row."""
    got = docs.select(F.col(id_col), _rewriter(key, False)(F.col(text_col)).alias("_g"))
    total = sum((F.col(f"_g.n_{k}") for k in KINDS[1:]), F.col(f"_g.n_{KINDS[0]}"))
    return got.select(id_col, "_g.text", total.alias("n_replaced"), *[f"_g.n_{k}" for k in KINDS])


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with rewritten texts; with ``back``, with the values they stand for."""
    got = prefix(docs) + "got"
    return (docs.withColumn(got, _rewriter(key, back)(F.col(text_col))).withColumn(text_col, F.col(f"{got}.text"))
            .select(*docs.columns))
