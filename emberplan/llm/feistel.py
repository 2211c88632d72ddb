"""Format-preserving pseudonyms for validated numbers and dates by keyed Feistel networks.

A value is a number below the size of its format's domain. Rounds of an unbalanced-by-at-most-one
Feistel network over mixed radix permute the domain keyed; values that fall outside (an
impossible date, a reserved number) walk on until they are inside, so that a format maps onto
itself, one to one. The key and the kind decide the permutation, nothing else: equal values stay
equal across documents, and a holder of the key can go back.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, tidy

ROUNDS = 10
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "hex", "email")


class Feistel:
    """Keyed permutations of range(size)."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, i: int, x: int, modulus: int) -> int:
        h = hashlib.blake2b(b"%d|%d|%b" % (i, x, tweak), key=self.key[:64], digest_size=32).digest()
        return int.from_bytes(h, "big") % modulus

    def _once(self, x: int, a: int, b: int, tweak: bytes, back: bool) -> int:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2 == 0:
                left = (left + sign * self._round(tweak, i, right, a)) % a
            else:
                right = (right + sign * self._round(tweak, i, left, b)) % b
        return left * b + right

    def permute(self, x: int, size: int, tweak: bytes, valid=lambda x: True, back: bool = False) -> int:
        """The value that x (valid, below size) has under the permutation of the valid values."""
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            x = self._once(x, a, b, tweak, back)
            if x < size and valid(x):
                return x


def luhn_digit(body: str) -> str:
    total = 0
    for i, d in enumerate(reversed(body)):
        d = int(d) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _iban_check(country: str, body: str) -> str:
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(digits) % 97:02d}"


def _fill(shape: str, digits: str) -> str:
    """shape with its digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _card(f, m, back):
    d = re.sub(r"\D", "", m)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    # All digits the same is no card, and stays out of the range.
    ok = lambda x: len(set((s := f"{x:0{len(d) - 1}d}") + luhn_digit(s))) > 1
    body = f"{f.permute(int(d[:-1]), 10 ** (len(d) - 1), b'card%d' % len(d), ok, back):0{len(d) - 1}d}"
    return _fill(m, body + luhn_digit(body))


def _iban(f, m, back):
    d = m.replace(" ", "")
    if not 15 <= len(d) <= 34 or _iban_check(d[:2], d[4:]) != d[2:4]:
        return None
    # Digits stay digits and letters letters: mixed radix by place.
    radix = [10 if c.isdigit() else 26 for c in d[4:]]
    x = 0
    for c, r in zip(d[4:], radix, strict=True):
        x = x * r + (int(c) if r == 10 else ord(c) - 65)
    x = f.permute(x, math.prod(radix), b"iban" + d[:2].encode() + "".join("9A"[r == 26] for r in radix).encode(), back=back)
    body = ""
    for r in reversed(radix):
        x, c = divmod(x, r)
        body = (str(c) if r == 10 else chr(65 + c)) + body
    new = iter(d[:2] + _iban_check(d[:2], body) + body)
    return "".join(c if c == " " else next(new) for c in m)


def _ssn(f, m, back):
    ok = lambda x: 0 < x // 10**6 < 900 and x // 10**6 != 666 and x // 10**4 % 100 and x % 10**4
    x = int(m.replace("-", ""))
    return _fill(m, f"{f.permute(x, 10**9, b'ssn', ok, back):09d}") if ok(x) else None


def _phone(f, m, back):
    code, _, rest = m.partition(" ") if m[0] == "+" else ("", "", m)
    if m[0] == "+" and not rest:
        code, rest = m[:2], m[2:]
    d = re.sub(r"\D", "", rest)
    if not 7 <= len(d) <= 14 or len(re.sub(r"\D", "", m)) > 15:
        return None
    new = f"{f.permute(int(d), 10 ** len(d), b'phone' + code.encode() + b'%d' % len(d), back=back):0{len(d)}d}"
    return m[: len(m) - len(rest)] + _fill(rest, new)


def _ip(f, m, back):
    parts = m.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ip", back=back)
    return ".".join(map(str, x.to_bytes(4, "big")))


DAY_0, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def _date(f, m, back):
    sep = re.search(r"\D", m)[0]
    parts = m.split(sep)
    first = 0 if len(parts[0]) == 4 else 2
    y, mid, last = (int(parts[first]), int(parts[1]), int(parts[2 - first]))
    # Day first unless only month first is a date.
    for order in ("ymd",) if first == 0 else ("dmy", "mdy"):
        mo, day = (mid, last) if order != "mdy" else (last, mid)
        try:
            x = datetime.date(y, mo, day).toordinal() - DAY_0
        except ValueError:
            continue
        if not 0 <= x < DAYS:
            return None
        # Dates that could be read day first or month first keep to themselves in every order, so
        # that a date keeps its pseudonym however it is written.
        both = lambda n: datetime.date.fromordinal(n + DAY_0).day <= 12
        ok = lambda n, own=both(x): both(n) == own
        t = datetime.date.fromordinal(f.permute(x, DAYS, b"date", ok, back) + DAY_0)
        new = {"ymd": (f"{t.year}", t.month, t.day), "dmy": (t.day, t.month, f"{t.year}"), "mdy": (t.month, t.day, f"{t.year}")}[order]
        return sep.join(n if isinstance(n, str) else f"{n:02d}" for n in new)
    return None


def _hex(f, m, back):
    if len(m) not in (32, 40, 48, 56, 64, 96, 128) or not (re.search("[0-9]", m) and re.search("[a-fA-F]", m)):
        return None
    upper = m.upper() == m
    # Only strings with both digits and letters are taken for keys, so these map onto each other.
    ok = lambda x: re.search("[0-9]", s := f"{x:0{len(m)}x}") and re.search("[a-f]", s)
    new = f"{f.permute(int(m, 16), 16 ** len(m), b'hex%d%d' % (len(m), upper), ok, back):0{len(m)}x}"
    return new.upper() if upper else new


def _email(f, m, back):
    local, domain = m.rsplit("@", 1)
    kinds = [("0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isalnum() else c for c in local]
    radix = [len(k) for k in kinds]
    x = 0
    for c, k in zip(local, kinds, strict=True):
        x = x * len(k) + k.index(c)
    if max(radix) == 1:
        return None
    x = f.permute(x, math.prod(radix), b"email@" + domain.encode() + "".join(k[0] for k in kinds).encode(), back=back)
    out = ""
    for k in reversed(kinds):
        x, i = divmod(x, len(k))
        out = k[i] + out
    return f"{out}@{domain}"


# Fixed formats, in the order in which they claim a place.
FORMATS = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    "date": (r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?![\d/-]|\.\d)", _date),
    "ip": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ip),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    "hex": (r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])", _hex),
    "card": (r"(?<![\d+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\d|-\d)", _card),
    "phone": (r"(?<![\d+(])(?:\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4})(?!\d|-\d)", _phone),
}
SOME = re.compile("[0-9@]")
#: Kinds written in groups, whose shorter readings are tried.
GROUPED = ("card", "iban")


class Pseudonyms:
    def __init__(self, key: bytes, kinds=tuple(FORMATS)):
        self.f = Feistel(key)
        # ASCII digits only: other scripts' digits are no part of these formats.
        self.formats = [(k, re.compile(p, re.ASCII), g) for k, (p, g) in FORMATS.items() if k in kinds]

    def spans(self, text: str, back: bool = False) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of the validated values, in order, without overlaps."""
        if not SOME.search(text):
            return []
        starts: list[int] = []  # of the places taken so far, in order; found by halving
        taken: list[tuple[int, int, str, str]] = []
        for kind, pattern, replace in self.formats:
            m = pattern.search(text)
            while m:
                start, end = m.span()
                k = bisect.bisect_left(starts, end)
                if k and taken[k - 1][1] > start:
                    m = pattern.search(text, max(start + 1, taken[k - 1][1]))
                    continue
                new = replace(self.f, text[start:end], back)
                # What fails as a whole may be a value and a number behind it.
                while new is None and kind in GROUPED and (cut := max(text.rfind(" ", start, end), text.rfind("-", start, end))) > start:
                    end = cut
                    new = replace(self.f, text[start:end], back)
                if new is not None:
                    k = bisect.bisect_left(starts, start)
                    starts.insert(k, start)
                    taken.insert(k, (start, end, kind, new))
                m = pattern.search(text, end if new is not None else start + 1)
        return taken

    def rewrite(self, text: str, back: bool = False) -> tuple[str, dict[str, int]]:
        out, at, counts = [], 0, {}
        for a, b, kind, new in self.spans(text, back):
            out += [text[at:a], new]
            at = b
            counts[kind] = counts.get(kind, 0) + 1
        return "".join([*out, text[at:]]), counts


def _rewritten(batches, key: bytes, text_at: int, names: list[str], back: bool):
    p = Pseudonyms(key)
    for b in batches:
        texts, counts = [], {k: [] for k in KINDS}
        for t in b.column(text_at).to_pylist():
            new, found = (t, {}) if t is None else p.rewrite(t, back)
            texts.append(new)
            for k in KINDS:
                counts[k].append(found.get(k, 0))
        cols = list(b.columns)
        cols[text_at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([*cols, *[pa.array(counts[k], pa.int64()) for k in KINDS]], names=names)


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", back: bool = False) -> DataFrame:
    """Every row of docs with validated values in its text replaced, and n_<kind> counts.

    What only looks like a value (a card number with a wrong check digit, an impossible date)
    stays. Formats: KINDS, written as in FORMATS; a date keeps its pseudonym in each of its
    orders. Time grows with the length of a text, whole texts of any length are read. Null texts stay null and empty ones empty, with counts of 0. Repeated rows are
    rewritten alike; an empty table gives none. Columns of docs named like the counts are
    replaced. back: undoes it (but where digits behind a grouped number happen to make a longer
    valid one with its pseudonym).
    """
    small_batches(docs.sparkSession)
    ours = [f"n_{k}" for k in KINDS]
    docs = docs.drop(*ours).withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField(k, T.LongType()) for k in ours])
    text_at, names = docs.columns.index(text_col), [*docs.columns, *ours]
    return docs.mapInArrow(tidy(lambda x: _rewritten(x, key, text_at, names, back)), schema)
