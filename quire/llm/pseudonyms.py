"""Personal data: format-preserving Feistel pseudonyms.

Validated values (payment card numbers with a right Luhn digit, telephone
numbers, IPv4 addresses, US social security numbers, IBANs, calendar dates,
e-mail local parts, access tokens) are replaced by another value of the
same format. Each format is a set of N values, numbered from 0; a keyed
Feistel network E permutes the numbers and a value x becomes
``E^-1(E(x) + 1 mod N)``: a permutation without fixed points, so equal values
get equal pseudonyms in every document, different values different ones, no
value stays itself, and the key undoes it (:func:`restore`).

A replaced number is again valid: cards keep length, first digit and a right
check digit, dates stay real dates between 1900 and 2099. Numbers that fail
validation are not personal data and stay. Defined results: null stays null,
empty stays empty; repeated rows give equal texts.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, with_columns

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email", "token")
DEMO_KEY = b"replace this key in production"


class Cycle:
    """A keyed single-cycle permutation of range(n) for each (format, n)."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, what: bytes, i: int, x: int, m: int) -> int:
        size = min(64, (m.bit_length() + 7) // 8 + 8)
        h = b""
        while len(h) * 8 < m.bit_length() + 64:
            h += hashlib.blake2b(b"%s|%d|%d|%d" % (what, i, x, len(h)), key=self.key, digest_size=size).digest()
        return int.from_bytes(h, "big") % m

    def _feistel(self, x: int, n: int, what: bytes, forward: bool) -> int:
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:                                        # walks on until it is back in range(n)
            u, v = divmod(x, b)                            # u in range(a), v in range(b)
            for i in range(ROUNDS) if forward else reversed(range(ROUNDS)):
                sign = 1 if forward else -1
                if i % 2:
                    u = (u + sign * self._round(what, i, v, a)) % a
                else:
                    v = (v + sign * self._round(what, i, u, b)) % b
            x = u * b + v
            if x < n:
                return x

    def step(self, x: int, n: int, what: bytes, by: int = 1) -> int:
        """The value after (by=1) or before (by=-1) ``x`` on the cycle."""
        if n < 2:
            return x
        what = b"%s/%d" % (what, n)
        return self._feistel((self._feistel(x, n, what, True) + by) % n, n, what, False)


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(shape: str, chars: str) -> str:
    """``shape`` with its ASCII letters and digits replaced in order by ``chars``."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _digits(c: Cycle, d: str, what: bytes, by: int) -> str:
    return str(c.step(int(d), 10 ** len(d), what, by)).zfill(len(d))


def card(c: Cycle, m: re.Match, by: int) -> str | None:
    d = re.sub(r"\D", "", m[0])
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = d[0] + _digits(c, d[1:-1], b"card", by)
    if len(set(body + luhn_digit(body))) == 1:             # not a card number by the rule above: one step on
        body = d[0] + _digits(c, body[1:], b"card", by)
    return _refill(m[0], body + luhn_digit(body))


def _iban_check(country: str, bban: str) -> str:
    n = "".join(str(int(x, 36)) for x in bban + country + "00")
    return f"{98 - int(n) % 97:02d}"


def iban(c: Cycle, m: re.Match, by: int) -> str | None:
    s = m[0].replace(" ", "")
    country, check, bban = s[:2], s[2:4], s[4:]
    if not 15 <= len(s) <= 34 or _iban_check(country, bban) != check:
        return None
    new = _by_class(c, bban, b"iban" + country.encode(), by)
    return _refill(m[0], country + _iban_check(country, new) + new)


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _walk(c: Cycle, d: str, what: bytes, by: int, ok: Callable[[str], bool]) -> str:
    while True:                                            # the next valid value on the cycle
        d = _digits(c, d, what, by)
        if ok(d):
            return d


def ssn(c: Cycle, m: re.Match, by: int) -> str | None:
    d = m[0].replace("-", "")
    return _refill(m[0], _walk(c, d, b"ssn", by, _ssn_ok)) if _ssn_ok(d) else None


def phone(c: Cycle, m: re.Match, by: int) -> str | None:
    """North American form (ten digits, or 1 and ten digits) or a plus sign and
    8 to 15 digits; a leading country code 1 stays, and so does whether an area
    code can be one (2 or more in front): the form with blanks is read as a
    telephone number only then, and equal numbers get equal pseudonyms in all forms."""
    d = re.sub(r"\D", "", m[0])
    plus = m[0].lstrip("(")[0] == "+"
    one = len(d) == 11 and d[0] == "1"
    if not (8 <= len(d) <= 15 if plus else len(d) == 10 or one):
        return None
    head = d[:1] if one else d[:2] if plus else ""
    rest = d[len(head):]
    if len(rest) == 10:
        return _refill(m[0], head + _walk(c, rest, b"phone", by, lambda x: (x[0] > "1") == (rest[0] > "1")))
    return _refill(m[0], head + _digits(c, rest, b"phone", by))


def ip(c: Cycle, m: re.Match, by: int) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = c.step(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ip", by)
    return ".".join(map(str, x.to_bytes(4, "big")))


_FIRST, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


def date(c: Cycle, m: re.Match, by: int) -> str | None:
    """Year first (2024-05-31, also with / or .), or day and month first
    (31.05.2024; with / the first number is the month where both can be)."""
    a, sep, b, sep2, e = m["a"], m["s"], m["b"], m["s2"], m["c"]
    if sep != sep2:
        return None
    if len(a) == 4:
        order = "ymd"
    elif len(e) == 4 and len(a) <= 2:
        order = "mdy" if sep == "/" and int(a) <= 12 else "dmy"
    else:
        return None
    part = dict(zip(order, (a, b, e), strict=True))
    try:
        day = dt.date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    pad = len(a) == len(b) == 2 or len(b) == len(e) == 2
    if not pad and any(len(v) == 2 and v[0] == "0" for v in (a, b, e)):
        return None
    while True:                                            # the next date that reads back in the form it was written in
        day = c.step(day, _DAYS, b"date", by)
        new = dt.date.fromordinal(day + _FIRST)
        if order == "dmy" and sep == "/" and new.day <= 12 or not pad and min(new.day, new.month) > 9:
            continue
        v = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if pad else str(new.month),
             "d": f"{new.day:02d}" if pad else str(new.day)}
        return sep.join(v[k] for k in order)


def _by_class(c: Cycle, s: str, what: bytes, by: int) -> str:
    """Letters to letters of the same case, digits to digits, all else stays."""
    n, x, radix = 1, 0, []
    for ch in s:
        r, base = (10, 48) if ch.isdigit() else (26, 97 if ch.islower() else 65) if ch.isalpha() else (1, ord(ch))
        radix.append((r, base))
        n *= r
        x = x * r + (ord(ch) - base)
    shape = "".join("9" if r == 10 else "." if r == 1 else "a" if b == 97 else "A" for r, b in radix)
    x = c.step(x, n, what + b":" + shape.encode(), by)
    out = []
    for r, base in reversed(radix):
        x, k = divmod(x, r)
        out.append(chr(base + k))
    return "".join(reversed(out))


def email(c: Cycle, m: re.Match, by: int) -> str | None:
    return _by_class(c, m["local"], b"email@" + m["domain"].lower().encode(), by) + "@" + m["domain"]


def token(c: Cycle, m: re.Match, by: int) -> str | None:
    """A hexadecimal value given to a key, token, secret or password, in one
    case; or an access key id of four fixed letters and 16 letters or digits."""
    if s := m["id"]:
        new = s[4:]
        x = c.step(int(new, 36), 36 ** 16, b"id", by)
        out = []
        for _ in range(16):
            x, k = divmod(x, 36)
            out.append("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[k])
        return s[:4] + "".join(reversed(out))
    s = m["hex"]
    low = s.islower() or s.isdigit()
    new = s
    while True:                                            # the next value on the cycle in the same case
        new = f"{c.step(int(new, 16), 16 ** len(s), b'token' + (b'a' if low else b'A'), by):0{len(s)}x}"
        if low or not new.isdigit():
            return m["head"] + (new if low else new.upper())


#: What each kind of value looks like, in the order in which they are tried at a place.
_LOOKS = {
    "email": r"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]+)@(?P<domain>[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})",
    "token": r"(?P<head>(?i:key|token|secret|password)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?P<hex>[0-9a-f]{16,128}|[0-9A-F]{16,128})(?!\w)|(?<!\w)(?P<id>A[KS]IA[0-9A-Z]{16})(?!\w)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "date": r"(?<![\w./-])(?P<a>\d{4}|\d{1,2})(?P<s>[-/.])(?P<b>\d{1,2})(?P<s2>[-/.])(?P<c>\d{4}|\d{1,2})(?![\w]|[-/.]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)",
    "phone": r"(?:(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|(?<!\w)\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|(?<![\w.-])(?:1[.-])?\d{3}(?P<q>[.-])\d{3}(?P=q)\d{4}|(?<![\w.-])(?<!\d )(?:1 )?[2-9]\d{2} \d{3} \d{4}(?! \d))(?![\w]|[-.]\d)",
    "long_card": r"(?<![\w.-])\d{4}(?P<l>[ -])(?:\d{4}(?P=l)){3}\d{3}(?!\w)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?P<g>[ -])\d{4}(?P=g)\d{4}(?P=g)\d{1,7}|\d{4}(?P<h>[ -])\d{6}(?P=h)\d{5})(?!\w)",
}
PATTERN = re.compile("|".join(f"(?P<{k}>{x})" for k, x in _LOOKS.items()), re.ASCII)
_ALONE = {k: re.compile(x, re.ASCII) for k, x in _LOOKS.items()}
_DO = {"long_card": card, "card": card, "iban": iban, "ssn": ssn, "phone": phone, "ip": ip, "date": date, "email": email, "token": token}
_WORD = re.compile(r"\w+", re.ASCII)
#: Every value holds one of these.
_ANY = re.compile(r"[0-9@]|A[KS]IA|(?i:key|token|secret|password)[\"']?\s{0,3}[:=]", re.ASCII)


def pseudonymise(text: str, cycle: Cycle, by: int = 1) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every value replaced, and (kind, start, end) of each in the new text."""
    if not _ANY.search(text):
        return text, []
    out, at, shift, spans = [], 0, 0, []
    pos = 0
    while m := PATTERN.search(text, pos):
        kind = next(k for k in _LOOKS if m[k] is not None)
        new = _DO[kind](cycle, m, by)
        if new is None:                                    # not valid as this: as another kind at this place?
            for kind in list(_LOOKS)[list(_LOOKS).index(kind) + 1:]:
                if (m2 := _ALONE[kind].match(text, m.start())) and (new := _DO[kind](cycle, m2, by)) is not None:
                    m = m2
                    break
            else:                                          # none: look on behind its first word
                skip = _WORD.match(text, m.start())
                pos = skip.end() if skip else m.start() + 1
                continue
        out += [text[at:m.start()], new]
        spans.append((kind.removeprefix("long_"), m.start() + shift, m.start() + shift + len(new)))
        shift += len(new) - (m.end() - m.start())
        at = pos = m.end()
    return "".join([*out, text[at:]]) if out else text, spans


def restore(text: str, cycle: Cycle) -> str:
    """The original of a pseudonymised text (with the same key)."""
    return pseudonymise(text, cycle, -1)[0]


def protect(docs: DataFrame, key: bytes, counts: bool = False) -> DataFrame:
    """``docs`` (all columns) with the values in ``text`` replaced; whoever has
    ``key`` can restore them (``DEMO_KEY`` is public). With ``counts``, a struct column ``pii`` of the number of values per kind is
    added (a column of that name is replaced)."""
    fields = [f for f in docs.schema.fields if not (counts and f.name == "pii")]
    docs = docs.select(*[f"`{f.name}`" for f in fields])
    number = T.StructType([T.StructField(k, T.LongType()) for k in KINDS])
    schema = T.StructType([*fields, *([T.StructField("pii", number)] if counts else [])])
    kind = pa.struct([(k, pa.int64()) for k in KINDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cycle = Cycle(key)
        for b in batches:
            texts, found = [], []
            for t in column(b, "text").to_pylist():
                t, spans = (t, []) if t is None else pseudonymise(t, cycle)
                texts.append(t)
                if counts:
                    n = dict.fromkeys(KINDS, 0)
                    for k, *_ in spans:
                        n[k] += 1
                    found.append(n)
            more = {"pii": pa.array(found, kind)} if counts else {}
            yield with_columns(b, text=pa.array(texts, column(b, "text").type), **more)

    return docs.mapInArrow(run, schema)
