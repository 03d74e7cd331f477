"""Personal numbers and dates replaced by format-preserving pseudonyms.

A candidate is found by its shape and validated (check digits, ranges, calendar).  Its value is
then permuted, under a secret key, among the valid values of its kind: a Feistel network over the
kind's numbers, walked until it lands on a valid one.  The pseudonym is written in the layout of
the original (separators, brackets, capitals, number of digits), and equal values get equal pseudonyms in all
documents, whatever their layout.  With the key the step can be undone (`invert`).

Kinds: card (13 to 19 digits, Luhn), ssn, phone (any ten digits after +1 or 1 or with brackets, otherwise ten
digits of the North American plan), phone_abroad (+ and 8 to 15 digits, not after +1; the first three stay), ipv4 (any four octets), iban
(mod 97), date (year first, day and month before a year, or with an English month name), email (letters and digits of the
local part).  Digits are those of ASCII.  Not found: numbers of ten or nine digits without any mark (they may be anything), IPv6
addresses, month names of other languages.

A candidate that fails validation stays, but hides nothing: the other kinds are tried where it begins, then shorter
readings of its groups, and the search goes on just after its first character.

Dates are permuted among those with as many digits in day and month, and a day over 12 among such days, so that a
date is written the same way with and without leading zeros and reads in the order of the original.

The key has no default: whoever has it can undo the pseudonyms.

Cases: a null text stays null with nothing found.  Empty text stays.  Whole texts are read, very long ones too.  Repeated rows
are equal again.  No rows give no rows.  All input columns are kept; result columns come last, underscores in front
where names are taken.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, small_batches

ROUNDS = 10
#: The session's setting that holds the key, as text.
KEY_SETTING = "spark.tidemark.pseudonym.key"

#: The English months.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + ")"
#: The shapes, in the order in which they are tried at a place.
_SHAPES = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?![0-9/-]|\.[0-9])",
    "named_date": rf"(?<![\w-])(?i:[0-9]{{1,2}} {_MONTH} [0-9]{{4}}|{_MONTH} [0-9]{{1,2}},? [0-9]{{4}})(?![\w-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<!\w)(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}|\+1[0-9]{10})(?![0-9])",
    "phone_abroad": r"(?<![\w+])\+[2-9][0-9]{0,14}(?:[ .-]?\([0-9]{1,5}\)[ .-]?[0-9]{0,14}|[ .-][0-9]{1,14}){0,7}(?![0-9])",
    "card": r"(?<![\w-])(?:[0-9]{13,19}|[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w-])",
}
_KIND_SHAPE = {kind: re.compile(shape) for kind, shape in _SHAPES.items()}
#: Where any shape may begin.
_SHAPE = re.compile("|".join(f"(?:{shape})" for shape in _SHAPES.values()).replace("([ .-])", "(?P<sep>[ .-])").replace("\\1", "(?P=sep)"))
#: What must be in a text for any shape to be there.
_HINT = re.compile(r"[0-9@]")


def feistel(value: int, size: int, key: bytes, tweak: str, backwards: bool = False) -> int:
    """A keyed permutation of 0..size-1, by a balanced Feistel network over the next power of four."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
            known = left if backwards else right
            digest = hashlib.blake2b(f"{tweak}|{size}|{r}|{known}".encode(), key=key[:64], digest_size=16).digest()
            mixed = int.from_bytes(digest, "big") & mask
            left, right = (right ^ mixed, left) if backwards else (right, left ^ mixed)
        value = (left << half) | right
        if value < size:
            return value


def _walk(value: int, size: int, valid: Callable[[int], bool], key: bytes, tweak: str, backwards: bool) -> int:
    """A permutation of the valid values: the network is applied until it meets one."""
    while True:
        value = feistel(value, size, key, tweak, backwards)
        if valid(value):
            return value


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _relaid(layout: str, digits: str) -> str:
    """The digits in the places of the layout's digits."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in layout)


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"[^0-9]", "", text)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    # the first digit (the network) stays, the last follows from the rest
    n = len(digits) - 2
    inner = lambda v: f"{v:0{n}d}"
    check = lambda body: next(c for c in "0123456789" if luhn(body + c))
    value = _walk(int(digits[1:-1]), 10**n, lambda v: len(set(digits[0] + inner(v))) > 1, key, f"card{len(digits)}{digits[0]}", back)
    body = digits[0] + inner(value)
    return _relaid(text, body + check(body))


def _ssn_valid(v: int) -> bool:
    area, group, serial = v // 1_000_000, v // 10_000 % 100, v % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    value = int(text.replace("-", ""))
    return _relaid(text, f"{_walk(value, 10**9, _ssn_valid, key, 'ssn', back):09d}") if _ssn_valid(value) else None


def _phone_valid(v: int) -> bool:
    return v // 10**7 >= 200 and v // 10**4 % 1000 >= 200


def _phone(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"[^0-9]", "", text)
    lead, own = digits[:-10], digits[-10:]
    if len(own) != 10 or lead not in ("", "1"):
        return None
    # numbers in the plan stay in it and others out of it, so that a number's pseudonym is the same in all layouts
    planned = _phone_valid(int(own))
    if not (planned or lead or "(" in text):
        return None
    return _relaid(text, f"{lead}{_walk(int(own), 10**10, lambda v: _phone_valid(v) == planned, key, 'phone', back):010d}")


def _phone_abroad(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"[^0-9]", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    # the country lies in the first three digits
    n = len(digits) - 3
    return _relaid(text, f"{digits[:3]}{feistel(int(digits[3:]), 10**n, key, f'abroad{digits[:3]}{n}', back):0{n}d}")


def _ipv4(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    # addresses of hosts become addresses of hosts, others others
    host = lambda v: 0 < v >> 24 < 224 and v >> 24 != 127
    value = int.from_bytes(bytes(parts), "big")
    return ".".join(str(b) for b in _walk(value, 1 << 32, lambda v: host(v) == host(value), key, "ipv4", back).to_bytes(4, "big"))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(text: str, key: bytes, back: bool) -> str | None:
    flat = text.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _mod97(flat) != 1:
        return None
    country, own = flat[:2], flat[4:]
    # digits stay digits and letters letters; the check digits follow
    bases = [10 if c.isdigit() else 26 for c in own]
    value = size = 0
    size = 1
    for c, base in zip(own, bases, strict=True):
        value = value * base + (int(c) if base == 10 else ord(c) - 65)
        size *= base
    value = feistel(value, size, key, f"iban{country}{''.join('d' if b == 10 else 'l' for b in bases)}", back)
    out = []
    for base in reversed(bases):
        value, d = divmod(value, base)
        out.append(str(d) if base == 10 else chr(65 + d))
    own = "".join(reversed(out))
    check = 98 - _mod97(f"{country}00{own}")
    rest = iter(f"{country}{check:02d}{own}")
    return "".join(c if c == " " else next(rest) for c in text)


_FIRST = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST + 1


def _date_class(d: datetime.date) -> tuple[bool, int]:
    """Dates of one class have as many digits in month and day, and read in the same orders."""
    return d.month < 10, 0 if d.day < 10 else 1 if d.day <= 12 else 2


def _date(text: str, key: bytes, back: bool) -> str | None:
    parts = re.split(r"[-/.]", text)
    marks = re.findall(r"[-/.]", text)
    # a date that reads either way is day first; what reads month first only has a day over 12
    for order in ["ymd"] if len(parts[0]) == 4 else ["dmy", "mdy"]:
        at = {c: i for i, c in enumerate(order)}
        try:
            day = datetime.date(*(int(parts[at[c]]) for c in "ymd"))
        except ValueError:
            continue
        if marks[0] != marks[1]:
            return None
        new = _other_date(day, key, back)
        if new is None:
            return None
        shown = {"y": f"{new.year:04d}", "m": str(new.month).zfill(len(parts[at["m"]])), "d": str(new.day).zfill(len(parts[at["d"]]))}
        out = [shown[c] for c in order]
        return out[0] + marks[0] + out[1] + marks[1] + out[2]
    return None


def _other_date(day: datetime.date, key: bytes, back: bool) -> datetime.date | None:
    """The pseudonym of a date, one of its class; None out of range."""
    value = day.toordinal() - _FIRST
    if not 0 <= value < _DAYS:
        return None
    alike = lambda v: _date_class(datetime.date.fromordinal(_FIRST + v)) == _date_class(day)
    return datetime.date.fromordinal(_FIRST + _walk(value, _DAYS, alike, key, "date", back))


def _named_date(text: str, key: bytes, back: bool) -> str | None:
    name, (first, year) = re.search(r"[A-Za-z]+", text)[0], re.findall(r"[0-9]+", text)
    month = next(i for i, m in enumerate(MONTHS, 1) if m[:3].lower() == name[:3].lower())
    try:
        new = _other_date(datetime.date(int(year), month, int(first)), key, back)
    except ValueError:
        return None
    if new is None:
        return None
    # a short name stays short, capitals stay; May is both, and becomes a short name
    word = MONTHS[new.month - 1] if len(name) > 3 else MONTHS[new.month - 1][:3]
    word = word.upper() if name.isupper() else word.lower() if name.islower() else word
    numbers = iter((str(new.day).zfill(len(first)), f"{new.year:04d}"))
    return re.sub(r"[0-9]+|[A-Za-z]+", lambda m: word if m[0].isalpha() else next(numbers), text)


def _email(text: str, key: bytes, back: bool) -> str | None:
    local, domain = text.rsplit("@", 1)
    # capitals are part of the layout: they stay in their places, and the value is that of the small letters
    capital = [c.isascii() and c.isupper() for c in local]
    local = "".join(c.lower() if big else c for c, big in zip(local, capital, strict=True))
    bases = [(10, "0") if c.isdigit() and c.isascii() else (26, "a") if "a" <= c <= "z" else None for c in local]
    value, size = 0, 1
    for c, base in zip(local, bases, strict=True):
        if base:
            value = value * base[0] + ord(c) - ord(base[1])
            size *= base[0]
    if size == 1:
        return None
    shape = "".join(b[1] if b else c for c, b in zip(local, bases, strict=True))
    value = feistel(value, size, key, f"email{shape}@{domain.lower()}", back)
    out = []
    for c, base, big in zip(reversed(local), reversed(bases), reversed(capital), strict=True):
        if base:
            value, d = divmod(value, base[0])
            c = chr(ord(base[1]) + d)
        out.append(c.upper() if big else c)
    return "".join(reversed(out)) + "@" + domain


_KINDS = {"email": _email, "iban": _iban, "ipv4": _ipv4, "date": _date, "named_date": _named_date, "ssn": _ssn, "phone": _phone, "phone_abroad": _phone_abroad, "card": _card}


def _replaced(text: str, at: int, key: bytes, backwards: bool) -> tuple[str, int, str] | None:
    """(kind, end, pseudonym) of the value that begins at this place."""
    for kind, shape in _KIND_SHAPE.items():
        match = shape.match(text, at)
        if not match:
            continue
        ends = [match.end()]
        if kind in ("card", "iban"):
            # without its last groups it may be a value beside which another number or word stands
            ends += [at + m.start() for m in reversed(list(re.finditer(r"[ -]", match[0])))]
        for end in ends:
            new = _KINDS[kind](text[at:end], key, backwards)
            if new is not None:
                return kind, end, new
    return None


def pseudonymise(text: str, key: bytes, backwards: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, stop) of each replaced value in the original."""
    if not _HINT.search(text):
        return text, []
    out, found, done, at = [], [], 0, 0
    while match := _SHAPE.search(text, at):
        start = match.start()
        got = _replaced(text, start, key, backwards)
        if got is None:
            at = start + 1
            continue
        kind, at, new = got
        out += [text[done:start], new]
        found.append((kind, start, at))
        done = at
    return ("".join(out) + text[done:], found) if found else (text, [])


def invert(text: str, key: bytes) -> str:
    """The text that pseudonymise() was given, if it held no other valid values."""
    return pseudonymise(text, key, backwards=True)[0]


_DRAWN: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key in the session's KEY_SETTING; without one a random key that lasts as long as the application."""
    held = spark.conf.get(KEY_SETTING, None)
    return held.encode() if held else _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def with_pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with pseudonymous text in text_col, and n_found, kinds (distinct, sorted, comma-joined) and found
    (kind, start and stop in the original text)."""
    small_batches(docs.sparkSession)
    held, n_found, kinds, found = (free_name(docs, x) for x in ("_private", "n_found", "kinds", "found"))

    @F.pandas_udf("text string, found array<struct<kind:string,start:int,stop:int>>")
    def replace(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [pseudonymise(t, key) if isinstance(t, str) else (None, []) for t in part]
            yield pd.DataFrame({"text": [d[0] for d in done], "found": [[{"kind": k, "start": a, "stop": b} for k, a, b in d[1]] for d in done]})

    out = docs.withColumn(held, replace.asNondeterministic()(F.col(text_col)))
    columns = [F.col(f"{held}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    spans = F.col(f"{held}.found")
    return out.select(*columns, F.size(spans).alias(n_found), F.array_join(F.array_sort(F.array_distinct(spans["kind"])), ",").alias(kinds), spans.alias(found))
