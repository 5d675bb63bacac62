"""Format-preserving pseudonyms of personal numbers, dates and addresses by a keyed Feistel permutation.

A found value is validated, ranked within the values of its own format, permuted there by a Feistel network (cycle
walking keeps it inside), and written back in its format: equal values get equal pseudonyms in every document, and the
key undoes them. Formats, with their tests and what stays:

card     13-19 digits, plain, by fours, 4-6-5, 4-6-4; Luhn -> same length, same first digit, Luhn holds
phone    +1 (NXX) NXX-XXXX and its common spellings         -> country code and punctuation stay, N in 2-9
ssn      ddd-dd-dddd, area, group and serial valid          -> valid again
iban     country, check digits, mod 97                      -> country and character classes stay, mod 97 holds
date     yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy; 1900 to 2099   -> a date in the same spelling, 1900 to 2099
ipv4     four numbers up to 255, not zero-padded            -> four numbers up to 255
email    local part @ domain                                -> letters and digits of the local part; the rest stays

Where two formats could begin at one place the first in the order above that passes its test wins; spans never overlap.
Where none passes, the search goes on one group of letters or digits further. Numbers that fail their test stay as they
are, and so does every other character.

Cases: null text gives null text and no spans; empty texts stay; repeated rows and equal texts get equal results; a
text of any length is read whole. The key is a parameter and never stored in the output.
"""

from __future__ import annotations

import datetime
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

ROUNDS = 10


def _noise(message: bytes, key: bytes, size: int) -> bytes:
    """size keyed pseudo-random bytes of a message: one digest, or as many numbered ones as are needed."""
    if size <= 64:
        return hashlib.blake2b(message, key=key, digest_size=size).digest()
    seed = hashlib.blake2b(message, key=key).digest()
    return b"".join(hashlib.blake2b(seed + k.to_bytes(4, "big"), key=key).digest() for k in range(-(-size // 64)))


def feistel(value: int, size: int, key: bytes, format_name: str, inverse: bool = False) -> int:
    """Keyed permutation of range(size): a balanced Feistel network over the next even number of bits, walked on while
    the result lies outside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    tag = format_name.encode() + b"/%d/" % size
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    while True:
        left, right = value >> half, value & mask
        for i in order:
            seen = left if inverse else right
            mixed = int.from_bytes(_noise(tag + bytes([i]) + seen.to_bytes(width, "big"), key, width + 8), "big") & mask
            left, right = (right ^ mixed, left) if inverse else (right, left ^ mixed)
        value = left << half | right
        if value < size:
            return value


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _spelled(pattern: str, digits: str) -> str:
    """pattern with its digits replaced in order."""
    put = iter(digits)
    return "".join(next(put) if c.isdigit() else c for c in pattern)


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def _walk(value: int, size: int, key: bytes, name: str, valid, inverse: bool) -> int:
    """The permutation restricted to valid values."""
    while True:
        value = feistel(value, size, key, name, inverse)
        if valid(value):
            return value


def card(value: str, key: bytes, inverse: bool = False) -> str | None:
    digits = _digits(value)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or not int(digits):
        return None
    n = len(digits) - 2  # the first digit stays, the last one is the check digit
    body = digits[0] + f"{feistel(int(digits[1:-1]), 10**n, key, 'card' + digits[0], inverse):0{n}}"
    return _spelled(value, next(body + c for c in "0123456789" if luhn(body + c)))


def phone(value: str, key: bytes, inverse: bool = False) -> str | None:
    digits = _digits(value)
    prefix, local = digits[:-10], digits[-10:]
    if prefix not in ("", "1") or local[0] < "2" or local[3] < "2":
        return None
    valid = lambda v: f"{v:010}"[0] >= "2" and f"{v:010}"[3] >= "2"
    return _spelled(value, prefix + f"{_walk(int(local), 10**10, key, 'phone', valid, inverse):010}")


def ssn(value: str, key: bytes, inverse: bool = False) -> str | None:
    def valid(number: int) -> bool:
        area, group, serial = number // 10**6, number // 10**4 % 100, number % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    number = int(_digits(value))
    return _spelled(value, f"{_walk(number, 10**9, key, 'ssn', valid, inverse):09}") if valid(number) else None


def _iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02}"


def _mixed(text: str, key: bytes, name: str, inverse: bool) -> str:
    """Letters permuted as letters of the same case and digits as digits, all together as one mixed-radix number."""
    alphabets = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isalpha() else c for c in text]
    number, size = 0, 1
    for c, letters in zip(text, alphabets):
        number, size = number * len(letters) + letters.index(c), size * len(letters)
    shape = "".join("9" if len(x) == 10 else x[0] for x in alphabets)
    number, out = feistel(number, size, key, f"{name}{shape}", inverse), []
    for letters in reversed(alphabets):
        number, digit = divmod(number, len(letters))
        out.append(letters[digit])
    return "".join(reversed(out))


def iban(value: str, key: bytes, inverse: bool = False) -> str | None:
    plain = value.replace(" ", "")
    country, body = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, body) != plain[2:4]:
        return None
    body = _mixed(body, key, "iban" + country, inverse)
    put = iter(country + _iban_check(country, body) + body)
    return "".join(" " if c == " " else next(put) for c in value)


FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


def date(value: str, key: bytes, inverse: bool = False) -> str | None:
    form = "%Y-%m-%d" if value[4] == "-" else f"%d{value[2]}%m{value[2]}%Y"
    try:
        day = datetime.datetime.strptime(value, form).date().toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    return datetime.date.fromordinal(FIRST_DAY + feistel(day, DAYS, key, "date", inverse)).strftime(form)


def ipv4(value: str, key: bytes, inverse: bool = False) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (p[0] == "0" and p != "0") for p in parts):
        return None
    number = feistel(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ipv4", inverse)
    return ".".join(map(str, number.to_bytes(4, "big")))


def email(value: str, key: bytes, inverse: bool = False) -> str | None:
    local, _, domain = value.rpartition("@")
    return f"{_mixed(local, key, 'email', inverse)}@{domain}"


FORMATS = {"card": card, "phone": phone, "ssn": ssn, "iban": iban, "date": date, "ipv4": ipv4, "email": email}

#: Spellings of each format, in the order in which they are tried at one place.
SPELLINGS = [
    ("card", r"\d{13,19}(?!\w)"),
    ("card", r"\d{4}(?P<g1>[ -])\d{4}(?P=g1)\d{4}(?P=g1)\d{4}(?P=g1)\d{1,3}(?!\w|-\d)"),
    ("card", r"\d{4}(?P<g2>[ -])\d{4}(?P=g2)\d{4}(?P=g2)\d{1,7}(?!\w)"),
    ("card", r"\d{4}(?P<g3>[ -])\d{6}(?P=g3)\d{4,5}(?!\w)"),
    ("phone", r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"),
    ("ssn", r"\d{3}-\d\d-\d{4}(?![\w-])"),
    ("iban", r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("date", r"\d{4}-\d\d-\d\d(?![\w-])|\d\d(?P<mark>[/.])\d\d(?P=mark)\d{4}(?![\w/])"),
    ("ipv4", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"),
]
_EACH = [(name, re.compile(pattern, re.ASCII)) for name, pattern in SPELLINGS]
#: What no value follows, but that a card may follow the hyphen behind another group of a failed candidate.
_BEFORE = re.compile(r"[\w.+@/-]", re.ASCII)
#: Places where a value may begin.
NUMBERS = re.compile(rf"(?<!{_BEFORE.pattern})(?:{'|'.join(pattern for _, pattern in SPELLINGS)})", re.ASCII)
_GROUP = re.compile(r"[A-Za-z0-9]+")
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", re.ASCII)
_DIGIT = re.compile(r"\d\D{0,3}\d\D{0,3}\d", re.ASCII)


def _value_at(text: str, at: int, key: bytes, taken: list[tuple[int, int]], only: str | None = None) -> tuple[int, int, str, str] | None:
    """The first format whose value begins there, passes its test and leaves the taken places alone."""
    for name, pattern in _EACH:
        m = pattern.match(text, at) if only in (None, name) else None
        pseudonym = FORMATS[name](m[0], key) if m else None
        if pseudonym is not None and not any(s < m.end() and at < e for s, e in taken):
            return at, m.end(), name, pseudonym
    return None


def spans(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, format, pseudonym) of every validated value, in order, without overlap."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", email(m[0], key)) for m in EMAIL.finditer(text)]
    taken = [(s, e) for s, e, *_ in found]
    if _DIGIT.search(text):
        at = 0
        while m := NUMBERS.search(text, at):
            at, value = m.end(), _value_at(text, m.start(), key, taken)
            for group in _GROUP.finditer(text, m.start(), m.end()) if value is None else ():
                before = text[group.start() - 1] if group.start() > m.start() else "."
                if before == "-" or not _BEFORE.match(before):
                    value = _value_at(text, group.start(), key, taken, only="card" if before == "-" else None)
                if value is not None:
                    break
            if value is not None:
                found.append(value)
                at = value[1]
    return sorted(found)


def replaced(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for start, end, _, pseudonym in found:
        out += [text[at:start], pseudonym]
        at = end
    return "".join([*out, text[at:]])


def pseudonymise(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """df with private_text (text with pseudonyms) and private_spans (array of start, end, format; places in characters
    of the input text)."""

    @arrow_udf("struct<text:string,spans:array<struct<start:int,end:int,format:string>>>")
    def hidden(column: pa.Array) -> pa.Array:
        out = []
        for x in column:
            value = x.as_py()
            found = spans(value, key) if value else []
            out.append({"text": replaced(value, found) if found else value, "spans": [{"start": s, "end": e, "format": f} for s, e, f, _ in found]})
        kind = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("format", pa.string())])))])
        return pa.array(out, kind)

    out = df.withColumn("__hidden", hidden(F.col(text)))
    return out.withColumn("private_text", F.col("__hidden.text")).withColumn("private_spans", F.col("__hidden.spans")).drop("__hidden")
