"""Names of people: folding and readings in Latin letters (Arrow functions: Spark has no Unicode normalization).

Each distinct value of a batch is worked on once.
"""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata
from collections.abc import Callable
from itertools import islice, product

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Cyrillic letters and their Latin readings.
READINGS = {
    "а": ["a"], "б": ["b"], "в": ["v"], "г": ["g"], "д": ["d"], "е": ["e"], "ё": ["e", "yo"], "ж": ["zh"], "з": ["z"], "и": ["i"], "й": ["i", "y"],
    "к": ["k"], "л": ["l"], "м": ["m"], "н": ["n"], "о": ["o"], "п": ["p"], "р": ["r"], "с": ["s"], "т": ["t"], "у": ["u"], "ф": ["f"], "х": ["kh", "h"],
    "ц": ["ts"], "ч": ["ch"], "ш": ["sh"], "щ": ["shch", "sch"], "ы": ["y"], "э": ["e"], "ю": ["yu", "iu"], "я": ["ya", "ia"], "ь": [""], "ъ": [""],
    "і": ["i"], "ї": ["i", "yi"], "є": ["e", "ye"], "ґ": ["g"], "ў": ["u"],
}
#: Other spellings of a Latin word's beginning and end.
STARTS = {"ye": ["e"], "yu": ["iu"], "ya": ["ia"]}
ENDS = {"ii": ["iy", "y"], "ei": ["ey"], "yi": ["y"]}
#: Readings of a word, and of a name, that are kept.
WORD_READINGS, NAME_READINGS = 16, 64
#: Choices of letters tried for one word.
MOST_CHOICES = 1 << 14


def unaccented(text: str) -> str:
    """Compatibility-decomposed, without combining marks, case-folded; anything but letters, digits and _ as single
    blanks, none at the ends."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w\s]", " ", text.casefold()).split())


def is_cyrillic(letter: str) -> bool:
    return "CYRILLIC" in unicodedata.name(letter, "")


def spellings(word: str) -> set[str]:
    """A Latin word and all that its beginnings and ends may change to, again and again."""
    found, fresh = {word}, [word]
    for current in fresh:  # grows while it is read
        others = [new + current[len(old) :] for old, options in STARTS.items() if current.startswith(old) for new in options]
        others += [current[: -len(old)] + new for old, options in ENDS.items() if current.endswith(old) for new in options]
        fresh += [x for x in dict.fromkeys(others) if x not in found]
        found.update(others)
    return found


def readings(word: str) -> list[str]:
    """Latin readings of a word in Cyrillic letters: the first in order of the alphabet."""
    letters = [READINGS.get(c.casefold(), [c.casefold()]) for c in word]
    return sorted({x for choice in islice(product(*letters), MOST_CHOICES) for x in spellings("".join(choice))})[:WORD_READINGS]


def variants(text: str) -> list[str]:
    """Folded forms of a name to look it up by, in order of the alphabet: its own and, if it holds Cyrillic letters, those
    of its readings. Forms without a letter are left out."""
    found = dict.fromkeys([unaccented(text)])
    if any(map(is_cyrillic, text)):
        words = re.findall(r"[^\W\d_]+|\d+|\s+|[^\w\s]", text)
        choices = [readings(w) if all(is_cyrillic(c) for c in w if c.isalpha()) else [w] for w in words]
        read: dict[str, None] = {}
        for choice in product(*choices):
            read.setdefault(unaccented("".join(choice)))
            if len(read) - ("" in read) >= NAME_READINGS:
                break
        found |= read
    return sorted(x for x in found if any(map(str.isalpha, x)))


def _of_distinct(function: Callable, kind: pa.DataType, column: pa.Array) -> pa.Array:
    encoded = column.dictionary_encode()
    return pa.array([function(x) for x in encoded.dictionary.to_pylist()], kind).take(encoded.indices)


def folded(text: str | Column) -> Column:
    """unaccented(text); null stays null."""

    @arrow_udf("string")
    def fold(column: pa.Array) -> pa.Array:
        return _of_distinct(unaccented, pa.string(), column)

    return fold(F.col(text) if isinstance(text, str) else text)


def name_variants(text: str | Column) -> Column:
    """array<string>: variants(text); null stays null."""

    @arrow_udf("array<string>")
    def read(column: pa.Array) -> pa.Array:
        return _of_distinct(variants, pa.list_(pa.string()), column)

    return read(F.col(text) if isinstance(text, str) else text)


#: A character reference that a semicolon ends.
CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def closed_references(text: str) -> str:
    """Text with the character references decoded that a semicolon ends; `&amp` alone, and unknown names, stay."""
    known = lambda m: m[1] == "#" or m[1:] in html.entities.html5
    return CLOSED.sub(lambda m: html.unescape(m[0]) if known(m[0]) else m[0], text)


def unescaped(text: Column, closed: bool = False) -> Column:
    """Text with HTML's character references decoded; null stays null. HTML lets some names stand without their semicolon
    (`&amp`); closed: those are left as they are."""
    function = closed_references if closed else html.unescape

    @arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        return pa.array([x if x is None or "&" not in x else function(x) for x in column.to_pylist()], pa.string())

    return decode(text)
