"""String measures shared by matching operators."""

from __future__ import annotations

import re
import unicodedata

# Digits and signs typed in place of letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
# Letters that decompose to no base letter.
LETTERS = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")


def fold(s: str) -> str:
    """Compatibility form, without accents and invisible signs, in lower case."""
    s = _INVISIBLE.sub("", unicodedata.normalize("NFKD", s)).casefold()
    return "".join(c for c in s if not unicodedata.combining(c)).translate(LETTERS)


def unleet(word: str) -> str:
    """A word with digits among its letters read as the letters they look like; numbers stay."""
    letters = sum(c.isalpha() for c in word)
    return word.translate(LOOKALIKES) if letters and letters * 2 >= len(word) and letters < len(word) else word


def osa(a: str, b: str, most: int | None = None) -> int:
    """Edits (insertion, deletion, substitution, swap of neighbours) between two strings; most + 1 if more."""
    if a == b:
        return 0
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            row.append(v)
        if most is not None and min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return prev[-1]


def abbreviates(short: str, word: str) -> bool:
    """Whether short is made of the first letter and further letters of word, in their order."""
    if not short or short[0] != word[0] or len(short) >= len(word):
        return False
    rest = iter(word)
    return all(c in rest for c in short)
