"""Sentences, masks and word lists that several operators on page text share."""

from __future__ import annotations

import re

import xxhash

#: Common words of the four languages of the corpus (fixed values).
COMMON = frozenset(
    "the of and in is was were to a an for with as by from on at that this these be are not or it its their than but each every no only while although during between across under once per both "
    "der die das den dem des und ist war waren von zu zum zur mit für auf im ein eine einer einem nicht oder aus nach seit bei über wie auch als trotz gegenüber durch "
    "le la les et de du est était un une dans pour par sur avec que qui ce cette ces aux au en ne pas ou depuis après comme sans selon "
    "el los las y del es fue una en con por para que se su sus al lo como desde tras sin según entre pese".split()
)
_WRAP = re.compile(r"(?<=[\w,;)])[ \t]*\n(?=[a-zà-öø-ÿ(])")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+(?=[^\sa-zà-öø-ÿ])")
_DIGIT = re.compile(r"\d|://|\w@\w")
_MARKS = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~’‘“”„«»…–—0123456789"})


def sentences(text: str) -> list[str]:
    """The sentences and lone lines of a text; a line that goes on in lower case is no end."""
    return [s for line in _WRAP.sub(" ", text).split("\n") for s in _SPLIT.split(line) if s.strip()]


def words(text: str) -> list[str]:
    """The words of a text in lower case, without digits and marks."""
    return text.lower().translate(_MARKS).split()


def mask(text: str) -> str:
    """``text`` in lower case with addresses, numbers and dates (#) and inner names (@) masked."""
    return " ".join("#" if not t.isalpha() and _DIGIT.search(t) else "@" if k and t[0].isupper() else t.lower() for k, t in enumerate(text.split()))


def digest(text: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)
