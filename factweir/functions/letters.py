"""Letters and digits of a text with their places in it, and the search for quotes on that index.

Only what a text's letters and digits say decides whether a quote stands in it. The index is one string of them
and one packed array of places, built once a text; a quote is then a plain substring, and its span is read off
the places of its first and last letter.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np

from factweir.functions.text import TYPOGRAPHY, VANISHING

#: Bounds of a quote and of its pieces around an ellipsis, in characters.
LEAST, MOST, LEAST_SKELETON, LEAST_PIECE, MOST_GAP, MOST_SPAN = 20, 600, 14, 6, 400, 1200
#: An elision of words, and dots or lines that lead the eye along a row of a table.
ELISION = r"\s*(?:\[\s*(?:\.\s*){3}\]|\[\s*…\s*\]|\.\s*\.\s*\.|…)\s*"
LEADERS = r"(?:\.\s?){4,}|(?:…\s?){2,}|(?:_\s?){4,}"
#: What may follow a footnote's digits, and closing signs that it may stand behind.
AFTER_NOTE, BEFORE_NOTE = ".,;:)", ".,;:)”\"'"

_UNIFIED = str.maketrans({c: k for k, v in TYPOGRAPHY.items() for c in v} | dict.fromkeys(VANISHING))
_ASCII = np.array([chr(i).isalnum() for i in range(128)])
_NO_LETTERS = bytes(i for i in range(128) if not chr(i).isalnum())
_ELISION, _LEADERS = re.compile(ELISION), re.compile(LEADERS)


def normal(text: str) -> str:
    """Compatibility composition, typographic characters unified, white space collapsed, trimmed, lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_UNIFIED)
    return " ".join(text.lower().split())


@lru_cache(maxsize=1 << 16)
def letters_of(char: str) -> str:
    """The letters and digits that one character stands for, lower case: `fi` for a ligature, none for a sign."""
    if unicodedata.category(char)[0] not in "LN" or not char.isalnum():
        return ""
    return "".join(c for c in unicodedata.normalize("NFKC", char).lower() if c.isalnum())


def plain_letters(text: str) -> str:
    """Letters and digits of a text, lower case."""
    if text.isascii():
        return text.lower().encode().translate(None, _NO_LETTERS).decode()
    return indexed(text)[0]


def indexed(text: str) -> tuple[str, np.ndarray]:
    """Letters and digits of a text, lower case, and the place (from 0) of the character that each comes from."""
    if text.isascii():
        return plain_letters(text), _ASCII[np.frombuffer(text.encode(), np.uint8)].nonzero()[0].astype(np.int32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds, which = np.unique(points, return_inverse=True)
    folded = [letters_of(chr(k)) for k in kinds]
    counts = np.array([len(f) for f in folded])[which]
    return "".join([folded[k] for k in which]), np.repeat(np.arange(len(points), dtype=np.int32), counts)


@lru_cache(maxsize=1)
def _digit_runs() -> re.Pattern:
    digits = "".join(re.escape(chr(i)) for i in range(0x110000) if chr(i).isdigit())
    return re.compile(f"[{digits}]+")


def note_places(text: str) -> np.ndarray:
    """Places of the digits of footnote marks: one or two, on a lower-case letter or on a closing sign that
    follows a letter or a bracket, before white space, a closing sign or the end."""
    found: list[int] = []
    for m in _digit_runs().finditer(text):
        start, end = m.span()
        if end - start > 2 or not start or not (end == len(text) or text[end].isspace() or text[end] in AFTER_NOTE):
            continue
        before, second = text[start - 1], text[start - 2 : start - 1]
        if before.islower() or (before in BEFORE_NOTE and (second.isalpha() or second == ")")):
            found += range(start, end)
    return np.array(found, dtype=np.int32)


def _edge(text: str) -> int:
    """Signs that a text begins with, up to its first letter, digit or white space."""
    if text and (text[0].isspace() or letters_of(text[0])):
        return 0
    return next((i for i, c in enumerate(text) if c.isspace() or letters_of(c)), len(text))


class Source:
    """A text with its index; what a quote doesn't ask for isn't built."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def normal(self) -> str:
        return normal(self.text)

    @cached_property
    def letters(self) -> str:
        return plain_letters(self.text) if self.text.isascii() else self.index[0]

    @cached_property
    def index(self) -> tuple[str, np.ndarray]:
        return indexed(self.text)

    @cached_property
    def without_notes(self) -> tuple[str, np.ndarray] | None:
        """The index less the digits of footnote marks; null if there are none."""
        notes = note_places(self.text)
        if not len(notes):
            return None
        letters, places = self.index
        kept = ~np.isin(places, notes)
        return "".join(np.array(list(letters))[kept]), places[kept]

    def span(self, first: int, last: int, head: str, tail: str) -> tuple[int, int]:
        """From the first to the last letter's place, with as many signs beside them as the quote has."""
        start, end = first, last + 1
        for _ in range(_edge(head.strip())):
            if not start or self.text[start - 1].isspace() or letters_of(self.text[start - 1]):
                break
            start -= 1
        for _ in range(_edge(tail.strip()[::-1])):
            if end == len(self.text) or self.text[end].isspace() or letters_of(self.text[end]):
                break
            end += 1
        return start, end

    def elided(self, pieces: list[str]) -> tuple[int, int] | None:
        """The first place where all pieces follow each other, each the next one found within the gap."""
        wanted = [plain_letters(p) for p in pieces]
        if min(map(len, wanted)) < LEAST_PIECE or sum(map(len, wanted)) < LEAST_SKELETON:
            return None
        letters, places = self.index
        first = letters.find(wanted[0])
        while first >= 0:
            at = first + len(wanted[0])
            for w in wanted[1:]:
                here = letters.find(w, at, at + MOST_GAP + len(w))
                if here < 0:
                    break
                at = here + len(w)
            else:
                start, end = self.span(places[first], places[at - 1], pieces[0], pieces[-1])
                return (start, end) if end - start <= MOST_SPAN else None
            first = letters.find(wanted[0], first + 1)
        return None

    def find(self, quote: str) -> tuple[str, int, int] | None:
        """(method, start, end) of a quote: exact, loose, footnote or ellipsis; None where it doesn't stand or
        is too short or long. A quote with elisions that isn't found by pieces is sought as one."""
        plain = normal(quote).strip(" \"'")
        if not LEAST <= len(plain) <= MOST:
            return None
        if quote.count(".") > 3 or "…" in quote or quote.count("_") > 3:
            quote = _LEADERS.sub(" ", quote)
        pieces = [p for p in _ELISION.split(quote) if plain_letters(p)] if "." in quote or "…" in quote else []
        if len(pieces) > 1 and (at := self.elided(pieces)):
            return "ellipsis", *at
        wanted = plain_letters(quote)
        if len(wanted) < LEAST_SKELETON:
            return None
        at, index, method = self.letters.find(wanted), None, "footnote"
        if at >= 0:
            index, method = self.index, "exact" if plain in self.normal else "loose"
        elif index := self.without_notes:
            at = index[0].find(wanted)
        return (method, *self.span(index[1][at], index[1][at + len(wanted) - 1], quote, quote)) if at >= 0 else None
