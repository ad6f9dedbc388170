"""Word splitting of the ``word_bpe`` tokenizer, and a bounded word cache.

The file's normaliser is NFC, white-space runs to one space, lower case; its
pre-tokenizer cuts by the pattern below. White space always separates, so a
text can be cut at white space first and each piece looked up as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import regex

#: Fixed by the tokenizer's file.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_SPECIAL = re.compile("|".join(map(re.escape, SPECIAL)))
#: ASCII and Latin-1 without odd control characters: NFC and case are plain there,
#: and what ``str.split`` takes as white space is what the tokenizer takes.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


#: The same for Arrow, whose patterns need ``\\A`` and ``\\z`` for the ends of a
#: text. In lower-case texts the words that are not letters only; white space and
#: these part the others.
PLAIN_TEXT = r"\A[\t-\r -~À-ÖØ-öø-ÿ]*\z"
PLAIN_LOWER_SIGNS = r"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+)"


def normalise(text: str) -> str:
    text = regex.sub(r"\p{White_Space}+", " ", unicodedata.normalize("NFC", text))
    return text.replace("Σ", "σ").lower()  # each letter by itself: no final sigma


def split_special(text: str) -> list[str]:
    """Pieces of the raw text; special tokens stand at odd places."""
    if "<|" not in text:
        return [text]
    pieces, at = [], 0
    for m in _SPECIAL.finditer(text):
        pieces += [text[at : m.start()], m[0]]
        at = m.end()
    return [*pieces, text[at:]]


def words(piece: str) -> list[str]:
    """Words of a piece without special tokens."""
    if _PLAIN.fullmatch(piece):
        return _PLAIN_WORD.findall(piece.lower())
    return _WORD.findall(normalise(piece))


def chunks(piece: str) -> list[str]:
    """The piece cut at white space, such that the words of the chunks one
    after another are the words of the piece."""
    if _PLAIN.fullmatch(piece):
        return piece.split()
    return normalise(piece).split(" ") if piece else []


class Cache(dict):
    """A dict that computes what it lacks. Of two generations of ``size`` the
    older is forgotten when the younger is full; what is used moves up."""

    def __init__(self, make: Callable[[str], object], size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
