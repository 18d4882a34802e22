"""Caches over the tokenizers library: most words of a corpus repeat, so each is merged once in a while, not always."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

#: Entries of a generation; a worker holds two generations, about 70 MB at most.
GENERATION = 150_000
#: Longer pieces aren't kept.
LONGEST_KEPT = 64
#: White space that isn't ASCII's four kinds: the libraries' patterns disagree about some of it.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff\u180e]")
#: \\p{L} and \\p{N} among the first 256 characters.
LATIN_LETTERS, LATIN_NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"


def is_latin(text: str) -> bool:
    """Only the first 256 characters and no rare white space, so that Python's own patterns split as the libraries' do."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return RARE_SPACE.search(text) is None


def byte_characters() -> list[str]:
    """The printable character of each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: From bytes read as Latin-1 to printable characters.
SHOWN = {b: c for b, c in enumerate(byte_characters()) if chr(b) != c}


def shown(piece: str) -> str:
    """A piece's bytes as printable characters."""
    return piece if piece.isascii() and piece.isprintable() and " " not in piece else piece.encode().decode("latin-1").translate(SHOWN)


class TokenCache:
    """From pieces of text to ids as little-endian unsigned 32-bit bytes.

    Two generations bound its memory: a full one becomes the old one, from which pieces in use return to the new one.
    """

    def __init__(self, ids_of: Callable[[str], list[int]], generation: int = GENERATION):
        self.ids_of, self.generation, self.young, self.old = ids_of, generation, {}, {}

    def ids(self, pieces: list[str]) -> bytes:
        young = self.young
        if missing := set(pieces).difference(young):
            if len(young) > self.generation:
                self.old, self.young, missing = young, (young := {}), set(pieces)
            old, brief = self.old, []
            for x in missing:
                if (got := old.get(x)) is None:
                    a = array("I", self.ids_of(x))
                    got = a.tobytes()
                    if len(x) > LONGEST_KEPT:
                        brief.append(x)
                young[x] = got
            out = b"".join(map(young.__getitem__, pieces))
            for x in brief:
                del young[x]
            return out
        return b"".join(map(young.__getitem__, pieces))
