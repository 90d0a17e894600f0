"""Cutting a text where the tokenizers' split pattern surely cuts it, so that what repeats is encoded once."""

from __future__ import annotations

from collections.abc import Callable

import regex
from public_tokenizers import PATTERN

#: White space that could stand before a blank; then the pattern's own split decides.
SPACES = [chr(c) for c in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)]
BEFORE_BLANK = [s + " " for s in SPACES]
SPLIT = regex.compile(PATTERN)
#: Neither letters, digits nor white space: a run of them after a letter is one match.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def pieces(text: str) -> list[str]:
    """The text in order, cut at matches of PATTERN; a piece may hold several matches but never a part of one.

    A blank that follows no white space starts a match: the blank goes with what follows it, or is part of a
    run of white space, which starts there. So a text without white space before a blank is cut before each blank.
    """
    if any(x in text for x in BEFORE_BLANK):
        return SPLIT.findall(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def matches_of(piece: str) -> list[str]:
    """The matches of PATTERN in a piece; letters after a blank or alone are one."""
    return [piece] if (piece[1:] if piece[0] == " " else piece).isalpha() else SPLIT.findall(piece)


def all_matches(parts: list[str]) -> list[list[str]]:
    """matches_of() each piece; letters after a blank, and marks at their end, are told without the pattern."""
    out = []
    for p in parts:
        if p[0] == " " and len(p) > 1:
            if p[1:].isalpha():
                out.append([p])
                continue
            word = p.rstrip(MARKS)
            if word[1:].isalpha():
                out.append([word, p[len(word) :]])
                continue
        out.append(matches_of(p))
    return out


class Memo:
    """Encoded pieces in two generations: when the young one is full it becomes the old one, so what recurs stays and memory is bounded.

    ``limit`` bounds the bytes of a generation, ``ENTRY`` standing for an entry's objects and its place in the table. What is longer than
    ``LONGEST`` characters is encoded anew each time.
    """

    ENTRY, LONGEST = 160, 256

    def __init__(self, limit: int = 16 << 20):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit, self.size = limit, 0

    def encode(self, parts: list[str], make: Callable[[list[str]], list[bytes]]) -> bytes:
        """The encoded pieces, joined; make() encodes the ones that are not known."""
        return b"".join(self.each(parts, make))

    def each(self, parts: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The encoded pieces; make() encodes the ones that are not known."""
        found = list(map(self.young.get, parts))
        if None in found:
            missing = dict.fromkeys([p for p, f in zip(parts, found, strict=True) if f is None])
            if self.old:
                missing |= {p: f for p in missing if (f := self.old.get(p)) is not None}
            new = [p for p, f in missing.items() if f is None]
            missing |= zip(new, make(new), strict=True)
            found = [missing[p] if f is None else f for p, f in zip(parts, found, strict=True)]
            for p, f in missing.items():
                self.keep(p, f)
        return found

    def get(self, piece: str) -> bytes | None:
        return found if (found := self.young.get(piece)) is not None else self.old.get(piece)

    def keep(self, piece: str, encoded: bytes) -> None:
        n = len(piece)
        if n <= self.LONGEST:
            self.young[piece] = encoded
            self.size += self.ENTRY + 2 * n + len(encoded)
            if self.size > self.limit:
                self.old, self.young, self.size = self.young, {}, 0
