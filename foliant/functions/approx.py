"""Where a wording stands nearly in a text: places found by exact pieces, verified by bit-parallel edit distances.

A window is a stretch of the text from the start of a word to the end of one. It is near a pattern if their edit
distance (characters put in, left out or changed) is at most ``most``. Cut into one piece more than that, a pattern
has a piece that stands unchanged in every near window, so only the text around pieces is looked at: one pass forward, with
any start allowed, names the ends that may do; from each a pass back names the starts with their exact distances. Both
passes keep a column of the distance table in the bits of an integer. Where many ends may do, all of them are tried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

#: Share of a pattern's characters that may be off.
FUZZY = 0.05


def most_errors(size: int, share: float = FUZZY) -> int:
    return math.ceil(round(size * share, 9))


class Pattern:
    """A pattern's characters as bits."""

    def __init__(self, pattern: str):
        self.size, self.bits = len(pattern), {}
        for k, c in enumerate(pattern):
            self.bits[c] = self.bits.get(c, 0) | 1 << k

    def distances(self, text: Iterator[str], anchored: bool) -> Iterator[int]:
        """After each character, the distance of the pattern to the text so far (anchored) or to its best ending."""
        m = self.size
        full, top, get = (1 << m) - 1, 1 << (m - 1), self.bits.get
        up, down, score = full, 0, m
        for c in text:
            eq = get(c, 0)
            x = eq | down
            d = (((eq & up) + up) ^ up) | eq
            right, left = down | (full & ~(d | up)), d & up
            if right & top:
                score += 1
            elif left & top:
                score -= 1
            right = (right << 1 | anchored) & full
            left = left << 1 & full
            up, down = left | (full & ~(x | right)), right & x
            yield score


def pieces_of(pattern: str, n: int) -> list[tuple[int, str]]:
    """The pattern in n pieces of nearly the same size, with their places; empty ones if it is shorter than that."""
    cuts = [len(pattern) * k // n for k in range(n + 1)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:])]


def occurrences(text: str, piece: str) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def regions(text: str, pattern: str, most: int) -> list[tuple[int, int]]:
    """Ranges of the text, apart from each other, that hold every near window."""
    m, seen = len(pattern), []
    pieces = pieces_of(pattern, most + 1)
    if not all(p for _, p in pieces):
        return [(0, len(text))]
    for at, piece in pieces:
        seen += [(max(0, i - at - most), min(len(text), i - at + m + most)) for i in occurrences(text, piece)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(seen):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def near_windows(text: str, pattern: str, most: int) -> list[tuple[int, int, int]]:
    """Start, end and distance of every near window that is no further off than the nearest one, by place."""
    if not pattern or most < 0:
        return []
    ahead, back = Pattern(pattern), Pattern(pattern[::-1])
    found: list[tuple[int, int, int]] = []
    n = len(text)
    for a, b in regions(text, pattern, most):
        for end, low in enumerate(ahead.distances(iter(text[a:b]), False), a + 1):
            if low > most or end < n and text[end] != " " or text[end - 1] == " ":
                continue
            reach = max(0, end - len(pattern) - most)
            for k, d in enumerate(back.distances(iter(text[reach:end][::-1]), True), 1):
                start = end - k
                if d <= most and text[start] != " " and (start == 0 or text[start - 1] == " "):
                    if d < most:
                        most, found = d, [f for f in found if f[2] <= d]
                    found.append((start, end, d))
    return sorted({f for f in found if f[2] == most}) if found else []


def plain_places(text: str, piece: str) -> list[int]:
    """Places of a piece, none overlapping the one before."""
    found: list[int] = []
    at = text.find(piece) if piece else -1
    while at >= 0:
        found.append(at)
        at = text.find(piece, at + len(piece))
    return found
