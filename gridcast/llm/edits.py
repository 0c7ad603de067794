"""Edit distance over words: insertions, deletions and replacements, each one edit."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def distance(a: Sequence[Hashable], b: Sequence[Hashable], free_end: bool = False) -> int:
    """Edits that turn ``a`` into ``b``, or with ``free_end`` into the prefix of ``b`` nearest to it.

    A column of the distance table is kept as two bit sets, the places where it rises
    and falls by one, so a word of ``b`` costs a few operations on whole numbers of len(a) bits.
    """
    if not a:
        return 0 if free_end else len(b)
    places: dict[Hashable, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    every = (1 << len(a)) - 1
    bottom = 1 << (len(a) - 1)
    rises, falls = every, 0
    score = best = len(a)
    for word in b:
        same = places.get(word, 0)
        upright = same | falls
        across = ((((same & rises) + rises) ^ rises) | same) & every
        grows = falls | (every & ~(across | rises))
        shrinks = rises & across
        if grows & bottom:
            score += 1
        elif shrinks & bottom:
            score -= 1
            best = min(best, score)
        grows = (grows << 1 | 1) & every
        rises = ((shrinks << 1) | ~(upright | grows)) & every
        falls = grows & upright
    return best if free_end else score


def bounded(a: Sequence[Hashable], b: Sequence[Hashable], most: int, free_end: bool = False) -> int | None:
    """The distance, or None if it is beyond ``most``."""
    if not free_end and abs(len(a) - len(b)) > most:
        return None
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    if not free_end:
        while end < len(a) - start and end < len(b) - start and a[-1 - end] == b[-1 - end]:
            end += 1
    edits = distance(a[start : len(a) - end], b[start : len(b) - end], free_end)
    return edits if edits <= most else None
