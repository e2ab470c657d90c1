"""Lines that left one place and stand in another: blocks within a file, blocks between files, then single lines."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from ..constants import MIN_MOVE_BLOCK_CONTENT_TOKENS, MIN_MOVE_BLOCK_LINES, MOVE_SEED_MAX_CANDIDATES, SINGLE_LINE_MOVE_MIN_CONTENT_TOKENS
from .hunks import Line


@dataclass
class Side:
    """One version of a file: its lines, which are free (not yet matched), which of these a rewrite left, and its pair."""

    lines: list[Line]
    pair: int | None = None
    free: list[bool] = field(default_factory=list)
    rewritten: list[bool] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.free = self.free or [True] * len(self.lines)
        self.rewritten = self.rewritten or [False] * len(self.lines)


def _rank(old: list[Side], block: tuple[int, int, int, int, int]) -> tuple:
    """Order in which blocks are taken: most lines, most content, nearest, then first."""
    f, i, g, j, size = block
    return (-size, -sum(x.content for x in old[f].lines[i : i + size]), abs(i - j), f, i, g, j)


def _enough(old: list[Side], block: tuple[int, int, int, int, int]) -> bool:
    f, i, _, _, size = block
    return size >= MIN_MOVE_BLOCK_LINES and sum(x.content for x in old[f].lines[i : i + size]) >= MIN_MOVE_BLOCK_CONTENT_TOKENS


def _runs(old: list[Side], new: list[Side], block: tuple[int, int, int, int, int]) -> list[tuple[int, int, int, int, int]]:
    """The parts of a block that are still free on both sides."""
    f, i, g, j, size = block
    out, first = [], None
    for k in range(size + 1):
        ok = k < size and old[f].free[i + k] and new[g].free[j + k]
        if ok and first is None:
            first = k
        elif not ok and first is not None:
            out.append((f, i + first, g, j + first, k - first))
            first = None
    return out


def blocks(old: list[Side], new: list[Side], same: bool) -> list[tuple[int, int, int, int, int]]:
    """(old file, old line, new file, new line, lines) of maximal runs of equal free lines that some rare line starts."""
    places: dict = defaultdict(list)
    for g, side in enumerate(new):
        for j, line in enumerate(side.lines):
            if side.free[j]:
                places[line.print].append((g, j))
    # seeds by diagonal; runs along a diagonal that hold a seed
    seeds: dict[tuple[int, int, int], list[int]] = defaultdict(list)
    for f, side in enumerate(old):
        for i, line in enumerate(side.lines):
            if side.free[i]:
                found = [(g, j) for g, j in places.get(line.print, ()) if (side.pair is not None and side.pair == new[g].pair) == same]
                if len(found) <= MOVE_SEED_MAX_CANDIDATES:
                    for g, j in found:
                        seeds[f, g, i - j].append(i)
    out = []
    for (f, g, shift), starts in seeds.items():
        a, b = old[f], new[g]
        equal = lambda i: 0 <= i < len(a.lines) and 0 <= i - shift < len(b.lines) and a.free[i] and b.free[i - shift] and a.lines[i].print == b.lines[i - shift].print  # noqa: E731, B023
        done = -1
        for i in starts:
            if i <= done:
                continue
            low = i
            while equal(low - 1):
                low -= 1
            done = i
            while equal(done + 1):
                done += 1
            block = (f, low, g, low - shift, done - low + 1)
            if _enough(old, block):
                out.append(block)
    return out


def detect(old: list[Side], new: list[Side]) -> list[tuple[int, int, int, int, str]]:
    """(old file, old line, new file, new line, layer). Files must be in path order, which breaks ties. Taken lines lose ``free``."""
    out: list[tuple[int, int, int, int, str]] = []
    for same, layer in ((True, "intra_file_move"), (False, "cross_file_move")):
        heap = [(_rank(old, b), b) for b in blocks(old, new, same)]
        heapq.heapify(heap)
        while heap:
            _, block = heapq.heappop(heap)
            left = _runs(old, new, block)
            if left != [block]:
                for part in left:
                    if _enough(old, part):
                        heapq.heappush(heap, (_rank(old, part), part))
                continue
            f, i, g, j, size = block
            for k in range(size):
                old[f].free[i + k] = new[g].free[j + k] = False
                out.append((f, i + k, g, j + k, layer))
    partner = {side.pair: g for g, side in enumerate(new) if side.pair is not None}
    for f, side in enumerate(old):
        if side.pair is None or side.pair not in partner:
            continue
        g = partner[side.pair]
        target = new[g]
        here, there = Counter(x.print for x in side.lines), Counter(x.print for x in target.lines)
        at = {x.print: j for j, x in enumerate(target.lines)}
        for i, line in enumerate(side.lines):
            key = line.print
            if side.free[i] and not side.rewritten[i] and line.content >= SINGLE_LINE_MOVE_MIN_CONTENT_TOKENS and here[key] == 1 and there[key] == 1:
                j = at[key]
                if target.free[j] and not target.rewritten[j]:
                    side.free[i] = target.free[j] = False
                    out.append((f, i, g, j, "intra_file_move"))
    return out
