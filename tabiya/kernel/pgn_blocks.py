"""What a block of a game file does to whatever state it is entered in, so that the blocks of one file can be read by many tasks.

Where a record begins depends on whether a comment or variation is open, which only the file's start tells. A block's effect is therefore a table
from each state that it may be entered in to the state that it leaves: a comment open or not, and how many variations. From a depth `need` on,
which the block never comes down from, the effect is the same but for the depth itself, so the table is finite. Effects compose; folded over a file's
blocks in order they give the state in which each one is entered, and the number of its first record.

Records: a tag after move text begins one. A stretch of lines is known by how many records begin in it, and by whether its first and last
line that counts is a tag or move text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from tabiya.kernel import pgn

TAG, TEXT = "t", "x"
#: A line without these can't change a state and is no tag.
_ODD, _MARKS = re.compile(r"[\[{}();]").search, re.compile("[{}();]").search


class Stretch(NamedTuple):
    """Records that begin after move text of the stretch itself, and what its first and last line that counts is ('' without any)."""

    starts: int = 0
    first: str = ""
    last: str = ""

    def then(self, other: Stretch) -> Stretch:
        joint = self.last == TEXT and other.first == TAG
        return Stretch(self.starts + other.starts + joint, self.first or other.first, other.last or self.last)


class Exit(NamedTuple):
    """The state that a block leaves, or damaged; of an entry from `need` on, depth is how much deeper it is than at the entry."""

    brace: bool
    depth: int
    damaged: bool
    lines: Stretch


class Effect(NamedTuple):
    """Exits by entry: of depths below need, by (brace, depth); of the others by brace."""

    need: int
    low: dict[tuple[bool, int], Exit]
    high: dict[bool, Exit]

    def of(self, brace: bool, depth: int) -> Exit:
        if depth < self.need:
            return self.low[brace, depth]
        found = self.high[brace]
        return found if found.damaged else found._replace(depth=depth + found.depth)


def is_tag(line: str) -> bool:
    return "[" in line and pgn._TAG(line.strip(" \t\f\v")) is not None


def kind(line: str, brace: bool, depth: int) -> str:
    """What a line counts as in a state: tag, text or nothing."""
    if not brace and not depth and is_tag(line):
        return TAG
    return TEXT if brace or line.strip() else ""


def turn(line: str, brace: bool) -> tuple[bool, bool, int, int]:
    """Whether a line ends a comment that isn't open, whether one is open after it, by how much it is deeper then, and how far it comes down meanwhile."""
    marks = pgn._MARK("{" + line if brace else line)
    depth = least = 0
    for m in marks:
        if m in "()":
            depth += 1 if m == "(" else -1
            least = min(least, depth)
    return "}" in marks, bool(marks) and marks[-1].startswith("{") and not marks[-1].endswith("}"), depth, -least


class _Run:
    """Entries whose states have become the same, each with its stretch until then. A deep run's depth counts from the entry's, which is at least `need`."""

    def __init__(self, entry, brace: bool, depth: int, deep: bool):
        self.entries, self.brace, self.depth, self.deep, self.need, self.lines = [(entry, Stretch())], brace, depth, deep, 0, Stretch()

    def absorb(self, other: _Run) -> None:
        self.entries = [(e, s.then(r.lines)) for r in (self, other) for e, s in r.entries]
        self.need, self.lines = max(self.need, other.need), Stretch()

    def step(self, line: str, odd: bool) -> bool:
        """Takes a line; whether the source isn't damaged by it."""
        if self.deep:  # in a variation always, so nothing is a tag
            what = TEXT if self.brace or line.strip() else ""
            if odd and not self.brace and is_tag(line):
                self.need = max(self.need, 1 - self.depth)
        else:
            what = kind(line, self.brace, self.depth)
        if odd and what == TEXT:
            bad, brace, more, drop = turn(line, self.brace)
            if self.deep:
                self.need = max(self.need, drop - self.depth)
            if bad or (not self.deep and self.depth < drop):
                return False
            self.brace, self.depth = brace, self.depth + more
        if what:
            self.lines = self.lines.then(Stretch(0, what, what))
        return True


def _short(lines: Iterable[str]) -> Iterator[str]:
    """Lines with the same effect: all plain tags are one, and of lines between that can't change a state, one stays, with text if any has."""
    plain = None
    for line in lines:
        if _ODD(line):
            if plain is not None:
                yield plain
            plain = None
            yield line if _MARKS(line) or not is_tag(line) else '[T ""]'
        elif plain != "x":
            plain = "x" if line.strip() else ""
    if plain is not None:
        yield plain


def effect(lines: Iterable[str]) -> Effect:
    """The effect of a block's lines."""
    lines = list(_short(lines))
    deep = _exits(lines, [((b, None), b, 0, True) for b in (False, True)])
    need = max(n for _, n in deep.values())
    low = _exits(lines, [((b, d), b, d, False) for b in (False, True) for d in range(need)])
    return Effect(need, {e: x for e, (x, _) in low.items()}, {e[0]: x for e, (x, _) in deep.items()})


def _exits(lines: list[str], entries: list[tuple]) -> dict:
    """Exit and need by entry. Runs that come to the same state go on as one."""
    live, found = [_Run(*e) for e in entries], {}

    def leave(run: _Run, damaged: bool) -> None:
        for e, s in run.entries:
            found[e] = Exit(run.brace, run.depth, damaged, s.then(run.lines)), run.need

    for line in lines:
        odd, changed = _ODD(line) is not None, False
        for run in list(live):
            before = (run.brace, run.depth)
            if not run.step(line, odd):
                live.remove(run)
                leave(run, True)
            changed |= before != (run.brace, run.depth)
        if changed and len(live) > 1:
            by: dict[tuple, _Run] = {}
            for run in live:
                same = by.setdefault((run.brace, run.depth), run)
                if same is not run:
                    same.absorb(run)
            live = list(by.values())
    for run in live:
        leave(run, False)
    return found


class Entry(NamedTuple):
    """How a block is entered: the state, whether move text is open, the number of the open record, and whether the file is damaged before."""

    brace: bool = False
    depth: int = 0
    text: bool = False
    seq: int = 0
    damaged: bool = False

    def after(self, x: Effect) -> Entry:
        if self.damaged:
            return self
        out = x.of(self.brace, self.depth)
        starts = out.lines.starts + (self.text and out.lines.first == TAG)
        return Entry(out.brace, out.depth, out.lines.last == TEXT if out.lines.last else self.text, self.seq + starts, out.damaged)
