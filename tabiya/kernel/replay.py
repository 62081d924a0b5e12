"""Replaying many games at once, ply by ply, with bitboards: one column for each kind of piece, one row for each game.

All games begin at the start position, so at each ply the same side moves. A token is read once for all games that have it; its candidates are the
pieces that its target square sees over the occupied squares, and each candidate's king safety is tested for all games together. What the columns
can't read (a token whose fields don't fit) goes to board.parse_san(), so the results are those of board.mainline().

Sliding pieces: along files and diagonals, subtracting the piece from the occupied squares of its line borrows up to the first one in the way, and the
byte-swapped board gives the other direction; along rows, a table by the row's eight bits.
"""

from __future__ import annotations

from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tabiya.kernel import board
from tabiya.kernel.board import BISHOP, KING, KING_TO, KNIGHT, KNIGHT_TO, LETTERS, PAWN, PAWN_FROM, QUEEN, ROOK, Board, name_of, square

U = np.uint64
ZERO, ONE = U(0), U(1)


def _mask(squares) -> np.uint64:
    return U(sum(1 << s for s in squares))


def _table(of) -> np.ndarray:
    return np.array([_mask(of(s)) for s in range(64)], U)


BIT = np.array([1 << s for s in range(64)], U)
TWICE, TWICE_SWAPPED = BIT << ONE, BIT.byteswap() << ONE
FILE_LINE = _table(lambda s: (t for t in range(64) if t % 8 == s % 8 and t != s))
RISING = _table(lambda s: (t for t in range(64) if t // 8 - t % 8 == s // 8 - s % 8 and t != s))
FALLING = _table(lambda s: (t for t in range(64) if t // 8 + t % 8 == s // 8 + s % 8 and t != s))
KNIGHTS, KINGS = _table(lambda s: KNIGHT_TO[s]), _table(lambda s: KING_TO[s])
PAWNS = {side: _table(lambda s, side=side: PAWN_FROM[side][s]) for side in (1, -1)}
#: By a square's file or row from 1 on; 0 holds all squares.
FILES = np.array([(1 << 64) - 1, *(int(_mask(range(f, 64, 8))) for f in range(8))], U)
ROWS = np.array([(1 << 64) - 1, *(0xFF << 8 * r for r in range(8))], U)
KEEP = np.array(board._KEEP, np.int64)


def _row_attacks() -> np.ndarray:
    out = np.zeros((8, 256), U)
    for x in range(8):
        for occupied in range(256):
            for step in (-1, 1):
                y = x + step
                while 0 <= y < 8:
                    out[x, occupied] |= U(1 << y)
                    if occupied >> y & 1:
                        break
                    y += step
    return out.ravel()


ROW_ATTACKS = _row_attacks()


def _line(line: np.ndarray, s: np.ndarray, occupied: np.ndarray) -> np.ndarray:
    line = line[s]
    inside = occupied & line
    return ((inside - TWICE[s]) ^ (inside.byteswap() - TWICE_SWAPPED[s]).byteswap()) & line


def diagonal(s: np.ndarray, occupied: np.ndarray) -> np.ndarray:
    return _line(RISING, s, occupied) | _line(FALLING, s, occupied)


def straight(s: np.ndarray, occupied: np.ndarray) -> np.ndarray:
    shift = (s & 56).astype(U)
    row = (occupied >> shift & U(255)).astype(np.int64)
    return _line(FILE_LINE, s, occupied) | ROW_ATTACKS[(s & 7) * 256 + row] << shift


def place(bit: np.ndarray) -> np.ndarray:
    """The square of a single bit (of none: 64)."""
    return np.bitwise_count(bit - ONE).astype(np.int64)


def lowest(bits: np.ndarray) -> np.ndarray:
    return bits & (~bits + ONE)


# What a token asks for. SHORT and LONG castle; COORDINATES name both squares.
NOTHING, SHORT, LONG, COORDINATES = 0, 7, 8, 9


class Token(NamedTuple):
    kind: int = NOTHING
    file: int = -1
    row: int = -1
    capture: int = 0
    target: int = 0
    promotion: int = 0
    start: int = 0


def read_token(token: str) -> Token:
    t = board.normalize(token)
    if t in ("O-O", "O-O-O"):
        return Token(LONG if t == "O-O-O" else SHORT)
    if found := board._PAWN_MOVE(t):
        file, capture, target, promotion = found.groups()
        return Token(PAWN, "abcdefgh".index(file) if file else -1, -1, int(bool(capture)), square(target), LETTERS.index(promotion) if promotion else 0)
    if found := board._PIECE(t):
        letter, file, row, capture, target = found.groups()
        return Token(LETTERS.index(letter), "abcdefgh".index(file) if file else -1, int(row) - 1 if row else -1, int(bool(capture)), square(target))
    u = token.strip().lower().replace("-", "").replace("x", "").rstrip("+#?!")
    if len(u) in (4, 5) and square(u[:2]) >= 0 and square(u[2:4]) >= 0:
        q = " pnbrqk".find(u[4]) if len(u) == 5 else 0
        if q not in (-1, 1, 6):
            return Token(COORDINATES, target=square(u[2:4]), promotion=q, start=square(u[:2]))
    return Token()


class Games:
    """The positions of many games at the same ply."""

    def __init__(self, n: int):
        start = Board.start().sq
        self.id = np.arange(n)
        self.sq = np.tile(np.array(start, np.int8), (n, 1))
        self.kinds = [np.zeros(n, U), *(np.full(n, _mask(s for s in range(64) if abs(start[s]) == k)) for k in range(1, 7))]
        self.of = {side: np.full(n, _mask(s for s in range(64) if start[s] * side > 0)) for side in (1, -1)}
        self.king = {1: np.full(n, 4), -1: np.full(n, 60)}
        self.castle, self.ep, self.side = np.full(n, 15), np.full(n, -1), 1

    def keep(self, rows: np.ndarray) -> None:
        self.id, self.sq, self.castle, self.ep = self.id[rows], self.sq[rows], self.castle[rows], self.ep[rows]
        self.kinds = [x[rows] for x in self.kinds]
        for by in (self.of, self.king):
            for side in by:
                by[side] = by[side][rows]

    def scalar(self, i: int) -> Board:
        return Board(self.sq[i].tolist(), self.side, int(self.castle[i]), int(self.ep[i]))

    def hit(self, i: np.ndarray, s: np.ndarray, by: int, occupied: np.ndarray, gone: np.ndarray | np.uint64 = ZERO) -> np.ndarray:
        """Whether pieces of side `by`, but for those that are gone, attack square s of games i."""
        kinds, theirs = self.kinds, self.of[by][i] & ~gone
        found = PAWNS[by][s] & kinds[PAWN][i] | KNIGHTS[s] & kinds[KNIGHT][i] | KINGS[s] & kinds[KING][i]
        queens = kinds[QUEEN][i]
        found |= diagonal(s, occupied) & (kinds[BISHOP][i] | queens) | straight(s, occupied) & (kinds[ROOK][i] | queens)
        return (found & theirs) != ZERO

    def safe(self, i: np.ndarray, a: np.ndarray, b: np.ndarray, passing: np.ndarray | None = None) -> np.ndarray:
        """Whether the mover's king isn't attacked after a move from a to b; passing: the captured pawn's bit where it doesn't stand on b."""
        gone = BIT[b] if passing is None else BIT[b] | passing
        occupied = (self.of[1][i] | self.of[-1][i]) & ~BIT[a] & ~gone | BIT[b]
        king = self.king[self.side][i]
        return ~self.hit(i, np.where(king == a, b, king), -self.side, occupied, gone)

    def legal_sources(self, i: np.ndarray, b: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Those of the candidates (bits) from which a move to b leaves the king safe."""
        legal, rows, left = np.zeros(len(i), U), np.arange(len(i)), candidates
        while True:
            some = left != ZERO
            rows, left = rows[some], left[some]
            if not len(rows):
                return legal
            bit = lowest(left)
            ok = self.safe(i[rows], place(bit), b[rows])
            legal[rows[ok]] |= bit[ok]
            left = left ^ bit

    def legal_ep(self) -> np.ndarray:
        """The en-passant square where a capture there is legal, or -1."""
        out = np.full(len(self.id), -1)
        i = np.flatnonzero(self.ep >= 0)
        if len(i):
            ep = self.ep[i]
            beside = PAWNS[self.side][ep] & self.kinds[PAWN][i] & self.of[self.side][i]
            for _ in range(2):
                some = beside != ZERO
                i, ep, beside = i[some], ep[some], beside[some]
                if not len(i):
                    break
                bit = lowest(beside)
                ok = self.safe(i, place(bit), ep, BIT[ep - 8 * self.side])
                out[i[ok]] = ep[ok]
                beside = beside ^ bit
        return out

    def keys(self) -> np.ndarray:
        """board.position_key() of each, as two columns of signed numbers."""
        rows = np.empty((len(self.id), 67), np.uint8)
        rows[:, :64] = self.sq + 8
        rows[:, 64], rows[:, 65], rows[:, 66] = self.side + 2, self.castle, self.legal_ep() + 1
        data = rows.tobytes()
        found = b"".join([blake2b(data[k : k + 67], digest_size=16).digest() for k in range(0, len(data), 67)])
        return np.frombuffer(found, ">i8").reshape(-1, 2)

    def choose(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start (-1: no legal move fits), target, promotion and the squares of other pieces that could go there, by columns of Token."""
        n, side = len(self.id), self.side
        kind, file, row, capture, b, promotion, start = (tokens[:, c].copy() for c in range(7))
        at, chosen, others = np.arange(n), np.full(n, -1), np.zeros(n, U)
        own, theirs = self.of[side], self.of[-side]
        occupied = own | theirs
        home, last = (4, 7) if side > 0 else (60, 0)
        named = kind == COORDINATES
        if named.any():
            piece = self.sq[at, start].astype(np.int64) * side
            castles = (piece == KING) & (start == home) & (np.abs(b - start) == 2)
            kind = np.where(named, np.where(castles, np.where(b > start, SHORT, LONG), np.maximum(piece, 0)), kind)
            pawn, promotes = piece == PAWN, b // 8 == last
            kind[named & (promotion > 0) & ~(pawn & promotes)] = NOTHING
            promotion = np.where(named & pawn & promotes & (promotion == 0), QUEEN, promotion)
            across = start % 8 != b % 8
            file, row = np.where(named & (~pawn | across), start % 8, file), np.where(named & ~pawn, start // 8, row)
            capture = np.where(named, np.where(pawn, across, (occupied & BIT[b]) != ZERO), capture)

        i = np.flatnonzero((kind >= KNIGHT) & (kind <= KING))
        if len(i):
            to, k, full = b[i], kind[i], occupied[i]
            sees = np.where(k == KNIGHT, KNIGHTS[to], np.where(k == KING, KINGS[to], ZERO))
            for slides, moves in ((diagonal, (BISHOP, QUEEN)), (straight, (ROOK, QUEEN))):
                j = np.flatnonzero((k == moves[0]) | (k == moves[1]))
                if len(j):
                    sees[j] |= slides(to[j], full[j])
            mine = np.zeros(len(i), U)
            for x in range(KNIGHT, KING + 1):
                j = np.flatnonzero(k == x)
                mine[j] = self.kinds[x][i[j]]
            legal = self.legal_sources(i, to, np.where(own[i] & BIT[to] == ZERO, sees & mine & own[i], ZERO))
            fits = legal & FILES[file[i] + 1] & ROWS[row[i] + 1]
            ok = (np.bitwise_count(fits) == 1) & ((capture[i] == 1) == (theirs[i] & BIT[to] != ZERO)) & ((file[i] >= 0) | (row[i] >= 0) | (np.bitwise_count(legal) == 1))
            chosen[i[ok]], others[i[ok]] = place(fits[ok]), (legal & ~fits)[ok]

        i = np.flatnonzero((kind == PAWN) & np.where(b // 8 == last, (promotion >= KNIGHT) & (promotion <= QUEEN), promotion == 0))
        if len(i):
            to, pawns, ep = b[i], self.kinds[PAWN][i] & own[i], self.ep[i]
            back = to - 8 * side
            inside = (back >= 0) & (back < 64)
            takes = capture[i] == 1
            across = back // 8 * 8 + file[i]
            beside = np.abs(file[i] - to % 8) == 1
            passing = takes & (to == ep) & (occupied[i] & BIT[to] == ZERO) & (to // 8 == (5 if side > 0 else 2))
            ok_take = takes & inside & beside & ((theirs[i] & BIT[to] != ZERO) | passing)
            free = ~takes & inside & (occupied[i] & BIT[to] == ZERO)
            far = to - 16 * side
            one = BIT[np.clip(back, 0, 63)]
            two = BIT[np.clip(far, 0, 63)]
            step = free & (pawns & one != ZERO)
            leap = free & ~step & (occupied[i] & one == ZERO) & (far // 8 == (1 if side > 0 else 6)) & (pawns & two != ZERO)
            a = np.where(ok_take, across, np.where(step, back, np.where(leap, far, -1)))
            ok = a >= 0
            ok[ok] = pawns[ok] & BIT[a[ok]] != ZERO
            ok &= ~named[i] | (a == start[i])
            j = np.flatnonzero(ok)
            fine = self.safe(i[j], a[j], to[j], np.where(passing[j], BIT[np.clip(to[j] - 8 * side, 0, 63)], ZERO))
            chosen[i[j[fine]]] = a[j[fine]]

        for what, right, rook, empty, over, to in ((SHORT, 1, 3, (1, 2), 1, 2), (LONG, 2, -4, (-1, -2, -3), -1, -2)):
            i = np.flatnonzero(kind == what)
            if not len(i):
                continue
            b[i] = home + to
            ok = (self.castle[i] & (right if side > 0 else right * 4) != 0) & (self.sq[i, home] == KING * side) & (self.sq[i, home + rook] == ROOK * side)
            ok &= occupied[i] & _mask(home + x for x in empty) == ZERO
            i = i[ok]
            for s in (home, home + over):
                i = i[~self.hit(i, np.full(len(i), s), -side, occupied[i])]
            i = i[self.safe(i, np.full(len(i), home), np.full(len(i), home + to))]
            chosen[i] = home
        return chosen, b, promotion * (chosen >= 0), others

    def apply(self, a: np.ndarray, b: np.ndarray, promotion: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Makes a legal move in each game; the kind that moved (SHORT and LONG for castling) and whether it took a piece."""
        n, side = len(self.id), self.side
        at, own, theirs = np.arange(n), self.of[side], self.of[-side]
        kind = np.abs(self.sq[at, a]).astype(np.int64)
        taken = np.abs(self.sq[at, b]).astype(np.int64)
        passing = (kind == PAWN) & (b == self.ep) & (a % 8 != b % 8)
        caught = np.where(passing, b - 8 * side, b)
        taken[passing] = PAWN
        takes = np.flatnonzero(taken)
        bit = BIT[caught[takes]]
        theirs[takes] &= ~bit
        for k in range(PAWN, QUEEN + 1):
            j = taken[takes] == k
            self.kinds[k][takes[j]] &= ~bit[j]
        self.sq[takes, caught[takes]] = 0
        becomes = np.where(promotion > 0, promotion, kind)
        for k in range(PAWN, KING + 1):
            j = np.flatnonzero(kind == k)
            self.kinds[k][j] &= ~BIT[a[j]]
            j = np.flatnonzero(becomes == k)
            self.kinds[k][j] |= BIT[b[j]]
        own &= ~BIT[a]
        own |= BIT[b]
        self.sq[at, a] = 0
        self.sq[at, b] = becomes * side
        kings = np.flatnonzero(kind == KING)
        self.king[side][kings] = b[kings]
        for what, rook, to in ((SHORT, 3, 1), (LONG, -4, -1)):
            j = np.flatnonzero((kind == KING) & (b - a == 2 * to))
            if len(j):
                kind[j] = what
                corner, beside = a[j] + rook, a[j] + to
                change = BIT[corner] | BIT[beside]
                own[j] ^= change
                self.kinds[ROOK][j] ^= change
                self.sq[j, corner], self.sq[j, beside] = 0, ROOK * side
        self.castle = self.castle & KEEP[a] & KEEP[b]
        self.ep = np.where((kind == PAWN) & (np.abs(b - a) == 16), (a + b) // 2, -1)
        self.side = -side
        return kind, taken > 0

    def checks(self) -> np.ndarray:
        """0, 1 (check) or 2 (mate) of the side that is to move."""
        n, side = len(self.id), self.side
        out = self.hit(np.arange(n), self.king[side], -side, self.of[1] | self.of[-1]).astype(np.int64)
        i = np.flatnonzero(out)
        # Most kings in check have a square to go to; the other positions are looked at one by one.
        targets = KINGS[self.king[side][i]] & ~self.of[side][i]
        while len(i):
            some = targets != ZERO
            for k in i[~some].tolist():
                b = self.scalar(k)
                if not any(b.safe(m) for m in b.pseudo()):
                    out[k] = 2
            i, targets = i[some], targets[some]
            if not len(i):
                break
            bit = lowest(targets)
            stuck = ~self.safe(i, self.king[side][i], place(bit))
            i, targets = i[stuck], (targets ^ bit)[stuck]
        return out


def _text(code: int) -> str:
    check, promotion, takes, b, a, origin, kind = code & 3, code >> 2 & 7, code >> 5 & 1, code >> 6 & 63, code >> 12 & 63, code >> 18 & 3, code >> 20
    start = name_of(a)
    if kind in (SHORT, LONG):
        text = "O-O" if kind == SHORT else "O-O-O"
    elif kind == PAWN:
        text = (start[0] + "x" if takes else "") + name_of(b) + ("=" + LETTERS[promotion] if promotion else "")
    else:
        text = LETTERS[kind] + ("", start[0], start[1], start)[origin] + ("x" if takes else "") + name_of(b)
    return text + ("", "+", "#")[check]


class Replayed(NamedTuple):
    """Of all games' tokens, one game after the other: text codes, and keys and moves of the first plies; legal: by game."""

    legal: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    keys: np.ndarray
    moves: np.ndarray

    def sans(self) -> pa.Array:
        """Lists of canonical moves; null for games that aren't legal."""
        values, place_ = np.unique(self.codes, return_inverse=True)
        flat = pa.DictionaryArray.from_arrays(pa.array(place_.astype(np.int32)), pa.array([_text(x) for x in values.tolist()], pa.string())).cast(pa.string())
        return self._lists(flat, self.lengths, True)

    def edges(self, most: int | None) -> pa.Array:
        """Lists of (a, b, move, white) of the first `most` plies; empty for games that aren't legal."""
        ply = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        keep = np.repeat(self.legal, self.lengths) & (ply < (most if most is not None else len(ply) + 1))
        columns = [pa.array(self.keys[keep, 0].astype(np.int64)), pa.array(self.keys[keep, 1].astype(np.int64)), pa.array(self.moves[keep].astype(np.int32)), pa.array(ply[keep] % 2 == 0)]
        counts = np.minimum(self.lengths, most if most is not None else self.lengths) * self.legal
        return self._lists(pa.StructArray.from_arrays(columns, ["a", "b", "move", "white"]), counts, False)

    def _lists(self, flat: pa.Array, counts: np.ndarray, nulls: bool) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(~self.legal) if nulls else None)


def replay(tokens: pa.ListArray, most: int | None = None) -> Replayed:
    """Replays all games; one without tokens isn't legal. Keys are found for the first `most` plies."""
    n = len(tokens)
    lengths = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
    lengths[tokens.is_null().to_numpy(zero_copy_only=False)] = 0
    distinct = tokens.flatten().dictionary_encode()
    fields = np.array([read_token(x or "") for x in distinct.dictionary.to_pylist()], np.int64).reshape(-1, len(Token._fields))
    which = distinct.indices.fill_null(0).to_numpy() if len(distinct) else np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    legal = lengths > 0
    codes, moves, keys = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64), np.zeros((len(which), 2), np.int64)
    games, ply = Games(n), 0
    games.keep(np.flatnonzero(legal))
    while len(games.id):
        at = first[games.id] + ply
        if most is None or ply < most:
            keys[at] = games.keys()
        words = fields[which[at]]
        a, b, promotion, others = games.choose(words)
        lost = np.flatnonzero(a < 0)
        for k in lost[words[lost, 0] != NOTHING].tolist():
            m = board.parse_san(bd := games.scalar(k), distinct.dictionary[int(which[at[k]])].as_py())
            if m is not None:
                a[k], b[k], promotion[k] = m
                kind = abs(bd.sq[m[0]])
                if kind not in (PAWN, KING) or (kind == KING and abs(m[1] - m[0]) != 2):
                    others[k] = _mask(x for x in bd.sources(kind, m[1]) if x != m[0])
        if (a < 0).any():
            legal[games.id[a < 0]] = False
            good = np.flatnonzero(a >= 0)
            games.keep(good)
            at, a, b, promotion, others = at[good], a[good], b[good], promotion[good], others[good]
        kind, takes = games.apply(a, b, promotion)
        origin = np.where(others == ZERO, 0, np.where(others & FILES[a % 8 + 1] == ZERO, 1, np.where(others & ROWS[a // 8 + 1] == ZERO, 2, 3)))
        codes[at] = kind << 20 | origin << 18 | a << 12 | b << 6 | takes << 5 | promotion << 2 | games.checks()
        moves[at] = a | b << 6 | promotion << 12
        ply += 1
        if len(games.id) and (lengths[games.id] <= ply).any():
            games.keep(np.flatnonzero(lengths[games.id] > ply))
    return Replayed(legal, lengths, codes, keys, moves)


def mainlines(games: list[list[str]], most: int | None = None) -> list:
    """board.mainline() of each game."""
    found = replay(pa.array(games, pa.list_(pa.string())), most)
    edges = [[(e["a"], e["b"], e["move"], e["white"]) for e in x] for x in found.edges(most).to_pylist()]
    return [None if s is None else (s, e) for s, e in zip(found.sans().to_pylist(), edges, strict=True)]
