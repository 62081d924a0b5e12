"""Games replayed together have the moves, keys and faults of games replayed one by one."""

import random

import pyarrow as pa
import pytest

from tabiya.kernel import replay
from tabiya.kernel.board import LETTERS, Board, mainline, name_of, perft, uci

ODD = ["Ke9", "e4", "Nf3", "O-O", "0-0-0", "Qxd5", "exd6", "", "e8=Q", "Rad1", "b2c3", "a7a8q", "Nbd7", "e1g1", "--", "Kxe1", "e7-e5"]


def random_game(r, plies):
    """Legal moves in several spellings; some games get a token that may not fit."""
    b, out = Board.start(), []
    for _ in range(plies):
        moves = b.legal()
        if not moves:
            break
        # Captures, promotions and castling more often than chance would have them.
        rare = [m for m in moves if m[2] or b.sq[m[1]] or (abs(b.sq[m[0]]) == 6 and abs(m[1] - m[0]) == 2)]
        m = r.choice(rare) if rare and r.random() < 0.3 else r.choice(moves)
        san, x = b.san(m), r.random()
        if x < 0.04:
            san = uci(m)
        elif x < 0.07:
            san = name_of(m[0]) + "-" + name_of(m[1]) + (LETTERS[m[2]] if m[2] else "")
        elif x < 0.1:
            san = san.replace("=", "").rstrip("+#") + "!?"
        elif x < 0.13 and san[0] in "NBRQK":
            san = san[0] + name_of(m[0]) + ("x" if "x" in san else "") + name_of(m[1])
        out.append(san)
        b = b.apply(m)
    if r.random() < 0.15 and out:
        out[r.randrange(len(out))] = r.choice(ODD)
    return out


@pytest.mark.parametrize("most", [None, 30])
def test_random_games_equal_the_scalar_replay(most):
    r = random.Random(most or 7)
    games = [random_game(r, r.choice((3, 40, 90, 200))) for _ in range(110)] + [[], ["e4"], ["e5"]]
    want = [mainline(g, most) for g in games]
    assert replay.mainlines(games, most) == want and 3 < sum(w is None for w in want) < 60


def test_castling_en_passant_promotion_and_mate():
    lines = [
        "e4 e5 Nf3 Nc6 Bc4 Bc5 O-O Nf6 d3 d6 c3 O-O",
        "d4 d5 Nc3 Nc6 Bf4 Bf5 Qd3 Qd6 O-O-O O-O-O",
        "e4 a6 e5 d5 exd6 a5 dxc7 a4 cxb8=Q a3 Qxa8",
        "e4 a6 e5 d5 exd6 a5 dxc7 a4 cxd8N a3",
        "f3 e5 g4 Qh4#",
        "e4 e5 Qh5 Nc6 Bc4 Nf6 Qxf7#",
        "e4 e5 Ke2 Ke7 Ke1 Ke8 Nf3 Nc6 Bc4 Bc5 O-O",  # the king has moved
        "e4 f5 e5 d5 exf6",  # only the last double step may be taken
        "e4 e5 Nf3 Nc6 Nc3 Nf6 Nb5 Nb4 Nbd4 Nbd5",
    ]
    games = [x.split() for x in lines]
    found = replay.mainlines(games)
    assert found == [mainline(g) for g in games]
    assert [f is None for f in found] == [False] * 6 + [True, True, False] and found[4][0][-1] == "Qh4#" and found[2][0][-1] == "Qxa8"


def _count(b, depth, by_columns):
    """perft by the columns: a child counts if its move, spelled by its squares, is legal there."""
    total = 0
    for m in b.pseudo():
        if by_columns(b, m):
            total += 1 if depth == 1 else _count(b.apply(m), depth - 1, by_columns)
    return total


def test_perft_by_columns():
    def legal(b, m):
        g = replay.Games(1)
        g.side, g.sq[0], g.castle[0], g.ep[0] = b.side, b.sq, b.castle, b.ep
        for k in range(1, 7):
            g.kinds[k][0] = replay._mask(s for s in range(64) if abs(b.sq[s]) == k)
        for side in (1, -1):
            g.of[side][0] = replay._mask(s for s in range(64) if b.sq[s] * side > 0)
            g.king[side][0] = b.king(side)
        a, to, promotion, _ = g.choose(replay.np.array([replay.read_token(uci(m))], replay.np.int64))
        return (int(a[0]), int(to[0]), int(promotion[0])) == m

    kiwi = Board.from_fen("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq -")
    rook = Board.from_fen("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - -")
    promotions = Board.from_fen("n1n5/PPPk4/8/8/8/8/4Kppp/5N1N b - -")
    for b, depth in ((Board.start(), 2), (kiwi, 1), (rook, 2), (promotions, 1)):
        assert _count(b, depth, legal) == perft(b, depth)


def test_null_and_sliced_lists():
    games = pa.array([["x"], None, ["e4", None], ["e4", "e5"], []], pa.list_(pa.string()))
    found = replay.replay(games.slice(1), 1)
    assert found.sans().to_pylist() == [None, None, ["e4", "e5"], None] and [len(x) for x in found.edges(1).to_pylist()] == [0, 0, 1, 0]
    assert replay.mainlines([]) == []
