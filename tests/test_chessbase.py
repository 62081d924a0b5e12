import random

import pytest

from tabiya import sinks
from tabiya.kernel import chessbase as K
from tabiya.kernel.board import Board, parse_san
from tabiya.plans import games as G
from tabiya.sources import chessbase as S

TABLES = K.plain_tables()


def _tokens(line):
    b, out = Board.start(), b""
    for t in line.split():
        m = parse_san(b, t)
        out += K.encode_token(b, m).to_bytes(2, "little")
        b = b.apply(m)
    return out


def test_2cbh_tokens_are_distinct_and_round_trip():
    assert len(K.piece_indices()) == 7336 and len(set(K.piece_indices().values())) == 7336
    assert min(K.pawn_tokens(-1).values()) == max(K.pawn_tokens(1).values()) + 1 == 0xAE8D and max(K.pawn_tokens(-1).values()) < 0xB129
    assert K.decode_tokens(_tokens("e4 e5 Nf3 Nc6")) == ["e4", "e5", "Nf3", "Nc6"]
    r = random.Random(7)
    for _ in range(12):
        b = Board.start()
        for _ in range(80):
            legal = b.legal()
            if not legal:
                break
            tokens = [K.encode_token(b, m) for m in legal]
            assert None not in tokens and len(set(tokens)) == len(tokens)
            b = b.apply(r.choice(legal))
    with pytest.raises(ValueError):
        K.decode_tokens(b"\xff\xff")


def _one(b, pieces, m):
    """A CBH token of a move that the plain tables hold."""
    for token, (kind, n, dx, dy) in TABLES.one_byte.items():
        a = pieces.of[kind * b.side][n]
        turn = -1 if kind == K.PAWN and b.side < 0 else 1
        if a == m[0] and (a % 8 + dx * turn) % 8 + 8 * ((a // 8 + dy * turn) % 8) == m[1] and not m[2]:
            if (abs(m[1] - m[0]) == 2 and kind == K.KING) == (token in (K.SHORT, K.LONG)):
                return token
    return None


def _stream(line, wrap=None):
    b, pieces, out = Board.start(), K.Numbered(Board.start()), b""
    for i, t in enumerate(line.split()):
        m = parse_san(b, t)
        token = _one(b, pieces, m)
        if token is None:
            flip = lambda s: s % 8 * 8 + s // 8
            word = flip(m[0]) | flip(m[1]) << 6 | ({5: 0, 4: 1, 3: 2, 2: 3}[m[2]] if m[2] else 0) << 12
            back = {v: k for k, v in enumerate(TABLES.two_bytes)}
            out += bytes([(K.TWO_BYTES + i) & 255, (back[word >> 8] + i) & 255, (back[word & 255] + i) & 255])
        else:
            out += bytes([(token + i) & 255])
        pieces.move(m[0], m[1], m[2], b.side)
        if abs(b.sq[m[0]]) == K.KING and abs(m[1] - m[0]) == 2:
            home = m[0] // 8 * 8
            pieces.move(home + (7 if m[1] > m[0] else 0), home + (5 if m[1] > m[0] else 3))
        b = b.apply(m)
        if wrap and i == wrap[0]:
            out += bytes([(x + i + 1) & 255 if x in (K.PUSH, K.POP) else x for x in wrap[1]])
    return out


def test_cbh_streams():
    line = "e4 e5 Nf3 Nc6 Bb5 a6 Bxc6 dxc6 O-O Qd4 Nxd4 exd4 c3 dxc3 Qf3 cxb2 Qg3 bxa1=Q"
    assert K.decode_stream(_stream(line), Board.start(), TABLES) == (line.split(), 0)
    null = K.decode_stream(bytes([K.FILLER, K.NULL]), Board.start(), TABLES)
    assert null == (["--"], 0)
    for bad in (bytes([K.TWO_BYTES]), bytes([K.POP, 0]), bytes([K.SHORT])):
        with pytest.raises(ValueError):
            K.decode_stream(bad, Board.start(), TABLES)


def test_cbh_variation_keeps_the_main_line():
    main = _stream("e4 e5 Nf3 Nc6")
    after = K.Numbered(Board.start())
    b = Board.start().apply(parse_san(Board.start(), "e4"))
    after.move(12, 28)
    c5 = _one(b, after, parse_san(b, "c5"))
    # A variation's moves count like any other, so the bytes after it move on by one.
    inner = bytes([(K.PUSH + 1) & 255, (c5 + 1) & 255, (K.POP + 2) & 255])
    stream = main[:1] + inner + bytes((x + 1) & 255 for x in main[1:])
    assert K.decode_stream(stream, Board.start(), TABLES) == ("e4 e5 Nf3 Nc6".split(), 1)


def test_custom_start():
    bits = ""
    want = {4: K.KING, 60: -K.KING, 8: K.PAWN}
    codes = {K.KING: "10001", -K.KING: "11001", K.PAWN: "10110"}
    for s in range(64):
        bits += codes[want[s % 8 * 8 + s // 8]] if s % 8 * 8 + s // 8 in want else "0"
    data = bytes([0, 0x10, 0, 7]) + int(bits.ljust(192, "0"), 2).to_bytes(24, "big")
    b, number = K.custom_start(data)
    assert (b.fen(), number) == ("4k3/8/8/8/8/8/P7/4K3 b - -", 7)
    with pytest.raises(ValueError):
        K.custom_start(bytes([0, 0, 0, 1]) + b"\xff" * 24)


def test_loaded_tables():
    text = "move 0x10 N 1 1 2\nbyte " + " ".join(map(str, range(256)))
    assert K.load_tables(text).one_byte == {16: (K.KNIGHT, 1, 1, 2)}
    with pytest.raises(ValueError):
        K.load_tables("byte 1 2")


def test_2cbh_set(spark, tmp_path):
    games, heads = b"", bytes(192)
    for k, (line, flags, result) in enumerate([("e4 e5 Nf3 Nc6", 1, 2), ("d4 d5", 0, 1), ("d4 d5", 1, 1)]):
        stream = _tokens(line)
        rec = bytearray(192)
        rec[0], rec[88] = flags, result
        rec[8:16] = len(games).to_bytes(8, "little")
        rec[24:32], rec[32:40] = (0).to_bytes(8, "little"), (1).to_bytes(8, "little")
        rec[96:98] = (2600).to_bytes(2, "little")
        rec[188:191] = (2024 << 9 | 5 << 5 | 3).to_bytes(3, "little")
        heads += bytes(rec)
        games += (K.MAGIC if k < 2 else bytes(8)) + (len(stream) + 4).to_bytes(4, "little") + bytes(12) + K.STANDARD + stream
    person = lambda a, b: (bytes(4) + len(a).to_bytes(4, "little") + a + len(b).to_bytes(4, "little") + b).ljust(4234, b"\0")
    for ext, data in (("2cbh", heads), ("2cbg", games), ("2lid", bytes(184) + person(b"Doe", b"Jo") + person(b"Roe", b""))):
        (tmp_path / f"db.{ext}").write_bytes(data)
    rows = S.read_2cbh(spark, str(tmp_path))
    assert {r.reason: r.n for r in S.reasons(rows).collect()} == {"converted": 1, "inactive": 1, "header": 1}
    g = S.games(rows).collect()[0]
    assert g.movetext == "1. e4 e5 2. Nf3 Nc6 1-0" and g.tags["White"] == "Doe, Jo" and g.tags["Black"] == "Roe" and g.tags["Date"] == "2024.05.03"
    raw = G.raw_games(S.games(rows).selectExpr("*", "0 as src_rank"), G.Config(least_plies=4))
    assert raw.filter("status = 'kept'").first().toks == ["e4", "e5", "Nf3", "Nc6"]


def test_cbh_set(spark, tmp_path):
    stream = _stream("e4 e5 Nf3 Nc6")
    games = bytes(8) + (len(stream) + 4).to_bytes(4, "big") + stream + (0x80000000 | 4).to_bytes(4, "big")
    rec = bytearray(46)
    rec[0], rec[27], rec[29], rec[30] = 1, 0, 3, 2
    rec[1:5], rec[24:27], rec[31:33] = (8).to_bytes(4, "big"), (1999 << 9).to_bytes(3, "big"), (2500).to_bytes(2, "big")
    special = bytearray(rec)
    special[1:5] = (8 + 4 + len(stream)).to_bytes(4, "big")
    people = bytes(28) + bytes(9) + b"Doe".ljust(30, b"\0") + b"Jo\0xx".ljust(20, b"\0") + bytes(8)
    events = bytes(28) + bytes(9) + b"Open".ljust(40, b"\0") + b"Rome".ljust(30, b"\0") + bytes(20)
    for ext, data in (("cbh", bytes(46) + bytes(rec) + bytes(special) + bytes(46)), ("cbg", games), ("cbp", people), ("cbt", events)):
        (tmp_path / f"old.{ext}").write_bytes(data)
    rows = S.read_cbh(spark, str(tmp_path), TABLES)
    assert {r.reason: r.n for r in S.reasons(rows).collect()} == {"converted": 1, "inactive": 1, "not encoded": 1}
    g = S.games(rows).first()
    assert g.movetext == "1. e4 e5 2. Nf3 Nc6 0-1" and g.tags["Date"] == "1999.??.??" and g.tags["Round"] == "3(2)" and (g.tags["Event"], g.tags["Site"], g.tags["White"]) == ("Open", "Rome", "Doe, Jo")
    assert S.clean(" a\t\x01b ") == "a b" and S.clean("\x00 ") == "?"
    text = S.games(rows).select(sinks.adapter_text(20).alias("t")).first().t
    assert text.startswith('[Event "Open"]\n[Site "Rome"]\n') and text.endswith("\n\n1. e4 e5 2. Nf3 Nc6\n0-1\n")
    (tmp_path / "old.cbt").unlink()
    assert S.read_cbh(spark, str(tmp_path), TABLES).first().reason == "incomplete: cbt"
    assert S.movetext(["Kd7", "a4"], "*", True, 7) == "7... Kd7 8. a4 *"
