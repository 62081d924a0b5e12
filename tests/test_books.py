import pytest

from pyspark.sql import functions as F

from tabiya.kernel import books
from tabiya.kernel.board import Board, parse_san, signed, uci
from tabiya.plans import books as P
from tabiya.sources import books as S
from tabiya.sources import files

NUMBERS = books.random_numbers()


def _record(b, san, weight):
    m = parse_san(b, san)
    return books.polyglot_key(b, NUMBERS).to_bytes(8, "big") + books.encode_polyglot(b, m).to_bytes(2, "big") + weight.to_bytes(2, "big") + bytes(4)


def _after(*sans):
    b = Board.start()
    for s in sans:
        b = b.apply(parse_san(b, s))
    return b


def _six_edges():
    s, e4, d4 = Board.start(), _after("e4"), _after("d4")
    return b"".join([_record(s, "e4", 100), _record(s, "d4", 80), _record(e4, "e5", 100), _record(e4, "c5", 90), _record(_after("e4", "e5"), "Nf3", 100), _record(d4, "d5", 100)])


def test_polyglot_book_to_lines(spark, tmp_path):
    p = tmp_path / "b.bin"
    p.write_bytes(_six_edges())
    entries = S.read_polyglot(spark, str(p))
    nodes, edges = P.polyglot_graph(spark, entries, NUMBERS, 10)
    assert edges.filter("problem is null").count() == 6 and nodes.count() == 7
    lines = P.covering_lines(nodes, edges, 10)
    assert sorted(tuple(r.line) for r in lines.collect()) == [("d4", "d5"), ("e4", "c5"), ("e4", "e5", "Nf3")]
    assert P.missed_edges(edges, lines).count() == 0 and P.stray_moves(edges, lines, "adjacent").count() == 0
    strange = lines.select(F.concat("line", F.array(F.when(F.col("line")[0] == "d4", "c4").otherwise("h6"))).alias("line")).filter("line[0] = 'd4'")
    assert P.stray_moves(edges, strange, "adjacent").count() == 1
    assert sorted(tuple(r.line) for r in P.tree_lines(nodes, edges).collect()) == [("d4", "d5"), ("e4", "c5"), ("e4", "e5", "Nf3")]
    seq = lines.select(F.col("line_no").alias("seq"), "line")
    assert P.merge_lines([seq, seq]).count() == 3
    share = {r.san: r.rel for r in P.relative_weights(edges).filter("depth = 0").collect()}
    assert round(share["e4"], 9) == round(100 * 100 / 180, 9)
    drawn = P.weighted_choice(edges).collect()
    assert len(drawn) == len({bytes(r.src) for r in drawn}) == 4


def test_parents_are_first_discoverers(spark, tmp_path):
    s = Board.start()
    rows = [_record(s, "Nf3", 100), _record(s, "Nc3", 80), _record(_after("Nf3"), "Nf6", 9), _record(_after("Nc3"), "Nf6", 9)]
    rows += [_record(_after("Nf3", "Nf6"), "Nc3", 1), _record(_after("Nc3", "Nf6"), "Nf3", 99)]
    (tmp_path / "t.bin").write_bytes(b"".join(rows))
    nodes, edges = P.polyglot_graph(spark, S.read_polyglot(spark, str(tmp_path / "t.bin")), NUMBERS, 10)
    assert [r.line for r in nodes.filter("depth = 3").collect()] == [["Nf3", "Nf6", "Nc3"]]
    assert [r.line for r in P.covering_lines(nodes, edges, 10).orderBy("line_no").collect()] == [["Nf3", "Nf6", "Nc3"], ["Nc3", "Nf6", "Nf3"]]


def test_ctg_parents_by_coordinates(spark, tmp_path):
    entries = S.read_ctg(spark, _ctg(tmp_path, ["g1f3 g8f6 b1c3", "b1c3 g8f6 g1f3"]))
    nodes, _ = P.ctg_graph(spark, entries, CODES)
    assert [r.line for r in nodes.filter("depth = 3").collect()] == [["Nc3", "Nf6", "Nf3"]]


def test_a_cycle_is_covered_once_its_line_ends(spark, tmp_path):
    there = ["Nf3", "Nf6", "Ng1", "Ng8"]
    rows = [_record(_after(*there[:i]), san, 100) for i, san in enumerate(there)] + [_record(Board.start(), "e4", 50)]
    (tmp_path / "c.bin").write_bytes(b"".join(rows))
    nodes, edges = P.polyglot_graph(spark, S.read_polyglot(spark, str(tmp_path / "c.bin")), NUMBERS, 6)
    assert [r.line for r in P.covering_lines(nodes, edges, 6).orderBy("line_no").collect()] == [[*there, "Nf3", "Nf6"], ["e4"]]


def test_polyglot_statistics_and_damage(spark, tmp_path):
    p = tmp_path / "b.bin"
    p.write_bytes(_record(Board.start(), "e4", 100) * 2 + _record(Board.start(), "d4", 0))
    got = S.book_statistics(S.read_polyglot(spark, str(p))).first()
    assert (got.records, got.active, got.zero_weight, got.duplicates, got.falls) == (3, 2, 1, 1, 0)
    (tmp_path / "c.bin").write_bytes(b"123456")
    with pytest.raises(Exception, match="16 bytes"):
        S.read_polyglot(spark, str(tmp_path / "c.bin")).collect()


CODES = books.plain_codes()


def _ctg(tmp_path, lines, name="f"):
    moves, boards = {}, {}
    for line in lines:
        b = Board.start()
        for u in line.split():
            key = books.ctg_signature(b)
            boards.setdefault(key, b)
            m = next(x for x in b.legal() if uci(x) == u)
            code = books.ctg_code(b, m, CODES)
            if code not in moves.setdefault(key, []):
                moves[key].append(code)
            b = b.apply(m)
        moves.setdefault(books.ctg_signature(b), [])
    page = b""
    for key, codes in moves.items():
        page += key + bytes([1 + 2 * len(codes)]) + b"".join(bytes([c, 0]) for c in codes) + (1).to_bytes(3, "big") + bytes(6) + (1).to_bytes(3, "big") + bytes(21)
    page = len(moves).to_bytes(2, "big") + bytes(2) + page
    path = tmp_path / f"{name}.ctg"
    path.write_bytes(bytes(4096) + page.ljust(4096, b"\0"))
    return str(path)


def test_ctg_covers_all_edges_with_transpositions_and_cycle(spark, tmp_path):
    lines = ["e2e4 e7e5 g1f3 b8c6", "g1f3 b8c6 e2e4 e7e5", "d2d4 d7d5 c2c4", "c2c4 d7d5 d2d4", "g1f3 g8f6 f3g1 f6g8", "a2a3 h7h6"]
    entries = S.read_ctg(spark, _ctg(tmp_path, lines))
    nodes, edges = P.ctg_graph(spark, entries, CODES)
    edges.cache()
    out = P.tree_lines(nodes, edges)
    assert edges.filter("problem is not null").count() == 0 and P.missed_edges(edges, out).count() == 0
    keyed = entries.select(F.lower(F.hex("signature")).alias("key"), "moves")
    r = P.coverage_report(nodes, edges, keyed).first()
    assert r.missing == 0 and r.illegal == 0 and r.transpositions >= 2


def test_ctg_depth_cut_and_damage(spark, tmp_path):
    path = _ctg(tmp_path, ["e2e4 e7e5 g1f3", "d2d4 d7d5"])
    entries = S.read_ctg(spark, path)
    nodes, edges = P.ctg_graph(spark, entries, CODES, 1)
    keyed = entries.select(F.lower(F.hex("signature")).alias("key"), "moves")
    r = P.coverage_report(nodes, edges, keyed, 1).first()
    assert (r.edges, r.cut_moves, r.cut_positions) == (2, 2, 2)
    bad = bytearray(open(path, "rb").read())
    bad[4096 + 4] = 0
    (tmp_path / "bad.ctg").write_bytes(bytes(bad))
    with pytest.raises(Exception, match="damaged"):
        S.read_ctg(spark, str(tmp_path / "bad.ctg")).collect()
    assert S.preflight(spark, str(tmp_path / "bad.ctg")).first().invalid_pages == 1
    with pytest.raises(ValueError):
        P.ctg_graph(spark, entries.filter("false"), CODES)


def test_ctg_castling_and_en_passant(spark, tmp_path):
    lines = ["e2e4 e7e5 g1f3 b8c6 f1c4 f8c5 e1g1", "e2e4 a7a6 e4e5 d7d5 e5d6"]
    _, edges = P.ctg_graph(spark, S.read_ctg(spark, _ctg(tmp_path, lines)), CODES)
    assert {"O-O", "exd6"} <= {r.san for r in edges.collect()}


def test_probe_indices_and_bounds():
    assert S.probe_indices(0, 0, 0) == [0] and S.probe_indices(5, 2, 9) == [2, 4, 12]
    assert S.ctb_bounds(bytes(12)) == (0, 0)
    with pytest.raises(ValueError):
        S.ctb_bounds(bytes(4))


def test_probing_finds_pages_by_hash(spark, tmp_path):
    entries = S.read_ctg(spark, _ctg(tmp_path, ["e2e4 e7e5", "d2d4"]))
    assert books.ctg_hash(b"") == 0 and books.ctg_hash(b"\xff") == books.HASH[1] + books.HASH[2]
    low, high = 3, 40
    (tmp_path / "none.cto").write_bytes(bytes(16) + b"\xff\xff\xff\xff" * 90)
    assert S.probed(entries, S.index_entries(spark, str(tmp_path / "none.cto")), low, high).filter("probed").count() == 0
    # An index that leads each other signature to its page at the last of its places, and all the rest to another page.
    table, wanted = [9] * 90, set()
    rows = sorted(bytes(r.signature) for r in entries.collect())
    free = set(range(90))
    for s in rows[::2]:
        place = next(x for x in reversed(S.probe_indices(books.ctg_hash(s), low, high)) if x in free)
        table[place] = 0
        free.discard(place)
        wanted.add(s)
    wanted |= {s for s in rows if any(table[x] == 0 for x in S.probe_indices(books.ctg_hash(s), low, high))}
    (tmp_path / "some.cto").write_bytes(bytes(16) + b"".join(x.to_bytes(4, "big") for x in table))
    index = S.index_entries(spark, str(tmp_path / "some.cto"))
    assert index.filter("page = 9").count() == 90 - len(rows[::2])
    found = S.probed(entries, index, low, high)
    assert {bytes(r.signature) for r in found.filter("probed").collect()} == wanted and found.count() == len(rows) == 4


def test_discovery(spark, tmp_path):
    for name in ("a.PGN", "x/OVERLAY-PGN/b.pgn", "c.overlay.pgn", "b.ctg", "b.cto", "b.ctb", "d.cbh", "temp/e.pgn", "my_output/f.pgn", "tabiya_raw_x.pgn", "n.txt", "y/a.pgn"):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    root = str(tmp_path / "in")
    got = files.inventory(files.listing(spark, root), root).orderBy("src_id").collect()
    assert [(r.kind, r.base, r.complete) for r in got] == [("CBH", "d", False), ("CTG", "b", True), ("OVERLAY-PGN", "c.overlay", True), ("OVERLAY-PGN", "b", True), ("PGN", "a", True), ("PGN", "a", True)]
    names = [r.name for r in files.output_names(files.inventory(files.listing(spark, root), root)).filter("kind = 'PGN'").orderBy("src_id").collect()]
    assert names[0] == "a" and len(names[1]) == 10
    sums = files.checksums(spark, root).collect()
    assert len(sums) == 12 and all(len(r.sha256) == 64 for r in sums)


def test_keys_are_stored_as_signed_numbers(spark, tmp_path):
    p = tmp_path / "b.bin"
    p.write_bytes(_record(Board.start(), "e4", 1))
    assert S.read_polyglot(spark, str(p)).first().key == signed(books.polyglot_key(Board.start(), NUMBERS))
