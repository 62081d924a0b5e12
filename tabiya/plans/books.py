"""Book pipelines: reachable graphs, lines that cover every edge, merges.

A graph grows level by level: the frontier joins the book's entries by key or signature, a kernel turns codes into legal
moves and boards, and known nodes are dropped. Node ids are 67-byte boards.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabiya.kernel import board, books
from tabiya.operators import dedup, graph
from tabiya.session import cut, ship

_EDGES = "src binary, dst binary, key string, dst_key string, move int, uci string, san string, weight long, place int, problem string"


def _steps(codes_of, key_of, decode, coordinates=False, skip=None):
    """Edges of frontier rows (node, moves): one row per move, with a problem for those that can't be made.

    place: the order in which a node's moves are tried, that of the entry or, if asked for, of the coordinates. Nodes that `skip` holds for have no rows.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for node, moves in zip(batch.column("node").to_pylist(), batch.column("moves").to_pylist(), strict=True):
                b, seen = books.board_of(node), set()
                if skip and skip(b):
                    continue
                tried = [(decode(b, x["code"]), x) for x in moves or []]
                if coordinates:
                    tried.sort(key=lambda t: (t[0] is None, t[0] and board.uci(t[0])))
                for place, (m, x) in enumerate(tried):
                    if m is None:
                        rows.append((node, None, key_of(b), None, x["code"], None, None, x["weight"], place, "illegal"))
                    elif m in seen:
                        rows.append((node, None, key_of(b), None, x["code"], board.uci(m), None, x["weight"], place, "duplicate"))
                    else:
                        seen.add(m)
                        after = b.apply(m)
                        rows.append((node, codes_of(after), key_of(b), key_of(after), board.move_code(m), board.uci(m), b.san(m), x["weight"], place, None))
            kinds = (pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string())
            names = ["src", "dst", "key", "dst_key", "move", "uci", "san", "weight", "place", "problem"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run


def reachable_book(spark: SparkSession, entries: DataFrame, run, start_key: str, most_depth: int) -> tuple[DataFrame, DataFrame]:
    """nodes (node, key, depth, parent, line: the moves to it) and edges (with depth and problem) from the start position.

    entries: key and moves (array of code, weight in order). A node's parent is its first discoverer in a queue that tries moves by place:
    places from the start, compared as arrays, order each level as that queue does, so nothing is ranked in one task. A level's rows are written to the shared folder. most_depth 0: no limit.
    """
    start = board.Board.start()
    first = [(bytearray(books.node_id(start)), start_key, 0, None, [], [])]
    nodes = cut(spark.createDataFrame(first, "node binary, key string, depth int, parent binary, line array<string>, places array<int>"))
    frontier, edges, depth = nodes, None, 0
    while not most_depth or depth < most_depth:
        work = frontier.join(entries, "key").select("node", "moves")
        found = work.mapInArrow(run, _EDGES)
        found = cut(found.join(frontier.select(F.col("node").alias("src"), F.col("line").alias("src_line"), F.col("places").alias("src_places")), "src").withColumn("depth", F.lit(depth)))
        edges = found if edges is None else edges.unionByName(found)
        by = F.struct("src_places", "place", "src_line", "src", "dst_key", "san")
        new = found.filter("problem is null").groupBy(F.col("dst").alias("node")).agg(F.min(by).alias("by")).join(nodes.select("node"), "node", "left_anti")
        frontier = cut(new.select("node", F.col("by.dst_key").alias("key"), F.lit(depth + 1).alias("depth"), F.col("by.src").alias("parent"), F.concat("by.src_line", F.array("by.san")).alias("line"), F.concat("by.src_places", F.array("by.place")).alias("places")))
        if not frontier.limit(1).count():
            break
        nodes, depth = nodes.unionByName(frontier), depth + 1
    return nodes, edges if edges is not None else cut(spark.createDataFrame([], _EDGES + ", src_line array<string>, src_places array<int>, depth int"))


def polyglot_graph(spark: SparkSession, entries: DataFrame, numbers: list[int], most_depth: int = 100) -> tuple[DataFrame, DataFrame]:
    """The graph of Polyglot entries (key, move, weight); moves of a key come by weight, then code."""
    ship(spark)
    key_of = lambda b: str(board.signed(books.polyglot_key(b, numbers)))
    run = _steps(lambda b: books.node_id(b, "adjacent"), key_of, books.polyglot_move)
    item = F.struct(F.negative("weight").alias("w"), F.col("move").alias("code"))
    moves = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["code"].alias("code"), F.negative(x["w"]).cast("long").alias("weight")))
    by_key = entries.groupBy(F.col("key").cast("string").alias("key")).agg(moves.alias("moves"))  # the moves of one position
    return reachable_book(spark, by_key, run, key_of(board.Board.start()), most_depth)


def ctg_graph(spark: SparkSession, entries: DataFrame, codes: dict[int, books.Code], most_depth: int = 0, pawnless: bool = True) -> tuple[DataFrame, DataFrame]:
    """The graph of CTG entries (signature, moves), moves by coordinates; a missing start position is an error, other missing ones end their lines.

    With pawnless=False, positions without pawns are reached but not looked up.
    """
    ship(spark)
    key_of = lambda b: books.ctg_signature(b).hex()
    move = lambda b, code: books.ctg_move(b, code, codes)
    run = _steps(lambda b: books.node_id(b, "legal"), key_of, move, coordinates=True, skip=None if pawnless else lambda b: not books.pawns(b))
    moves = F.transform("moves", lambda x: F.struct(x["code"].alias("code"), F.lit(0).cast("long").alias("weight")))
    by_key = entries.groupBy(F.lower(F.hex("signature")).alias("key")).agg(F.first("moves").alias("moves")).select("key", moves.alias("moves"))
    root = key_of(board.Board.start())
    if not by_key.filter(F.col("key") == root).limit(1).count():
        raise ValueError("the book has no start position")
    return reachable_book(spark, by_key, run, root, most_depth)


def relative_weights(edges: DataFrame) -> DataFrame:
    from tabiya.operators.preference import relative_weight

    return relative_weight(edges.filter("problem is null"), ["src"], "weight")


def coverage_report(nodes: DataFrame, edges: DataFrame, entries_key: DataFrame, most_depth: int = 0) -> DataFrame:
    """One row: positions, edges, transpositions, illegal, duplicate_moves, missing (positions without an entry), deepest, cut_positions, cut_moves."""
    good = edges.filter("problem is null")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    n = nodes.agg(F.count("*").alias("positions"), F.max("depth").alias("deepest"))
    e = edges.agg(F.sum(F.when(F.col("problem").isNull(), 1).otherwise(0)).alias("edges"), F.sum(F.when(F.col("problem") == "illegal", 1).otherwise(0)).alias("illegal"), F.sum(F.when(F.col("problem") == "duplicate", 1).otherwise(0)).alias("duplicate_moves"))
    known = entries_key.select("key", "moves")
    missing = count(nodes.join(known.select("key"), "key", "left_anti"), "missing")
    at_cut = nodes.filter(F.col("depth") == most_depth) if most_depth else nodes.limit(0)
    cut_ = at_cut.join(known, "key").filter(F.size("moves") > 0).agg(F.count("*").alias("cut_positions"), F.coalesce(F.sum(F.size("moves")), F.lit(0)).alias("cut_moves"))
    report = n.crossJoin(e).crossJoin(missing).crossJoin(cut_)  # one row each
    distinct = count(good.select("dst").distinct(), "_reached")
    return report.crossJoin(distinct).withColumn("transpositions", F.col("edges") - F.col("_reached")).drop("_reached")


def tree_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line (moves): each edge off the tree, and each tree edge into a node without edges, after the path to its start."""
    good = edges.filter("problem is null")
    parents = nodes.select(F.col("node").alias("dst"), F.col("parent"), F.col("line").alias("own"))
    inner = good.select(F.col("src").alias("dst")).distinct().withColumn("inner", F.lit(True))
    e = good.withColumn("line", F.concat("src_line", F.array("san"))).join(parents, "dst").join(inner, "dst", "left")
    on_tree = F.coalesce((F.col("parent") == F.col("src")) & (F.col("own") == F.col("line")), F.lit(False))
    return e.filter(~on_tree | F.col("inner").isNull()).select("line").distinct()


def covering_lines(nodes: DataFrame, edges: DataFrame, most_depth: int) -> DataFrame:
    """line_no, line: greedy lines of one book, in the order of source depth, weight, key and move.

    For each edge not yet covered: the path to its start, the edge, then on along uncovered edges (else the heaviest) to a leaf or the
    cap. A line's edges count as covered once it ends, so a cycle may be walked again; a line that is there already is left out. Each line depends on those before, so one book is one task; books run side by side by their `book` column.
    """
    if "book" not in edges.columns:
        edges, nodes = edges.withColumn("book", F.lit("")), nodes.withColumn("book", F.lit(""))
    paths = nodes.select("book", F.col("node").alias("src"), F.col("line").alias("path"))
    table = edges.filter("problem is null").drop("src_line", "src_places", "place", "problem", "dst_key").join(paths, ["book", "src"])

    def run(pdf):
        import pandas as pd

        unsigned = [int(k) & board.M64 if k.lstrip("-").isdigit() else int(k, 16) for k in pdf["key"]]
        order = sorted(range(len(pdf)), key=lambda r: (pdf["depth"].iat[r], -pdf["weight"].iat[r], unsigned[r], pdf["uci"].iat[r]))
        rows = [tuple(pdf[c].iat[r] for c in ("src", "dst", "san", "path")) for r in order]
        out: dict[bytes, list[int]] = {}
        for r in sorted(range(len(order)), key=lambda r: (-pdf["weight"].iat[order[r]], pdf["uci"].iat[order[r]])):
            out.setdefault(bytes(rows[r][0]), []).append(r)
        into = {(tuple(rows[r][3]) + (rows[r][2],)): r for r in range(len(rows))}
        covered, lines = [False] * len(rows), {}
        for r in range(len(rows)):
            if covered[r]:
                continue
            path, passed, at = tuple(rows[r][3]), [r], bytes(rows[r][1])
            while len(path) + len(passed) < most_depth and at in out:
                passed.append(next((x for x in out[at] if not covered[x]), out[at][0]))
                at = bytes(rows[passed[-1]][1])
            line = path + tuple(rows[x][2] for x in passed)
            if line in lines:
                continue
            lines[line] = list(line)
            passed += [into[path[:k]] for k in range(1, len(path) + 1) if path[:k] in into]  # tree edges of the path
            for x in passed:
                covered[x] = True
        lines = list(lines.values())
        return pd.DataFrame({"book": [pdf["book"].iat[0]] * len(lines), "line_no": range(len(lines)), "line": lines})

    return table.groupBy("book").applyInPandas(run, "book string, line_no long, line array<string>")


def spread_lines(nodes: DataFrame, edges: DataFrame, most_depth: int) -> DataFrame:
    """line_no, line: lines that cover every edge, made by all tasks level by level (operators.graph.layered_cover); covering_lines() makes other, about as many."""
    good = edges.filter("problem is null").select("src", "dst", F.col("san").alias("label"), "weight")
    lines = graph.layered_cover(good, nodes.select("node", "depth", F.col("line").alias("path")), most_depth)
    return lines.select(F.xxhash64(F.array_join("line", " ")).alias("line_no"), "line")


def sampled_games(edges: DataFrame, n: int, most_depth: int, results: DataFrame | None = None, seed: int = 20260831) -> DataFrame:
    """walker, line, result: n lines drawn by weight, root moves first one by one; results (dst_key, w, d, l of the side that moved there) give the odds of the
    result where a line ends, else it is *."""
    good = edges.filter("problem is null").select("src", "dst", F.col("san").alias("label"), "weight", F.struct("dst_key", "depth").alias("payload"))
    found = graph.sampled_lines(good, bytearray(books.node_id(board.Board.start())), n, most_depth, seed)
    if results is None:
        return found.select("walker", "line", F.lit("*").alias("result"))
    odds = found.join(results.select("dst_key", "w", "d", "l"), F.col("last.dst_key") == F.col("dst_key"), "left")
    total = F.coalesce(F.col("w") + F.col("d") + F.col("l"), F.lit(0))
    u = (F.pmod(F.xxhash64(F.lit(seed + 1), "walker"), F.lit(1 << 52)) + 0.5) / float(1 << 52) * total
    white = F.size("line") % 2 == 1  # who moved last
    won, lost = F.when(white, "1-0").otherwise("0-1"), F.when(white, "0-1").otherwise("1-0")
    result = F.when(total == 0, "*").when(u < F.col("w"), won).when(u < F.col("w") + F.col("d"), "1/2-1/2").otherwise(lost)
    return odds.select("walker", "line", result.alias("result"))


def played_edges(lines: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """src, move of all moves of the lines, with node ids by each of the en-passant rules; an illegal move fails the query."""

    def run(batches):
        for batch in batches:
            rows = set()
            for line in batch.column("line").to_pylist():
                b = board.Board.start()
                for san in line:
                    m = board.parse_san(b, san)
                    if m is None:
                        raise ValueError(f"not a move here: {san}")
                    rows.update((books.node_id(b, rule), board.move_code(m)) for rule in rules)
                    b = b.apply(m)
            rows_ = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_], pa.binary()), pa.array([r[1] for r in rows_], pa.int32())], ["src", "move"])

    return lines.select("line").mapInArrow(run, "src binary, move int").distinct()


def missed_edges(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """src, move of legal edges that no line plays."""
    return edges.filter("problem is null").select("src", "move").distinct().join(played_edges(lines, ("adjacent", "legal")), ["src", "move"], "left_anti")


def stray_moves(edges: DataFrame, lines: DataFrame, rule: str) -> DataFrame:
    """src, move of moves of the lines that aren't edges of the book: along a line, each position and move must be the book's. rule: that of the edges' node ids."""
    return played_edges(lines, (rule,)).join(edges.filter("problem is null").select("src", "move").distinct(), ["src", "move"], "left_anti")


def merge_lines(frames: list[DataFrame]) -> DataFrame:
    """line, rank, seq: the union of books (line, seq) in order, first of each move sequence; prefixes and transpositions are lines of their own."""
    keyed = [f.select("seq", "line", F.array_join("line", " ").alias("key")) for f in frames]
    return dedup.merge_sources(keyed, ["key"], "seq").drop("key")


def admitted_lines(games: DataFrame) -> DataFrame:
    """path, seq, line, key (coordinates) of written book lines (the columns of sources.pgn); the query fails at the first record that may not be merged, and names its place.

    A record needs a result tag, the standard start position, and move text whose every move is spelled canonically and is legal, with a result at its end.
    """

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "seq", "tags", "movetext", "error")]
            rows = []
            for path, seq, tags, text, error in zip(*columns, strict=True):
                try:
                    if error:
                        raise ValueError(error)
                    tags = dict(tags or [])
                    if tags.get("Result") not in ("*", "1-0", "0-1", "1/2-1/2"):
                        raise ValueError("no result")
                    if tags.get("FEN") or tags.get("SetUp") == "1":
                        raise ValueError("not the standard start position")
                    words = (text or "").split()
                    rows.append((path, seq, [w for w in words[:-1] if not w.rstrip(".").isdigit()], board.sequence_key(" ".join(words)), None))
                except ValueError as e:
                    rows.append((path, seq, None, None, f"{path}, record {seq}: {e}"))
            kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "seq", "line", "key", "wrong"])

    found = games.mapInArrow(run, "path string, seq long, line array<string>, key string, wrong string")
    # The check is part of the key, so no plan can leave it out.
    return found.select("path", "seq", "line", F.when(F.col("wrong").isNotNull(), F.raise_error(F.col("wrong")).cast("string")).otherwise(F.col("key")).alias("key"))


def merge_written_books(books_: list[DataFrame]) -> DataFrame:
    """line, rank, seq: the lines of books as written (each the columns of sources.pgn), in order, first of each sequence of moves."""
    return dedup.merge_sources([admitted_lines(g).select("seq", "line", "key") for g in books_], ["key"], "seq").drop("key")


def merge_all(games: DataFrame, lines: DataFrame) -> DataFrame:
    """Games and then book lines, without looking for duplicates across them."""
    return games.unionByName(lines, allowMissingColumns=True)


def anchor_children(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """position, move, w, d, l, n, decisive, score of each edge whose target has an entry: its counts are the other side's."""
    from tabiya.operators.preference import with_score

    counts = entries.groupBy(F.lower(F.hex("signature")).alias("dst_key")).agg(F.first("wins").alias("l"), F.first("losses").alias("w"), F.first("draws").alias("d"), F.first("total").alias("total"))
    joined = edges.filter("problem is null").join(counts, "dst_key").select(F.hex("src").alias("position"), F.col("uci").alias("move"), "w", "d", "l", "total")
    scored = with_score(joined)
    return scored.withColumn("n", F.greatest("n", "total")).drop("total")


def weighted_choice(edges: DataFrame, seed: int = 20260831) -> DataFrame:
    """One edge of each node, drawn by weight (at least 1): the largest of log(u) / weight, with u from a hash of seed, node and move."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "src", "uci"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    key = F.log(u) / F.greatest(F.col("weight"), F.lit(1))
    good = edges.filter("problem is null").withColumn("_k", key)
    return good.withColumn("_r", F.row_number().over(W.partitionBy("src").orderBy(F.desc("_k"), "uci"))).filter("_r = 1").drop("_k", "_r")
