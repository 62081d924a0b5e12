"""A whole run over a folder: games, books, overlays, merges, final games and reports, as files in an output folder."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya import sinks
from tabiya.functions import text as X
from tabiya.kernel.books import Code
from tabiya.kernel.chessbase import Tables
from tabiya.operators.preference import SMALL, STRICT, Policy, anchors, first_failure, wilson
from tabiya.plans import books as B
from tabiya.plans import games as G
from tabiya.plans import reports
from tabiya.session import cut, ship
from tabiya.sources import books, chessbase, files, pgn


@dataclass(frozen=True)
class Options:
    """What a run does; tables of formats without a rule are needed only if such files are there."""

    games: G.Config = field(default_factory=G.Config)
    book_depth: int = 40
    ctg_depth: int = 0
    numbers: list[int] | None = None
    codes: dict[int, Code] | None = None
    tables: Tables | None = None
    #: Lines of Polyglot books by all tasks (operators.graph.layered_cover) in place of one task a book; they cover the same edges.
    spread: bool = False
    #: Whether the anchor moves of CTG books are written, too.
    anchors: bool = False


@dataclass
class Outcome:
    status: str
    metrics: DataFrame
    problems: list[str]


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def ranked_games(spark: SparkSession, paths: dict[str, int]) -> DataFrame | None:
    """The games of all these files as one read, with the rank of each file."""
    if not paths:
        return None
    ranks = spark.createDataFrame(list(paths.items()), "path string, src_rank int")
    return pgn.read_games(spark, list(paths)).join(F.broadcast(ranks), "path")  # a folder's listing, which the driver has


def game_sources(spark: SparkSession, sources: list, options: Options, problems: list[str], reasons: list[DataFrame]) -> DataFrame | None:
    """Games of PGN files, then of CBH and 2CBH sets, by lower-case path; src_rank is that order. reasons: why records of sets were left out."""
    kinds = {"PGN": 0, "CBH": 1, "2CBH": 1}
    found = sorted((s for s in sources if s.kind in kinds), key=lambda s: (kinds[s.kind], s.path.lower()))
    frames = [ranked_games(spark, {s.path: rank for rank, s in enumerate(found) if s.kind == "PGN"})]
    for rank, s in enumerate(found):
        if s.kind == "PGN":
            continue
        if not s.complete or (s.kind == "CBH" and options.tables is None):
            problems.append(f"skipped: {s.path}")
            continue
        stem = s.path.rsplit(".", 1)[0]
        paths = [s.path] + [p for e in files.SIDE_FILES[s.kind] for p in (f"{stem}.{e}",)]
        rows = cut(chessbase.read_cbh(spark, paths, options.tables) if s.kind == "CBH" else chessbase.read_2cbh(spark, paths))
        if not chessbase.games(rows).limit(1).count():
            problems.append(f"partial: {s.path}: no record converted")
        reasons.append(chessbase.reasons(rows))
        frames.append(chessbase.games(rows).withColumn("src_rank", F.lit(rank)))
    return _union([f for f in frames if f is not None])


def overlay_sources(spark: SparkSession, sources: list) -> DataFrame | None:
    return ranked_games(spark, {s.path: i for i, s in enumerate(s for s in sources if s.kind == "OVERLAY-PGN")})


def book_anchors(nodes: DataFrame, edges: DataFrame, entries: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Anchor moves of a book by its children's counts, and the policy that gave them: the strict one, or the small one if that gives none and none was asked for."""
    stats = cut(B.anchor_children(nodes, edges, entries))
    if policy is not None:
        return anchors(stats, ["position"], "move", policy).withColumn("policy", F.lit("asked for"))
    strict = cut(anchors(stats, ["position"], "move", STRICT).withColumn("policy", F.lit("strict")))
    return strict if strict.limit(1).count() else anchors(stats, ["position"], "move", SMALL).withColumn("policy", F.lit("small"))


def anchor_diagnostics(nodes: DataFrame, edges: DataFrame, entries: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """reason and how many candidates break that rule first."""
    return wilson(B.anchor_children(nodes, edges, entries)).groupBy(first_failure(policy).alias("reason")).agg(F.count("*").alias("n"))


def depth_histogram(edges: DataFrame) -> DataFrame:
    """Per depth: positions with moves, legal moves, illegal and duplicate ones."""
    when = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    p = F.col("problem")
    return edges.groupBy("depth").agg(F.count_distinct("src").alias("positions"), when(p.isNull(), "legal"), when(p == "illegal", "illegal"), when(p == "duplicate", "duplicates"))


@dataclass
class Book:
    """A book's lines (seq, line), how many moves of which kind it has at each depth, and of a CTG book what its report says and the statistics of the positions that it reaches."""

    lines: DataFrame
    depths: DataFrame
    report: DataFrame | None = None
    statistics: DataFrame | None = None
    anchors: DataFrame | None = None


def read_book(spark: SparkSession, source, options: Options) -> Book:
    """ValueError if an edge isn't covered."""
    report = statistics = moves = None
    if source.kind == "BIN":
        if options.numbers is None:
            raise ValueError("Polyglot books need their table of numbers")
        nodes, edges = B.polyglot_graph(spark, books.read_polyglot(spark, source.path), options.numbers, options.book_depth)
        make = B.spread_lines if options.spread else B.covering_lines
        lines = cut(make(nodes, edges, options.book_depth).select(F.col("line_no").alias("seq"), "line"))
    else:
        if options.codes is None:
            raise ValueError("CTG books need their table of codes")
        entries = books.read_ctg(spark, source.path)
        nodes, edges = B.ctg_graph(spark, entries, options.codes, options.ctg_depth)
        lines = B.tree_lines(nodes, edges).withColumn("seq", F.xxhash64(F.array_join("line", " ")))
        lines = cut(lines.select("seq", "line"))
        keyed = entries.withColumn("key", F.lower(F.hex("signature")))
        report = B.coverage_report(nodes, edges, keyed.select("key", "moves"), options.ctg_depth).withColumn("path", F.lit(source.path)).withColumn("lines", F.lit(lines.count()))
        statistics = nodes.select("key", "depth", "line").join(keyed.drop("path"), "key")
        moves = cut(book_anchors(nodes, edges, entries)) if options.anchors else None
    if B.missed_edges(edges, lines).limit(1).count():
        raise ValueError("a book's edge is on no line")
    if B.stray_moves(edges, lines, "adjacent" if source.kind == "BIN" else "legal").limit(1).count():
        raise ValueError("a line leaves its book")
    return Book(lines, depth_histogram(edges), report, statistics, moves)


def played(lines: DataFrame) -> DataFrame:
    """lines (line: canonical moves) with line as text, san and edges, as overlays have them."""
    found = G.with_edges(lines.withColumnRenamed("line", "toks"))
    return found.withColumn("line", X.line_key(F.col("san"))).drop("toks")


def run(spark: SparkSession, root: str, out: str, options: Options = Options()) -> Outcome:
    """Everything that the folder's sources allow. A damaged game file keeps its games in RAW and leaves METAL out; a broken
    Polyglot book fails the run's books; a broken CTG book is left out."""
    ship(spark)
    out = out.rstrip("/")
    inventory = files.output_names(files.inventory(files.listing(spark, root), root))
    sources = inventory.orderBy("src_id").collect()  # a folder's listing
    inventory.coalesce(1).write.json(f"{out}/REPORTS/INVENTORY")
    told = [(k, str(v)) for k, v in vars(options).items() if k not in ("numbers", "codes", "tables")] + [(k, "given" if vars(options)[k] else "none") for k in ("numbers", "codes", "tables")]
    spark.createDataFrame(told, "name string, value string").coalesce(1).write.json(f"{out}/REPORTS/SETTINGS")
    problems: list[str] = []
    notices: list[str] = []
    counts: list[DataFrame] = []
    bin_failed = overlay_empty = False

    def note(stage: str, df: DataFrame) -> None:
        counts.append(reports.metrics(stage, df))

    def write(df: DataFrame, text, order: list[str], path: str) -> None:
        n = df.count()
        sinks.write_text(df, text, order, f"{out}/{path}")
        sinks.require_count(spark, f"{out}/{path}", n)

    metal = None
    reasons: list[DataFrame] = []
    games = game_sources(spark, sources, options, problems, reasons)
    if reasons:
        _union(reasons).coalesce(1).write.json(f"{out}/REPORTS/ADAPTERS")
    raw = None
    if games is not None:
        games = cut(games)
        raw = cut(G.raw_games(games, options.games))
        kept = raw.filter("status = 'kept'")
        if kept.limit(1).count():
            write(kept, sinks.raw_text(), ["src_rank", "seq"], "RAW/GAMES")
        note("raw", G.raw_counts(raw).drop("src_rank").groupBy().sum())
        damaged = G.damaged_sources(games).collect()  # a row per damaged file
        problems += [f"partial: damaged {r.path}: {r.error}" for r in damaged]
        if not damaged:
            chosen, models = G.metal_games(games, options.games)
            metal = cut(models)
            note("metal", metal.agg(F.count("*").alias("games")).crossJoin(chosen.agg(F.count("*").alias("preferred"))))
            if metal.limit(1).count():
                write(metal, sinks.model_text(), ["src_rank", "seq"], "METAL/GAMES")

    frames: list[DataFrame] = []
    ctg: list[DataFrame] = []
    for s in sorted((s for s in sources if s.kind in ("CTG", "BIN")), key=lambda s: (s.kind != "CTG", s.path.lower())):
        if not s.complete:
            problems.append(f"skipped: {s.path}")
            continue
        try:
            book = read_book(spark, s, options)
        except Exception as e:  # a CTG book that fails is reported, and the run goes on; a BIN book that fails ends the books
            problems.append(f"partial: {s.path}: {str(e)[:200]}")
            if s.kind == "BIN":
                bin_failed = True
                break
            continue
        name = f"{s.kind}-{s.name}"
        write(book.lines, sinks.line_text(width=100 if s.kind == "CTG" else 0), ["seq"], f"RAW/BOOKS/{name}")
        # What was written must be what a merge admits.
        if B.admitted_lines(pgn.read_games(spark, f"{out}/RAW/BOOKS/{name}")).select(F.count("key")).first()[0] != book.lines.count():
            raise ValueError(f"{name}: lines were lost")
        frames.append(book.lines)
        book.depths.coalesce(1).write.json(f"{out}/REPORTS/DEPTHS-{name}")
        if s.kind == "CTG":
            sinks.write_statistics(book.statistics, f"{out}/REPORTS/STATISTICS-{name}")
            book.report.coalesce(1).write.json(f"{out}/REPORTS/COVERAGE-{name}")
            write(book.lines, sinks.line_text(width=100), ["seq"], f"METAL/{name}")
            if book.anchors is not None:
                used = [r.policy for r in book.anchors.select("policy").distinct().collect()]  # one at most
                if used != ["strict"]:
                    notices.append(f"notice: {s.path}: " + ("anchors by the small policy" if used else "no anchors"))
                book.anchors.coalesce(1).write.json(f"{out}/REPORTS/ANCHORS-{name}")
            ctg.append(played(book.lines).withColumn("src_rank", F.lit(len(ctg))))

    overlay = overlay_sources(spark, sources)
    if overlay is not None:
        overlay = cut(overlay)
        if G.damaged_sources(overlay).limit(1).count():
            raise ValueError("an overlay is damaged")
        overlay = cut(G.overlay_lines(overlay, options.games.most_plies))
        own = overlay.filter("status = 'kept'").select((F.col("src_rank").cast("long") * (1 << 40) + F.col("seq")).alias("seq"), F.col("san").alias("line"))
        overlay_empty = not own.limit(1).count()
        if not overlay_empty:
            write(own, sinks.line_text(event="Overlay line"), ["seq"], "RAW/OVERLAY")
            frames.append(own)
    merged = None
    if frames and not bin_failed:
        merged = cut(B.merge_lines(frames))
        write(merged, sinks.line_text(), ["rank", "seq"], "RAW/MERGED-BOOKS")
        note("books", merged.agg(F.count("*").alias("lines")))
    if merged is not None and raw is not None:
        both = B.merge_all(
            raw.filter("status = 'kept'").select(F.lit(0).alias("part"), F.col("src_rank").cast("long").alias("rank"), "seq", sinks.raw_text().alias("text")),
            merged.select(F.lit(1).alias("part"), F.col("rank").cast("long").alias("rank"), "seq", sinks.line_text().alias("text")),
        )
        write(both, F.col("text"), ["part", "rank", "seq"], "RAW/ALL")
    # METAL as a whole: games, then the lines of CTG books, then overlay lines that neither has.
    parts, base = [], []
    if metal is not None and metal.limit(1).count():
        parts.append(metal.select(F.lit(0).alias("part"), "src_rank", "seq", sinks.model_text().alias("text")))
        base.append(metal.select("src_rank", "seq", X.line_key(F.col("san")).alias("line"), "edges"))
    if ctg:
        lines = cut(_union(ctg))
        parts.append(lines.select(F.lit(1).alias("part"), "src_rank", "seq", sinks.line_text("san").alias("text")))
        base.append(lines.select("src_rank", "seq", "line", "edges"))
    if parts and overlay is not None and not overlay_empty:
        known = cut(_union(base))
        note("overlay", G.overlay_contribution(known, overlay))
        added = overlay.filter("status = 'kept'").join(known.select("line").distinct(), "line", "left_anti")
        parts.append(added.select(F.lit(2).alias("part"), "src_rank", "seq", sinks.line_text("san", "Overlay line").alias("text")))
    if parts:
        whole = cut(_union(parts))
        note("final", whole.agg(*(F.count_if(F.col("part") == k).alias(n) for k, n in enumerate(("games", "book_lines", "overlay_lines")))))
        write(whole, F.col("text"), ["part", "src_rank", "seq"], "METAL/FINAL")

    status = spark.range(1).select(reports.classify_run(F.lit(overlay_empty), F.lit(bin_failed), F.lit(any(p.startswith("partial") for p in problems)), F.lit(any(p.startswith("skipped") for p in problems))).alias("s")).first().s
    found = _union(counts)
    if found is None:
        found = spark.createDataFrame([], "stage string, name string, value double")
    found = cut(found)
    lines = reports.report_lines(found).unionByName(spark.createDataFrame([(f"status       {status}",), *[(p,) for p in [*problems, *notices]]], "value string"))
    lines.coalesce(1).write.text(f"{out}/REPORTS/RUN")
    files.checksums(spark, out).select(F.concat_ws("  ", "sha256", "path").alias("value")).coalesce(1).write.text(f"{out}-CHECKSUMS")
    return Outcome(status, found, problems)
