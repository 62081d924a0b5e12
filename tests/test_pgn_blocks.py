"""Game files read by blocks: whatever the cuts, the records are those of a reading from start to end."""

import random

import hypothesis
import hypothesis.strategies as st
import pytest

from tabiya.kernel import pgn
from tabiya.kernel.pgn_blocks import TAG, TEXT, Entry, effect, kind, turn
from tabiya.sources.pgn import read_games, whole_games

PIECES = ['[Event "x"]', '[A "("]', '[B "}{"]', "1. e4 e5", "{ open", "close }", "( a", "b )", "{ [Event ", '( [Event "in"]', "", "  ", "; rest ) } {", "{ a } ( b { ) } )", "1-0", '  [C "1"]  ', ")", "}", "\ufeff[D \"2\"]"]


def _states(lines):
    """The entry of each line, one line after the other."""
    at, out = Entry(), []
    for line in lines:
        out.append(at)
        if at.damaged:
            continue
        what = kind(line, at.brace, at.depth)
        if what == TAG:
            at = at._replace(text=False, seq=at.seq + at.text)
        elif what == TEXT:
            bad, brace, more, drop = turn(line, at.brace)
            if bad or at.depth < drop:
                at = at._replace(damaged=True)
            else:
                at = at._replace(brace=brace, depth=at.depth + more, text=True)
    return [*out, at]


@hypothesis.settings(max_examples=400, deadline=None)
@hypothesis.given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_effects_give_the_state_at_every_cut(lines):
    states = _states(lines)
    whole = effect(lines)
    assert _same(Entry().after(whole), states[-1])
    for i in range(len(lines) + 1):
        first = Entry().after(effect(lines[:i]))
        assert _same(first, states[i])
        for j in range(i, len(lines) + 1):
            assert _same(first.after(effect(lines[i:j])), states[j])


def _same(a, b):
    return a.damaged == b.damaged and a.seq == b.seq if a.damaged or b.damaged else a == b


@hypothesis.settings(max_examples=200, deadline=None)
@hypothesis.given(st.lists(st.sampled_from(PIECES), max_size=10), st.booleans(), st.integers(0, 5))
def test_effects_hold_for_every_entry(lines, brace, depth):
    """Against a reading that really entered so: the same lines after ones that open so much."""
    before = ["( x"] * depth + (["{ y"] if brace else [])
    want = _states([*before, *lines])[-1]
    assert _same(Entry().after(effect(before)).after(effect(lines)), want)


def test_long_openings_and_closings():
    lines = ["( a"] * 50 + ["b )"] * 50 + ['[E "x"]', "1. e4", '[E "y"]']
    assert Entry().after(effect(lines)) == Entry(False, 0, False, 2)
    assert Entry(depth=7, text=True).after(effect(["c )"] * 7 + ['[E "x"]'])) == Entry(False, 0, False, 1)
    assert effect(["c )"] * 500).of(False, 3).damaged


def _rows(df):
    return sorted((r.path, r.seq, r.tags, r.tag_order, r.movetext, r.error) for r in df.collect())


@pytest.mark.parametrize("size", [40, 170, 5000])
def test_reading_by_blocks_equals_reading_whole(spark, tmp_path, size):
    r = random.Random(size)
    game = lambda i: f'[Event "e{i}"]\n[White "a \\"b\\" ( {{"]\n\n1. e4 {{ [Event "in a comment"]\n\n[X "y"] }} e5 ( 1... c5 {{ ) }}\n[Event "in a variation"]\n) 2. Nf3 é\n1-0\n\n'
    texts = {
        "plain": "".join(game(i) for i in range(40)),
        "mark and returns": "\ufeff" + "".join(game(i) for i in range(9)).replace("\n", "\r\n"),
        "long record": '[Event "x"]\n' + "1. e4 e5\n" * 300 + '[Event "y"]\n*',
        "unclosed": game(1) + game(2) + '[Event "z"]\n1. e4 ( e5\n' + '[Event "w"]\n' * 30,
        "damaged": game(1) * 12 + "1. e4 } e5\n" + game(2) * 5,
        "no tags": "1. e4 e5\n1. d4",
        "empty": "",
        "tags alone": '[Event "x"]\n[Site "y"]',
    }
    for k in range(6):
        texts[f"random {k}"] = "\n".join(r.choice(PIECES[:9] + PIECES[10:16]) if r.random() < 0.3 else r.choice(PIECES[:1] + PIECES[3:4]) for _ in range(80))
    for name, text in texts.items():
        (tmp_path / f"{name}.pgn").write_bytes(text.encode() + (b"\xff\n" if name == "plain" else b""))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
        got, want = _rows(read_games(spark, str(tmp_path))), _rows(whole_games(spark, str(tmp_path)))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert got == want and len(want) > 70 and sum(r[5] is not None for r in want) >= 2


def test_records_of_a_block_are_whole():
    assert [m for _, _, m in pgn.records(['[Event "x"]', "1. e4", '[Event "y"]', "1. d4"])] == ["1. e4", "1. d4"]
