"""Automata against a search of every path, and the lexical transducer against generated forms."""

import itertools
import random
from collections import defaultdict

import pytest

from wordloom.functions.local import local
from wordloom.operators import analyze as an
from wordloom.operators import automata, generate
from wordloom.sources import lexicon as lx


def searched(arcs, finals, start, symbols, most=40):
    """All outputs by brute force."""
    out, seen, todo = set(), set(), [(start, 0, ())]
    while todo:
        state, at, written = todo.pop()
        if (state, at, written) in seen or len(written) > most:
            continue
        seen.add((state, at, written))
        if at == len(symbols) and state in finals:
            out.add(written)
        for s, d, i, o in arcs:
            if s == state and (not i or (at < len(symbols) and symbols[at] == i)):
                todo.append((d, at + bool(i), written + ((o,) if o else ())))
    return out


def run(spark, arcs, finals, inputs, start=0):
    a, f = local(spark, arcs, automata.ARCS), local(spark, [(s,) for s in finals], "state int")
    got = defaultdict(set)
    for r in automata.transduce(local(spark, list(enumerate(inputs)), "id int, symbols array<string>"), a, f, start).collect():
        assert tuple(r.output) not in got[r.id]
        got[r.id].add(tuple(r.output))
    return got


def test_chains_of_empty_arcs_and_circles(spark):
    arcs, finals, state = [], [0], 1
    inputs = [["x"], [], ["c", "c"], ["c"], ["d"]]
    for n in range(1, 21):  # k<n> is followed by n empty arcs, each of which writes
        path = [0, *range(state, state + n + 1)]
        state += n + 1
        arcs.append((path[0], path[1], f"k{n}", ""))
        arcs += [(a, b, "", "abcde"[i % 5]) for i, (a, b) in enumerate(zip(path[1:], path[2:]))]
        finals.append(path[-1])
        inputs.append([f"k{n}"])
    # A circle of empty arcs that write nothing, with ways in and out.
    a, b, c = state, state + 1, state + 2
    arcs += [(0, a, "c", "C"), (a, b, "", ""), (b, c, "", ""), (c, a, "", ""), (c, a, "c", ""), (b, 0, "", ""), (0, a, "", "")]
    got = run(spark, arcs, finals, inputs)
    for i, symbols in enumerate(inputs):
        assert got[i] == searched(arcs, finals, 0, symbols)
    assert got[1] == {()} and ("C", "C") in got[2] and got[24] == {tuple("abcde" * 4)}


def test_a_circle_that_writes_is_an_error(spark):
    with pytest.raises(ValueError, match="without end"):
        run(spark, [(0, 1, "a", ""), (1, 2, "", "x"), (2, 1, "", "")], [1], [["a"]])
    # Whether an input is accepted is known all the same.
    a, f = local(spark, [(0, 1, "a", ""), (1, 2, "", "x"), (2, 1, "", "")], automata.ARCS), local(spark, [(1,)], "state int")
    assert {r.id: r.accepted for r in automata.accepts(local(spark, [(0, ["a"]), (1, ["b"]), (2, [])], "id int, symbols array<string>"), a, f).collect()} == {0: True, 1: False, 2: False}


def acyclic_empty(r, states, symbols, n):
    """Random arcs; empty ones lead upwards, so that they make no circle."""
    arcs = set()
    for _ in range(n):
        s, d = r.randrange(states), r.randrange(states)
        i = r.choice([*symbols, ""])
        if i or s < d:
            arcs.add((s, d, i, r.choice(["u", "v", ""])))
    return sorted(arcs)


def test_random_machines_and_their_composition(spark):
    r = random.Random(11)
    inputs = [list(x) for n in range(4) for x in itertools.product("ab", repeat=n)]
    for _ in range(3):
        first, second = acyclic_empty(r, 4, "ab", 9), [(s, d, {"a": "u", "b": "v"}.get(i, ""), o) for s, d, i, o in acyclic_empty(r, 3, "ab", 8)]
        finals = [[0, 3], [1, 2]]
        got = run(spark, first, finals[0], inputs)
        for i, symbols in enumerate(inputs):
            assert got[i] == searched(first, finals[0], 0, symbols)
        machines = [automata.Machine(local(spark, a, automata.ARCS), local(spark, [(s,) for s in f], "state int")) for a, f in zip((first, second), finals)]
        both = automata.compose(*machines)
        want = {i: {z for y in searched(first, finals[0], 0, x) for z in searched(second, finals[1], 0, list(y))} for i, x in enumerate(inputs)}
        out = defaultdict(set)
        asked = local(spark, list(enumerate(inputs)), "id int, symbols array<string>")
        for x in automata.transduce(asked, both.arcs, both.finals, both.start).collect():
            out[x.id].add(tuple(x.output))
        assert {i: out[i] for i in want} == want


def test_an_empty_table_and_a_machine_without_a_final_state(spark):
    arcs = local(spark, [(0, 1, "a", "b")], automata.ARCS)
    none, one = local(spark, [], "state int"), local(spark, [(1,)], "state int")
    inputs = local(spark, [(1, ["a"]), (2, None), (None, ["a"])], "id int, symbols array<string>")
    assert automata.transduce(inputs, arcs, none).count() == 0 and automata.transduce(inputs.where("false"), arcs, one).count() == 0
    assert sorted((r.id or 0) for r in automata.transduce(inputs, arcs, one).collect()) == [0, 1]
    m = automata.compose(automata.Machine(arcs, one), automata.Machine(arcs, one))  # b is not read
    assert m.arcs.count() == 0


def test_lexical_transducer_generates_and_analyses(spark):
    lexemes = [(1, "stop", "V", "DOUBLE_CONS", {}), (2, "pity", "N", "Y_FINAL", {}), (3, "box", "N", "SIBILANT", {}), (4, "bake", "V", "SILENT_E", {"+PAST": "boke"}), (5, "tall", "ADJ", "REG", {}), (6, "tal", "N", "REG", {}), (7, "of", "FUNC", "REG", {}), (8, "box", "V", "SIBILANT", {})]
    table = local(spark, [(i, s, p, c, 1.0, False, list(f.items())) for i, s, p, c, f in lexemes], an.LEXEME)
    rules = an.Ruleset.of(table, lx.builtin_closed(spark))
    want = {(r.lex_id, r.origin, r.surface) for r in generate.generated_forms(rules).where("origin like '+%'").collect()}
    m = automata.lexical_machine(rules)
    assert {(r.lex_id, r.tag, r.surface) for r in automata.lexical_forms(rules, m).collect()} == want and len(want) > 12
    words = sorted({w for _, _, w in want} | {"boke", "stoped", "taller", "", "boxs"})
    got = {(r.lex_id, r.tag, r.word) for r in automata.lexical_analyses(local(spark, [(w,) for w in words], "word string"), rules, m).collect()}
    assert got == want
