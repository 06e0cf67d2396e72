"""Finite automata as arc tables, run and combined as joins.

arcs: (src, dst, in_sym, out_sym); '' (or null) reads or writes nothing. finals: (state). Inputs are (id, symbols).
All inputs advance together, a join a symbol. Arcs that read nothing are taken out first, by a
fixpoint over the arcs alone, so that each later join reads a symbol. Fixpoints are semi-naive: a round
joins only what the round before found, is written, and the last finds nothing new.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import rules as r
from wordloom.functions.local import local
from wordloom.functions.staging import numbered, staged

from .analyze import Ruleset
from .generate import regular_forms

ARCS = "src int, dst int, in_sym string, out_sym string"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@dataclasses.dataclass
class Machine:
    arcs: DataFrame
    finals: DataFrame
    start: object = 0

    def inverse(self) -> Machine:
        """The machine that reads what this one writes."""
        return Machine(self.arcs.select("src", "dst", F.col("out_sym").alias("in_sym"), F.col("in_sym").alias("out_sym")), self.finals, self.start)

    def at_start(self) -> Column:
        return F.lit(self.start).cast(self.arcs.schema["src"].dataType)


def _written(symbol: str = "out_sym") -> Column:
    nothing = F.array().cast("array<string>")
    return F.when(F.coalesce(symbol, F.lit("")) == "", nothing).otherwise(F.array(symbol))


def without_empty(m: Machine) -> tuple[DataFrame, DataFrame]:
    """steps (src, dst, in_sym, output), each an arc that reads with the empty ones before it, and ends (state,
    output): what is written on the way from a state to a final one without reading.

    The closure of empty arcs is taken from the start and from where an arc that reads leads to. Empty arcs may
    go in circles; where such a circle writes, outputs are without end, and ValueError is raised.
    """
    arcs = m.arcs.select("src", "dst", F.coalesce("in_sym", F.lit("")).alias("in_sym"), _written().alias("output"))
    empty, reads = arcs.where("in_sym = ''").drop("in_sym"), arcs.where("in_sym <> ''")
    steps, ends = reads, m.finals.select("state", F.array().cast("array<string>").alias("output"))
    if not empty.isEmpty():
        empty = staged(empty.distinct(), "empty-arcs")
        hop = empty.select(F.col("src").alias("dst"), F.col("dst").alias("__to"), F.col("output").alias("__more"))
        begins = reads.select(F.col("dst").alias("src")).union(m.arcs.sparkSession.range(1).select(m.at_start().alias("src"))).distinct()
        # `way` has the states of a run, each with the symbols written before it.
        new, runs = empty.join(begins, "src", "left_semi").withColumn("way", F.array(F.struct(F.col("src").alias("state"), F.lit(0).alias("n")))), None
        while True:
            again = F.exists("way", lambda x: (x["state"] == F.col("dst")) & (x["n"] < F.size("output")))
            new = new.where(~((F.col("src") == F.col("dst")) & (F.size("output") == 0))).withColumn("again", again)
            new = new.groupBy("src", "dst", "output").agg(F.first("way").alias("way"), F.max("again").alias("again"))
            new = staged(new if runs is None else new.join(runs, ["src", "dst", "output"], "left_anti"), "empty-runs")
            state = new.agg(F.count("*"), F.max("again")).first()
            if state[1]:
                raise ValueError("arcs that read nothing write in a circle: outputs without end")
            if not state[0]:
                break
            one = new.select("src", "dst", "output")
            runs = one if runs is None else runs.union(one)
            way = F.concat("way", F.array(F.struct(F.col("dst").alias("state"), F.size("output").alias("n"))))
            new = new.withColumn("way", way).join(hop, "dst").select("src", F.col("__to").alias("dst"), F.concat("output", "__more").alias("output"), "way")
        if runs is not None:
            run = runs.select("src", F.col("dst").alias("__at"), F.col("output").alias("__before"))
            after = lambda df, at: run.join(df, F.col("__at") == df[at])
            steps = steps.union(after(reads.withColumnRenamed("src", "__src"), "__src").select("src", "dst", "in_sym", F.concat("__before", "output").alias("output")))
            ends = ends.union(after(ends, "state").select("src", F.concat("__before", "output")))
    return staged(steps.distinct(), "steps"), staged(ends.distinct(), "ends")


def transduce(inputs: DataFrame, arcs: DataFrame, finals: DataFrame, start: object = 0) -> DataFrame:
    """(id, output): all outputs (arrays of symbols) of accepted inputs, each once. As many rounds as the longest input
    has symbols, or fewer where none gets so far."""
    m = Machine(arcs, finals, start)
    steps, ends = without_empty(m)
    now, found, k = inputs.select("id", "symbols", m.at_start().alias("state"), F.array().cast("array<string>").alias("output")), None, 0
    end = ends.withColumnRenamed("output", "__end")
    while True:
        here = now.where(F.size("symbols") == k).join(end, "state").select("id", F.concat("output", "__end").alias("output"))
        found = here if found is None else found.union(here)
        step = steps.select(F.col("src").alias("state"), F.col("in_sym").alias("__symbol"), F.col("dst").alias("__to"), F.col("output").alias("__more"))
        moved = now.withColumn("__symbol", F.get("symbols", F.lit(k))).join(step, ["state", "__symbol"])
        now = staged(moved.select("id", "symbols", F.col("__to").alias("state"), F.concat("output", "__more").alias("output")).distinct(), "configurations")
        if now.isEmpty():
            return found.distinct()
        k += 1


def accepts(inputs: DataFrame, arcs: DataFrame, finals: DataFrame, start: object = 0) -> DataFrame:
    """(id, accepted), whatever the arcs write."""
    ok = transduce(inputs, arcs.withColumn("out_sym", F.lit("")), finals, start).select("id", F.lit(True).alias("ok")).distinct()
    return inputs.join(ok, "id", "left").select("id", F.coalesce("ok", F.lit(False)).alias("accepted"))


# Machines from machines


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that gives what `second` makes of what `first` writes. States are pairs, of which only those
    that the start reaches, and that reach a final one, are made; they are numbered."""
    spark = first.arcs.sparkSession
    none = lambda c: F.coalesce(c, F.lit(""))
    left = staged(first.arcs.select(F.col("src").alias("p"), F.col("dst").alias("p2"), none("in_sym").alias("in_sym"), none("out_sym").alias("mid")), "left-arcs")
    right = staged(second.arcs.select(F.col("src").alias("q"), F.col("dst").alias("q2"), none("in_sym").alias("mid"), none("out_sym").alias("out_sym")), "right-arcs")
    new = spark.range(1).select(first.at_start().alias("p"), second.at_start().alias("q"))
    seen, arcs, columns = new, None, ["p", "q", "p2", "q2", "in_sym", "out_sym"]
    while not new.isEmpty():
        read = new.join(left, "p")
        alone = read.where("mid = ''").select("p", "q", "p2", F.col("q").alias("q2"), "in_sym", F.lit("").alias("out_sym"))
        write = new.join(right.where("mid = ''"), "q").select("p", "q", F.col("p").alias("p2"), "q2", F.lit("").alias("in_sym"), "out_sym")
        both = read.where("mid <> ''").join(right, ["q", "mid"]).select(*columns)
        round_ = staged(alone.union(write).union(both).distinct(), "pair-arcs")
        arcs = round_ if arcs is None else arcs.union(round_)
        new = staged(round_.select(F.col("p2").alias("p"), F.col("q2").alias("q")).distinct().join(seen, ["p", "q"], "left_anti"), "pairs")
        seen = seen.union(new)
    finals = seen.join(first.finals.select(F.col("state").alias("p")), "p", "left_semi").join(second.finals.select(F.col("state").alias("q")), "q", "left_semi")
    ids = numbered(seen, F.col("p"), F.col("q")).select("p", "q", (F.col("number") - 1).alias("id"))
    ids = staged(ids, "pair-numbers")
    src, dst = ids.withColumnRenamed("id", "src"), ids.withColumnsRenamed({"p": "p2", "q": "q2", "id": "dst"})
    whole = arcs.join(src, ["p", "q"]).join(dst, ["p2", "q2"]).select("src", "dst", "in_sym", "out_sym")
    start = ids.where((F.col("p") == first.at_start()) & (F.col("q") == second.at_start())).first()["id"]
    return trimmed(Machine(staged(whole, "composed"), staged(finals.join(ids, ["p", "q"]).select(F.col("id").alias("state")), "composed-finals"), start))


def trimmed(m: Machine) -> Machine:
    """Only arcs on a way to a final state."""
    back = m.arcs.select(F.col("dst").alias("state"), "src").distinct()
    alive = new = m.finals.select("state").distinct()
    while True:
        new = staged(back.join(new, "state", "left_semi").select(F.col("src").alias("state")).distinct().join(alive, "state", "left_anti"), "alive")
        if new.isEmpty():
            break
        alive = alive.union(new)
    alive = staged(alive, "alive-states")
    return Machine(staged(m.arcs.join(alive.withColumnRenamed("state", "dst"), "dst", "left_semi").select("src", "dst", "in_sym", "out_sym"), "trimmed"), m.finals, m.start)


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs by prefix: src, dst, in_sym; finals): states are the prefixes themselves."""
    w = words.select("word").distinct().where("word <> ''")
    arcs = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.struct(F.substring(F.col("word"), F.lit(1), i - 1).alias("src"), F.substring(F.col("word"), F.lit(1), i).alias("dst"), F.substring(F.col("word"), i, F.lit(1)).alias("in_sym")))).alias("a")).select("a.*").distinct()
    return arcs, w.select(F.col("word").alias("state"))


# Machines of a language

#: The paradigm's transducers: (part of speech, class, tag).
TRANSDUCERS = sorted({x[:3] for x in r.PARADIGM})


def inflection_transducer(spark: SparkSession, tag: str, pos: str, stem_class: str, language: r.Language = r.ENGLISH) -> tuple[DataFrame, DataFrame]:
    """Arcs and finals of the transducer that spells a tag after stems of a class. It copies the stem's
    letters, drops the last where the paradigm cuts it or writes it twice where it doubles, and writes the
    ending for the tag: y +PL to ies, s t o p +PAST to s t o p p e d."""
    rows, states, done = [(0, 0, c, c) for c in LETTERS], 1, []
    for p, c, t, ending, cut, doubles in language.paradigm:
        if (p, c, t) != (pos, stem_class, tag):
            continue
        # What must stand last: (letter, what is written for it, what the tag writes); '' if any may.
        if cut:
            lasts = [({"Y_FINAL": "y", "SILENT_E": "e"}[stem_class], "", ending)]
        else:
            lasts = [(x, x, x + ending) for x in LETTERS if x not in "aeiouywx"] if doubles else [("", "", ending)]
        for letter, kept, written in lasts:
            if letter:
                rows.append((0, states, letter, kept))
            rows.append((states if letter else 0, states + 1, tag, written))
            done.append((states + 1,))
            states += 2
    return local(spark, rows, ARCS), local(spark, done, "state int")


def class_symbol(pos: str, stem_class: str) -> Column:
    return F.concat_ws(":", pos, stem_class)


def paradigm_machine(spark: SparkSession, language: r.Language = r.ENGLISH, letters: str = LETTERS) -> Machine:
    """Reads a stem's letters, the symbol of its part of speech and class, and a tag, and writes the form. State 0 copies
    letters; it guesses which are last and are dropped or doubled, which the class then confirms. The tag writes an
    ending's first letter, empty arcs the others."""
    rows, made = [(0, 0, c, c) for c in letters], {}

    def state(*name) -> int:
        return made.setdefault(name, len(made) + 1)

    for cut in sorted({x[4] for x in language.paradigm} - {0}):
        for i in range(cut):
            rows += [(state("cut", cut, i) if i else 0, state("cut", cut, i + 1), c, "") for c in letters]
    if any(x[5] for x in language.paradigm):
        rows += [(0, state("twice", c), c, c) for c in letters]
    for pos, stem_class, tag, ending, cut, doubles in language.paradigm:
        symbol, at = f"{pos}:{stem_class}", state("class", pos, stem_class, cut, doubles)
        lasts = [(state("twice", c), c) for c in letters] if doubles else [(state("cut", cut, cut) if cut else 0, "")]
        rows += [(last, at, symbol, written) for last, written in lasts]
        for i, out in enumerate(ending or [""]):
            after = state("end") if i + 1 >= len(ending) else state("ending", pos, stem_class, tag, ending, i)
            rows.append((at, after, "" if i else tag, out))
            at = after
    return Machine(local(spark, list(dict.fromkeys(rows)), ARCS), local(spark, [(state("end"),)], "state int"))


def lexeme_machine(rules: Ruleset) -> Machine:
    """Reads a lexeme's letters, #lex_id and a tag that its paradigm spells, and writes the letters, its class and the tag.
    Lexemes share the states of common beginnings."""
    named = lambda c: F.concat(F.lit("="), c)
    arcs, _ = trie(rules.lexeme.select(F.col("stem").alias("word")))
    letters = arcs.select(named("src").alias("src"), named("dst").alias("dst"), "in_sym", F.col("in_sym").alias("out_sym"))
    entry, forms = F.concat(F.lit("#"), F.col("lex_id").cast("string")), regular_forms(rules)
    entries = forms.select(named("stem").alias("src"), entry.alias("dst"), entry.alias("in_sym"), class_symbol("pos", "eff").alias("out_sym"))
    tags = forms.select(entry.alias("src"), F.lit("end").alias("dst"), F.col("tag").alias("in_sym"), F.col("tag").alias("out_sym"))
    return Machine(letters.union(entries.distinct()).union(tags.distinct()), rules.spark.range(1).select(F.lit("end").alias("state")), "=")


def lexical_machine(rules: Ruleset) -> Machine:
    """Lexemes composed with the paradigm: (stem, #lex_id, tag) to forms, and inverted, forms to these."""
    return compose(lexeme_machine(rules), paradigm_machine(rules.spark, rules.language))


def lexical_forms(rules: Ruleset, machine: Machine | None = None) -> DataFrame:
    """(lex_id, tag, surface): the forms that the lexical transducer gives of every lexeme and tag."""
    m = machine or lexical_machine(rules)
    asked = regular_forms(rules).select("lex_id", "stem", "tag").distinct()
    symbols = F.concat(F.split("stem", ""), F.array(F.concat(F.lit("#"), F.col("lex_id").cast("string")), "tag"))
    out = transduce(asked.select(F.struct("lex_id", "tag").alias("id"), symbols.alias("symbols")), m.arcs, m.finals, m.start)
    return out.select("id.lex_id", "id.tag", F.array_join("output", "").alias("surface")).distinct()


def lexical_analyses(words: DataFrame, rules: Ruleset, machine: Machine | None = None) -> DataFrame:
    """(word, lex_id, tag): what the lexical transducer, inverted, reads words (word) as."""
    m = (machine or lexical_machine(rules)).inverse()
    asked = words.where("word <> ''").select("word").distinct()
    out = transduce(asked.select(F.col("word").alias("id"), F.split("word", "").alias("symbols")), m.arcs, m.finals, m.start)
    entry = F.filter("output", lambda x: x.startswith("#"))
    return out.select(F.col("id").alias("word"), F.substring(F.get(entry, F.lit(0)), 2, 20).cast("long").alias("lex_id"), F.element_at("output", -1).alias("tag")).distinct()


def symbol_ids(symbols: DataFrame) -> DataFrame:
    """(symbol, id): dense ids in order of the symbols."""
    return numbered(symbols.select("symbol").distinct(), F.col("symbol")).select("symbol", (F.col("number") - 1).alias("id"))
