"""Command line: python -m wordloom MODE [WORDS | FILE] [options].

Modes: analyze (words, or a prompt without any), segment (a word a line, JSON lines out),
text (raw text, token JSON lines out), selfcheck, stats.
"""

from __future__ import annotations

import argparse
import sys


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="wordloom", description=__doc__)
    p.add_argument("mode", choices=["analyze", "segment", "text", "selfcheck", "stats"])
    p.add_argument("inputs", nargs="*", help="words to analyze, or the file to read")
    p.add_argument("--lexicon", action="append", default=[], help="a lexicon file; must exist")
    p.add_argument("--derived-first", action="store_true")
    p.add_argument("--nbest", type=int, default=1)
    p.add_argument("--compact", action="store_true")
    a = p.parse_args(argv)
    if a.derived_first and a.mode not in ("segment", "text"):
        p.error("--derived-first orders segmentations; analyses have no order by derivation")
    if a.nbest < 1 or (a.nbest > 1 and a.mode != "segment"):
        p.error("--nbest is a positive number, of segment")
    if a.mode in ("segment", "text") and len(a.inputs) != 1:
        p.error("one file is read")
    return a


def main(argv: list[str]) -> int:
    a = arguments(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from wordloom.functions.local import local
    from wordloom.operators import analyze as an
    from wordloom.operators import generate, tokens
    from wordloom.operators import segment as sg
    from wordloom.sources import lexicon as lx
    from wordloom.sources import lines as raw

    spark = SparkSession.builder.appName("wordloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        lexeme = lx.builtin(spark, *a.lexicon).cache()
    except FileNotFoundError as e:
        print(f"no such lexicon: {e}", file=sys.stderr)
        return 2
    rules = an.Ruleset.of(lexeme, lx.builtin_closed(spark))

    def ask() -> str:
        try:
            return input("> ").strip()
        except EOFError:
            return ":quit"

    def show(words: list[str]) -> None:
        df = local(spark, [(w,) for w in words], "word string")
        found = an.analyze(df, rules)
        if a.compact:
            print("\n".join(r.text for r in an.compact_text(df, found).collect()))
            return
        text = {r.word: r.text for r in an.analysis_text(found).collect()}
        print("\n".join(text.get(w.lower(), f"{w} → (no analysis)") for w in words))

    if a.mode == "analyze" and a.inputs:
        show(a.inputs)
    elif a.mode == "analyze":
        while (line := ask()) != ":quit":
            if line == ":help":
                print(":stats :quit, or words")
            elif line == ":stats":
                print(lx.load_stats(lexeme).first().asDict())
            elif line:
                show(line.split())
    elif a.mode == "segment":
        words = lx.lines(spark, a.inputs[0]).select(F.col("value").alias("word"), "line_no")
        out = words.join(sg.jsonl(sg.segment(words, rules, a.derived_first, a.nbest), a.nbest), "word").orderBy("line_no")
        for r in out.select("value").toLocalIterator():
            print(r.value)
    elif a.mode == "text":
        records = tokens.segmented_lines(raw.read(spark, a.inputs[0]), rules, a.derived_first)
        for r in tokens.token_jsonl(records, "line").orderBy("line", "pos").select("value").toLocalIterator():
            print(r.value)
    elif a.mode == "selfcheck":
        bad = generate.selfcheck(rules).collect()
        for r in bad:
            print(r.origin, r.n, *r.examples, sep="\t")
        return int(bool(bad))
    else:
        print(lx.load_stats(lexeme).first().asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
