"""Lexicon files and the other inputs of analysis and evaluation, and their sinks.

Readers are lenient row by row and never drop silently: each gives its rows with a `reason`
where one is malformed, and a plain reader that leaves those out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions import orthography as o
from wordloom.functions.local import local

#: A small lexicon of our own, as lines of a lexicon file.
BUILTIN = """
# nouns
cat N REG
dog N REG
book N REG
friend N REG
form N REG
nation N REG
king N REG
child N IRR_CHILD PLURAL=children
mouse N IRR_MOUSE PLURAL=mice
sheep N IRR_SHEEP PLURAL=sheep
ox N IRR_OX PLURAL=oxen
city N Y_FINAL
story N Y_FINAL
fly N Y_FINAL
box N SIBILANT
church N SIBILANT
wish N SIBILANT
potato N SIBILANT
horse N SILENT_E
fame N SILENT_E
power N REG
hope N SILENT_E
widget N REG
ring N REG
# verbs
walk V REG
play V REG
form V REG
read V REG PAST=read PAST_PART=read
work V REG
govern V REG
act V REG
carry V Y_FINAL
fly V Y_FINAL PAST=flew PAST_PART=flown
deny V Y_FINAL
rely V Y_FINAL
pass V SIBILANT
wash V SIBILANT
stop V DOUBLE_CONS
run V DOUBLE_CONS PAST=ran PAST_PART=run
plan V DOUBLE_CONS
hope V SILENT_E
bake V SILENT_E
create V SILENT_E
argue V SILENT_E
go V IRR_GO PAST=went PAST_PART=gone
be V IRR_BE PAST=was PAST_PART=been THIRD_SG=is
have V IRR_HAVE PAST=had PAST_PART=had THIRD_SG=has
do V IRR_DO PAST=did PAST_PART=done
sing V IRR_SING PAST=sang PAST_PART=sung
bring V IRR_RING PAST=brought PAST_PART=brought
swim V IRR_SWIM PAST=swam PAST_PART=swum
can V IRR_GO PAST=could PRES_PART=able
# adjectives
kind ADJ REG
kind N REG
quick ADJ REG
cold ADJ REG
small ADJ REG
red ADJ DOUBLE_CONS
big ADJ DOUBLE_CONS
happy ADJ Y_FINAL
easy ADJ Y_FINAL
large ADJ SILENT_E
true ADJ SILENT_E
good ADJ REG COMP=better SUP=best
national ADJ REG
# adverbs and others
soon ADV REG
often ADV REG
"""
CLOSED = """
a an the of and or but to in on at by for with from as is are was be been it its this that these those he she they we you i
not no nor so if then than when where who whom which what how all any some each every do does did has have had will would
can could may might must shall should his her their our your my me him them us up out over under again once here there
"""

WIKTIONARY = "word string, pos string, forms array<struct<form:string,tags:array<string>>>, _corrupt string"


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value, load_ord, line_no) of text files, plain or compressed, in the order given. A path that is
    missing is looked for with .gz; FileNotFoundError where neither is there."""
    out = None
    for i, path in enumerate(paths):
        df = spark.read.text(existing(spark, path)).select(F.regexp_replace("value", "\r$", "").alias("value"), F.lit(i).alias("load_ord"), F.monotonically_increasing_id().alias("line_no"))
        out = df if out is None else out.unionByName(df)
    return out


def existing(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for p in (path, f"{path}.gz"):
        at = hadoop(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return p
    raise FileNotFoundError(path)


def text_lines(spark: SparkSession, text: str) -> DataFrame:
    return local(spark, [(v, 0, i) for i, v in enumerate(text.split("\n"))], "value string, load_ord int, line_no long")


def lexicon_rows(source: DataFrame) -> DataFrame:
    """Parsed lexicon lines with `reason`: comment, short, class, or null for a lexeme.

    Unknown parts of speech are nouns, unknown features plurals; a weight that is no number, and
    a token without `=`, don't count; of equal features the last counts.
    """
    cols = F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0))
    code = F.coalesce(F.get(cols, F.lit(1)), F.lit(""))
    known = dict.fromkeys(o.POS) | {"NOUN": "N", "VERB": "V", "ADJECTIVE": "ADJ", "ADVERB": "ADV", "FUNCTION": "FUNC"}
    pos = F.lit("N")
    for k, v in known.items():
        pos = F.when(code == k, v or k).otherwise(pos)
    pairs = F.filter(F.slice("cols", 4, 10_000), lambda x: x.contains("="))
    key, value = (lambda x: F.substring_index(x, "=", 1)), (lambda x: F.expr("1") if x is None else F.regexp_replace(x, "^[^=]*=", ""))
    feature = lambda k: F.coalesce(F.try_element_at(F.create_map(*(F.lit(y) for kv in o.FEATURES.items() for y in kv)), k), F.lit("+PL"))
    entry = F.aggregate(
        F.filter(pairs, lambda x: key(x) != "WEIGHT"), F.create_map().cast("map<string,string>"),
        lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != feature(key(x))), F.create_map(feature(key(x)), value(x))),
    )
    weights = F.filter(F.transform(F.filter(pairs, lambda x: key(x) == "WEIGHT"), lambda x: value(x).try_cast("float")), lambda x: x.isNotNull())
    weight = F.try_element_at(weights, F.lit(-1))
    stem_class = F.get("cols", F.lit(2))
    reason = F.when((F.size("cols") == 0) | F.col("value").rlike(r"^\s*#"), "comment").when(F.size("cols") < 3, "short").when(~stem_class.isin(*o.REGULAR, *o.IRREGULAR), "class")
    return source.withColumn("cols", cols).select(
        "value", "load_ord", "line_no", F.get("cols", F.lit(0)).alias("stem"), pos.alias("pos"), stem_class.alias("stem_class"), F.coalesce(weight, F.lit(1.0)).cast("float").alias("weight"), weight.isNotNull().alias("weight_known"), entry.alias("irregular"), reason.alias("reason")
    )


def lexicon(source: DataFrame) -> DataFrame:
    """Lexemes in load order; the same stem may come again and is kept."""
    rows = lexicon_rows(source).where("reason is null")
    return rows.select((F.col("load_ord").cast("long") * (1 << 52) + F.col("line_no")).alias("lex_id"), "stem", "pos", "stem_class", "weight", "weight_known", "irregular")


#: Settings of a session that name its own lexicon and closed-class files, several by commas: what a site reads always.
LEXICON_FILES, CLOSED_FILES = "spark.wordloom.lexicon", "spark.wordloom.closed"


def named_files(spark: SparkSession, setting: str) -> list[str]:
    return [p.strip() for p in (spark.conf.get(setting, None) or "").split(",") if p.strip()]


def builtin(spark: SparkSession, *paths: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """Our own lexemes, then the session's files, optional supplements, and the files asked for. All but supplements must exist."""
    source = text_lines(spark, BUILTIN)
    paths = (*named_files(spark, LEXICON_FILES), *paths)
    more = []
    for p in optional:
        try:
            more.append(existing(spark, p))
        except FileNotFoundError:
            pass
    if [*more, *paths]:
        source = source.unionByName(lines(spark, *more, *paths).withColumn("load_ord", F.col("load_ord") + 1))
    return lexicon(source)


def merged(*lexicons: DataFrame) -> DataFrame:
    """Union in order, duplicates kept."""
    out = None
    for i, df in enumerate(lexicons):
        df = df.withColumn("lex_id", F.col("lex_id") + (i << 56))
        out = df if out is None else out.unionByName(df)
    return out


def closed_class(source: DataFrame) -> DataFrame:
    """(word): the first column of each line, folded."""
    first = F.regexp_extract("value", r"^\s*(\S+)", 1)
    return source.where(~F.col("value").rlike(r"^\s*(#|$)")).select(o.ascii_lower(first).alias("word")).distinct()


def builtin_closed(spark: SparkSession) -> DataFrame:
    """Our own closed-class words and those of the session's files."""
    own, files = local(spark, [(w,) for w in sorted(set(CLOSED.split()))], "word string"), named_files(spark, CLOSED_FILES)
    return own.unionByName(closed_class(lines(spark, *files))).distinct() if files else own


def frequency(source: DataFrame) -> DataFrame:
    """(word, zipf) of word<TAB>zipf lines; others don't count."""
    parts = F.split("value", "\t")
    return source.where(~F.col("value").startswith("#")).select(F.get(parts, F.lit(0)).alias("word"), F.get(parts, F.lit(1)).try_cast("double").alias("zipf"), F.size(parts).alias("n")).where("n = 2 and zipf is not null").drop("n")


def words(source: DataFrame) -> DataFrame:
    """Lines in order, duplicates kept; blank lines don't count."""
    return source.where("trim(value) <> ''").select(F.trim("value").alias("word"), "load_ord", "line_no")


def read_wiktionary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary entries, one JSON object a line; bad lines have `_corrupt`."""
    return spark.read.schema(WIKTIONARY).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def gold_rows(source: DataFrame) -> DataFrame:
    """(word, pieces, line_no, reason) of word<TAB>a|b lines."""
    parts = F.split("value", "\t", -1)
    rows = source.where("trim(value) <> '' and not startswith(value, '#')").select(F.get(parts, F.lit(0)).alias("word"), F.split(F.get(parts, F.lit(1)), r"\|", -1).alias("pieces"), F.size(parts).alias("n"), "line_no")
    reason = F.when(F.col("n") != 2, "columns").when(F.exists("pieces", lambda p: p == ""), "empty piece").when(F.array_join("pieces", "") != F.col("word"), "pieces don't rebuild the word")
    return rows.withColumn("reason", reason).drop("n")


def gold(source: DataFrame) -> DataFrame:
    """(word, pieces); of a word that comes again the last line counts."""
    return gold_rows(source).where("reason is null").groupBy("word").agg(F.max_by("pieces", "line_no").alias("pieces"))


def counts(source: DataFrame) -> DataFrame:
    """(item, cnt) of item<TAB>count lines."""
    parts = F.split("value", "\t")
    return source.select(F.get(parts, F.lit(0)).alias("item"), F.get(parts, F.lit(1)).try_cast("long").alias("cnt")).where("cnt is not null")


def _common(a: Column, b: Column) -> Column:
    return F.substring(a, F.lit(1), o.common_prefix(a, b))


def inflection_gold(rows: DataFrame) -> DataFrame:
    """(form, source, pieces, reason) of (lemma, form, feature, segmentation): gold from inflection tables.
    The cut is after what lemma and form share."""
    stem = _common(F.col("lemma"), F.col("form"))
    pieces = F.array(stem, F.expr("substring(form, length(stem) + 1)"))
    reason = (
        F.when(~F.col("lemma").rlike("^[a-z]+$") | ~F.col("form").rlike("^[a-z]+$"), "characters")
        .when(F.col("form") == F.col("lemma"), "unchanged")
        .when(F.length("stem") == F.length("form"), "no ending")
        .when(F.col("stem") == "", "nothing shared")
    )
    return rows.withColumn("stem", stem).select("form", F.col("stem").alias("measured"), F.substring_index("feature", "|", 1).alias("kind"), pieces.alias("pieces"), reason.alias("reason"))


def derivation_gold(rows: DataFrame) -> DataFrame:
    """(form, source, pieces, reason) of (source, target, affix, kind): gold from derivation tables. A
    prefix is cut where the target starts with it; a suffix after what source and target share."""
    stem = _common(F.col("source"), F.col("target"))
    prefixed = F.col("kind") == "prefix"
    pieces = F.when(prefixed, F.array("affix", F.expr("substring(target, length(affix) + 1)"))).otherwise(F.array("stem", F.expr("substring(target, length(stem) + 1)")))
    reason = (
        F.when(~F.col("source").rlike("^[a-z]+$") | ~F.col("target").rlike("^[a-z]+$"), "characters")
        .when(prefixed & (~F.expr("startswith(target, affix)") | (F.col("target") == F.col("affix"))), "prefix absent")
        .when(~prefixed & ((F.col("stem") == "") | (F.length("stem") == F.length("target"))), "no cut")
    )
    return rows.withColumn("stem", stem).select(F.col("target").alias("form"), F.col("source").alias("measured"), "kind", pieces.alias("pieces"), reason.alias("reason"))


def columns(source: DataFrame, *names: str) -> DataFrame:
    """The first fields of tab-separated lines (value) by name; lines with fewer don't count."""
    parts = F.split("value", "\t", -1)
    return source.where(F.size(parts) >= len(names)).select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def read_inflections(spark: SparkSession, *paths: str) -> DataFrame:
    """(lemma, form, feature, segmentation) of inflection tables, for inflection_gold."""
    return columns(lines(spark, *paths), "lemma", "form", "feature", "segmentation")


def read_derivations(spark: SparkSession, *paths: str) -> DataFrame:
    """(source, target, source_pos, target_pos, affix, kind) of derivation tables, for derivation_gold."""
    return columns(lines(spark, *paths), "source", "target", "source_pos", "target_pos", "affix", "kind")


def read_lemmas(spark: SparkSession, *paths: str) -> DataFrame:
    """(word): the distinct first fields of the lines of an inflection table that have more than one."""
    parts = F.split("value", "\t", 2)
    return lines(spark, *paths).where((F.size(parts) == 2) & (F.get(parts, F.lit(1)) != "")).select(F.get(parts, F.lit(0)).alias("word")).distinct()


def parsed_gold(rows: DataFrame, suffixes_only: bool = False) -> DataFrame:
    """(form, pieces) of (word, parse): bracketed parses whose morphemes concatenate to the word. suffixes_only:
    the opening bracket of a prefix isn't read as one, so that parses with prefixes give nothing."""
    pieces = o.flat_parse(F.col("parse"), suffixes_only)
    return rows.select(F.lower("word").alias("form"), pieces.alias("pieces")).where((F.size("pieces") > 0) & (F.array_join("pieces", "") == F.col("form")))


def read_xlsx(spark: SparkSession, path: str, columns: tuple[str, ...] = ("Word", "MorphoLexSegm")) -> DataFrame:
    """The named columns of every sheet that has them, of workbooks at path. A workbook is a zip of XML and
    goes through Python, one a task."""
    names = list(columns)

    def read(batches):
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        local = lambda e: e.tag.rpartition("}")[2]
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = [""]
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(si) == "si"]
                    for sheet in sorted(n for n in z.namelist() if re.match(r"xl/worksheets/[^/]+\.xml$", n)):
                        head, rows = None, []
                        for row in (e for e in ElementTree.fromstring(z.read(sheet)).iter() if local(e) == "row"):
                            cells = {}
                            for c in row:
                                text = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
                                cells[re.sub(r"\d", "", c.get("r", ""))] = shared[int(text)] if c.get("t") == "s" and text else text
                            if head is None:
                                head = {v: k for k, v in cells.items()}
                            elif all(n in head for n in names):
                                rows.append([cells.get(head[n]) for n in names])
                        yield pd.DataFrame(rows, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, ", ".join(f"{n} string" for n in names))


# Sinks


def write_lexicon(entries: DataFrame, path: str) -> None:
    """stem, part of speech, class, features in fixed order, weight, by tabs; ordered by load order."""
    features = [F.when(F.map_contains_key("irregular", F.lit(tag)), F.concat(F.lit(f"{name}="), F.element_at("irregular", F.lit(tag)))) for name, tag in o.FEATURES.items()]
    weight = F.when(F.col("weight_known"), F.concat(F.lit("WEIGHT="), o.six_digits(F.col("weight"))))
    entries.orderBy("lex_id").select(F.concat_ws("\t", "stem", "pos", "stem_class", *features, weight).alias("value")).write.text(path)


def write_frequency(freq: DataFrame, path: str) -> None:
    freq.orderBy(F.desc("zipf"), "word").select(F.concat_ws("\t", "word", F.format_string("%.2f", "zipf")).alias("value")).write.text(path)


def write_counts(items: DataFrame, path: str) -> None:
    items.orderBy(F.desc("cnt"), "item").select(F.concat_ws("\t", "item", F.col("cnt").cast("string")).alias("value")).write.text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of few rows as JSON, in one file."""
    report.coalesce(1).write.json(path)


def write_differences(rows: DataFrame, path: str) -> None:
    """evaluate.differences() as tab-separated lines with a head, the commonest words first."""
    rows.orderBy(F.desc("cnt"), "word").write.option("sep", "\t").option("header", True).csv(path)


def load_stats(lexeme: DataFrame) -> DataFrame:
    """(lexemes, states, transitions): of the trie that the stems would make."""
    stems = lexeme.select("stem").distinct().where("stem <> ''")
    nodes = stems.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda i: F.substring(F.col("stem"), F.lit(1), i))).alias("p"))
    return lexeme.agg(F.count("*").alias("lexemes")).join(F.broadcast(nodes.agg((F.count_distinct("p") + 1).alias("states"), F.count_distinct("p").alias("transitions"))))


def read_prefix_rules(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, attaches, prefix_ord) of a tab-separated file: a prefix and the parts of speech that it attaches to, separated
    by spaces; lines that begin with # and blank ones are left out. Such rows make a Language's `prefixes`."""
    rows = lines(spark, path).where(~F.col("value").rlike(r"^\s*(?:#|$)")).select(F.split("value", "\t", 2).alias("f"), "line_no")
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("line_no")) - 1  # a few dozen rows
    return rows.select(F.trim(F.get("f", F.lit(0))).alias("prefix"), F.split(F.trim(F.coalesce(F.get("f", F.lit(1)), F.lit(""))), r"\s+").alias("attaches"), order.alias("prefix_ord"))
