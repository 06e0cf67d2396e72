"""Language identification by a string kernel.

A text's features are the byte n-grams (n = 1, 2, 3: a blended spectrum) of its lower-cased
UTF-8, non-letters of ASCII made spaces, each present or not. The kernel of two texts is the
number of n-grams they share over the geometric mean of their numbers. Landmarks from a
bounded labelled sample give a Nystroem map; ridge regression on it, one against the rest,
gives a weight to each landmark and language. A text's scores are a product of its presence
vector, the landmarks' presence matrix and the weights; the last two are multiplied once, so
batches of texts take one matrix product.

The scores of K languages sum to about 1 for any text, so a winner's score says which language,
not whether it is one of them. That is said by `known`, the share of a text's distinct 3-grams
that the landmarks hold.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table

#: Bound of the labelled sample and the number of landmarks, both of each language, and both of all languages, which share
#: them where they are many.
SAMPLE, LANDMARKS = 300, 48
ALL_SAMPLE, ALL_LANDMARKS, ALL_BYTES = 15_000, 2_400, 128 << 20
#: Bytes of the longest text that is learned from where there are shorter ones; of longer ones so many characters are.
LONGEST = 1 << 18
RIDGE, BLOCK = 0.05, 64
#: A text of a learned language has at least this share of its 3-grams in the landmarks, or as much as
#: all but a hundredth of the labelled sample have where that is less.
LEAST_KNOWN = 0.7
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_TO = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
_BASE = (0, 1 << 8, (1 << 8) + (1 << 16))  # of codes of 1-, 2- and 3-grams
CODES = _BASE[2] + (1 << 24)


def codes(text: str) -> np.ndarray:
    """The n-grams of a text, with repeats."""
    a = np.frombuffer(text.lower().encode("utf-8", "surrogatepass").translate(_TO), np.uint8).astype(np.int32)
    two = a[:-1] << 8 | a[1:]
    return np.concatenate([a, two + _BASE[1], (two[:-1] << 8 | a[2:]) + _BASE[2]])


class Model:
    """languages; vocab: n-gram codes of the landmarks; weights: a row for each of vocab, a column for each language."""

    def __init__(self, sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.languages = sorted({lang for _, lang in sample})
        texts = [t for t, _ in sample]
        marks = [i for lang in self.languages for i in [j for j, (_, x) in enumerate(sample) if x == lang][:landmarks]]
        self.vocab = np.unique(np.concatenate([np.unique(codes(texts[i])) for i in marks])) if marks else np.zeros(0, np.int32)
        z = self.presence([texts[i] for i in marks])
        z = z / np.sqrt(np.maximum(1, z.sum(axis=1, keepdims=True)))
        self.least_known = self.calibrated(texts, marks)
        kernel = np.concatenate([self.kernel(texts[i : i + BLOCK], z) for i in range(0, len(texts), BLOCK)]) if texts else np.zeros((0, 0))
        if not len(self.languages):
            self.weights = np.zeros((0, 0), np.float32)
            return
        value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
        ok = value > 1e-6 * value.max()
        into = vector[:, ok] / np.sqrt(value[ok])
        phi = np.hstack([kernel @ into, np.ones((len(kernel), 1))])
        y = np.where(np.array([x for _, x in sample])[:, None] == np.array(self.languages), 1.0, -1.0)
        w = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
        self.bias = w[-1].astype(np.float32)
        self.weights = (z.T.astype(np.float64) @ (into @ w[:-1])).astype(np.float32)

    @functools.cached_property
    def place(self) -> np.ndarray:
        place = np.zeros(CODES, np.uint16 if len(self.vocab) < 65535 else np.int32)
        place[self.vocab] = np.arange(1, len(self.vocab) + 1)
        return place

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "place"}

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Presence of vocab; roots of the numbers of distinct n-grams, those outside vocab too; known."""
        p, size, known = np.zeros((len(texts), len(self.vocab) + 1), np.float32), np.zeros((len(texts), 1), np.float32), np.zeros(len(texts))
        first = int(np.searchsorted(self.vocab, _BASE[2]))  # of 3-grams in vocab
        for i, t in enumerate(texts):
            c = codes(t)
            at = self.place[c]
            p[i, at] = 1
            strange = np.unique(c[at == 0])
            size[i] = p[i, 1:].sum() + len(strange)
            have, lack = p[i, 1 + first :].sum(), (strange >= _BASE[2]).sum()
            # Texts of one or two bytes have shorter n-grams only.
            known[i] = have / (have + lack) if have + lack else 1 - len(strange) / max(1.0, size[i, 0])
        return p[:, 1:], np.sqrt(np.maximum(1, size)), known

    def calibrated(self, texts: list[str], marks: list[int]) -> float:
        """The least share of known 3-grams: LEAST_KNOWN, or less where the sample's texts have less. A
        landmark's 3-grams count as known where another landmark has them."""
        if not texts:
            return 0.0
        own = [np.unique(codes(texts[i])) for i in marks]
        holders = np.bincount(np.concatenate([self.place[u] for u in own]), minlength=len(self.vocab) + 1)
        others = sorted(set(range(len(texts))) - set(marks))
        shares = [float((holders[self.place[t]] > 1).mean()) for u in own if len(t := u[u >= _BASE[2]])]
        for i in range(0, len(others), BLOCK):
            shares += self.read([texts[j] for j in others[i : i + BLOCK]])[2].tolist()
        return min(LEAST_KNOWN, float(np.quantile(shares, 0.01))) if shares else 0.0

    def presence(self, texts: list[str]) -> np.ndarray:
        return self.read(texts)[0]

    def kernel(self, texts: list[str], z: np.ndarray) -> np.ndarray:
        p, size, _ = self.read(texts)
        return (p @ z.T) / size

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, known): the score is the winner's regression value, from -1..1 to 0..1."""
        out = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        if not self.languages:
            return out
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        for i in range(0, len(known), BLOCK):
            part = known[i : i + BLOCK]
            p, size, share = self.read([texts[j] for j in part])
            f = (p @ self.weights) / size + self.bias
            best = f.argmax(axis=1)
            for j, b, v, k in zip(part, best, f[np.arange(len(part)), best], share):
                out[j] = (self.languages[b], float(min(1.0, max(0.0, (1 + v) / 2))), float(k))
        return out


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, all_bytes: int = ALL_BYTES) -> Model:
    """Learn from at most `sample` documents of each language, the first by a hash of the id, of those
    with a text, a language and an id that is not held out. Texts over LONGEST bytes come last and are read up to so many
    characters. Many languages share ALL_SAMPLE documents, ALL_LANDMARKS landmarks and all_bytes bytes, each at least one
    document. Ids and languages alone are ranked. An id that repeats is one document: the largest of its rows by
    language and text."""
    fit = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out()
    size = F.octet_length("text").cast("long")
    light = docs.where(fit).groupBy("doc_id").agg(F.max("lang").alias("lang"), F.max(size).alias("bytes"))
    counted = staged(light.groupBy("lang").agg(F.count("*").alias("k")), "languages")
    languages = max(1, counted.count())
    sample, landmarks = max(1, min(sample, ALL_SAMPLE // languages)), max(1, min(landmarks, ALL_LANDMARKS // languages))
    # A share of each language that holds four samples of it goes on to be ranked, however large it is.
    share = counted.select("lang", F.least(F.lit(1.0), 4.0 * sample / F.col("k")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    light = light.join(F.broadcast(share), "lang").where(place < F.col("share"))
    first = Window.partitionBy("lang").orderBy(F.col("bytes") > LONGEST, place, "doc_id")
    read = F.sum(F.least("bytes", F.lit(4 * LONGEST))).over(first.rowsBetween(Window.unboundedPreceding, 0))
    ranked = light.withColumn("n", F.row_number().over(first)).withColumn("read", read)
    ids = ranked.where((F.col("n") == 1) | ((F.col("n") <= sample) & (F.col("read") <= all_bytes // languages))).select("doc_id", "lang")
    chosen = docs.where(fit).select("doc_id", "lang", F.when(size <= LONGEST, F.col("text")).otherwise(F.left("text", F.lit(LONGEST))).alias("text"))
    rows = chosen.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.max("text").alias("text")).collect()
    rows = sorted((str(r["lang"]), r["doc_id"], r["text"]) for r in rows)
    return Model([(t, lang) for lang, _, t in rows if LETTER.search(t)], landmarks)


def predicted(text: Column, model: Model, spark: SparkSession) -> Column:
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,known:double>")
    def of(texts: pa.Array) -> pa.Array:
        got = sent.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), *(pa.array([g[i] for g in got], pa.float64()) for i in (1, 2))], ["lang_pred", "score", "known"])

    return of(text)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with held_out, lang_pred and score; columns of these names are replaced.

    The whole text is read, and nothing else of a row. A null text, or one without a letter,
    is `und` with score 0; so is every text where there is nothing to learn from. A null id is
    not held out, and not learned from.
    """
    docs = docs.drop("held_out", "lang_pred", "score")
    model = model or train(docs)
    return docs.withColumn("__p", predicted(F.col("text"), model, docs.sparkSession)).withColumns({"held_out": held_out(), "lang_pred": F.col("__p.lang_pred"), "score": F.col("__p.score")}).drop("__p")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
