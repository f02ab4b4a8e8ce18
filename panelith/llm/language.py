"""Language identification in two steps: the family, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.llm._common import ship, table

DIMS = 4096
UNDETERMINED = "und"
# The family of a language by its code; others are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk be pl cs sk bg sr hr sl mk bs", "baltic": "lt lv", "uralic": "fi et hu", "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur pa mr gu ne", "dravidian": "ta te kn ml", "semitic": "ar he am mt", "sinitic": "zh", "japonic": "ja", "koreanic": "ko", "celtic": "ga cy gd br", "malayic": "id ms jv",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """A unit vector of hashed counts (square roots) of runs of one to three characters over the whole text, in lower
    case, with all but letters as one kind of boundary; None if there is no letter."""
    if not text:
        return None
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[chars]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one boundary after each word
    c = np.where(letter, chars, 0)[keep].astype(np.uint32)
    c = np.concatenate(([np.uint32(0)], c, [np.uint32(0)])).astype(np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
    counts = np.zeros(DIMS)
    for h in (c[1:-1] * np.uint32(0xC2B2AE35), two * np.uint32(0x27D4EB2F) + np.uint32(7), three * np.uint32(0x165667B1) + np.uint32(13)):
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(h >> np.uint32(20), minlength=DIMS)
    x = np.sqrt(counts)
    return (x / np.sqrt(x @ x)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 30, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine with hinge loss, by dual coordinate descent. y: 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    share = np.where(y > 0, (y < 0).sum(), (y > 0).sum()) / max(1, len(y)) * 2  # both sides weigh the same
    order = np.random.RandomState(seed)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / norm[i], 0.0), c * share[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    families: tuple[str, ...]
    family_weights: np.ndarray  # a row for each family, against the rest
    pairs: dict[tuple[str, str], np.ndarray]  # within a family; positive: the first

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the logistic of the smaller of the two steps' margins. UNDETERMINED with 0 if there is no letter or nothing was learned."""
        x = features(text)
        if x is None or not self.languages:
            return UNDETERMINED, 0.0
        x = np.append(x, 1.0)
        margin, family = 5.0, self.families[0]
        if len(self.families) > 1:
            of = self.family_weights @ x
            best = np.argsort(-of, kind="stable")
            family, margin = self.families[best[0]], float(of[best[0]] - of[best[1]]) / 2
        own = [n for n in self.languages if FAMILY_OF.get(n, n) == family]
        wins = dict.fromkeys(own, 0.0)
        closest: dict[str, float] = {}
        for a, b in combinations(own, 2):
            m = float(self.pairs[a, b] @ x)
            wins[a if m >= 0 else b] += 1
            for n, d in ((a, m), (b, -m)):
                closest[n] = min(closest.get(n, 5.0), d)
        lang = max(own, key=lambda n: (wins[n], closest.get(n, 0.0)))
        return lang, float(1 / (1 + np.exp(-3 * min(margin, closest.get(lang, 5.0)))))


def train(labelled: DataFrame, per_language: int = 300) -> Model:
    """Fit on about `per_language` distinct texts of each language: a bounded sample, chosen by a hash of the text.

    labelled: (text, lang); rows with null lang or without a letter are passed over. The hash's threshold comes from the
    number of distinct texts, so copies don't thin out the others. The driver gets a count for
    each language and the sample's vectors, never texts. With no rows the model predicts nothing.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    texts = F.count_distinct(F.when(F.col("text").rlike(r"\p{L}"), F.xxhash64("text")))
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(texts.alias("n")).collect()}
    if not counts:
        return Model((), (), np.zeros((0, DIMS + 1)), {})
    top = 1 << 30
    below = F.create_map(*[F.lit(x) for n, c in sorted(counts.items()) for x in (n, min(top, int(1.3 * per_language / c * top) + 1))])
    picked = rows.withColumn("u", F.pmod(F.xxhash64("text"), F.lit(top))).filter(F.col("u") < below[F.col("lang")]).dropDuplicates(["lang", "u"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if v is None else v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["lang", "u", "x"])

    got = picked.select("lang", "u", "text").mapInArrow(run, "lang string, u long, x binary").filter("x is not null").toPandas().sort_values(["lang", "u"])
    got = got.groupby("lang").head(per_language)
    x = np.array([np.frombuffer(v, np.float16) for v in got.x], np.float32).reshape(-1, DIMS)
    lang = got.lang.to_numpy()
    languages = tuple(sorted(set(lang)))
    family = np.array([FAMILY_OF.get(n, n) for n in lang])
    families = tuple(sorted(set(family)))
    weights = np.array([svm(x, np.where(family == f, 1, -1)) for f in families]) if len(families) > 1 else np.zeros((len(families), DIMS + 1))
    pairs = {}
    for a, b in combinations(languages, 2):
        if FAMILY_OF.get(a, a) == FAMILY_OF.get(b, b):
            own = (lang == a) | (lang == b)
            pairs[a, b] = svm(x[own], np.where(lang[own] == a, 1, -1))
    return Model(languages, families, weights, pairs)


def predict(df: DataFrame, model: Model, text: str = "text", into: str | None = None) -> DataFrame:
    """df with lang_pred and score (or with a struct of them named `into`), from the whole text alone. Null, empty and letterless texts get UNDETERMINED and 0; clashing columns are replaced."""
    ship(df.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    if into:
        return df.withColumn(into, run(F.col(text).cast("string")))
    return df.drop("lang_pred", "score").withColumn("_p", run(F.col(text).cast("string"))).select("*", "_p.*").drop("_p")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op5_language_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
