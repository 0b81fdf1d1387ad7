"""Language identification by multilingual mixture inference.

A language is a distribution over character trigrams (lower-cased letters, other characters are
word gaps), learned with add-``SMOOTH`` counts from labelled texts.  A document is a mixture of
languages: expectation-maximisation estimates the proportions that make its trigrams most
likely, and the set of languages is chosen by penalised likelihood: from the best single
language on, the next most probable one joins while the gain in log-likelihood is over
``PENALTY`` x log(trigrams).  The document's language is the one with the largest proportion,
and that proportion is its score.

Learning: at most about ``MAX_ROWS`` labelled rows a language, drawn by a hash of the row's id (the
bound of the fit), so a text that many rows repeat is drawn as often as its rows are; a language of
which none is drawn is left out of the model.  Trigram counts are summed on the executors, and the
driver gets one row per language and trigram bucket.  Defined cases: null text, or one without
letters, is ``und`` with score 0; with no labelled row at all every text is ``und``; repeated rows get
the same answer; of languages with equal proportions the last in code-point order is named; very long
texts are counted whole; other columns of ``docs`` aren't read, so their names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, tidied

BUCKETS = 1 << 15
SMOOTH = 0.05
MAX_ROWS = 2_000
ITERATIONS = 12
PENALTY = 4.0
#: A language whose proportion among all is under this isn't tried for the set.
LEAST_SHARE = 0.01
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each trigram around a letter of the whole text."""
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[c]
    if not letter.any():
        return np.zeros(0, np.int64)
    c = np.where(letter, c, 0)
    c = np.r_[0, c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]], 0].astype(np.uint64)
    g = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (g >> np.uint64(49)).astype(np.int64)[c[1:-1] != 0]


class Mixture:
    """EM over a trained table of trigram probabilities (buckets x languages)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.p = (counts + SMOOTH) / (counts.sum(0, keepdims=True) + SMOOTH * BUCKETS)

    def em(self, p: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        share, total = start, n.sum()
        for _ in range(ITERATIONS):
            s = p @ share
            share = share * ((n / s) @ p) / total
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str | None) -> dict[str, float]:
        """Chosen languages with their proportions; empty if there is nothing to go by."""
        grams, n = np.unique(trigrams(text), return_counts=True)
        k = len(self.languages)
        if not len(grams) or not k:
            return {}
        p, n = self.p[grams], n.astype(float)
        alone = n @ np.log(p)
        share, _ = self.em(p, n, np.full(k, 1 / k))
        chosen = [int(alone.argmax())]
        best, shares = float(alone[chosen[0]]), np.ones(1)
        price = PENALTY * math.log(n.sum() + 1)
        for j in np.argsort(-share):
            if share[j] < LEAST_SHARE:
                break
            if j in chosen:
                continue
            trial = [*chosen, int(j)]
            got, value = self.em(p[:, trial], n, np.full(len(trial), 1 / len(trial)))
            if value - best <= price:
                break
            chosen, best, shares = trial, value, got
        return {self.languages[j]: float(s) for j, s in zip(chosen, shares)}


def fit(docs: DataFrame, lang: str, text: str, usable: Column, max_rows: int = MAX_ROWS, doc_id: str = "doc_id") -> Mixture:
    """Learn from rows where ``usable`` holds and ``lang`` isn't null."""
    train = docs.where(usable & col(docs, lang).isNotNull()).select(
        col(docs, doc_id).alias("row"), col(docs, lang).cast("string").alias("lang"), col(docs, text).cast("string").alias("text")
    )
    # One row per language.
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Mixture([], np.zeros((BUCKETS, 0)))
    place = {v: k for k, v in enumerate(languages)}
    rate = F.element_at(F.create_map(*(x for v in languages for x in (F.lit(v), F.lit(min(1.0, max_rows / sizes[v]))))), F.col("lang"))
    # A row without an id is drawn by its text.
    key = F.when(F.col("row").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.lit(3), "row"))
    drawn = train.where(F.pmod(key, F.lit(1 << 20)) < rate * (1 << 20)).select("lang", "text")
    schema = T.StructType([T.StructField("lang", T.IntegerType(), False), T.StructField("bucket", T.IntegerType(), False), T.StructField("n", T.LongType(), False)])

    def count(batches):
        sums = {}
        for b in batches:
            for v, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = place[v]
                if k not in sums:
                    sums[k] = np.zeros(BUCKETS, np.int64)
                sums[k] += np.bincount(trigrams(t), minlength=BUCKETS)
        for k, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(s[at])], names=schema.names)

    counts = np.zeros((BUCKETS, len(languages)))
    got = drawn.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("bucket").to_numpy(), got.column("lang").to_numpy()] = got.column("n").to_numpy()
    drawn_ones = np.flatnonzero(counts.sum(0))
    return Mixture([languages[k] for k in drawn_ones], counts[:, drawn_ones])


_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType(), False), T.StructField("lang_pred", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False), T.StructField("languages", T.MapType(T.StringType(), T.DoubleType(), False), False),
])


def predict(docs: DataFrame, model: Mixture, held: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and the whole mixture; reads id and text only."""

    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def run(batches):
        model = shared.value
        for b in batches:
            found = [model.infer(t) for t in b.column(2).to_pylist()]
            top = [max(f.items(), key=lambda x: (x[1], x[0])) if f else (UNKNOWN, 0.0) for f in found]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([t[0] for t in top], pa.string()), pa.array([min(1.0, round(t[1], 9)) for t in top], pa.float64()),
                pa.array([sorted(f.items()) for f in found], pa.map_(pa.string(), pa.float64())),
            ], schema=_arrow)

    _arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.map_(pa.string(), pa.float64()))])
    return docs.select(col(docs, doc_id).cast("long").alias("doc_id"), held.alias("held_out"), col(docs, text).cast("string").alias("text")).mapInArrow(tidied(run), _OUT)
