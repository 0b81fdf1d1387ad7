"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all lower-cased words of a text and their beginnings of ``PREFIX`` letters, known by a 32-bit
hash; none is left out.  A term weighs (1 + log count) x idf x relevance, where the relevance is
the square of (size of its log odds of label 1 among the examples, shrunk by ``SHRINK`` examples of the
common rate, plus ``LEAST_RELEVANCE``), so that every term takes part and rare ones can't claim much.

Index: labelled examples, ordered so that like ones are neighbours, in blocks of ``BLOCK``; a
term that is in ``WIDE`` of the blocks or more keeps its greatest weight in each.  A query
first adds up its terms of greatest weight and those of few blocks, which have few postings; what its other terms can still
add in a block is bounded by the block's maxima, and only examples that can thereby reach the k-th best
sum are scored in full, so the k nearest are exact.  Their votes, weighted by how near they are, give a raw value, and
isotonic regression of the labels on leave-one-out values turns it into a probability.  The
neighbours are the evidence.

Learning: at most about ``MAX_EXAMPLES`` labelled rows of each label, drawn by hash (the bound of
the fit); the rates at which they were drawn weight the calibration.  Examples become vectors on the
executors, and the driver gets these alone; leave-one-out votes are made on the executors again.
Defined cases: texts that share no term with an example (null and empty ones too) get the calibrated
common rate of label 1; no labelled row at all: score 0 for all; null labels are no labels; equal
cosines go by the order of the examples, which depends on their vectors and ids alone; repeated rows
get the same answer; very long texts are counted whole; other columns of ``docs`` aren't read, so
their names can't clash.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, held_out, stored, tidied

PREFIX = (5,)
SHRINK = 5.0
LEAST_RELEVANCE = 0.02
POWER = 2.0
MAX_EXAMPLES = 2_000
NEIGHBOURS = 11
BLOCK = 64
#: Share of a query's postings that is added up before bounds are applied.
FIRST_SHARE = 0.2
#: Share of the blocks from which on a term has a row of maxima.
WIDE = 0.25
THRESHOLD = 0.7
CACHE_WORDS = 200_000
#: Words whose terms are counted together.
PIECE_WORDS = 50_000

_WORDS = re.compile(r"[^\W\d_]+")


@functools.cache
def _letters() -> np.ndarray:
    """By code point: is it part of a word, as in ``_WORDS``?"""
    every = np.arange(0x110000, dtype=np.uint32).view("U1")
    return np.strings.isalnum(every) & ~np.strings.isdecimal(every)


def words_of(text: str | None) -> list[str]:
    """What ``_WORDS`` finds in the lower-cased text."""
    if not text:
        return []
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_letters()[points], points, np.uint32(32)).tobytes().decode("utf-32-le", "surrogatepass").split()


class _Codes(dict):
    """Numbers words from 0 as they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class Terms:
    """Terms of whole texts with their counts; the terms of a word are made once while it is in the cache.

    With a vocabulary (sorted hashes) terms are places in it and others are left out, else they are the hashes.
    """

    def __init__(self, vocabulary: np.ndarray | None = None):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.codes = _Codes()
        #: By kind of term (words, then beginnings) and word's code: the term, -1 if there is none.
        self.terms = np.zeros((1 + len(PREFIX), 0), np.int64)

    def learn(self, words: list[str]) -> None:
        """Terms of the words that got the next codes."""
        made = [[crc32(w.encode("utf-8", "surrogatepass")) for w in words]]
        made += [[crc32(f"{w[:n]}~".encode("utf-8", "surrogatepass")) if len(w) > n else -1 for w in words] for n in PREFIX]
        terms = np.array(made, np.int64)
        if self.vocabulary is not None:
            at = np.searchsorted(self.vocabulary, terms)
            at[at == len(self.vocabulary)] = 0
            terms = np.where(self.vocabulary[at] == terms, at, -1) if len(self.vocabulary) else np.full_like(terms, -1)
        self.terms = np.concatenate([self.terms, terms], axis=1)

    def many(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ascending terms and their counts of each text, in order."""
        piece, size = [], 0
        for text in texts:
            if not piece and len(self.codes) > CACHE_WORDS:
                self.forget()
            words = words_of(text)
            piece.append(np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words)))
            size += len(words)
            if size >= PIECE_WORDS or len(piece) >= PIECE_WORDS:
                yield from self._count(piece)
                piece, size = [], 0
        if piece:
            yield from self._count(piece)

    def _count(self, piece: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Terms and counts of texts that are given as their words' codes."""
        if new := len(self.codes) - self.terms.shape[1]:
            self.learn(list(islice(reversed(self.codes), new))[::-1])
        terms = self.terms[:, np.concatenate(piece)]
        # A text's place stands above the 32 bits of its terms.
        both = (terms | np.repeat(np.arange(len(piece)) << 32, [len(codes) for codes in piece]))[terms >= 0]
        both, counts = np.unique(both, return_counts=True)
        cut = np.searchsorted(both, np.arange(len(piece) + 1) << 32).tolist()
        both &= 0xFFFFFFFF
        for a, b in zip(cut, cut[1:]):
            yield both[a:b], counts[a:b]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return next(self.many([text]))


#: A posting (place of the example, weight) or a term of an example (its rank, weight), kept as one long.
_PAIR = np.dtype([("at", "<i4"), ("weight", "<f4")])


def _pairs(at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), _PAIR)
    out["at"], out["weight"] = at, weight
    return out.view(np.int64)


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin .. begin + n - 1 of each pair, one after the other."""
    out = np.repeat(begin - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


class Index:
    """Block-max inverted index over unit vectors of the examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, ids: list[int | None]):
        self.size = n = len(vectors)
        self.blocks = max(1, -(-n // BLOCK))
        flat = np.concatenate([v[0] for v in vectors]) if n else np.zeros(0, np.int64)
        row = np.repeat(np.arange(n), [len(v[0]) for v in vectors])
        self.vocabulary, term = np.unique(flat, return_inverse=True)
        m = len(self.vocabulary)
        with_term = np.bincount(term, minlength=m)
        ones = np.bincount(term, labels[row] if n else None, minlength=m)
        base = min(max(float(labels.mean()) if n else 0.5, 1e-6), 1 - 1e-6)
        share = (ones + SHRINK * base) / (with_term + SHRINK)
        odds = np.abs(np.log(np.maximum(share, 1e-9) / np.maximum(1 - share, 1e-9)) - math.log(base / (1 - base)))
        self.term_weight = (np.log((1 + n) / (1 + with_term)) + 1) * (odds + LEAST_RELEVANCE) ** POWER
        self.ids, self.labels, self.weights = ids, labels.astype(float), weights
        self.bare = float(np.average(labels, weights=weights)) if n else 0.0
        self.steps: tuple[np.ndarray, np.ndarray] | None = None
        self.shared = self.scratch = None
        if not n:
            return
        unit = [self.unit(np.searchsorted(self.vocabulary, t), c) for t, c in vectors]
        # Examples that share their heaviest terms stand together.
        heavy = [tuple(self.vocabulary[t[np.argsort(-w, kind="stable")[:3]]].tolist()) for t, w in unit]
        order = sorted(range(n), key=lambda k: (heavy[k], ids[k] is None, ids[k] or 0))
        unit = [unit[k] for k in order]
        self.ids, self.labels, self.weights = [ids[k] for k in order], self.labels[order], weights[order]
        sizes = [len(t) for t, _ in unit]
        term = np.concatenate([t for t, _ in unit])
        value = np.concatenate([w for _, w in unit]).astype(np.float32)
        # Common terms get the low ranks, so that looking up examples' terms stays within little memory.
        self.by_rank = np.argsort(-with_term, kind="stable").astype(np.int32)
        self.rank = np.empty(m, np.int32)
        self.rank[self.by_rank] = np.arange(m, dtype=np.int32)
        self.own_begin, self.own = np.cumsum([0, *sizes]), _pairs(self.rank[term], value)
        place = np.repeat(np.arange(n), sizes)
        by_term = np.argsort(term, kind="stable")
        term, place, value = term[by_term], place[by_term], value[by_term]
        self.postings = _pairs(place, value)
        self.begin = np.searchsorted(term, np.arange(m + 1))
        self.most = np.maximum.reduceat(value, self.begin[:-1]) if m else np.zeros(0, np.float32)
        # Runs of one term in one block: their greatest weight, for terms of many blocks.
        run = term.astype(np.int64) * self.blocks + place // BLOCK
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]][: len(run)])
        run_term, run_block = run[starts] // self.blocks, run[starts] % self.blocks
        wide = np.bincount(run_term, minlength=m) >= max(2, WIDE * self.blocks)
        self.row = np.where(wide, np.cumsum(wide) - 1, -1).astype(np.int32)
        self.maxima = np.zeros((int(wide.sum()), self.blocks), np.float32)
        kept = wide[run_term]
        if kept.any():
            self.maxima[self.row[run_term[kept]], run_block[kept]] = np.maximum.reduceat(value, starts)[kept]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"shared": None, "scratch": None}

    @property
    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The examples' unit vectors, in the index's order."""
        if not self.size:
            return []
        own, cut = self.own.view(_PAIR), self.own_begin[1:-1]
        return list(zip(np.split(self.by_rank[own["at"]], cut), np.split(own["weight"], cut)))

    def unit(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of terms (places in the vocabulary) by their counts."""
        w = (1 + np.log(counts)) * self.term_weight[at]
        return at, w / (math.sqrt(float(w @ w)) or 1.0)

    def nearest(self, query: tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS, but: int = -1) -> list[tuple[float, int]]:
        """The k examples of greatest cosine over 0 as (cosine, place); ties by place."""
        terms, q = query
        if not len(terms):
            return []
        order = np.argsort(-q * self.most[terms])
        terms, q = terms[order], q[order]
        a = self.begin[terms]
        n = self.begin[terms + 1] - a
        before, row = np.cumsum(n) - n, self.row[terms]
        first = (before <= FIRST_SHARE * n.sum()) | (row < 0)
        post = self.postings[_ranges(a[first], n[first])].view(_PAIR)
        score = np.bincount(post["at"], post["weight"] * np.repeat(q[first], n[first]), self.size)
        if but >= 0:
            score[but] = -2.0  # under any bound
        least = np.partition(score, self.size - k)[self.size - k] if k <= self.size else 0.0
        if not first.all():
            more = q[~first] @ self.maxima[row[~first]]
            score += np.repeat(more, BLOCK)[: self.size]
        open_ = np.flatnonzero(score >= max(least - 1e-9, 1e-300))
        a, n = self.own_begin[open_], self.own_begin[open_ + 1] - self.own_begin[open_]
        open_, a, n = open_[n > 0], a[n > 0], n[n > 0]
        if not len(open_):
            return []
        # In full, term by term of each example that is still open.
        dense = self.scratch
        if dense is None:
            dense = self.scratch = np.zeros(len(self.vocabulary))
        rank = self.rank[terms]
        dense[rank] = q
        own = np.concatenate([self.own[i:j] for i, j in zip(a.tolist(), (a + n).tolist())]).view(_PAIR)
        score = np.add.reduceat(dense.take(own["at"]) * own["weight"], np.cumsum(n) - n)
        dense[rank] = 0.0
        best = np.lexsort((open_, -np.round(score, 12)))[:k]
        return [(s, j) for s, j in zip(score[best].tolist(), open_[best].tolist()) if s > 0]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, by weight of nearness."""
        if not near:
            return self.bare
        s = np.array([x[0] for x in near])
        w = s / (1.05 - np.minimum(s, 1.0))
        return float((w * self.labels[[x[1] for x in near]]).sum() / w.sum())

    def calibrate(self, raw: np.ndarray) -> None:
        """Isotonic regression of labels on leave-one-out votes (pool adjacent violators)."""
        pools: list[list[float]] = []  # raw, mean, weight
        for k in np.argsort(raw, kind="stable"):
            pools.append([raw[k], self.labels[k], self.weights[k]])
            while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][0] == pools[-1][0]):
                r, m, w = pools.pop()
                low = pools[-1]
                low[1] = (low[1] * low[2] + m * w) / (low[2] + w)
                low[2] += w
                low[0] = r
        self.steps = np.array([p[0] for p in pools]), np.array([p[1] for p in pools])

    def probability(self, raw: float) -> float:
        if self.steps is None or not len(self.steps[0]):
            return raw
        return min(max(float(np.interp(raw, *self.steps)), 0.0), 1.0)

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[int | None, float]]]:
        """Calibrated score and evidence (example id, cosine)."""
        if not self.size:
            return 0.0, []
        near = self.nearest(self.unit(terms, counts))
        return self.probability(self.vote(near)), [(self.ids[k], round(s, 9)) for s, k in near[:5]]


def examples(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, max_examples: int = MAX_EXAMPLES) -> tuple[DataFrame, dict[int, float]]:
    """Drawn examples (doc_id, text, y), stored, and the rate at which each label was drawn."""
    given = labels.select(F.col("doc_id").cast("long").alias("id"), col(labels, label).cast("int").alias("y"))
    given = given.where(~held_out(F.col("id")) & F.col("y").isin(0, 1) & F.col("id").isNotNull())
    sizes = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    rates = {y: min(1.0, max_examples / n) for y, n in sizes.items()}
    rate = F.when(F.col("y") == 1, rates.get(1, 0.0)).otherwise(rates.get(0, 0.0))
    drawn = given.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 20)) < rate * (1 << 20))
    # About 2 x max_examples rows of 12 bytes by the rates above, so this side is broadcast.
    rows = docs.select(col(docs, doc_id).cast("long").alias("doc_id"), col(docs, text).cast("string").alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("id"))
    return stored(rows.select("doc_id", "text", "y"), "toxic-examples"), rates


_VECTOR = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.IntegerType(), False), T.StructField("terms", T.BinaryType(), False), T.StructField("counts", T.BinaryType(), False)])


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_examples: int = MAX_EXAMPLES) -> Index:
    rows, rates = examples(docs, labels, doc_id=doc_id, text=text, label=label, max_examples=max_examples)

    def vectorise(batches):
        of = Terms()
        for b in batches:
            v = list(of.many(t.as_py() for t in b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t.astype("<u4").tobytes() for t, _ in v], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in v], pa.binary())], names=_VECTOR.names)

    spark = docs.sparkSession
    got = rows.select("doc_id", "y", "text").mapInArrow(vectorise, _VECTOR).orderBy("doc_id", "y", "terms", "counts").toArrow().to_pylist()  # the drawn examples
    vectors = [tuple(np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("terms", "counts")) for r in got]
    index = Index(vectors, np.array([r["y"] for r in got], float), np.array([1 / max(1e-9, rates[r["y"]]) for r in got]), [r["doc_id"] for r in got])
    if got:
        index.shared = shared = spark.sparkContext.broadcast(index)

        def left_out(batches):
            vectors = shared.value.vectors
            for b in batches:
                raw = [shared.value.vote(shared.value.nearest(vectors[k], but=k)) for k in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.float64())], names=["id", "raw"])

        votes = spark.range(len(got), numPartitions=max(1, len(got) // 250)).mapInArrow(left_out, "id long, raw double").collect()
        index.calibrate(np.array([r["raw"] for r in sorted(votes)]))
    return index


_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType(), False), T.StructField("score", T.DoubleType(), False),
    T.StructField("predicted", T.IntegerType(), False), T.StructField("evidence", T.ArrayType(T.LongType()), False),
])


def score(docs: DataFrame, model: Index, held: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the nearest examples)."""
    # Bounded by MAX_EXAMPLES; the index went to the workers when it was fitted, only the steps are new.
    shared, steps = model.shared or docs.sparkSession.sparkContext.broadcast(model), model.steps

    def run(batches):
        index, terms = shared.value, Terms(shared.value.vocabulary)
        index.steps = steps
        for b in batches:
            got = [index.score(*v) for v in terms.many(t.as_py() for t in b.column(2))]
            s = [round(g[0], 9) for g in got]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32()),
                pa.array([[e[0] for e in g[1]] for g in got], pa.list_(pa.int64())),
            ], names=_OUT.names)

    return docs.select(col(docs, doc_id).cast("long").alias("doc_id"), held.alias("held_out"), col(docs, text).cast("string").alias("text")).mapInArrow(tidied(run), _OUT)
