"""Language-model scores: masked pseudo-likelihood by a bidirectional window network.

Every word is predicted from the two words before and the two after it (not itself); the sum of
the log-probabilities over all words of a text is its pseudo-log-likelihood.

The output is a tree of softmax nodes, all trained on the context of both sides:
    h = tanh(b + the sum of E[place][word there] over the two places before and the two after)
    root   the ``ALONE`` most frequent words, ``GROUPS`` groups of the others (by their ending), and a rest of each group
    group  its ``WIDTH`` most frequent words

so the ``ALONE`` + ``GROUPS`` x ``WIDTH`` most frequent words are told apart by context.  A word of a
group's rest follows from its share there, (count of the word) / (count of the rest + 1), by the
counts of the whole corpus; words that weren't counted have a count of one, spelled at a constant cost
a character.  Most words are decided at the root; only those of a group meet a second softmax.
In a context the words told apart have a vector each and place, and so has the rest of every group.

The counts of all words are a stored table.  A histogram of the counts tells from which count on there
are at most ``VOCABULARY`` words, and only these go to the driver and the workers.  Texts are coded once
(two bytes a word, stored); rest words outside the vocabulary leave the map as distinct words with
their number in the text, are joined to the table, and their logarithms (whole billionths, so their
order can't matter) are added up by text.

Training: numpy, by parallel stochastic gradient descent on the coded texts.  In each of ``ROUNDS``
rounds every partition starts from the same parameters, and the results are averaged by number of
words, added up in two levels (some hundred thousand numbers, whatever the corpus; the driver gets at most
``SUMS`` of them).  Each round predicts every ``ROUNDS``-th word of every text, so all rounds together are one epoch: all words of all
documents have been predicted once at the end, and counts and training grow with the input.

Defined cases: null or wordless texts have 0 words, sum 0.0 and mean null; an empty corpus trains
nothing; words are runs other than the six space characters, A-Z lower-cased; words of equal count go
by their bytes; repeated rows are counted and trained on as often as they come and get equal scores;
very long texts are scored whole; other columns of ``docs`` aren't read, so their names can't clash.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, stored, tidied

ALONE = 32
GROUPS = 16
#: Branches of the root; the rests of the groups come last, from ``REST`` on.
REST = ALONE + GROUPS
CLASSES = REST + GROUPS
WIDTH = 64
VOCABULARY = 150_000
HIDDEN = 16
STEP = 0.05
BATCH = 8_192
#: Bound on what one batch moves a number of a context's vector by; frequent words gather many gradients.
LONGEST_MOVE = 0.2
ROUNDS = 2
SUMS = 16
SEED = 11
COUNTER_WORDS = 300_000
CACHE_WORDS = 300_000
#: Log-probability of a character of a word that wasn't counted.
SPELL = math.log(1 / 40)
NANO = 1_000_000_000
#: Steps of the histogram of counts within a doubling.
FINE = 16


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def group_of(word: bytes) -> int:
    """Group of a word that isn't alone at the root."""
    return zlib.crc32(word[-3:]) % GROUPS


_COUNTS = T.StructType([T.StructField("word", T.BinaryType(), False), T.StructField("n", T.LongType(), False)])


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word, n over all documents; a task hands on what it counted whenever its table is full."""

    def run(batches):
        sums: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                sums.update(words_of(t))
                if len(sums) > COUNTER_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(sums.keys()), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=_COUNTS.names)
                    sums.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums.keys()), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=_COUNTS.names)

    return docs.select(col(docs, text).cast("string").alias("text")).mapInArrow(tidied(run), _COUNTS).groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most`` and whole steps of the histogram, most frequent first."""
    step = F.floor(F.log2("n") * FINE).cast("int")
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect(), reverse=True):  # at most 64 x FINE rows
        if r["c"] > left:
            break
        left, least = left - r["c"], r["s"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["n"]) for r in counts.where(step >= least).collect()), key=lambda x: (-x[1], x[0]))


class Lexicon:
    """Codes of words (branch of the root x WIDTH + place in the group) and shares of rest words; ``counts`` (word, n) has all words."""

    def __init__(self, top: list[tuple[bytes, int]], group_totals: dict[int, int], counts: DataFrame | None = None):
        """``top``: most frequent first; ``group_totals``: words counted by group, those that are alone too."""
        self.counts = counts
        #: Number of each vocabulary word, most frequent first; behind them, a number for the others of each group.
        self.number = {w: k for k, (w, _) in enumerate(top)}
        code_of = np.zeros(len(top) + GROUPS, np.uint16)
        rest = np.array([group_totals.get(g, 0) for g in range(GROUPS)], np.float64)
        root = np.zeros(CLASSES)
        nodes = np.zeros((GROUPS, WIDTH))
        filled = [0] * GROUPS
        part_of = np.zeros(len(top) + GROUPS)
        for k, (w, n) in enumerate(top):
            g = group_of(w)
            if k < ALONE:
                code_of[k] = k * WIDTH
                root[k] = n
            elif filled[g] < WIDTH:
                code_of[k] = (ALONE + g) * WIDTH + filled[g]
                nodes[g, filled[g]] = n
                filled[g] += 1
            else:
                code_of[k] = (REST + g) * WIDTH
                part_of[k] = math.log(n)
                continue
            rest[g] -= n
        rest = np.maximum(rest, 0)
        root[ALONE:REST], root[REST:] = nodes.sum(1), rest
        self.root_share = (root + 0.5) / (root.sum() + 0.5 * CLASSES)
        self.node_share = (nodes + 0.5) / (nodes.sum(1, keepdims=True) + 0.5 * WIDTH)
        #: Log-probability of a word of count one in the rest of its group.
        self.one = -np.log(rest + 1.0)
        code_of[len(top) :] = (REST + np.arange(GROUPS)) * WIDTH
        in_rest = code_of >= REST * WIDTH
        part_of[in_rest] += self.one[code_of[in_rest] // WIDTH - REST]
        #: By number: the code, and what a rest word's share adds to its way through the tree (of a word outside the vocabulary, without its count).
        self.code_of, self.part_of = code_of, part_of

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}  # the table stays where it is


def log_count(n: Column, word: Column) -> Column:
    """Billionths of the logarithm of a word's count, or of its spelling where it wasn't counted."""
    return F.round(F.coalesce(F.ln(n), F.length(word) * F.lit(SPELL)) * F.lit(NANO)).cast("long")


class Coder(dict):
    """Numbers of words; those of words outside the vocabulary are made when they are met, and kept while there is room."""

    def __init__(self, lexicon: Lexicon):
        super().__init__(lexicon.number)
        self.known = len(lexicon.number)

    def __missing__(self, word: bytes) -> int:
        number = self.known + group_of(word)
        if len(self) < self.known + CACHE_WORDS:
            self[word] = number
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def learn_words(docs: DataFrame, text: str = "text") -> Lexicon:
    """Count the words of all documents."""
    counts = stored(word_counts(docs, text), "lm-words")
    by_group = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("n", T.LongType(), False)])

    def groups(batches):
        sums: Counter = Counter()
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[group_of(w)] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums.keys()), pa.int32()), pa.array(list(sums.values()), pa.int64())], names=by_group.names)

    totals = {r["k"]: r["n"] for r in counts.mapInArrow(groups, by_group).groupBy("k").agg(F.sum("n").alias("n")).collect()}  # GROUPS rows
    return Lexicon(frequent(counts, VOCABULARY), totals, counts)


_WORD = T.StructType([T.StructField("word", T.BinaryType(), False), T.StructField("k", T.LongType(), False)])
_CODED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("codes", T.BinaryType(), False), T.StructField("part", T.DoubleType(), False),
    T.StructField("words", T.ArrayType(_WORD, False), False),
])


def coded(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, codes of all words, ``part`` (shares of rest words of the vocabulary, and ones of the others), ``words`` (the others); stored."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # VOCABULARY words
    kind = pa.list_(pa.struct([pa.field("word", pa.binary(), False), pa.field("k", pa.int64(), False)]))

    def run(batches):
        lex = shared.value
        coder = Coder(lex)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                codes, part, words, numbers, ends = [], [], [], [], [0]
                for t in b.column(1).slice(at, 256):
                    ws = words_of(t.as_py())
                    own = coder.numbers(ws)
                    others = Counter([ws[i] for i in np.flatnonzero(own >= coder.known).tolist()])
                    words += others.keys()
                    numbers += others.values()
                    codes.append(lex.code_of[own].tobytes()), part.append(float(lex.part_of[own].sum())), ends.append(len(words))
                lists = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(numbers, pa.int64())], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), pa.array(codes, pa.binary()), pa.array(part, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists, type=kind)], names=_CODED.names)

    texts = docs.select(col(docs, doc_id).cast("long").alias("doc_id"), col(docs, text).cast("string").alias("text"))
    return stored(texts.mapInArrow(tidied(run), _CODED).withColumn("row", F.monotonically_increasing_id()), "lm-coded")


#: Context number of a code: words told apart have one each, and so has the rest of each group.  ``OUTSIDE`` stands for beyond the text.
CONTEXT = np.concatenate([np.repeat(np.arange(ALONE), WIDTH), ALONE + np.arange(GROUPS * WIDTH), ALONE + GROUPS * WIDTH + np.repeat(np.arange(GROUPS), WIDTH)]).astype(np.uint16)
OUTSIDE = ALONE + GROUPS * WIDTH + GROUPS


def windows(codes: np.ndarray) -> np.ndarray:
    """Context numbers of the two words before and the two after each word: a column a place."""
    n = len(codes)
    c = np.full(n + 4, OUTSIDE, np.uint16)
    c[2 : 2 + n] = CONTEXT[codes]
    return np.stack([c[:n], c[1 : n + 1], c[3 : n + 3], c[4 : n + 4]])


def _exp(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits and their sums by row, each row shifted by its greatest only if some logit might be too large for exp.

    ``x`` is a tanh, so that logits are bounded by the weights.  Sums are products with ones, which is faster than adding up short rows.
    """
    s = x @ weight
    s += bias
    if (np.abs(weight).sum(0) + np.abs(bias)).max(initial=0) > 60:
        s -= s.max(1, keepdims=True)
    np.exp(s, out=s)
    return s, s @ np.ones(s.shape[1], np.float32)


class Network:
    """Window network over the words around, with one softmax at the root and one a group."""

    NAMES = ("E", "b", "U", "c", "W", "d")

    def __init__(self, lexicon: Lexicon):
        rng = np.random.default_rng(SEED)
        some = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.E, self.b = some(4, OUTSIDE + 1, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.U, self.c = some(HIDDEN, CLASSES), np.log(lexicon.root_share).astype(np.float32)
        self.W, self.d = some(GROUPS, HIDDEN, WIDTH), np.log(lexicon.node_share).astype(np.float32)

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.NAMES])

    def load(self, v: np.ndarray) -> None:
        at = 0
        for name in self.NAMES:
            x = getattr(self, name)
            setattr(self, name, v[at : at + x.size].reshape(x.shape).astype(x.dtype))
            at += x.size

    def hidden(self, around: np.ndarray) -> np.ndarray:
        z = np.take(self.E[0], around[0], 0)
        for k in range(1, 4):
            z += np.take(self.E[k], around[k], 0)
        z += self.b
        return np.tanh(z, out=z)

    @staticmethod
    def by_group(root: np.ndarray):
        """(group, places) of the words that a group tells apart."""
        at = np.flatnonzero((root >= ALONE) & (root < REST))
        order = at[np.argsort(root[at].astype(np.uint8), kind="stable")]
        ends = np.searchsorted(root[order], np.arange(ALONE, REST + 1))
        for g in range(GROUPS):
            if ends[g + 1] > ends[g]:
                yield g, order[ends[g] : ends[g + 1]]

    def logs(self, around: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Log-probability of each word's way through the tree."""
        h, n = self.hidden(around), len(codes)
        root, place = (codes // WIDTH).astype(np.int64), (codes % WIDTH).astype(np.int64)
        e, total = _exp(h, self.U, self.c)
        out = np.log(np.maximum(e[np.arange(n), root] / total, 1e-30)).astype(np.float64)
        for g, at in self.by_group(root):
            e, total = _exp(h[at], self.W[g], self.d[g])
            out[at] += np.log(np.maximum(e[np.arange(len(at)), place[at]] / total, 1e-30))
        return out

    def train(self, around: np.ndarray, codes: np.ndarray, step: float = STEP) -> None:
        """One gradient step on a batch; the sum of gradients is scaled by 1 / sqrt(batch)."""
        n = len(codes)
        h = self.hidden(around)
        root, place = (codes // WIDTH).astype(np.int64), (codes % WIDTH).astype(np.int64)
        rate = np.float32(step / math.sqrt(n))

        def node(x, weight, bias, target):
            """Moves a node and returns what its words want of their hidden layer."""
            s, total = _exp(x, weight, bias)
            s *= (rate / total)[:, None]
            s[np.arange(len(target)), target] -= rate
            back = s @ weight.T
            weight -= x.T @ s
            bias -= np.ones(len(s), np.float32) @ s
            return back

        dh = node(h, self.U, self.c, root)
        for g, at in self.by_group(root):
            dh[at] += node(h[at], self.W[g], self.d[g], place[at])
        dh *= 1 - h * h
        self.b -= dh.sum(0)
        by_unit = np.ascontiguousarray(dh.T, np.float64)
        for k in range(4):
            move = np.stack([np.bincount(around[k], unit, OUTSIDE + 1) for unit in by_unit], 1).astype(np.float32)
            self.E[k] -= np.clip(move, -LONGEST_MOVE, LONGEST_MOVE, out=move)


_SUM = T.StructType([T.StructField("w", T.DoubleType(), False), T.StructField("v", T.BinaryType(), False)])


def train(texts: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS) -> Network:
    """Train on coded texts: round r predicts words r, r + rounds, ... of each."""
    spark = texts.sparkSession
    network = Network(lexicon)
    start = network.vector()
    bare = Lexicon([], {})  # the shapes; the parameters come as a vector

    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(start)

        def local(batches):
            net, seen, held, rows = Network(bare), 0, 0, []
            net.load(shared.value)

            def go():
                x, y = np.concatenate([w for w, _ in rows], 1), np.concatenate([c for _, c in rows])
                for at in range(0, held, BATCH):
                    net.train(x[:, at : at + BATCH], y[at : at + BATCH], STEP / (1 + turn))

            for b in batches:
                for data in b.column(0):
                    c = np.frombuffer(data.as_buffer(), np.uint16)
                    if len(c) > turn:
                        rows.append((windows(c)[:, turn::rounds], c[turn::rounds]))
                        held += len(rows[-1][1])
                    if held >= BATCH:
                        go()
                        seen, held, rows = seen + held, 0, []
            if held:
                go()
            if seen + held:
                yield pa.RecordBatch.from_arrays([pa.array([float(seen + held)]), pa.array([(net.vector() * np.float32(seen + held)).tobytes()], pa.binary())], names=_SUM.names)

        def add(batches):
            w, v = 0.0, None
            for b in batches:
                for x, data in zip(b.column(0).to_pylist(), b.column(1)):
                    part = np.frombuffer(data.as_buffer(), np.float32).astype(np.float64)
                    w, v = w + x, part if v is None else v + part
            if v is not None:
                yield pa.RecordBatch.from_arrays([pa.array([w]), pa.array([v.astype(np.float32).tobytes()], pa.binary())], names=_SUM.names)

        parts = texts.select("codes").mapInArrow(tidied(local), _SUM)
        sums = parts.repartition(SUMS, F.xxhash64("v")).sortWithinPartitions("w", "v").mapInArrow(add, _SUM).collect()  # at most SUMS rows
        if not sums:
            break
        weight = sum(r["w"] for r in sums)
        start = np.sum([np.frombuffer(v, np.float32).astype(np.float64) for v in sorted(bytes(r["v"]) for r in sums)], axis=0) / weight
    network.load(start)
    return network


def score_coded(texts: DataFrame, lexicon: Lexicon, network: Network) -> DataFrame:
    """doc_id, n_tokens, sum_logprob, mean_logprob of coded texts."""
    shared = texts.sparkSession.sparkContext.broadcast(network.vector())
    bare = Lexicon([], {})
    schema = "row long, doc_id long, n_tokens long, part double"

    def run(batches):
        net = Network(bare)
        net.load(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                codes = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(2).slice(at, 64)]
                lengths = np.array([len(c) for c in codes])
                sums = np.zeros(len(codes))
                if lengths.any():
                    x, y = np.concatenate([windows(c) for c in codes], 1), np.concatenate(codes)
                    logs = np.concatenate([net.logs(x[:, s : s + BATCH], y[s : s + BATCH]) for s in range(0, len(y), BATCH)])
                    ends = np.cumsum(lengths)
                    total = np.concatenate([[0.0], np.cumsum(logs)])
                    sums = total[ends] - total[ends - lengths]
                part = sums + b.column(3).slice(at, 64).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 64), b.column(1).slice(at, 64), pa.array(lengths, pa.int64()), pa.array(part)], names=["row", "doc_id", "n_tokens", "part"])

    parts = texts.select("row", "doc_id", "codes", "part").mapInArrow(tidied(run), schema)
    rest = texts.select("row", F.explode("words").alias("w")).select("row", "w.word", "w.k")
    rest = rest.join(lexicon.counts, "word", "left") if lexicon.counts is not None else rest.withColumn("n", F.lit(None).cast("long"))
    logs = rest.groupBy("row").agg(F.sum(F.col("k") * log_count(F.col("n"), F.col("word"))).alias("billionths"))
    total = F.round(F.col("part") + F.coalesce(F.col("billionths"), F.lit(0)) / NANO, 4)
    out = parts.join(logs, "row", "left").select("doc_id", "n_tokens", total.alias("sum_logprob"))
    return out.withColumn("mean_logprob", F.when(F.col("n_tokens") > 0, F.round(F.col("sum_logprob") / F.col("n_tokens"), 6)))


def fit(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[Lexicon, Network]:
    """Count words and train, both over all documents."""
    lexicon = learn_words(docs, text)
    ids = docs.select(F.lit(None).cast("long").alias("doc_id"), col(docs, text).alias("text"))
    return lexicon, train(coded(ids, lexicon), lexicon, rounds)


def score(docs: DataFrame, model: tuple[Lexicon, Network], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, sum_logprob, mean_logprob of every whole text."""
    return score_coded(coded(docs, model[0], doc_id, text), *model)


def fit_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``score`` of the documents by a model of these documents; they are coded once."""
    lexicon = learn_words(docs, text)
    texts = coded(docs, lexicon, doc_id, text)
    return score_coded(texts, lexicon, train(texts, lexicon, rounds))
