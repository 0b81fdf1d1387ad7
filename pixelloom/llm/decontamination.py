"""Benchmark decontamination by an FM-index per training shard.

A training shard is a run of documents with about ``SHARD_WORDS`` words.  Its words become
symbols (words that no test phrase has share one symbol and end every match), the text is
indexed by suffix array, Burrows-Wheeler transform and a wavelet matrix, and all test phrases
are searched backwards at once: each step is two ranks per level for every phrase.  Phrases that
occur are located by walking to sampled suffix positions; their spans are merged per document.

A stretch of text between two words foreign to every phrase can hold a phrase only if it is as
long as the shortest one; shorter stretches are left out of the index, which loses nothing.

Test phrases: windows of ``WINDOW`` consecutive words of each item; an item of fewer words, but
not none, is one phrase.  Items are read one by one and split into blocks of at most
``BLOCK_BYTES`` of phrases.  The driver makes a block's symbols once and broadcasts its arrays; a
worker holds one block at a time and searches all shards of a batch for it, so a benchmark of any
size is scanned whole.  A shard's spans and items are merged over the blocks.

Words: A-Z lower-cased, runs of anything but ASCII other than digits and letters.
Defined cases: null or wordless texts have no words, no hits, and are clean; null and wordless
items give no phrase; repeated documents and items are judged one by one, so ties don't arise; a
very long text is a shard of its own; empty tables work; a column that bears the name of an
output column (names are compared without case) is replaced by it.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, tidied

WINDOW = 13
SHARD_WORDS = 1 << 17
#: Suffix positions that are divisible by this are kept.
SAMPLE = 8
BLOCK_BYTES = 64 << 20
#: A document is contaminated if hit words are at least one in so many.
MIN_SHARE = 20

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall(text.encode().lower()) if text else []


class WaveletMatrix:
    """Ranks over a sequence of small integers; all operations take arrays."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels = levels
        self.ones, self.bits, self.zeros = [], [], []
        for k in range(levels - 1, -1, -1):
            bit = (seq >> k) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.bits.append(bit.astype(bool))
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start = np.zeros(len(at), np.int64)
        end = at.astype(np.int64)
        for level in range(self.levels):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            s, e = ones[start], ones[end]
            start = np.where(one, zeros + s, start - s)
            end = np.where(one, zeros + e, end - e)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.int64)
        out = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            one, s = self.bits[level][at], self.ones[level][at]
            out = out * 2 + one
            at = np.where(one, self.zeros[level] + s, at - s)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order: ranks of doubling depth, only groups still tied are sorted again.

    The text must end in a symbol that is smallest and unique.
    """
    n = len(text)
    sa = np.argsort(text.astype(np.uint16) if n and text.max() < 1 << 16 else text, kind="stable")
    sorted_text = text[sa]
    first = np.flatnonzero(np.r_[True, sorted_text[1:] != sorted_text[:-1]])
    size = np.diff(np.r_[first, n])
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(first, size)
    tied = np.flatnonzero(np.repeat(size > 1, size))
    depth = 1
    while len(tied):
        s = sa[tied]
        group = rank[s]
        ahead = s + depth
        key = group * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        s, key = s[order], key[order]
        sa[tied] = s
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        rank[s] = np.repeat(tied[first], size)
        tied = tied[np.repeat(size > 1, size)]
        depth *= 2
    return sa


class FMIndex:
    """Word-level FM-index of one text; symbols below ``alphabet``, 0 only at the end."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = SAMPLE):
        n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]  # position -1 is the end symbol
        self.size = n
        self.wavelet = WaveletMatrix(bwt, max(1, (alphabet - 1).bit_length()))
        self.before = np.zeros(alphabet + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=alphabet), out=self.before[1:])
        self.marked = sa % sample == 0
        self.marks = np.zeros(n + 1, np.int32)
        np.cumsum(self.marked, out=self.marks[1:])
        self.samples = sa[self.marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of right-aligned phrases, all searched backwards at once."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        width = phrases.shape[1]
        for back in range(1, width + 1):
            live = live[(lengths[live] < back) | (high[live] > low[live])]
            now = live[lengths[live] >= back]
            if not len(now):
                break
            symbol = phrases[now, width - back]
            both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low[now], high[now]]))
            low[now] = self.before[symbol] + both[: len(now)]
            high[now] = self.before[symbol] + both[len(now) :]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back in the text until a sampled one."""
        rows = rows.astype(np.int64)
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            at = rows[todo]
            hit = self.marked[at]
            out[todo[hit]] = self.samples[self.marks[at[hit]]] + steps
            todo = todo[~hit]
            at = at[~hit]
            symbol = self.wavelet.access(at)
            rows[todo] = self.before[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out


class Phrases:
    """A block of distinct test phrases: symbols of its words, and the items each belongs to.

    Travels as arrays and one list of words; a worker makes the table of symbols when it first needs it.
    """

    def __init__(self, phrases: dict[tuple[bytes, ...], list[int]]):
        self.vocabulary = sorted({w for p in phrases for w in p})
        self.symbols: dict[bytes, int] | None = None
        symbol = self.symbol
        self.alphabet = len(self.vocabulary) + 2
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        width = int(self.lengths.max(initial=1))
        self.grid = np.zeros((len(phrases), width), np.int32)
        for k, p in enumerate(phrases):
            self.grid[k, width - len(p) :] = [symbol[w] for w in p]
        items = [[x for x in i if x is not None] for i in phrases.values()]
        self.item_ids = np.array([x for i in items for x in i], np.int64)
        self.item_ends = np.cumsum([0, *map(len, items)])
        self.shortest = int(self.lengths.min(initial=1))

    @property
    def symbol(self) -> dict[bytes, int]:
        """0 ends the text, 1 stands between stretches."""
        if self.symbols is None:
            self.symbols = {w: k + 2 for k, w in enumerate(self.vocabulary)}
        return self.symbols

    def __getstate__(self) -> dict:
        return self.__dict__ | {"symbols": None}

    def coded(self, words: list[bytes]) -> np.ndarray:
        get = self.symbol.get
        return np.fromiter((get(w, 1) for w in words), np.int32, len(words))

    def items(self, phrase: int) -> list[int]:
        return self.item_ids[self.item_ends[phrase] : self.item_ends[phrase + 1]].tolist()

    def find(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in documents given as symbols (1: foreign): document, first word, phrase."""
        sizes = np.array([len(d) for d in docs], np.int64)
        # A foreign word after each document, so no stretch runs over two of them.
        flat = np.ones(int(sizes.sum()) + len(docs), np.int32)
        starts = np.cumsum(np.r_[0, sizes + 1])[:-1]
        for a, d in zip(starts, docs):
            flat[a : a + len(d)] = d
        known = np.flatnonzero(flat > 1)
        none = np.zeros(0, np.int64)
        if not len(known):
            return none, none, none
        cut = np.flatnonzero(np.diff(known) > 1) + 1
        a, b = known[np.r_[0, cut]], known[np.r_[cut, len(known)] - 1] + 1
        long = b - a >= self.shortest
        a, b = a[long], b[long]
        if not len(a):
            return none, none, none
        # Stretches, each followed by the symbol 1; the end of all is 0.
        size = b - a + 1
        out = np.cumsum(np.r_[0, size])
        source = np.arange(int(out[-1])) - np.repeat(out[:-1] - a, size)
        text = flat[source]
        text[out[1:] - 1] = 1
        index = FMIndex(np.r_[text, 0], self.alphabet)
        low, high = index.search(self.grid, self.lengths)
        count = high - low
        hit = np.flatnonzero(count)
        if not len(hit):
            return none, none, none
        count = count[hit]
        rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - low[hit], count)
        at = source[index.locate(rows)]
        doc = np.searchsorted(starts, at, "right") - 1
        return doc, at - starts[doc], np.repeat(hit, count)


def phrases_of(items, window: int = WINDOW) -> dict[tuple[bytes, ...], list[int]]:
    """Distinct phrases of (item_id, text) pairs, with the ids of the items that hold them."""
    out: dict[tuple[bytes, ...], set[int]] = {}
    for item, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            out.setdefault(tuple(words[k : k + window]), set()).add(item)
    return {p: sorted(i, key=lambda x: (x is None, x)) for p, i in out.items()}


def merged(first: np.ndarray, length: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Union of word spans as [begin, end) pairs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + length, -1)
    inside = np.r_[0, np.cumsum(edge[:n]) > 0, 0]
    turn = np.flatnonzero(np.diff(inside))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist()))


_EXTRA = (
    T.StructField("n_words", T.LongType(), False), T.StructField("n_hit", T.LongType(), False), T.StructField("n_items", T.LongType(), False),
    T.StructField("item_ids", T.ArrayType(T.LongType()), False),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())), False), T.StructField("contaminated", T.BooleanType(), False),
)


def blocks_of(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int = BLOCK_BYTES):
    """Phrases of the items in blocks of bounded size, made one at a time on the driver."""
    rows, size = [], 0
    for r in benchmark.select(col(benchmark, item_id).cast("long"), col(benchmark, text).cast("string")).toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1] or "")
        if size * window > block_bytes:
            yield Phrases(phrases_of(rows, window))
            rows, size = [], 0
    if rows:
        yield Phrases(phrases_of(rows, window))


class Found:
    """What the blocks find in a run of documents."""

    def __init__(self, n: int):
        self.sizes = np.zeros(n, np.int64)
        self.spans: list[list] = [[] for _ in range(n)]
        self.items: list[set] = [set() for _ in range(n)]

    def add(self, at: int, phrases: Phrases, docs: list[np.ndarray]) -> None:
        """Occurrences in documents ``at`` and on, given as symbols."""
        doc, first, phrase = phrases.find(docs)
        order = np.argsort(doc, kind="stable")
        doc, first, phrase = doc[order], first[order], phrase[order]
        cut = np.flatnonzero(np.diff(doc)) + 1
        for a, c in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)]) if len(doc) else ():
            d = at + int(doc[a])
            self.spans[d].append((first[a:c], phrases.lengths[phrase[a:c]]))
            for p in np.unique(phrase[a:c]).tolist():
                self.items[d].update(phrases.items(p))

    def rows(self):
        for size, s, i in zip(self.sizes.tolist(), self.spans, self.items):
            ranges = merged(np.concatenate([x[0] for x in s]), np.concatenate([x[1] for x in s]), size) if s else []
            hit = sum(b - a for a, b in ranges)
            yield size, hit, len(i), sorted(i), [list(r) for r in ranges], hit > 0 and MIN_SHARE * hit >= size


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` with n_words, n_hit, n_items, item_ids, spans
    (word ranges to remove) and contaminated.  One pass over the documents, no shuffle.

    Rows with a null item id take part in n_hit and spans but aren't listed among the items.
    """
    extra = {f.name.lower() for f in _EXTRA}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in extra]
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks_of(benchmark, item_id, item_text, window)]
    types = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*(types[c] for c in keep), *_EXTRA])
    n = len(keep)
    # A text that is kept as it is isn't sent a second time.
    sent = [col(docs, c) for c in keep]
    if text in keep and types[text].dataType == T.StringType():
        source = keep.index(text)
    else:
        source = n
        sent.append(col(docs, text).cast("string").alias(fresh(docs, "_text")))

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.bool_())

    def run(batches):
        at_hand: list = [None, None]

        def block(k: int) -> Phrases:
            """The worker holds one block; the others stay in Spark's files."""
            if at_hand[0] != k:
                at_hand[:] = k, blocks[k].value
                vars(blocks[k]).pop("_value", None)
            return at_hand[1]

        for b in batches:
            column, found = b.column(source), Found(b.num_rows)
            for k in range(max(1, len(blocks))):
                phrases = block(k) if blocks else None
                # Shards of bounded size; words are symbols as soon as they are read.
                at, shard, size = 0, [], 0
                for row in range(b.num_rows):
                    words = words_of(column[row].as_py())
                    found.sizes[row] = len(words)
                    if phrases is None or not len(phrases.lengths):
                        continue
                    shard.append(phrases.coded(words))
                    size += len(words)
                    if size >= shard_words or row + 1 == b.num_rows:
                        found.add(at, phrases, shard)
                        at, shard, size = row + 1, [], 0
            cols = list(zip(*found.rows())) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(c, t) for c, t in zip(cols, kinds))], names=schema.names)

    return docs.select(*sent).mapInArrow(tidied(run), schema)


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def with_digest(found: DataFrame) -> DataFrame:
    """Adds items_sha256 of item_ids sorted as strings."""
    return found.withColumn("items_sha256", F.sha2(F.concat_ws(",", F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))), 256))
