"""Near-duplicate classes by chosen-path set similarity join.

A document's set is its distinct word shingles.  Documents of the same set form a class (found
by a fingerprint of the whole set); everything below works on one representative a class.

Join: each set has ``COORDS`` minwise tokens.  In each of ``TREES`` independent trees a set goes
down the children named by randomly chosen coordinates and its token there: at the root each
coordinate is chosen with probability 1 / (threshold x COORDS), below with ``SPREAD`` times that.
Two sets at the threshold share a child of a common node with probability 1 - 1/e or more, so
all trees together miss a link with probability below 1e-3 (``recall_at_threshold``); links
between more similar sets are missed more rarely.  Under the roots a token is known by its four
bits of the sketch, which adds members to a child but never parts two that belong together.

A node of at most ``TASK`` sets comes to one task, which walks the rest of its tree: nodes of at
most ``LEAF`` sets are compared exhaustively, a node most of whose sets are like its first one is
compared set by set, with sets that were reached before left out (``spread``), every other node
goes down a level.  A larger node goes down levels as rows; one that stays large because its sets
are alike is taken for one candidate group as it is.

"Compared" is by 4-bit sketches of the minwise tokens (a pair at the threshold passes with
probability over 0.9999).  A task hands on not the pairs that pass but one edge a set, to the least
of those it is joined to.  The edges join sets up to candidate groups, and the full sets of a group
come together in one task and are compared exactly (``linked``); two sets already in one component
aren't compared again, since only components are asked for.

A group over ``CHUNK`` sets or ``CHUNK_TOKENS`` shingles is cut by set size into bands, so that only
equal and adjacent bands can hold a link, and the bands into chunks.  First every chunk is
compared with itself and a few pivots of its band and the next; what is then still outside the
group's main component is compared with all chunks of the bands around it.

All state is in DataFrames; the driver sees counts only.  Defined cases: texts without words
are linked with nothing; a text with fewer words than a shingle is one shingle; rows with the
same doc_id are separate rows; a null doc_id can be linked but never names a component unless
no linked row has an id (component_id is then null and the row is kept); very long texts are sets
like others, split by no limit; other columns of ``docs`` aren't read, so their names can't clash;
empty tables work.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, drop_stored, fresh, stored, tidied

COORDS = 64
TREES = 12
SPREAD = 2.0
#: Sets of a node that one task takes whole (40 bytes each).
TASK = 16_384
#: Sets of a node that are compared exhaustively.
LEAF = 128
#: Levels under the roots, in a task and before it.
DEPTH = 4
#: Sets and shingles (8 bytes each) that one task compares exactly at a time.
CHUNK = 2_048
CHUNK_TOKENS = 1 << 20
PIVOTS = 4
#: Edges that one task joins up at once (16 bytes each); more are contracted in rounds first.
LOCAL_EDGES = 1 << 16
SEED = 7_919
CACHE_WORDS = 150_000
#: Ids that are broadcast at most (16 bytes each) to pick rows out of the documents.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(SEED)
_MULT = _rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LOW = np.uint64(0x1111111111111111)
WORDS = COORDS // 16
SKETCH = [f"s{k}" for k in range(WORDS)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct hashed shingles of whole texts (64 bits each), sorted."""

    def __init__(self, size: int):
        self.size = size
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        cache = self.words
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
        k = min(self.size, n)
        s = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            s = _mix(s * _M1 + h[i : n - k + 1 + i])
        return np.unique(s)


def fingerprint(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def min_tokens(shingles: np.ndarray) -> np.ndarray:
    """One minwise token (32 bits) for each coordinate."""
    out = np.empty(COORDS, np.uint32)
    for k in range(COORDS):
        out[k] = (shingles * _MULT[k] + _ADD[k]).min() >> np.uint64(32)
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """4 bits a coordinate, in WORDS longs."""
    mixed = ((tokens.astype(np.uint64) * _M1) >> np.uint64(60)).reshape(-1, 16)
    return (mixed << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).view(np.int64)


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal 4-bit fields of sketches (rows of WORDS unsigned longs)."""
    x = a ^ b
    y = x | (x >> np.uint64(1))
    y = (y | (y >> np.uint64(2))) & _LOW
    return COORDS - np.bitwise_count(y).sum(-1, dtype=np.int64)


def _chosen(threshold: float, trees: int) -> list[tuple[int, int]]:
    """(tree, coordinate) pairs at the roots; each tree gets at least one."""
    rng = random.Random(SEED)
    out = []
    for tree in range(trees):
        picked = [i for i in range(COORDS) if rng.random() < 1 / (threshold * COORDS)] or [rng.randrange(COORDS)]
        out += [(tree, i) for i in picked]
    return out


def recall_at_threshold(threshold: float, trees: int = TREES, depth: int = 3) -> float:
    """Chance that two sets exactly at the threshold share a node ``depth`` levels down."""
    alive = 1.0
    for level in range(depth):
        rate = 1.0 if level == depth - 1 else SPREAD
        alive = 1 - math.exp(-rate * alive)
    return 1 - (1 - alive) ** trees


def least_matches(threshold: float) -> int:
    """Sketch matches below which a pair is given up: over 4 standard deviations under the mean."""
    p = threshold + (1 - threshold) / 16
    return math.floor(COORDS * p - 4.3 * math.sqrt(COORDS * p * (1 - p)))


def signatures(docs: DataFrame, shingle: int, threshold: float, trees: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, th (hash of the text: with the id it tells a row), n (set size), cid (class: fingerprint of the set, null for the empty set), sketch s0.., root nodes k0..."""
    roots = _chosen(threshold, trees)
    tree, coordinate = (np.array(x, np.uint64) for x in zip(*roots))
    salt = _mix(tree * _M3 + coordinate * _M1 + np.uint64(1))
    names = ["doc_id", "th", "n", "cid", *SKETCH, *(f"k{j}" for j in range(len(roots)))]
    schema = T.StructType([T.StructField(c, T.LongType(), c != "n") for c in names])

    def run(batches):
        make = Shingler(shingle)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                texts = b.column(1).slice(at, 1000)
                n, got = np.zeros(len(texts), np.int64), np.zeros((len(names) - 3, len(texts)), np.int64)
                for row, t in enumerate(texts):
                    s = make(t.as_py())
                    n[row] = len(s)
                    if len(s):
                        m = min_tokens(s)
                        got[0, row] = fingerprint(s)
                        got[1 : 1 + WORDS, row] = sketch(m)
                        got[1 + WORDS :, row] = _mix(m[coordinate.astype(np.int64)].astype(np.uint64) * _M2 + salt).view(np.int64)
                empty = n == 0
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1000), b.column(2).slice(at, 1000), pa.array(n), *(pa.array(x, mask=empty) for x in got)], names=names)

    return _body(docs, doc_id, text).select("doc_id", "text", "th").mapInArrow(tidied(run), schema)


def _body(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, th of documents."""
    body = docs.select(col(docs, doc_id).cast("long").alias("doc_id"), col(docs, text).cast("string").alias("text"))
    return body.withColumn("th", F.xxhash64("text"))


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least one that the edges (a, b) join it to."""
    at = np.arange(n)
    while len(a):
        x, y = at[a], at[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(at, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = at[at]
            if np.array_equal(up, at):
                break
            at = up
    return at


def exhaustive(key: np.ndarray, s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of like sets within the nodes; rows of a node stand together."""
    first, second = [], []
    live, d = np.flatnonzero(key[:-1] == key[1:]), 1
    while len(live):
        ok = matches(s[live], s[live + d]) >= least
        first.append(live[ok]), second.append(live[ok] + d)
        d += 1
        live = live[live + d < len(key)]
        live = live[key[live] == key[live + d]]
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def spread(s: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the like sets among ``rows``: a set that was reached isn't compared again."""
    first, second, left = [], [], rows
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            k = front.pop()
            ok = matches(s[left], s[k]) >= least
            new, left = left[ok], left[~ok]
            first.append(np.full(len(new), k)), second.append(new)
            front += new.tolist()
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def walk(key: np.ndarray, s: np.ndarray, threshold: float, least: int, leaf: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (not all of them in alike nodes) that join all like sets of the nodes and of their trees."""
    first, second = [], []
    rows = np.arange(len(key))
    limit = np.uint64(SPREAD / (threshold * COORDS) * (1 << 32))
    coordinates = np.arange(COORDS, dtype=np.uint64)
    for level in range(depth + 1):
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[begin, len(key)])
        fits = np.repeat(size <= leaf, size)
        a, b = exhaustive(key[fits], s[rows[fits]], least)
        first.append(rows[fits][a]), second.append(rows[fits][b])
        keys, members = [], []
        for at, n in zip(begin[size > leaf], size[size > leaf]):
            own, k = rows[at : at + n], np.uint64(key[at].astype(np.int64).view(np.uint64))
            if level == depth or 2 * np.count_nonzero(matches(s[own], s[own[0]]) >= least) >= n:
                a, b = spread(s, own, least)
                first.append(a), second.append(b)
                continue
            down = _mix(k + (coordinates + np.uint64(1)) * _M1)
            for i in np.flatnonzero((down >> np.uint64(32)) < limit):
                field = (s[own, i // 16] >> np.uint64(4 * (i % 16))) & np.uint64(15)
                keys.append(_mix(down[i] + field * _M3)), members.append(own)
        if not keys:
            break
        key, rows = np.concatenate(keys).view(np.int64), np.concatenate(members)
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
    return np.concatenate(first), np.concatenate(second)


_EDGES = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.LongType(), False)])


def _edge_batch(a, b) -> pa.RecordBatch:
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _node_edges(nodes: DataFrame, threshold: float, leaf: int) -> DataFrame:
    """Edges (a < b) that join up the sets of each node (key, cid, sketch) that may be similar."""
    least = least_matches(threshold)

    def run(batches):
        held = [np.zeros(0, np.int64)] * (2 + WORDS)
        for b in batches_with_end(batches):
            if b is not None:
                held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns)]
            key = held[0]
            # The last node may go on in the next batch.
            end = len(key) if b is None else int(np.searchsorted(key, key[-1])) if len(key) else 0
            if not end:
                continue
            key, cid, s = key[:end], held[1][:end], np.stack(held[2:], 1)[:end].view(np.uint64)
            held = [h[end:] for h in held]
            shared = np.r_[False, key[1:] == key[:-1]]
            shared[:-1] |= shared[1:]
            key, cid, s = key[shared], cid[shared], s[shared]
            x, y = walk(key, s, threshold, least, leaf)
            root = joined(len(key), x, y)
            moved = np.flatnonzero(root != np.arange(len(key)))
            yield _edge_batch(cid[moved], cid[root[moved]])

    dealt = nodes.select("key", "cid", *SKETCH).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidied(run), _EDGES).where("a <> b").distinct()


def batches_with_end(batches):
    """The batches, and then None."""
    yield from batches
    yield None


def _few(rows: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``rows``, to be broadcast if there are at most ``most``."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def sketch_matches(a: list[Column], b: list[Column]) -> Column:
    """Number of equal 4-bit fields of two sketches."""
    total = None
    for x, y in zip(a, b):
        x = x.bitwiseXOR(y)
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 2)).bitwiseAND(F.lit(0x1111111111111111))
        part = F.lit(16) - F.bit_count(y)
        total = part if total is None else total + part
    return total


def _go_down(rows: DataFrame, threshold: float, level: int, last: bool, name: str) -> tuple[DataFrame, DataFrame]:
    """What becomes of nodes that are too large for a task: edges of those that are alike, children of the others.

    Alike: at least half of a node's sets are like one of three random ones.  At the last level every
    node is one group.  A child is a coordinate, chosen at random in the node, and a field there.
    """
    least = least_matches(threshold)
    pick = lambda k: F.min(F.struct(F.xxhash64(F.lit(level * 8 + k), "cid"), *SKETCH)).alias(f"p{k}")
    pivots = rows.groupBy("key").agg(F.min("cid").alias("low"), *map(pick, range(3)))
    like = F.lit(False)
    for k in range(3):
        like = like | (sketch_matches([F.col(c) for c in SKETCH], [F.col(f"p{k}")[c] for c in SKETCH]) >= least)
    share = rows.join(_few(pivots), "key").groupBy("key", "low").agg(F.avg(like.cast("double")).alias("share"))
    nodes = stored(share.select("key", "low", ((F.col("share") >= 0.5) | F.lit(last)).alias("whole")), f"{name}-nodes")
    judged = rows.join(_few(nodes), "key")
    edges = stored(judged.where("whole AND cid <> low").select(F.col("low").alias("a"), F.col("cid").alias("b")), f"{name}-edges")
    rate = int(SPREAD / (threshold * COORDS) * (1 << 20))
    field = f"shiftrightunsigned(get(array({', '.join(SKETCH)}), cast(i div 16 as int)), cast(4 * (i % 16) as int)) & 15L"
    down = f"transform(filter(sequence(0, {COORDS - 1}), i -> pmod(xxhash64({level}, key, i), {1 << 20}) < {rate}), i -> xxhash64(key, i, {field}))"
    below = stored(judged.where("NOT whole").select(F.explode(F.expr(down)).alias("key"), "cid", *SKETCH), f"{name}-below")
    drop_stored(nodes)
    return edges, below


def candidate_edges(classes: DataFrame, keys: list[str], threshold: float, task: int, leaf: int) -> DataFrame:
    """Edges (a < b) that join up classes with all classes that may be similar, stored."""
    # Stored, so that a class is dealt to its nodes once, however many of them are large.
    nodes = stored(classes.select("cid", *SKETCH, F.explode(F.array(*keys)).alias("key")), "near-nodes")
    found, made, level = [], [nodes], 0
    while True:
        large = stored(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > task).select("key"), f"near-large{level}")
        made.append(large)
        if not large.head(1):
            found.append(_node_edges(nodes, threshold, leaf))
            break
        side = _few(large)
        found.append(_node_edges(nodes.join(side, "key", "left_anti"), threshold, leaf))
        whole, nodes = _go_down(nodes.join(side, "key"), threshold, level, level == DEPTH, f"near-level{level}")
        found.append(whole), made.extend((whole, nodes))
        level += 1
    out = stored(_all(found).distinct() if len(found) > 1 else found[0], "near-edges")
    drop_stored(*made)
    return out


def linked(sets: list[np.ndarray], roots: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Exact links that join the roots of all linked sets; sets of one root aren't compared.

    ``side``: a set is compared only with sets of which one of the two has it.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True)) if roots[0] != roots[1] and 100 * sizes.min() >= percent * sizes.max() else 0
        return [(0, 1)] if both and 100 * both >= percent * (int(sizes.sum()) - both) else []
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(token, kind="stable")
    rows_of = row[order]  # sets by token
    first = np.searchsorted(token[order], np.arange(int(token.max(initial=-1)) + 2))
    begin = np.cumsum(sizes) - sizes
    mark = np.zeros(len(first), bool)
    at = np.unique(roots, return_inverse=True)[1]
    out = []
    for k in range(m - 1):
        other = np.arange(k + 1, m)
        ok = (at[other] != at[k]) & (100 * np.minimum(sizes[other], sizes[k]) >= percent * np.maximum(sizes[other], sizes[k]))
        if side is not None and not side[k]:
            ok &= side[other]
        other = other[ok]
        if not len(other):
            continue
        own = token[begin[k] : begin[k] + sizes[k]]
        a, n = first[own], first[own + 1] - first[own]
        if int(sizes[other].sum()) < int(n.sum()):  # few sets are open: look their tokens up
            mark[own] = True
            n = sizes[other]
            flat = np.arange(int(n.sum())) + np.repeat(begin[other] - (np.cumsum(n) - n), n)
            both = np.add.reduceat(mark[token[flat]].astype(np.int64), np.cumsum(n) - n)
            mark[own] = False
        else:  # else the sets that hold this one's tokens
            both = np.bincount(rows_of[np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)], minlength=m)[other]
        for j in other[100 * both >= percent * (sizes[k] + sizes[other] - both)]:
            if at[j] != at[k]:
                out.append((k, int(j)))
                at[at == at[j]] = at[k]
    return out


class _Sets:
    """Hashed sets of classes, made anew from the documents when they are needed."""

    def __init__(self, docs: DataFrame, classes: DataFrame, doc_id: str, text: str, shingle: int, unique: bool):
        self.body = _body(docs, doc_id, text)
        self.ids = classes.select("cid", F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"))
        self.shingle, self.unique = shingle, unique

    def of(self, cids: DataFrame) -> DataFrame:
        """cid, body (the set's hashes) for ``cids``, stored.

        Rows come by doc_id and hash of the text, so that rows without an id, or of one id, meet the classes of their own text only; a
        row whose set isn't the class's (a text of the same hash) doesn't count.
        """
        shingle = self.shingle

        def run(batches):
            make = Shingler(shingle)
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    cid, body = [], []
                    for c, t in zip(b.column(0).slice(at, 500).to_pylist(), b.column(1).slice(at, 500)):
                        s = make(t.as_py())
                        if fingerprint(s) == c:
                            cid.append(c), body.append(s.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(body, pa.binary())], names=["cid", "body"])

        wanted = _few(self.ids.join(cids, "cid", "left_semi"))
        rows = self.body.join(wanted, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th"))).select("cid", "text").mapInArrow(tidied(run), "cid long, body binary")
        return stored(rows if self.unique else rows.dropDuplicates(["cid"]), "near-sets")


def _compared(rows: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Exact links within each task, from rows (key..., cid, root, side, body); a set that comes twice counts once."""
    names = [f"t{k}" for k in range(len(key))]

    def run(batches):
        now, own = None, {}

        def links():
            if len(own) < 2:
                return [], []
            ids = sorted(own)
            got = linked([np.frombuffer(own[c][2], np.uint64) for c in ids], np.array([own[c][0] for c in ids], np.int64), percent, np.array([own[c][1] for c in ids]))
            return [ids[i] for i, _ in got], [ids[j] for _, j in got]

        for b in batches:
            a, z = [], []
            keys = zip(*(b.column(x).to_pylist() for x in range(len(names))))
            cid, root, side = (b.column(len(names) + x).to_pylist() for x in range(3))
            for n, k in enumerate(keys):
                if k != now:
                    x, y = links()
                    a += x
                    z += y
                    now, own = k, {}
                if cid[n] not in own or side[n]:
                    own[cid[n]] = (root[n], side[n], b.column(len(names) + 3)[n].as_py())
            if a:
                yield _edge_batch(a, z)
        yield _edge_batch(*links())

    dealt = rows.select(*(F.col(k).alias(n) for k, n in zip(key, names)), "cid", "root", "side", "body").repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(tidied(run), _EDGES)


def _parts(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """How many chunks the rows of each ``by`` make."""
    n = F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("n") / CHUNK_TOKENS)).cast("int")
    return rows.groupBy(*by).agg(n.alias(name))


def _large_group_links(rows: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """Links within groups of more than one chunk; ``rows``: grp, cid, n.

    Sets of which one has under ``percent`` of the other's size can't be linked, so a set meets those of
    its own band of sizes and of the two beside it.
    """
    band = F.floor(F.ln("n") / -math.log(percent / 100)).cast("int")
    rows = rows.withColumn("band", band)
    parts = stored(_parts(rows, ["grp", "band"], "parts"), "near-parts")
    part = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    rows = stored(rows.join(parts, ["grp", "band"]).withColumn("part", part), "near-members")
    # Each chunk with pivots of its band and of the next.
    pick = [F.min(F.struct(F.xxhash64(F.lit(k), "cid").alias("h"), F.col("cid").alias("cid"))).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = rows.groupBy("grp", "band").agg(*pick).select("grp", "band", F.explode(F.array_distinct(F.array(*(F.col(f"p{k}")["cid"] for k in range(PIVOTS))))).alias("cid"))
    pivots = pivots.select("grp", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), "cid").join(parts, ["grp", "band"])
    pivots = pivots.select("grp", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cid")
    near = rows.select("grp", "band", "part", "cid", F.lit(False).alias("side")).union(pivots.select("grp", "band", "part", "cid", F.lit(True)))
    near = near.withColumn("root", F.col("cid")).withColumn("side", F.lit(True)).join(sets, "cid")
    first = stored(_compared(near, ["grp", "band", "part"], percent), "near-chunks")
    # What is outside the main component meets all chunks around it.
    own = stored(_rooted(rows, components(first, "near-chunks-cc")), "near-rooted")
    main = own.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("grp").agg(F.max(F.struct("c", "root")).alias("m")).select("grp", F.col("m.root").alias("main"))
    stray = own.join(_few(main), "grp").where("root <> main").select("grp", "band", "cid", "n", "root")
    many = _parts(stray, ["grp", "band"], "strays")
    stray = stored(stray.join(many, ["grp", "band"]).withColumn("spart", F.pmod(F.xxhash64(F.lit(1), "cid"), F.col("strays")).cast("int")), "near-strays")
    tasks = stray.select("grp", F.col("band").alias("sband"), "spart").distinct().select("grp", "sband", "spart", F.explode(F.array(*(F.col("sband") + d for d in (-1, 0, 1)))).alias("band"))
    tasks = stored(tasks.join(parts, ["grp", "band"]).select("grp", "sband", "spart", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "near-tasks")
    found = [first]
    if tasks.head(1):
        key = ["grp", "sband", "spart", "band", "part"]
        theirs = own.join(tasks, ["grp", "band", "part"]).select(*key, "cid", "root", F.lit(False).alias("side"))
        ours = stray.select("grp", F.col("band").alias("sband"), "spart", "cid", "root").join(tasks, ["grp", "sband", "spart"]).select(*key, "cid", "root", F.lit(True).alias("side"))
        found.append(stored(_compared(theirs.union(ours).join(sets, "cid"), key, percent), "near-strays-links"))
    drop_stored(parts, rows, own, stray, tasks)
    return found


def _first_row() -> Column:
    """Of several rows the one with the smallest id, rows without one last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))


def links(sigs: DataFrame, docs: DataFrame, *, shingle: int, percent: int, doc_id: str, text: str, task: int = TASK, leaf: int = LEAF) -> DataFrame:
    """Verified links (a, b) between classes, stored: enough of them to join every component."""
    threshold = percent / 100
    keys = [c for c in sigs.columns if c[0] == "k"]
    classes = sigs.where(F.col("cid").isNotNull()).groupBy("cid").agg(_first_row().alias("row"), *(F.first(c).alias(c) for c in ("n", *SKETCH, *keys)))
    classes = stored(classes.select("cid", "row.doc_id", "row.th", "n", *SKETCH, *keys), "near-classes")
    edges = candidate_edges(classes, keys, threshold, task, leaf)
    if not edges.head(1):
        return edges
    unique = not sigs.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("c")).where("c > 1").head(1)
    groups = components(edges, "near-groups").select(F.col("node").alias("cid"), F.col("root").alias("grp"))
    rows = groups.join(classes.select("cid", "n"), "cid")
    rows = stored(rows.join(_parts(rows, ["grp"], "chunks"), "grp"), "near-rows")
    sets = _Sets(docs, classes, doc_id, text, shingle, unique).of(groups.select("cid"))
    small = rows.where("chunks = 1").select("grp", "cid", F.col("cid").alias("root"), F.lit(True).alias("side")).join(sets, "cid")
    found = [stored(_compared(small, ["grp"], percent), "near-small")]
    large = rows.where("chunks > 1").select("grp", "cid", "n")
    if large.head(1):
        found += _large_group_links(large, sets, percent)
    out = found[0]
    if len(found) > 1:
        out = stored(_all(found), "near-links")
        drop_stored(*found)
    drop_stored(classes, edges, groups, rows, sets)
    return out


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """node, root for every node of ``edges`` (a, b): equal for nodes that are joined; stored.

    Contraction: each node goes to the least of itself and its neighbours, and on to where that one
    went; then edges are redrawn between what is left.  Ids are fingerprints, so least ones are random
    ones and every round leaves a fraction of the nodes.  What is left after rounds of
    stored tables, at most LOCAL_EDGES edges, one task joins up.
    """
    left = stored(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    steps: list[DataFrame] = []
    while left.limit(LOCAL_EDGES + 1).count() > LOCAL_EDGES:
        ends = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        first = ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root"))
        jump = first.select(F.col("node").alias("root"), F.col("root").alias("far"))
        steps.append(step := stored(first.join(jump, "root").select("node", F.col("far").alias("root")), f"{name}-step"))
        of_a, of_b = (step.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "ab")
        moved = left.join(of_a, "a").join(of_b, "b").where("ra <> rb")
        rest = stored(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-left")
        drop_stored(left)
        left = rest

    def settle(batches):
        a, b = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *((r.column(0).to_numpy(), r.column(1).to_numpy()) for r in batches)))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[joined(len(nodes), at[: len(a)], at[len(a) :])])], names=["node", "root"])

    out = last = left.coalesce(1).mapInArrow(settle, "node long, root long")
    if steps:
        steps.append(stored(last, f"{name}-step"))
        out = steps[0]
        for step in steps[1:]:
            on = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
            out = out.join(on, "root", "left").select("node", F.coalesce("far", "root").alias("root"))
    out = stored(out, name)
    drop_stored(left, *steps)
    return out


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the component of each class so far, as ``root``."""
    r = roots.select(F.col("node").alias("cid"), "root")
    return nodes.join(r, "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0].select("a", "b")
    for t in tables[1:]:
        out = out.union(t.select("a", "b"))
    return out


def _classified(docs: DataFrame, shingle: int, percent: int, doc_id: str, text: str, trees: int, task: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of the rows, and per class (cid) its component's first row (``row``: no_id, doc_id, th)."""
    sigs = stored(signatures(docs, shingle, percent / 100, trees, doc_id, text), "near-sigs")
    found = links(sigs, docs, shingle=shingle, percent=percent, doc_id=doc_id, text=text, task=task, leaf=leaf)
    roots = components(found, "near-final")
    per_class = _rooted(sigs.where(F.col("cid").isNotNull()).groupBy("cid").agg(_first_row().alias("own")), roots)
    least = per_class.groupBy("root").agg(F.min("own").alias("row"))
    drop_stored(found)
    return sigs, per_class.join(least, "root").select("cid", "row")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", trees: int = TREES, task: int = TASK, leaf: int = LEAF) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, cid (class of equal sets), component_id, kept.

    Linked: 100 x intersection >= ``percent`` x union.  component_id is the smallest doc_id of
    the component; null if none of its rows has an id, and then all are kept (``deduplicated`` keeps one row there too).
    """
    sigs, per_class = _classified(docs, shingle, percent, doc_id, text, trees, task, leaf)
    rows = sigs.select("doc_id", F.col("n").alias("n_shingles"), "cid").join(per_class.select("cid", F.col("row.doc_id").alias("least_id")), "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    return rows.select("doc_id", "n_shingles", "cid", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def deduplicated(docs: DataFrame, *, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component, the one with the smallest id; columns unchanged.

    A row is told by its id and text: of rows that share an id, or have none, one a component stays as well (the one whose
    text has the smallest hash).  Texts without words are all kept.  Rows that repeat both id and text count as one.
    """
    sigs, per_class = _classified(docs, shingle, percent, doc_id, text, TREES, TASK, LEAF)
    row, first = F.struct("doc_id", "th"), F.struct("row.doc_id", "row.th")
    judged = sigs.select("doc_id", "th", "cid").join(per_class, "cid", "left").withColumn("kept", F.col("row").isNull() | row.eqNullSafe(first))
    id_, th = fresh(docs, "_gone_id"), fresh(docs, "_text_hash")
    rows = stored(judged.groupBy(F.col("doc_id").alias(id_), F.col("th").alias("gone_th")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "near-kept")
    # The rows that go are fewer than those that stay; while they are few the texts aren't moved.
    gone = _few(rows.where("NOT kept").select(id_, F.col("gone_th").alias(f"{th}_gone")))
    out = docs.withColumn(th, F.xxhash64(col(docs, text).cast("string")))
    out = out.join(gone, col(docs, doc_id).cast("long").eqNullSafe(F.col(id_)) & (F.col(th) == F.col(f"{th}_gone")), "left_anti").drop(th)
    if rows.where("kept AND n > 1").head(1):  # repeated rows: the one case that costs a shuffle of texts
        out = out.dropDuplicates([doc_id, text])
    drop_stored(sigs)
    return out
