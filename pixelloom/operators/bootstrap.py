"""Bootstrap confidence intervals of means, macro means, and macro means of macro means.

Two forms.  ``draws_sql_form`` resamples by key: draw i of iteration b picks the problem at
md5(seed, group, b, i) modulo n, so any SQL engine gives the same interval.  ``intervals`` is
a grouped map with numpy's generator, one group per (model, benchmark, block), whose
stream is consumed over sorted groups, all metrics sharing the indices.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CI_METRICS = ("edit_accuracy", "preservation_accuracy", "iou")
N_BOOT = 10_000
SEED = 42


def resampled_means(values: np.ndarray, rng: np.random.Generator, n_boot: int, cells: int = 1 << 22) -> np.ndarray:
    """Means of n_boot resamples of the rows of ``values`` (n, metrics).

    Indices are drawn a few resamples at a time, at most ``cells`` values (or one resample) at once;
    the stream gives the same numbers as one draw of all.
    """
    n = len(values)
    out = np.empty((n_boot, values.shape[1]))
    step = max(1, cells // max(1, n * values.shape[1]))
    for at in range(0, n_boot, step):
        k = min(step, n_boot - at)
        out[at : at + k] = values[rng.integers(0, n, size=(k, n))].mean(1)
    return out


def nested_interval(tree, n_boot: int = N_BOOT, seed: int = SEED) -> np.ndarray:
    """2.5 and 97.5 percentiles of the (nested) macro mean; empty groups are skipped.

    ``tree`` is an (n, metrics) array, or a list of trees; each list averages its children.
    """
    rng = np.random.default_rng(seed)

    def walk(t):
        if isinstance(t, np.ndarray):
            return resampled_means(t, rng, n_boot) if len(t) else None
        total, k = None, 0
        for part in map(walk, t):
            if part is not None:
                total, k = part if total is None else total + part, k + 1
        return total / k if k else None

    means = walk(tree)
    if means is None or n_boot <= 0:
        return np.zeros((2, tree.shape[1] if isinstance(tree, np.ndarray) else len(CI_METRICS)))
    return np.percentile(means, [2.5, 97.5], axis=0)


def intervals(long: DataFrame, keys: list[str], levels: list[str], order: list[str], n_boot: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """keys, ci95_<metric>_low / _high.

    A group of ``keys`` is resampled inside its innermost ``levels`` (none: the group itself) and
    averaged outwards; problems stand in ``order``.  One group must fit a worker (it is a model's
    problems in one block).  Without levels the blocks of a group are resampled together: from one seed
    blocks of the same problems draw the same indices, so these are drawn once and whole rows are taken.
    """
    types = {f.name: f.dataType.simpleString() for f in long.schema.fields}
    names = [f"ci95_{m}_{e}" for m in CI_METRICS for e in ("low", "high")]
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"{n} double" for n in names)])

    def tree(rows: pd.DataFrame, depth: int):
        if depth == len(levels):
            return rows[list(CI_METRICS)].to_numpy(float)
        return [tree(part, depth + 1) for _, part in rows.groupby(levels[depth], sort=True, dropna=False)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*levels, *order], kind="stable")
        got = nested_interval(tree(rows, 0), n_boot, seed)
        return pd.DataFrame([[*rows[keys].iloc[0], *got.T.ravel()]], columns=[*keys, *names])

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [part.sort_values(order, kind="stable") for _, part in rows.groupby("block", sort=True, dropna=False)]
        out = []
        for n in sorted({len(p) for p in parts}):
            own = [p for p in parts if len(p) == n]
            got = nested_interval(np.concatenate([p[list(CI_METRICS)].to_numpy(float) for p in own], 1), n_boot, seed).T.reshape(len(own), -1)
            out += [[*p[keys].iloc[0], *g] for p, g in zip(own, got)]
        return pd.DataFrame(out, columns=[*keys, *names])

    columns = dict.fromkeys([*keys, *levels, *order, *CI_METRICS])
    if "block" in keys and not levels:
        return long.select(*columns).groupBy(*(k for k in keys if k != "block")).applyInPandas(together, schema)
    return long.select(*columns).groupBy(*keys).applyInPandas(run, schema)


#: Rotations and sines of md5 (RFC 1321), and the words it begins with.
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Hashes made at once (as many as the cache holds), draws of a task, and problems of a row that goes to it.
TILE, DRAWS, PIECE = 1 << 14, 1 << 24, 1 << 12


def _digits(numbers: np.ndarray, n: int, at: int) -> np.ndarray:
    """Words (len(numbers), 16) of blocks that hold only the n digits of each number, from byte ``at`` on."""
    block = np.zeros((len(numbers), 64), np.uint8)
    for k in range(n):
        block[:, at + k] = numbers // 10 ** (n - 1 - k) % 10 + 48
    return block.view("<u4")


def _md5_heads(words: list[np.ndarray]) -> np.ndarray:
    """The first 32 bits of the md5 of messages of one block, of which the 16 words are given; the last three steps don't change them."""
    a, b, c, d = (np.full((1, 1), x, np.uint32) for x in _BEGIN)
    for k in range(61):
        if k < 16:
            f, w = d ^ (b & (c ^ d)), k
        elif k < 32:
            f, w = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif k < 48:
            f, w = b ^ c ^ d, (3 * k + 5) % 16
        else:
            f, w = c ^ (b | ~d), 7 * k % 16
        turn = _TURNS[k // 16][k % 4]
        x = f + a + (words[w] + np.uint32(_SINES[k]))
        up = x << np.uint32(turn)
        x >>= np.uint32(32 - turn)
        up |= x
        a, b, c, d = d, up + b, b, c
    return (b + np.uint32(_BEGIN[0])).byteswap()


def key_draws(name: str, first: int, last: int, n: int) -> np.ndarray:
    """Places (from 0) that draws 1 to n of iterations ``first`` to ``last`` pick of n: md5 of ``name|b|i``, its first 8 hex digits modulo n."""
    prefix = f"{name}|".encode()
    out = np.empty((last - first + 1, n), np.uint32)
    spans = lambda low, high: [(k, max(low, 10 ** (k - 1)), min(high, 10**k - 1)) for k in range(len(str(low)), len(str(high)) + 1)]  # noqa: E731  of numbers with as many digits
    for nb, b0, b1 in spans(first, last):
        for ni, i0, i1 in spans(1, n):
            size = len(prefix) + nb + 1 + ni
            if size > 55:  # more than one block
                for b in range(b0, b1 + 1):
                    out[b - first, i0 - 1 : i1] = [int.from_bytes(hashlib.md5(b"%s%d|%d" % (prefix, b, i)).digest()[:4]) for i in range(i0, i1 + 1)]
                continue
            fixed = np.frombuffer((prefix + bytes(nb) + b"|" + bytes(ni) + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), "<u4")
            for i in range(i0, i1 + 1, TILE):
                own_i = _digits(np.arange(i, min(i + TILE, i1 + 1)), ni, len(prefix) + nb + 1)
                step = max(1, TILE // len(own_i))
                for b in range(b0, b1 + 1, step):
                    own_b = _digits(np.arange(b, min(b + step, b1 + 1)), nb, len(prefix))
                    whole = [w for w in range(16) if own_b[:, w].any() or own_i[:, w].any()]
                    words = [own_b[:, w, None] | own_i[None, :, w] | fixed[w] if w in whole else fixed[w].reshape(1, 1) for w in range(16)]
                    out[b - first : b - first + len(own_b), i - 1 : i - 1 + len(own_i)] = _md5_heads(words)
    out -= out // np.uint32(n) * np.uint32(n)
    return out


def _drawn_means(name: str, first: int, last: int, values: list[np.ndarray], cells: int = 1 << 21) -> list[np.ndarray]:
    """Means of the resamples (iterations, metrics) of each of ``values`` (n, metrics); what is missing (NaN) isn't counted.

    Groups of several sizes under one name get the draws of all sizes, as a join by place gives them.
    """
    sizes = sorted({len(v) for v in values})
    out = [np.empty((last - first + 1, v.shape[1])) for v in values]
    known = [~np.isnan(v) for v in values]
    step = max(1, cells // sizes[-1])
    for b in range(first, last + 1, step):
        k = min(step, last + 1 - b)
        times = np.zeros((k, sizes[-1]))
        for n in sizes:
            place = key_draws(name, b, b + k - 1, n) + np.arange(0, k * n, n)[:, None]
            times[:, :n] += np.bincount(place.ravel(), minlength=k * n).reshape(k, n)
        for n in sizes:
            own = [j for j, v in enumerate(values) if len(v) == n]
            both = times[:, :n] @ np.concatenate([np.where(known[j], values[j], 0) for j in own], 1)
            most = times[:, :n].sum(1, keepdims=True)
            for at, j in zip(range(0, both.shape[1], values[own[0]].shape[1]), own):
                count = most if known[j].all() else times[:, :n] @ known[j]
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[j][b - first : b - first + k] = both[:, at : at + values[j].shape[1]] / count
    return out


def _percentile(means: Column, p: float) -> Column:
    """Of an array, between neighbours as SQL's percentile takes it."""
    def one(s: Column) -> Column:
        at = (F.size(s) - 1) * p
        low, high = F.floor(at), F.ceil(at)
        x, y = (F.element_at(s, (k + 1).cast("int")) for k in (low, high))
        return F.when(F.size(s) == 0, None).when(x == y, x).otherwise((high - at) * x + (at - low) * y)

    return F.transform(F.array(F.sort_array(means)), one)[0]


def draws_sql_form(long: DataFrame, keys: list[str], levels: list[str], order: list[str], n_boot: int, seed: int = SEED, draws: int = DRAWS) -> DataFrame:
    """The same intervals from md5 draws; ``levels`` are macro-averaged from the last to the first.

    A group's problems become rows of ``PIECE`` problems in ``order``.  Its iterations are dealt to tasks of some
    ``draws`` draws, which get its pieces by a sorted join, hash the draws, count how often each problem is taken, and
    hand on a mean an iteration: no draw is stored or sent.  A task holds 24 bytes a problem and block of its group.
    """
    leaf = [*keys, *levels]
    units = [k for k in leaf if k != "block"]
    types = {f.name: f.dataType.simpleString() for f in long.schema.fields}
    place = Window.partitionBy(*leaf).orderBy(*order)
    rows = long.select(*leaf, (F.row_number().over(place) - 1).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy(*leaf)).alias("n"), *(F.col(m).cast("double").alias(m) for m in CI_METRICS))
    rows = rows.withColumn("piece", F.floor(F.col("pos") / PIECE).cast("int"))
    pieces = rows.groupBy(*leaf, "piece").agg(F.sort_array(F.collect_list(F.struct("pos", *CI_METRICS))).alias("own"))
    # The largest of a group's blocks has all pieces, so that each piece is told the same number of parts.
    deal = rows.groupBy(*units, "piece").agg(F.greatest(F.lit(1), F.least(F.lit(n_boot), F.ceil(F.max("n") * (n_boot / draws)))).cast("int").alias("parts"))
    deal = deal.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    dealt = pieces.join(deal.hint("merge"), [*units, "piece"]).select(
        *leaf, "piece", "part", "parts", F.concat_ws("|", F.lit(str(seed)), *(F.col(k) for k in units)).alias("name"), *(F.col("own")[m].alias(m) for m in CI_METRICS)
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([*((k, "ascending") for k in leaf), ("piece", "ascending")]).combine_chunks()
        name, part, of = (table.column(c)[0].as_py() for c in ("name", "part", "parts"))
        first, last = n_boot * (part - 1) // of + 1, n_boot * part // of
        begin = np.flatnonzero(table.column("piece").to_numpy() == 0)
        values = []
        for row, end in zip(begin, [*begin[1:], table.num_rows]):
            own = table.slice(row, end - row)
            values.append(np.stack([own.column(m).combine_chunks().flatten().to_numpy(zero_copy_only=False) for m in CI_METRICS], 1))
        means = _drawn_means(name, first, last, values)
        made = [pa.array([m[:, k] for m in means], pa.list_(pa.float64())) for k in range(len(CI_METRICS))]
        return pa.table([*(table.column(k).take(pa.array(begin)) for k in leaf), pa.array([first] * len(means), pa.int32()), *made], names=[*leaf, "b", *CI_METRICS])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in leaf), "b int", *(f"{m} array<double>" for m in CI_METRICS)])
    # A given number of tasks: these few bytes, which take long, would be joined to one task.
    tasks = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = dealt.repartition(tasks, *units, "part").groupBy(*units, "part").applyInArrow(run, schema)
    if levels:
        level = level.select(*leaf, "b", F.posexplode(F.arrays_zip(*CI_METRICS))).select(*leaf, (F.col("b") + F.col("pos")).alias("b"), "col.*")
        level = level.select(*leaf, "b", *(F.nanvl(m, F.lit(None)).alias(m) for m in CI_METRICS)).dropna("all", subset=list(CI_METRICS))
        for depth in range(len(levels) - 1, -1, -1):
            level = level.groupBy(*keys, *levels[:depth], "b").agg(*(F.avg(m).alias(m) for m in CI_METRICS))
        means = level.groupBy(*keys).agg(*(F.collect_list(m).alias(m) for m in CI_METRICS))
    else:
        means = level.groupBy(*keys).agg(*(F.flatten(F.collect_list(m)).alias(m) for m in CI_METRICS))
        means = means.select(*keys, *(F.filter(m, lambda x: ~F.isnan(x)).alias(m) for m in CI_METRICS))
    return means.select(*keys, *(F.round(_percentile(F.col(m), p), 9).alias(f"ci95_{m}_{e}") for m in CI_METRICS for e, p in (("low", 0.025), ("high", 0.975))))
