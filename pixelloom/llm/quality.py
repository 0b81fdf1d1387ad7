"""Quality rules on documents, and host-level rules learned from their failures.

Per document: word and symbol counts, repeated lines, repeated 8-word windows.  Per host
(the ``source`` column): how often each rule fails, shrunk towards all hosts by a beta
prior whose two parameters are estimated from the hosts themselves (method of moments).

Host verdicts come from the posterior rates (a beta distribution, by its mean and deviation).  A host
is *suspect* by a rule if its rate is over the corpus rate with probability ``SURE``: its
documents are then held to that rule, which other hosts' documents may fail.  A host *fails* if,
with probability ``SURE``, more than half of its documents, and more than of the corpus, fail some
rule: all its documents go.
Documents that fail no rule stay unless their host fails.

Defined cases: null text has no words and fails ``n_words``; a null host is no host, so its
documents are judged by the document rules alone; repeated rows are judged one by one; very long
texts are judged whole; a rate just at its limit isn't over it; an empty table gives an empty result; other columns pass through untouched
unless they bear the name of an output column (compared without case), which then replaces them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, drop_stored, fresh, stored, tidied

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rules that count for the host only: share of symbols in word characters, share of repeated lines.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: Probability with which a host's rate has to be over the limit, and its one-sided normal deviate.
SURE = 0.95
DEVIATE = 1.6448536269514722
#: The prior weighs at least as much as so many documents, so a handful of failures proves little.
MIN_STRENGTH = 10.0
#: Failed hosts are broadcast up to this number (names of at most some hundred bytes).
BROADCAST_HOSTS = 100_000

SYMBOLS = "#*$%&|<>"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Number of words inside windows that occur at least twice (exact: ranks are doubled)."""
    n = len(words)
    if n <= window:
        return 0
    index: dict[str, int] = {}
    rank = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if len(index) == n:
        return 0
    length = 1
    while length < window:
        step = min(length, window - length)
        pairs = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        _, rank, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        length += step
        if len(counts) == len(pairs):
            return 0
    starts = np.flatnonzero(counts[rank] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:n])))


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The values of STATS for one whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = _WORDS.findall(text)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), lines, dup, repeated_words(words)


def with_stats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` and STATS; one pass, no shuffle."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in STATS]
    src = fresh(docs, "_text")
    types = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*(types[c] for c in keep), *(T.StructField(c, T.LongType(), False) for c in STATS)])
    n = len(keep)

    def run(batches):
        for b in batches:
            texts = b.column(n)
            got = np.array([text_stats(t) for at in range(0, b.num_rows, 500) for t in texts.slice(at, 500).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(got[:, k]) for k in range(len(STATS)))], names=[*keep, *STATS])

    return docs.select(*(col(docs, c) for c in keep), col(docs, text).alias(src)).mapInArrow(tidied(run), schema)


#: Rules that documents are held to if their host is suspect by them.
SOFT = ("symbols", "lines")
OUTPUTS = (*STATS, "base_failed", "kept")


def rule_columns() -> dict[str, Column]:
    """Failure of each rule, and of any, over STATS."""
    c = F.col
    rules = {
        "base": (c("n_words") < MIN_WORDS) | (F.lit(100) * c("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * c("n_words")),
        "symbols": F.lit(100) * c("n_symbols") > F.lit(MAX_SYMBOL_PERCENT) * c("word_chars"),
        "lines": F.lit(100) * c("n_dup_lines") > F.lit(MAX_DUP_LINE_PERCENT) * c("n_lines"),
    }
    return rules | {"any": rules["base"] | rules["symbols"] | rules["lines"]}


def host_verdicts(stats: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: documents, per rule the failures and the shrunk rate, ``suspect_`` by rule, ``host_failed``.

    Beta prior by moments over hosts: mean m of all documents, variance of the hosts' rates
    around m (weighted by documents) less what sampling alone gives; strength s = m(1-m)/v - 1,
    held in MIN_STRENGTH .. 1e6.  Posterior mean r = (failures + s m) / (documents + s), variance
    r (1 - r) / (documents + s + 1).  Sums are partial before the shuffle, so a hot host costs one row a task.
    """
    rules = rule_columns()
    hosts = stats.where(col(stats, host).isNotNull()).groupBy(col(stats, host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(r.cast("long")).alias(f"f_{k}") for k, r in rules.items())
    )
    prior = hosts.agg(
        F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("hosts"),
        *(F.sum(f"f_{k}").alias(f"s_{k}") for k in rules),
        *(F.sum(F.pow(F.col(f"f_{k}").cast("double"), F.lit(2.0)) / F.col("n")).alias(f"q_{k}") for k in rules),
    )
    out = hosts.crossJoin(F.broadcast(prior))  # the right side is one row
    for k in rules:
        m = F.col(f"s_{k}") / F.col("all_n")
        noise = m * (1 - m)
        var = F.col(f"q_{k}") / F.col("all_n") - m * m - noise * F.col("hosts") / F.col("all_n")
        strength = F.when(var * 1e6 > noise, F.greatest(F.lit(MIN_STRENGTH), noise / var - 1)).otherwise(F.lit(1e6))
        out = out.withColumn("strength", strength).withColumn(f"rate_{k}", (F.col(f"f_{k}") + F.col("strength") * m) / (F.col("n") + F.col("strength")))
        r = F.col(f"rate_{k}")
        low = r - DEVIATE * F.sqrt(r * (1 - r) / (F.col("n") + F.col("strength") + 1))
        out = out.withColumn(f"suspect_{k}", low > (F.greatest(F.lit(0.5), m) if k == "any" else m))
    return out.select("host", "n", *(f"f_{k}" for k in rules), *(f"rate_{k}" for k in rules), *(f"suspect_{k}" for k in SOFT), F.col("suspect_any").alias("host_failed"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``) with STATS, ``base_failed`` and ``kept``.

    The statistics are stored once and hosts are summed from the stored table.  With ``keep`` given
    that table is also the result's; without it, whole rows would have to be stored, so only the
    hosts' columns are, and the documents are walked a second time.  Only hosts with a verdict against
    them are joined back: broadcast while they are few, else by a left join that Spark splits by skew.
    """
    if keep is None:
        keep = [c for c in docs.columns if c.lower() not in OUTPUTS]
        summed = stored(with_stats(docs, text, [host]), "quality")
        stats = with_stats(docs, text, keep)
    else:
        keep = [c for c in keep if c.lower() not in OUTPUTS]
        summed = stats = stored(with_stats(docs, text, list(dict.fromkeys([*keep, host]))), "quality")
    found = host_verdicts(summed, host).where(F.col("host_failed") | F.col("suspect_symbols") | F.col("suspect_lines"))
    names = {c: fresh(stats, f"_{c}") for c in ("host", "host_failed", *(f"suspect_{k}" for k in SOFT))}
    bad = stored(found.select(*(F.col(c).alias(n) for c, n in names.items())), "host-verdicts")
    if stats is not summed:
        drop_stored(summed)
    if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    out = stats.join(bad, col(stats, host) == bad[names["host"]], "left")
    rules = rule_columns()
    held = [F.coalesce(F.col(names[f"suspect_{k}"]), F.lit(False)) & rules[k] for k in SOFT]
    gone = rules["base"] | F.coalesce(F.col(names["host_failed"]), F.lit(False)) | held[0] | held[1]
    return out.withColumn("base_failed", rules["base"]).withColumn("kept", ~gone).drop(*names.values())


__all__ = ["STATS", "drop_stored", "host_verdicts", "judge", "repeated_words", "text_stats", "with_stats"]
