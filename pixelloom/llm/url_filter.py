"""URL verdicts: fixed allow/block rules first, then a weighted vocabulary found by Aho-Corasick.

Terms are strict (one hit blocks) or soft (at least ``SOFT_LIMIT`` distinct ones whose weights
sum to ``SOFT_WEIGHT`` block).  A hit counts only if it is not inside a longer run of letters.
The automaton is built once a task from a broadcast list; the url column is read alone.  Rules and terms may be given as tables, of at
most ``MAX_ENTRIES`` rows each (more is an error): a url's cost depends on its length and hits, not on their number.

Defined cases: null, empty or malformed urls have empty host and path and are allowed unless the
vocabulary hits; repeated rows are judged alike; an empty table gives an empty result; very long urls are searched whole; of rules of one
length that fit a url there is one only (they are the same text), and of the same rule given twice the first holds; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import col

# The rules of the contract, (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# The vocabulary, term -> weight; strict terms block alone.
STRICT = {"porn": 1.0, "xxx": 1.0, "casino": 1.0, "malware": 1.0, "phishing": 1.0, "spam-farm": 1.0, "warez": 1.0}
SOFT = {"ads": 0.5, "ad": 0.4, "track": 0.5, "tracker": 0.5, "click": 0.4, "popup": 0.6, "banner": 0.4, "spam": 0.7, "affiliate": 0.5, "bet": 0.4, "adult": 0.6, "promo": 0.3}
SOFT_LIMIT = 2
SOFT_WEIGHT = 0.8
#: Most rows of a table of rules or terms: they are broadcast.
MAX_ENTRIES = 1_000_000


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or if there is no ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((p for p in map(rest.find, "/?#") if p >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((p for p in map(tail.find, "?#") if p >= 0), default=len(tail))
    host = rest[:end]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:stop]


class RuleIndex:
    """Rules by host; a url looks up its host's suffixes only, so the cost doesn't grow with the rules."""

    def __init__(self, rules=RULES):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def best(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, as (rule, verdict)."""
        found: tuple[str | None, str | None] = (None, None)
        size, at = -1, 0
        while host and at >= 0:
            for prefix, verdict in self.by_host.get(host[at:], ()):
                rule = host[at:] + prefix
                if path.startswith(prefix) and len(rule) > size:
                    found, size = (rule, verdict), len(rule)
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return found


class Vocabulary:
    """Aho-Corasick automaton over strict and soft terms with letter boundaries."""

    def __init__(self, strict=STRICT, soft=SOFT):
        self.automaton = ahocorasick.Automaton()
        for kind, terms in (("strict", strict), ("soft", soft)):
            for term, weight in terms.items():
                self.automaton.add_word(term, (term, kind, weight))
        self.automaton.make_automaton()

    def hits(self, url: str | None) -> tuple[dict[str, int], dict[str, int], float]:
        """Counts of strict and of soft terms, and the weight of the distinct soft terms."""
        strict: dict[str, int] = {}
        soft: dict[str, int] = {}
        weight = 0.0
        low = (url or "").lower()
        for end, (term, kind, w) in self.automaton.iter(low) if len(self.automaton) else ():
            start = end - len(term) + 1
            if (start and low[start - 1].isalpha()) or (end + 1 < len(low) and low[end + 1].isalpha()):
                continue
            counts = strict if kind == "strict" else soft
            if kind == "soft" and term not in soft:
                weight += w
            counts[term] = counts.get(term, 0) + 1
        return strict, soft, weight

    def blocks(self, strict: dict, soft: dict, weight: float) -> bool:
        return bool(strict) or (len(soft) >= SOFT_LIMIT and weight > SOFT_WEIGHT - 1e-9)


SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()),
    T.StructField("n_strict", T.LongType()), T.StructField("n_soft", T.LongType()), T.StructField("soft_weight", T.DoubleType()),
])


def _bounded(table: DataFrame, *names: str) -> list[tuple]:
    rows = table.select(*(col(table, n) for n in names)).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} rules or terms")
    return [tuple(r) for r in rows]


def rules_of(table: DataFrame) -> tuple[tuple[str, str, str], ...]:
    """Rules of a table (verdict, host, path): hosts lower-cased, rows without a verdict or host left out, a null path is ``/``.

    Of a rule with two verdicts ``block`` holds.
    """
    rows = {(h.lower(), p or "/", v) for v, h, p in _bounded(table, "verdict", "host", "path") if v and h}
    return tuple((v, h, p) for h, p, v in sorted(rows, key=lambda r: (r[0], r[1], r[2] != "block")))


def terms_of(table: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Strict and soft terms of a table (term, strict, weight): lower-cased, null and empty ones left out.

    Of a term given twice strict holds, then the greater weight; a null weight is 1.
    """
    strict: dict[str, float] = {}
    soft: dict[str, float] = {}
    for term, is_strict, weight in _bounded(table, "term", "strict", "weight"):
        if term:
            own, w = (strict if is_strict else soft), 1.0 if weight is None else float(weight)
            own[term.lower()] = max(w, own.get(term.lower(), w))
    return strict, {t: w for t, w in soft.items() if t not in strict}


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", *, rules: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``; reads two columns, no shuffle.

    ``rules`` (verdict, host, path) and ``terms`` (term, strict, weight) replace the fixed ones.
    """
    own_rules = RULES if rules is None else rules_of(rules)
    strict_terms, soft_terms = (STRICT, SOFT) if terms is None else terms_of(terms)
    shared = pages.sparkSession.sparkContext.broadcast((own_rules, strict_terms, soft_terms))  # at most 2 x MAX_ENTRIES

    def run(batches):
        given, strict_, soft_ = shared.value
        rules, words = RuleIndex(given), Vocabulary(strict_, soft_)
        for b in batches:
            rows = []
            for u in b.column(1).to_pylist():
                host, path = split_url(u)
                rule, verdict = rules.best(host, path)
                strict, soft, weight = words.hits(u)
                rows.append((host, path, rule, verdict or ("block" if words.blocks(strict, soft, weight) else "allow"), len(strict), len(soft), round(weight, 6)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=SCHEMA.names)

    return pages.select(col(pages, page_id).cast("long").alias("page_id"), col(pages, url).cast("string").alias("url")).mapInArrow(run, SCHEMA)
