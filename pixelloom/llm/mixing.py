"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source the mix walks the documents in
key order, again and again, until the source's budget of words is used up: every document is
taken ``floor(target / size of source)`` times, and those before the cut once more.  The cut is
found with distributed prefix sums: the keys of a source are range-partitioned into buckets (a
uniform key gives even ones, about ``BUCKET_ROWS`` rows each, however hot the source), sums of
buckets are added up per source, and only the bucket in which the budget ends is sorted.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share the words of all
documents; a target stops at ``MAX_EPOCHS`` times its source's size and the excess is shared
anew by weight.  The result of that filling has a closed form: with sources sorted by
cap / weight, those before the first one whose cap isn't reached are capped.

Defined cases: null text has size 0; a null source is a source of its own, the last; a source
without words gets target 0; documents that tie in every respect share what is left for
them evenly; an empty table gives an empty result; very long texts are counted whole; repeated rows are documents of their own, which share a key and
so tie; other columns, whatever their names, are kept by ``mixed_documents`` and not read by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, col, fresh, q, stored

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BUCKET_ROWS = 20_000
SEED = 20_240_117
KEY_BITS = 60


def words(text: Column) -> Column:
    """Number of words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """Hash-random key of ``KEY_BITS`` bits; copies under other ids get other keys."""
    whole = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, KEY_BITS // 4), 16, 10).cast("long")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with, for each of ``sums``, its sum over the rows before in the total order; stored.

    Rows are dealt by ranges of their keys and added up where they are; sums over the ranges (one row a partition) give each range its start.
    """
    own = rows.select("*", *(k.alias(f"_o{i}") for i, k in enumerate(order)), *(v.alias(f"_v_{n}") for n, v in sums.items()))
    keys = [f"_o{i}" for i in range(len(order))]
    own = stored(own.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), f"{name}-order")
    own = own.withColumn("_range", F.shiftright("_at", 33))  # the place in the range is below
    each = own.groupBy("_range").agg(*(F.sum(f"_v_{n}").alias(f"_r_{n}") for n in sums))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    start = each.select("_range", *(F.coalesce(F.sum(f"_r_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums))
    inner = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = own.join(F.broadcast(start), "_range")  # a row a partition
    return stored(own.select(*rows.columns, *((F.col(f"_s_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0))).alias(n) for n in sums)), name)


def targets(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size): adds weight and target.

    Sources are ranked, and summed up in the order of cap / weight, by ranges: however many there are, no task has them all.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked = running(sources, order, {"rank": F.lit(1)}, "mix-ranked")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double")
    s = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    total = s.agg(F.sum("source_size").cast("double").alias("total"), F.sum("weight").alias("weights"))
    ratio = F.col("cap") / F.col("weight")
    up = running(s, [ratio, *order], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}, "mix-filled").crossJoin(F.broadcast(total))  # one row
    level = (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    # The first source that isn't capped fixes the level of all; those before it are under their caps' level.
    first = up.where(ratio > level).agg(F.min_by(level, F.struct(ratio, *order)).alias("level"))  # one row
    s = up.crossJoin(F.broadcast(first))
    return s.select("source", "source_size", "weight", F.round(F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")), 6).alias("target"))


def plan(sizes: DataFrame, bucket_rows: int = BUCKET_ROWS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Where each source's budget ends.

    ``sizes``: source, size, key.  One row per source: source, source_size, target, copies
    (whole epochs), cut_key, cut_words (what is left for the rows at cut_key), cut_rows (how
    many rows have that key).  Rows of smaller key are taken once more.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    goal = targets(per.select("source", "source_size"), max_epochs)
    goal = goal.withColumn("budget", F.round("target").cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("copies", whole).withColumn("left", F.col("budget") - F.col("copies") * F.col("source_size"))
    goal = stored(goal, "mix-goal")

    # All sources have the same bucket bounds, set by the hottest: 2^k of them.
    most = per.agg(F.max("rows")).first()[0] or 0
    bits = max(0, (max(1, most // bucket_rows)).bit_length())
    bucket = F.shiftright("key", KEY_BITS - bits).cast("int")
    sums = sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(up), F.lit(0)))
    same = F.col("s.source").eqNullSafe(F.col("g.source"))
    ends = sums.alias("s").join(goal.alias("g"), same).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words")))
    ends = ends.select(F.col("s.source").alias("source"), "bucket", (F.col("left") - F.col("before")).alias("rest"))

    inside = sizes.withColumn("bucket", bucket).alias("s").join(F.broadcast(ends).alias("g") if _few(ends) else ends.alias("g"), same & (F.col("s.bucket") == F.col("g.bucket")))
    inside = inside.groupBy(F.col("s.source").alias("source"), "key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("cut_rows"), F.first("rest").alias("rest"))
    walk = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum("words").over(walk), F.lit(0)))
    cut = inside.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    cut = cut.select("source", F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("cut_words"), "cut_rows")
    out = goal.alias("g").join(cut.alias("s"), same, "left").select(
        F.col("g.source").alias("source"), "source_size", "target", "copies", "cut_key", "cut_words", "cut_rows"
    )
    return stored(out, "mix-plan")


#: Rows of at most this many sources are broadcast (under 100 bytes each).
BROADCAST_SOURCES = 100_000


def _few(sources: DataFrame) -> bool:
    return sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def with_plan(rows: DataFrame, source: str, cuts: DataFrame) -> DataFrame:
    """Join each row to its source's cut: broadcast while the sources are few, else by shuffle,
    where Spark splits the hot source."""
    names = {c: fresh(rows, f"_{c}") for c in cuts.columns}
    side = cuts.select(*(F.col(c).alias(n) for c, n in names.items()))
    if _few(cuts):
        side = F.broadcast(side)
    return rows.join(side, col(rows, source).eqNullSafe(side[q(names["source"])]), "left"), names


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies.

    ``taken`` counts words: whole epochs, and in the last one what lies before the cut, so a
    source's sum is its budget exactly; the document at the cut is taken in part.
    """
    sizes = stored(docs.select(
        col(docs, doc_id).alias("doc_id"), col(docs, source).cast("string").alias("source"),
        words(col(docs, text)).alias("size"), key_of(col(docs, doc_id), col(docs, text)).alias("key"),
    ), "mix-sizes")
    cuts = plan(sizes.select("source", "size", "key"), max_epochs=max_epochs)
    rows, n = with_plan(sizes, "source", cuts)
    c = {k: F.col(v) for k, v in n.items()}
    last = F.when(F.col("key") < c["cut_key"], F.col("size")).when(F.col("key") == c["cut_key"], F.floor(c["cut_words"] / c["cut_rows"])).otherwise(F.lit(0))
    taken = (c["copies"] * F.col("size") + F.coalesce(last, F.lit(0))).cast("long")
    return rows.select("doc_id", "source", "size", c["source_size"].alias("source_size"), c["target"].alias("target"), taken.alias("taken"), c["copies"].alias("copies"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The mix as a table: rows of ``docs``, each as often as it is taken, whole texts only.

    The document at the cut comes once more if at least half of it lies before the cut.
    Only (source, size, key) is shuffled to plan the cuts, never the texts.
    """
    sized = docs.select(col(docs, source).cast("string").alias("source"), words(col(docs, text)).alias("size"), key_of(col(docs, doc_id), col(docs, text)).alias("key"))
    cuts = plan(stored(sized, "mix-sizes"), max_epochs=max_epochs)
    rows, n = with_plan(docs, source, cuts)
    c = {k: F.col(v) for k, v in n.items()}
    key = key_of(col(rows, doc_id), col(rows, text))
    half = c["cut_words"] * 2 >= words(col(rows, text)) * c["cut_rows"]
    more = F.when(key < c["cut_key"], 1).when((key == c["cut_key"]) & half, 1).otherwise(0)
    times = (c["copies"] + F.coalesce(more, F.lit(0))).cast("int")
    # A source without words has no budget to end: its (empty) documents are left out.
    again = fresh(rows, "_again")
    return rows.withColumn(again, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select(*(col(docs, x) for x in docs.columns))
