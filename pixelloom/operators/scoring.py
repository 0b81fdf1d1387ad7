"""Scores of an output against input and answer, pixel by pixel and per problem.

A problem's eleven threshold blocks come from one aggregation: per-threshold counts are conditional
sums, so pixels are read once, partial sums leave each task, and one row a problem is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import THRESHOLDS
from ..functions import color

METRICS = ("edit_accuracy", "preservation_accuracy", "iou", "changed_pixels")
BLOCK_FIELDS = ("edit_correct_pixels", "preservation_correct_pixels", *METRICS)


def changed_mask() -> Column:
    """Input and answer differ in some channel."""
    c = F.col
    return (c("ir") != c("ar")) | (c("ig") != c("ag")) | (c("ib") != c("ab"))


def with_distances(px: DataFrame) -> DataFrame:
    """Adds edit (changed mask), de (output to answer) and de_in (output to input)."""
    labs = px.select("*", *(color.lab_struct(F.col(f"{k}r"), F.col(f"{k}g"), F.col(f"{k}b")).alias(f"lab_{k}") for k in "iap"))
    return labs.select(
        *px.columns, changed_mask().alias("edit"), color.delta_e(F.col("lab_p"), F.col("lab_a")).alias("de"), color.delta_e(F.col("lab_p"), F.col("lab_i")).alias("de_in")
    )


def ratio(num: Column, den: Column) -> Column:
    """num / den, 1.0 where there is nothing to count."""
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(1.0))


def score(px: DataFrame, keys: list[str]) -> DataFrame:
    """keys, edit_pixels, preservation_pixels, blocks: array of (t, counts and accuracies)."""
    d = with_distances(px)
    edit, keep = F.col("edit"), ~F.col("edit")
    sums = [F.count_if(edit).alias("edit_pixels"), F.count_if(keep).alias("preservation_pixels")]
    for t in THRESHOLDS:
        sums += [
            F.count_if(edit & (F.col("de") <= t)).alias(f"ec{t}"), F.count_if(keep & (F.col("de") <= t)).alias(f"pc{t}"),
            F.count_if(F.col("de_in") > t).alias(f"ch{t}"),
        ]
    g = d.groupBy(*keys).agg(*sums)
    ep, pp = F.col("edit_pixels"), F.col("preservation_pixels")

    def block(t: int) -> Column:
        ec, pc, ch = F.col(f"ec{t}"), F.col(f"pc{t}"), F.col(f"ch{t}")
        return F.struct(
            F.lit(t).alias("t"), ec.alias("edit_correct_pixels"), pc.alias("preservation_correct_pixels"), ratio(ec, ep).alias("edit_accuracy"),
            ratio(pc, pp).alias("preservation_accuracy"), ratio(ec, ep + pp - pc).alias("iou"), ch.alias("changed_pixels"),
        )

    return g.select(*keys, "edit_pixels", "preservation_pixels", F.array(*map(block, THRESHOLDS)).alias("blocks"))


def zero_blocks(edit: Column, keep: Column) -> Column:
    """Blocks of a problem without output: all zero, but an empty image is matched in full."""
    iou = F.when((edit == 0) & (keep == 0), F.lit(1.0)).otherwise(F.lit(0.0))
    none = F.lit(0).cast("long")
    return F.array(*(F.struct(
        F.lit(t).alias("t"), none.alias("edit_correct_pixels"), none.alias("preservation_correct_pixels"), F.lit(0.0).alias("edit_accuracy"),
        F.lit(0.0).alias("preservation_accuracy"), iou.alias("iou"), none.alias("changed_pixels"),
    ) for t in THRESHOLDS))


def mean_of_blocks(blocks: Column, field: str) -> Column:
    total = F.aggregate(blocks, F.lit(0.0), lambda acc, b: acc + b[field].cast("double"))
    return total / F.size(blocks)


def long_form(stats: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and block: block '0' .. '10' and 'mean', with METRICS as doubles."""
    per = F.transform("blocks", lambda b: F.struct(b["t"].cast("string").alias("block"), *(b[m].cast("double").alias(m) for m in METRICS)))
    mean = F.array(F.struct(F.lit("mean").alias("block"), *(mean_of_blocks(F.col("blocks"), m).alias(m) for m in METRICS)))
    return stats.select(*keys, F.explode(F.concat(per, mean)).alias("x")).select(*keys, "x.*")


def diff_class(edit: Column, de: Column, t: float) -> Column:
    """green / red: changed and right / wrong; blue / orange: to be kept and right / wrong."""
    return F.when(edit, F.when(de <= t, "green").otherwise("red")).otherwise(F.when(de <= t, "blue").otherwise("orange"))


def fit_geometry(w_out: Column, h_out: Column, w_ans: Column, h_ans: Column) -> dict[str, Column]:
    """Size after scaling to cover the answer, and the corner of the centred crop."""
    scale = F.greatest(w_ans / w_out, h_ans / h_out)
    same = (w_out == w_ans) & (h_out == h_ans)
    n_w = F.when(same, w_ans).otherwise(F.ceil(w_out * scale)).cast("long")
    n_h = F.when(same, h_ans).otherwise(F.ceil(h_out * scale)).cast("long")
    return {"scaled_w": n_w, "scaled_h": n_h, "crop_x": F.floor((n_w - w_ans) / 2).cast("long"), "crop_y": F.floor((n_h - h_ans) / 2).cast("long")}


# -- whole images ----------------------------------------------------------------------------------

def fit_image(out: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest-neighbour scaling to cover, then centred crop (source pixel: centre of the target's)."""
    h, w = out.shape[:2]
    if (h, w) == (height, width):
        return out
    scale = max(width / w, height / h)
    n_w, n_h = math.ceil(w * scale), math.ceil(h * scale)
    xs = np.minimum(((np.arange(n_w) + 0.5) * w / n_w).astype(int), w - 1)
    ys = np.minimum(((np.arange(n_h) + 0.5) * h / n_h).astype(int), h - 1)
    x, y = (n_w - width) // 2, (n_h - height) // 2
    return out[ys[y : y + height]][:, xs[x : x + width]]


def _packed(image: np.ndarray) -> np.ndarray:
    x = np.zeros((image.shape[0] * image.shape[1], 4), np.uint8)
    for k in range(3):  # rows of three bytes at a time would be slow
        x[:, 2 - k] = image.reshape(-1, 3)[:, k]
    return x.view("<u4")[:, 0]


#: Runs of pixels from which on those that are far from both colours are told by their cell.
MANY_RUNS = 1 << 15
#: (input, answer) colour pairs up to which a table of cells is made for each (32 KB each).
MANY_PAIRS = 256


def _cell_bounds() -> tuple[np.ndarray, np.ndarray]:
    """Least and largest L*, a*, b* in each cell of 8 x 8 x 8 colours: light and its root grow with every channel."""
    at = np.arange(32, dtype=np.uint8) * 8
    corner = lambda k: np.stack(np.meshgrid(at + k, at + k, at + k, indexing="ij"), -1).reshape(-1, 3).astype(np.uint8)
    low, high = (color.lab_roots(corner(np.uint8(k))).astype(float) for k in (0, 7))
    span = lambda x, y: np.stack([116 * x[:, 1] - 16, 500 * (x[:, 0] - y[:, 1]), 200 * (x[:, 1] - y[:, 2])])
    return span(low, high), span(high, low)


_CELLS = _cell_bounds()


def _may_be_near(i: np.ndarray, a: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Places whose output may be within the largest threshold of input or answer; one is left for rounding."""
    begin = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (a[1:] != a[:-1])])
    pairs, which = np.unique(i[begin].astype(np.uint64) << np.uint64(32) | a[begin], return_inverse=True)
    if len(pairs) > MANY_PAIRS:
        return np.arange(len(o))
    reach = THRESHOLDS[-1] + 1
    near = np.zeros((len(pairs), 32**3), bool)
    for packed in ((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)):
        for c in np.unique(packed):
            lab = color.lab_array(np.array([c >> 16, c >> 8 & 255, c & 255], np.uint8)[None])[0]
            meets = [(low <= x + reach) & (high >= x - reach) for low, high, x in zip(*_CELLS, lab)]
            near[packed == c] |= meets[0] & meets[1] & meets[2]
    cell = (o >> 9 & 0x7C00) | (o >> 6 & 0x3E0) | (o >> 3 & 0x1F)
    return np.flatnonzero(near.ravel().take(np.repeat(which << 15, np.diff(np.r_[begin, len(o)])) | cell))


def _changes(image: np.ndarray) -> np.ndarray:
    """Bytes (three a pixel, padded to words) that differ from the pixel before."""
    flat = np.ascontiguousarray(image).reshape(-1)
    out = np.zeros(-(-len(flat) // 8) * 8, bool)
    np.not_equal(flat[3:], flat[:-3], out=out[3 : len(flat)])
    return out


def _starts(changes: np.ndarray, n: int) -> np.ndarray:
    """Pixels (of n) with which a run begins: words without a change are passed over."""
    word = np.flatnonzero(changes.view(np.uint64) != 0)
    k = np.flatnonzero(changes.reshape(-1, 8)[word])
    at = (word[k >> 3] * 8 + (k & 7)) // 3
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    return np.r_[0, at] if n else at


def _colours(image: np.ndarray, at: np.ndarray) -> np.ndarray:
    flat = np.ascontiguousarray(image).reshape(-1)
    red, green, blue = (flat[3 * at + c].astype(np.uint32) for c in range(3))
    return red << 16 | green << 8 | blue


def _lab(packed: np.ndarray) -> np.ndarray:
    return color.lab_array(np.stack([packed >> 16, packed >> 8 & 255, packed & 255], -1).astype(np.uint8))


@dataclass
class Base:
    """Runs of pixels with the same colours in input and answer, which all outputs of a problem are scored against."""

    n: int
    changes: np.ndarray
    size: np.ndarray
    colours: np.ndarray
    i: np.ndarray  # number of the input's and the answer's colour in each run
    a: np.ndarray


def base(image: np.ndarray, answer: np.ndarray) -> Base:
    n = image.shape[0] * image.shape[1]
    changes = _changes(image)
    if answer is not image:
        changes |= _changes(answer)
    first = _starts(changes, n)
    code, colours = pd.factorize(np.concatenate([_colours(image, first), _colours(answer, first)]))
    return Base(n, changes, np.diff(np.r_[first, n]), colours, code[: len(first)], code[len(first) :])


#: Pixels whose channels are compared at once, which a cache holds.
BAND = 1 << 16
#: Colours up to which a table of cells is made for each (32 KB each).
MANY_COLOURS = 1024
#: The same bounds for cells of 32 x 32 x 32 colours, and the 64 small cells in each of these.
_wide = [x.reshape(3, 8, 4, 8, 4, 8, 4) for x in _CELLS]
_WIDE = _wide[0].min((2, 4, 6)).reshape(3, 512), _wide[1].max((2, 4, 6)).reshape(3, 512)
_INSIDE = np.arange(32**3).reshape(8, 4, 8, 4, 8, 4).transpose(0, 2, 4, 1, 3, 5).reshape(512, 64)


@lru_cache(1 << 14)
def _reach(colour: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells that may be within the largest threshold of a colour (one is left for rounding), and their least and largest channels."""
    lab, reach = _lab(np.array([colour], np.uint32)).T, THRESHOLDS[-1] + 1
    meets = lambda cells: ((cells[0] <= lab + reach) & (cells[1] >= lab - reach)).all(0)
    cells = _INSIDE[meets(_WIDE)].ravel()
    cells = cells[meets((_CELLS[0][:, cells], _CELLS[1][:, cells]))]  # the colour's own is one of them
    rgb = np.stack([cells >> 10, cells >> 5 & 31, cells & 31])
    return cells.astype(np.int16), (rgb.min(1) * 8).astype(np.uint8), (rgb.max(1) * 8 + 7).astype(np.uint8)


def _near_places(b: Base, output: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of an output, and their runs, that may be within the largest threshold of input or answer: by their channels first, then by cell."""
    runs = np.arange(len(b.size), dtype=np.int32)
    if len(b.colours) > MANY_COLOURS:
        return np.arange(b.n), np.repeat(runs, b.size)
    cells, low, high = zip(*(_reach(int(c)) for c in b.colours))
    low, span = np.array(low), np.array(high) - np.array(low)
    near = np.zeros(len(cells) << 15, bool)
    for k, own in enumerate(cells):
        near[k << 15 : k + 1 << 15][own] = True
    flat, edit, first = np.ascontiguousarray(output).reshape(-1), b.a != b.i, np.cumsum(b.size) - b.size
    of_answer, of_input = b.a.astype(np.int64) << 15, b.i.astype(np.int64) << 15
    places, owners = [], []
    for begin in range(0, b.n, BAND):
        end = min(begin + BAND, b.n)
        r = slice(np.searchsorted(first, begin, "right") - 1, np.searchsorted(first, end))
        size = np.minimum(first[r] + b.size[r], end) - np.maximum(first[r], begin)
        channels = [flat[3 * begin + c : 3 * end : 3].copy() for c in range(3)]
        hit = np.zeros(end - begin, bool)
        for code in (b.a[r], b.i[r]) if edit[r].any() else (b.a[r],):
            own = True
            for c in (1, 0, 2):
                own &= channels[c] - np.repeat(low[code, c], size) <= np.repeat(span[code, c], size)
            hit |= own
        at = np.flatnonzero(hit)
        run = np.repeat(runs[r], size)[at]
        red, green, blue = (x[at].astype(np.int64) >> 3 for x in channels)
        cell = red << 10 | green << 5 | blue
        own = near[of_answer[run] | cell]
        edited = np.flatnonzero(edit[run])
        own[edited] |= near[of_input[run[edited]] | cell[edited]]
        places.append(at[own] + begin)
        owners.append(run[own])
    return np.concatenate(places), np.concatenate(owners)


def image_stats(image: np.ndarray, answer: np.ndarray, output: np.ndarray, of: Base | None = None) -> dict:
    """Counts and blocks of one image triplet in float32; ``of``: the runs of input and answer, if they are known.

    Pixels that follow one another with the same three colours are scored once and counted by their number; of many,
    only those are scored whose colour may be within the largest threshold.
    """
    b = base(image, answer) if of is None else of
    n, size, edit, labs = b.n, b.size, b.i != b.a, _lab(b.colours)
    ep = int(size[edit].sum())
    pp = n - ep
    i, a = b.i, b.a
    changes = None if output is image or output is answer else _changes(output)
    if changes is None:
        lab_o = labs[i if output is image else a]
    elif np.count_nonzero(changes) > n // 2:  # hardly any runs
        at, run = _near_places(b, output)
        i, a, edit, size = i[run], a[run], edit[run], np.ones(len(run), np.int64)
        lab_o = _lab(_colours(output, at))
    else:
        changes |= b.changes
        first = _starts(changes, n)
        run = np.repeat(np.arange(len(size)), size)[first]
        i, a, edit, size, o = i[run], a[run], edit[run], np.diff(np.r_[first, n]), _colours(output, first)
        if len(first) > MANY_RUNS:
            near = _may_be_near(b.colours[i], b.colours[a], o)
            i, a, edit, size, o = i[near], a[near], edit[near], size[near], o[near]
        lab_o = _lab(o)
    # A difference counts for the thresholds from the next whole number on.
    last = THRESHOLDS[-1] + 1
    step = lambda x, y: np.minimum(np.ceil(np.sqrt(((x - labs[y]) ** 2).sum(-1))), last).astype(np.int64)
    de = step(lab_o, a)
    de_in = de.copy()
    de_in[edit] = step(lab_o[edit], i[edit])
    count = lambda s, w: np.cumsum(np.bincount(s, w, last + 1)).astype(np.int64).tolist()  # noqa: E731  of pixels up to each threshold
    edited, kept, same = count(de, size * edit), count(de, size * ~edit), count(de_in, size)
    div = lambda x, d: x / d if d else 1.0
    blocks = []
    for t in THRESHOLDS:
        ec, pc = edited[t], kept[t]
        blocks.append({
            "t": t, "edit_correct_pixels": ec, "preservation_correct_pixels": pc, "edit_accuracy": div(ec, ep), "preservation_accuracy": div(pc, pp),
            "iou": div(ec, ep + pp - pc), "changed_pixels": n - same[t],
        })
    return {"edit_pixels": ep, "preservation_pixels": pp, "blocks": blocks}


_BLOCK = "struct<t:int,edit_correct_pixels:bigint,preservation_correct_pixels:bigint,edit_accuracy:double,preservation_accuracy:double,iou:double,changed_pixels:bigint>"


def _bgr(row: dict) -> np.ndarray:
    data = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    if row["nChannels"] == 1:
        return np.repeat(data, 3, 2)
    return data[..., 2::-1]


def triplet_score(image: np.ndarray, answer: np.ndarray, output: np.ndarray | None, of: Base | None = None) -> dict:
    """has_output, correct_output_size, edit_pixels, preservation_pixels and blocks of one triplet; without an output all pixels are wrong."""
    if output is None:
        edit = np.any(image != answer, -1)
        ep, pp = int(edit.sum()), int((~edit).sum())
        iou = 1.0 if ep + pp == 0 else 0.0
        zero = [{"t": t, "edit_correct_pixels": 0, "preservation_correct_pixels": 0, "edit_accuracy": 0.0, "preservation_accuracy": 0.0, "iou": iou, "changed_pixels": 0} for t in THRESHOLDS]
        return {"has_output": False, "correct_output_size": None, "edit_pixels": ep, "preservation_pixels": pp, "blocks": zero}
    same = output.shape[:2] == answer.shape[:2]
    return {"has_output": True, "correct_output_size": same} | image_stats(image, answer, fit_image(output, *answer.shape[:2]), of)


#: Fields that ``triplet_score`` fills, as a schema.
SCORE_FIELDS = f"has_output boolean, correct_output_size boolean, edit_pixels bigint, preservation_pixels bigint, blocks array<{_BLOCK}>"


def score_images(triplets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, has_output, correct_output_size, edit_pixels, preservation_pixels, blocks.

    ``triplets``: keys and the image structs input, answer, output (null or undecodable: missing).
    Images are decoded in this stage only, a few at a time (Arrow batches of whole images).
    """
    types = {f.name: f.dataType.simpleString() for f in triplets.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", has_output boolean, correct_output_size boolean, edit_pixels bigint, preservation_pixels bigint, blocks array<{_BLOCK}>"

    def run(batches):
        for b in batches:
            rows = [triplet_score(_bgr(r["input"]), _bgr(r["answer"]), _bgr(r["output"]) if r["output"] is not None and r["output"]["height"] > 0 else None) for r in b.select(["input", "answer", "output"]).to_pylist()]
            made = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), *made.columns], names=[*keys, *made.schema.names])

    return triplets.select(*keys, "input", "answer", "output").mapInArrow(run, schema)


_ARROW = pa.schema([
    ("has_output", pa.bool_()), ("correct_output_size", pa.bool_()), ("edit_pixels", pa.int64()), ("preservation_pixels", pa.int64()),
    ("blocks", pa.list_(pa.struct([("t", pa.int32()), ("edit_correct_pixels", pa.int64()), ("preservation_correct_pixels", pa.int64()), ("edit_accuracy", pa.float64()), ("preservation_accuracy", pa.float64()), ("iou", pa.float64()), ("changed_pixels", pa.int64())]))),
])
