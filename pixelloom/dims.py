"""Fixed dimension data: tasks, categories, modes, conditions, palettes, shapes, charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Task name -> (category, modes).
TASKS: dict[str, tuple[str, tuple[str, ...]]] = {
    "translation": ("geometric_transformation", ("amount", "align")),
    "rotation": ("geometric_transformation", ("local", "external")),
    "reflection": ("geometric_transformation", ("local", "external")),
    "scaling": ("geometric_transformation", ("amount", "match")),
    "shearing": ("geometric_transformation", ("default",)),
    "construction": ("structural_manipulation", ("line", "circle", "polygon")),
    "removal": ("structural_manipulation", ("attribute", "location")),
    "copying": ("structural_manipulation", ("default",)),
    "border": ("structural_manipulation", ("default",)),
    "cropping": ("structural_manipulation", ("straight", "tilted")),
    "recolor": ("color_change", ("color_code", "dropper")),
    "flood_fill": ("color_change", ("background", "foreground")),
    "blending": ("color_change", ("default",)),
    "gradient": ("color_change", ("background", "foreground")),
    "point_operations": ("color_change", ("invert", "grayscale", "brightness")),
    "comparison": ("symbolic_reasoning", ("default",)),
    "ordering": ("symbolic_reasoning", ("default",)),
    "pattern": ("symbolic_reasoning", ("grid", "circular")),
    "counting": ("symbolic_reasoning", ("shape", "color")),
    "legend": ("symbolic_reasoning", ("default",)),
}
# Visual condition -> (width, height, palette, striped, n level).
CONDITIONS: dict[str, tuple[int, int, str | None, bool, int]] = {
    "baseline": (1024, 1024, None, False, 0),
    "horizontal": (1024, 576, None, False, 0),
    "vertical": (576, 1024, None, False, 0),
    "nonstandard": (1024, 1024, "nonstandard", False, 0),
    "striped": (1024, 1024, None, True, 0),
    "n_med": (1024, 1024, None, False, 1),
    "n_high": (1024, 1024, None, False, 2),
    "n_xhigh": (1024, 1024, None, False, 3),
}
# Charts and their edit tasks.
CHARTS: dict[str, tuple[str, ...]] = {
    "bar_chart": ("add_bar", "sort_bars", "remove_bar", "recolor_bar"),
    "heatmap": ("add_cell", "shift_heatmap", "mask_cells", "change_colormap"),
    "line_chart": ("draw_segments", "normalize_series", "filter_series", "shade_interval"),
    "network": ("add_node", "swap_nodes", "remove_node", "recolor_node"),
    "scatter_plot": ("draw_best_fit_line", "swap_axes", "remove_outlier", "recolor_class"),
}
# The standard palette, in order.
PALETTE: dict[str, tuple[int, int, int]] = {
    "red": (255, 0, 0), "orange": (255, 165, 0), "yellow": (255, 255, 0), "green": (0, 255, 0), "blue": (0, 0, 255), "purple": (128, 0, 128),
    "pink": (255, 192, 203), "brown": (139, 69, 19), "black": (0, 0, 0), "gray": (128, 128, 128), "white": (255, 255, 255),
}
# Shape types, in order.
SHAPES = ("circle", "square", "triangle", "pentagon", "hexagon", "star", "heart", "ring", "arrow", "cross", "diamond", "semicircle")
# Scene sizes n by level, for most tasks and for those of their own.
N_LEVELS = {"": (3, 10, 25, 60), "pattern": (1, 3, 6, 10), "comparison": (3, 5, 7, 9), "ordering": (3, 5, 7, 9), "counting": (5, 10, 25, 60)}
# Error texts that are worth a retry.
TRANSIENT = ("429", "500", "502", "503", "504", "timeout", "timed out", "rate limit", "overloaded", "unavailable", "connection")
PROBLEMS_PER_TASK = 12
THRESHOLDS = tuple(range(11))
DIFF_THRESHOLDS = (0, 2, 5, 10)


def n_of(task: str, level: int) -> int:
    return N_LEVELS.get(task, N_LEVELS[""])[level]


def names(values) -> Column:
    """Constant array of strings."""
    return F.array(*map(F.lit, values))


def pick(values, index: Column) -> Column:
    """Element ``index`` (from 0) of constant values."""
    return F.element_at(names(values), (index + 1).cast("int"))


def tasks(spark: SparkSession) -> DataFrame:
    """task, category, ord, modes: 20 rows."""
    return spark.createDataFrame([(t, c, k, list(m)) for k, (t, (c, m)) in enumerate(TASKS.items())], "task string, category string, ord int, modes array<string>")


def conditions(spark: SparkSession) -> DataFrame:
    """8 rows."""
    return spark.createDataFrame([(n, k, *v) for k, (n, v) in enumerate(CONDITIONS.items())], "visual_condition string, ord int, width int, height int, palette string, striped boolean, n_level int")


def palette(spark: SparkSession) -> DataFrame:
    """ord, name, r, g, b: 11 rows."""
    return spark.createDataFrame([(k, n, *c) for k, (n, c) in enumerate(PALETTE.items())], "ord int, name string, r int, g int, b int")


def charts(spark: SparkSession) -> DataFrame:
    """chart, subtask, task (chart_subtask): 20 rows."""
    return spark.createDataFrame([(c, k, s, f"{c}_{s}") for c, subs in CHARTS.items() for k, s in enumerate(subs)], "chart string, sub int, subtask string, task string")


# -- the same data as SQL, for oracles ---------------------------------------------------------

def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_tasks() -> str:
    return "(VALUES " + ", ".join(f"('{t}', '{c}', {k}, {sql_list(m)})" for k, (t, (c, m)) in enumerate(TASKS.items())) + ") AS dim_task(task, category, ord, modes)"


def sql_conditions() -> str:
    return "(VALUES " + ", ".join(f"('{n}', {k}, {w}, {h}, {'NULL' if p is None else repr(p)}, {s}, {lv})" for k, (n, (w, h, p, s, lv)) in enumerate(CONDITIONS.items())) + ") AS dim_condition(visual_condition, ord, width, height, palette, striped, n_level)"


def sql_palette() -> str:
    return "(VALUES " + ", ".join(f"({k}, '{n}', {r}, {g}, {b})" for k, (n, (r, g, b)) in enumerate(PALETTE.items())) + ") AS dim_color(ord, name, r, g, b)"


def sql_charts() -> str:
    return "(VALUES " + ", ".join(f"('{c}', {k}, '{s}', '{c}_{s}')" for c, subs in CHARTS.items() for k, s in enumerate(subs)) + ") AS dim_chart(chart, sub, subtask, task)"
