"""Pixel scores: the image form, the column form, and their agreement."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from pixelloom.functions import color
from pixelloom.operators import scoring
from pixelloom.sources import png, problem_tree


def image(seed, h=32, w=32):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), np.uint8)


def test_all_equal():
    s = scoring.image_stats(image(1), image(1), image(1))
    assert s["edit_pixels"] == 0 and all(b["iou"] == 1 and b["edit_accuracy"] == 1 and b["changed_pixels"] == 0 for b in s["blocks"])


def test_perfect_output():
    s = scoring.image_stats(image(1), image(2), image(2))
    assert all(b["iou"] == 1 and b["preservation_accuracy"] == 1 for b in s["blocks"])


def test_untouched_output():
    s = scoring.image_stats(image(1), image(2), image(1))
    assert s["blocks"][0]["edit_accuracy"] == 0 and s["blocks"][0]["changed_pixels"] == 0


def test_counts_rise_with_the_threshold():
    s = scoring.image_stats(image(1), image(2), image(3))["blocks"]
    assert all(a["edit_correct_pixels"] <= b["edit_correct_pixels"] and a["changed_pixels"] >= b["changed_pixels"] for a, b in zip(s, s[1:]))


def test_lab_of_black_and_white():
    assert np.allclose(color.lab_array(np.zeros((4, 4, 3), np.uint8)), 0, atol=1e-4)
    assert np.allclose(color.lab_array(np.full((1, 1, 3), 255, np.uint8))[0, 0], [100, 0, 0], atol=0.02)


@pytest.mark.parametrize(("h", "w"), [(48, 64), (96, 128), (16, 16), (32, 32), (20, 64)])
def test_fit_image_has_the_answers_size(h, w):
    out = scoring.fit_image(image(3, h, w), 32, 32)
    assert out.shape == (32, 32, 3)


def test_fit_image_doubles_pixels():
    small = image(4, 16, 16)
    assert (scoring.fit_image(small, 32, 32) == small.repeat(2, 0).repeat(2, 1)).all()


@pytest.mark.parametrize("shape", [(5, 7, 3), (1, 1, 3), (6, 4)])
def test_png_round_trip(shape):
    x = np.random.default_rng(0).integers(0, 256, shape, np.uint8)
    back = png.decode(png.encode(x))
    assert (back == (x if x.ndim == 3 else x[..., None].repeat(3, 2))).all()


def test_images_and_columns_agree(spark, tmp_path):
    """Three problems on disk (one without output, one of another size), scored as images and as pixels."""
    rows = []
    for k in range(3):
        i, a = image(10 + k, 12, 16), image(10 + k, 12, 16)
        a[:5] = 255 - a[:5]
        o = a.copy()
        o[3:8, :9] = np.clip(o[3:8, :9].astype(int) + k * 2 - 1, 0, 255)
        problem_tree.write_problem(tmp_path / "p" / "bench" / "removal", k, i, a, {"instruction": "x", "problem_id": k})
        if k != 1:
            folder = tmp_path / "o" / "m" / "bench" / "removal"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{k:04d}_output.png").write_bytes(png.encode(o if k == 0 else o.repeat(2, 0).repeat(2, 1)))
            for y in range(12):
                rows += [(k, *map(int, i[y, x]), *map(int, a[y, x]), *map(int, o[y, x])) for x in range(16)]
    probs = problem_tree.problems(spark, f"file://{tmp_path}/p")
    outs = problem_tree.outputs(spark, f"file://{tmp_path}/o")
    plan = probs.join(outs, ["benchmark", "task", "idx"], "left")
    got = {r["idx"]: r for r in scoring.score_images(plan, ["idx"]).collect()}
    assert got[1]["has_output"] is False and got[1]["blocks"][3]["preservation_accuracy"] == 0 and got[2]["correct_output_size"] is False
    px = spark.createDataFrame(rows, "idx int, ir int, ig int, ib int, ar int, ag int, ab int, pr int, pg int, pb int")
    for r in scoring.score(px, ["idx"]).collect():
        assert [x for b in r["blocks"] for x in b] == pytest.approx([x for b in got[r["idx"]]["blocks"] for x in b])


def test_tree_is_written_by_executors_and_broken_sidecars_are_left_out(spark):
    got = problem_tree.demo_index(spark).collect()
    assert len(got) == 2 * 2 * 12 - 1 and all(r["height"] == r["width"] == 32 and r["has_answer"] and r["instruction"] for r in got)
    assert {(r["task"], r["idx"]) for r in got} == {(t, i) for t in ("removal", "recolor") for i in {r["idx"] for r in got}} - {("recolor", 2)}


def plain_score(image, answer, output):
    """Counts for the thresholds pixel by pixel, by the formulas of colour alone."""
    def lab(rgb):
        x = rgb.astype(np.float64) / 255
        x = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4) @ np.array(color.MATRIX).T / np.array(color.WHITE)
        f = np.where(x > (6 / 29) ** 3, np.cbrt(x), x * (29 / 6) ** 2 / 3 + 4 / 29)
        return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)

    edit = (image != answer).any(-1)
    de, de_in = (np.sqrt(((lab(output) - lab(x)) ** 2).sum(-1)) for x in (answer, image))
    return int(edit.sum()), [(int((edit & (de <= t)).sum()), int((~edit & (de <= t)).sum()), int((de_in > t).sum())) for t in range(11)]


def test_full_size_pictures_in_all_conditions():
    """1,024 pixels wide, one problem of each condition, against the plain scorer; one output is far off, one a little."""
    from pixelloom import dims
    from pixelloom.generate import run, tasks

    rng = np.random.default_rng(0)
    for name, (w, h, _, striped, level) in dims.CONDITIONS.items():
        made = next(p for k in range(50) if (p := tasks.generate("recolor", run.seed_of(name, k), dims.n_of("recolor", level), w, h, dims.TASKS["recolor"][1][0], striped=striped)))
        assert made.image.shape == (h, w, 3) and max(h, w) >= 1024
        near = np.clip(made.answer.astype(int) + rng.integers(-2, 3, made.answer.shape), 0, 255).astype(np.uint8)
        for output in (made.image, near):
            got = scoring.image_stats(made.image, made.answer, output)
            edit, want = plain_score(made.image, made.answer, output)
            assert got["edit_pixels"] == edit
            for b, counts in zip(got["blocks"], want):
                have = (b["edit_correct_pixels"], b["preservation_correct_pixels"], b["changed_pixels"])
                assert have == pytest.approx(counts, abs=3), (name, b["t"])  # float32 beside float64 at the threshold itself


@pytest.mark.parametrize("spread", [12, 40, 255])
def test_far_colours_are_left_out_without_a_difference(spread):
    """Counts of an output that differs in every pixel are those of a plain pass over all pixels, of which few are scored."""
    from pixelloom.functions.color import lab_array
    from pixelloom.operators import scoring

    rng = np.random.default_rng(spread)
    answer = np.array([(255, 0, 0), (0, 0, 0), (128, 128, 128), (255, 255, 255), (0, 0, 9)], np.uint8)[rng.integers(0, 5, (320, 20))].repeat(16, 1)
    image = answer.copy()
    image[40:90, 60:200] = (0, 255, 0)
    output = np.clip(answer.astype(int) + rng.integers(-spread, spread + 1, answer.shape), 0, 255).astype(np.uint8)
    got = scoring.image_stats(image, answer, output)
    de, de_in = (np.sqrt(((lab_array(output) - lab_array(x)) ** 2).sum(-1)) for x in (answer, image))
    edit = (image != answer).any(-1)
    assert got["edit_pixels"] == edit.sum()
    for t, b in enumerate(got["blocks"]):
        assert (b["edit_correct_pixels"], b["preservation_correct_pixels"], b["changed_pixels"]) == ((edit & (de <= t)).sum(), (~edit & (de <= t)).sum(), (de_in > t).sum())
    packed = [scoring._packed(x) for x in (image, answer, output)]
    near = scoring._may_be_near(*packed)
    assert len(near) < 0.2 * edit.size or spread < 255


def test_few_pixels_of_noise_are_converted_whatever_the_answer(monkeypatch):
    """An answer of some 290 colours and an output that differs in every pixel: counts as pixel by pixel; runs of the problem are shared by its outputs."""
    from pixelloom.functions.color import lab_array
    from pixelloom.operators import infer

    image = np.empty((300, 512, 3), np.uint8)
    image[:, :200], image[:, 200:] = (40, 120, 90), (200, 30, 60)
    answer = image.copy()
    answer[50:250, 100:390] = np.stack([np.arange(290) // 2, 200 - np.arange(290) // 2, np.arange(290) // 3], 1)
    output = infer.create("noise")(image, "x", answer)[0]
    assert (output == np.random.default_rng(zlib.crc32(b"x")).integers(0, 256, image.shape, np.uint8)).all()
    converted = []
    monkeypatch.setattr(color, "lab_array", lambda rgb: (converted.append(rgb.size // 3), lab_array(rgb))[1])
    of = scoring.base(image, answer)
    edit = (image != answer).any(-1)
    for o in (output, image, answer, np.where(edit[..., None], output, image), answer.repeat(2, 0).repeat(2, 1)):
        got = scoring.triplet_score(image, answer, o, of)
        o = scoring.fit_image(o, 300, 512)
        de, de_in = (np.sqrt(((lab_array(o) - lab_array(x)) ** 2).sum(-1)) for x in (answer, image))
        for t, b in enumerate(got["blocks"]):
            assert (b["edit_correct_pixels"], b["preservation_correct_pixels"], b["changed_pixels"]) == ((edit & (de <= t)).sum(), (~edit & (de <= t)).sum(), (de_in > t).sum())
        assert got["edit_pixels"] == edit.sum() and got["blocks"] == scoring.triplet_score(image, answer, o)["blocks"]
        if o is output:
            assert sum(converted) < 0.2 * edit.size
    monkeypatch.setattr(scoring, "MANY_COLOURS", 8)
    assert scoring.image_stats(image, answer, output, of) == scoring.image_stats(image, answer, output)
