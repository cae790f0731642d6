"""Filters of colour scans, by what they promise of pages made here."""

import numpy as np
import pytest

from folioflow.functions import colors
from folioflow.operators import scans

RANDOM = np.random.default_rng(8)


def page(h=90, w=120, tint=(1.0, 1.0, 1.0)):
    """Paper that darkens to the right, with bars of ink."""
    light = np.linspace(235, 130, w) * np.ones((h, 1))
    image = light[..., None] * np.array(tint)
    image[20:24, 10:110] *= 0.2
    image[60:64, 10:110] *= 0.2
    return colors.whole(image)


def test_black_and_white():
    got = colors.filtered(page(), "blackWhite")
    assert set(np.unique(got)) == {0, 255}
    assert (got[21:23, 12:108] == 0).all() and (got[62, 12:108] == 0).all()
    away = np.r_[0:18, 27:57, 68:90]
    assert (got[away] == 255).all()
    assert (colors.filtered(page(), "blackWhite", brightness=0.3) >= got).all()


def test_whiteboard_turns_paper_white():
    image = page()
    image[40:44, 20:100] = (190, 40, 40)
    got = colors.filtered(image, "whiteboard").astype(int)
    assert got[np.r_[0:16, 70:90]].min() >= 250
    assert (got[41:43, 25:95, 0] - got[41:43, 25:95, 1]).min() >= 150


def test_auto_colour_takes_out_a_cast_and_shadows():
    got = colors.filtered(page(tint=(1.0, 0.95, 0.75)), "autoColor").astype(int)
    clean = got[np.r_[0:16, 70:90]]
    assert clean.min() >= 225 and np.ptp(clean.reshape(-1, 3).mean(0)) < 6
    assert got[21:23, 15:105].max() < 110


def test_gray_and_photo():
    image = RANDOM.integers(90, 150, (20, 30, 3)).astype(np.uint8)
    gray = colors.filtered(image, "grayscale")
    assert (np.ptp(gray, axis=-1) == 0).all() and gray.min() == 0 and gray.max() == 255
    rich = colors.filtered(image, "photo").astype(int)
    assert np.ptp(rich, axis=-1).mean() > np.ptp(image.astype(int), axis=-1).mean()
    even = np.full((4, 4, 3), 100, np.uint8)
    assert (np.ptp(colors.filtered(even, "photo"), axis=-1) == 0).all() and (colors.filtered(even, "grayscale") == 100).all()


@pytest.mark.parametrize("name", [*colors.FILTERS, "no such filter"])
def test_every_filter_keeps_sizes_and_its_input(name):
    for h, w in ((1, 1), (1, 9), (7, 2), (30, 41), (230, 310)):
        image = RANDOM.integers(0, 256, (h, w, 3)).astype(np.uint8)
        held = image.copy()
        got = colors.filtered(image, name)
        assert got.shape == image.shape and got.dtype == np.uint8 and (image == held).all()
    assert colors.filtered(np.zeros((0, 4, 3), np.uint8), name).shape == (0, 4, 3)


def test_adjustments():
    values = np.repeat(np.arange(256, dtype=np.uint8).reshape(16, 16, 1), 3, -1)
    assert (colors.filtered(values, "original") == values).all()
    for b, c in ((0.4, 0), (-0.4, 0), (0, 0.7), (0, -0.7), (3, -3)):
        assert (np.diff(colors.adjusted(b, c).astype(int)) >= 0).all()
    assert (colors.adjusted(0.4, 0) >= np.arange(256)).all() and (colors.adjusted(-0.4, 0) <= np.arange(256)).all()
    assert np.ptp(colors.adjusted(0, -1)) == 0 and colors.level_at(np.arange(100, dtype=np.uint8), 0.25) == 24


def test_images_of_a_table(spark):
    rows = [("a", 2, 1, [10, 20, 30, 40, 50, 60]), ("b", 2, 2, [1, 2, 3]), ("c", 1, 1, [1, None, 3]), ("d", 1, 1, None), (None, 1, 1, [7, 8, 9])]
    images = spark.createDataFrame(rows, "image_id string, width int, height int, pixels array<int>")
    got = {r.image_id: r.pixels for r in scans.colour_filtered(images, "original").collect()}
    assert got == {"a": [10, 20, 30, 40, 50, 60], None: [7, 8, 9]}
    assert scans.colour_filtered(images.limit(0), "photo").count() == 0
