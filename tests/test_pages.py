"""Pages on photos made here: corners are found within a few hundredths of the diagonal, and none where no page is."""

import numpy as np
import pytest

from folioflow.functions import pages
from folioflow.operators import scans


def inside(quad, h, w):
    y, x = np.mgrid[:h, :w]
    ahead = np.roll(quad, -1, 0) - quad
    return np.all([dx * (y - cy) - dy * (x - cx) >= 0 for (cx, cy), (dx, dy) in zip(quad, ahead)], axis=0)


def photo(random, kind, h=300, w=400):
    """A page with lines of text on a desk; its corners."""
    angle = np.radians(random.uniform(-30, 30))
    size = np.array([w, h]) * random.uniform(0.5, 0.62, 2)
    turn = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
    quad = (np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)]) * size / 2) @ turn + np.array([w, h]) * random.uniform(0.46, 0.54, 2) + random.uniform(-12, 12, (4, 2))
    y, x = np.mgrid[:h, :w]
    desk = np.full((h, w), random.uniform(50, 110))
    if kind == 1:
        desk += 18 * np.sin(y * 0.2 + 2 * np.sin(x * 0.01))
    if kind == 2:
        desk += 15 * np.sin(x * 0.05) * np.cos(y * 0.06)
    held = inside(quad, h, w)
    shown = np.where(held, desk.mean() + random.uniform(70, 110), desk)
    centre = quad.mean(0)
    shown = np.where(inside(centre + (quad - centre) * 0.75, h, w) & (y % 14 < 2), 50, shown)
    if kind == 3:
        shown = shown * (1.1 - 0.35 * x / w)
    shown = shown[..., None] * [1.0, 0.98, 0.95] + random.normal(0, 6, (h, w, 3))
    return np.clip(shown, 0, 255).astype(np.uint8), quad


@pytest.mark.parametrize("kind", range(4))
def test_corners_of_pages(kind):
    random = np.random.default_rng(kind)
    done = 0
    while done < 6:
        image, quad = photo(random, kind)
        if (quad < 6).any() or (quad > [393, 293]).any():
            continue
        got = pages.corners(image)
        assert got is not None
        nearest = np.linalg.norm(got[:, None] - quad[None], axis=-1)
        assert nearest.min(1).max() < 0.03 * 500, (kind, done, got, quad)
        done += 1


def test_no_page_no_corners():
    random = np.random.default_rng(9)
    y, x = np.mgrid[:300, :400]
    for scene in (np.full((300, 400), 120.0), 120 + 30 * np.sin(y * 0.2 + 2 * np.sin(x * 0.01)), 80 * (x / 400 - 0.5) + 120, 120 + 25 * np.sin(x * 0.02) + 25 * np.sin(y * 0.03)):
        noisy = scene[..., None] * [1.1, 1.0, 0.8] + random.normal(0, 8, (300, 400, 3))
        assert pages.corners(np.clip(noisy, 0, 255).astype(np.uint8)) is None
    assert pages.corners(np.zeros((10, 300, 3), np.uint8)) is None and pages.corners(np.zeros((40, 40, 3), np.uint8)) is None


def test_a_page_that_leaves_the_photo():
    image = np.full((200, 300, 3), 60, np.uint8)
    image[40:, 50:240] = 220
    got = pages.corners(image)
    assert np.abs(got - [(50, 40), (240, 40), (240, 200), (50, 200)]).max() < 4


def test_largest_quadrilateral():
    square = np.array([(0, 0), (5, -1), (10, 0), (10, 10), (0, 10)], float)
    got = pages.largest_inside(square)
    assert abs(pages.areas(got[None])[0]) == 100 and pages.largest_inside(square[:3]) is None


def test_corners_of_a_table(spark):
    image = np.full((120, 160, 3), 50, np.uint8)
    image[20:100, 30:130] = 230
    rows = [(1, 160, 120, image.ravel().tolist()), (2, 20, 20, [80] * 1200), (3, 9, 9, [1]), (4, 1, 1, None)]
    frame = spark.createDataFrame(rows, "image_id long, width int, height int, pixels array<int>")
    got = {r.image_id: r.corners for r in scans.page_corners(frame).collect()}
    assert got.keys() == {1, 2} and got[2] is None
    assert np.abs(np.array(got[1]) - [(30, 20), (130, 20), (130, 100), (30, 100)]).max() < 3
    assert scans.page_corners(frame.limit(0)).count() == 0


def test_images_of_a_small_table_are_spread(spark):
    from folioflow.session import spread, table

    rows = spread(table(spark, "/root/testdata/sf0.001", "supplier").select("s_suppkey"), "s_suppkey")
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_places_worked_out_once_give_the_same_values():
    from folioflow.functions import scan

    random = np.random.default_rng(2)
    planes = [random.normal(size=(7, 9)) for _ in range(2)]
    x, y = random.uniform(-2, 11, (2, 5, 40))
    for plane, got in zip(planes, scan.sampled_all(planes, x, y)):
        left, top = np.minimum(np.clip(x, 0, 8).astype(int), 7), np.minimum(np.clip(y, 0, 6).astype(int), 5)
        dx, dy = np.clip(x, 0, 8) - left, np.clip(y, 0, 6) - top
        upper = plane[top, left] * (1 - dx) + plane[top, left + 1] * dx
        lower = plane[top + 1, left] * (1 - dx) + plane[top + 1, left + 1] * dx
        assert (got == upper * (1 - dy) + lower * dy).all() and (scan.sampled(plane, x, y) == got).all()


def test_images_are_drawn_once_and_after_they_are_dealt(spark):
    """A filter on pixels had them drawn again for each condition, in the one task that reads a small table."""
    from pyspark.sql import functions as F

    from folioflow.plans.record_queries import page_corners
    from folioflow.session import spread

    drawn = F.transform(F.sequence(F.lit(1), F.lit(20 * 20 * 3)), lambda i: (i + F.col("id")).cast("int") % 200)
    images = spread(spark.range(3), "id").select(F.col("id").alias("image_id"), F.lit(20).alias("width"), F.lit(20).alias("height"), drawn.alias("pixels"))
    for frame in (scans.page_corners(images), scans.colour_filtered(images, "grayscale")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("transform(") == 1 and "Filter" not in plan, plan
    plan = page_corners(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Filter" not in plan, plan


def test_images_that_are_not_whole_are_left_out(spark):
    rows = [(1, 2, 1, [0, 1, 2, 3, 4, 255]), (2, 2, 1, [0, 1, 2, 3, 4]), (3, 2, 1, [0, 1, 2, None, 4, 5]), (4, 2, 1, None), (5, 0, 1, []), (6, -1, -2, [1] * 6), (7, None, 1, [1] * 3), (8, 1, 1, [1, 1, 1])]
    frame = spark.createDataFrame(rows, "image_id long, width long, height int, pixels array<int>").coalesce(1)
    got = scans.colour_filtered(frame, "original").collect()
    assert sorted((r.image_id, r.width, r.height, r.pixels) for r in got) == [(1, 2, 1, [0, 1, 2, 3, 4, 255]), (8, 1, 1, [1, 1, 1])]
    assert sorted(r.image_id for r in scans.page_corners(frame).collect()) == [1, 8]


def test_components_by_runs():
    from folioflow.functions import scan

    random = np.random.default_rng(5)
    for share in (0, 0.2, 0.4, 0.6, 1):
        mask = random.random((23, 31)) < share
        want, label = np.zeros(mask.shape, int), 0
        for y, x in zip(*np.nonzero(mask)):
            if not want[y, x]:
                label, todo = label + 1, [(y, x)]
                while todo:
                    y0, x0 = todo.pop()
                    if 0 <= y0 < 23 and 0 <= x0 < 31 and mask[y0, x0] and not want[y0, x0]:
                        want[y0, x0] = label
                        todo += [(y0 + a, x0 + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        assert (scan.components(mask) == want).all()


def test_images_looked_at_together_give_the_corners_of_each_alone():
    random = np.random.default_rng(6)
    images = [photo(random, n % 4, *size)[0] for n, size in enumerate([(60, 80)] * 20 + [(90, 70), (60, 80), (12, 80), (500, 420)])]
    images += [np.zeros((60, 80, 3), np.uint8), random.integers(0, 256, (60, 80, 3)).astype(np.uint8)]
    together, alone = pages.corners_of(images), [pages.corners(image) for image in images]
    assert sum(x is not None for x in alone) > 5 and any(x is None for x in alone)
    assert all((a is None and b is None) or (a == b).all() for a, b in zip(together, alone))
    assert pages.corners_of([]) == []
