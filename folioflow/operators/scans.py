"""Kernels of page scans over a table of planes; a plane is one row, so each runs in the row's own task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.functions import colors, pages, raster, scan
from folioflow.session import bounded_batches

Kernel = Callable[[np.ndarray], np.ndarray]

#: Filters of scanned pages that need one plane only, by name.
KERNELS: dict[str, Callable[..., Kernel]] = {
    "box_blur": lambda radius: lambda p: raster.box_blur(p, radius),
    "local_mean": lambda radius: lambda p: raster.box_mean_variance(p, radius)[0],
    "local_variance": lambda radius: lambda p: raster.box_mean_variance(p, radius)[1],
    "smallest": lambda radius: lambda p: raster.rank_filter(p, radius, False),
    "largest": lambda radius: lambda p: raster.rank_filter(p, radius, True),
    "gaussian": lambda sigma: lambda p: raster.gaussian_blur(p, sigma),
    "black_white": lambda radius: lambda p: raster.without_specks(np.where(scan.sauvola(p, radius), 0, 255).astype(np.uint8)),
    "even_light": lambda: lambda p: np.clip(p / np.maximum(scan.lighting(p), 1) * 255, 0, 255),
    "resized": lambda width, height: lambda p: scan.resized(p, width, height),
    "turned": lambda quarters: lambda p: scan.turned(p, quarters),
    "components": lambda level: lambda p: scan.components(p < level),
}


def filtered(planes: DataFrame, kernel: str, *parameters: float, key: str = "image_id") -> DataFrame:
    """(key, width, height, pixels) of planes through one of ``KERNELS``; F47, F50, W14-W17, W19, A29, A31.

    ``planes`` has key, width, height and pixels, an array of width * height values
    in rows. Planes of another number of pixels, or null ones, are left out.
    """
    run = KERNELS[kernel](*parameters)
    kind = planes.schema[key].dataType.simpleString()
    sound = planes.where("width > 0 and height > 0 and size(pixels) = width * height")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.asarray(run(np.array(p, float).reshape(h, w))) for w, h, p in zip(*(batch.column(n).to_pylist() for n in (1, 2, 3)))]
            sizes = (pa.array([x.shape[n] for x in out], pa.int32()) for n in (1, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array([x.ravel().astype(float) for x in out], pa.list_(pa.float64()))], names=[key, "width", "height", "pixels"])

    return sound.select(key, "width", "height", "pixels").mapInArrow(step, f"`{key}` {kind}, width int, height int, pixels array<double>")


def _held(images: DataFrame, key: str) -> DataFrame:
    """(key, width, height, pixels) of colour images, in batches that a Python worker can hold.

    Whether they are whole is seen where they are used: a filter here would have pixels
    that come from an expression made again for each of its conditions, and before
    ``images`` are dealt to tasks.
    """
    bounded_batches(images.sparkSession)
    return images.select(key, *(images[c].try_cast("int").alias(c) for c in ("width", "height")), images["pixels"].cast("array<int>").alias("pixels"))


def _whole(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, list[np.ndarray]]:
    """The rows of ``_held`` that have as many values as their size says, none of them null, and their images."""
    rows, shown = [], []
    for n, (w, h, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3))):
        if w and h and min(w, h) > 0 and p.is_valid and len(p.values) == w * h * 3 and not p.values.null_count:
            rows.append(n)
            shown.append(np.asarray(p.values, np.uint8).reshape(h, w, 3))
    return batch.take(pa.array(rows, pa.int64())) if len(rows) < batch.num_rows else batch, shown


def colour_filtered(images: DataFrame, name: str, brightness: float = 0.0, contrast: float = 0.0, key: str = "image_id") -> DataFrame:
    """(key, width, height, pixels) of colour images through a filter of ``colors.FILTERS``.

    ``pixels`` has width * height * 3 whole numbers 0 to 255, row by row, red, green
    and blue of a pixel together. Images of another size, or null ones, are left out.
    """
    kind = images.schema[key].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, whole = _whole(batch)
            shown = [colors.filtered(image, name, brightness, contrast).ravel() for image in whole]
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array([x.astype(np.int32) for x in shown], pa.list_(pa.int32()))], names=[key, "width", "height", "pixels"])

    return _held(images, key).mapInArrow(step, f"`{key}` {kind}, width int, height int, pixels array<int>")


def page_corners(images: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, corners) of colour images as ``colour_filtered`` takes them; corners are four (x, y), null where no page is seen."""
    kind = images.schema[key].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, whole = _whole(batch)
            held = pa.array([None if x is None else x.tolist() for x in pages.corners_of(whole)], pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([rows.column(0), held], names=[key, "corners"])

    return _held(images, key).mapInArrow(step, f"`{key}` {kind}, corners array<array<double>>")
