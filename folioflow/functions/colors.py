"""Filters of scanned colour pages; an image is an array (height, width, 3) of whole numbers 0 to 255."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from folioflow.functions import raster, scan

# Weights of a colour's lightness, in doubles and in 256ths.
LIGHT, LIGHT_256 = (0.299, 0.587, 0.114), (77, 150, 29)
#: Longest side of the copy that the paper is estimated on.
PAPER_SIDE = 200
#: Local paper counts fully from the first share of the lighting on, and not at all under the second.
TRUSTED, DOUBTED = 0.85, 0.7
#: Below this, paper is too dark to divide by.
DARK = 8
#: Lightness that automatic colour brings paper to, and within which bounds; the share of the paper that is brightest; bounds of a channel's balance.
PAPER, GAIN, BRIGHT, BALANCE = 242, (0.85, 3.0), 0.8, (0.6, 1.6)
#: Whiteboards: lightness that is white, gain of saturation, exponent that darkens ink.
BOARD_WHITE, BOARD_SATURATION, BOARD_GAMMA = 232.0, 1.5, 1.3
#: Photos: how much of the S-curve is mixed in, and the most that grey pixels gain in colour.
CURVE, VIBRANCE = 0.35, 0.4
#: Black and white: ink at most this dark is ink, paper from this on is paper, whatever is around.
SURE_INK, SURE_PAPER = 140, 235


def whole(values: np.ndarray) -> np.ndarray:
    """the nearest whole number from 0 to 255."""
    return np.floor(np.clip(values, 0, 255) + 0.5).astype(np.uint8)


def luma(image: np.ndarray) -> np.ndarray:
    """lightness in whole numbers."""
    return ((image.astype(np.int64) @ np.array(LIGHT_256) + 128) >> 8).astype(np.uint8)


def level_at(plane: np.ndarray, share: float) -> int:
    """The first value at which the counts add up to ``share`` of all."""
    counts = np.cumsum(np.bincount(plane.ravel(), minlength=256))
    return int(np.searchsorted(counts, share * counts[-1]))


def adjusted(brightness: float, contrast: float) -> np.ndarray:
    """a table of 256 values for brightness and contrast, each -1 to 1; 0 and 0 change nothing."""
    b, c = np.clip([brightness, contrast], -1, 1)
    factor = 1 + c * (2 if c > 0 else 1)
    return whole((np.arange(256) - 127.5) * factor + 127.5 + 110 * b)


def paper(plane: np.ndarray) -> np.ndarray:
    """What one channel would be without ink: the local paper where it agrees with the lighting, else the lighting.

    Large dark areas so keep their colour.
    """
    h, w = plane.shape
    shrunk = min(1.0, PAPER_SIDE / max(h, w))
    sw, sh = (max(1, int(side * shrunk + 0.5)) for side in (w, h))
    small = whole(scan.resized(plane.astype(float), sw, sh))
    local = raster.box_blur(raster.rank_filter(raster.rank_filter(small, 3, True), 2, False), 3).astype(float)
    light = scan.lighting(local)
    trust = np.clip((local / light - DOUBTED) / (TRUSTED - DOUBTED), 0, 1)
    found = whole(raster.box_blur(trust * local + (1 - trust) * light, 2)).astype(float)
    if (sw, sh) == (w, h):
        return found
    x, y = ((np.arange(n) + 0.5) * m / n - 0.5 for n, m in ((w, sw), (h, sh)))
    return whole(scan.sampled(found, *np.meshgrid(x, y))).astype(float)


def papers(image: np.ndarray) -> np.ndarray:
    return np.stack([paper(image[..., n]) for n in range(3)], -1)


def lit(values: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Values as shares of their paper, 255 for paper itself; too dark a paper is left out of account."""
    return np.where(background < DARK, values, values * 255.0 / np.maximum(background, 1))


def saturated(image: np.ndarray, gain: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Lightness and the image with each pixel's distance from grey multiplied."""
    light = (image @ np.array(LIGHT))[..., None]
    return light, light + (image - light) * gain


def original(image: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[image]


def grayscale(image: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Lightness, stretched between its first and last hundredth."""
    light = luma(image)
    shown = table[scan.stretched(level_at(light, 0.01), level_at(light, 0.99))][light]
    return np.repeat(shown[..., None], 3, -1)


def black_white(image: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Ink and paper by a local threshold after shadows are divided out; single dark pixels go."""
    light = luma(image).astype(float)
    background = paper(light)
    even = np.where(background < DARK, 255.0, np.minimum(lit(light, background), 255))
    even = table[whole((even + raster.box_blur(even, 1)) / 2)]
    ink = scan.sauvola(even, max(7, min(even.shape) // 50), closed=True) | (even <= SURE_INK)
    shown = np.where(ink & (even < SURE_PAPER), 0, 255).astype(np.uint8)
    return np.repeat(raster.without_specks(shown)[..., None], 3, -1)


def whiteboard(image: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each channel over its own paper, so that it turns white; ink darker and richer in colour."""
    even = lit(image.astype(float), papers(image)) * (255 / BOARD_WHITE)
    light, rich = saturated(even, BOARD_SATURATION)
    darker = np.where(light < 255, 255 * (np.minimum(light, 255) / 255) ** BOARD_GAMMA, 255)
    return table[whole(rich * np.where(light > 1, darker / np.maximum(light, 1), 1))]


def auto_color(image: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Paper to one lightness and without a cast, then more contrast and sharper edges."""
    background = papers(image)
    light = luma(background)
    sample = background.reshape(-1, 3)[::7][light.ravel()[::7] >= level_at(light, BRIGHT)]
    means = sample.mean(0) if len(sample) else np.zeros(3)
    balance = np.clip(means @ np.array(LIGHT) / means, *BALANCE) if means.all() else np.ones(3)
    gain = np.where(light < DARK, 1.0, np.clip(PAPER / np.maximum(light, 1), *GAIN))
    even = whole(image * balance * gain[..., None])
    shades = luma(even)
    high = min(level_at(shades, 0.99), PAPER)
    even = scan.stretched(min(level_at(shades, 0.01), high - 102), high)[even].astype(float)
    blurred = np.stack([raster.box_blur(even[..., n], 1) for n in range(3)], -1)
    return table[whole(even + 0.6 * (even - blurred))]


def photo(image: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A gentle S-curve; dull pixels gain more colour than rich ones."""
    x = np.arange(256) / 255
    curve = whole(255 * (x + CURVE * (x * x * (3 - 2 * x) - x)))
    high, low = (image.astype(float).max(-1, keepdims=True), image.astype(float).min(-1, keepdims=True))
    _, rich = saturated(image.astype(float), 1 + VIBRANCE * (1 - (high - low) / np.maximum(high, 1)))
    return table[curve][whole(rich)]


#: Filters by name; a name that isn't here leaves the image as it is.
FILTERS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "original": original, "autoColor": auto_color, "grayscale": grayscale, "blackWhite": black_white, "whiteboard": whiteboard, "photo": photo,
}


def filtered(image: np.ndarray, name: str, brightness: float = 0.0, contrast: float = 0.0) -> np.ndarray:
    """an image through a filter, then brightness and contrast; black and white takes these before its threshold."""
    return FILTERS.get(name, original)(image, adjusted(brightness, contrast)) if image.size else image
