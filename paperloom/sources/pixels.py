"""Grey images as arrays: skew, rotation, noise, contrast, black and white. Decoding files is left to their libraries."""

from __future__ import annotations

import math

import numpy as np


def otsu(image: np.ndarray) -> int:
    """The grey value (inclusive) that parts dark from light with the largest between-class variance; 128 if there is none."""
    counts = np.bincount(image.astype(np.int64).ravel(), minlength=256)[:256].astype(float)
    below, total = np.cumsum(counts), counts.sum()
    sums = np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * (total - below) * (sums / below - (sums[-1] - sums) / (total - below)) ** 2
    between = np.nan_to_num(between, nan=0.0, posinf=0.0)
    return int(np.argmax(between)) if between.max() > 0 else 128


def skew_angle(dark: np.ndarray, most: int = 15, step: int = 4) -> int:
    """The whole angle in degrees under which rows of dark pixels stand out most; the first of equals, 0 for none."""
    h, w = dark.shape
    y, x = np.mgrid[0:h:step, 0:w:step]
    best, angle = 0.0, 0
    for degrees in range(-most, most + 1):
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        px = np.trunc(w / 2 + (x - w / 2) * c - (y - h / 2) * s).astype(int)
        py = np.trunc(h / 2 + (x - w / 2) * s + (y - h / 2) * c).astype(int)
        ok = (px >= 0) & (px < w) & (py >= 0) & (py < h)
        if ok.any():
            profile = np.bincount(py[ok], dark[py[ok], px[ok]].astype(float), h)
            if profile.var() > best:
                best, angle = profile.var(), degrees
    return angle


def rotated(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    h, w = image.shape
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    y, x = np.mgrid[0:h, 0:w]
    px = np.rint(w / 2 + (x - w / 2) * c - (y - h / 2) * s).astype(int)
    py = np.rint(h / 2 + (x - w / 2) * s + (y - h / 2) * c).astype(int)
    ok = (px >= 0) & (px < w) & (py >= 0) & (py < h)
    return np.where(ok, image[py.clip(0, h - 1), px.clip(0, w - 1)], fill).astype(image.dtype)


def deskewed(image: np.ndarray) -> np.ndarray:
    angle = skew_angle(image < image.mean())
    return rotated(image, angle) if abs(angle) >= 0.5 else image


def denoised(image: np.ndarray) -> np.ndarray:
    """The median of three by three pixels."""
    wide = np.pad(image, 1, mode="edge")
    return np.median(np.stack([wide[i : i + image.shape[0], j : j + image.shape[1]] for i in range(3) for j in range(3)]), axis=0).astype(image.dtype)


def equalised(image: np.ndarray) -> np.ndarray:
    """Histogram equalisation."""
    counts = np.cumsum(np.bincount(image.ravel(), minlength=256))
    first = counts[counts > 0][0]
    if counts[-1] == first:
        return image
    return np.rint((counts - first) * 255.0 / (counts[-1] - first)).clip(0, 255).astype(np.uint8)[image]


def binarised(image: np.ndarray) -> np.ndarray:
    return np.where(image > otsu(image), 255, 0).astype(np.uint8)


def prepared(image: np.ndarray) -> np.ndarray:
    """All steps; what fails leaves the image as it was."""
    for step in (deskewed, denoised, equalised, binarised):
        try:
            image = step(image)
        except Exception:
            return image
    return image
