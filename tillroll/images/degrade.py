"""Seeded degradations of gray pictures, by name; the same seed gives the same pixels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tillroll.images.pixels import _sample, blur, homography, rotate, warp


def _clip(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def rotation(a, r):
    return rotate(a, r.uniform(-8, 8))


def gaussian_blur(a, r):
    radius = r.uniform(1, 2.5)
    return _clip(blur(a, max(3, 2 * int(radius) + 1), radius))


def motion_blur(a, r):
    k, t = int(r.choice([5, 7, 9])), np.radians(r.uniform(0, 180))
    y, x = np.mgrid[: a.shape[0], : a.shape[1]].astype(float)
    return _clip(np.mean([_sample(a, x + d * np.cos(t), y + d * np.sin(t)).astype(float) for d in range(-(k // 2), k // 2 + 1)], axis=0))


def gaussian_noise(a, r):
    return _clip(a + r.normal(0, 18, a.shape))


def salt_pepper_noise(a, r):
    hit = r.random(a.shape)
    return np.where(hit < 0.01, 0, np.where(hit > 0.99, 255, a)).astype(np.uint8)


def jpeg_compression(a, r):
    """Blocks of 8 by 8 through a cosine transform whose terms are rounded coarsely, as at quality 25."""
    h, w = a.shape
    p = np.pad(a.astype(float) - 128, ((0, -h % 8), (0, -w % 8)), mode="edge")
    k = np.arange(8)
    c = np.sqrt(2 / 8) * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
    c[0] /= np.sqrt(2)
    blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2)
    step = 2 * (8 + 6.0 * (k[:, None] + k[None]))
    done = c.T @ (np.rint((c @ blocks @ c.T) / step) * step) @ c
    return _clip(done.swapaxes(1, 2).reshape(p.shape)[:h, :w] + 128)


def brightness_contrast(a, r):
    b, c = r.uniform(-60, 40), r.uniform(0.5, 1.3)
    return _clip((a.astype(float) - 128) * c + 128 + b)


def shadow(a, r):
    """A soft band, darkest in its middle, where 55 % of the brightness is gone."""
    w = a.shape[1]
    start, width = int(r.uniform(0, 0.6 * w)), max(1, int(r.uniform(0.2 * w, 0.5 * w)))
    away = np.abs(np.arange(w) - start - width / 2) / (width / 2)
    return _clip(a * (1 - 0.55 * np.maximum(0, 1 - away)))


def perspective_warp(a, r):
    """Corners move by up to 8 % of the shorter side."""
    h, w = a.shape
    corners = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    most = 0.08 * min(h, w)
    return warp(a, homography(corners, corners + r.uniform(-most, most, (4, 2))), h, w)


def crop(a, r):
    h, w = a.shape
    t, b, l, s = r.uniform(0, 0.12, 4)
    return a[int(t * h) : h - int(b * h), int(l * w) : w - int(s * w)].copy()


def low_contrast_fade(a, r):
    return _clip(128 + (a.astype(float) - 128) * r.uniform(0.15, 0.4))


def wrinkle_warp(a, r):
    """Both axes are displaced by waves of 4 pixels along the other one."""
    y, x = np.mgrid[: a.shape[0], : a.shape[1]].astype(float)
    across, down = r.uniform(0, 2 * np.pi, 2)
    wave = lambda t, phase: 4 * np.sin(2 * np.pi * t / 40 + phase)
    return _sample(a, x + wave(y, across), y + wave(x, down))


def thermal_streak(a, r):
    """Three bands across the picture, up to 3 % of its height, faded to 30 to 80 % of their ink."""
    h, out = a.shape[0], a.astype(float)
    for _ in range(3):
        top, high, left = int(r.uniform(0, h)), int(r.uniform(2, max(3, 0.03 * h))), r.uniform(0.3, 0.8)
        out[top : top + high] = 255 - (255 - out[top : top + high]) * left
    return _clip(out)


DEGRADATIONS: dict[str, Callable] = {"clean": lambda a, r: a.copy(), **{f.__name__: f for f in (rotation, gaussian_blur, motion_blur, gaussian_noise, salt_pepper_noise, jpeg_compression, brightness_contrast, shadow, perspective_warp, crop, low_contrast_fade, wrinkle_warp, thermal_streak)}}


def degrade(a: np.ndarray, name: str, seed: int) -> np.ndarray:
    return DEGRADATIONS[name](a, np.random.default_rng(seed))
