"""Pixel operators: arrays of uint8 in, arrays of uint8 or numbers out."""

from __future__ import annotations

import numpy as np


def to_grayscale(a: np.ndarray) -> np.ndarray:
    """Two dimensions pass; one channel is squeezed; three or four become luminance."""
    if a.ndim == 2:
        return np.clip(a, 0, 255).astype(np.uint8)
    if a.ndim == 3 and a.shape[2] == 1:
        return np.clip(a[:, :, 0], 0, 255).astype(np.uint8)
    if a.ndim == 3 and a.shape[2] in (3, 4):
        return np.clip(np.rint(a[:, :, :3].astype(float) @ np.array([0.299, 0.587, 0.114])), 0, 255).astype(np.uint8)
    raise ValueError(f"no gray for shape {a.shape}")


def apply_orientation(a: np.ndarray, exif: int) -> np.ndarray:
    """Upright by the EXIF value 1 to 8; others are left alone."""
    mirrored = {2: lambda x: x[:, ::-1], 3: lambda x: x[::-1, ::-1], 4: lambda x: x[::-1], 5: lambda x: x.swapaxes(0, 1), 6: lambda x: np.rot90(x, 3), 7: lambda x: np.rot90(x, 2).swapaxes(0, 1), 8: lambda x: np.rot90(x, 1)}
    return np.ascontiguousarray(mirrored.get(exif, lambda x: x)(a))


def _padded(g: np.ndarray, r: int) -> np.ndarray:
    return np.pad(g.astype(float), r, mode="reflect" if min(g.shape) > r else "edge")


def _windows(g: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(_padded(g, k // 2), (k, k))


def gaussian_kernel(k: int, sigma: float) -> np.ndarray:
    x = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma * sigma))
    return x / x.sum()


def blur(g: np.ndarray, k: int, sigma: float) -> np.ndarray:
    w, r = gaussian_kernel(k, sigma), k // 2
    rows = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), 1, _padded(g, r))
    return np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), 0, rows)


def median(g: np.ndarray, k: int = 3) -> np.ndarray:
    k = max(3, k) + (max(3, k) % 2 == 0)
    return np.median(_windows(g, k), axis=(2, 3)).astype(np.uint8)


def non_local_means(g: np.ndarray, h: float = 10, patch: int = 7, search: int = 21) -> np.ndarray:
    """Weighted mean of the search window by patch distance, one offset at a time."""
    r, s, f = patch // 2, search // 2, g.astype(float)
    wide = np.pad(f, s, mode="reflect" if min(g.shape) > s else "edge")
    total, weight = np.zeros_like(f), np.zeros_like(f)
    for dy in range(-s, s + 1):
        for dx in range(-s, s + 1):
            moved = wide[s + dy : s + dy + f.shape[0], s + dx : s + dx + f.shape[1]]
            sums = np.pad((f - moved) ** 2, r, mode="edge").cumsum(0).cumsum(1)
            sums = np.pad(sums, ((1, 0), (1, 0)))
            near = (sums[patch:, patch:] - sums[:-patch, patch:] - sums[patch:, :-patch] + sums[:-patch, :-patch]) / patch**2
            w = np.exp(-near / (h * h))
            total += w * moved
            weight += w
    return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)


def unsharp(g: np.ndarray, amount: float = 1.0, sigma: float = 1.0) -> np.ndarray:
    return np.clip(np.rint(g + amount * (g - blur(g, 7, sigma))), 0, 255).astype(np.uint8)


def gamma(a: np.ndarray, value: float) -> np.ndarray:
    if value <= 0:
        raise ValueError("gamma must be above zero")
    return a.copy() if value == 1 else np.clip(np.rint(255 * (np.arange(256) / 255) ** (1 / value)), 0, 255).astype(np.uint8)[a]


def estimate_gamma(g: np.ndarray, target: float = 150) -> float:
    mean = float(g.mean())
    return 1.0 if mean <= 0 or mean >= 255 else float(np.clip(np.log(mean / 255) / np.log(target / 255), 0.2, 5))


def clahe(g: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Equalise each tile's clipped histogram and blend the four nearest tiles' mappings."""
    h, w = g.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            tile = g[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            counts = np.bincount(tile.ravel(), minlength=256).astype(float)
            most = max(1.0, clip * max(1, tile.size) / 256)
            extra = np.maximum(counts - most, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(counts, most) + extra / 256) * 255 / max(1, tile.size)
    fy, fx = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = np.minimum(fy.astype(int), tiles - 2 if tiles > 1 else 0), np.minimum(fx.astype(int), tiles - 2 if tiles > 1 else 0)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None]
    at = lambda dy, dx: maps[np.minimum(y0 + dy, tiles - 1)[:, None], np.minimum(x0 + dx, tiles - 1)[None], g]
    out = (1 - wy) * ((1 - wx) * at(0, 0) + wx * at(0, 1)) + wy * ((1 - wx) * at(1, 0) + wx * at(1, 1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def otsu(g: np.ndarray) -> int:
    """The level that parts the histogram with the greatest variance between its sides."""
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / below[-1] - mass) ** 2 / (below * above)
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def global_threshold(g: np.ndarray) -> np.ndarray:
    return np.where(g > otsu(g), 255, 0).astype(np.uint8)


def adaptive_threshold(g: np.ndarray, block: int = 25, c: float = 10) -> np.ndarray:
    block = max(3, block) + (max(3, block) % 2 == 0)
    return np.where(g > blur(g, block, 0.3 * ((block - 1) * 0.5 - 1) + 0.8) - c, 255, 0).astype(np.uint8)


def quality(a: np.ndarray) -> dict:
    """Sharpness (variance of the Laplacian), contrast and brightness, with their flags."""
    g = to_grayscale(a).astype(float)
    p = np.pad(g, 1, mode="reflect" if min(g.shape) > 1 else "edge")
    sharp = float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())
    flags = {"is_blurry": sharp < 100, "is_low_contrast": float(g.std()) < 40, "is_poorly_lit": not 60 <= float(g.mean()) <= 225}
    return {"blur": sharp, "contrast": float(g.std()), "brightness": float(g.mean()), **flags, "needs_accurate_mode": any(flags.values())}


def _hull(p: np.ndarray) -> np.ndarray:
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def skew_angle(a: np.ndarray) -> float:
    """Degrees by which the smallest rectangle around the ink is turned; 0 if there is little ink or the angle is over 30."""
    g = to_grayscale(a)
    ys, xs = np.nonzero(g <= otsu(g)) if g.min() < g.max() else ([], [])
    if len(ys) < 10:
        return 0.0
    hull = _hull(np.column_stack([xs, ys]).astype(float))
    if len(hull) < 3:
        return 0.0
    edges = np.roll(hull, -1, 0) - hull
    angles = np.arctan2(edges[:, 1], edges[:, 0])
    turned = lambda t: hull @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    area = lambda q: np.prod(q.max(0) - q.min(0))
    best = np.degrees(min(angles, key=lambda t: area(turned(t))))
    best = (best + 45) % 90 - 45
    return 0.0 if abs(best) > 30 else float(best)


def _sample(a: np.ndarray, x: np.ndarray, y: np.ndarray, fill: float = 255) -> np.ndarray:
    """Bilinear values at fractional places; fill outside."""
    h, w = a.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0

    def at(i, j):
        inside = (i >= 0) & (i < h) & (j >= 0) & (j < w)
        v = a[np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)].astype(float)
        return np.where(inside[..., None] if a.ndim == 3 else inside, v, fill)

    if a.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    out = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def rotate(a: np.ndarray, degrees: float) -> np.ndarray:
    """Counter-clockwise, on a canvas grown to hold all, white outside."""
    t, (h, w) = np.radians(degrees), a.shape[:2]
    c, s = np.cos(t), np.sin(t)
    nh, nw = int(np.ceil(abs(h * c) + abs(w * s) - 1e-9)), int(np.ceil(abs(w * c) + abs(h * s) - 1e-9))
    y, x = np.mgrid[:nh, :nw].astype(float)
    x, y = x - (nw - 1) / 2, y - (nh - 1) / 2
    return _sample(a, c * x - s * y + (w - 1) / 2, s * x + c * y + (h - 1) / 2)


def deskew(a: np.ndarray) -> tuple[np.ndarray, float]:
    angle = skew_angle(a)
    return (rotate(a, angle), angle) if abs(angle) > 0.1 else (a, angle)


def order_corners(p: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left, whatever the order given."""
    s, d = p.sum(1), p[:, 1] - p[:, 0]
    return np.array([p[s.argmin()], p[d.argmin()], p[s.argmax()], p[d.argmax()]], float)


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    rows, b = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        b += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(b, float)), 1).reshape(3, 3)


def warp(a: np.ndarray, back: np.ndarray, h: int, w: int) -> np.ndarray:
    """The h by w image whose pixels come from where back maps them."""
    y, x = np.mgrid[:h, :w].astype(float)
    q = np.stack([x, y, np.ones_like(x)], -1) @ back.T
    return _sample(a, q[..., 0] / q[..., 2], q[..., 1] / q[..., 2])


def document_corners(a: np.ndarray) -> np.ndarray | None:
    """Corners of a bright sheet on a darker ground that covers at least a fifth of the picture, or None.

    The sheet must be a quadrilateral: nearly all that is bright lies between its four extremes.
    """
    g = to_grayscale(a)
    level = otsu(g)
    dark, light = g[g <= level], g[g > level]
    if not len(dark) or not len(light) or light.mean() - dark.mean() < 50:
        return None
    edge = np.concatenate([g[0], g[-1], g[:, 0], g[:, -1]])
    ys, xs = np.nonzero(median(np.where(g > level, 255, 0).astype(np.uint8)) > 0)
    if (edge > level).mean() > 0.5 or len(ys) < 0.2 * g.size:
        return None
    p = np.column_stack([xs, ys]).astype(float)
    corners = order_corners(np.array([p[p.sum(1).argmin()], p[p.sum(1).argmax()], p[(p[:, 1] - p[:, 0]).argmin()], p[(p[:, 1] - p[:, 0]).argmax()]]))
    inside = np.ones(len(p), bool)
    for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        along = b - a
        if not (reach := np.hypot(*along)):
            return None
        inside &= (along[0] * (p[:, 1] - a[1]) - along[1] * (p[:, 0] - a[0])) / reach >= -2  # two pixels of play
    return corners if inside.mean() > 0.97 else None


def correct_perspective(a: np.ndarray, corners: np.ndarray) -> np.ndarray:
    tl, tr, br, bl = order_corners(np.asarray(corners, float))
    side = lambda p, q: float(np.hypot(*(p - q)))
    w, h = max(1, round(max(side(tl, tr), side(bl, br)))), max(1, round(max(side(tl, bl), side(tr, br))))
    return warp(a, homography(np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]]), np.array([tl, tr, br, bl])), h, w)


def preprocess(a: np.ndarray, mode: str = "auto", exif: int = 1) -> tuple[np.ndarray, dict]:
    """Upright, flat, straight, judged, then cleaned as the mode says; what was done is in ``steps``."""
    steps = []
    if exif in range(2, 9):
        a, steps = apply_orientation(a, exif), [*steps, "exif_orientation"]
    if (corners := document_corners(a)) is not None:
        a, steps = correct_perspective(a, corners), [*steps, "perspective_correction"]
    a, angle = deskew(a)
    if abs(angle) > 0.1:
        steps.append("deskew")
    q = quality(a)
    accurate = mode == "accurate" or (mode == "auto" and q["needs_accurate_mode"])
    g = to_grayscale(a)
    steps.append("grayscale")
    if not accurate:
        return median(g), {**q, "mode": "fast", "angle": angle, "steps": [*steps, "denoise_fast"]}
    if q["is_poorly_lit"]:
        g, steps = gamma(g, estimate_gamma(g)), [*steps, "auto_gamma"]
    if q["is_low_contrast"]:
        g, steps = clahe(g), [*steps, "clahe"]
    if q["is_blurry"]:
        g, steps = unsharp(non_local_means(g), 1.5), [*steps, "denoise_accurate", "sharpen"]
    else:
        g, steps = median(g), [*steps, "denoise_fast"]
    return g, {**q, "mode": "accurate", "angle": angle, "steps": steps}
