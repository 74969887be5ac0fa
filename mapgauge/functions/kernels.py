"""Numpy kernels on stacks of maps (n, height, width), for neighbourhood and spectral metrics."""

from __future__ import annotations

import numpy as np

LUMA = (0.299, 0.587, 0.114)


def _shift(a: np.ndarray, di: int, dj: int, r: int) -> np.ndarray:
    h, w = a.shape[1] - 2 * r, a.shape[2] - 2 * r
    return a[:, r + di : r + di + h, r + dj : r + dj + w]


def _padded(a: np.ndarray, r: int, mode: str) -> np.ndarray:
    return np.pad(a, ((0, 0), (r, r), (r, r)), mode=mode)


def separable(a: np.ndarray, rows, cols, mode: str = "symmetric") -> np.ndarray:
    """Correlation with an outer product of two odd kernels."""
    r = len(rows) // 2
    p = np.pad(a, ((0, 0), (r, r), (0, 0)), mode=mode)
    v = sum(k * p[:, d : d + a.shape[1]] for d, k in enumerate(rows) if k)
    s = len(cols) // 2
    p = np.pad(v, ((0, 0), (0, 0), (s, s)), mode=mode)
    return sum(k * p[:, :, d : d + a.shape[2]] for d, k in enumerate(cols) if k)


def gradients(a: np.ndarray, side: tuple = (1, 2, 1), mode: str = "symmetric") -> tuple[np.ndarray, np.ndarray]:
    """Derivatives across (j) and down (i)."""
    return separable(a, side, (-1, 0, 1), mode), separable(a, (-1, 0, 1), side, mode)


def gaussian(a: np.ndarray, radius: int = 5, sigma: float = 11 / 6) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    return separable(a, k, k)


def dilate(a: np.ndarray, r: int = 1) -> np.ndarray:
    p = _padded(a, r, "constant")
    return np.any([_shift(p, i, j, r) for i in range(-r, r + 1) for j in range(-r, r + 1)], axis=0)


def erode(a: np.ndarray, r: int = 1) -> np.ndarray:
    p = _padded(a, r, "constant")
    return np.all([_shift(p, i, j, r) for i in range(-r, r + 1) for j in range(-r, r + 1)], axis=0)


def valid_pair(gt: np.ndarray, pred: np.ndarray) -> np.ndarray:
    return (gt > 0) & (pred > 0) & np.isfinite(gt) & np.isfinite(pred)


def ssim_map(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    c1, c2 = 0.01**2, 0.03**2
    mx, my = gaussian(x), gaussian(y)
    vx, vy, vxy = gaussian(x * x) - mx * mx, gaussian(y * y) - my * my, gaussian(x * y) - mx * my
    return (2 * mx * my + c1) * (2 * vxy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))


def depth_ssim(gt: np.ndarray, pred: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """SSIM of depth after a joint min-max scaling over valid pixels; 0 without any, 1 for a range below 1e-8."""
    flat = lambda f, a, b, fill: f(np.where(ok, f(np.stack([a, b]), axis=0), fill).reshape(len(gt), -1), axis=1)
    lo, hi = flat(np.min, gt, pred, np.inf), flat(np.max, gt, pred, -np.inf)
    some, span = ok.reshape(len(gt), -1).any(axis=1), hi - lo
    scale = np.where(some & (span >= 1e-8), span, 1.0)[:, None, None]
    base = np.where(some, lo, 0.0)[:, None, None]
    x, y = np.where(ok, (pred - base) / scale, 0.0), np.where(ok, (gt - base) / scale, 0.0)
    weight = gaussian(ok.astype(float)) > 0.5
    n = weight.reshape(len(gt), -1).sum(axis=1)
    out = np.where(weight, ssim_map(x, y), 0.0).reshape(len(gt), -1).sum(axis=1) / np.maximum(n, 1)
    out = np.where(n > 0, out, 0.0)
    return np.where(~some, 0.0, np.where(span < 1e-8, 1.0, out))


def depth_edges(z: np.ndarray, ok: np.ndarray, threshold: float = 0.1, method: str = "relative") -> np.ndarray:
    """Edge pixels. Central differences see zeros beyond the border, so borders of positive depth are edges."""
    if method == "sobel":
        across, down = gradients(z)
        return (np.hypot(across, down) > threshold) & ok
    p = _padded(z, 1, "constant")
    jump = np.maximum(abs(_shift(p, 0, 1, 1) - _shift(p, 0, -1, 1)), abs(_shift(p, 1, 0, 1) - _shift(p, -1, 0, 1)))
    return (jump > (threshold * z if method == "relative" else threshold)) & ok


def luma(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def rgb_edges(y: np.ndarray, threshold: float = 0.1, method: str = "sobel") -> np.ndarray:
    """Sobel magnitude above the threshold; canny_approx thins it in four direction sectors and leaves the border out."""
    across, down = gradients(y)
    size = np.hypot(across, down)
    strong = size > threshold
    if method != "canny_approx":
        return strong
    angle = np.mod(np.degrees(np.arctan2(down, across)), 180)
    p = _padded(size, 1, "constant")
    sector = np.select([(angle < 22.5) | (angle >= 157.5), angle < 67.5, angle < 112.5], [0, 1, 2], 3)
    steps = [((0, 1), (0, -1)), ((-1, 1), (1, -1)), ((1, 0), (-1, 0)), ((-1, -1), (1, 1))]
    peak = np.zeros(y.shape, bool)
    for s, (a, b) in enumerate(steps):
        peak |= (sector == s) & (size >= _shift(p, *a, 1)) & (size >= _shift(p, *b, 1))
    peak[:, [0, -1]] = False
    peak[:, :, [0, -1]] = False
    return strong & peak


def edge_scores(gt: np.ndarray, pred: np.ndarray, tolerance: int = 1) -> dict[str, np.ndarray]:
    """Counts, precision, recall and F1 of edges within a tolerance; 0 where there is nothing to divide by."""
    n = lambda a: a.reshape(len(a), -1).sum(axis=1)
    ng, np_ = n(gt), n(pred)
    p = np.where(np_ > 0, n(pred & dilate(gt, tolerance)) / np.maximum(np_, 1), 0.0)
    r = np.where(ng > 0, n(gt & dilate(pred, tolerance)) / np.maximum(ng, 1), 0.0)
    f = np.where(p + r > 0, 2 * p * r / np.where(p + r > 0, p + r, 1), 0.0)
    return {"gt_edges": ng, "pred_edges": np_, "precision": p, "recall": r, "f1": f}


def normals(z: np.ndarray) -> np.ndarray:
    """Unit normals (n, h, w, 3) from Sobel / 8 with zero padding."""
    across, down = gradients(z, mode="constant")
    v = np.stack([-across / 8, -down / 8, np.ones(z.shape)], axis=-1)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def normal_angles(gt: np.ndarray, pred: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles in degrees, and where they count: the mask eroded once, so never on the border."""
    dot = (normals(np.where(ok, gt, 0.0)) * normals(np.where(ok, pred, 0.0))).sum(axis=-1)
    return np.degrees(np.arccos(np.clip(dot, -1, 1))), erode(ok)


def chroma_error(gt: list[np.ndarray], pred: list[np.ndarray], kernel: str = "scharr", eps: float = 1e-6) -> np.ndarray:
    """Structure-weighted chromaticity error: chroma differences weighted by the mean gradient magnitude of both lumas."""
    tg, tp = sum(gt) + eps, sum(pred) + eps
    e = sum(abs(a / tg - b / tp) for a, b in zip(gt, pred, strict=True)) / 3
    side, over = ((3, 10, 3), 16) if kernel == "scharr" else ((1, 2, 1), 8)
    mag = lambda y: np.hypot(*[g / over for g in gradients(y, side)])
    w = (mag(luma(*gt)) + mag(luma(*pred))) / 2
    mean = lambda a: a.reshape(len(a), -1).mean(axis=1)
    return np.where(mean(w) < eps, 0.0, mean(w * e) / (mean(w) + eps))


def _radius(h: int, w: int) -> np.ndarray:
    ci, cj = h // 2, w // 2
    i, j = np.mgrid[:h, :w]
    return np.sqrt((i - ci) ** 2 + (j - cj) ** 2) / np.sqrt(ci * ci + cj * cj)


def _power(y: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.fftshift(np.fft.fft2(y), axes=(1, 2))) ** 2


def high_frequency_share(y: np.ndarray, cut: float = 0.75) -> np.ndarray:
    """Share of spectral energy beyond a normalised radius; 0 for total energy below 1e-10."""
    e = _power(y)
    total = e.sum(axis=(1, 2))
    return np.where(total < 1e-10, 0.0, e[:, _radius(*y.shape[1:]) > cut].sum(axis=1) / np.where(total < 1e-10, 1, total))


def band_similarity(gt: np.ndarray, pred: np.ndarray, bands: int = 4) -> np.ndarray:
    """(n, bands): 1 - min(|ratio - 1|, 1) of the energy in equal radial bands [lo, hi)."""
    r, p, g = _radius(*gt.shape[1:]), _power(pred), _power(gt)
    out = []
    for k in range(bands):
        at = (r >= k / bands) & (r < (k + 1) / bands)
        a, b = p[:, at].sum(axis=1), g[:, at].sum(axis=1)
        ratio = np.where(b < 1e-10, np.where(a < 1e-10, 1.0, 2.0), a / np.where(b < 1e-10, 1, b))
        out.append(1 - np.minimum(abs(ratio - 1), 1))
    return np.stack(out, axis=1)
