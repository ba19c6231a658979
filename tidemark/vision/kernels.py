"""Kernels on one frame or mask as a numpy array; all work is vectorised over pixels."""

from __future__ import annotations

import numpy as np

#: Sum of channel steps that make an edge; channel bounds of dark and white.
EDGE, DARK, WHITE, HUD_WHITE = 150, 42, 190, 185


def picture(raw: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(height, width, 3).astype(np.int16)


def edges(rgb: np.ndarray) -> np.ndarray:
    """Pixels that differ much from the one to their left."""
    out = np.zeros(rgb.shape[:2], bool)
    out[:, 1:] = np.abs(np.diff(rgb, axis=1)).sum(axis=2) > EDGE
    return out


def frame_features(raw: bytes, previous: bytes | None, width: int, height: int) -> dict[str, float]:
    """Brightness, saturation, change and the shares of white, dark and edges in the regions that segmentation reads."""
    rgb = picture(raw, width, height)
    top, low = rgb.max(axis=2), rgb.min(axis=2)
    edge = edges(rgb)
    y, x = np.mgrid[:height, :width]
    hud = (y < np.floor(height * 0.17 + 0.5)) & (x > width * 0.35) & (x < width * 0.65)
    centre = (y > height * 0.2) & (y < height * 0.76) & (x > width * 0.24) & (x < width * 0.76)
    share = lambda mask, where: float((mask & where).sum() / max(1, where.sum()))
    return {
        "brightness": float(rgb.mean()),
        "saturation": float(np.where(top > 0, (top - low) / np.maximum(top, 1), 0.0).mean()),
        "difference": float(np.abs(rgb - picture(previous, width, height)).mean()) if previous is not None else 0.0,
        "edge_ratio": float(edge.mean()),
        "hud_white_ratio": share(low > HUD_WHITE, hud),
        "hud_edge_ratio": share(edge, hud),
        "center_dark_ratio": share(top < DARK, centre),
        "center_white_ratio": share(low > WHITE, centre),
        "center_edge_ratio": share(edge, centre),
    }


def components(mask: np.ndarray, eight: bool = False) -> list[dict[str, int]]:
    """Connected areas of a mask: box, area. Labels spread to their smallest neighbour until none changes."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    far = h * w + 2
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    while True:
        wide = np.pad(np.where(label > 0, label, far), 1, constant_values=far)
        least = np.min([wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in [(0, 0), *steps]], axis=0)
        new = np.where(mask, least, 0)
        flat = new.ravel()
        root = np.concatenate([[0], flat])  # jump to the label of the label
        new = np.where(mask, root[new], 0)
        if (new == label).all():
            break
        label = new
    out = []
    for k in np.unique(label[label > 0]):
        ys, xs = np.nonzero(label == k)
        out.append({"x": int(xs.min()), "y": int(ys.min()), "width": int(np.ptp(xs)) + 1, "height": int(np.ptp(ys)) + 1, "area": len(xs)})
    return out


def holes(mask: np.ndarray) -> int:
    """Areas of background that the border doesn't reach."""
    return len(components(~np.pad(mask, 1), eight=False)) - 1


def otsu(gray: np.ndarray) -> int:
    """The threshold with the greatest variance between what is under or at it and what is over."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    under = np.cumsum(n)
    total, level = under[-1], np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (level[-1] * under / total - level) ** 2 / (under * (total - under))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def projection_runs(mask: np.ndarray, axis: int, least: int = 1) -> list[tuple[int, int]]:
    """Stretches of rows (axis 1) or columns (axis 0) with at least ``least`` set pixels, end exclusive."""
    on = np.concatenate([[0], (mask.sum(axis=axis) >= least).astype(int), [0]])
    step = np.diff(on)
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def normalized_glyph(mask: np.ndarray, width: int = 16, height: int = 28) -> np.ndarray:
    """The set part of a mask, stretched to a fixed size by nearest pixels."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return np.zeros((height, width), bool)
    box = mask[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    return box[(np.arange(height) * box.shape[0] // height)[:, None], np.arange(width) * box.shape[1] // width]


def glyph_distance(a: np.ndarray, b: np.ndarray, aspect_a: float, aspect_b: float) -> float:
    """Share of differing pixels, plus weighted differences of aspect and density."""
    return float((a != b).mean() + 0.18 * abs(aspect_a - aspect_b) + 0.12 * abs(a.mean() - b.mean()))


def nearest_glyphs(mask: np.ndarray, templates: list[tuple[str, np.ndarray, float]], k: int = 3) -> list[tuple[str, float]]:
    """The k labels with the closest template, best of each label."""
    glyph = normalized_glyph(mask)
    ys, xs = np.nonzero(mask)
    aspect = (np.ptp(xs) + 1) / (np.ptp(ys) + 1) if len(ys) else 0.0
    best: dict[str, float] = {}
    for label, template, other in templates:
        best[label] = min(best.get(label, np.inf), glyph_distance(glyph, template, aspect, other))
    return sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]


def shifted_correlation(image: np.ndarray, template: np.ndarray, reach: int) -> tuple[float, int, int]:
    """The best normalised correlation of a template with equally large parts of an image, and its shift."""
    h, w = template.shape
    t = template - template.mean()
    best = (-1.0, 0, 0)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            part = np.zeros((h, w))
            ys, xs = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
            part[ys.start - dy : ys.stop - dy, xs.start - dx : xs.stop - dx] = image[ys, xs]
            p = part - part.mean()
            norm = np.sqrt((p**2).sum() * (t**2).sum())
            best = max(best, (float((p * t).sum() / norm) if norm else 0.0, dy, dx))
    return best


def hue_histogram(rgb: np.ndarray, bins: int = 24) -> np.ndarray:
    """Hues weighted by saturation, of sum 1 (all 0 for grey)."""
    r, g, b = (rgb[..., k].astype(float) for k in range(3))
    top, low = rgb.max(axis=2).astype(float), rgb.min(axis=2).astype(float)
    span = np.where(top > low, top - low, 1.0)
    hue = np.select([top == r, top == g], [((g - b) / span) % 6, (b - r) / span + 2], (r - g) / span + 4) * 60
    weight = np.where(top > low, (top - low) / np.maximum(top, 1), 0.0)
    n = np.bincount((hue // (360 / bins)).astype(int).ravel() % bins, weights=weight.ravel(), minlength=bins)
    return n / n.sum() if n.sum() else n


def hue_peak(histogram: np.ndarray) -> tuple[float, float]:
    """Degrees of the strongest bin with its neighbours (the circle closes), as their circular mean, and their share."""
    bins = len(histogram)
    wide = histogram + np.roll(histogram, 1) + np.roll(histogram, -1)
    k = int(wide.argmax())
    near = [(k - 1) % bins, k, (k + 1) % bins]
    angle = (np.array(near) + 0.5) * 2 * np.pi / bins
    mean = np.arctan2((np.sin(angle) * histogram[near]).sum(), (np.cos(angle) * histogram[near]).sum())
    return float(np.degrees(mean) % 360), float(wide[k])


def colour_motion(now: np.ndarray, before: np.ndarray, hue: float, reach: float = 25.0, least_area: int = 12, most: int = 4) -> list[dict[str, int]]:
    """Moved areas of about a hue, largest first."""
    top, low = now.max(axis=2), now.min(axis=2)
    span = np.where(top > low, top - low, 1).astype(float)
    r, g, b = (now[..., k].astype(float) for k in range(3))
    h = np.select([top == r, top == g], [((g - b) / span) % 6, (b - r) / span + 2], (r - g) / span + 4) * 60
    near = np.abs((h - hue + 180) % 360 - 180) <= reach
    moved = np.abs(now - before).sum(axis=2) > 60
    areas = [c for c in components(near & moved & (top - low > 60), eight=True) if c["area"] >= least_area]
    return sorted(areas, key=lambda c: (-c["area"], c["y"], c["x"]))[:most]
