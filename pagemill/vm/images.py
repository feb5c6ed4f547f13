"""Samples of images, and their reduction."""

from __future__ import annotations

import math

import numpy as np

from .graphics import components

# Default resolutions, and the range in which a resolution is taken.
DEFAULTS = {"Color": 300, "Gray": 300, "Mono": 1200}
LEAST, MOST = 9, 2400


def samples(data: bytes, width: int, height: int, n: int, bits: int) -> np.ndarray | None:
    """(rows, width, n) of the whole rows that there are; rows begin at bytes."""
    row = (width * n * bits + 7) // 8
    rows = min(height, len(data) // row) if row else 0
    if not rows or bits not in (1, 2, 4, 8):
        return None
    raw = np.frombuffer(data, np.uint8, rows * row).reshape(rows, row)
    if bits < 8:
        raw = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
        raw = (raw * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2)
    return raw[:, : width * n].reshape(rows, width, n).astype(np.int64)


def packed(values: np.ndarray, bits: int) -> bytes:
    rows = values.reshape(len(values), -1)
    if bits == 8:
        return rows.astype(np.uint8).tobytes()
    flags = ((rows[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).reshape(len(rows), -1)
    return np.packbits(flags, axis=1).tobytes()


def averaged(values: np.ndarray, factor: int) -> np.ndarray:
    """Means of blocks, rounded half up; blocks at the right and bottom are what is left."""
    rows, width, _ = values.shape
    down = np.add.reduceat(np.add.reduceat(values, np.arange(0, rows, factor), axis=0), np.arange(0, width, factor), axis=1)
    count = np.minimum(factor, rows - np.arange(0, rows, factor))[:, None] * np.minimum(factor, width - np.arange(0, width, factor))[None, :]
    return (down + (count // 2)[:, :, None]) // count[:, :, None]


def subsampled(values: np.ndarray, factor: int) -> np.ndarray:
    """The sample at the top left of each block."""
    return values[::factor, ::factor]


def resolution(image: dict, m: tuple) -> tuple[float, float]:
    across, down = math.hypot(m[0], m[1]), math.hypot(m[2], m[3])
    return (image["w"] / across * 72 if across else math.inf), (image["h"] / down * 72 if down else math.inf)


def placements(page) -> dict[int, tuple[float, float]]:
    """The least resolution of each image over all its paints, in forms and patterns too."""
    from . import geometry as g

    least: dict[int, tuple[float, float]] = {}
    items = page.resources.items
    seen = 0

    def walk(ops, m, depth) -> None:
        nonlocal seen
        for op in ops:
            seen += 1
            if op[0] == "Do":
                x, y = resolution(items["img"][op[1]], g.then(op[2], m))
                a, b = least.get(op[1], (math.inf, math.inf))
                least[op[1]] = (min(a, x), min(b, y))
            elif op[0] == "form" and depth < 16:
                walk(items["form"][op[1]].get("ops", ()), g.then(op[2], m), depth + 1)
            elif op[0] == "pattern" and depth < 16:
                p = items["pattern"][op[1]]
                if "ops" in p:
                    walk(p["ops"], p["matrix"], depth + 1)

    walk(page.content.ops, g.IDENTITY, 0)
    return least


def reduced(image: dict, least: tuple[float, float], policy: dict) -> dict:
    """The image as the policy wants it: the same one, or one that is smaller by a whole factor."""
    space = image["space"]
    bits = 1 if image["mask"] else image["bits"]
    kind = "Mono" if bits == 1 else "Gray" if space is not None and components(space) == 1 else "Color"
    if policy.get(f"Downsample{kind}Images") != "true" or image.get("key") or space is not None and space[0] == "Indexed":
        return image
    try:
        target = int(policy.get(f"{kind}ImageResolution", DEFAULTS[kind]))
    except ValueError:
        target = DEFAULTS[kind]
    if not LEAST <= target <= MOST:
        target = DEFAULTS[kind]
    factor = max(1, math.floor(min(least) / target)) if math.isfinite(min(least)) else 1
    values = samples(image["data"], image["w"], image["h"], 1 if space is None else components(space), bits) if factor > 1 else None
    if values is None or len(values) < image["h"]:
        return image
    style = policy.get(f"{kind}ImageDownsampleType", "/Subsample" if kind == "Mono" else "/Average")
    small = subsampled(values, factor) if kind == "Mono" or style == "/Subsample" else averaged(values, factor)
    return image | {"w": small.shape[1], "h": small.shape[0], "data": packed(small, bits)}
