"""Areas and clips of planar polygons, as numpy helpers for use inside tasks.

Points are arrays (n, 2), not closed. Polygons are simple: no ring crosses itself.
"""

from __future__ import annotations

import numpy as np


def points(ring: list) -> np.ndarray:
    """The corners of a closed ring of structs (x, y)."""
    return np.array([(p["x"], p["y"]) for p in ring][:-1], float).reshape(-1, 2)


def signed_area(p: np.ndarray) -> float:
    """Shoelace area; negative for clockwise rings."""
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0] - p[0, 0], p[:, 1] - p[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2


def is_convex(window: np.ndarray) -> bool:
    """Whether a clockwise ring never turns left and goes round once."""
    edge = np.roll(window, -1, axis=0) - window
    edge = edge[(edge != 0).any(axis=1)]
    after = np.roll(edge, -1, axis=0)
    turn = np.arctan2(edge[:, 0] * after[:, 1] - edge[:, 1] * after[:, 0], (edge * after).sum(axis=1))
    return bool((turn <= 1e-12).all() and turn.sum() > -2 * np.pi - 1e-6)


def clip_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Part of a polygon inside a clockwise convex window. Parts that fall apart stay joined
    by edges of no area."""
    for (ax, ay), (bx, by) in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not len(subject):
            break
        side = (bx - ax) * (subject[:, 1] - ay) - (by - ay) * (subject[:, 0] - ax)
        kept = []
        for i in range(len(subject)):
            p, q, s, t = subject[i], subject[(i + 1) % len(subject)], side[i], side[(i + 1) % len(subject)]
            if s <= 0:
                kept.append(p)
            if s * t < 0:
                kept.append(p + (q - p) * (s / (s - t)))
        subject = np.array(kept) if kept else np.empty((0, 2))
    return subject


class Window2D:
    """A polygon of any shape and direction that others are clipped to, prepared once.

    One that is not convex is taken as its fan of triangles about the first corner, which
    cover each inner point once when counted by their direction.
    """

    def __init__(self, window: np.ndarray) -> None:
        if signed_area(window) > 0:
            window = window[::-1]
        self.parts: list[tuple[int, np.ndarray]] = []
        if len(window) >= 3 and is_convex(window):
            self.parts = [(1, window)]
        else:
            for b, c in zip(window[1:-1], window[2:], strict=True):
                fan = np.array([window[0], b, c])
                turn = signed_area(fan)
                if turn:
                    self.parts.append((1, fan) if turn < 0 else (-1, fan[::-1]))
        self.boxes = [(sign, part, part.min(axis=0), part.max(axis=0)) for sign, part in self.parts]

    def common_area(self, subject: np.ndarray) -> float:
        if len(subject) < 3:
            return 0.0
        low, high = subject.min(axis=0), subject.max(axis=0)
        near = ((sign, part) for sign, part, lo, hi in self.boxes if (lo < high).all() and (hi > low).all())
        return max(sum(sign * abs(signed_area(clip_convex(subject, part))) for sign, part in near), 0.0)


def common_area(subject: np.ndarray, window: np.ndarray) -> float:
    """Area common to two polygons of any shape and direction."""
    return Window2D(window).common_area(subject)
