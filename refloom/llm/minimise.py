"""Limited-memory quasi-Newton minimisation in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 80, memory: int = 8, tolerance: float = 1e-6) -> np.ndarray:
    """The point reached from x after at most ``steps`` descents of f, which returns its value and gradient."""
    value, gradient = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(gradient).max(initial=0) < tolerance:
            break
        direction, saved = -gradient, []
        for s, y in reversed(moves):
            a = (s @ direction) / (s @ y)
            saved.append(a)
            direction = direction - a * y
        if moves:
            s, y = moves[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(saved)):
            direction = direction + (a - (y @ direction) / (s @ y)) * s
        slope, length = gradient @ direction, 1.0 if moves else 1.0 / max(np.abs(gradient).sum(), 1e-12)
        while True:
            new = x + length * direction
            new_value, new_gradient = f(new)
            if new_value <= value + 1e-4 * length * slope or length < 1e-10:
                break
            length /= 2
        if length < 1e-10:
            break
        s, y = new - x, new_gradient - gradient
        if s @ y > 1e-12:
            moves = [*moves[-memory + 1 :], (s, y)]
        x, value, gradient = new, new_value, new_gradient
    return x
