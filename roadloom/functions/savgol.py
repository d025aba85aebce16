"""Savitzky-Golay weights and window lengths."""

from __future__ import annotations

import numpy as np


def window_length(hz: float, seconds: float = 0.3, polyorder: int = 2) -> int:
    """Frames of a smoothing window: seconds * hz rounded half to even, made odd, and long enough for the polynomial."""
    if not hz > 0:
        raise ValueError(f"a sampling rate is above 0, not {hz}")
    n = round(hz * seconds)
    n += n % 2 == 0
    least = polyorder + 3
    least += least % 2 == 0
    return max(n, least)


def checked_length(n: int, polyorder: int) -> int:
    if n % 2 == 0 or n <= polyorder:
        raise ValueError(f"a window length is odd and above the polynomial's order {polyorder}, not {n}")
    return n


def weights(length: int, polyorder: int = 2) -> np.ndarray:
    """Row r holds the weights of a window's values in the fitted polynomial's value at its place r."""
    t = np.arange(length) - length // 2
    basis = np.vander(t.astype(float), min(polyorder, length - 1) + 1, increasing=True)
    return basis @ np.linalg.pinv(basis)
