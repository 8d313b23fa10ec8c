"""64-bit mixing of NumPy arrays."""

from __future__ import annotations

import numpy as np


def mix64(h: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3, a bijection of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
