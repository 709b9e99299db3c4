"""What tasks that work on NumPy arrays share."""

from __future__ import annotations

import numpy as np


def keep_memory() -> None:
    """For tasks that make many arrays of some 100 kB: after one large block was freed, glibc's malloc
    holds on to what is freed later (at most twice this block), in place of giving each array back to
    the system and faulting its pages in again."""
    block = np.empty(16 << 20, np.uint8)
    del block
