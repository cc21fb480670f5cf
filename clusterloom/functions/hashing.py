"""Spark's ``xxhash64`` of whole numbers over arrays, for keys that are made within a task."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def int_hash(values: np.ndarray, seed) -> np.ndarray:
    """``xxhash64`` of int columns; ``seed`` is 42 at first, then the hash of the columns before."""
    with np.errstate(over="ignore"):
        seed = np.asarray(seed).astype(np.uint64)
        h = (seed + _P5 + np.uint64(4)) ^ (np.asarray(values).astype(np.int32).view(np.uint32).astype(np.uint64) * _P1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))
