"""Small dense decompositions on rows of grouped moments, batched through Arrow.

These run once per patch, transform or pair, never per point: the moments are
summed by Spark with map-side combining first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def eig3(moments: pd.Series) -> pd.Series:
    """Symmetric ``[xx, xy, xz, yy, yz, zz]`` to 3 ascending eigenvalues and their 3 unit vectors."""
    rows = np.array([np.full(6, np.nan) if m is None else np.asarray(m, float) for m in moments]).reshape(-1, 6)
    ok = np.isfinite(rows).all(axis=1)
    matrices = np.where(ok[:, None], rows, 0.0)[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
    values, vectors = np.linalg.eigh(matrices)
    packed = np.concatenate([values, vectors.transpose(0, 2, 1).reshape(-1, 9)], axis=1)
    return pd.Series([p.tolist() if good else None for p, good in zip(packed, ok)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def rotation_from_covariance(covariance: pd.Series) -> pd.Series:
    """Row-major source-by-target covariance to the best proper rotation (row-major 3x3)."""
    rows = np.array([np.full(9, np.nan) if c is None else np.asarray(c, float) for c in covariance]).reshape(-1, 9)
    ok = np.isfinite(rows).all(axis=1)
    left, _, right = np.linalg.svd(np.where(ok[:, None], rows, 0.0).reshape(-1, 3, 3))
    target = right.transpose(0, 2, 1)
    target[:, :, 2] *= np.sign(np.linalg.det(target @ left.transpose(0, 2, 1)))[:, None]
    rotations = (target @ left.transpose(0, 2, 1)).reshape(-1, 9)
    return pd.Series([r.tolist() if good else None for r, good in zip(rotations, ok)])


def hull_ring(points: np.ndarray) -> np.ndarray:
    """Counterclockwise convex hull of 2-D points (monotone chain)."""
    unique = np.unique(points, axis=0)
    if len(unique) < 3:
        return unique

    def chain(ordered: np.ndarray) -> list[np.ndarray]:
        kept: list[np.ndarray] = []
        for p in ordered:
            while len(kept) > 1:
                a, b = kept[-2], kept[-1]
                if (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0:
                    break
                kept.pop()
            kept.append(p)
        return kept

    lower, upper = chain(unique), chain(unique[::-1])
    return np.array(lower[:-1] + upper[:-1])
