"""Small dense steps on V x V matrices: the part of each operator that runs once per matrix, not per row."""

from __future__ import annotations

import numpy as np


def fix_signs(p: np.ndarray) -> np.ndarray:
    """Turn every column so that its entry of largest absolute value is positive."""
    lead = p[np.abs(p).argmax(axis=0), np.arange(p.shape[1])]
    return p * np.where(lead < 0, -1.0, 1.0)


def leading_eigen(s: np.ndarray, a: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues of a symmetric matrix with sign-fixed vectors as columns."""
    lam, vec = np.linalg.eigh((s + s.T) / 2)
    order = np.argsort(lam)[::-1][: a or len(lam)]
    return np.maximum(lam[order], 0.0), fix_signs(vec[:, order])


def soft_threshold(x, eps):
    return np.sign(x) * np.maximum(np.abs(x) - eps, 0.0)


def shrink_operator(gram: np.ndarray, threshold: float) -> np.ndarray:
    """B with Z @ B = Z after soft-thresholding its singular values, computed from gram = Z'Z.

    Squaring halves the precision, so singular values below 1e-8 of the largest are noise and set to zero.
    """
    lam, vec = np.linalg.eigh((gram + gram.T) / 2)
    s = np.sqrt(np.maximum(lam, 0.0))
    keep = s > max(threshold, 1e-8 * s.max(initial=0.0))
    gain = np.zeros_like(s)
    gain[keep] = (s[keep] - threshold) / s[keep]
    return (vec * gain) @ vec.T


def orthonormal_average(loadings: list[np.ndarray]) -> np.ndarray:
    """Mean of several V x A loading sets after aligning signs to the first, re-orthonormalised (polar factor)."""
    first = loadings[0]
    total = np.zeros_like(first)
    for p in loadings:
        total += p * np.where((p * first).sum(axis=0) < 0, -1.0, 1.0)
    u, _, vt = np.linalg.svd(total / len(loadings), full_matrices=False)
    return u @ vt
