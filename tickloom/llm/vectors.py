"""Integer vectors from columns of numbers, and exact integer arithmetic on them with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GRID = 256  # steps of a component between two whole numbers
FAR = 1 << 62  # components beyond it, either way, count as it


def usable(column: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sizes, values): which rows hold a vector without null or non-finite components, and floor(256 * x).

    With ``length`` only vectors of so many components are usable.  An empty vector is usable otherwise.
    """
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), sizes)
    good = column.is_valid().to_numpy(zero_copy_only=False)
    good[owner[~np.isfinite(x)]] = False
    if length is not None:
        good &= sizes == length
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.clip(np.floor(GRID * x[good[owner]]), -FAR, FAR).astype(np.int64)
    return np.flatnonzero(good), sizes[good], scaled


def lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column without nulls, padded with zeros to the longest row or ``width``."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), max(int(sizes.max(initial=0)), width)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def _most(a: np.ndarray) -> int:
    return int(np.abs(a).max(initial=0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``; Python integers where 64 bits are too few."""
    a, b = widened(a, b)
    bound = _most(a) * _most(b) * max(a.shape[1], 1)
    if bound < 1 << 53:  # every partial sum is a whole number that a double holds
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    return a.astype(object) @ b.T.astype(object)


def norms(a: np.ndarray) -> np.ndarray:
    """Exact squared lengths of the rows."""
    if _most(a) ** 2 * max(a.shape[1], 1) < 1 << 63:
        return np.einsum("ij,ij->i", a, a)
    wide = a.astype(object)
    return (wide * wide).sum(axis=1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``."""
    a, b = widened(a, b)
    if (_most(a) + _most(b)) ** 2 * max(a.shape[1], 1) >= 1 << 62:
        a, b = a.astype(object), b.astype(object)
        return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return norms(a)[:, None] + norms(b)[None, :] - 2 * products(a, b)


def longs(values: np.ndarray) -> np.ndarray:
    """As 64-bit integers; what lies beyond them becomes the nearest one."""
    if values.dtype == object:
        values = np.clip(values, -(1 << 63), (1 << 63) - 1)
    return values.astype(np.int64)
