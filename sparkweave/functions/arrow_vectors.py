"""Products of blocks of vectors on Arrow tables, where pairs are too many to be rows."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that are held at once.
SCORES = 1 << 22


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round does: halves go up in the shortest decimal. Near a half, and for large numbers, decimals decide."""
    by = 10.0**digits
    with np.errstate(all="ignore"):
        scaled = np.abs(x) * by
        out = np.copysign(np.floor(scaled + 0.5) / by, x) + 0.0
        unsure = np.isfinite(x) & ~((np.abs(scaled - np.floor(scaled) - 0.5) > 1e-6) & (scaled < 1e9))
    out[~np.isfinite(x)] = x[~np.isfinite(x)]
    wide, last = Context(prec=400), Decimal(1).scaleb(-digits)
    for at in zip(*np.nonzero(unsure)):
        out[at] = float(Decimal(repr(float(x[at]))).quantize(last, ROUND_HALF_UP, wide)) + 0.0
    return out


def matrix(lists: pa.ChunkedArray, missing: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with 0, and their lengths, ``missing`` for one that is null or holds a null."""
    lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else lists.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        out = values.reshape(len(lengths), width)
    else:
        out = np.zeros((len(lengths), width))
        out[np.arange(width) < lengths[:, None]] = values
    kinds = np.where(lists.is_null().to_numpy(zero_copy_only=False), missing, lengths)
    if flat.null_count:
        kinds[np.repeat(np.arange(len(lengths)), lengths)[flat.is_null().to_numpy(zero_copy_only=False)]] = missing
        out = np.nan_to_num(out, nan=0.0, posinf=np.inf, neginf=-np.inf)
    return out, kinds


def _sides(asked: pa.Table, held: pa.Table):
    """Matrices of one width; pairs of vectors of other lengths than each other's have no score, as null."""
    (q, q_kind), (v, v_kind) = matrix(asked["q"], -1), matrix(held["v"], -2)
    width = max(q.shape[1], v.shape[1])
    fill = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    return fill(q), q_kind, fill(v), v_kind


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values, nulls first."""
    return pd.factorize(column.to_pandas(), sort=True)[0]


def _chunks(order: np.ndarray, codes: np.ndarray, most: int):
    """Runs of whole groups, of ``most`` rows or one group, each with its groups' bounds."""
    ends = [*(np.flatnonzero(np.diff(codes[order])) + 1), len(order)]
    start, bounds = 0, [0]
    for end in ends:
        if end - start > most and len(bounds) > 1:
            yield order[start : start + bounds[-1]], bounds
            start, bounds = start + bounds[-1], [0]
        bounds.append(end - start)
    yield order[start:], bounds


def _firsts(group: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Which rows are the first of their code in their group, for the n codes that come first there; groups are runs."""
    new = np.zeros(len(group), bool)
    new[np.unique(group * (codes.max(initial=0) + 2) + codes + 1, return_index=True)[1]] = True
    count, start = np.cumsum(new), np.searchsorted(group, group)
    return new & (count - count[start] < n)  # a group's first row is a new one


def best(left: list[str], right: list[str], k: int, tie: list[str], digits: int, firsts: tuple[str, int] | None = None):
    """A function of two tables: of each qid the k best pairs by rounded inner product, ties to the smaller ``tie``.

    Products of blocks find who can be among the k best; these are added up anew in
    order, as the column function does, so the result doesn't depend on the blocks.
    ``firsts``: (column of ``right``, n): vectors of the first n values' first rows come besides.
    """

    def cell(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            none = np.zeros(0, np.int64)
            return _picked(asked, held, none, none, pa.array([], pa.float64()), none > 0)
        q, q_kind, v, v_kind = _sides(asked, held)
        n, codes = len(v), _codes(asked["qid"])
        groups = _codes(held[firsts[0]]) if firsts else None
        ties = [(_codes(asked[t])[:, None], None) if t in left else (None, _codes(held[t])) for t in tie]
        parts = []
        for rows, bounds in _chunks(np.argsort(codes, kind="stable"), codes, max(1, SCORES // n)):
            with np.errstate(all="ignore"):
                near = q[rows] @ v.T
            near[np.isnan(near)] = np.inf
            near[q_kind[rows][:, None] != v_kind] = -np.inf
            found = []
            for a, b in zip(bounds, bounds[1:]):
                flat = near[a:b].ravel()
                last = np.partition(flat, len(flat) - k)[len(flat) - k] if len(flat) > k else -np.inf
                # Rounding moves a score by half a digit, another order of adding by far less.
                at = np.flatnonzero(flat >= last - (2 * 10.0**-digits + 1e-9 * abs(last) if np.isfinite(last) else 0))
                found.append((rows[a + at // n], at % n, np.full(len(at), a)))
            i, j, group = map(np.concatenate, zip(*found))
            x = np.zeros(len(i))
            with np.errstate(all="ignore"):
                for d in range(q.shape[1]):
                    x += q[i, d] * v[j, d]
            x, null = rounded(x, digits), q_kind[i] != v_kind[j]
            nan = np.isnan(x)
            keys = [c[i, 0] if h is None else h[j] for c, h in ties]
            order = np.lexsort((*keys[::-1], -np.where(nan | null, 0, x), ~nan, null, group))
            place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
            order = order[place < k]
            first = _firsts(group[order], groups[j[order]], firsts[1]) if firsts else null[order]
            parts.append((i[order], j[order], x[order], null[order], first))
        i, j, x, null, first = map(np.concatenate, zip(*parts))
        return _picked(asked, held, i, j, pa.array(x, mask=null), first)

    def _picked(asked: pa.Table, held: pa.Table, i: np.ndarray, j: np.ndarray, score: pa.Array, first: np.ndarray) -> pa.Table:
        columns = [asked[c].take(pa.array(i)) for c in left] + [held[c].take(pa.array(j)) for c in right]
        if not firsts:
            return pa.table([*columns, score], names=[*left, *right, "score"])
        v = held["v"].take(pa.array(j, mask=~first)).combine_chunks()
        v = v if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks)
        return pa.table([*columns, score, pa.StructArray.from_arrays([v], names=["v"], mask=pa.array(~first))], names=[*left, *right, "score", "at"])

    return cell


def attend(digits: int):
    """A function of two tables: for each question its best score, and the sums of weights exp(score - best) and of weighted vectors."""

    def cell(asked: pa.Table, held: pa.Table) -> pa.Table:
        q, q_kind, v, v_kind = _sides(asked, held)
        best, total, x = [np.zeros(0)], [np.zeros(0)], [np.zeros((0, v.shape[1]))]
        none = [np.zeros(0, bool)]
        step = max(1, SCORES // max(1, len(v)))
        for a in range(0, len(q) if len(v) else 0, step):
            own = q_kind[a : a + step, None] == v_kind
            s = np.where(own, rounded(q[a : a + step] @ v.T, digits), -np.inf)
            m = s.max(axis=1)
            e = np.where(own, np.exp(s - np.where(np.isfinite(m), m, 0)[:, None]), 0.0)
            best.append(m), total.append(e.sum(axis=1)), x.append(e @ v), none.append(~own.any(axis=1))
        none = np.concatenate(none)
        mask = lambda p: pa.array(np.concatenate(p), mask=none)
        flat = np.concatenate(x)
        values = pa.array(flat.ravel(), mask=np.repeat(none, flat.shape[1]))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), values)
        qid = asked["qid"].slice(0, len(flat))
        return pa.table([qid, mask(best), mask(total), lists], names=["qid", "m", "z", "x"])

    return cell
