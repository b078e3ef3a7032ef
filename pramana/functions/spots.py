"""Boxes of items on sampled frames: batches of rows of lists, read as whole Arrow and numpy columns."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pramana.functions import geometry as G

#: Rows that are looked at together: with some tens of boxes a row, pairs of boxes take some tens of MB.
ROWS = 2000
SIDES = ("x0", "y0", "x1", "y1")


def sliced(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _numbers(values: pa.Array) -> np.ndarray:
    return pc.cast(values, pa.float64()).to_numpy(zero_copy_only=False)


def _boxes(structs: pa.StructArray) -> np.ndarray:
    box = pc.struct_field(structs, "box")
    return np.stack([_numbers(pc.struct_field(box, c)) for c in SIDES], 1)


def _rows(lists: pa.ListArray) -> np.ndarray:
    """The row of every element of the lists."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` copies its element and its number among them."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _on_frames(regions: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """(region, frame) of every sampled frame that a region hits, as ``geometry.frames_hit``."""
    grid, tol = np.array(G.grid()), G.tolerance()
    t0, t1 = (_numbers(pc.struct_field(regions, c)) for c in ("t0", "t1"))
    first, end = np.searchsorted(grid, t0 - tol, "left"), np.searchsorted(grid, t1 + tol, "right")
    of, at = _spread(np.where(np.isnan(t0) | np.isnan(t1), 0, np.maximum(end - first, 0)))
    return of, first[of] + at


def _equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of ``a`` and ``b`` with one key, in the order of ``a``."""
    order = np.argsort(b, kind="stable")
    first = np.searchsorted(b[order], a, "left")
    of, at = _spread(np.searchsorted(b[order], a, "right") - first)
    return of, order[first[of] + at]


def _area(b):
    return (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])


def _intersection(a, b):
    return np.maximum(0.0, np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0])) * np.maximum(0.0, np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]))


def _share(part, whole):
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _iou(a, b):
    inter = _intersection(a, b)
    return _share(inter, _area(a) + _area(b) - inter)


def avoiding(key: pa.Array, regions: pa.ListArray, tries: int, seed: int) -> pa.ListArray:
    """For each region that hits a frame one of its span and size: of the boxes drawn for its row's key and its number there, the first
    that overlaps least with the row's regions on its frames."""
    flat, row = regions.flatten(), _rows(regions)
    box = _boxes(flat)
    of, frame = _on_frames(flat)
    spot = row[of] * G.SAMPLED + frame
    a, b = _equal(spot, spot)
    a, b = of[a], of[b]
    hit = np.unique(of)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    names = [f"{seed}:" if k is None else f"{seed}:{k}:" for k in key.to_pylist()]
    start = {k: f"{names[row[k]]}{number[k]}:" for k in hit.tolist()}
    size = box[:, 2:] - box[:, :2]
    room = np.maximum(0.0, 1 - size)
    best, place = np.full(len(row), np.inf), np.zeros((len(row), 2))
    left = hit
    for k in range(tries):
        if not len(left):
            break
        digits = b"".join(md5(f"{start[r]}{k}:{c}".encode()).digest() for r in left.tolist() for c in "xy")
        # the first twelve hexadecimal digits
        high = np.frombuffer(digits, ">u8").reshape(-1, 2)[:, 0] >> np.uint64(16)
        at = high.astype(np.float64).reshape(-1, 2) / 16.0**12 * room[left]
        drawn = np.zeros_like(box)
        drawn[left] = np.concatenate([at, at + size[left]], 1)
        met = np.zeros(len(row))
        np.maximum.at(met, a, _iou(drawn[a], box[b]))
        nearer = met[left] < best[left]
        best[left[nearer]], place[left[nearer]] = met[left[nearer]], at[nearer]
        left = left[best[left] > 0]
        keep = best[a] > 0
        a, b = a[keep], b[keep]
    found = np.concatenate([place, place + size], 1)[hit]
    boxes = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(4)], SIDES)
    kept = flat.take(pa.array(hit))
    made = pa.StructArray.from_arrays([pc.struct_field(kept, "t0"), pc.struct_field(kept, "t1"), boxes], ["t0", "t1", "box"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=len(regions)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)


def shares(names: pa.ListArray, seen: pa.ListArray, regions: pa.ListArray, controls: pa.ListArray, cover: float, largest: float, same: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row the frames that its controls hit, and on how many of them one covers a seen box; see ``strata.entity_control_share``."""
    mine, control, other = regions.flatten(), controls.flatten(), seen.flatten()
    m, frame = _on_frames(mine)
    mine_box, mine_at = _boxes(mine)[m], _rows(regions)[m] * G.SAMPLED + frame
    c, frame = _on_frames(control)
    c_row = _rows(controls)[c]
    c_box, c_at = _boxes(control)[c], c_row * G.SAMPLED + frame
    # phrases as numbers of the batch
    said = pa.concat_arrays([pc.struct_field(other, "phrase"), names.flatten()]).dictionary_encode()
    code, phrases = pc.fill_null(said.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), len(said.dictionary) + 1
    o_row, frame, box = _rows(seen), _numbers(pc.struct_field(other, "frame")), _boxes(other)
    code, own = code[: len(other)], code[len(other) :] + _rows(names) * phrases
    kept = np.flatnonzero((frame >= 0) & (frame < G.SAMPLED) & (code >= 0) & (_area(box) < largest) & ~np.isin(o_row * phrases + code, own))
    at, box, code = o_row[kept] * G.SAMPLED + frame[kept].astype(np.int64), box[kept], code[kept]
    a, b = _equal(at, mine_at)
    met = np.unique((at * phrases + code)[a[_iou(box[a], mine_box[b]) >= same]])
    free = np.isin(at, mine_at) & ~np.isin(at * phrases + code, met)
    at, box = at[free], box[free]
    a, b = _equal(c_at, at)
    hit = np.unique(a[_share(_intersection(box[b], c_box[a]), _area(box[b])) >= cover])
    return np.bincount(c_row, minlength=len(names)), np.bincount(c_row[hit], minlength=len(names))
