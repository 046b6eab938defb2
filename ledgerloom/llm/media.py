"""Media columns: copies of pictures, cropped or edited, by local image descriptors.

A picture becomes grey levels in a pyramid (whole, by the root of a half, and half size). Corners (Harris response) that are maximal in
their neighbourhood are keypoints, so their number follows the picture's area and a crop keeps those it shows. Each has an orientation
from its patch's centroid and 64 brightness comparisons turned by it; the comparisons are those of many drawn ones that split sample
patches evenly and differ from each other most. A keypoint and the nearest one beside it are entered in two Hamming tables: one by the
first halves of both descriptors, one by the second. One half alone would be shared by chance far too often in a large collection.

Pictures meet in the tables' entries, whatever share of their keypoints they have in common; those that share an entry with a bucket's
hub are compared on all their keypoints through grouping.classes, and what stays open goes through open_pairs: all pairs
that share an entry, but for those of which too few keypoints match. Geometric consensus: matches within max_distance bits are grouped by turn and scale, two matches fix a similarity transform
(any turn and shift), and pictures are copies if one transform brings at least min_inliers matches, and a share of the smaller one's
keypoints, together.

Pictures of one width are stacked and treated together with numpy, large ones in strips; equal pixels (128 bits of SHA-256) are one node
before any join.

Defined results: null, unreadable and empty pictures have no keypoints and are copies only of equal bytes (all null ones are one class);
pictures of over MAX_PIXELS pixels, or MAX_SIDE to a side, count as unreadable; one without corners is a copy only of equal pixels; a null id gets a number made
from the value; rows that share an id are judged each by its own picture; ties between hubs go to the smaller number; an empty table
gives no rows; extra columns, whatever their names, are ignored. Readable are binary PGM and PPM of 8 or
16 bits and 8-bit PNG without interlacing. A text of over 14 million words is rendered as a picture beyond MAX_PIXELS.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import grouping
from ledgerloom.llm.scratch import written
from ledgerloom.llm.words import cut_words, mix64
from ledgerloom.llm.workers import map_batches

MAX_PIXELS, MAX_SIDE = 1 << 27, (1 << 16) - 1
_PAD, _NMS, _PATCH, _TURNS = 12, 8, 7, 64
_SCALES = (1.0, 0.5**0.5, 0.5)
_SHIFTS = (1, 2, 4, 8, 1)  # window 2, 4, 8, 16, 17 = 2 * _NMS + 1
_TABLES = 2
_STRIP, _HALO = 1 << 20, 2 * _PAD
_POINT = np.dtype([("x", "<u2"), ("y", "<u2"), ("level", "i1"), ("turn", "i1"), ("bits", "<u8")])
_YY, _XX = (g[np.hypot(*np.mgrid[-_PATCH : _PATCH + 1, -_PATCH : _PATCH + 1]) <= _PATCH] for g in np.mgrid[-_PATCH : _PATCH + 1, -_PATCH : _PATCH + 1])


def _turned(points: np.ndarray) -> np.ndarray:
    """(turn, test, end, xy): points turned by each step, as whole pixels."""
    angles = np.arange(_TURNS) * 2 * np.pi / _TURNS
    return np.rint(np.stack([points @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) for a in angles])).astype(np.int64)


def _sample_picture(rng: np.random.Generator, height: int = 100, width: int = 130) -> np.ndarray:
    out = np.full((height, width), 120.0, np.float32)
    for _ in range(40):
        (y, x), (h, w) = rng.integers(0, (height - 12, width - 12)), rng.integers(5, 40, 2)
        out[y : y + h, x : x + w] = rng.integers(0, 256)
    return out


@lru_cache(1)
def comparisons(drawn: int = 1000, pictures: int = 12) -> np.ndarray:
    """The 64 comparisons, for each turn: of those drawn, the most even ones on sample pictures that are least alike (trained from fixed seeds)."""
    rng = np.random.default_rng(64)
    ends = rng.uniform(-_PATCH, _PATCH, (4 * drawn, 2, 2))
    fit = (np.hypot(ends[..., 0], ends[..., 1]) <= _PATCH).all(axis=1) & (np.hypot(*(ends[:, 0] - ends[:, 1]).T) >= 3)
    tests, bits = _turned(ends[fit][:drawn]), []
    for k in range(pictures):
        picture = _sample_picture(rng) if k % 3 else rng.uniform(0, 255, (100, 130)).astype(np.float32)
        smooth, _, y, x, turn = _corners(np.pad(picture, _PAD, mode="edge"))
        at = tests[turn]
        value = smooth[y[:, None, None] + at[..., 1], x[:, None, None] + at[..., 0]]
        bits.append(value[..., 0] < value[..., 1])
    seen = np.concatenate(bits).astype(np.float32)
    even = np.abs(seen.mean(axis=0) - 0.5)
    alike = np.abs(np.corrcoef(seen + rng.normal(0, 1e-3, seen.shape), rowvar=False))
    for most in np.arange(0.2, 1.01, 0.05):
        chosen: list[int] = []
        for i in np.argsort(even, kind="stable"):
            if len(chosen) < 64 and (not chosen or alike[i, chosen].max() < most):
                chosen.append(int(i))
        if len(chosen) == 64:
            break
    return tests[:, rng.permutation(chosen)]


#: The head of a PGM or PPM file: kind, width, height and greatest level, with comments between them.
_HEADER = re.compile(rb"P([56])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s")


def _allowed(height: int, width: int) -> bool:
    return 0 < height * width <= MAX_PIXELS and max(height, width) <= MAX_SIDE


def decode_picture(value: bytes | None) -> np.ndarray | None:
    """Grey levels of a PGM, PPM or PNG file; None where it can't be read."""
    try:
        if value and (head := _HEADER.match(value)):
            width, height, most = (int(head[k]) for k in (2, 3, 4))
            shape = (height, width) + (() if head[1] == b"5" else (3,))
            if not _allowed(height, width) or not 0 < most < 1 << 16:
                return None
            kind = np.dtype(np.uint8 if most < 256 else ">u2")
            pixels = np.frombuffer(value, kind, int(np.prod(shape)), head.end()).reshape(shape).astype(np.float32)
            pixels = pixels if most == 255 else pixels * np.float32(255 / most)
            return pixels if head[1] == b"5" else pixels.mean(axis=2)
        if value and value[:8] == b"\x89PNG\r\n\x1a\n":
            return _decode_png(value)
    except (ValueError, IndexError, zlib.error):
        return None
    return None


def _decode_png(value: bytes) -> np.ndarray | None:
    at, packed, head = 8, b"", b""
    while at < len(value):
        size, kind = int.from_bytes(value[at : at + 4], "big"), value[at + 4 : at + 8]
        chunk = value[at + 8 : at + 8 + size]
        head, packed = (chunk if kind == b"IHDR" else head), (packed + chunk if kind == b"IDAT" else packed)
        at += size + 12
    width, height, depth, colour, interlace = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9], head[12]
    n = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or n is None or interlace or not _allowed(height, width):
        return None
    size = height * (1 + width * n)
    lines = np.frombuffer(zlib.decompressobj().decompress(packed, size), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.int64)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        up = out[y - 1] if y else np.zeros(width * n, np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(-1, n), axis=0).ravel() % 256
        elif kind == 2:
            out[y] = (line + up) % 256
        else:
            row = out[y]
            for i in range(width * n):
                a, b, c = (row[i - n] if i >= n else 0), up[i], (up[i - n] if i >= n else 0)
                guess = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                row[i] = (line[i] + guess) % 256
    pixels = out.reshape(height, width, n).astype(np.float32)
    return pixels[:, :, : n - (n in (2, 4))].mean(axis=2)


def render_words(hashes: np.ndarray, cells: int = 32, side: int = 3) -> bytes:
    """A PGM picture of a text: each word a square texture from its hash, laid out in lines of `cells` words, or more where a long text would
    be too high a picture for that."""
    while -(-len(hashes) // cells) * side > MAX_SIDE:
        cells *= 2
    lines = max(1, -(-len(hashes) // cells))
    bits = np.zeros(lines * cells, np.uint64)
    bits[: len(hashes)] = hashes
    levels = ((bits[:, None] >> (np.arange(side * side, dtype=np.uint64) * np.uint64(4))[None, :]) & np.uint64(15)).astype(np.uint8) * 17
    pixels = levels.reshape(lines, cells, side, side).transpose(0, 2, 1, 3).reshape(lines * side, cells * side)
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def _box3(a: np.ndarray) -> np.ndarray:
    b = a.copy()
    b[1:] += a[:-1]
    b[:-1] += a[1:]
    c = b.copy()
    c[:, 1:] += b[:, :-1]
    c[:, :-1] += b[:, 1:]
    return c


def _local_max(a: np.ndarray) -> np.ndarray:
    """The maximum over the (2 * _NMS + 1)-wide square around each pixel."""
    for axis in (0, 1):
        out = a
        for shift in _SHIFTS:
            moved = out[shift:] if axis == 0 else out[:, shift:]
            kept = out[:-shift] if axis == 0 else out[:, :-shift]
            out = np.maximum(moved, kept)
        full = np.full_like(a, -np.inf)
        if axis == 0:
            full[_NMS : _NMS + out.shape[0]] = out
        else:
            full[:, _NMS : _NMS + out.shape[1]] = out
        a = full
    return a


def _corners(stack: np.ndarray) -> tuple[np.ndarray, ...]:
    """The smoothed picture, and the places (y, x), responses' peaks, and turns of its corners; the outer _PAD pixels hold none."""
    fine = _box3(stack)
    dy, dx = np.zeros_like(fine), np.zeros_like(fine)
    dy[1:-1] = fine[2:] - fine[:-2]
    dx[:, 1:-1] = fine[:, 2:] - fine[:, :-2]
    xx, yy, xy = _box3(dx * dx), _box3(dy * dy), _box3(dx * dy)
    response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    peak = (response == _local_max(response)) & (response > 1.0)
    peak[:_PAD] = peak[-_PAD:] = peak[:, :_PAD] = peak[:, -_PAD:] = False
    y, x = np.nonzero(peak)
    smooth = _box3(fine)
    patch = smooth[y[:, None] + _YY[None, :], x[:, None] + _XX[None, :]]
    patch = patch - patch.mean(axis=1, keepdims=True)
    turn = np.rint(np.arctan2(patch @ _YY, patch @ _XX) * _TURNS / (2 * np.pi)).astype(np.int64) % _TURNS
    return smooth, response, y, x, turn


def _keypoints(pictures: list[np.ndarray], level: int, tests: np.ndarray) -> list[np.ndarray]:
    """Keypoints of pictures of one width, stacked with padding between them."""
    tops = np.cumsum([0] + [p.shape[0] + 2 * _PAD for p in pictures])
    smooth, _, y, x, turn = _corners(np.concatenate([np.pad(p, _PAD, mode="edge") for p in pictures]))
    owner = np.searchsorted(tops, y, "right") - 1
    heights = np.array([p.shape[0] for p in pictures])
    inside = (y - tops[owner] >= _PAD) & (y - tops[owner] < _PAD + heights[owner])
    y, x, turn, owner = y[inside], x[inside], turn[inside], owner[inside]
    ends = tests[turn]
    value = smooth[y[:, None, None] + ends[..., 1], x[:, None, None] + ends[..., 0]]
    bits = ((value[..., 0] < value[..., 1]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    points = np.zeros(len(x), _POINT)
    points["x"], points["y"], points["level"], points["turn"], points["bits"] = x - _PAD, y - _PAD - tops[owner], level, turn, bits
    return np.split(points, np.searchsorted(owner, np.arange(1, len(pictures))))


def _in_strips(picture: np.ndarray, level: int, tests: np.ndarray) -> np.ndarray:
    """Keypoints of one large picture, from strips that overlap by what a keypoint depends on: those of the whole, in bounded memory."""
    height, rows = picture.shape[0], max(4 * _HALO, _STRIP // picture.shape[1])
    found = []
    for top in range(0, height, rows):
        low, high = max(0, top - _HALO), min(height, top + rows + _HALO)
        (points,) = _keypoints([picture[low:high]], level, tests)
        points["y"] += low
        found.append(points[(points["y"] >= top) & (points["y"] < top + rows)])
    return np.concatenate(found)


def _shrunk(picture: np.ndarray) -> np.ndarray:
    """The picture at _SCALES[1] of its size, by linear interpolation between pixel centres."""
    out = picture
    for axis in (0, 1):
        n = picture.shape[axis]
        at = np.clip((np.arange(int(n * _SCALES[1])) + 0.5) / _SCALES[1] - 0.5, 0, n - 1)
        low = np.floor(at).astype(np.int64)
        part = (at - low).astype(np.float32).reshape((-1, 1) if axis == 0 else (1, -1))
        out = out.take(low, axis) * (1 - part) + out.take(np.minimum(low + 1, n - 1), axis) * part
    return out


def _levels(picture: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    yield 0, picture
    if min(picture.shape) >= 4 * _PATCH:
        yield 1, _shrunk(picture)
        p = picture[: picture.shape[0] // 2 * 2, : picture.shape[1] // 2 * 2]
        yield 2, (p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) / 4


def describe(pictures: list[np.ndarray | None], tests: np.ndarray) -> list[np.ndarray]:
    """The keypoints of each picture over all levels."""
    found: list[list[np.ndarray]] = [[np.zeros(0, _POINT)] for _ in pictures]
    alike: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for i, picture in enumerate(pictures):
        if picture is None or not picture.size:
            continue
        for level, p in _levels(picture):
            if p.size > _STRIP:
                found[i].append(_in_strips(p, level, tests))
            else:
                alike.setdefault((level, p.shape[1]), []).append((i, p))
    for (level, width), members in alike.items():
        many = max(1, _STRIP // (width * max(p.shape[0] + 2 * _PAD for _, p in members)))
        for at in range(0, len(members), many):
            group = members[at : at + many]
            for (i, _), points in zip(group, _keypoints([p for _, p in group], level, tests), strict=True):
                found[i].append(points)
    return [np.concatenate(p) for p in found]


def table_entries(points: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
    """(keypoint, table) entries of each keypoint: a half of its descriptor, that of the nearest keypoint on its level, and in which eighth
    of a circle, seen from its own orientation, that one lies; a keypoint alone on its level has its own half twice. The points may be
    those of several pictures, owner being each one's picture."""
    group = points["level"] if owner is None else owner * len(_SCALES) + points["level"]
    x, y = points["x"].astype(float), points["y"].astype(float)
    near = _nearest(x, y, group)
    seen = np.arctan2(y[near] - y, x[near] - x) - points["turn"] * (2 * np.pi / _TURNS)
    eighth = np.floor((seen % (2 * np.pi)) * 4 / np.pi).astype(np.uint64)
    out, bits, beside = np.zeros((len(points), _TABLES), np.uint64), points["bits"], points["bits"][near]
    for t in range(_TABLES):
        half = [(b >> np.uint64(32 * t)) & np.uint64(0xFFFFFFFF) for b in (bits, beside)]
        out[:, t] = mix64(half[0] * np.uint64(0x9E3779B97F4A7C15) + mix64(half[1] * np.uint64(16) + eighth + np.uint64(8 * t + 1)))
    return out.view(np.int64)


def _nearest(x: np.ndarray, y: np.ndarray, group: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
    """The place of each point's nearest other one of its group, the first of several; its own if there is no other.

    Groups of about the same size are treated together, large ones in strips."""
    order, out = np.argsort(group, kind="stable"), np.arange(len(x))
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    sizes = np.diff(np.append(starts, len(x)))
    x, y = x[order], y[order]
    side = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for s in np.unique(side[sizes > 1]):
        alike = np.flatnonzero((side == s) & (sizes > 1))
        many = max(1, chunk // int(s * s))
        for at in range(0, len(alike), many):
            first, n = (v[alike[at : at + many]] for v in (starts, sizes))
            place, inside = first[:, None] + np.arange(s), np.arange(s) < n[:, None]
            place = np.where(inside, place, first[:, None])
            gx, gy, own = x[place], y[place], np.arange(s)
            rows = max(1, chunk // int(s * len(first)))
            for low in range(0, int(s), rows):
                far = (gx[:, low : low + rows, None] - gx[:, None, :]) ** 2 + (gy[:, low : low + rows, None] - gy[:, None, :]) ** 2
                far[np.broadcast_to((own[low : low + rows, None] == own) | ~inside[:, None, :], far.shape)] = np.inf
                kept = inside[:, low : low + rows]
                out[order[place[:, low : low + rows][kept]]] = order[(first[:, None] + far.argmin(axis=2))[kept]]
    return out


def _matches(a: np.ndarray, b: np.ndarray, max_distance: int, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    rows, found = max(1, chunk // max(1, len(b))), []
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a["bits"][at : at + rows, None] ^ b["bits"][None, :]) <= max_distance)
        found.append((i + at, j))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _places(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the whole picture as complex numbers, and each level's pixel size."""
    size = 1 / np.array(_SCALES)[points["level"]]
    return (points["x"] + 0.5) * size + 1j * (points["y"] + 0.5) * size, size


def _distinct(i: np.ndarray, j: np.ndarray) -> int:
    """How many keypoints of either side the matches (i, j) can bring together at most."""
    return min(len(set(i.tolist())), len(set(j.tolist())))


def can_agree(a: np.ndarray, b: np.ndarray, least: float, max_distance: int = 6) -> bool:
    """Whether enough keypoints of both pictures have a match, whatever their places: without that no transform brings `least` together."""
    return min(len(a), len(b)) >= least and _distinct(*_matches(a, b, max_distance)) >= least


def agreeing(a: np.ndarray, b: np.ndarray, max_distance: int = 6, tolerance: float = 4.0, enough: float = np.inf) -> int:
    """The most keypoints whose matches agree on one similarity transform; the search ends where that is enough, or can't be.

    Matches of about the same turn and scale are taken together; each fixes a transform with two others of its group, far from it.
    """
    least = enough if enough < np.inf else 2
    i, j = _matches(a, b, max_distance)
    if len(i) < max(2, least) or (enough < np.inf and _distinct(i, j) < least):
        return 0
    (pa_, size_a), (pb, size_b) = _places(a), _places(b)
    za, zb, ratio = pa_[i], pb[j], np.log(size_a[i] / size_b[j])
    angle = (a["turn"][i].astype(int) - b["turn"][j]) * 2 * np.pi / _TURNS
    slack = tolerance * np.maximum(size_a[i], size_b[j])
    turn, step = np.rint(angle * 8 / np.pi).astype(int) % 16, np.rint(ratio / np.log(2) * 2).astype(int)
    best = 0
    for t in range(16):
        near_turn = np.minimum((turn - t) % 16, (t - turn) % 16) <= 1
        for s in np.unique(step[turn == t]):
            own = np.flatnonzero(near_turn & (np.abs(step - s) <= 1))
            if len(own) < max(2, least, best + 1) or _distinct(i[own], j[own]) < max(least if enough < np.inf else 0, best + 1):
                continue
            best = max(best, _consensus(za[own], zb[own], ratio[own], angle[own], slack[own], i[own], j[own], enough))
            if best >= enough:
                return best
    return best


def _consensus(za: np.ndarray, zb: np.ndarray, ratio: np.ndarray, angle: np.ndarray, slack: np.ndarray, i: np.ndarray, j: np.ndarray, enough: float) -> int:
    order = np.argsort(zb.real + zb.imag, kind="stable")
    m, first, second = len(order), [], []
    for shift in {max(1, m // 2), max(1, m // 3)}:
        first.append(order)
        second.append(np.roll(order, shift))
    p, q = np.concatenate(first), np.concatenate(second)
    apart = np.abs(zb[p] - zb[q]) >= 8
    p, q = p[apart], q[apart]
    z = (za[p] - za[q]) / (zb[p] - zb[q])
    fit = (np.abs(z) > 0) & (np.abs(np.log(np.maximum(np.abs(z), 1e-9)) - ratio[p]) < 0.3) & (np.abs(np.angle(z * np.exp(-1j * angle[p]))) < 0.4)
    p, z = p[fit], z[fit]
    shift, best, rows = za[p] - z * zb[p], 0, max(1, (1 << 20) // m)
    for at in range(0, len(p), rows):
        near = np.abs(za[None, :] - z[at : at + rows, None] * zb[None, :] - shift[at : at + rows, None]) <= slack[None, :]
        for k in np.argsort(-near.sum(axis=1), kind="stable"):
            if near[k].sum() <= best:
                break
            best = max(best, min(len(np.unique(i[near[k]])), len(np.unique(j[near[k]]))))
            if best >= enough:
                return best
    return best


def _content(pictures: list[np.ndarray | None], raw: list) -> tuple[list[int], list[int]]:
    """128 bits of each picture's size and pixels, or of its bytes where it can't be read."""
    out = []
    for picture, value in zip(pictures, raw, strict=True):
        data = b"%d %d " % picture.shape + picture.astype(np.uint8).tobytes() if picture is not None else b"?" + (value or b"")
        digest = hashlib.sha256(data).digest()
        out.append([int.from_bytes(digest[k : k + 8], "big", signed=True) for k in (0, 8)])
    return [x for x, _ in out], [y for _, y in out]


def decode_column(column: pa.Array) -> tuple[list[np.ndarray | None], list]:
    values = column.to_pylist()
    return [decode_picture(v) for v in values], values


def render_column(column: pa.Array) -> tuple[list[np.ndarray | None], list]:
    """Pictures of texts, for tables whose media are to be rendered: PGM files that are decoded again. A text without words is empty."""
    words = cut_words(column)
    bounds = zip(words.offsets[:-1], words.offsets[1:], strict=True)
    files = [render_words(words.hashes[a:b]) if b > a else b"" for a, b in bounds]
    return [decode_picture(f) for f in files], files


def _batch_keys(column: pa.Array, least: int = 0) -> tuple[np.ndarray, pa.Array]:
    """(entries, rows): each entry of a picture of at least so many keypoints once, and the row of its picture."""
    points = [np.frombuffer(p, _POINT) for p in column.to_pylist()]
    many = np.array([len(p) if len(p) >= least else 0 for p in points], np.int64)
    owner = np.repeat(np.arange(len(points)), many)
    entries = table_entries(np.concatenate([np.zeros(0, _POINT), *[p for p, n in zip(points, many, strict=True) if n]]), owner)
    row, key = np.repeat(owner, _TABLES), entries.ravel()
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))[: len(row)]
    return key[new], pa.array(row[new])


def open_pairs(open_nodes: DataFrame, sets: DataFrame, min_inliers: int, share: float) -> DataFrame:
    """The pairs (a, b) of open nodes (node, label) of different labels that can be copies: all that share an entry, whichever it is, but for
    those of which too few keypoints have a match, so that no transform can bring enough of them together.

    The members of an entry's largest label are met by the others only, so large groups of copies cost their number.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, place = _batch_keys(batch.column(2), min_inliers)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(place), batch.column(1).take(place)], ["key", "node", "label"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(left, _POINT), np.frombuffer(right, _POINT)
                ok.append(can_agree(a, b, max(min_inliers, share * min(len(a), len(b)))))
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    held = written(sets.join(open_nodes, "node").select("node", "label", "points"), "open-keypoints")
    entries = written(map_batches(held, keyed, "key long, node long, label long"), "open-entries")
    by_label = entries.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = F.max_by("label", F.struct("n", "label")).alias("main")
    mixed = written(by_label.groupBy("key").agg(main, F.count("*").alias("labels")).filter("labels > 1").select("key", "main"), "mixed-entries")
    met = written(entries.join(mixed, "key"), "open-shared-entries")
    others = met.filter("label <> main").select("key", F.col("node").alias("other"), F.col("label").alias("other_label"))
    pairs = met.join(others, "key").filter("label <> other_label").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    left, right = (held.select(F.col("node").alias(n), F.col("points").alias(f"{n}_points")) for n in ("a", "b"))
    both = written(pairs.distinct(), "open-pairs").join(left, "a").join(right, "b").select("a", "b", "a_points", "b_points")
    return written(map_batches(both, judge, "a long, b long"), "rivals")


def _node_keypoints(described: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, points) of each node with keypoints, once. Only what is repeated is looked up; the points of other rows aren't moved."""
    place = ["id", "p1", "p2"]
    counted = described.groupBy(*place).agg(F.count("*").alias("n")).join(nodes, place, "left")
    odd = written(counted.filter("n > 1 OR node IS NULL"), "repeated-pictures")
    spare = written(nodes.filter("node <> id").select(*place, "node"), "renumbered-pictures")
    full = described.filter("length(points) > 0").select(*place, "points")
    single = full.join(odd, place, "left_anti").join(spare, place, "left").select(F.coalesce("node", "id").alias("node"), "points")
    repeated = full.join(odd.filter("node IS NOT NULL").select(*place, "node"), place).dropDuplicates(place).select("node", "points")
    return written(single.union(repeated), "node-keypoints")


def copy_classes(
    media: DataFrame,
    pictures: Callable[[pa.Array], tuple[list[np.ndarray | None], list]] = decode_column,
    min_inliers: int = 5,
    share: float = 0.25,
    batch_rows: int = 64,
) -> DataFrame:
    """(media_id, class_id) of media (media_id, value); class_id is the smallest id of its class."""

    tests = comparisons()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(low, batch_rows)
                seen, raw = pictures(batch.column(2))
                points = pa.array([p.tobytes() for p in describe(seen, tests)], pa.binary())
                content = [pa.array(c, pa.int64()) for c in _content(seen, raw)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *content, points], ["media_id", "id", "p1", "p2", "points"])

    number = F.coalesce(F.col("media_id").cast("long"), F.lit(-1) - F.shiftrightunsigned(F.xxhash64("value"), 1))
    table = media.select(F.col("media_id").cast("long").alias("media_id"), number.alias("id"), "value")
    described = written(map_batches(table, run, "media_id long, id long, p1 long, p2 long, points binary"), "keypoints")
    nodes = grouping.number_nodes(described, ["p1", "p2"], [])
    placed = written(described.select("media_id", "id", "p1", "p2").join(nodes.select("p1", "p2", "node"), ["p1", "p2"]).select("media_id", "node"), "placed")
    sets = _node_keypoints(described, nodes)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, place = _batch_keys(batch.column(1), min_inliers)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(place)], ["key", "node"])

    buckets = grouping.shared_buckets(map_batches(sets, keyed, "key long, node long"), sparse=True)
    asked = written(buckets.select("node").distinct(), "bucket-nodes")
    met = written(grouping.asked_only(sets, asked, "node").join(asked, "node"), "bucket-keypoints")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(left, _POINT), np.frombuffer(right, _POINT)
                least = max(min_inliers, share * min(len(a), len(b)))
                ok.append(agreeing(a, b, enough=least) >= least)
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    def compare(pairs: DataFrame) -> DataFrame:
        left, right = (met.select(F.col("node").alias(n), F.col("points").alias(f"{n}_points")) for n in ("a", "b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_points", "b_points")
        return map_batches(both, judge, "a long, b long")

    labels = grouping.classes(buckets, compare, lambda nodes: compare(open_pairs(nodes, met, min_inliers, share)))
    joined = placed.join(labels.withColumnRenamed("label", "class"), "node", "left")
    return joined.select("media_id", F.coalesce("class", "node").alias("class_id"))


def visible_text(html: str = "html"):
    """A page's text: scripts, styles, comments and tags become spaces."""
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")
