"""Media columns: local descriptors that find cropped, resized, turned or edited copies of images.

An image is a column of binary PGM. On every level of a scale pyramid each corner that is the strongest around it
is kept, whatever their number. A corner's patch is turned by its intensity centroid, and pairs of its points are
compared, one bit each. The pairs are those, of many random ones, whose bits are most even and least alike on
seeded pictures; so unrelated descriptors rarely agree.

The 128 bits are cut into ``BANDS`` disjoint bands (Hamming tables). Two descriptors that differ in at most
``MOST_BITS`` = ``BANDS`` - 1 bits are equal in one band at least, so a join on bands loses none of them. Levels
meet each other in it, which is how resized copies are found. The matches of an image pair must then agree on one similarity:
two matches fix scale, turn and shift, and the others are held against it.

Equal images are one class, known by digest, and only one of them is indexed, so copies never meet each other.

Defined results
---------------
* Null, empty or damaged images have no descriptors and match nothing. Images without corners, too.
* A null id: the row is left out, of queries, index and classes alike. Rows that share an id are images of their own:
  the index knows rows, not ids; two queries with one id count as one picture with the points of both.
* A class's id is the smallest id of its images. Ties between similarities: the first in the order of points.
* Mirrored copies aren't found. Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.llm.storage import stored

#: Pyramid levels of queries, a twelfth of an octave apart; every ``INDEX_STEP``-th is indexed.
LEVELS = tuple(2.0 ** (-k / 12) for k in range(13))
INDEX_STEP = 3
RADIUS, BITS, TURNS, BLOB = 8, 128, 36, 1.2
#: A corner is the strongest within so many pixels.
APART = 3
BANDS = 8
MOST_BITS = BANDS - 1
#: Places (squares of 4 pixels) that must agree on a similarity; how far (pixels) a point may be from where that takes it.
LEAST_MATCHES, TOLERANCE = 3, 2.5
#: Pairs of matches that are tried as similarities, evenly spaced over all pairs.
HYPOTHESES = 4096
#: Queries' bands (56 bytes a row) are broadcast up to this many rows, else both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Pixels that are described at once.
SLICE_PIXELS = 1 << 20

_GRID = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1].astype(np.float32)
_DISC = ((_GRID**2).sum(0) <= RADIUS**2).astype(np.float32)
_SIDE = 2 * RADIUS + 1


# --- pixels ------------------------------------------------------------------------------------

def to_pgm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.clip(pixels, 0, 255).astype(np.uint8).tobytes()


def from_pgm(data: bytes | None) -> np.ndarray | None:
    """Pixels, or None where the data isn't a whole 8-bit PGM."""
    try:
        magic, size, depth, body = bytes(data).split(b"\n", 3)
        w, h = map(int, size.split())
        return np.frombuffer(body, np.uint8, w * h).reshape(h, w) if magic == b"P5" and depth == b"255" and w * h else None
    except (TypeError, ValueError):
        return None


def smoothed(x: np.ndarray) -> np.ndarray:
    """Binomial 5 x 5 over the last two axes; edges repeat."""
    for axis in (-1, -2):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (2, 2)
        p, n = np.moveaxis(np.pad(x, pad, mode="edge"), axis, -1), x.shape[axis]
        x = np.moveaxis((p[..., :n] + p[..., 4:] + 4 * (p[..., 1 : n + 1] + p[..., 3 : n + 3]) + 6 * p[..., 2 : n + 2]) / 16, -1, axis)
    return x


def resized(x: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear over the last two axes."""
    if scale == 1.0:
        return x
    for axis in (-1, -2):
        n = x.shape[axis]
        at = np.clip((np.arange(max(1, int(n * scale))) + 0.5) / scale - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        part = (at - low).astype(x.dtype if x.dtype.kind == "f" else np.float64)
        shape = [1] * x.ndim
        shape[axis] = len(part)
        part = part.reshape(shape)
        x = np.take(x, low, axis) * (1 - part) + np.take(x, np.minimum(low + 1, n - 1), axis) * part
    return x


def strongest(x: np.ndarray) -> np.ndarray:
    """The maximum within ``APART`` pixels."""
    for axis in (-1, -2):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (APART, APART)
        p, n = np.moveaxis(np.pad(x, pad, mode="edge"), axis, -1), x.shape[axis]
        out = p[..., :n].copy()
        for k in range(1, 2 * APART + 1):
            np.maximum(out, p[..., k : k + n], out=out)
        x = np.moveaxis(out, -1, axis)
    return x


def corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, row, column) of a stack's Harris maxima that leave room for a patch; parabolas give fractions of a pixel."""
    edge = RADIUS + 2
    if min(x.shape[1:]) <= 2 * edge:
        return (np.empty(0, int),) * 3
    gy, gx = np.gradient(x, axis=(1, 2))
    a, b, c = smoothed(gx * gx), smoothed(gy * gy), smoothed(gx * gy)
    r = a * b - c * c - 0.05 * (a + b) ** 2
    peak = ((r >= strongest(r)) & (r > 1.0))[:, edge:-edge, edge:-edge]
    image, row, column = np.nonzero(peak)
    row, column = row + edge, column + edge
    here, places = r[image, row, column], []
    for at, before, after in ((row, r[image, row - 1, column], r[image, row + 1, column]), (column, r[image, row, column - 1], r[image, row, column + 1])):
        places.append(at + np.clip((after - before) / np.maximum(2 * (2 * here - before - after), 1e-6), -0.5, 0.5))
    return image, *places


def patches_at(y: np.ndarray, image: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """(point, patch): the flat patches around places between pixels, bilinear."""
    top, left = np.floor(row).astype(np.int64), np.floor(column).astype(np.int64)
    steps = np.arange(-RADIUS, RADIUS + 2)
    around = (steps[:, None] * y.shape[2] + steps).ravel()
    wide = np.ascontiguousarray(y).ravel()[((image * y.shape[1] + top) * y.shape[2] + left)[:, None] + around].reshape(-1, _SIDE + 1, _SIDE + 1)
    down, right = ((x[:, None, None]).astype(np.float32) for x in (row - top, column - left))
    wide = wide[:, :-1] * (1 - down) + wide[:, 1:] * down
    return (wide[:, :, :-1] * (1 - right) + wide[:, :, 1:] * right).reshape(-1, _SIDE * _SIDE)


def oriented(x: np.ndarray, step: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every ``step``-th level of a stack of images: level, image, row, column, turn and flat patch of its corners."""
    base = smoothed(x.astype(np.float32))
    for level in range(0, len(LEVELS), step):
        y = resized(base, LEVELS[level])
        image, row, column = corners(y)
        if len(image):
            patches = patches_at(y, image, row, column)
            dy, dx = patches @ (_GRID[0] * _DISC).ravel(), patches @ (_GRID[1] * _DISC).ravel()
            turn = np.rint(np.arctan2(dy, dx) / (2 * np.pi) * TURNS).astype(int) % TURNS
            yield level, image, row, column, turn, patches


def filters(tests: np.ndarray) -> np.ndarray:
    """(turn, patch, test): the difference of two blobs of radius ``BLOB`` for each test (test, 2 points, row and column), turned with the patch."""
    out = np.empty((TURNS, _SIDE * _SIDE, len(tests)), np.float32)
    rows, columns = _GRID.reshape(2, -1, 1, 1)
    for turn, angle in enumerate(2 * np.pi * np.arange(TURNS) / TURNS):
        y = tests[..., 0] * np.cos(angle) + tests[..., 1] * np.sin(angle)
        x = tests[..., 1] * np.cos(angle) - tests[..., 0] * np.sin(angle)
        blob = np.exp(-((rows - y) ** 2 + (columns - x) ** 2) / (2 * BLOB**2))
        blob /= blob.sum(0)
        out[turn] = blob[..., 1] - blob[..., 0]
    return out


def tested(patches: np.ndarray, turn: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """One bit for each point and test: the second place is lighter."""
    out = np.empty((len(patches), filters.shape[2]), bool)
    for t in np.unique(turn):
        own = np.flatnonzero(turn == t)
        out[own] = patches[own] @ filters[t] > 0
    return out


@lru_cache
def pattern(candidates: int = 4000, samples: int = 100) -> np.ndarray:
    """Filters of the tests that are even and least alike on seeded pictures, dealt over the bands in turn."""
    rng = np.random.default_rng(20)
    radius, angle = (RADIUS - 1.5) * np.sqrt(rng.random((candidates, 2))), 2 * np.pi * rng.random((candidates, 2))
    tests = np.stack([radius * np.sin(angle), radius * np.cos(angle)], -1)
    seen = oriented(np.stack([picture(rng.normal(size=8)) for _ in range(samples)]), INDEX_STEP)
    turn, patches = (np.concatenate(x) for x in zip(*(found[-2:] for found in seen)))
    bits = np.concatenate([tested(patches, turn, filters(tests[at : at + 250])) for at in range(0, candidates, 250)], 1).astype(np.float32)
    mean = bits.mean(0)
    bits = (bits - mean) / np.sqrt(mean * (1 - mean) + 1e-6)
    alike = np.abs(bits.T @ bits) / len(bits)
    order = np.argsort(np.abs(mean - 0.5), kind="stable")
    order = order[np.abs(mean[order] - 0.5) < 0.2]
    for limit in np.arange(0.15, 1.01, 0.05):
        chosen, free = [], np.ones(candidates, bool)
        for t in order:
            if free[t]:
                chosen.append(int(t))
                free &= alike[t] < limit
        if len(chosen) >= BITS:
            return filters(tests[np.array(chosen[:BITS]).reshape(-1, BANDS).T.ravel()])
    raise ValueError("too few candidates")


#: A point in one long: row and column in quarter pixels (26 bits each), turn (6 bits), level (4 bits).
def packed_place(y: np.ndarray, x: np.ndarray, turn: np.ndarray, level: int) -> np.ndarray:
    return (np.rint(y * 4).astype(np.int64) << 36) | (np.rint(x * 4).astype(np.int64) << 10) | (turn.astype(np.int64) << 4) | level


def unpacked_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position as a complex number (column + i row), turn, scale."""
    return ((place >> 10) & (2**26 - 1)) / 4 + 1j * (place >> 36) / 4, (place >> 4) & 63, np.array(LEVELS)[place & 15]


POINT = np.dtype([("place", "<i8"), ("high", "<i8"), ("low", "<i8")])


def describe(stack: np.ndarray, tests: np.ndarray, step: int = 1) -> list[np.ndarray]:
    """The points of each image of a stack (n, h, w)."""
    owners, found = [], []
    for level, image, row, column, turn, patches in oriented(stack, step):
        bits = np.packbits(tested(patches, turn, tests), axis=1).view(">i8").astype(np.int64)
        points = np.empty(len(image), POINT)
        points["place"] = packed_place((row + 0.5) / LEVELS[level], (column + 0.5) / LEVELS[level], turn, level)
        points["high"], points["low"] = bits[:, 0], bits[:, 1]
        owners.append(image)
        found.append(points)
    if not owners:
        return [np.empty(0, POINT)] * len(stack)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.split(np.concatenate(found)[order], np.searchsorted(owner[order], np.arange(1, len(stack))))


# --- tables ------------------------------------------------------------------------------------

EXTRACTED = "image_id long, digest binary, points binary"


def _described(images: list[bytes | None], tests: np.ndarray, step: int) -> list[bytes]:
    """Points of images as bytes; images of one size go through as one array, equal ones once."""
    out: dict[bytes, bytes] = {}
    by_shape: dict[tuple[int, int], list[tuple[bytes, np.ndarray]]] = {}
    for data in {x for x in images if x is not None}:
        pixels = from_pgm(data)
        if pixels is None:
            out[data] = b""
        else:
            by_shape.setdefault(pixels.shape, []).append((data, pixels))
    for (h, w), same in by_shape.items():
        together = max(1, SLICE_PIXELS // (h * w))
        for at in range(0, len(same), together):
            part = same[at : at + together]
            for (data, _), points in zip(part, describe(np.stack([p for _, p in part]), tests, step)):
                out[data] = points.tobytes()
    return [b"" if x is None else out[x] for x in images]


def extract(images: DataFrame, step: int = INDEX_STEP) -> DataFrame:
    """images (image_id, image) -> image_id, digest (null for a null image) and the points of every ``step``-th level, packed."""
    import hashlib

    tests = pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                data = part.column(1).to_pylist()
                digests = [None if x is None else hashlib.sha256(x).digest() for x in data]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(_described(data, tests, step), pa.binary())], names=["image_id", "digest", "points"])

    return images.where(F.col("image_id").isNotNull()).select(F.col("image_id").cast("long").alias("image_id"), "image").mapInArrow(run, EXTRACTED)


def points_of(described: DataFrame, id_col: str = "image_id") -> DataFrame:
    """One row per point: image_id, place, high, low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = [np.frombuffer(x, POINT) for x in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in rows])
                points = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(np.ascontiguousarray(points[c])) for c in POINT.names)], names=["image_id", *POINT.names])

    return described.where(F.length("points") > 0).select(id_col, "points").mapInArrow(run, "image_id long, place long, high long, low long")


def _banded(points: DataFrame) -> DataFrame:
    """One row per point and band: key is the band's number and value."""
    width = BITS // BANDS
    words = [(word, shift) for word in ("high", "low") for shift in range(64 - width, -1, -width)]
    value = lambda b, word, shift: F.shiftrightunsigned(F.col(word), shift).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(b << width)
    return points.select("*", F.explode(F.array(*(value(b, *w) for b, w in enumerate(words)))).alias("key"))


def near_points(q: DataFrame, i: DataFrame, broadcast: bool) -> DataFrame:
    """Rows of q and i (aliases) whose descriptors differ in at most ``MOST_BITS`` bits, each once or more often."""
    near = F.bit_count(F.col("q.high").bitwiseXOR(F.col("i.high"))) + F.bit_count(F.col("q.low").bitwiseXOR(F.col("i.low"))) <= MOST_BITS
    asked = F.broadcast(_banded(q)) if broadcast else _banded(q).hint("merge")
    return _banded(i).alias("i").join(asked.alias("q"), (F.col("q.key") == F.col("i.key")) & near)


def similarity(q: np.ndarray, i: np.ndarray) -> tuple[int, complex, complex]:
    """(matches that agree, factor, shift) of the best similarity i = factor * q + shift between matched places."""
    (at, q_turn, q_scale), (to, i_turn, i_scale) = unpacked_place(q), unpacked_place(i)
    ratio, turn = np.log2(q_scale / i_scale), 2 * np.pi / TURNS * (i_turn - q_turn)
    first, second = np.triu_indices(len(q), 1)
    apart = np.abs(at[second] - at[first]) > 8
    first, second = first[apart], second[apart]
    if len(first) > HYPOTHESES:
        pick = np.linspace(0, len(first) - 1, HYPOTHESES).astype(int)
        first, second = first[pick], second[pick]
    best = (0, 1 + 0j, 0j)
    if not len(first):
        return best

    def agrees(factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            size, way = np.log2(np.abs(factor)), np.angle(factor)
        return (
            (np.abs(factor[:, None] * at + shift[:, None] - to) <= TOLERANCE * np.maximum(1, np.abs(factor))[:, None])
            & (np.abs(size[:, None] - ratio) <= 0.5)
            & (np.abs(np.angle(np.exp(1j * (way[:, None] - turn)))) <= np.pi / 6)
        )

    def points(held: np.ndarray) -> int:
        cells = lambda x: len(np.unique(np.floor(x.real / 4) + 1j * np.floor(x.imag / 4)))  # noqa: E731  a corner is found on several levels
        return min(cells(at[held]), cells(to[held]))

    for start in range(0, len(first), 512):
        a, b = first[start : start + 512], second[start : start + 512]
        factor = (to[b] - to[a]) / (at[b] - at[a])
        shift = to[a] - factor * at[a]
        held = agrees(factor, shift)
        for k in np.argsort(-held.sum(1), kind="stable")[:4]:
            if held[k].sum() <= best[0]:
                break
            own = held[k]
            mid, goal = at[own].mean(), to[own].mean()
            spread = (np.abs(at[own] - mid) ** 2).sum()
            better = (np.conj(at[own] - mid) * (to[own] - goal)).sum() / spread if spread else factor[k]
            moved = goal - better * mid
            refined = agrees(np.array([better]), np.array([moved]))[0]
            n, f, s = max((points(own), factor[k], shift[k]), (points(refined), better, moved), key=lambda x: x[0])
            if n > best[0]:
                best = (n, f, s)
    return best


FOUND = "query_id long, image_id long, n_matches long, shift_y int, shift_x int, scale double, turn int"


def _agreed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for query, image, matches in pdf.itertuples(index=False, name=None):
            places = np.array(sorted((m["q"], m["i"]) for m in matches), np.int64)
            n, factor, shift = similarity(places[:, 0], places[:, 1])
            if n >= LEAST_MATCHES:
                out.append((query, image, n, int(round(shift.imag)), int(round(shift.real)), float(abs(factor)), int(round(np.degrees(np.angle(factor)))) % 360))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])


def find_matches(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Both described (image_id, points): query_id, image_id, n_matches, shift, scale and turn from query to image."""
    q, i = stored(points_of(queries), "image-queries"), stored(points_of(index), "image-index")
    met = near_points(q, i, q.count() * BANDS <= BROADCAST_ROWS).select(F.col("q.image_id").alias("query_id"), F.col("i.image_id").alias("image_id"), F.struct(F.col("q.place").alias("q"), F.col("i.place").alias("i")).alias("m"))
    # A pair of images has as many matches as its points allow; equal ones from several bands fall together.
    pairs = met.groupBy("query_id", "image_id").agg(F.collect_set("m").alias("matches")).where(F.size("matches") >= LEAST_MATCHES)
    return pairs.mapInPandas(_agreed, FOUND)


def class_table(described: DataFrame) -> DataFrame:
    """digest -> class_id (the smallest id), class_size and row (of one of the smallest id's images); ``described`` has a column row."""
    least = F.min(F.struct("image_id", "row")).alias("least")
    return described.where(F.col("digest").isNotNull()).groupBy("digest").agg(least, F.count(F.lit(1)).alias("class_size")).select("digest", F.col("least.image_id").alias("class_id"), F.col("least.row").alias("row"), "class_size")


def find_copies(queries: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both (image_id, image). Links (query_id, class_id, n_matches, shift_y, shift_x, scale, turn) and members (image_id, class_id, class_size)."""
    described = stored(extract(images), "images").withColumn("row", F.monotonically_increasing_id())
    classes = stored(class_table(described), "image-classes")
    # The index is known by row, so that rows with one id stay apart.
    index = described.select(F.col("row"), "points").join(classes.select("row").hint("merge"), "row", "left_semi").select(F.col("row").alias("image_id"), "points")
    found = find_matches(extract(queries, step=1).select("image_id", "points"), index)
    links = found.withColumnRenamed("image_id", "row").join(classes.select("row", "class_id"), "row").drop("row")
    members = described.where(F.col("digest").isNotNull()).select("image_id", "digest").join(classes.select("digest", "class_id", "class_size").hint("merge"), "digest").drop("digest")
    return links, members


# --- pictures for tables that have none ----------------------------------------------------------

def picture(values: np.ndarray, size: int = 64) -> np.ndarray:
    """A picture that a vector's values decide: texture of several grains with rectangles and discs on it."""
    rng = np.random.default_rng(np.frombuffer(np.asarray(values, np.float32).tobytes(), np.uint32))
    y, x = np.mgrid[:size, :size]
    out = np.full((size, size), 128.0)
    for grain, strength in ((8, 26), (4, 30), (2, 22)):
        out += strength * resized(rng.normal(size=(size // grain, size // grain)), float(grain))
    for _ in range(6):
        cy, cx, ry, rx = rng.integers(0, size, 2).tolist() + rng.integers(3, 12, 2).tolist()
        inside = (abs(y - cy) <= ry) & (abs(x - cx) <= rx) if rng.random() < 0.6 else ((y - cy) / ry) ** 2 + ((x - cx) / rx) ** 2 <= 1
        out[inside] = 0.5 * out[inside] + rng.integers(10, 118)
    return out


def edited(pixels: np.ndarray, key: int) -> np.ndarray:
    """A crop with other brightness and contrast and some noise; by the key's remainder by 3 also resized or turned by right angles."""
    rng = np.random.default_rng(abs(key))
    top, left = rng.integers(0, 13, 2)
    h, w = pixels.shape
    part = pixels[top : top + h - 12, left : left + w - 12]
    if key % 3 == 1:
        part = resized(part.astype(np.float64), rng.uniform(0.75, 1.25))
    elif key % 3 == 2:
        part = np.rot90(part, rng.integers(1, 4))
    return part * rng.uniform(0.85, 1.1) + rng.uniform(-12, 12) + rng.normal(0, 1.0, part.shape)


def pictures(vectors: DataFrame, edit: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(image_id, image): each vector's picture as PGM; with ``edit``, an edited crop of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids, vectors = part.column(0), (x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in part.column(1))
                images = [None if v is None or not len(v) else to_pgm(edited(picture(v), i) if edit else picture(v)) for i, v in zip(ids.to_pylist(), vectors)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(images, pa.binary())], names=["image_id", "image"])

    # A picture is many times its vector's size, so the few partitions of a small table are dealt out first.
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("image_id"), F.col(vector_col).alias("v")).repartition(parts).mapInArrow(run, "image_id long, image binary")
