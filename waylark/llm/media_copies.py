"""Copies of images by local descriptors, cropped or edited ones too.

Corners are found at several scales by Harris's measure. Each gets an angle from
the intensity centroid around it and TESTS binary comparisons of smoothed
intensities, at places turned by that angle. A corner and each of its NEIGHBOURS nearest
of the same scale make a duo; a chunk of CHUNK_BITS of the one with the same chunk of the
other is a key, CHUNKS for each duo, so that duos meet in a hash join when one chunk of
each agrees, whatever flips elsewhere. The one of the lesser chunk comes first. Duos rather than single descriptors, as windows of
different images are often alike by chance, two neighbouring ones seldom. Only duos
under keys that occur twice, by a filter of bounded size, travel. In a key's bucket the first duo leads; those
that are near a leader, KEY_BITS_APART at most in each part, are paired with the first such, and one that
is near no leader leads too, so that a bucket of copies gives a pair for each and no more;
each map task does so with its own before, and sends on leaders only.
Pairs of images are then verified: descriptors are matched by Hamming distance, and
matches must agree on one similarity transform. Verified links make classes by
connected components. A leader may be a chance meeting, so all duos meet again
under their keys, with their classes: every pair of images of different classes that is
near under a key is verified too. Equal duos of one class stand for each other
there, by the least image. So the classes are those of all near pairs, while a bucket
of copies still makes few pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .near_dedup import components

SCALES = (1.0, 1.5, 2.25)
#: Corners of an image by scale, or one for each so many pixels of that scale where these are more: a crop keeps its share.
CORNERS = (16, 10, 6)
CORNER_PIXELS = 400
#: But never more than this, as pairs of images are compared corner by corner.
MOST_CORNERS = 1000
RADIUS = 13
TESTS = 128
NEIGHBOURS = 3
CHUNKS, CHUNK_BITS = 6, 20
#: Two duos are near if each part has so many different bits at most.
KEY_BITS_APART = 16
#: Two descriptors match with so many different bits at most; a copy has so many matches that agree on a transform.
MOST_BITS_APART = 30
LEAST_AGREEING = 6
PIXELS_APART = 4.0
ANGLE_APART = 0.45
BATCH = 16
#: Keys that a map task remembers before it starts afresh.
REMEMBERED = 100_000
#: Images of a batch for Python.
BATCH_ROWS = 500
#: Images are dealt into parts of about so many; a cell of two parts verifies the pairs between them.
PART_IMAGES = 4000
LEAST_PARTS = 4
#: Bytes of distances that are compared at once.
PASS_BYTES = 1 << 21

_rng = np.random.default_rng(2011)


def _test_places() -> np.ndarray:
    """(TESTS, 2, 2) offsets (y, x) within the radius.

    The angle points from dark to light, so a test along it would nearly always have
    the same outcome; the two places of a test lie across it.
    """
    places: list[np.ndarray] = []
    while len(places) < TESTS:
        p, q = _rng.uniform(1 - RADIUS, RADIUS - 1, (2, 2))
        if max(np.hypot(*p), np.hypot(*q)) < RADIUS - 1 and abs(p[1] - q[1]) < 2 and abs(p[0] - q[0]) > 5:
            places.append(np.stack([p, q]))
    return np.array(places)


_PLACES = _test_places()
_grid = np.array([(y, x) for y in range(-RADIUS + 2, RADIUS - 1, 2) for x in range(-RADIUS + 2, RADIUS - 1, 2) if y * y + x * x < (RADIUS - 2) ** 2])
DESCRIPTOR = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "<u8", (TESTS // 64,))])


def decode_pgm(data: bytes) -> np.ndarray | None:
    """The pixels of a binary PGM (P5) of 8 bits; None for anything else."""
    if not data or data[:2] != b"P5":
        return None
    at, numbers = 2, []
    while len(numbers) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at)
            if at < 0:
                return None
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        numbers.append(int(data[at:end]))
        at = end
    w, h, top = numbers
    pixels = np.frombuffer(data, dtype=np.uint8, offset=at + 1) if len(data) > at else np.empty(0, dtype=np.uint8)
    return pixels[: w * h].reshape(h, w) if 0 < top < 256 and len(pixels) >= w * h > 0 else None


def encode_pgm(pixels: np.ndarray) -> bytes:
    return f"P5 {pixels.shape[1]} {pixels.shape[0]} 255\n".encode() + pixels.astype(np.uint8).tobytes()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean of the squares of side 2r + 1, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = x.shape[axis]
        x = (np.take(c, np.arange(2 * r + 1, 2 * r + 1 + n), axis=axis) - np.take(c, np.arange(n), axis=axis)) / (2 * r + 1)
    return x


def _shrunk(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return x
    x = _box(x, 1)
    h, w = int(x.shape[1] / scale), int(x.shape[2] / scale)
    y0, x0 = (np.arange(h) + 0.5) * scale - 0.5, (np.arange(w) + 0.5) * scale - 0.5
    yi, xi = np.clip(y0.astype(int), 0, x.shape[1] - 2), np.clip(x0.astype(int), 0, x.shape[2] - 2)
    fy, fx = (y0 - yi)[None, :, None], (x0 - xi)[None, None, :]
    top = x[:, yi][:, :, xi] * (1 - fx) + x[:, yi][:, :, xi + 1] * fx
    low = x[:, yi + 1][:, :, xi] * (1 - fx) + x[:, yi + 1][:, :, xi + 1] * fx
    return top * (1 - fy) + low * fy


def _largest(x: np.ndarray, r: int) -> np.ndarray:
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        p = np.pad(x, pad, constant_values=-np.inf)
        n = x.shape[axis]
        x = np.max([np.take(p, np.arange(k, k + n), axis=axis) for k in range(2 * r + 1)], axis=0)
    return x


def describe(images: np.ndarray) -> list[np.ndarray]:
    """Descriptors of each of some images of one size."""
    found: list[list[np.ndarray]] = [[] for _ in images]
    for scale, most in zip(SCALES, CORNERS, strict=True):
        x = _shrunk(images.astype(np.float64), scale)
        h, w = x.shape[1:]
        if min(h, w) <= 2 * RADIUS + 2:
            continue
        smooth = _box(x, 1)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        measure = a * b - c * c - 0.05 * (a + b) ** 2
        inner = np.full_like(measure, -np.inf)
        inner[:, RADIUS : h - RADIUS, RADIUS : w - RADIUS] = measure[:, RADIUS : h - RADIUS, RADIUS : w - RADIUS]
        peaks = np.where((inner == _largest(inner, 2)) & (inner > 1e-3), inner, 0)
        flat = peaks.reshape(len(x), -1)
        order = np.argsort(-flat, axis=1, kind="stable")[:, : max(most, min(MOST_CORNERS, h * w // CORNER_PIXELS))]
        good = np.take_along_axis(flat, order, axis=1) > 0
        img = np.repeat(np.arange(len(x)), good.sum(axis=1))
        place = order[good]
        if not len(place):
            continue
        py, px = place // w, place % w
        blur = _box(x, 2)
        around = blur[img[:, None], py[:, None] + _grid[:, 0], px[:, None] + _grid[:, 1]]
        angle = np.arctan2((around * _grid[:, 0]).sum(axis=1), (around * _grid[:, 1]).sum(axis=1))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        dy, dx = _PLACES[None, :, :, 0], _PLACES[None, :, :, 1]
        ty = np.rint(py[:, None, None] + dx * sin + dy * cos).astype(int)
        tx = np.rint(px[:, None, None] + dx * cos - dy * sin).astype(int)
        value = blur[img[:, None, None], np.clip(ty, 0, h - 1), np.clip(tx, 0, w - 1)]
        bits = np.packbits(value[:, :, 0] < value[:, :, 1], axis=1, bitorder="little").view("<u8")
        out = np.empty(len(place), dtype=DESCRIPTOR)
        out["x"], out["y"] = (px + 0.5) * scale - 0.5, (py + 0.5) * scale - 0.5
        out["scale"], out["angle"], out["bits"] = scale, angle, bits
        cut = np.searchsorted(img, np.arange(len(x) + 1))
        for i in range(len(x)):
            found[i].append(out[cut[i] : cut[i + 1]])
    return [np.concatenate(f) if f else np.empty(0, dtype=DESCRIPTOR) for f in found]


def duos(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of an image's duos, and the four words of bits of each, those of the lesser chunk first."""
    words = np.ascontiguousarray(d["bits"])
    if len(d) < 2:
        return np.empty(0, dtype=np.uint64), np.empty((0, 4), dtype=np.uint64)
    apart = np.hypot(d["x"][:, None] - d["x"], d["y"][:, None] - d["y"])
    apart[(d["scale"][:, None] != d["scale"]) | (apart == 0)] = np.inf
    q = np.argsort(apart, axis=1, kind="stable")[:, :NEIGHBOURS]
    p = np.repeat(np.arange(len(d)), q.shape[1])
    q = q.ravel()
    there = np.isfinite(apart[p, q])
    p, q = np.divmod(np.unique(np.minimum(p, q)[there] * len(d) + np.maximum(p, q)[there]), len(d))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(d), -1), axis=1, bitorder="little")[:, : CHUNKS * CHUNK_BITS]
    chunk = (bits.reshape(len(d), CHUNKS, CHUNK_BITS).astype(np.uint64) << np.arange(CHUNK_BITS, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    nth = (np.arange(CHUNKS, dtype=np.uint64) + np.uint64(1)) << np.uint64(40)
    turned = (chunk[p] > chunk[q])[:, :, None]
    pair = np.concatenate([np.where(turned, words[q][:, None], words[p][:, None]), np.where(turned, words[p][:, None], words[q][:, None])], axis=2)
    return common.mix(common.mix(np.minimum(chunk[p], chunk[q]) + nth) + np.maximum(chunk[p], chunk[q])).ravel(), pair.reshape(-1, 4)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether duos (words in the last axis) are near."""
    apart = np.bitwise_count(a ^ b)
    return (apart[..., :2].sum(axis=-1) <= KEY_BITS_APART) & (apart[..., 2:].sum(axis=-1) <= KEY_BITS_APART)


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """The most matches of two images that agree on one similarity transform."""
    if len(a) < LEAST_AGREEING or len(b) < LEAST_AGREEING:
        return 0
    apart = np.bitwise_count(a["bits"][:, None, :] ^ b["bits"][None, :, :]).sum(axis=2)
    best = apart.argmin(axis=1)
    i = np.flatnonzero((apart[np.arange(len(a)), best] <= MOST_BITS_APART) & (apart.argmin(axis=0)[best] == np.arange(len(a))))
    if len(i) < LEAST_AGREEING:
        return 0
    p, q = a[i], b[best[i]]
    turn, grow = q["angle"] - p["angle"], q["scale"] / p["scale"]
    cos, sin = grow * np.cos(turn), grow * np.sin(turn)
    most = 0
    for k in range(len(i)):
        x, y = p["x"] - p["x"][k], p["y"] - p["y"][k]
        ex = q["x"][k] + cos[k] * x - sin[k] * y - q["x"]
        ey = q["y"][k] + sin[k] * x + cos[k] * y - q["y"]
        da = np.abs((turn - turn[k] + np.pi) % (2 * np.pi) - np.pi)
        near = (ex * ex + ey * ey <= (PIXELS_APART * max(1.0, grow[k])) ** 2) & (da <= ANGLE_APART) & (np.abs(np.log(grow / grow[k])) < 0.5)
        most = max(most, int(near.sum()))
    return most


def features(media: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """(id, descriptors) of each image; null descriptors where it can't be read or has no corners.

    A scalar function, so that one that draws the images shares its worker.
    """

    @F.pandas_udf("binary")
    def described(images: pd.Series) -> pd.Series:
        shapes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for n, data in enumerate(images):
            pixels = decode_pgm(bytes(data)) if data is not None else None
            if pixels is not None:
                shapes.setdefault(pixels.shape, []).append((n, pixels))
        out: list[bytes | None] = [None] * len(images)
        for same in shapes.values():
            for a in range(0, len(same), BATCH):
                part = same[a : a + BATCH]
                for (n, _), d in zip(part, describe(np.stack([x for _, x in part])), strict=True):
                    out[n] = d.tobytes() if len(d) else None
        common.trim()
        return pd.Series(out, dtype=object)

    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).alias("image")).where("id is not null")
    return rows.select("id", described("image").alias("descriptors"))


class _Bucket:
    """The leaders of a key: duos that were near none before them."""

    __slots__ = ("bits", "ids")

    def __init__(self, i: int, w: np.ndarray):
        self.bits, self.ids = w[None, :], [i]

    def place(self, i: int, w: np.ndarray) -> int | None:
        """The first leader that a duo is near; without one it leads."""
        found = near(self.bits, w)
        if found.any():
            return self.ids[int(found.argmax())]
        self.bits, self.ids = np.concatenate([self.bits, w[None, :]]), [*self.ids, i]
        return None


WORDS = ["b0", "b1", "b2", "b3"]


def _shared(keys: np.ndarray, bits: int, shared: np.ndarray) -> np.ndarray:
    """Places of the keys that others may share."""
    pos = key_positions(keys, bits)
    return np.flatnonzero((shared[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1)


def _led(it: Iterator[pd.DataFrame], bits: int, shared: np.ndarray) -> Iterator[pd.DataFrame]:
    """Of a task's duos under keys that others may share: pairs (id, other) with leaders, and a row (other null) for each leader."""
    buckets: dict[int, _Bucket] = {}
    pairs: set[tuple[int, int]] = set()
    rows: list[tuple[int, ...]] = []

    def out() -> pd.DataFrame:
        a = np.array(rows, dtype=np.int64).reshape(-1, 6)
        p = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        none = np.zeros(len(p), dtype=np.int64)
        words = {name: np.concatenate([a[:, 2 + k], none]) for k, name in enumerate(WORDS)}
        return pd.DataFrame({"key": np.concatenate([a[:, 0], p[:, 0]]), "id": np.concatenate([a[:, 1], p[:, 0]]), **words, "other": pd.array([None] * len(a) + p[:, 1].tolist(), dtype="Int64")})

    common.release()
    for pdf in it:
        pdf = pdf.sort_values("id", kind="stable")  # small ids lead, so that buckets have leaders in common
        for i, d in zip(pdf["id"].tolist(), pdf["descriptors"], strict=True):
            keys, words = duos(np.frombuffer(d, dtype=DESCRIPTOR))
            for r in _shared(keys, bits, shared).tolist():
                key, w = int(keys[r]), words[r]
                bucket = buckets.get(key)
                if bucket is None:
                    buckets[key] = _Bucket(i, w)
                elif (leader := bucket.place(i, w)) is not None:
                    if leader != i:
                        pairs.add((i, leader))
                    continue
                rows.append((int(keys[r].view(np.int64)), i, *w.view(np.int64).tolist()))
            if len(rows) + len(pairs) > REMEMBERED:
                yield out()
                buckets, pairs, rows = {}, set(), []
    yield out()
    buckets, pairs, rows = {}, set(), []
    common.trim()


def _words(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[WORDS].to_numpy().astype(np.int64).view(np.uint64)


def _leaders(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (image, leader) from rows sorted by key: in each bucket, a duo that is near no leader becomes one; the others are paired with the first they are near. Only leaders are held, so a bucket may be of any size."""
    now: int | None = None
    bucket: _Bucket | None = None
    for pdf in it:
        done = pdf["other"].notna().to_numpy()
        out: list[tuple[int, int]] = [(int(i), int(j)) for i, j in zip(pdf["id"][done], pdf["other"][done], strict=True)]
        pdf = pdf[~done]
        for key, i, w in zip(pdf["key"].tolist(), pdf["id"].tolist(), _words(pdf), strict=True):
            if key != now:
                now, bucket = key, _Bucket(i, w)
            elif (leader := bucket.place(i, w)) is not None and leader != i:
                out.append((i, leader))
        yield pd.DataFrame(out, columns=["a", "b"]).drop_duplicates()


def _keyed(it: Iterator[pd.DataFrame], bits: int, shared: np.ndarray) -> Iterator[pd.DataFrame]:
    """A row for each duo and each of its keys that others may share."""
    common.release()
    for pdf in it:
        sets = [duos(np.frombuffer(d, dtype=DESCRIPTOR)) for d in pdf["descriptors"]]
        keys = np.concatenate([k for k, _ in sets])
        r = _shared(keys, bits, shared)
        image = np.repeat(np.arange(len(sets)), [len(k) for k, _ in sets])[r]
        words = np.concatenate([w for _, w in sets])[r].view(np.int64)
        yield pd.DataFrame({"key": keys[r].view(np.int64), "id": pdf["id"].to_numpy()[image], "root": pdf["root"].to_numpy()[image], **{name: words[:, k] for k, name in enumerate(WORDS)}})


def _each_once(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by key, class and duo, the first of each."""
    last: tuple | None = None
    for pdf in it:
        a = pdf[["key", "root", *WORDS]].to_numpy()
        if len(a):
            new = np.append(last is None or tuple(a[0].tolist()) != last, (a[1:] != a[:-1]).any(axis=1))
            last = tuple(a[-1].tolist())
            if new.any():
                yield pdf[new]


def _across(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All pairs (image, image) of different classes that are near under a key, from rows sorted by key, class and duo. Pairs within a class aren't visited."""
    common.release()
    for pdf in common.grouped_batches(_each_once(it), "key", 20_000):
        key, root, ids = (pdf[c].to_numpy() for c in ("key", "root", "id"))
        words = _words(pdf)
        key_end = np.searchsorted(key, key, side="right")
        new = np.append(True, (key[1:] != key[:-1]) | (root[1:] != root[:-1]))
        i, j = np.arange(len(key)), np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1]
        held: list[np.ndarray] = []
        rows = 0
        while True:
            more = j < key_end[i]
            i, j = i[more], j[more]
            if rows > 200_000 or (rows and not len(i)):
                yield pd.DataFrame(np.unique(np.concatenate(held), axis=0), columns=["a", "b"])
                held, rows = [], 0
            if not len(i):
                break
            found = near(words[i], words[j])
            if found.any():
                held.append(np.sort(np.stack([ids[i[found]], ids[j[found]]], axis=1), axis=1))
                rows += len(held[-1])
            j = j + 1


def mutual_matches(bits: np.ndarray, start: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many mutual matches each pair (x, y) of images has, as ``agreeing`` counts them; image k has ``bits`` from start[k] on, size[k] of them."""
    span = np.arange(max(1, size[x].max(), size[y].max()))
    p, q = (bits[np.minimum(start[s][:, None] + span, len(bits) - 1)] for s in (x, y))
    apart = sum(np.bitwise_count(p[:, :, None, k] ^ q[:, None, :, k]) for k in range(bits.shape[1]))
    apart[(span >= size[x][:, None])[:, :, None] | (span >= size[y][:, None])[:, None, :]] = 255
    best = apart.argmin(axis=2)
    least = np.take_along_axis(apart, best[:, :, None], axis=2)[:, :, 0]
    back = np.take_along_axis(apart.argmin(axis=1), best, axis=1)
    return ((least <= MOST_BITS_APART) & (back == span)).sum(axis=1)


def _judged(pairs: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
    """Those of some pairs that are verified; ``sides`` has the descriptors of their images."""
    if not len(pairs):
        return pairs[["a", "b"]]
    sets = [np.frombuffer(d, dtype=DESCRIPTOR) for d in sides["descriptors"]]
    size = np.array([len(d) for d in sets])
    bits, start = np.concatenate([d["bits"] for d in sets]), np.cumsum(size) - size
    common.release()
    places = pd.Index(sides["id"])
    x, y = places.get_indexer(pairs["a"]), places.get_indexer(pairs["b"])
    ok = np.zeros(len(pairs), dtype=bool)
    step = max(1, PASS_BYTES // int(size.max()) ** 2)
    for a in range(0, len(pairs), step):
        enough = mutual_matches(bits, start, size, x[a : a + step], y[a : a + step]) >= LEAST_AGREEING
        for k in (a + np.flatnonzero(enough)).tolist():
            ok[k] = agreeing(sets[x[k]], sets[y[k]]) >= LEAST_AGREEING
    return pairs.loc[ok, ["a", "b"]]


def verified(pairs: DataFrame, found: DataFrame, images: int) -> DataFrame:
    """The pairs (a, b) of images that are copies. Descriptors travel once to each cell of two parts that has a pair with them."""
    parts = max(LEAST_PARTS, -(-images // PART_IMAGES))
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    p, q = part("a"), part("b")
    asked = common.written(pairs.select("a", "b", (F.least(p, q) * parts + F.greatest(p, q)).alias("cell")), "asked")
    needed = asked.select(F.col("cell").alias("place"), F.explode(F.array("a", "b")).alias("id")).distinct()
    sides = found.select("id", "descriptors").join(needed, "id")
    return asked.repartition(tasks, "cell").groupBy("cell").cogroup(sides.repartition(tasks, "place").groupBy("place")).applyInPandas(_judged, "a long, b long")


def classes_of(good: DataFrame) -> DataFrame:
    """(id, root) for each end of verified links."""
    # an image's partners, one for each of its keys at most, are linked to the least of them: many images share these, so few links are left
    stars = good.groupBy("a").agg(F.collect_set("b").alias("bs")).select("a", "bs", F.array_min("bs").alias("least"))
    few = stars.select(F.explode(F.concat(F.array("a"), "bs")).alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    return components(few)


def key_positions(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(16)).astype(np.int64) & np.int64(bits - 1)


def linked(found: DataFrame) -> DataFrame:
    """The verified links (a, b) among images, given as (id, descriptors) with an id once only: enough of them that every near pair under a key is either linked, in one class, or verified to be no copies."""
    spark = found.sparkSession
    images, size = found.agg(F.count(F.lit(1)), F.sum(F.length("descriptors"))).first()
    bits = common.filter_bits((size or 0) // DESCRIPTOR.itemsize * NEIGHBOURS * CHUNKS, per_item=8)

    def places(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for a in range(0, len(pdf), 1000):
                each = [np.unique(key_positions(duos(np.frombuffer(d, dtype=DESCRIPTOR))[0], bits)) for d in pdf["descriptors"].iloc[a : a + 1000]]
                pos, n = np.unique(np.concatenate(each), return_counts=True)
                yield pd.DataFrame({"pos": pos.astype(np.int32), "n": n.astype(np.int32)})
        common.trim()

    twice = found.select("descriptors").mapInPandas(places, "pos int, n int").groupBy("pos").agg(F.sum("n").alias("n")).where("n > 1").select("pos")
    shared = np.zeros(bits // 8, dtype=np.uint8)
    for bucket, packed in common.position_bitmap(twice).collect():  # bits / 8 bytes at most
        at = (bucket - 1) * 4096
        part = np.frombuffer(packed, dtype=np.uint8)[: len(shared) - at]
        shared[at : at + len(part)] = part
    told = spark.sparkContext.broadcast(shared)

    rows = found.mapInPandas(lambda it: _led(it, bits, told.value), "key long, id long, b0 long, b1 long, b2 long, b3 long, other long")
    met = rows.repartition("key").sortWithinPartitions("key", "id")
    with common.arrow_rows(spark, BATCH_ROWS):
        pairs = common.written(met.mapInPandas(_leaders, "a long, b long").distinct(), "met")
    good = common.written(verified(pairs, found, images), "judged")

    known = found.join(classes_of(good), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "descriptors")
    rows = known.mapInPandas(lambda it: _keyed(it, bits, told.value), "key long, id long, root long, b0 long, b1 long, b2 long, b3 long")
    met = rows.repartition("key").sortWithinPartitions("key", "root", *WORDS, "id")
    with common.arrow_rows(spark, BATCH_ROWS):
        pairs = common.written(met.mapInPandas(_across, "a long, b long").distinct(), "met")
    return common.written(good.unionByName(verified(pairs, found, images)), "judged")


def media_groups(media: DataFrame, id_col: str = "media_id", image_col: str = "image") -> DataFrame:
    """(media_id, class_id, links) for each row of ``media``: the least id of its class of copies, its own where it has none, and how many verified links it has.

    Links are those that were tried: of each image to the leaders of its buckets, and
    of images that these left in different classes to each other. Images
    are binary PGM; null, broken and plain ones without corners stand alone. Rows that
    repeat an id are one medium, with the first row's descriptors in the order of
    their bytes. A null id has a null class. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = media.sparkSession
    with common.arrow_rows(spark, BATCH_ROWS):  # images are large rows
        found = common.written(features(media, id_col, image_col), "descriptors")
    found = found.where("descriptors is not null").groupBy("id").agg(F.min("descriptors").alias("descriptors"))
    found = common.written(found, "descriptors")

    good = linked(found)
    classes = classes_of(good)
    ends = good.select(F.col("a").alias("id")).union(good.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    out = media.select(F.col(id_col).cast("long").alias("id")).join(classes.join(ends, "id"), "id", "left")
    return out.select(F.col("id").alias("media_id"), F.coalesce("root", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


# ---------------------------------------------------------------- images of vectors

CELLS, CELL = 16, 6
_MIX = np.random.default_rng(5).normal(0, 1, (CELLS * CELLS, 64))


def picture(vector: np.ndarray) -> np.ndarray:
    """A mosaic of CELLS x CELLS grey cells, each a fixed combination of the vector's components."""
    v = np.zeros(64)
    v[: min(64, len(vector))] = vector[:64]
    norm = float(np.linalg.norm(v)) or 1.0
    grey = np.clip(128 + 48 * (_MIX @ (v / norm)), 0, 255).reshape(CELLS, CELLS)
    return np.rint(np.kron(grey, np.ones((CELL, CELL))))


def edited(pixels: np.ndarray, kind: int) -> np.ndarray:
    """As it is, cropped, of other brightness and contrast, or both."""
    if kind in (1, 3):
        pixels = pixels[9:-4, 5:-8] if kind == 1 else pixels[3:-10, 7:-2]
    if kind in (2, 3):
        pixels = np.clip(pixels * (0.75 if kind == 2 else 1.15) + (35 if kind == 2 else -20), 0, 255)
    return pixels


def pictures(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(media_id, image): a picture of each vector, edited in one of four ways as its id says. A null vector has no image."""

    @F.pandas_udf("binary")
    def drawn(ids: pd.Series, vectors: pd.Series) -> pd.Series:
        return pd.Series([encode_pgm(edited(picture(np.asarray(v, dtype=float)), int(i) % 4)) if v is not None and not pd.isna(i) else None for i, v in zip(ids, vectors, strict=True)], dtype=object)

    key = F.col(id_col).cast("long")
    return embeddings.select(key.alias("media_id"), drawn(key, F.col(vector_col)).alias("image"))
