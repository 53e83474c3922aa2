"""Copies among images: multiscale corners, orientation-normalised binary tests, Hamming-table joins over neighbouring corners and geometric consensus."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, arrow_map, mix
from .components import connected_components, forest

#: Radius of a descriptor's patch, its binary tests, and the tables it is cut into: descriptors at most 3 bits apart share one of 4.
RADIUS, TESTS, TABLES = 10, 128, 4
#: Corners that must agree on one similarity transform, within this many pixels.
AGREE, PIXELS = 6, 3.0
#: Directions of a corner's neighbours that its marks tell apart, members of a mark that meet in one task, and numbers compared at a time.
DIRECTIONS, PART, AT_ONCE = 8, 256, 1 << 21
#: Next members, in a drawn order, that each member of a mark is tried with while more than that many pairs a member are left.
NEXT, FEW = 2, 8

_rng = np.random.default_rng(5)
_tests = np.clip(_rng.normal(0, RADIUS / 2.2, (TESTS, 4)), -RADIUS + 1, RADIUS - 1)
_disc = np.array([(dy, dx) for dy in range(-RADIUS, RADIUS + 1) for dx in range(-RADIUS, RADIUS + 1) if dy * dy + dx * dx <= RADIUS * RADIUS])


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2 r + 1 pixels, edges repeated."""
    p = np.cumsum(np.cumsum(np.pad(np.pad(a, r, mode="edge"), ((1, 0), (1, 0))), axis=0), axis=1)
    n = 2 * r + 1
    return p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]


def corners(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keypoints [n, 4] (x, y, size of a pixel, angle) and descriptors [n, TABLES] of 32 bits, of a grey image [h, w].

    Corners are the local maxima of Harris' response at full, two-thirds and half size and so on, as long as a patch fits.
    A patch is turned by the angle of its intensity centroid before its tests, and only compares grey values, so
    brightness, contrast and turning change little. No image or a flat one: no keypoints.
    """
    points, found, step = [], [], 1.0
    base = image.astype(np.float64)
    while min(base.shape) / step > 2 * RADIUS + 3:
        h, w = int(base.shape[0] / step), int(base.shape[1] / step)
        yy, xx = (np.arange(h) * step).astype(int), (np.arange(w) * step).astype(int)
        a = (_box(base, 1) / 9)[np.ix_(yy, xx)]
        gy, gx = np.gradient(a)
        xx2, yy2, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx2 * yy2 - xy * xy - 0.05 * (xx2 + yy2) ** 2
        r[: RADIUS + 1], r[-RADIUS - 1 :], r[:, : RADIUS + 1], r[:, -RADIUS - 1 :] = 0, 0, 0, 0
        top = np.maximum.reduce([np.roll(r, i, 0) for i in (-2, -1, 0, 1, 2)])
        top = np.maximum.reduce([np.roll(top, i, 1) for i in (-2, -1, 0, 1, 2)])
        y, x = np.nonzero((r == top) & (r > 1e-3 * max(r.max(), 1.0)) & (r > 1))
        if len(y):
            patch = a[y[:, None] + _disc[:, 0], x[:, None] + _disc[:, 1]]
            patch = patch - patch.mean(axis=1, keepdims=True)
            angle = np.arctan2(patch @ _disc[:, 0], patch @ _disc[:, 1])
            c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
            at = lambda ty, tx: a[np.clip(np.rint(y[:, None] + ty * c + tx * s), 0, h - 1).astype(int), np.clip(np.rint(x[:, None] + tx * c - ty * s), 0, w - 1).astype(int)]
            bits = at(_tests[:, 0], _tests[:, 1]) > at(_tests[:, 2], _tests[:, 3]) + 1e-6
            points.append(np.stack([x * step, y * step, np.full(len(y), step), angle], axis=1))
            found.append(np.packbits(bits, axis=1).view(np.int32).reshape(len(y), TABLES))
        step *= 1.5
    if not points:
        return np.zeros((0, 4)), np.zeros((0, TABLES), np.int32)
    return np.concatenate(points), np.concatenate(found)


def consensus(m: np.ndarray, enough: float = np.inf) -> int:
    """m [n, 8]: keypoints that match, of two images. How many distinct corners agree on one similarity transform; as soon as enough do, no more are tried."""
    best = 0
    for p in m:
        if best >= enough:
            break
        k = p[6] / p[2]
        turn = p[7] - p[3]
        c, s = k * np.cos(turn), k * np.sin(turn)
        dx, dy = m[:, 0] - p[0], m[:, 1] - p[1]
        # y grows downwards in both images, and angles are measured the same way
        x, y = p[4] + c * dx - s * dy, p[5] + s * dx + c * dy
        off = np.abs((m[:, 7] - m[:, 3] - turn + np.pi) % (2 * np.pi) - np.pi)
        ok = (np.hypot(x - m[:, 4], y - m[:, 5]) <= PIXELS * max(1, k)) & (off < 0.35)
        best = max(best, min(len({tuple(q) for q in np.rint(m[ok, 0:2] / 3).tolist()}), len({tuple(q) for q in np.rint(m[ok, 4:6] / 3).tolist()})))
    return best


def _may_agree(m: np.ndarray, agree: int) -> np.ndarray:
    """m [pairs, n, 8], n matches of each pair of images: which pairs have agree of them on one transform, corners that coincide counted apart.

    In single precision with some slack: never fewer than consensus() finds.
    """
    m = m.astype(np.float32)
    turn = m[:, :, 7] - m[:, :, 3]
    off = np.abs((turn[:, None, :] - turn[:, :, None] + np.float32(np.pi)) % np.float32(2 * np.pi) - np.float32(np.pi)) < 0.351
    out = (off.sum(axis=2) >= agree).any(axis=1)
    m, turn, off = m[out], turn[out], off[out]
    k = m[:, :, 6] / m[:, :, 2]
    c, s = (k * np.cos(turn))[:, :, None], (k * np.sin(turn))[:, :, None]
    dx, dy = m[:, None, :, 0] - m[:, :, None, 0], m[:, None, :, 1] - m[:, :, None, 1]
    x, y = m[:, :, None, 4] + c * dx - s * dy - m[:, None, :, 4], m[:, :, None, 5] + s * dx + c * dy - m[:, None, :, 5]
    off &= x * x + y * y <= ((PIXELS * np.maximum(1, k) + 0.05) ** 2)[:, :, None]
    out[out] = (off.sum(axis=2) >= agree).any(axis=1)
    return out


def marks(points: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Distinct 64-bit marks of an image: for each corner and table, its key, those of its two nearest corners at its scale and where they lie from it.

    Directions are taken from the corner's own angle, so turning changes none. Corners with fewer than two others at
    their scale give none.
    """
    out = []
    for size in np.unique(points[:, 2]):
        at = np.flatnonzero(points[:, 2] == size)
        n = len(at)
        if n < 3:
            continue
        x, y, angle, k = points[at, 0], points[at, 1], points[at, 3], keys[at].astype(np.uint64)
        step = max(1, AT_ONCE // n)
        for i in range(0, n, step):
            own = np.arange(i, min(n, i + step))
            far = (x[own, None] - x) ** 2 + (y[own, None] - y) ** 2
            far[np.arange(len(own)), own] = np.inf
            near = np.argpartition(far, 1, axis=1)[:, :2]
            turn = np.arctan2(y[near] - y[own, None], x[near] - x[own, None]) - angle[own, None]
            side = np.floor(turn % (2 * np.pi) * (DIRECTIONS / (2 * np.pi))).astype(np.uint64)
            for t in range(TABLES):
                with np.errstate(over="ignore"):
                    # the order of the two does not count
                    two = mix(k[near, t] * np.uint64(DIRECTIONS + 1) + side).sum(axis=1, dtype=np.uint64)
                    out.append(mix(two + mix(k[own, t] * np.uint64(TABLES) + np.uint64(t))))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def agrees(pa_: np.ndarray, ka: np.ndarray, pb: np.ndarray, kb: np.ndarray, agree: int) -> bool:
    """Whether that many corners of two images match in a table and lie on one similarity transform."""
    i, j = [], []
    step = max(1, AT_ONCE // max(1, len(kb)))
    for at in range(0, len(ka), step):
        x, y = np.nonzero((ka[at : at + step, None, :] == kb[None, :, :]).any(axis=2))
        i.append(x + at)
        j.append(y)
    m = np.concatenate([pa_[np.concatenate(i)], pb[np.concatenate(j)]], axis=1) if i else np.zeros((0, 8))
    if len(m) < agree or (len(m) ** 2 <= AT_ONCE and not _may_agree(m[None], agree)[0]):
        return False
    return consensus(m.astype(np.float64), agree) >= agree


def _tried(pairs: DataFrame, nodes: DataFrame, agree: int) -> DataFrame:
    """Those of pairs (u, v) that agree."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            sides = [[np.frombuffer(x, t).reshape(-1, 4) for x in b.column(c).to_pylist()] for c, t in (("pu", np.float32), ("ku", np.int32), ("pv", np.float32), ("kv", np.int32))]
            ok = pa.array([agrees(*x, agree) for x in zip(*sides, strict=True)], pa.bool_())
            return pa.record_batch([b.column("u").filter(ok), b.column("v").filter(ok)], ["u", "v"])

        return f

    side = lambda k: nodes.select(F.col("id").alias(k), F.col("points").alias("p" + k), F.col("keys").alias("k" + k))
    return arrow_map(pairs.join(side("u"), "u").join(side("v"), "v"), make, "u long, v long")


def _mixed(rest: DataFrame, comps: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Members (mark, id) with their component c, and marks with the most common one (lead), members, components (cs) and pairs of different ones (cross); marks of one component go.

    grows: a mark has more than FEW such pairs a member, and a tenth fewer components than before, if it was there.
    """
    known = rest.select("mark", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("mark", "id", F.coalesce("component", "id").alias("c"))
    sizes = known.groupBy("mark", "c").agg(F.count("*").cast("double").alias("n"))
    of = sizes.groupBy("mark").agg(F.max_by("c", F.struct("n", "c")).alias("lead"), F.sum("n").alias("members"), ((F.sum("n") ** 2 - F.sum(F.col("n") ** 2)) / 2).alias("cross"), F.count("*").alias("cs"))
    of = of.filter("cs > 1")
    of = of.withColumn("was", F.lit(None).cast("long")) if before is None else of.join(before.select("mark", F.col("cs").alias("was")), "mark", "left")
    return known, of.withColumn("grows", (F.col("cross") > FEW * F.col("members")) & F.coalesce(F.col("cs") <= 0.9 * F.col("was"), F.lit(True))).drop("was")


def _next_pairs(rest: DataFrame, turn: int) -> DataFrame:
    """Each member of a mark with the NEXT ones in an order drawn anew each turn, if they are of other components: NEXT pairs a member at most."""
    parts = rest.withColumn("part", F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("members") / PART)))
    drawn = Window.partitionBy("mark", "part").orderBy(F.xxhash64("id", F.lit(-1 - turn)), "id")
    others = F.array(*(F.struct(F.lead("id", i).over(drawn).alias("id"), F.lead("c", i).over(drawn).alias("c")) for i in range(1, NEXT + 1)))
    met = parts.select("id", "c", others.alias("others")).select("id", "c", F.explode("others").alias("o"))
    return met.filter("c <> o.c").select(F.least("id", "o.id").alias("u"), F.greatest("id", "o.id").alias("v"))


def _cross_pairs(rest: DataFrame) -> DataFrame:
    """All pairs of members of a mark that are of different components, each once: those outside the lead with the lead's, and among themselves."""
    parts = F.ceil(F.col("members") / PART)
    outside = rest.filter("c <> lead").select("mark", F.pmod(F.xxhash64("id"), parts).alias("part"), F.col("id").alias("u"), F.col("c").alias("cu"))
    every = rest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    pairs = outside.join(every, ["mark", "part"]).filter("cu <> c and (c = lead or u < id)")
    return pairs.select(F.least("u", "id").alias("u"), F.greatest("u", "id").alias("v"))


def _linked(members: DataFrame, agreeing: Callable[[DataFrame], DataFrame], shelf: Shelf) -> DataFrame:
    """(node, component) of the images that agreeing pairs of members link. members: mark, id and u, the mark's smallest id. See image_copies()."""
    rest = members.filter("u < id")
    tried = shelf.put(rest.select("u", F.col("id").alias("v")).distinct(), "pairs")
    comps = shelf.put(connected_components(forest(shelf.put(agreeing(tried), "edges")), shelf), "components")
    mixed, turn = None, 0
    while True:
        known, of = _mixed(rest, comps, mixed)
        mixed = shelf.put(of, "mixed")
        n, cross, grow = mixed.agg(F.sum("members"), F.sum("cross"), F.max("grows")).first()
        if not n:
            return comps
        rest = shelf.put(known.join(mixed, "mark").select("mark", "id", "c", "lead", "members", "grows"), "members")
        last = cross <= FEW * n or not grow
        pairs = _cross_pairs(rest) if last else _next_pairs(rest.filter("grows"), turn)
        new = shelf.put(pairs.distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
        found = shelf.put(agreeing(new), "edges")
        # what earlier links join is one link from each image to its component
        edges = comps.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(found)
        comps = shelf.put(connected_components(forest(edges), shelf), "components")
        if last:
            return comps
        tried, turn = tried.unionByName(new), turn + 1


def image_copies(images: DataFrame, agree: int = AGREE) -> DataFrame:
    """One row per row of images (image_id, width, height, pixels: grey bytes by row): image_id, n_corners, component_id.

    Images whose corners agree on a similarity transform are copies: cropped, shifted, turned, resized or brightened.
    component_id is the smallest image_id that such links reach. Equal pixels are one node, found by a digest. Tried
    are the pairs of images that share a mark (see marks()): first each mark's members with the smallest of them. It
    has then met them all and leaves the mark. If many pairs of different components are left, members of marks with
    many of them are tried with the next ones in a drawn order, as long as a mark's components fall with it, so that a
    large group of copies grows together at a few pairs a member; at last all pairs of different components, once each. A pair that shares a mark
    and could join two components is never left out. Pairs of images that share a mark and are no copies are all
    tried, which grows with the square of their number.

    Null or empty pixels, or pixels that don't fill width times height: no corners, linked with nothing. Null ids:
    component_id null. Rows that repeat an id and pixels get equal rows. An empty table gives no rows. Other columns
    are left out.
    """
    spark = images.sparkSession
    shelf = Shelf(spark, "media")

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            digest, points, keys = [], [], []
            for w, h, p in zip(b.column("width").to_pylist(), b.column("height").to_pylist(), b.column("pixels").to_pylist(), strict=True):
                good = p and w and h and len(p) == w * h
                k, d = corners(np.frombuffer(p, np.uint8).reshape(h, w)) if good else (np.zeros((0, 4)), np.zeros((0, TABLES), np.int32))
                digest.append(hashlib.blake2b(p + b"%d" % w, digest_size=16).digest() if len(k) else None)
                points.append(k.astype(np.float32).tobytes())
                keys.append(d.astype(np.int32).tobytes())
            return pa.record_batch([b.column("image_id"), *(pa.array(x, pa.binary()) for x in (digest, points, keys))], ["image_id", "digest", "points", "keys"])

        return f

    def make_marks():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [marks(np.frombuffer(p, np.float32).reshape(-1, 4), np.frombuffer(k, np.int32).reshape(-1, TABLES)) for p, k in zip(b.column("points").to_pylist(), b.column("keys").to_pylist(), strict=True)]
            ids = np.repeat(b.column("id").to_numpy(), [len(x) for x in found])
            return pa.record_batch([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), pa.array(ids, pa.int64())], ["mark", "id"])

        return f

    d = images.select(F.col("image_id").cast("long").alias("image_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels")
    seen = shelf.put(arrow_map(d, make, "image_id long, digest binary, points binary, keys binary"), "corners")
    reps = seen.filter("digest is not null and image_id is not null").groupBy("digest").agg(F.min("image_id").alias("id"))
    one = shelf.put(seen.select("digest", F.col("image_id").alias("id"), "points", "keys").join(reps, ["digest", "id"]).dropDuplicates(["digest"]).select("id", "points", "keys"), "nodes")
    every = shelf.put(arrow_map(one, make_marks, "mark long, id long"), "marks")
    shared = every.groupBy("mark").agg(F.min("id").alias("u"), F.max("id").alias("most")).filter("u < most").select("mark", "u")
    members = shelf.put(every.join(shared, "mark"), "members")
    shelf.drop(every)
    comps = _linked(members, lambda pairs: _tried(pairs, one, agree), shelf)
    named = reps.join(comps.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = seen.select("image_id", (F.length("points") / 16).cast("long").alias("n_corners"), "digest").join(named, "digest", "left")
    return out.select("image_id", "n_corners", F.when(F.col("image_id").isNotNull(), F.coalesce("component_id", "image_id")).alias("component_id"))


CELL, SIDE = 9, 8


def _mosaic(v: np.ndarray) -> np.ndarray:
    """A vector as an image: 8 by 8 cells, one for each of the first 64 components, mid grey where it has fewer."""
    g = np.zeros(SIDE * SIDE)
    g[: min(len(v), SIDE * SIDE)] = v[: SIDE * SIDE]
    g = 128 + 100 * np.tanh(4 * g)
    return np.kron(g.reshape(SIDE, SIDE), np.ones((CELL, CELL))).round().astype(np.uint8)


def vector_images(vectors: DataFrame, edited_every: int = 50) -> DataFrame:
    """The tables hold no images, so every row of vectors (vec_id, embedding) is drawn: image_id = 2 * vec_id.

    Of every edited_every-th vec_id a second image, 2 * vec_id + 1, is cropped by some pixels on all sides and brightened.
    Null vectors and ids give no image; null or non-finite components count as 0.
    """

    def run(batches):
        for b in batches:
            rows = []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                im = _mosaic(np.nan_to_num(np.array([0.0 if x is None else x for x in v]), posinf=0, neginf=0))
                rows.append((2 * i, im))
                if i % edited_every == 7:
                    k = 3 + i % 7
                    rows.append((2 * i + 1, np.clip(im[k : -k - 2, k + 1 : -k] * 0.9 + 18, 0, 255).astype(np.uint8)))
            yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([x.shape[1] for _, x in rows], pa.int32()), pa.array([x.shape[0] for _, x in rows], pa.int32()), pa.array([x.tobytes() for _, x in rows], pa.binary())], ["image_id", "width", "height", "pixels"])

    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    return v.mapInArrow(run, "image_id long, width int, height int, pixels binary")
