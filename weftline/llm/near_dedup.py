"""MinHash near-duplicate detection: universal hash minima, banding, signature verification, confirmation on full sets, star components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, arrow_map, lean, shingle_set, slices, text_bytes
from .components import connected_components

#: A pair at similarity 0.8 is missed with probability (1 - 0.8**ROWS)**BANDS = 1.3e-7.
BANDS, ROWS = 40, 5
#: Members around one centre that share a shingle at most, for it to be joined; more common ones are counted instead.
FEW = 32
#: Words of 64 bits that say which shingles of its centre a member lacks.
LACKS = 8
LACKING = [f"l{i}" for i in range(LACKS)]
#: Ids broadcast at most, 16 bytes each; beyond, the same join is shuffled.
BROADCAST_IDS = 1_000_000


@lru_cache(None)
def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n multiply-shift functions x -> (a x + b) >> 32 on 64 bits."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def minima(sets: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """uint32 minima [n, documents] of the non-empty sets that begin at starts in the concatenation."""
    a, b = _hash_family(n)
    out = np.empty((n, len(starts)), np.uint32)
    # whole documents a block, so that a block stays in the processor's cache; one longer document is a block of its own
    ends, at = np.append(starts[1:], len(sets)), 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + 32_768, "right")))
            x, s = sets[starts[at] : ends[to - 1]], starts[at:to] - starts[at]
            y = np.empty_like(x)
            for i in range(n):
                np.multiply(x, a[i], out=y)
                np.add(y, b[i], out=y)
                out[i, at:to] = np.minimum.reduceat(y, s) >> np.uint64(32)
            at = to
    return out


def _sign(k: int, bands: int, rows: int):
    """The minimum of (a x + b) has the minimum of its high half, so the shift comes after the minimum."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, k) for t in b.column("text").to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys: list = [None] * len(sets)
            sig: list = [None] * len(sets)
            if len(some):
                m = minima(np.concatenate([sets[i] for i in some]), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), bands * rows)
                low = np.ascontiguousarray(m.T.astype(np.uint16))
                banded = np.ascontiguousarray(m.reshape(bands, rows, -1).transpose(2, 0, 1))
                for j, i in enumerate(some):
                    sig[i] = low[j].tobytes()
                    keys[i] = [int.from_bytes(hashlib.blake2b(banded[j, q].tobytes(), digest_size=8, salt=q.to_bytes(2, "little")).digest(), "little", signed=True) for q in range(bands)]
            return pa.record_batch([b.column("doc_id"), b.column("row_hash"), pa.array(sizes), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "row_hash", "n_shingles", "digest", "bands", "sig"])

        return f

    return make


def _alike(least: float):
    """Pairs whose signatures agree as pairs above the threshold nearly always do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("sig_u", "sig_v"))
                yield b.select(["u", "v"]).filter(pa.array((x == y).mean(axis=1) >= least))

    return run


def _confirm(percent: int):
    """Pairs with 100 * intersection >= percent * union of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if b.num_rows:
                ok, last, x = [], None, None
                for s, t in zip(b.column("set_u"), b.column("set_v"), strict=True):
                    s = s.as_buffer()
                    if last is None or not s.equals(last):
                        last, x = s, np.frombuffer(s, np.uint64)
                    y = np.frombuffer(t.as_buffer(), np.uint64)
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    if 100 * len(small) < percent * len(large):
                        ok.append(False)
                        continue
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each member of a group and its centre: the sizes of both sets, what they share, the rest of the member's shingles, and which of the centre's it lacks.

    The lacking ones are bits in LACKS words, at places that the shingle's hash tells: bits set by either of two members
    are never more than the shingles of the centre that at least one of them lacks.
    """
    for b in slices(batches):
        if b.num_rows:
            n, n_c, both, rest, lacks = [], [], [], [], np.zeros((b.num_rows, LACKS), np.uint64)
            for i, (s, t) in enumerate(zip(b.column("set"), b.column("set_c"), strict=True)):
                x, c = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                on = c[np.minimum(np.searchsorted(c, x), len(c) - 1)] == x
                out = c[x[np.minimum(np.searchsorted(x, c), len(x) - 1)] != c]
                np.bitwise_or.at(lacks[i], (out >> np.uint64(6)) % np.uint64(LACKS), np.uint64(1) << (out & np.uint64(63)))
                n.append(len(x))
                n_c.append(len(c))
                both.append(int(on.sum()))
                rest.append(x[~on].view(np.int64))
            words = [pa.array(np.ascontiguousarray(lacks[:, i]).view(np.int64)) for i in range(LACKS)]
            yield pa.record_batch([*(b.column(x) for x in ("c", "id", "component", "off")), *(pa.array(x, pa.int64()) for x in (n, n_c, both)), pa.array(rest, pa.list_(pa.int64())), *words], ["c", "id", "component", "off", "n", "n_c", "both", "rest", *LACKING])


def _sets(k: int):
    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([b.column("id"), pa.array([shingle_set(t, k).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["id", "set"])

        return f

    return make


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text, ...): doc_id, n_shingles, component_id, kept and row_hash (xxhash64 of text).

    Documents are linked whose sets of distinct k-word shingles have 100 * intersection >= percent * union.
    component_id is the smallest doc_id that links reach; kept marks its holder. Sets are held as 64-bit hashes.

    Equal sets are one node, found by a digest before any pair is made, so exact copies cost no pairs. In each bucket
    of the bands the member in most company, as the original of copies is, is tried with all others; then the best of
    those it doesn't reach. In buckets that still hold several components, bounds from what each set shares with the
    bucket's centre tell which other pairs may link, and all of those are tried. No bucket is gathered or capped.

    Null or empty text, or text without words: an empty set, linked with nothing, its own component. Null doc_id:
    component_id null, kept true, and no links. Rows that repeat doc_id and text get equal rows. An empty table
    gives no rows. Other columns of docs are left out, so their names can't clash.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "near")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), text_bytes().alias("text"))
    signed = shelf.put(arrow_map(plain, _sign(k, bands, rows), "doc_id long, row_hash long, n_shingles long, digest binary, bands array<long>, sig binary", "words"), "signed")

    reps = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"))
    reps = shelf.put(reps, "reps")
    own = signed.select("digest", F.col("doc_id").alias("id"), "bands", "sig").join(reps, ["digest", "id"])
    member = own.select("id", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("top")).filter("low < top").select("bucket", "n")
    member = shelf.put(member.join(shared, "bucket"), "member")
    # the original of a group of copies is in the largest bucket of nearly every band: it is the best centre
    weight = shelf.put(member.groupBy("id").agg(F.sum("n").alias("weight")), "weight")

    ids = weight.select("id")
    few = ids.count() <= BROADCAST_IDS
    wanted = F.broadcast(ids) if few else ids
    sigs = shelf.put(own.select("id", "sig").join(wanted, "id"), "sigs")
    node = reps.join(wanted, "id")
    picked = signed.select("digest", "doc_id").join(F.broadcast(node) if few else node, "digest").filter("doc_id = id").select("id").distinct()
    texts = plain.drop("row_hash").withColumnRenamed("doc_id", "id").join(F.broadcast(picked) if few else picked, "id")
    sets = shelf.put(arrow_map(texts, _sets(k), "id long, set binary", "words"), "sets")

    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5

    def confirmed(pairs: DataFrame) -> DataFrame:
        """pairs (u, v), distinct: those that are links."""
        p = pairs.join(sigs.select(F.col("id").alias("v"), F.col("sig").alias("sig_v")), "v").join(sigs.select(F.col("id").alias("u"), F.col("sig").alias("sig_u")), "u")
        p = shelf.put(p.select("u", "v", "sig_u", "sig_v").mapInArrow(lean(_alike(least)), "u long, v long"), "alike")
        p = p.join(sets.select(F.col("id").alias("v"), F.col("set").alias("set_v")), "v").join(sets.select(F.col("id").alias("u"), F.col("set").alias("set_u")), "u")
        return p.select("u", "v", "set_u", "set_v").mapInArrow(lean(_confirm(percent)), "u long, v long").distinct()

    def stars(open_members: DataFrame) -> DataFrame:
        """(bucket, c): in each bucket the member in most company, of equals the smallest id."""
        best = open_members.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("neg"))).alias("best"))
        return best.select("bucket", (-F.col("best.neg")).alias("c"))

    centre = shelf.put(stars(member), "centre")
    first = member.select("bucket", "id").join(centre, "bucket").filter("id != c")
    tried = shelf.put(first.select(F.least("id", "c").alias("u"), F.greatest("id", "c").alias("v")).distinct(), "tried")
    links = shelf.put(confirmed(tried), "confirmed")
    comps = shelf.put(connected_components(links, shelf), "components")

    def still_open(m: DataFrame) -> DataFrame:
        """m (bucket, id, n) with component, in buckets that hold more than one."""
        m = m.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        several = m.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
        return m.join(several, "bucket")

    def extend(pairs: DataFrame) -> None:
        nonlocal tried, links, comps
        pairs = pairs.select(F.least("id", "c").alias("u"), F.greatest("id", "c").alias("v")).distinct()
        pairs = shelf.put(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        more = shelf.put(confirmed(pairs), "more")
        if not more.isEmpty():
            links = links.unionByName(more)
            comps = shelf.put(connected_components(links, shelf), "components")

    # the member in most company outside the leading component may be the original of another group
    m = shelf.put(still_open(member), "open")
    lead = m.join(centre.withColumnRenamed("c", "id"), ["bucket", "id"]).select("bucket", F.col("component").alias("lead"))
    outside = shelf.put(m.join(lead, "bucket").filter("component != lead").select("bucket", "id"), "outside")
    # of its buckets' such members each member takes the best, and each bucket the best of what its members took: so
    # neighbouring buckets are tried with the same few members
    best = outside.join(stars(outside), "bucket").join(weight.withColumnRenamed("id", "c"), "c")
    main = best.groupBy("id").agg(F.max(F.struct("weight", (-F.col("c")).alias("neg"))).alias("best"))
    c = outside.join(main, "id").groupBy("bucket").agg((-F.max("best")["neg"]).alias("c"))
    c = c.join(comps.select(F.col("node").alias("c"), F.col("component").alias("cc")), "c", "left").withColumn("cc", F.coalesce("cc", "c"))
    extend(m.join(c, "bucket").filter("component != cc").select("id", "c").distinct())

    # All pairs across components that are left, around the centre they share. What two sets share is at most what the
    # one with less of the centre shares with it, at most the centre without what either lacks of it, and the shingles
    # off the centre that both have. Shingles of few members are joined; those of many count for whoever has them. So
    # copies that random edits take too far from the original, which never link, make hardly any pairs, and no pair
    # that can link is left out. A set of which that leaves too little for any partner goes first.
    m = still_open(member)
    at = m.join(centre, "bucket").filter("id != c").select("c", "id", "component").distinct()
    at = at.join(comps.select(F.col("node").alias("c"), F.col("component").alias("cc")), "c", "left").withColumn("off", F.col("component") != F.coalesce("cc", "c"))
    at = at.join(sets, "id").join(sets.select(F.col("id").alias("c"), F.col("set").alias("set_c")), "c")
    at = shelf.put(at.select("c", "id", "component", "off", "set", "set_c").mapInArrow(lean(_beside), "c long, id long, component long, off boolean, n long, n_c long, both long, rest array<long>, " + ", ".join(f"{x} long" for x in LACKING)), "beside")
    rest = at.select("c", "id", "component", "off", F.explode("rest").alias("g"))
    counts = rest.groupBy("c", "g").agg(F.count("*").alias("times")).filter("times > 1")
    rest = shelf.put(rest.join(counts, ["c", "g"]), "rest")
    common = rest.filter(F.col("times") > FEW).groupBy("c", "id").agg(F.count("*").alias("common"))
    own = ["id", "component", "n", "n_c", "both", "common", *LACKING]
    at = at.drop("rest").join(common, ["c", "id"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    at = shelf.put(at.select("c", "off", *own), "around")
    two = lambda d, *cs: (d.filter("off").select("c", *(F.col(x).alias("o_" + x) for x in cs)), d.select("c", *(F.col(x).alias("x_" + x) for x in cs)))
    across = F.expr("o_component != x_component")
    either = sum((F.bit_count(F.col("o_" + x).bitwiseOR(F.col("x_" + x))) for x in LACKING[1:]), F.bit_count(F.col("o_l0").bitwiseOR(F.col("x_l0"))))
    quick = F.least(F.col("o_both") + F.col("o_common"), F.col("x_both") + F.col("x_common"))
    most = F.least(quick, F.col("o_n_c") - either + F.least("o_common", "x_common"))
    enough = lambda k: 100 * k >= percent * (F.col("o_n") + F.col("x_n") - k)
    o, x = two(at.filter(100 * (F.col("both") + F.col("common")) >= percent * F.col("n")), *own)
    near = o.join(x, (o["c"] == x["c"]) & across & enough(quick) & enough(most)).select(F.col("o_id").alias("id"), F.col("x_id").alias("c"))
    o, x = two(rest.filter(F.col("times") <= FEW).withColumnRenamed("g", "h"), "id", "component", "h")
    both = o.join(x, (o["c"] == x["c"]) & (F.col("o_h") == F.col("x_h")) & across).groupBy(o["c"], "o_id", "x_id").agg(F.count("*").alias("extra"))
    size = lambda p: at.select("c", *(F.col(x).alias(f"{p}_{x}") for x in own if x != "component"))
    both = both.join(size("o"), ["c", "o_id"]).join(size("x"), ["c", "x_id"]).filter(enough(most + F.col("extra")))
    extend(near.unionByName(both.select(F.col("o_id").alias("id"), F.col("x_id").alias("c"))))

    named = reps.join(comps.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "row_hash", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "row_hash")
