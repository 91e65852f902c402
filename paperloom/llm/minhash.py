"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard.

Two permutations of the 32-bit universe do all the work (Li and Li, 2022): the
first scrambles a shingle's place, the second, shifted circularly by k steps,
gives the k-th signature coordinate.  Coordinates are banded; members of a band
bucket are candidates; a link needs the exact Jaccard similarity of the full
shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import vectext as V
from paperloom.llm.common import cut, small_batches
from paperloom.llm.graph import connected_components

SHINGLE = 5
THRESHOLD = 75  # per cent
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Least share of equal signature coordinates at which a candidate is verified:
#: over five standard errors below the threshold.
ESTIMATE = 0.55
#: Coordinates of the wide sketch, and the share of them for a candidate inside a bucket
#: (nearly four standard errors below the threshold).
WIDE, WIDE_ESTIMATE = 1024, 0.70
#: Members of a bucket that one task compares with one another at most; larger buckets are tiled.
TILE = 1024
#: Bits of the fixed-size filter of ids whose sets are needed (8 MB), whatever the corpus.
FILTER_BITS = 1 << 26

_PRIMES = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_FIRST = (np.uint32(0x9E3779B1), np.uint32(0x7FEB352D))
_STEP = np.uint32(0x5BD1E995)


def _permute(x: np.ndarray, keys: tuple) -> None:
    """A bijection on 32-bit words, in place."""
    x ^= x >> np.uint32(16)
    x *= keys[0]
    x ^= x >> np.uint32(13)
    x *= keys[1]
    x ^= x >> np.uint32(16)


def signatures(sets: np.ndarray, bounds: np.ndarray, count: int = COORDINATES) -> np.ndarray:
    """The first ``count`` signature coordinates (rows x count, uint32) of non-empty sets."""
    place = (sets >> np.uint64(32)).astype(np.uint32)
    _permute(place, _FIRST)
    rows = len(bounds) - 1
    out = np.empty((rows, count), dtype=np.uint32)
    if not rows:
        return out
    shifted, spare = np.empty_like(place), np.empty_like(place)
    starts = bounds[:-1]
    shift = np.uint32(0)
    with np.errstate(over="ignore"):
        for k in range(count):
            np.subtract(place, shift, out=shifted)
            for bits, key in ((16, _PRIMES[0]), (13, _PRIMES[1])):
                np.right_shift(shifted, np.uint32(bits), out=spare)
                np.bitwise_xor(shifted, spare, out=shifted)
                np.multiply(shifted, key, out=shifted)
            np.right_shift(shifted, np.uint32(16), out=spare)
            np.bitwise_xor(shifted, spare, out=shifted)
            out[:, k] = np.minimum.reduceat(shifted, starts)
            shift = np.uint32((int(shift) + int(_STEP)) & 0xFFFFFFFF)
    return out


def band_hashes(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band; the band's number is part of it."""
    wide = coordinates.astype(np.uint64).reshape(len(coordinates), BANDS, ROWS)
    total = np.zeros((len(coordinates), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        total = V.mix64(total + wide[:, :, r] + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % (1 << 64)))
    return V.mix64(total + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, last, sets, bounds in V.shingle_sets(batch.column(1), SHINGLE):
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            kept = np.concatenate((bounds[:-1][full], bounds[-1:]))
            coordinates = signatures(sets, kept)
            bands = band_hashes(coordinates).view(np.int64)
            sketch = (coordinates & np.uint32(255)).astype(np.uint8)
            raw = sets.tobytes()
            keys, places, sketches = [None] * len(sizes), np.zeros(len(sizes) + 1, np.int32), [None] * len(sizes)
            for k, i in enumerate(full.tolist()):
                keys[i] = hashlib.blake2b(raw[bounds[i] * 8 : bounds[i + 1] * 8], digest_size=16).digest()
                sketches[i] = sketch[k].tobytes()
            places[1:][full] = BANDS
            np.cumsum(places, out=places)
            lists = pa.ListArray.from_arrays(pa.array(places), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(sizes.astype(np.int64)), pa.array(keys, pa.binary()), lists, pa.array(sketches, pa.binary())], schema=_FEATURES)


def _similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= THRESHOLD * (len(x) + len(y) - common)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = pa.array([_similar(x, y) for x, y in zip(a, b)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)


def _filter_words(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ids (two bits each) of a fixed size, built on the executors."""
    h = F.xxhash64("id")
    bits = ids.select(F.explode(F.array(F.pmod(h, F.lit(FILTER_BITS)), F.pmod(F.shiftright(h, 28), F.lit(FILTER_BITS)))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(bit, 32) as int))")).alias("mask"))
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    found = words.toArrow()
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy().astype(np.uint32)
    return out


def _needed(docs: DataFrame, ids: DataFrame, wide: bool) -> DataFrame:
    """(id, value) of the documents in ``ids`` (a column id).

    value: the wide sketch, or the full shingle set as sorted 64-bit words.
    A filter of fixed size drops most other documents before the exact join.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_filter_words(ids))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            h = batch.column(2).to_numpy()
            inside = np.ones(len(h), dtype=bool)
            for g in (h % FILTER_BITS, (h >> 28) % FILTER_BITS):
                inside &= (words[g >> 5] >> (g & 31).astype(np.uint32)) & np.uint32(1) == 1
            batch = batch.filter(pa.array(inside))
            for first, last, hashes, bounds in V.shingle_sets(batch.column(1), SHINGLE):
                if wide:
                    full = np.diff(bounds) > 0
                    kept = np.concatenate((bounds[:-1][full], bounds[-1:]))
                    raw = (signatures(hashes, kept, WIDE) & np.uint32(255)).astype(np.uint8).tobytes()
                    at = np.concatenate(([0], np.cumsum(full) * WIDE)).tolist()
                else:
                    raw, at = hashes.tobytes(), (bounds * 8).tolist()
                value = pa.array([raw[i:j] for i, j in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), value], names=["id", "value"])

    found = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).where("doc_id is not null").mapInArrow(values, "id long, value binary")
    return found.where(F.octet_length("value") > 0).join(ids, "id", "left_semi").dropDuplicates(["id"])


def _confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = cut(_needed(docs, ids, wide=False), "sets")
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("value").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("value").alias("right")), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(_verified, "a long, b long")


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, COORDINATES) for k in (2, 3))
        keep = (x == y).sum(axis=1) >= ESTIMATE * COORDINATES
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches agree in at least ESTIMATE of the coordinates."""
    joined = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(_close, "a long, b long")


def _tile_pairs(table: pa.Table) -> pa.Table:
    """Pairs of one tile that lie in different components and whose wide sketches agree.

    A pair that also shares the bucket of an earlier band (the whole hash, as
    the bucket's) was met there or settled with a hub, so it is named once.
    """
    ids, comps = table.column("id").to_numpy(), table.column("component").to_numpy()
    side = table.column("side").to_numpy()
    sketch = np.frombuffer(b"".join(table.column("value").to_pylist()), np.uint8).reshape(len(ids), WIDE)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)
    earlier = bands[:, : table.column("band")[0].as_py()] if len(ids) else bands
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side != 0)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in left.tolist():
        js = right[comps[right] != comps[i]]
        if side[i] == 2:
            js = js[js > i]
        if len(js):
            js = js[(sketch[js] == sketch[i]).sum(axis=1) >= WIDE_ESTIMATE * WIDE]
            js = js[~(earlier[js] == earlier[i]).any(axis=1)]
            b.append(ids[js])
            a.append(np.full(len(js), ids[i]))
    x, y = np.concatenate(a), np.concatenate(b)
    return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _bucket_pairs(docs: DataFrame, members: DataFrame, labels: DataFrame, bands: DataFrame) -> DataFrame:
    """Candidates inside buckets that still hold more than one component.

    Pairs with the bucket's hub are settled already and left out.  A bucket of
    more than TILE members is cut into slices and compared slice by slice, so
    no task holds more than two slices.  ``bands``: (id, bands), the bucket
    hashes of every document.
    """
    others = members.where("n > 2 and id <> hub").join(labels, "id", "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("component"))
    mixed = others.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / TILE)).cast("int")
    mixed = cut(mixed.select("bucket", slices.alias("g")), "buckets")
    rows = cut(others.join(mixed, "bucket"), "mixed")
    sketches = cut(_needed(docs, cut(rows.select("id").distinct(), "ids"), wide=True).join(bands, "id"), "wide")
    rows = rows.withColumn("s", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    sided = rows.select("bucket", "band", "id", "component", F.col("s"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
    tiles = sided.select("bucket", "band", "id", "component", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), F.when(F.col("s") == F.col("o"), 2).when(F.col("s") < F.col("o"), 0).otherwise(1).alias("side"))
    return tiles.join(sketches, "id").groupBy("bucket", "i", "j").applyInArrow(_tile_pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): its near-duplicate group.

    Result: doc_id, n_shingles (distinct five-word shingles), component_id (the
    least doc_id reachable over links), kept (doc_id = component_id), class_id
    (the least doc_id with the same shingle set).  Links: 100 * intersection >=
    75 * union, confirmed on the full sets.

    * Documents with the same set form a class; only class representatives are
      compared, so copies cost nothing, however many.
    * In a bucket every member is first compared with the bucket's least id.
      Only members that then still lie in different components are compared
      with one another, after the sketch estimate.
    * A null or blank text has no shingles and is linked with nothing.  A row
      without doc_id can't be linked; it is returned with component_id null and
      kept true.  Repeated rows each give a row.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = cut(docs.mapInArrow(_features, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary"), "features")
    usable = features.where("doc_id is not null and set_key is not null")
    classes = cut(usable.groupBy("set_key").agg(F.min("doc_id").alias("class_id")), "classes")
    reps = usable.join(classes, "set_key").where("doc_id = class_id")
    sketches = cut(reps.select(F.col("doc_id").alias("id"), "sketch", "bands").dropDuplicates(["id"]), "sketches")

    banded = sketches.select("id", F.posexplode("bands").alias("band", "bucket"))
    # from a file, so that the join either broadcasts them or splits the rows of a hot bucket
    buckets = cut(banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = cut(banded.join(buckets, "bucket"), "members")
    slim = sketches.select("id", "sketch")

    first = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = cut(_confirm(docs, cut(_likely(first, slim), "pairs")), "confirmed")
    labels = cut(connected_components(links, "a", "b"), "labels")
    rest = cut(_bucket_pairs(docs, members, labels, sketches.select("id", "bands")), "pairs")
    if not rest.isEmpty():
        links = links.union(_confirm(docs, rest))
        labels = cut(connected_components(links, "a", "b"), "labels")

    found = classes.join(labels.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select("set_key", "class_id", F.coalesce("component", "class_id").alias("component"))
    out = features.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that have a smaller one in their group.

    Rows without doc_id, null and blank texts stay, as they are linked with
    nothing; rows that share a doc_id stay or go together.  No rows, no result.
    """
    gone = cut(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
