"""Near-duplicate documents by a signature-coordinate inverted join.

1. Each text becomes its set of word shingles, and that a MinHash signature of ``coordinates`` values. Documents
   with equal sets are one class, told by a 128-bit digest and represented by the least id.
2. Representatives are posted under (coordinate, value) pairs. Two signatures that agree in at least ``needed``
   places agree in one of any ``coordinates - needed + 1``, so only that prefix of the coordinates is posted.
3. Postings alone in their list are skipped. In two linear rounds each list links its members to one leader of it,
   pairs that meet in several lists being merged; the pairs whose whole signatures agree often enough are confirmed
   on the full sets and joined into components.
4. Lists whose members are by then all of one component are skipped. In the others the members of different
   components are compared, signature by signature, inside the task, which gives a forest of what may be near, never
   all pairs; a long list is dealt by pairs of its parts, or, where that takes more rows, split by a second coordinate
   first. What a forest joins is a family. Its members outside its largest component are compared with the whole family
   on full sets, slice by slice. Nothing is capped: every pair of the posted lists is either compared or already joined.

A pair at the threshold agrees in fewer than ``needed`` places with a probability of about two in a million.

Cases: null and empty texts and texts without words have an empty set and are linked with nothing; a text with
fewer words than a shingle is one shingle; rows that repeat an id count as one document of all their texts; a row
with a null id keeps a null component; very long texts are taken whole; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trim, written
from .components import connected_components

_CACHED = 200_000


@dataclass(frozen=True)
class Spec:
    """Shingle length in words, the threshold as a fraction, and the signature's shape."""

    words: int = 5
    numerator: int = 80
    denominator: int = 100
    coordinates: int = 64
    needed: int = 36
    seed: int = 1
    long_list: int = 4096
    tile_rows: int = 512
    broadcast_rows: int = 1_000_000

    @property
    def posted(self) -> int:
        return self.coordinates - self.needed + 1

    def multipliers(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(1, 1 << 63, self.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_HASHES = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash: every bit depends on all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles. Only A-Z are lowered and only ASCII space parts words."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, own), np.uint64, len(own))
    size = min(words, len(own))
    out = np.full(len(own) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(own) - size + 1 + i]
    return np.unique(mixed(out))


def minima(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The signature's values: for each multiplier the least product."""
    out = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(out, (hashes[i : i + 4096, None] * multipliers).min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, key: str, text: str, spec: Spec) -> DataFrame:
    """(id, n, d1, d2, posts, sig): set size, digest, hashed prefix coordinates, one byte a coordinate."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = spec.multipliers()
        place = np.arange(spec.coordinates, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        for batch in batches:
            rows = {k: [] for k in ("n", "d1", "d2", "posts", "sig")}
            for value in batch.column(1).to_pylist():
                own = shingles(value, spec.words)
                rows["n"].append(len(own))
                if not len(own):
                    for k in ("d1", "d2", "posts", "sig"):
                        rows[k].append(None)
                    continue
                digest = xxhash.xxh3_128_digest(own.tobytes())
                values = mixed(minima(own, multipliers) + place)
                rows["d1"].append(int.from_bytes(digest[:8], "little", signed=True))
                rows["d2"].append(int.from_bytes(digest[8:], "little", signed=True))
                rows["posts"].append(values.view(np.int64)[: spec.posted])
                rows["sig"].append((values & np.uint64(255)).astype(np.uint8).tobytes())
            kinds = {"n": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "posts": pa.list_(pa.int64()), "sig": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[k], kinds[k]) for k in kinds)], names=["id", *kinds])
        _HASHES.clear()
        trim()

    kind = docs.select(F.col(key).alias("id")).schema[0].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(signed, f"id {kind}, n long, d1 long, d2 long, posts array<long>, sig binary")


def agreeing(pairs: DataFrame, sigs: DataFrame, spec: Spec) -> DataFrame:
    """The (a, b) of ``pairs`` whose signatures agree in ``needed`` places and whose sizes allow the threshold."""
    own = sigs.select("id", "n", "sig")
    joined = pairs.join(own.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(own.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    joined = joined.where((F.least("na", "nb") * spec.denominator >= F.greatest("na", "nb") * spec.numerator)).select("a", "b", "sa", "sb")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, spec.coordinates) for i in (2, 3))
                keep = pa.array((x == y).sum(axis=1) >= spec.needed)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return joined.mapInArrow(compared, joined.select("a", "b").schema)


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, spec: Spec) -> DataFrame:
    """The (a, b) of ``pairs`` whose full shingle sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    own = set_table(docs, ids, key, text, spec)
    joined = pairs.join(own.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(own.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(spec.denominator * both >= spec.numerator * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = written(joined.mapInArrow(verified, joined.select("a", "b").schema), "links")
    own.unpersist()
    return out


class _Joined(dict):
    """Union-find over what it is asked for."""

    def root(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = self[up]
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(x), self.root(y)
        self[max(a, b)] = min(a, b)
        return a != b


def agreements(sigs: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """In how many places each of ``sigs`` agrees with ``sig``; up to 255."""
    same = sigs == sig
    if same.shape[1] % 8:
        return same.sum(axis=1)
    return (same.view(np.uint64).sum(axis=1, dtype=np.uint64) * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _crossing(rows: list[tuple], seen: _Joined, spec: Spec) -> list[tuple]:
    """Links that hold together what may be near in one list of (comp, n, sig, side): a forest over its components, never all pairs. What ``seen`` has joined is one component."""
    comps = [seen.root(r[0]) if r[0] in seen else r[0] for r in rows]
    if len(set(comps)) < 2:
        return []
    _, comp = np.unique(np.array(comps), return_inverse=True)
    size = np.array([r[1] for r in rows], np.int64)
    sig = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, spec.coordinates)
    side = np.array([r[3] for r in rows])
    inside = comp == np.bincount(comp).argmax()  # the largest component need not be a side twice
    at, out = np.arange(len(comps)), []
    for i in np.flatnonzero(side == 1) if side.any() else np.flatnonzero(~inside):
        other = np.flatnonzero((comp != comp[i]) & ((side == 2) if side[i] else (inside | (at > i))))
        near = other[agreements(sig[other], sig[i]) >= spec.needed]
        near = near[np.minimum(size[near], size[i]) * spec.denominator >= np.maximum(size[near], size[i]) * spec.numerator]
        for k in np.unique(comp[near], return_index=True)[1] if len(near) else ():
            if seen.join(comps[i], comps[near[k]]):
                out.append((comps[i], comps[near[k]]))
    return out


def crossing(lists: DataFrame, spec: Spec) -> DataFrame:
    """Links between components that share a list of (post, side, comp, n, sig) and have members whose signatures agree. Members of side 0 are all compared, those of side 1 only with those of side 2."""
    dealt = lists.repartition("post").sortWithinPartitions("post").select("post", "comp", "n", "sig", "side")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, seen = None, [], _Joined()
        for batch in batches:
            out = []
            for post, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if post != now:
                    out += _crossing(rows, seen, spec)
                    now, rows = post, []
                rows.append(tuple(row))
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], schema)
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in _crossing(rows, seen, spec)], schema)

    return dealt.mapInArrow(met, "a long, b long")


def parts(spec: Spec) -> Column:
    """In how many parts a list of ``members`` is cut; each member then goes to as many tiles."""
    return F.when(F.col("members") <= spec.long_list, F.lit(1)).otherwise(F.ceil(2 * F.col("members") / spec.long_list)).cast("int")


def tiled(lists: DataFrame, spec: Spec) -> DataFrame:
    """Lists of (post, id, members, ...) dealt by pairs of their parts, with the member's side in the tile: any two members are compared in one tile, and a tile has at most about ``long_list`` of them."""
    lists = lists.withColumn("__parts", parts(spec)).withColumn("__own", F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    side = F.when(F.col("__own") == F.col("__other"), 0).when(F.col("__own") < F.col("__other"), 1).otherwise(2)
    return lists.withColumn("side", side).withColumn("post", F.xxhash64("post", F.least("__own", "__other"), F.greatest("__own", "__other")))


def split(lists: DataFrame, spec: Spec) -> DataFrame:
    """Lists of (post, sig, ...) split by one more coordinate: two that agree in ``needed`` places share one beside that of the list among any ``posted`` others."""
    places = F.explode(F.sequence(F.lit(spec.coordinates - spec.posted + 1), F.lit(spec.coordinates)))
    return lists.withColumn("__place", places).withColumn("post", F.xxhash64("post", "__place", F.expr("substring(sig, __place, 1)"))).drop("__place")


def set_table(docs: DataFrame, ids: DataFrame, key: str, text: str, spec: Spec) -> DataFrame:
    """(id, set) of the shingle sets of the rows that a table of ids names; kept until released."""
    ids = written(ids, "ids")
    few = ids.count() <= spec.broadcast_rows  # a checked bound; beyond it the join is shuffled
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x, spec.words).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "set"])

    kind = ids.schema[0].dataType.simpleString()
    return texts.mapInArrow(sets, f"id {kind}, set binary").groupBy("id").agg(F.min("set").alias("set")).persist(StorageLevel.DISK_ONLY)


def _exact(held: list[tuple], comps: list[int], sets: list[bytes], ids: list[int], joined: _Joined, spec: Spec) -> list[tuple]:
    """Links that the threshold confirms between held (id, comp, set) and a batch, one for each pair of parts still apart."""
    own = [np.frombuffer(x[2], np.uint64) for x in held]
    other = [np.frombuffer(x, np.uint64) for x in sets]
    _, codes = np.unique(np.concatenate([*own, *other]), return_inverse=True)
    sizes = np.array([len(x) for x in other], np.int64)
    split = sum(map(len, own))
    mine, theirs = codes[:split], codes[split:]
    bounds = np.cumsum(sizes) - sizes
    flags = np.zeros(int(codes.max()) + 1, np.int32)
    label = np.array(comps)
    at, out = 0, []
    for (a, comp, _), words in zip(held, own, strict=True):
        codes_a = mine[at : at + len(words)]
        at += len(words)
        flags[codes_a] = 1
        both = np.add.reduceat(flags[theirs], bounds)
        flags[codes_a] = 0
        near = np.flatnonzero((label != comp) & (spec.denominator * both >= spec.numerator * (sizes + len(words) - both)))
        out += [(a, ids[k]) for k in near.tolist() if joined.join(comp, comps[k])]
    return out


def family_links(forest: DataFrame, comps: DataFrame, links: DataFrame, docs: DataFrame, key: str, text: str, spec: Spec) -> DataFrame:
    """The confirmed links between components that ``forest`` holds together.

    What the forest joins is a family. Its largest component is compared with nothing of its own; every other member
    is compared, on full sets, with the whole family. Both sides are cut, so that a task holds ``tile_rows`` such members
    at a time and about as many of the family stream past them; each tile gives a forest of links, never all pairs.
    """
    nodes = connected_components(links.union(forest), "a", "b").withColumnRenamed("component", "family").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).select(F.col("node").alias("id"), "family", "comp")
    by = nodes.groupBy("family", "comp").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("comps")).where("comps > 1")
    by = by.select("family", "main", *(F.ceil(F.greatest(n, F.lit(1)) / spec.tile_rows).cast("int").alias(name) for name, n in (("slices", F.col("all") - F.col("most")), ("stripes", F.col("all")))))
    nodes = written(nodes.join(by, "family"), "families")
    sets = set_table(docs, nodes.select("id").distinct(), key, text, spec)
    both = nodes.join(sets, "id")
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = both.where("comp != main").select("family", own("slices", 1).alias("slice"), every("stripes").alias("stripe"), F.lit(0).alias("side"), "id", "comp", "set")
    passing = both.select("family", every("slices").alias("slice"), own("stripes", 2).alias("stripe"), F.lit(1).alias("side"), "id", "comp", "set")
    tile = F.xxhash64("family", "slice", "stripe").alias("tile")
    dealt = held.union(passing).withColumn("tile", tile).repartition("family", "tile").sortWithinPartitions("family", "tile", "side").select("family", "tile", "side", "id", "comp", "set")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, joined = None, [], _Joined()
        for batch in batches:
            families, tiles, sides, ids, comps, sets = (c.to_pylist() for c in batch.columns)
            out, at = [], 0
            while at < len(ids):
                here = (families[at], tiles[at])
                if here != now:
                    now, own, joined = here, [], _Joined()
                end = at
                while end < len(ids) and (families[end], tiles[end], sides[end]) == (*here, sides[at]):
                    end += 1
                if sides[at] == 0:
                    own += zip(ids[at:end], comps[at:end], sets[at:end], strict=True)
                elif own:
                    out += _exact(own, comps[at:end], sets[at:end], ids[at:end], joined, spec)
                at = end
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], schema)

    out = written(dealt.mapInArrow(compared, "a long, b long"), "links")
    sets.unpersist()
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", spec: Spec = Spec()) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row; kept is true for the row whose id is its component's. Ids are integers.

    Each step is written, not cached: a cached table carries the plans it came from into each later plan, and keeps
    their shuffle files.
    """
    sigs = written(signatures(docs, key, text, spec), "signatures")
    classes = sigs.where(F.col("n") > 0).groupBy("d1", "d2").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "n", "posts", "sig")).alias("r"))
    reps = written(classes.select("d1", "d2", "r.id", "r.n", "r.posts", "r.sig"), "classes")
    own = reps.where(F.col("id").isNotNull())
    posts = own.select("id", F.explode("posts").alias("post"))
    several = posts.groupBy("post").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("post", "first", "last")
    posts = written(posts.join(several, "post"), "posts")

    def linked(pairs: DataFrame) -> DataFrame:
        near = written(agreeing(pairs.where("a != b").distinct(), own, spec), "near")
        return confirmed(near, docs, key, text, spec)

    # Two linear rounds: each list's first member, then, where it did not hold all, its last.
    links = linked(posts.select(F.col("id").alias("a"), F.col("first").alias("b")))
    comps = connected_components(links, "a", "b")
    labelled = lambda df: df.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    several = lambda df: df.join(df.groupBy("post").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members")).where("low < high"), "post")
    left = written(several(labelled(posts.drop("first"))), "lists")
    other = left.where("comp != high").select(F.col("id").alias("a"), F.col("last").alias("b"))
    links = links.union(linked(other))
    comps = connected_components(links, "a", "b")
    # What is still of several components is compared, list by list, and what may be near then family by family.
    left = written(several(labelled(left.select("post", "id"))), "lists")
    columns = ["post", "side", "comp", "n", "sig"]
    signed = left.join(own.select("id", "n", "sig"), "id")
    lists = tiled(signed.where(parts(spec) <= spec.posted), spec).select(columns)
    longer = signed.where(parts(spec) > spec.posted)  # parts would take more rows than a second coordinate
    if left.where(parts(spec) > spec.posted).limit(1).count():
        lists = lists.union(tiled(written(several(split(longer.drop("low", "high", "members"), spec)), "lists"), spec).select(columns))
    forest = written(crossing(lists, spec), "forest")
    links = links.union(family_links(forest, comps, links, docs, key, text, spec))
    comps = connected_components(links, "a", "b")
    found = reps.select("d1", "d2", F.col("id").alias("rep")).join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("c"))
    joined = sigs.select("id", "n", "d1", "d2").join(found, ["d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    result = joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(key) == F.col("component_id"))
    return written(result, "near_duplicates")
