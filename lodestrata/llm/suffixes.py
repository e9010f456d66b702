"""Removal of repeated substrings by a sparse suffix array, built as a distributed merge sort.

Every string of ``length`` bytes has one anchor: the leftmost of its 32-byte grams with the least hash. Equal
strings have equal anchors, so of all suffixes only those that begin at anchors are sorted, about one in ninety.

1. Anchors' hashes are counted; those that occur twice mark a bitmap of bounded size, which every task gets. A bit
   set by chance costs work, never a result.
2. Each task takes the suffixes at marked anchors, up to the last byte that a string with this anchor reaches, and
   the bytes before them from where the first such string starts. Suffixes with equal surroundings meet at once:
   all their strings are repeated, and one of them stands for all. The others are sorted, front-coded, compressed,
   and exchanged as runs, dealt by the anchor's hash. An anchor with very many suffixes is split: its strings are told
   apart by how far before the anchor they start, and each band of starts is dealt by the bytes that its strings share.
3. The runs are combined by a loser tree that never compares a known prefix again. The prefixes that neighbours share
   in its order decide: a string that starts l bytes before its anchor is repeated if another suffix shares all but l
   of the ``length`` bytes with its own, and the l bytes before. For each l the merged order falls into blocks by shared
   prefixes, the order of what stands before into blocks by shared ends, and suffixes of the same two blocks repeat.
   What is repeated goes back as ranges of starts, document by document.
4. Documents drop the bytes that the ranges cover.

Cases: null and empty texts, and those shorter than ``length``, lose nothing; repeated rows repeat all their
strings, and one id with several texts counts as several documents; rows with a null id take part; very long texts
are taken whole, in pieces that overlap; overlapping repeats in one text count; empty tables give empty results.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole, written
from .losertree import common_prefix, decoded, front_coded, merged

GRAM = 32
#: Into how many bands the starts of a hot anchor's strings are split.
BANDS = 8
_PIECE = 1 << 17
_PLACE = np.uint64((1 << 24) - 1)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEPS = np.random.default_rng(21).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each place on, from those of powers of two."""
    power, size, out, done = _BYTES[data], 1, None, 0
    while True:
        if length & size:
            out = power if out is None else out[: len(power) - done] * _STEPS[size.bit_length() + 30] + power[done:] if len(power) > done else out[:0]
            done += size
        if size * 2 > length:
            break
        power = power[: max(0, len(power) - size)] * _STEPS[size.bit_length()] + power[size:]
        size *= 2
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def _least(values: np.ndarray, window: int) -> np.ndarray:
    span = 1
    while span < window:
        step = min(span, window - span)
        values = np.minimum(values[:-step], values[step:])
        span += step
    return values


def anchors(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(place, first start, last start, hash) of each anchor for the valid starts of ``length``-byte strings."""
    found = []
    for at in range(0, len(data) - length + 1, _PIECE):
        part = data[at : at + _PIECE + length - 1]
        hashes = string_hashes(part, GRAM)
        keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        place = (_least(keys, length - GRAM + 1) & _PLACE).astype(np.int64)
        ok = valid[at : at + len(place)]
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        keep = ok[first]
        first, last = first[keep], last[keep]
        found.append((place[first] + at, first + at, last + at, hashes[place[first]]))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class _Texts:
    """Texts of one batch, joined; which starts have a whole string in one text."""

    def __init__(self, texts: list[str], length: int):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"".join(parts)
        self.bounds = np.cumsum([0, *map(len, parts)])
        self.array = np.frombuffer(self.data, np.uint8)
        self.valid = np.ones(len(self.array), bool)
        for begin, end in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            self.valid[max(begin, end - length + 1) : end] = False
        self.anchors = anchors(self.array, self.valid, length)


def _batches(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut so that the texts of each have about ``most`` bytes."""
    for batch in batches:
        begin, total = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            total += n or 0
            if total >= most or i + 1 == batch.num_rows:
                own = batch.slice(begin, i + 1 - begin)
                yield own, [x or "" for x in own.column(column).to_pylist()]
                begin, total = i + 1, 0


def repeated_anchors(texts: DataFrame, length: int, most_bits: int, hot_from: int, most_hot: int = 1 << 16) -> tuple[bytes, int, int, np.ndarray]:
    """A bitmap of the hashes of anchors that occur twice, the number of its bits (at most ``most_bits``), the anchors counted, and the hashes of the hot ones.

    Hot are those that occur ``hot_from`` times, or more where the input is so large that over ``most_hot`` could be hot.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values in _batches(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(_Texts(values, length).anchors[3].view(np.int64))], names=["hash"])

    counted = texts.select("text").mapInArrow(hashed, "hash long").groupBy("hash").agg(F.count("*").alias("n"))
    twice = written(counted.where("n > 1").select("hash", "n"), "anchors")
    rows, total = twice.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = 1 << 16
    while bits < min(16 * rows, most_bits):
        bits *= 2
    hot = twice.where(F.col("n") >= max(hot_from, total // most_hot)).select("hash").toArrow()["hash"].to_numpy()
    bit = F.shiftrightunsigned("hash", 24).bitwiseAND(F.lit(bits - 1).cast("long"))
    rows = twice.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("word")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows["place"].to_numpy()] = rows["word"].to_numpy()
    return words.tobytes(), bits, total, np.sort(hot)


def packed(entries: list[tuple[bytes, bytes, int, bytes]]) -> bytes:
    """A sorted run of (right, left, row, start) as front-coded and compressed bytes; row -1 stands for several."""
    out = bytearray()
    for (shared, rest), (_, left, row, start) in zip(front_coded(e[0] for e in entries), entries, strict=True):
        out += shared.to_bytes(2, "little") + len(rest).to_bytes(2, "little") + len(left).to_bytes(2, "little") + row.to_bytes(4, "little", signed=True) + start.to_bytes(8, "little") + rest + left
    return zstandard.ZstdCompressor(level=1).compress(bytes(out))


def unpacked(run: bytes) -> Iterator[tuple[int, bytes, tuple[bytes, int, int]]]:
    data = zstandard.ZstdDecompressor().decompress(run)
    at = 0
    while at < len(data):
        shared, rest, left = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (0, 2, 4))
        row = int.from_bytes(data[at + 6 : at + 10], "little", signed=True)
        start = int.from_bytes(data[at + 10 : at + 18], "little")
        at += 18
        yield shared, data[at : at + rest], (data[at + rest : at + rest + left], row, start)
        at += rest + left


def _exchanged(texts: DataFrame, bitmap, bits: int, parts: int, length: int, hot: np.ndarray) -> DataFrame:
    """(part, run, ids, ties, id, tie, first, last): runs for the merge with the ids of their rows, and ranges known to repeat."""
    id_type = texts.schema["id"].dataType.simpleString()
    arrow_id = pa.int64()
    schema = pa.schema([("part", pa.int32()), ("run", pa.binary()), ("ids", pa.list_(arrow_id)), ("ties", pa.list_(pa.int64())), ("id", arrow_id), ("tie", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(bitmap.value, np.uint64)
        band = -(-(length - GRAM + 1) // BANDS)
        for batch, values in _batches(batches, 2):
            ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = _Texts(values, length)
            place, first, last, hashes = own.anchors
            bit = (hashes.view(np.uint64) >> np.uint64(24)) & np.uint64(bits - 1)
            hit = np.flatnonzero((marks[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
            place, first, last = (x[hit].tolist() for x in (place, first, last))
            keys = hashes[hit].view(np.uint64)
            part, piece = (keys % np.uint64(parts)).astype(np.int64).tolist(), [0] * len(place)
            for i in np.flatnonzero(np.isin(keys.view(np.int64), hot)).tolist():
                # The band of starts from ``least`` to ``least + band - 1`` bytes before the anchor; the first takes the place of the whole.
                bands = [(n, max(first[i], place[i] - n * band - band + 1), min(last[i], place[i] - n * band)) for n in range((place[i] - last[i]) // band, (place[i] - first[i]) // band + 1)]
                for k, (n, low, high) in enumerate(bands):
                    at = place[i] - n * band
                    to = xxhash.xxh3_64_intdigest(own.data[at : at - band + 1 + length], n) % parts
                    if k:
                        for column, value in ((place, place[i]), (first, low), (last, high), (part, to), (piece, n + 1)):
                            column.append(value)
                    else:
                        new = (low, high, to, n + 1)
                first[i], last[i], part[i], piece[i] = new
            rows = (np.searchsorted(own.bounds, np.array(first, np.int64), "right") - 1).tolist()
            met: dict[tuple, list[int]] = {}
            data = own.data
            for i in range(len(place)):
                met.setdefault((part[i], bytes([piece[i]]) + data[place[i] : last[i] + length], data[first[i] : place[i]]), []).append(i)
            known: list[int] = []
            runs: dict[int, list[tuple]] = {}
            for (p, right, left), where in met.items():
                if len(where) > 1:
                    known += where
                    runs.setdefault(p, []).append((right, left, -1, 0))
                else:
                    row = rows[where[0]]
                    runs.setdefault(p, []).append((right, left, row, first[where[0]] - int(own.bounds[row])))
            out = []
            for p, entries in runs.items():
                entries.sort()
                used = sorted({e[2] for e in entries if e[2] >= 0})
                number = {row: n for n, row in enumerate(used)}
                out.append({"part": p, "run": packed([(r, left, number.get(row, -1), s) for r, left, row, s in entries]), "ids": [ids[x] for x in used], "ties": [ties[x] for x in used]})
            known.sort(key=first.__getitem__)
            open_range = None
            for i in known:  # neighbours become one range
                base = int(own.bounds[rows[i]])
                if open_range and open_range[0] == rows[i] and open_range[2] + 1 >= first[i] - base:
                    open_range[2] = max(open_range[2], last[i] - base)
                    continue
                if open_range:
                    out.append({"part": -1 - open_range[0] % parts, "id": ids[open_range[0]], "tie": ties[open_range[0]], "first": open_range[1], "last": open_range[2]})
                open_range = [rows[i], first[i] - base, last[i] - base]
            if open_range:
                out.append({"part": -1 - open_range[0] % parts, "id": ids[open_range[0]], "tie": ties[open_range[0]], "first": open_range[1], "last": open_range[2]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return texts.select("id", "tie", "text").mapInArrow(sorted_runs, f"part int, run binary, ids array<{id_type}>, ties array<long>, id {id_type}, tie long, first long, last long")


def _repeats(rights: list[int], shared: list[int], lefts: list[bytes], groups: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(entry, first, last) ranges of starts in each entry's context whose strings another entry of its group has too.

    Entries are in merged order: ``rights`` are the lengths of their suffixes, ``shared`` the prefixes in common with
    the entry before, ``lefts`` what stands before, and no two have both in common.
    """
    n = len(rights)
    group = np.array(groups)
    right = np.where(np.concatenate([[True], group[1:] != group[:-1]]), -1, np.array(shared))
    turned = [x[::-1] for x in lefts]
    order = sorted(range(n), key=lambda i: (groups[i], turned[i]))
    left = np.full(n, -1)
    for k in range(1, n):
        if groups[order[k]] == groups[order[k - 1]]:
            left[k] = common_prefix(turned[order[k - 1]], turned[order[k]])
    order = np.array(order)
    marks = np.zeros((n, length - GRAM + 1), bool)
    block = np.empty(n, np.int64)
    for back in range(length - GRAM + 1):
        apart = right < length - back
        met = ~apart | np.concatenate([~apart[1:], [False]])
        if not met.any():
            continue
        block[order] = np.cumsum(left < back)
        here = np.flatnonzero(met)
        both = np.cumsum(apart)[here] * (n + 1) + block[here]
        _, place, count = np.unique(both, return_inverse=True, return_counts=True)
        marks[here, back] = count[place] > 1
    sizes = np.array([len(x) for x in lefts])
    edges = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    entry, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)
    yield from zip(entry.tolist(), (sizes[entry] - high + 1).tolist(), (sizes[entry] - low).tolist(), strict=True)


def _combined(runs: list[tuple[bytes, list, list]], length: int, most: int = 1 << 14) -> Iterator[tuple]:
    """(id, tie, first, last) of the repeated strings in the runs of one part."""

    def entries_of(n: int) -> Iterator[tuple[int, bytes, tuple]]:
        return ((s, key, (left, row, start, n)) for s, key, (left, row, start) in decoded(unpacked(runs[n][0])))

    def given(load: tuple, first: int, last: int) -> tuple:
        _, row, start, n = load
        return runs[n][1][row], runs[n][2][row], start + first, start + last

    # Entries of different contexts that share a gram wait: length of the suffix, prefix shared with the one before, load or None, group.
    waiting: list[tuple[int, int, bytes, tuple | None, int]] = []
    group: list[tuple[int, int, bytes, tuple | None, int]] = []
    same: dict[bytes, int] = {}
    number = 0

    def flushed() -> Iterator[tuple]:
        rights, shared, lefts, loads, groups = map(list, zip(*waiting, strict=True))
        for e, first, last in _repeats(rights, shared, lefts, groups, length):
            if loads[e] is not None:
                yield given(loads[e], first, last)

    for shared, key, load in merged([entries_of(n) for n in range(len(runs))]):
        prefix, right, left = shared - 1, len(key) - 1, load[0]  # before the suffix stands the number of its band
        if prefix < GRAM:
            if len(group) > 1:
                waiting += group
                if len(waiting) >= most:
                    yield from flushed()
                    waiting = []
            group, same, number = [], {}, number + 1
        elif prefix < right or right != group[-1][0]:
            same = {}
        if (k := same.get(left)) is not None:  # the same surroundings once more: all their strings are repeated
            whole = (0, len(left) + right - length)
            before = group[k]
            if before[3] is not None:
                yield given(before[3], *whole)
                group[k] = (*before[:3], None, before[4])
            if load[1] >= 0:
                yield given(load, *whole)
            continue
        same[left] = len(group)
        group.append((right, prefix, left, load if load[1] >= 0 else None, number))
    if len(group) > 1:
        waiting += group
    if waiting:
        yield from flushed()


def repeated_ranges(texts: DataFrame, length: int = 200, parts: int | None = None, most_bits: int = 1 << 27, hot_from: int = 4096, part_bytes: int = 1 << 23) -> DataFrame:
    """(id, tie, first, last): ranges of starts of repeated strings, for texts given as (id, tie, text); there are so many parts that each has about ``part_bytes``."""
    spark = texts.sparkSession
    bitmap, bits, total, hot = repeated_anchors(texts, length, most_bits, hot_from)
    parts = parts or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * length * total // part_bytes)
    shared = spark.sparkContext.broadcast(bitmap)
    runs = _exchanged(texts, shared, bits, parts, length, hot)
    dealt = runs.repartition("part").sortWithinPartitions("part")
    schema = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []

        def given(found) -> Iterator[pa.RecordBatch]:
            columns = list(zip(*found, strict=True))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            known = pc.less(batch.column(0), 0)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(known) for i in (4, 5, 6, 7)], schema=schema)
            rest = batch.filter(pc.invert(known))
            for part, run, ids, ties in zip(*(rest.column(i).to_pylist() for i in range(4)), strict=True):
                if part != now:
                    yield from given(_combined(own, length))
                    now, own = part, []
                own.append((run, ids, ties))
        yield from given(_combined(own, length))

    id_type = texts.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(combined, f"id {id_type}, tie long, first long, last long")


def removed(data: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """What is left of ``data`` without the bytes covered by strings that start in the ranges; bytes and runs removed."""
    parts, at, gone, spans, end = [], 0, 0, 0, -1
    for first, last in sorted(ranges):
        stop = last + length
        if first > end:
            parts.append(data[at:first])
            spans += 1
            gone += stop - first
        elif stop > end:
            gone += stop - end
        end = max(end, stop)
        at = end
    parts.append(data[at:])
    return b"".join(parts), gone, spans


def digests(text: Column, ranges: Column, length: int = 200) -> Column:
    """A struct of n_bytes, n_removed, n_spans and kept_sha256 for a text and its ranges, an array of (first, last) or null."""

    @F.arrow_udf(RESULT)
    def digested(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = []
        for value, own in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            data = value.encode("utf-8", "surrogatepass")
            kept, gone, spans = removed(data, [(r["first"], r["last"]) for r in own or ()], length)
            rows.append({"n_bytes": len(data), "n_removed": gone, "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()})
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return digested.asNondeterministic()(whole(text), ranges)


def with_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, parts: int | None = None, hot_from: int = 4096) -> DataFrame:
    """(key, text, ranges): every row with the ranges of starts of its repeated strings, null if it has none. Ids are integers."""
    own = docs.select(F.col(key).cast("long").alias("id"), whole(F.col(text)).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranges = repeated_ranges(own, length, parts, hot_from=hot_from).distinct().groupBy("id", "tie").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    joined = own.alias("d").join(ranges.alias("r"), F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.tie") == F.col("r.tie")), "left")
    return joined.select(F.col("d.id").alias(key), "d.text", "r.ranges")
