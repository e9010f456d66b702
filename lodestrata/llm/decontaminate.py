"""Benchmark decontamination, in DataFrame expressions only.

1. Texts and items are read as lower-case words, hashed one by one. A piece is a run of consecutive shingles and has
   a SimHash of 64 bits. Each item posts pieces so densely that every window at the threshold holds one of them
   unchanged (``shared_run`` says why); the piece at every place of every text is looked up block by block, and a
   posted one within ``radius`` bits names the pair of text and item. Nothing else names pairs.
2. In the texts of those pairs each shingle of a named item gives a place where an item-sized window would have to
   start to have the shingle where the item has it. A window at the threshold has a least number of hit places in it,
   so runs of that many hits bound where windows can start. In each run every start between the least and the greatest
   place that its hits name is a window: one step outside, towards them, loses no hit, so a best window is always
   among these.
3. Each window's exact weighted similarity (sum of least over sum of greatest counts of shingles) decides. It needs
   the window's hits only, for other shingles add nothing to the least counts and their number is known.

The posted blocks, the items' shingles and the named pairs are broadcast only while their counted rows stay below a
bound; beyond it the joins shuffle. The more pieces are posted, the wider the blocks and the smaller the radius: an
unchanged piece differs in no bit, so results do not depend on it.

Cases: null and empty texts and items and those without words match nothing; an item with fewer words than a
shingle is one shingle, searched with its own length; a text shorter than an item has no window of its size, but is
itself compared; repeated rows of a document count once, repeated items match separately, and different texts or items of one id
are compared apart; ties go to the first place between those that hits name; empty tables give empty results; very long texts are taken whole. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole, without, written
from .winnowing import let, words_of


#: Shingles in a piece, one less than a power of two each; the longest that an item's shared run holds is taken.
PIECES = (7, 3, 1)


@dataclass(frozen=True)
class Spec:
    words: int = 5
    similarity: float = 0.8
    radius: int = 3
    broadcast_rows: int = 2_000_000


def shingle_hashes(words: Column, size: Column | int) -> Column:
    """Hashes of the shingles of an array of words; a shorter one is one shingle."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.greatest(F.size(words) - size, F.lit(0))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, size)))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64 bits, each the majority of that bit over all hashes; half or fewer give 0."""

    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1).cast("long")))
        return F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def majority(hashes: list[Column]) -> Column:
    """The SimHash of 1, 3, 7, 15 and so on hashes: counters of all bits side by side, their last carry the majority."""

    def digits(own: list[Column]) -> list[Column]:
        if len(own) == 1:
            return own
        half, carry, sums = len(own) // 2, own[-1], []
        for a, b in zip(digits(own[:half]), digits(own[half:-1]), strict=True):
            sums.append(a.bitwiseXOR(b).bitwiseXOR(carry))
            carry = a.bitwiseAND(b).bitwiseOR(carry.bitwiseAND(a.bitwiseXOR(b)))
        return [*sums, carry]

    return digits(hashes)[-1]


def blocks(fingerprint: Column, radius: int) -> Column:
    """``radius + 1`` blocks of the 64 bits, as structs of number and value."""
    return F.array(*(F.struct(F.lit(i).alias("number"), value.alias("value")) for i, value in _parts(fingerprint, radius)))


def _parts(fingerprint: Column, radius: int) -> list[tuple[int, Column]]:
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(i, F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit(((1 << (b - a)) - 1) - ((1 << 64) if b - a == 64 else 0)).cast("long"))) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser over the sum of the greater counts of two arrays of hashes."""

    def common(h: Column) -> Column:
        return F.least(F.size(F.filter(a, lambda x: x == h)), F.size(F.filter(b, lambda x: x == h)))

    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, h: n + common(h))
    return let(both, lambda n: n / (F.size(a) + F.size(b) - n))


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(whole(text)), lambda w: F.xxhash64(w))


def shared_run(words: Column, size: Column, shingles: Column, spec: Spec) -> Column:
    """A number of consecutive shingles of the item that every window at the threshold has in the same order.

    A window at similarity t has at least t * S of the item's S shingles, and at most S * (1 - t) / (1 + t) places with
    others. Let no sequence of more than r words occur twice in the item, r < size - 1. Neighbouring places with
    shingles of the item then have neighbouring ones; and if fewer than size - 1 - r others stand between two such
    places, the words that the two share fix where both are in the item, and those between are the item's as well. So
    others part the shared places into few runs, and the longest has at least its share. Where r is greater, one.
    """
    t = spec.similarity
    twice = lambda n: let(shingle_hashes(words, n), lambda h: (F.size(F.array_distinct(h)) < F.size(h)).cast("int"))
    between = size - 1 - sum(twice(n) for n in range(1, spec.words))
    shared = F.ceil(shingles * t - 1e-6)
    others = F.floor(shingles * ((1 - t) / (1 + t)) + 1e-6)
    return F.when(between > 0, F.greatest(F.ceil(shared / (F.floor(others / between) + 1)), F.lit(1))).otherwise(1).cast("int")


def item_table(items: DataFrame, key: str, text: str, spec: Spec) -> DataFrame:
    """(item_id, __item, length, size, shingles, item_hashes, run, piece): size is the shingle's length in words, piece that of posted pieces in shingles."""
    own = items.select(F.col(key).alias("item_id"), word_hashes(F.col(text)).alias("words")).where(F.size("words") > 0)
    own = own.withColumn("size", F.least(F.size("words"), F.lit(spec.words))).withColumn("item_hashes", shingle_hashes(F.col("words"), F.col("size")))
    own = own.withColumn("shingles", F.size("item_hashes")).withColumn("run", shared_run(F.col("words"), F.col("size"), F.col("shingles"), spec))
    piece = F.greatest(*(F.when(F.col("run") >= p, p).otherwise(1) for p in (*PIECES, 1)))
    return own.select("item_id", F.xxhash64("item_id", "item_hashes").alias("__item"), F.size("words").alias("length"), "size", "shingles", "item_hashes", "run", piece.alias("piece"))


def posted_pieces(own: DataFrame) -> DataFrame:
    """(__item, size, piece, print): of each item the SimHashes of pieces at such steps that every shared run has a whole one."""
    at = F.sequence(F.lit(0), F.col("shingles") - F.col("piece"), F.col("run") - F.col("piece") + 1)
    prints = F.transform(at, lambda i: simhash(F.slice("item_hashes", i + 1, F.col("piece"))))
    return own.select("__item", "size", "piece", F.explode(F.array_distinct(prints)).alias("print"))


def keys(fingerprint: Column, radius: int, kind: int) -> Column:
    """The blocks of a fingerprint as one long each; ``kind`` parts those of different pieces."""
    return F.transform(blocks(fingerprint, radius), lambda b: _key(b["number"], b["value"], radius, kind))


def _key(number, value: Column, radius: int, kind: int) -> Column:
    return F.shiftleft(value, 9).bitwiseOR((number + kind * (radius + 1)).cast("long"))


def named_pairs(texts: DataFrame, pieces: DataFrame, spec: Spec) -> DataFrame:
    """(__doc, __text, __item) where a piece of the text differs from a posted one in at most ``radius`` bits, written.

    texts: (__doc, __text, words), words as hashes.
    """
    kinds = sorted((r["size"], r["piece"]) for r in pieces.select("size", "piece").distinct().collect())  # at most words + 2
    posted = pieces.count()
    # A place meets at most one posted block in sixteen by chance.
    radius = next((r for r in range(spec.radius, 0, -1) if posted * (r + 1) * 16 <= 1 << (64 // (r + 1))), 0)
    index = None
    for kind, (size, piece) in enumerate(kinds):
        own = pieces.where((F.col("size") == size) & (F.col("piece") == piece))
        own = own.select("__item", F.lit(kind).alias("kind"), "print", F.explode(keys(F.col("print"), radius, kind)).alias("key"))
        index = own if index is None else index.union(own)
    index = written(index.distinct(), "blocks")
    shortest = min(size + piece - 1 for size, piece in kinds)
    spots = texts.where(F.size("words") >= shortest).select("__doc", "__text", "words", F.explode(F.sequence(F.lit(0), F.size("words") - shortest)).alias("i"))
    w = [F.get("words", F.col("i") + d) for d in range(max(size + piece - 1 for size, piece in kinds))]
    spots = spots.select("__doc", "__text", *(x.alias(f"w{d}") for d, x in enumerate(w)))
    grams = {(size, at) for size, piece in kinds for at in range(piece)}
    ends = {f"end{k}": F.col(f"w{size + piece - 2}").isNotNull() for k, (size, piece) in enumerate(kinds)}
    spots = spots.select("__doc", "__text", *(c.alias(n) for n, c in ends.items()), *(F.xxhash64(*(f"w{at + d}" for d in range(size))).alias(f"g{size}_{at}") for size, at in sorted(grams)))
    prints = [F.when(F.col(f"end{k}"), majority([F.col(f"g{size}_{at}") for at in range(piece)])).alias(f"print{k}") for k, (size, piece) in enumerate(kinds)]
    spots = spots.select("__doc", "__text", *prints)
    own = [_key(F.lit(number), value, radius, k) for k in range(len(kinds)) for number, value in _parts(F.col(f"print{k}"), radius)]
    spots = spots.withColumn("key", F.explode(F.array(*own)))
    found = spots.join(F.broadcast(index) if index.count() <= spec.broadcast_rows else index, "key")
    seen = F.coalesce(*(F.when(F.col("kind") == k, F.col(f"print{k}")) for k in range(len(kinds))))
    return written(found.where(F.bit_count(seen.bitwiseXOR(F.col("print"))) <= radius).select("__doc", "__text", "__item").distinct(), "pairs")


def best_window(hits: Column, need: Column, shingles: Column, last: Column) -> Column:
    """(n, s) of the best window: n shingles shared with the item, and minus its start; null if none has ``need`` hits.

    hits: (p, lo, hi, id, c) by place p, with the least and greatest start that p names, and the item's shingle and
    its count there. shingles: those of a window. last: the last possible start.
    """

    def shared(own: Column) -> Column:
        several = lambda u: F.least(F.size(F.filter(own, lambda x: x["id"] == u["id"])), u["c"])
        kinds = F.array_distinct(F.transform(own, lambda x: F.struct(x["id"].alias("id"), x["c"].alias("c"))))
        plain = F.size(F.array_distinct(own["id"]))
        return F.when(F.exists(own["c"], lambda c: c > 1), F.aggregate(kinds, F.lit(0), lambda n, u: n + several(u))).otherwise(plain)

    def from_hit(j: Column) -> Column:
        """The best of the windows whose first hit is the j-th."""

        def of(near: Column) -> Column:
            lowest = F.greatest(F.least(F.array_min(near["lo"]), last), F.coalesce(F.get(hits, j - 1)["p"] + 1, F.lit(0)), F.get(hits, j + need - 1)["p"] - shingles + 1, F.lit(0))
            highest = F.least(F.greatest(F.array_max(near["hi"]), F.lit(0)), F.get(hits, j)["p"], last)
            score = lambda s: F.struct(let(F.filter(near, lambda x: x["p"] < s + shingles), shared).alias("n"), (-s).alias("s"))
            return let(F.struct(lowest.alias("a"), highest.alias("b")), lambda e: F.when(e["a"] <= e["b"], F.array_max(F.transform(F.sequence(e["a"], e["b"]), score))))

        return let(F.slice(hits, j + 1, shingles), of)

    return F.when(F.size(hits) >= need, F.array_max(F.transform(F.sequence(F.lit(0), F.size(hits) - need), from_hit)))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", spec: Spec = Spec()) -> DataFrame:
    """(key, item_id, start, similarity): for each document and item the best window that reaches the threshold, its first word counted from 0."""
    own = written(item_table(items, item_key, item_text, spec), "items")
    sizes = sorted(r[0] for r in own.select("size").distinct().collect())  # at most ``words`` lengths
    if not sizes:
        kind = items.schema[item_key].dataType
        return docs.limit(0).select(key, F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity"))
    posted = own.select("item_id", "__item", "length", "size", "shingles", F.posexplode("item_hashes").alias("at", "hash")).distinct()
    posted = posted.groupBy("item_id", "__item", "length", "size", "shingles", "hash").agg(F.min("at").alias("at"), F.max("at").alias("last_at"), F.count("*").cast("int").alias("c"))
    held = lambda df: F.broadcast(df) if df.count() <= spec.broadcast_rows else df  # noqa: E731  a checked bound
    raw = docs.select(F.col(key).alias("__doc"), F.col(text).alias("raw")).withColumn("__text", F.xxhash64(whole(F.col("raw"))))
    hashed_words = lambda df: df.select("__doc", "__text", F.explode(F.array(word_hashes(F.col("raw")))).alias("words"))  # noqa: E731  computed once, whatever reads it
    pairs = named_pairs(hashed_words(raw), written(posted_pieces(own), "pieces"), spec)
    same = lambda a, b: a["__doc"].eqNullSafe(b["__doc"]) & (a["__text"] == b["__text"])
    named = held(pairs.select("__doc", "__text").distinct())
    texts, wanted = hashed_words(raw.join(named, same(raw, named), "left_semi")), held(pairs)
    found = None
    for size in sizes:
        places = texts.where(F.size("words") >= size).select("__doc", "__text", "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("i"))
        hashed = places.select("__doc", "__text", F.size("words").alias("n_words"), "i", F.xxhash64(*(F.get("words", F.col("i") + d) for d in range(size))).alias("hash"))
        hits = hashed.join(held(posted.where(F.col("size") == size)), "hash")
        hits = hits.join(wanted, same(hits, wanted) & (hits["__item"] == wanted["__item"]), "left_semi")
        hit = F.struct(F.col("i").alias("p"), (F.col("i") - F.col("last_at")).alias("lo"), (F.col("i") - F.col("at")).alias("hi"), F.col("at").alias("id"), "c")
        hits = hits.groupBy("__doc", "__text", "n_words", "item_id", "__item", "length", "shingles").agg(F.sort_array(F.collect_set(hit)).alias("hits"))
        own_shingles = F.greatest(F.least("n_words", "length") - (size - 1), F.lit(1))
        # What both share, n, is at most the hit places, and n / (a + b - n) reaches the threshold from n = threshold / (1 + threshold) * (a + b) on.
        need = F.greatest(F.ceil((own_shingles + F.col("shingles")) * (spec.similarity / (1 + spec.similarity)) - 1e-6).cast("int"), F.lit(1))
        hits = hits.withColumn("own_shingles", own_shingles).withColumn("need", need).where(F.size("hits") >= F.col("need"))
        found = hits if found is None else found.union(hits)
    found = written(found, "hits")
    window = best_window(F.col("hits"), F.col("need"), F.col("own_shingles"), F.greatest(F.col("n_words") - F.col("length"), F.lit(0)))
    found = found.select("__doc", "item_id", "own_shingles", "shingles", F.explode(F.array(window)).alias("b"))  # computed once, whatever reads it
    scored = found.select("__doc", "item_id", (-F.col("b.s")).alias("start"), (F.col("b.n") / (F.col("own_shingles") + F.col("shingles") - F.col("b.n"))).alias("similarity"))
    best = scored.where(F.col("similarity") >= spec.similarity).groupBy("__doc", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b"))
    return best.select(F.col("__doc").alias(key), "item_id", (-F.col("b.s")).alias("start"), F.col("b.similarity").alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", spec: Spec = Spec()) -> DataFrame:
    """The rows of documents without a leaked item, all columns kept; a row with a null id stays."""
    return without(docs, leaks(docs, items, key, text, spec=spec), key)
