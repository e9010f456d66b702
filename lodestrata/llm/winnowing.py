"""Document fingerprints by winnowing, in DataFrame expressions only.

A text is read as lower-case words (runs of letters and digits; a letter of a script without spaces is a word of
its own). Each run of ``gram`` words gets a hash, and of every ``window`` consecutive hashes the least is chosen,
the rightmost among equal ones. A chosen hash and its place share one long, the place counted downwards below the
hash, so that a plain minimum finds both and breaks ties to the right; window minima come from doubling, four
passes for twelve hashes. Any ``window + gram - 1`` words that two texts share give them a hash in common.

Cases: null and empty texts and texts without words have an empty fingerprint, alike to another empty one (1) and
to no other (0); a text with fewer words than a gram is one gram; a text with fewer grams than a window has one
choice; very long texts are taken whole; repeated rows follow each other in the order of documents; rows with a
null id come first, in the order of their texts' hashes; an empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole, written

GRAM, WINDOW = 5, 12
#: What parts words: anything but letters, marks and digits, and the places after letters of scripts without spaces.
_BETWEEN = r"[^\p{L}\p{M}\p{N}]+|(?<=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}])"
_PLACES = 31


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _BETWEEN), "")


def _keys(hashes: Column, gram: int) -> Column:
    """For each gram its 32-bit hash above its place, counted downwards."""
    last = F.lit((1 << _PLACES) - 1).cast("long")

    def at(i: Column) -> Column:
        parts = [F.get(hashes, i + d) for d in range(gram)]  # beyond the end null, which a hash leaves out
        return F.shiftleft(F.shiftrightunsigned(F.xxhash64(*parts), 32), _PLACES) + (last - i)

    grams = F.greatest(F.size(hashes) - (gram - 1), F.lit(1))
    return F.when(F.size(hashes) > 0, F.transform(F.sequence(F.lit(0), grams - 1), at)).otherwise(F.array().cast("array<bigint>"))


def _doubled(values: Column, step: int) -> Column:
    return F.transform(values, lambda x, i: F.least(x, F.get(values, i + step)))


def chosen(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The chosen keys of a text as array<long>, in the order of their places."""

    def minima(values: Column, span: int) -> Column:
        if span >= window:
            return F.array_distinct(F.slice(values, 1, F.greatest(F.size(values) - (window - 1), F.least(F.size(values), F.lit(1)))))
        step = min(span, window - span)
        return let(_doubled(values, step), lambda v: minima(v, span + step))

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), lambda h: let(_keys(h, gram), lambda k: minima(k, 1)))


def hashes_of(keys: Column) -> Column:
    return F.array_distinct(F.transform(keys, lambda x: F.shiftright(x, _PLACES)))


def as_text(keys: Column) -> Column:
    """hash:place of each choice, the hash in hexadecimal, comma-joined."""
    last = F.lit((1 << _PLACES) - 1).cast("long")
    return F.array_join(F.transform(keys, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, _PLACES))), F.lit(":"), (last - x.bitwiseAND(last)).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two fingerprints' hashes, 0 to 1."""
    both = F.size(F.array_intersect(hashes_of(a), hashes_of(b)))
    total = F.size(F.array_union(hashes_of(a), hashes_of(b)))
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def successors(keys: DataFrame, name: str, most: int = 100_000, width: int = 64) -> DataFrame:
    """(name, following) for a table of distinct longs: the next greater one, the least after the greatest."""
    low, high, rows = keys.agg(F.min(name), F.max(name), F.count(name)).first()
    if rows <= most:
        ordered = Window.orderBy(name)
        return keys.select(name, F.coalesce(F.lead(name).over(ordered), F.lit(low)).alias("following"))
    span = max(1, (high - low + 1) * width // rows)
    blocked = keys.withColumn("__block", F.floor((F.col(name) - low) / F.lit(span)).cast("long"))
    blocked = blocked.withColumn("following", F.lead(name).over(Window.partitionBy("__block").orderBy(name)))
    firsts = written(keys.withColumn("__block", F.floor((F.col(name) - low) / F.lit(span)).cast("long")).groupBy("__block").agg(F.min(name).alias("__first")), "blocks")
    after = successors(firsts.select("__block"), "__block", most, width).join(firsts.withColumnsRenamed({"__block": "following", "__first": "__next"}), "following").select("__block", "__next")
    return blocked.join(after, "__block").select(name, F.coalesce("following", "__next").alias("following"))


def blocks_of(docs: DataFrame, key: str, rows_per_block: int, buckets: int = 128) -> Column:
    """A block number for each row of (key, __tie), in the order of key, nulls first, and tie; about ``rows_per_block`` rows have one.

    Sampled quantiles part the keys into buckets, a bucket into equal spans of the key, and one of a single key, or of
    nulls, into equal spans of the tie. A bounded number of sampled keys and one row a bucket come to the driver.
    """
    rows, nulls = docs.agg(F.count("*"), F.sum(F.col(key).isNull().cast("long"))).first()
    share = min(1.0, 32 * buckets / max(1, rows))
    drawn = sorted(r[0] for r in docs.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64("__tie", key), F.lit(1 << 30)) < int(share * (1 << 30)))).select(key).collect())
    cuts = [drawn[i * len(drawn) // buckets] for i in range(buckets)] if drawn else []
    hot = {a + 1 for a, b in zip(cuts, cuts[1:], strict=False) if a == b and a < (1 << 63) - 1}  # a hot key is a bucket of its own
    bounds = sorted({*cuts, *hot})
    longs = lambda x: F.array(*(F.lit(v).cast("long") for v in x))
    within = F.size(F.filter(longs(bounds), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    bucket = F.when(F.col(key).isNull(), F.lit(0)).otherwise(within + 1)
    stats = {r[0]: r[1:] for r in docs.groupBy(bucket.alias("b")).agg(F.min(key), F.max(key), F.count("*")).collect()}
    half = 1 << 62
    lows, spans, firsts, by_tie, first = [], [], [], [], 0
    for i in range(len(bounds) + 2):
        low, high, n = stats.get(i, (None, None, 0))
        tied = low is None or low == high
        least, most = (-half, half - 1) if tied else (low >> 1, high >> 1)
        span = min(max(1, (most - least + 1) * rows_per_block // max(1, n)), (1 << 63) - 1)
        for column, value in ((lows, least), (spans, span), (firsts, first), (by_tie, tied)):
            column.append(value)
        first += (most - least) // span + 1
    at = lambda x: F.get(longs(x), bucket)
    place = F.when(F.get(F.array(*map(F.lit, by_tie)), bucket), F.shiftright("__tie", 1)).otherwise(F.shiftright(key, 1))
    return at(firsts) + F.floor((place - at(lows)).cast("decimal(20,0)") / at(spans)).cast("long")


def with_next(docs: DataFrame, key: str, text: str, derived: Column, rows_per_block: int = 64) -> DataFrame:
    """(key, text, keys, next_text, next_keys): each row with the text and its derivate of the row that follows by ``key``; the first follows the last.

    Rows are dealt by narrow blocks, so that one shuffle brings neighbours together and no task holds more than its
    blocks; only the first text of each block travels again, to the end of the block before, and is derived again.
    """
    tied = docs.select(key, text, F.xxhash64(text).alias("__tie"))
    block = blocks_of(tied, key, rows_per_block)
    dealt = tied.withColumn("__block", block)
    order = Window.partitionBy("__block").orderBy(F.col(key).asc_nulls_first(), "__tie")
    lead = lambda c: F.lead(c).over(order)
    own = dealt.withColumn("keys", derived).select(key, text, "keys", "__block", lead(F.lit(True)).alias("__inner"), lead(text).alias("__next_text"), lead("keys").alias("__next_keys"))
    heads = written(dealt.groupBy("__block").agg(F.min_by(text, F.struct(F.col(key).isNotNull(), key, "__tie")).alias(text)), "heads")
    before = successors(heads.select("__block"), "__block").select(F.col("following").alias("__block"), F.col("__block").alias("__before"))
    heads = heads.join(before, "__block").select(F.col("__before").alias("__block"), F.col(text).alias("__head_text"), derived.alias("__head_keys"))
    joined = own.join(heads, "__block", "left")
    chosen_of = lambda c: F.when(F.col("__inner"), F.col(f"__next_{c}")).otherwise(F.col(f"__head_{c}")).alias(f"next_{c}")
    return joined.select(key, text, "keys", chosen_of("text"), chosen_of("keys"))


def compared_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses to each other and to the next document's."""
    pairs = with_next(docs.select(key, whole(F.col(text)).alias("text")), key, "text", chosen(F.col("text"), gram, window))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))
    pairs = pairs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
    pairs = pairs.withColumn("edited_keys", chosen(F.col("edited"), gram, window))
    return pairs.select(
        key, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("keys")).alias("fingerprint"), as_text(F.col("edited_keys")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("edited_keys")).alias("near_edited"), likeness(F.col("keys"), F.col("next_keys")).alias("near_next"),
    )
