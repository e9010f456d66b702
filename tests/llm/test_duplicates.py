"""Near-duplicates, components, suffixes, and merges."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import losertree, neardup, suffixes
from lodestrata.llm import queries as Q
from lodestrata.llm.components import connected_components

DOCS = "doc_id long, text string, component_id string"


def word_sets(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components_of(rows, n, least=80):
    """By comparing every pair."""
    sets = [(i, word_sets(t, n)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            both = len(x & y)
            if both and 100 * both >= least * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in up}


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n // 4):
        own = [rng.choice(words) for _ in range(rng.randint(1, 90))]
        rows.append(own)
        for _ in range(rng.choice((0, 1, 3, 8))):
            other = list(own)
            for _ in range(rng.randint(0, 6)):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append(other)
    rng.shuffle(rows)
    return [(3 * i + 1, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed,n,spec", [(1, 4, {}), (2, 5, {}), (3, 4, {"long_list": 3, "tile_rows": 2, "broadcast_rows": 0})])
def test_components_equal_comparing_all_pairs(spark, seed, n, spec):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS).repartition(5)
    got = {r.doc_id: r for r in neardup.near_duplicates(df, spec=neardup.Spec(words=n, **spec)).collect()}
    want = components_of(rows, n)
    assert {i: r.component_id for i, r in got.items()} == want
    for i, t in rows:
        assert got[i].n_shingles == len(word_sets(t, n)) and got[i].kept == (want[i] == i)


def test_families_beyond_stars(spark):
    """Variants of one text with more and more edits: links run along the chain, not to one centre."""
    rng = random.Random(7)
    base = [f"x{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for p in rng.sample(range(120), rng.randint(0, 9)):
            own[p] = f"y{i}_{p}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame([(*r, "") for r in rows], DOCS)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, spec=neardup.Spec(words=4, tile_rows=5)).collect()}
    assert got == components_of(rows, 4)


def family(seed, n, words=60, edits=5):
    """Near copies of one text, all in the same lists."""
    rng = random.Random(seed)
    base = [f"x{i}" for i in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for p in rng.sample(range(words), rng.randint(0, edits)):
            own[p] = f"y{i}_{p}"
        rows.append((i, " ".join(own)))
    return rows


def test_long_lists_are_cut_in_few_parts(spark, monkeypatch):
    """A long list is not multiplied by every second coordinate, and no pair of it is lost."""
    rows, dealt, real = family(21, 80), [], neardup.crossing
    monkeypatch.setattr(neardup, "crossing", lambda lists, spec: dealt.append(lists.count()) or real(lists, spec))
    df = spark.createDataFrame([(*r, "") for r in rows], DOCS)
    spec = neardup.Spec(words=4, long_list=40, tile_rows=10)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, spec=spec).collect()}
    assert got == components_of(rows, 4)
    assert 0 < dealt[0] <= spec.posted * len(rows) * 4


def test_longest_lists_are_split_by_a_second_coordinate(spark, monkeypatch):
    rows, splits, real = family(22, 160, edits=9), [], neardup.split
    monkeypatch.setattr(neardup, "split", lambda lists, spec: splits.append(1) or real(lists, spec))
    df = spark.createDataFrame([(*r, "") for r in rows], DOCS)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, spec=neardup.Spec(words=4, long_list=4, tile_rows=10)).collect()}
    assert splits and got == components_of(rows, 4)


def test_near_duplicate_plans_stay_small(spark):
    """What the driver keeps of its plans: no step has the plans of the steps before it in its own."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    df = spark.createDataFrame([(*r, "x") for r in corpus(5)], DOCS)
    assert neardup.near_duplicates(df).count() == len(corpus(5))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    own = store.executionsList(before, 1000)
    plans = [own.apply(i).physicalPlanDescription() for i in range(own.size())]
    assert plans and max(p.count("InMemoryRelation") for p in plans) <= 8 and max(map(len, plans)) < 100_000


def test_near_duplicate_edges(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, t), (5, t.upper()), (5, t.upper()), (6, "a b"), (7, "A  b"), (None, t), (8, "a b c"), (9, "z " * 300_000), (10, "z " * 299_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], DOCS)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, spec=neardup.Spec(words=4)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 47, 4, True), (5, 47, 4, False), (5, 47, 4, False), (6, 1, 6, True), (7, 1, 6, False), (None, 47, None, None), (8, 1, 8, True), (9, 1, 9, True), (10, 1, 9, False)], key=str)
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_near_duplicate_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r.component_id for r in Q.op7_minhash(spark, sf_dir).collect()}
    assert got == components_of(rows, 4)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, j) for j in range(1001, 1100)] + [(7, 7), (5, 4), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1100), 1000)}
    assert connected_components(df.limit(0), "a", "b").collect() == []


def test_components_of_few_links_take_few_jobs(spark):
    rng = random.Random(12)
    links = [(i, i + 1) for i in range(300)] + [(rng.randrange(1000, 4000), rng.randrange(1000, 4000)) for _ in range(1700)] + [(2, -(2**62)), (-5, -6)]
    df = spark.createDataFrame(links, "a long, b long")
    spark.sparkContext.setJobGroup("few links", "components")
    got = connected_components(df, "a", "b").collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 16
    spark.sparkContext.setJobGroup("rounds", "components")
    rounds = connected_components(df, "a", "b", local_links=0)
    assert got and sorted(got) == sorted(rounds.collect()) and rounds.dtypes == connected_components(df, "a", "b").dtypes


# --- suffixes


def kept_of(texts, length):
    """By counting every string."""
    data = [(t or "").encode() for t in texts]
    counts = collections.Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if counts[b[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def suffix_rows(spark, rows, length, parts=None, hot_from=4096):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixes.with_ranges(df.repartition(3), length=length, parts=parts, hot_from=hot_from)
    return [(r.doc_id, *r.r) for r in found.select("doc_id", suffixes.digests(F.col("text"), F.col("ranges"), length).alias("r")).collect()]


@pytest.mark.parametrize("seed,length,hot_from", [(1, 40, 4096), (2, 64, 2), (3, 200, 4096), (4, 200, 2)])
def test_removal_equals_counting_all_strings(spark, seed, length, hot_from):
    rng = random.Random(seed)
    texts = []
    for i in range(60):
        t = "".join(rng.choice("ab cdéf") for _ in range(rng.randint(0, 5 * length)))
        if i % 3 == 0 and texts:
            other = rng.choice(texts)
            a = rng.randrange(len(other) + 1)
            cut = other[a : a + rng.randint(0, 3 * length)]
            p = rng.randrange(len(t) + 1)
            t = t[:p] + cut + t[p:]
        texts.append(t)
    texts += ["x" * (3 * length), "xy" * length, "xyz " * length, "q" * length, texts[0], texts[0]]
    want = [(i, *w) for i, w in enumerate(kept_of(texts, length))]
    assert sorted(suffix_rows(spark, list(enumerate(texts)), length, parts=3, hot_from=hot_from)) == want


@pytest.mark.parametrize("hot_from", [20, 4096])
def test_a_common_line_in_many_contexts(spark, hot_from):
    """A line of under 200 bytes in many texts repeats only with what some have around it."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    line, ends, begins = noise(150), [noise(90) for _ in range(3)], [noise(90) for _ in range(3)]
    texts = [noise(150) + rng.choice(["", *begins]) + line + rng.choice(["", *ends]) + noise(150) for _ in range(60)]
    want = [(i, *w) for i, w in enumerate(kept_of(texts, 200))]
    assert sorted(suffix_rows(spark, list(enumerate(texts)), 200, hot_from=hot_from)) == want and sum(w[2] for w in want) > 1000


def test_suffix_edges(spark):
    long = "".join(chr(97 + (i * i) % 23) for i in range(400))
    rows = [(1, None), (2, ""), (3, "short"), (None, long), (4, long), (4, long), (5, "ab" * 200_000)]
    got = suffix_rows(spark, rows, 200)
    assert sorted(r[2] for r in got) == [0, 0, 0, 400, 400, 400, 400_000]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.with_ranges(df).collect() == []


def test_suffix_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op10_suffixes(spark, sf_dir).collect())
    assert got == [(i, *w) for (i, _), w in zip(docs, kept_of([t for _, t in docs], 200), strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=12), max_size=7))
def test_merge_is_sorted_and_tells_shared_prefixes(runs):
    coded = [losertree.decoded((n, rest, i) for n, rest in losertree.front_coded(sorted(r))) for i, r in enumerate(runs)]
    got = list(losertree.merged(coded))
    assert [k for _, k, _ in got] == sorted(k for r in runs for k in r)
    before = b""
    for shared, key, _ in got:
        assert shared == losertree.common_prefix(before, key)
        before = key
