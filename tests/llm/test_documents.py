"""Fingerprints, decontamination, archives, main text, and the pipeline."""

import base64
import collections
import datetime
import gzip
import glob
import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, htmltext, pageparse, warc, winnowing
from lodestrata.llm import queries as Q


def prints(text):
    return {x.split(":")[0] for x in text.split(",") if x}


def likeness(a, b):
    a, b = prints(a), prints(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprint_query(spark, sf_dir):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in Q.op6_winnowing(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[1][:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - likeness(r.fingerprint, r.edited_fingerprint)) < 1e-9
        assert abs(r.near_next - likeness(r.fingerprint, got[after[0]].fingerprint)) < 1e-9


def chosen(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", winnowing.as_text(winnowing.chosen(F.coalesce("text", F.lit("")))).alias("f")).orderBy("i").collect()
    return [[(x.split(":")[0], int(x.split(":")[1])) for x in r.f.split(",") if x] for r in rows]


def test_windows_and_ties(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    ((*places,),) = chosen(spark, [" ".join(words)])
    at = [p for _, p in places]
    grams = 400 - winnowing.GRAM + 1
    assert at == sorted(at) and max(b - a for a, b in zip([-1, *at], [*at, grams], strict=True)) <= winnowing.WINDOW
    (same,) = chosen(spark, ["a " * 60])
    assert [p for _, p in same] == list(range(winnowing.WINDOW - 1, 60 - winnowing.GRAM + 1)) and len({h for h, _ in same}) == 1
    # every window's rightmost least hash, recomputed from the one-choice fingerprints of the single grams
    hashes = [h for (h, _), in (tuple(x) for x in chosen(spark, [" ".join(words[i : i + 5]) for i in range(60)]))]
    want = []
    for s in range(60 - winnowing.WINDOW + 1):
        window = [int(h, 16) for h in hashes[s : s + winnowing.WINDOW]]
        p = s + max(i for i, h in enumerate(window) if h == min(window))
        if p not in want:
            want.append(p)
    (got,) = chosen(spark, [" ".join(words[:64])])
    assert [p for _, p in got] == want


def test_shared_words_are_always_found(spark):
    rng = random.Random(2)
    need = winnowing.GRAM + winnowing.WINDOW - 1
    shared = [f"s{i}" for i in range(need)]
    texts = []
    for i in range(12):
        own = [f"x{i}_{rng.randrange(99)}" for _ in range(60)]
        p = rng.randrange(60)
        texts.append(" ".join(own[:p] + shared + own[p:]))
    sets = [{h for h, _ in f} for f in chosen(spark, texts)]
    assert set.intersection(*sets)


def test_fingerprint_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (5, "one two", "c"), (5, "one two", "c"), (7, "…!?", None), (None, "only null id", "n"), (9, "word " * 200_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = winnowing.compared_with_edits(df).collect()
    assert len(got) == 7
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0].fingerprint == "" and by[1][0].near_edited == 1.0 and by[1][0].near_next == 1.0 and by[2][0].near_next == 0.0
    assert len({r.fingerprint for r in by[5]}) == 1 and max(r.near_next for r in by[5]) == 1.0
    assert by[9][0].edited_sha256 == hashlib.sha256(("word " * 100_000 + "only null id").encode()).hexdigest()
    assert winnowing.compared_with_edits(df.limit(0)).collect() == []
    one = winnowing.compared_with_edits(df.where("doc_id = 9")).collect()
    assert one[0].near_next == 1.0 and one[0].n_chars == 1_000_000


def test_blocks_of_uneven_keys(spark):
    """Outliers, a hot key and nulls: blocks follow the order of key and tie and stay small."""
    rng = random.Random(3)
    ids = [*range(2000), 2**60, -(2**63), 2**63 - 1, *[77] * 700, *[None] * 500]
    rows = [(i, rng.getrandbits(63) - 2**62) for i in ids]
    df = spark.createDataFrame(rows, "id long, __tie long")
    got = df.withColumn("b", winnowing.blocks_of(df, "id", 8)).collect()
    got.sort(key=lambda r: (r.id is not None, r.id or 0, r["__tie"]))
    blocks = [r.b for r in got]
    assert blocks == sorted(blocks) and max(collections.Counter(blocks).values()) < 100
    docs = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate([-(2**63), 2**63 - 1, 5, 6])], "doc_id long, text string")
    following = {r.doc_id: r.next_text for r in winnowing.with_next(docs, "doc_id", "text", F.array(F.lit(1))).collect()}
    assert following == {-(2**63): "t2", 5: "t3", 6: "t1", 2**63 - 1: "t0"}


def test_successors_in_blocks(spark):
    ids = sorted({random.Random(3).randrange(-(10**9), 10**9) for _ in range(700)} | set(range(50)))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    want = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    for most in (5, 100, 10_000):
        assert {r.id: r.following for r in winnowing.successors(df, "id", most, 8).collect()} == want


# --- decontamination


def leaked(docs, items, n=5):
    """By sliding every item over every text."""
    words = lambda t: [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", (t or "").lower()) if w]
    grams = lambda w, n: collections.Counter(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))
    out = set()
    for d, t in docs:
        w = words(t)
        for i, u in ((i, words(x)) for i, x in items):
            if not u or not w:
                continue
            size = min(n, len(u))
            want = grams(u, size)
            for s in range(max(1, len(w) - len(u) + 1)):
                own = grams(w[s : s + len(u)], size)
                both = sum((own & want).values())
                if both >= 0.8 * (sum(own.values()) + sum(want.values()) - both):
                    out.add((d, i))
                    break
    return out


def test_leaks_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {(r.doc_id, r.item_id) for r in Q.op4_decontaminate(spark, sf_dir).collect()} == leaked(docs, items)


def test_near_leaks_and_edges(spark):
    rng = random.Random(5)
    item = [f"q{i}" for i in range(60)]
    docs, items = [], [(1, " ".join(item)), (2, "just three words"), (3, None), (4, ""), (5, " ".join(item)), (6, "a b a b a b a b a b a b")]
    for d in range(40):
        own = list(item)
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(own))
            kind = rng.random()
            own[p : p + 1] = [] if kind < 0.3 else [own[p], "extra"] if kind < 0.6 else ["other"]
        noise = [f"n{rng.randrange(50)}" for _ in range(40)]
        docs.append((d, " ".join(noise[:20] + own + noise[20:])))
    docs += [(50, None), (51, ""), (52, "so Just, three WORDS! here"), (53, "just three"), (54, "b a b a b a b a b a b a"), (None, " ".join(item)), (55, "x " * 300_000 + " ".join(item)), (0, docs[0][1])]
    d = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, similarity string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d.select("doc_id", "text"), i).collect()}
    want = leaked(docs, items)
    assert got - {p for p in got if p[0] is None} <= want | {(None, 1), (None, 5)}
    assert len(want - got) <= 0.05 * len(want)
    assert {(d, i) for d, i in want if d in (52, 54, 55)} <= got
    kept = decontaminate.clean(d, i)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {x for x, _ in docs} - {x for x, _ in got if x is not None}
    assert decontaminate.leaks(d.select("doc_id", "text"), i.limit(0)).collect() == [] == decontaminate.leaks(d.limit(0), i).collect()


def best_windows(docs, items, n=5):
    """The greatest similarity of each leaked pair, by sliding every item over every text."""
    words = lambda t: [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", t.lower()) if w]
    grams = lambda w, n: collections.Counter(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))
    out = {}
    for d, w in ((d, words(t)) for d, t in docs):
        for i, u in ((i, words(x)) for i, x in items):
            want = grams(u, min(n, len(u)))
            for s in range(max(1, len(w) - len(u) + 1)):
                own = grams(w[s : s + len(u)], min(n, len(u)))
                both = sum((own & want).values())
                like = both / (sum(own.values()) + sum(want.values()) - both)
                if like >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), like)
    return out


def test_best_windows_start_between_hits(spark):
    rng = random.Random(8)
    item = [f"q{i}" for i in range(100)]
    many = ["x"] * 55 + ["y"] * 53
    items = [(1, " ".join(item)), (2, " ".join(many)), (3, " ".join(item[20:50] + item[20:50]))]
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    texts = [noise(30) + noise(3) + item[3:50] + noise(6) + item[50:97] + noise(3) + noise(30), ["x"] * 53 + ["y"] * 55, item[4:], item[:95], (item[20:50] * 9), item * 3]
    for _ in range(60):
        a, b, p = rng.randrange(6), 100 - rng.randrange(6), rng.randrange(20, 80)
        texts.append(noise(rng.randrange(12)) + item[a:p] + noise(rng.randrange(9)) + item[p + rng.randrange(3) : b] + noise(rng.randrange(12)))
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = best_windows(docs, items)
    assert (0, 1) in want and (1, 2) in want
    for bound in (0, 2_000_000):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(d, i, spec=decontaminate.Spec(broadcast_rows=bound)).collect()}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("radius", [3, 24])
def test_blocks_guarantee_the_radius(spark, radius):
    rng = random.Random(6)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for p in rng.sample(range(64), radius):
            b ^= 1 << p
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        rows.append((signed(a), signed(b)))
    df = spark.createDataFrame(rows, "a long, b long")
    assert df.where(~F.arrays_overlap(decontaminate.blocks(F.col("a"), radius), decontaminate.blocks(F.col("b"), radius))).count() == 0


def test_simhash_bits(spark):
    hs = [3, 1, -1, 1 << 40]
    want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs))
    got = spark.createDataFrame([(hs,)], "h array<long>").select(decontaminate.simhash(F.col("h"))).first()[0]
    assert got % (1 << 64) == want


@pytest.mark.parametrize("n", [1, 3, 7, 15])
def test_majority_is_the_simhash(spark, n):
    rng = random.Random(n)
    df = spark.createDataFrame([([rng.getrandbits(64) - (1 << 63) for _ in range(n)],) for _ in range(50)], "h array<long>")
    assert df.where(decontaminate.majority([F.get("h", i) for i in range(n)]) != decontaminate.simhash(F.col("h"))).count() == 0


def reworked(rng, item, letters):
    """The item with a few words put in, left out, replaced or repeated, and parts changed about."""
    own = list(item)
    for _ in range(rng.randint(0, 3)):
        p, q = sorted(rng.randrange(len(own) or 1) for _ in range(2))
        kind = rng.randrange(5)
        if kind == 0:
            own = own[q:] + own[:q]
        elif kind == 1:
            own[p:p] = own[p : min(q, p + 6)]
        else:
            own[p : p + 1] = [[], [*own[p : p + 1], rng.choice(letters)], [rng.choice(letters)]][kind - 2]
    return own[rng.randint(0, 2) : len(own) - rng.randint(0, 2)]


def test_every_leak_shares_the_run_that_pieces_are_posted_for(spark):
    rng = random.Random(12)
    items, docs = [], []
    for i, n in enumerate([2, 3, 4, 6, 10, 20, 40, 400] * 4):
        letters = [f"w{k}" for k in range(n)]
        items.append((i, " ".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 5, 7, 14, 22, 35, 60])))))
        for _ in range(15):
            noise = [[rng.choice(letters) for _ in range(rng.randrange(6))] for _ in range(2)]
            docs.append((len(docs), " ".join(noise[0] + reworked(rng, items[i][1].split() * (1 + (n == 3)), letters) + noise[1])))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = best_windows(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(d, i).collect()}
    assert got == pytest.approx(want) and len(want) > 200
    own = {r.item_id: r for r in decontaminate.item_table(i, "item_id", "text", decontaminate.Spec()).collect()}
    assert {r.piece for r in own.values()} == {1, 3, 7}
    for a, b in want:
        text, item, words = f" {docs[a][1]} ", items[b][1].split(), own[b].run + own[b].size - 1
        assert any(f" {' '.join(item[k : k + words])} " in text for k in range(len(item) - words + 1))


def test_only_simhash_blocks_name_pairs(spark, monkeypatch):
    item = " ".join(f"q{k}" for k in range(40))
    d = spark.createDataFrame([(1, f"so {item} so"), (2, "else")], "doc_id long, text string")
    i = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.leaks(d, i).collect()] == [(1, 1, 1, 1.0)]
    monkeypatch.setattr(decontaminate, "simhash", lambda hashes: F.lit(0).cast("long"))
    assert decontaminate.leaks(d, i).collect() == [] and decontaminate.clean(d, i).count() == 2


def test_many_pieces_narrow_the_radius(spark):
    rng = random.Random(13)
    items = [(k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(30))) for k in range(3000)]
    docs = [(k, "before " + items[k][1] + " after") for k in range(0, 3000, 100)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for spec in (decontaminate.Spec(), decontaminate.Spec(broadcast_rows=0), decontaminate.Spec(radius=0), decontaminate.Spec(radius=24)):
        assert {tuple(r) for r in decontaminate.leaks(d, i, spec=spec).collect()} == {(k, k, 1, 1.0) for k, _ in docs}


# --- archives


def captured(pages, least=0):
    best = {}
    for i, h in pages:
        b = (h or "").encode()
        if len(b) >= least:
            best[b] = max(best.get(b, -1), i)
    out = {}
    for i, h in pages:
        b = (h or "").encode()
        again = len(b) >= least and best[b] != i
        out[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", best[b] if again else None)
    return out


def test_warc_query(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in Q.op2_warc(spark, sf_dir).collect()}
    assert got == captured(pages)


def test_warc_order_in_any_time_zone(spark, sf_dir):
    """The query's rows in order of place are the capture history; the session's zone, even in hours that it lacks, doesn't matter."""
    pages = spark.createDataFrame([(x, "http://a.org/", "h") for x in (5, 3 * 10**11, 2**62, 6024600, 26589600, 26593200)], "page_id long, url string, html string")
    want = sorted((r.urlkey, r.timestamp, r.page_id) for r in Q.op2_warc(spark, sf_dir).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = Q.op2_warc(spark, sf_dir).orderBy("place").collect()
        times = {r.page_id: r.timestamp for r in warc.captured(pages).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [(r.urlkey, r.timestamp, r.page_id) for r in rows] == want and [r.place for r in rows] == list(range(len(rows)))
    start = datetime.datetime(2024, 1, 1)
    assert all(len(t) == 14 for t in times.values())
    assert all(times[x] == (start + datetime.timedelta(seconds=x)).strftime("%Y%m%d%H%M%S") for x in (5, 6024600, 26589600, 26593200))


def test_warc_records_are_where_the_index_says(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", "x" * i) for i in range(40)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), records_per_file=7)
    files = {p.name: gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz")}
    rows = warc.merged_index(warc.read_archives(spark, str(tmp_path / "w")), per_range=5).collect()
    assert len(rows) == 40
    for r in rows:
        assert next(warc.parsed(files[r.archive][r.offset :]))["page_id"] == r.page_id


@pytest.mark.parametrize("least,per_range", [(0, 3), (6, 100_000)])
def test_warc_round_trip(spark, least, per_range):
    html = ["<p>é</p>", "<p>é</p>", None, "", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "y" * 500_000, "abc", "abc", "<p>é</p>"]
    pages = [(i * 7, f"http://{'b' if i % 2 else 'a'}.example.org/p{i % 3}", h, "t") for i, h in enumerate(html)] + [(100, None, "abc", "t"), (101, "not a url ü\r\nx", "q", "t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, timestamp string").repartition(3)
    rows = warc.captured(df, revisit_from=least, per_range=per_range).orderBy("range", "place").collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == captured([(p[0], p[2]) for p in pages], least)
    keys = [(r.urlkey, r.timestamp, r.page_id) for r in rows]
    assert keys == sorted(keys) and [r.place for r in rows] == list(range(len(pages))) and all(r.archive and r.offset >= 0 for r in rows)
    assert warc.captured(df.limit(0)).collect() == []


def test_archive_text(spark, tmp_path):
    df = spark.createDataFrame([(5, "http://X.org:80/a?b#c", "hi")], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    (path,) = [p for p in glob.glob(f"{tmp_path}/w/part*") if gzip.open(p).read()]
    data = gzip.open(path).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\nhi\r\n\r\n")
    with pytest.raises(ValueError, match="digest"):
        list(warc.parsed(data.replace(b"\r\n\r\nhi", b"\r\n\r\nho")))
    assert warc.url_key("http://X.org:80/a?b#c") == "org,x)/a?b" == warc.url_key("https://x.org/a?b")
    nulls = spark.createDataFrame([(None, None, None), (None, None, None)], "page_id long, url string, html string")
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in warc.captured(nulls).collect()] == [(None, 0, "response")] * 2


# --- main text


def test_blocks_of_broken_markup():
    page = "<html><head><title>t</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>A&amp;B</a><li>C</ul></nav><!-- x --><article><h1>H  1</h1><p><b>one<br>two<p class=\"x y\">a<i>b</i> &copy;&nbsp;c</article><footer>f"
    got = pageparse.blocks(page)
    assert [b.text for b in got] == ["A&B", "C", "H 1", "one two", "ab © c", "f"]
    assert got[0].linked == 1.0 and got[4].path[-3:] == ("p", ".x", ".y") and "article" not in got[5].path
    assert pageparse.blocks(None) == [] == pageparse.blocks("<script>x") and [b.text for b in pageparse.blocks("a < b <")] == ["a < b <"]


def test_labeller_gradients():
    import numpy as np

    rng = random.Random(1)
    made = [htmltext.synthetic_page(rng) for _ in range(3)]
    pages, labels = [pageparse.blocks(p) for p, _ in made], [y for _, y in made]
    model = htmltext.Labeller(3)

    def loss():
        c = np.clip(np.concatenate(model.run(pages)[0]), 1e-12, 1 - 1e-12)
        y = np.concatenate([np.array(r, float) for r in labels])
        return -(y * np.log(c) + (1 - y) * np.log(1 - c)).sum() / len(pages)

    grads = model.run(pages, labels)[1]
    for k in ("v", "c", "w1", "w2", "u1", "u2", "b1", "marks", "words"):
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        keep = model.p[k][at]
        model.p[k][at] = keep + 1e-5
        up = loss()
        model.p[k][at] = keep - 1e-5
        assert np.isclose((up - loss()) / 2e-5, grads[k][at], rtol=1e-3), k
        model.p[k][at] = keep


def test_labeller_on_pages_it_has_not_seen():
    rng = random.Random(77)
    made = [htmltext.synthetic_page(rng) for _ in range(150)]
    pages = [pageparse.blocks(p) for p, _ in made]
    right = total = 0
    for chance, (_, y) in zip(htmltext.trained().run(pages)[0], made, strict=True):
        right += sum((c >= 0.5) == t for c, t in zip(chance, y, strict=True))
        total += len(y)
    assert right / total > 0.97


def test_main_text_query(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = Q.op5_html_text(spark, sf_dir).collect()
    want = {i: "\n".join(b.text for b in pageparse.blocks(p.html) if "article" in b.path) for i, p in pages.items()}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)
    assert sum(r.text == want[r.page_id] for r in got) >= 0.995 * len(got)


def test_main_text_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "<p>", None), (4, "<article><h1>T</h1><p>Body text here.</p></article>" + "<footer>f</footer>", "t"), (5, "<article>" + "<p>Some words in a row.</p>" * 20_000 + "</article>", "")]
    df = spark.createDataFrame([*rows, rows[3]], "page_id long, html string, text string")
    got = df.withColumn("r", htmltext.main_text(htmltext.trained(), F.col("html"))).collect()
    assert [got[i].r.text for i in (0, 1, 2)] == ["", "", ""] and got[3].r.text == got[5].r.text == "T\nBody text here."
    assert got[4].r.n_kept == 20_000 and got[3].text == "t"
    assert df.limit(0).select(htmltext.main_text(htmltext.trained(), F.col("html"))).collect() == []
