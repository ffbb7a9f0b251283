"""Line dedup, near-dedup, winnowing, URL lists and the pipeline against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from spindrift.llm import lines, neardup, queries, urls, winnow


def oracle(name, sf):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return sorted(c.sql(queries.ORACLES[name]).fetchall(), key=str)


def test_lines_equal_sql(spark, small):
    got = queries.op5_lines_cuckoo(spark, small).collect()
    assert sorted(map(tuple, got), key=str) == oracle("op5_lines_cuckoo", small)
    assert sum(r.n_dropped for r in got) > 0


def test_lines_odd(spark, empty):
    key = "Each of Us knows this very long and WELL known line"
    texts = {0: f"{key}\nown", 1: f"\t{key.lower()}  \r\n\n{key}", 2: key, 3: key.upper() + "\nx", 4: f"a\n{key}\nb\n{key}", 5: None, 6: "", 7: key[:39]}
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()] + [(None, key, "x"), (2, key, "x")], "doc_id long, text string, n_lines string")
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lines.dedup(docs).collect()}
    assert got == {(0, "own", 2, 1), (1, "", 3, 2), (2, "", 1, 1), (3, "x", 2, 1), (4, texts[4], 4, 0), (5, None, 1, 0), (6, "", 1, 0), (7, key[:39], 1, 0), (None, key, 1, 0)}
    assert lines.digests(empty).count() == 0


def test_line_index_is_reversible(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    some, rest = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    view = lambda x: (sorted(map(str, x.frequent.collect())), sorted(map(str, x.drops().select("doc_id", lines.F.array_sort("keys").alias("k")).collect())))
    one = lines.LineIndex.build(some)
    both = one.insert(rest)
    assert view(both) == view(lines.LineIndex.build(docs)) != view(one)
    back = both.delete(rest)
    assert view(back) == view(one)
    for index in (both, back):  # no filter misses a frequent key
        filters = {r.shard: lines.CuckooFilter.from_bytes(r.filter) for r in index.filters.collect()}
        for r in index.frequent.collect():
            assert filters[int.from_bytes(r.key[12:16]) % index.shards].contains(bytes(r.key))


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = [rng.bytes(16) for _ in range(6000)]
    f = lines.CuckooFilter(3000)
    for k in keys[:3500] + keys[:50]:  # more than it was made for
        f.insert(k)
    table = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
    assert f.contains_all(table)[:3500].all() and f.contains_all(table)[3500:].mean() < 0.01
    assert [f.contains(k) for k in keys] == f.contains_all(table).tolist()
    g = lines.CuckooFilter.from_bytes(f.to_bytes())
    for k in keys[:3400]:
        assert g.delete(k)
    assert all(g.contains(k) for k in keys[3400:3500] + keys[:50])
    assert g.contains_all(table).mean() < 0.1


def brute_classes(rows, similar=0.8):
    """rows: (doc_id, text); classes by all pairs that share a shingle, from the definition alone."""
    texts = [t or "" for _, t in rows]
    words = [re.findall("[a-z0-9\x80-\U0010ffff]+", t.lower()) for t in texts]
    often = Counter(w for own in words for w in set(own))
    idf = {w: 1 + math.log(max(1, min(1000, (len(rows) + 1) / (n + 1)))) / math.log(1000) for w, n in often.items()}
    sets, at = [], {}
    for i, own in enumerate(words):
        grams = [tuple(own[k : k + 5]) for k in range(len(own) - 4)] if len(own) >= 5 else [tuple(own)] if own else []
        sets.append({g: n * sum(idf[w] for w in g) / len(g) for g, n in Counter(grams).items()})
        for g in sets[-1]:
            at.setdefault(g, []).append(i)
    whole, up = [sum(s.values()) for s in sets], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def link(i, j):
        up[find(i)] = find(j)

    first = {}
    for i, (d, _) in enumerate(rows):
        for k in (("text", texts[i]), ("id", d)) if d is not None else (("text", texts[i]),):
            link(i, first.setdefault(k, i))
    for i in range(len(rows)):
        for j in {j for g in sets[i] for j in at[g] if j < i}:
            a, b = sets[i], sets[j]
            if min(whole[i], whole[j]) >= 0.79 * max(whole[i], whole[j]) and find(i) != find(j):
                low = sum(min(v, b[g]) for g, v in a.items() if g in b)
                if low / (whole[i] + whole[j] - low) >= similar - 1e-6:
                    link(i, j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted([(d, least[find(i)]) for i, (d, _) in enumerate(rows)], key=str)


def test_neardup_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want = brute_classes([tuple(r) for r in docs.collect()])
    got = sorted(map(tuple, neardup.classes(docs).collect()), key=str)
    assert got == want and any(a != b for a, b in got)


def test_neardup_recall(spark):
    """Ids divisible by 20 against all texts: links that an exact search by a prefix filter finds, apart from all bands and centres."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = dict(map(tuple, neardup.classes(docs).collect()))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    own = [texts[i] for i in ids]
    w = neardup._words(own)
    words, n = np.unique(neardup._distinct(w), return_counts=True)
    h, v, first = neardup.shingles(own, neardup.Weights(words[n * neardup.RARE >= len(ids)], n[n * neardup.RARE >= len(ids)], len(ids)))
    doc = np.repeat(np.arange(len(ids)), np.diff(first))
    whole, order = np.bincount(doc, v, len(ids)), np.argsort(h, kind="stable")
    s = h[order]
    often = np.searchsorted(s, h, "right") - np.searchsorted(s, h, "left")
    sets = lambda k: (np.sort(h[first[k] : first[k + 1]]), v[first[k] : first[k + 1]][np.argsort(h[first[k] : first[k + 1]])])
    links = found = 0
    for q in (k for k, d in enumerate(ids) if d % 20 == 0 and first[k] < first[k + 1]):
        a, b = first[q], first[q + 1]
        at = np.argsort(often[a:b], kind="stable")
        prefix = h[a:b][at][v[a:b][at][::-1].cumsum(dtype=np.float64)[::-1] >= 0.7999 * v[a:b].sum(dtype=np.float64)]
        near = {k for i, j in zip(np.searchsorted(s, prefix), np.searchsorted(s, prefix, "right")) for k in doc[order[i:j]].tolist()}
        for k in near:
            if own[k] != own[q] and min(whole[k], whole[q]) >= 0.79 * max(whole[k], whole[q]) and neardup.weighted_jaccard(sets(q), sets(k)) >= 0.8:
                links, found = links + 1, found + (got[ids[q]] == got[ids[k]])
    assert links > 20 and found >= 0.98 * links


def test_neardup_of_a_group_of_edits(spark):
    """Copies with edits of their own: many are near the original only, and not near each other."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    base = [word() for _ in range(400)]
    rows = [(1000, " ".join(base))]
    for i in range(120):
        t = list(base)
        for at in rng.sample(range(400), 7):
            t[at] = word()
        rows.append((i, " ".join(t)))
    rows += [(2000 + i, " ".join(word() for _ in range(300))) for i in range(30)]
    got = dict(map(tuple, neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert sorted(got.items(), key=str) == brute_classes(rows)
    assert {got[d] for d, _ in rows[:121]} == {0} and all(got[d] == d for d, _ in rows[121:])


def in_one_bucket(monkeypatch, tile):
    """All texts share one bucket, and no other; ``tile``: weight of the tiles that they are compared in."""
    monkeypatch.setattr(neardup, "bands", lambda drawn: np.zeros((len(drawn), 1), np.int64))
    monkeypatch.setattr(neardup, "TILE", tile)


@pytest.mark.parametrize("tile", [200_000, 2000])
def test_neardup_of_versions(spark, monkeypatch, tile):
    """Each version is near the one before it only: links between nodes that were no centres count too."""
    in_one_bucket(monkeypatch, tile)
    rows = []
    for chain in range(5):
        text = [f"w{chain}x{i}" for i in range(300)]
        for k in range(5):
            rows.append((10 * chain + k, " ".join(text)))
            text[k * 40 : k * 40 + 20] = [f"v{chain}x{k}x{i}" for i in range(20)]
    got = sorted(map(tuple, neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_classes(rows) and {c for _, c in got} == {0, 10, 20, 30, 40}


@pytest.mark.parametrize("tile", [200_000, 9000])
def test_neardup_of_a_shared_template(spark, monkeypatch, tile):
    """Many different documents with one template in one bucket, some of them near copies; and edits without their original."""
    in_one_bucket(monkeypatch, tile)
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    template, base, rows = words(150), words(200), []
    for i in range(60):
        own = words(80)
        rows.append((2 * i, " ".join(template + own)))
        if i % 3 == 0:
            own[40] = "edited"
            rows.append((2 * i + 1, " ".join(template + own)))
    for i in range(40):
        t = list(base)
        for at in rng.sample(range(200), 3):
            t[at] = f"e{i}"
        rows.append((1000 + i, " ".join(t)))
    got = sorted(map(tuple, neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_classes(rows)
    assert [d for d, c in got if d < 1000 and d != c] == sorted((2 * i + 1 for i in range(0, 60, 3)), key=str)


def test_products_of_tiles_are_the_similarities():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(5, 60))) for _ in range(40)] + ["", "a b"]
    weights = neardup.Weights(neardup._words(["a b c"]).hash, np.array([40, 20, 2]), 42)
    h, v, first = neardup.shingles(texts, weights)
    sets = [(np.sort(h[i:j]), v[i:j][np.argsort(h[i:j])]) for i, j in zip(first, first[1:])]
    left, right = np.arange(25), np.arange(20, 42)
    got = neardup._similarities(*neardup.counted_shingles(texts, weights), left, right)
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            if x != y:  # a text with itself is not asked for
                want = neardup.weighted_jaccard(sets[x], sets[y]) if len(sets[x][0]) and len(sets[y][0]) else 0
                assert abs(got[i, j] - want) < 1e-5


def test_labels_of_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    rng.shuffle(links)
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = dict(map(tuple, neardup.labelled(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: find(x) for x in list(up)}


def test_neardup_odd(spark, odd, empty):
    got = sorted(map(tuple, neardup.classes(odd).collect()), key=str)
    assert got == brute_classes([tuple(r) for r in odd.select("doc_id", "text").collect()])
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns
    assert neardup.classes(empty).count() == 0 and neardup.one_of_each(empty).count() == 0


def test_weighted_samples_meet_with_the_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(1 << 63, size=400).astype(np.uint64)
    w = rng.uniform(1, 3, 400).astype(np.float32)
    a, b = np.arange(300), np.arange(60, 400)
    x = neardup.samples(np.concatenate([h[a], h[b]]), np.concatenate([w[a], w[b]]), np.array([0, 300, 640]), n=2000)
    order = lambda i: (np.sort(h[i]), w[i][np.argsort(h[i])])
    want = neardup.weighted_jaccard(order(a), order(b))
    assert abs((x[0] == x[1]).mean() - want) < 0.04


def rolled(words, xx, gram=5):
    """Hashes of all grams by definition: each word's hash turned left by its place from the gram's end."""
    turn = lambda h, k: (h << k | h >> (64 - k)) & (1 << 64) - 1 if k else h
    out = []
    for i in range(len(words) - gram + 1):
        h = 0
        for k in range(gram):
            h ^= turn(xx(words[i + k]), gram - 1 - k)
        out.append(h)
    return out


def brute_fingerprint(text, xx, window=4):
    """(position, hash) of the chosen grams, from the definition alone."""
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    if not words or len(words) < 5:
        return None
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    g = [signed(h << 2 & (1 << 64) - 1) >> 2 for h in rolled(words, xx)]
    out = []
    for i in range(max(1, len(g) - window + 1)):
        own = g[i : i + window]
        at = max(k for k, h in enumerate(own) if h == min(own)) + i
        if (at, g[at]) not in out:
            out.append((at, g[at]))
    return out


def test_winnowing_equals_the_definition(spark):
    import xxhash

    xx = lambda w: xxhash.xxh64(w.encode(), seed=42).intdigest()
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["a", "b", "Cé", "42"]) for _ in range(rng.choice([0, 1, 4, 5, 6, 7, 8, 9, 30, 200])))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = {}
    for r in winnow.fingerprints(docs).collect():
        got, want = [(x.pos, x.hash) for x in r.fingerprint], brute_fingerprint(rows[r.doc_id][1], xx)
        assert got == want if want is not None else len(got) == (1 if rows[r.doc_id][1] else 0)
        own[r.doc_id] = {h for _, h in got}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in winnow.edited(docs).collect():
        following = (r.doc_id - 1) % len(rows)
        assert abs(r.near_next - alike(own[r.doc_id], own[following])) < 1e-12 and [(x.pos, x.hash) for x in r.marks] and {x.hash for x in r.marks} == own[r.doc_id] or not own[r.doc_id]
        t, n = rows[r.doc_id][1], rows[following][1]
        edited = brute_fingerprint(t[: len(t) - len(t) // 2] + n[: len(t) // 2], xx)
        if edited is not None:
            assert abs(r.near_edited - alike(own[r.doc_id], {h for _, h in edited})) < 1e-12


def test_winnowing_of_scripts_without_blanks(spark):
    text = "春眠不覺曉處處聞啼鳥夜來風雨聲花落知多少"
    docs = spark.createDataFrame([(1, text), (2, "又" + text), (3, "白日依山盡黃河入海流欲窮千里目更上一層樓")], "doc_id long, text string")
    got = {r.doc_id: {x.hash for x in r.fingerprint} for r in winnow.fingerprints(docs).collect()}
    assert len(got[1] & got[2]) >= len(got[1]) - 1 and not got[1] & got[3]


def test_winnowing_guarantee(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for i in range(0, 80, 2):
        shared = [word() for _ in range(8)]
        rows += [(i + k, " ".join([word() for _ in range(rng.randint(0, 30))] + shared + [word() for _ in range(rng.randint(0, 30))])) for k in (0, 1)]
    got = {r.doc_id: {x.hash for x in r.fingerprint} for r in winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] & got[i + 1] for i in range(0, 80, 2))


@pytest.mark.parametrize("buckets", [1, 3, 500])
def test_edited_texts(spark, small, odd, buckets):
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd):
        rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1].encode()), reverse=True)
        want = []
        for i, (d, t) in enumerate(rows):
            n = rows[(i + 1) % len(rows)][1]
            e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
        got = winnow.edited(docs, buckets).collect()
        assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == sorted(want, key=str)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_winnowing_likeness_and_empty(spark, empty):
    assert winnow.edited(empty).count() == 0
    one = winnow.edited(spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.near_edited < 1
    same = winnow.edited(spark.createDataFrame([(i, "same words here for all of us and all of you") for i in range(3)] + [(9, ""), (10, None)], "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in same if r.doc_id < 5}) == 1 and next(r for r in same if r.doc_id == 10).near_next == 1


def test_urls_equal_sql(spark, small):
    got = queries.op9_urls_as_of(spark, small).collect()
    assert sorted(map(tuple, got), key=str) == oracle("op9_urls_as_of", small)


def test_urls_as_of(spark):
    log = spark.createDataFrame(
        [("bad", "d:evil.com", "add", "2024-01-10"), ("bad", "d:evil.com", "add", "2024-01-12"), ("bad", "d:evil.com", "remove", "2024-02-01"), ("bad", "d:evil.com", "remove", "2024-02-02"), ("bad", "d:evil.com", "add", "2024-03-01"),
         ("ads", "u:shop.org/ads", "add", "2024-01-01"), ("ads", "u:shop.org/ads", "add", "2024-01-01"), ("ads", None, "add", "2024-01-01"), ("ads", "d:x.org", "remove", "2024-01-01"), ("v6", "u:[2001:db8::1]/", "add", "2024-01-01"), ("one", "d:same.org", "remove", "2024-01-05"), ("one", "d:same.org", "add", "2024-01-05")],
        "list string, key string, action string, at string").withColumn("at", urls.F.to_timestamp("at"))
    cases = [(1, "https://www.EVIL.com/x", "2024-01-09", 0), (2, "https://a.b.evil.com:80/", "2024-01-10", 1), (3, "//evil.com", "2024-02-01", 0), (4, "http://u@evil.com?q", "2024-05-01", 1), (5, "http://notevil.com/", "2024-05-01", 0),
             (6, "http://shop.org/ads/7?x", "2024-05-01", 1), (7, "http://shop.org/Ads", "2024-05-01", 0), (8, None, "2024-05-01", 0), (9, "nonsense", "2024-05-01", 0), (10, "http://x.org", "2024-05-01", 0), (13, "http://[::1]:8080/x", "2024-05-01", 0), (14, "http://u@[2001:db8::1]/", "2024-05-01", 1), (11, "http://same.org/", "2024-01-05", 1), (12, "http://evil.com", None, 0), (1, "https://www.EVIL.com/x", "2024-01-20", 1)]
    got = urls.active(spark.createDataFrame([c[:3] for c in cases], "page_id long, url string, at string").select("page_id", "url", urls.F.to_timestamp("at").alias("fetched_at")), log)
    assert sorted((r.page_id, r.n_active) for r in got.collect()) == sorted((c[0], c[3]) for c in cases)
    assert urls.active(got.limit(0).selectExpr("page_id", "host as url", "current_timestamp() as fetched_at"), log).count() == 0


def test_pipeline(spark, small, odd):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    now, sizes = docs, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        now = p.stored(stage(spark, now, small))
        assert now.columns == docs.columns, name
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    pieces = p.run(spark, small).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in now.collect()}
    for name, stage in p.STAGES:
        assert stage(spark, odd, small).count() >= 1, name
        assert stage(spark, odd.limit(0), small).count() == 0, name
