"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words in a row (a text of fewer words is one shingle). Its weight is its number in the
text times its IDF: the mean of its words' smoothed inverse document frequencies. These are counted
exactly over all documents and clipped at ``RARE``: a word in fewer than one of a thousand documents
weighs as one in just so many. So only words beyond that are looked up, and there are at most a thousand
times as many of them as a document has distinct words on average, whatever the size of the corpus.

Each sample of a text is drawn by Ioffe's improved consistent weighted sampling, so two texts share it with
the probability of their weighted Jaccard similarity. Three samples make a band; texts that share one of
ten bands' buckets are candidates (at similarity 0.8, all but one pair in a thousand), unless their whole
weights differ by too much to be that similar. Equal texts are one node, named by the MD5 of the text.

Candidates are verified by their exact weighted Jaccard similarity, from their whole texts. First every node
of a bucket is compared with one centre, the node that meets most others (of a text and its edits, the text):
a star, whose centre's text is sent once for each ``STAR`` texts. Links are contracted to classes. What is
left to compare then are pairs of different classes that share a bucket, so they share its centre too. The
nodes of each centre that are still of several classes are dealt into tiles of about ``TILE`` weight, and
every two tiles are compared in one task by products of their shingle matrices: no pair becomes a row, and a
group of one tile moves each text once. A group of n tiles moves each n times; that is the cost of testing
all pairs of a large group whose members are about as similar as the bound, and no pair is left out.

Defined results: equal texts (null counts as empty) are one class; texts without words are only ever in a
class with equal texts; rows with the same doc_id are one document, so their texts are in one class; a
row without doc_id has the class of its text, or none where no row with an id is in it; the class id is
the smallest doc_id; texts of any length are taken whole; repeated rows give repeated rows; an empty table
gives an empty table; other columns are left out by classes() and kept by one_of_each().
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import anti_join, arrow_stage, discard, semi_join, stored, texts_of
from spindrift.llm.words import BY_LETTER, Words, groups, mix

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 10, 3
#: A word in fewer than one of so many documents weighs as one in just so many.
RARE = 1000
#: Texts compared with one copy of a centre; weight of the shingles of a tile, some hundred kilobytes of text at most.
STAR, TILE = 64, 100_000
_U = np.uint64


def _words(texts: list[str]) -> Words:
    return Words([t.lower() for t in texts], BY_LETTER)


class Weights:
    """IDF by word: ``words`` are hashes in order, ``idf`` theirs; all other words have ``other``."""

    def __init__(self, words: np.ndarray, frequencies: np.ndarray, documents: int):
        order = np.argsort(words)
        self.words, self.idf = words[order], _idf(frequencies[order], documents)
        self.other = np.float32(_idf(np.array([0]), documents)[0])

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), self.other, np.float32)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.idf[at], self.other)


def _idf(frequencies: np.ndarray, documents: int) -> np.ndarray:
    """1 for a word of all documents, 2 for one in fewer than one of ``RARE``."""
    share = np.minimum((documents + 1) / (frequencies + 1), RARE)
    return (1 + np.log(np.maximum(share, 1)) / np.log(RARE)).astype(np.float32)


def word_weights(docs: DataFrame) -> Weights:
    """Exact document frequencies of all words, summed within tasks before they move; those of the frequent ones are gathered."""
    n = docs.count()

    def rows(batches, room=1 << 20):
        word, count = np.zeros(0, _U), np.zeros(0, np.int64)
        for _, texts in groups(batches):
            w = _words(texts)
            own = _distinct(w)
            word, count = _summed(np.concatenate([word, own]), np.concatenate([count, np.ones(len(own), np.int64)]))
            if len(word) > room:
                yield from zip(word.view(np.int64).tolist(), count.tolist())
                word, count = word[:0], count[:0]
        yield from zip(word.view(np.int64).tolist(), count.tolist())

    every = arrow_stage(texts_of(docs), rows, "word long, n long", batch=20_000)
    often = every.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") * RARE >= n).toPandas()  # at most RARE times the mean number of a document's words
    return Weights(often["word"].to_numpy(np.int64).view(_U), often["n"].to_numpy(np.int64), n)


def _distinct(w: Words) -> np.ndarray:
    """The hashes of each document's distinct words, one document after the other or not."""
    key = mix(w.hash + w.doc.astype(_U) * _U(0x9E3779B97F4A7C15))
    return w.hash[np.unique(key, return_index=True)[1]]


def _summed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(words, kind="stable")
    words = words[order]
    at = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
    return words[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def shingles(texts: list[str], weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles' hashes, their weights, first index of each text's shingles; then their number)."""
    h, v, times, first = counted_shingles(texts, weights)
    return h, v * times.astype(np.float32), first


def counted_shingles(texts: list[str], weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles' hashes, their IDF, how often each stands in its text, first index of each text's shingles)."""
    w = _words(texts)
    n = np.diff(w.first)
    own = weights.of(w.hash)
    last = len(w.hash) - SHINGLE + 1
    if last > 0:
        h, v = w.hash[:last] * _U(0x100000001B3), own[:last].copy()
        for k in range(1, SHINGLE):
            h = (h ^ (w.hash[k : last + k] >> _U(k))) * _U(0x100000001B3)
            v += own[k : last + k]
        whole = w.doc[:last] == w.doc[SHINGLE - 1 :]
        h, v, d = mix(h[whole]), v[whole] / np.float32(SHINGLE), w.doc[:last][whole]
    else:
        h, v, d = np.zeros(0, _U), np.zeros(0, np.float32), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        more = [(mix(np.array([int.from_bytes(hashlib.blake2b(w.hash[w.first[i] : w.first[i + 1]].tobytes(), digest_size=8).digest(), "little")], _U))[0], own[w.first[i] : w.first[i + 1]].mean()) for i in short]
        h = np.concatenate([h, np.array([x for x, _ in more], _U)])
        v = np.concatenate([v, np.array([x for _, x in more], np.float32)])
        d = np.concatenate([d, short])
    key = mix(h + d.astype(_U) * _U(0x9E3779B97F4A7C15))  # one number for a shingle of a text
    _, at, times = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(d[at], kind="stable")
    at, times = at[order], times[order]
    return h[at], v[at], times, np.searchsorted(d[at], np.arange(len(texts) + 1))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of the Gamma(2, 1) distribution: r, 1 / r, and ln c, at 65,536 midpoints."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.sqrt(2 * p) + p  # then Newton steps on 1 - (1 + x) exp(-x) = p
    for _ in range(60):
        x = np.maximum(1e-9, x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x) + 1e-300))
    return x.astype(np.float32), (1 / x).astype(np.float32), np.log(x).astype(np.float32)


def samples(h: np.ndarray, weights: np.ndarray, first: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n consistent weighted samples of each text that has shingles: rows of hashes of (shingle, t)."""
    r_of, inverse, log_c = _tables()
    some = np.flatnonzero(np.diff(first) > 0)
    at, log_w = first[:-1][some], np.log(weights)
    out = np.empty((len(some), n), np.uint32)
    for k in range(n):
        bits = mix(h ^ _U((k + 1) * 0xD1B54A32D192ED03 & (2**64 - 1)))
        a = (bits & _U(0xFFFF)).astype(np.int32)
        c = (bits >> _U(16) & _U(0xFFFF)).astype(np.int32)
        beta = (bits >> _U(40)).astype(np.float32) / np.float32(1 << 24)
        t = np.floor(log_w * inverse[a] + beta)
        log_a = log_c[c] - r_of[a] * (t - beta + np.float32(1))
        drawn = (bits ^ (t.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15))) * _U(0xBF58476D1CE4E5B9) >> _U(32)
        # the order of positive floats is that of their bits; the sample rides along in the lower half
        order = np.maximum(log_a + np.float32(96), np.float32(1e-6)).view(np.uint32).astype(_U) << _U(32) | drawn
        out[:, k] = (np.minimum.reduceat(order, at) & _U(0xFFFFFFFF)).astype(np.uint32) if len(at) else 0
    return out


def bands(drawn: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's bands."""
    x = drawn.reshape(len(drawn), BANDS, ROWS).astype(_U)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), x.shape[:2])
    for k in range(ROWS):
        h = mix(h ^ x[:, :, k])
    return h.view(np.int64)


def _node(text: str):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, node (MD5 of the text), weight of all shingles, bands (null for a text without words)."""

    def rows(batches):
        for ids, texts in groups(batches):
            h, v, first = shingles(texts, weights)
            own = iter(bands(samples(h, v, first)).tolist())
            total = np.concatenate([[0], np.cumsum(v, dtype=np.float64)])
            total = total[first[1:]] - total[first[:-1]]
            for (d,), t, w in zip(ids, texts, total.tolist()):
                yield d, hashlib.md5(t.encode("utf-8", "surrogatepass")).digest(), w, next(own) if w > 0 else None

    return arrow_stage(texts_of(docs), rows, "doc_id long, node binary, weight double, bands array<long>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (shingles in order, weights): sum of the smaller weights over sum of the larger ones."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    low = np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64)
    return low / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - low)


def _close(a: str, b: str, similar: float):
    """Whether whole weights allow the similarity; a little below, for sums of rounded numbers."""
    return F.least(a, b) >= (similar - 1e-4) * F.greatest(a, b)


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are at least ``similar``. ``texts``: node and text, one row for each a and b.

    Groups are a centre b and at most about STAR of its a, so no text moves more often than once for each pair, and
    a centre's once for each group."""
    many = pairs.groupBy("b").agg(F.count("a").alias("n")).where(F.col("n") > STAR).withColumnRenamed("b", "hub")
    split = F.pmod(F.xxhash64("a"), F.coalesce(F.ceil(F.col("n") / STAR), F.lit(1)))
    salted = stored(pairs.join(many, pairs["b"] == many["hub"], "left").select("a", "b", split.cast("int").alias("salt")))
    members = salted.join(texts.withColumnRenamed("node", "a"), "a").select("b", "salt", F.lit(1).alias("role"), F.col("a").alias("node"), "text")
    centres = salted.select("b", "salt").distinct().join(texts.withColumnRenamed("node", "b"), "b").select("b", "salt", F.lit(0).alias("role"), F.col("b").alias("node"), "text")
    stars = members.unionByName(centres).repartition("b", "salt").sortWithinPartitions("b", "salt", "role")

    def rows(batches):
        centre, of = None, None
        for told, own in groups(batches, columns=("b", "salt", "role", "node")):
            h, v, first = shingles(own, weights)
            for (b, salt, role, node), i, j in zip(told, first.tolist(), first[1:].tolist()):
                order = np.argsort(h[i:j])
                vector = h[i:j][order], v[i:j][order]
                if role == 0:
                    centre, of = vector, (b, salt)
                elif of == (b, salt) and len(centre[0]) and len(vector[0]) and weighted_jaccard(centre, vector) >= similar - 1e-6:
                    yield node, b

    found = stored(arrow_stage(stars, rows, "a binary, b binary"))
    discard(salted)
    return found


def labelled(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component that the links (a, b) make; nodes that stand alone are left out.

    In every pass each node of the graph goes to the smallest among itself and its neighbours, then links are drawn
    between where their ends went. As nodes are hashes, a graph shrinks by a constant share a pass on average; a
    star is done in three. Minima are taken before rows move, so a hub gathers nothing."""
    edges, label = stored(links.select("a", "b").where("a <> b").distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        goes = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        if label is None:
            now = stored(goes.toDF("node", "label"))
            goes = now.toDF("node", "to")
        else:
            goes = stored(goes)
            step = label.join(goes.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            now = stored(step)
            discard(label)
        ends = edges.join(goes.toDF("a", "x"), "a").join(goes.toDF("b", "y"), "b").where("x <> y")
        fewer = stored(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(edges, goes if label is not None else None)
        edges, label = fewer, now
        if not edges.limit(1).count():
            discard(edges)
            return label


def _similarities(h: np.ndarray, v: np.ndarray, times: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of the texts ``left`` with the texts ``right``.

    A shingle that stands n times in a text is n items; then what two texts share is a product of matrices of
    items, made a block of items at a time, of those that several texts have."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    often = int(times.max(initial=1))
    items = [(h[at], v[at], text[at], n) for n in range(1, often + 1) if len(at := np.flatnonzero(times >= n))]
    whole = np.bincount(text, v * times, len(first) - 1)
    shared = np.zeros((len(left), len(right)), np.float64)
    row, column = np.full(len(first) - 1, -1), np.full(len(first) - 1, -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    for key, weight, t, _ in items:
        key, code, n = np.unique(key, return_inverse=True, return_counts=True)
        some = np.flatnonzero(n[code] > 1)
        code, t, weight = code[some], t[some], weight[some]
        order = np.argsort(code, kind="stable")
        code, t, weight = np.cumsum(np.diff(code[order], prepend=-1) > 0) - 1, t[order], weight[order]
        for start in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
            i, j = np.searchsorted(code, [start, start + 2048])
            c, own, w = code[i:j] - start, t[i:j], weight[i:j]
            a, b = np.zeros((len(left), 2048), np.float32), np.zeros((2048, len(right)), np.float32)
            x, y = row[own] >= 0, column[own] >= 0
            a[row[own[x]], c[x]] = w[x]
            b[c[y], column[own[y]]] = 1
            shared += a @ b
    total = whole[left][:, None] + whole[right][None]
    return shared / np.maximum(total - shared, 1e-9)


def _links_of_tiles(rest: DataFrame, texts: DataFrame, weights: Weights, similar: float) -> DataFrame:
    """(a, b): links between nodes of different labels in each group of ``rest`` (centre, node, label, tiles), enough to join all that are linked."""
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    placed = rest.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1)))
    placed = placed.select("centre", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "label").join(texts, "node")
    dealt = placed.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j")

    def links(told, own):
        tiles = np.array([tile for _, _, _, tile, _, _ in told])
        left = np.flatnonzero(tiles == told[0][1])
        right = np.flatnonzero(tiles == told[0][2])
        h, v, times, first = counted_shingles(own, weights)
        near = _similarities(h, v, times, first, left, right) >= similar - 1e-6
        label = [x[5] for x in told]
        up = {x: x for x in label}

        def find(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for i, j in zip(*np.nonzero(near)):
            x, y = left[i], right[j]
            if (a := find(label[x])) != (b := find(label[y])):
                up[a] = b
                yield told[x][4], told[y][4]

    def rows(batches):
        of, told, own = None, [], []
        for b in batches:
            for x in zip(b["centre"], b["i"], b["j"], b["tile"], b["node"], b["label"], b["text"]):
                if x[:3] != of:
                    if len({y[5] for y in told}) > 1:
                        yield from links(told, own)
                    of, told, own = x[:3], [], []
                told.append(x[:6])
                own.append(x[6])
        if len({y[5] for y in told}) > 1:
            yield from links(told, own)

    return stored(arrow_stage(dealt, rows, "a binary, b binary"))


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id: one row for each row of ``docs``."""
    weights = word_weights(docs)
    every = stored(signatures(docs, weights))
    nodes = stored(every.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"), F.first("bands").alias("bands")))
    links = _of_one_id(every)
    spread = nodes.where("first_id is not null and bands is not null").select("node", "first_id", "weight", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("node").alias("size")).where("size > 1")
    in_band = stored(spread.join(shared, "bucket"))
    # the centre of a bucket is the node that meets the most nodes in all its buckets
    meets = in_band.groupBy("node").agg(F.sum("size").alias("meets"))
    ranked = in_band.join(meets, "node").select("bucket", F.struct(-F.col("meets"), F.xxhash64("node"), "node", "weight").alias("rank"))
    chosen = stored(ranked.groupBy("bucket").agg(F.min("rank").alias("c")).select("bucket", F.col("c.node").alias("centre"), F.col("c.weight").alias("heavy")))
    pairs = in_band.join(chosen, "bucket").where((F.col("node") != F.col("centre")) & _close("weight", "heavy", similar))
    pairs = stored(pairs.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct())
    texts = _texts(docs, in_band)
    found = verified(pairs, texts, weights, similar)
    labels = labelled(found.unionByName(links))
    rest = _unfinished(in_band, chosen, labels)
    discard(found, in_band, chosen, pairs)
    if rest.limit(1).count():
        found = _links_of_tiles(rest, texts, weights, similar)
        if found.limit(1).count():
            labels = _joined(labels, found)
        discard(found)
    discard(rest, texts)
    return _with_class(every, nodes, labels)


def _of_one_id(every: DataFrame) -> DataFrame:
    """Links between the texts of rows with one doc_id."""
    several = every.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("other")).where("b <> other").select("doc_id", "b")
    return every.join(several, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")


def _texts(docs: DataFrame, in_band: DataFrame) -> DataFrame:
    """node, text of the nodes in buckets, each from the row with its smallest doc_id: no other copy of a text moves."""
    wanted = stored(in_band.select("first_id", "node").distinct())
    ids = stored(wanted.select("first_id").distinct())
    own = semi_join(texts_of(docs), "doc_id", ids).withColumn("node", _node("text"))
    own = stored(own.join(wanted.withColumnRenamed("first_id", "doc_id"), ["doc_id", "node"], "left_semi").select("node", "text").dropDuplicates(["node"]))
    discard(wanted, ids)
    return own


def _unfinished(in_band: DataFrame, chosen: DataFrame, labels: DataFrame) -> DataFrame:
    """centre, node, label, tiles: of each centre's buckets the other nodes, where they are of several classes."""
    here = in_band.join(chosen, "bucket").where("node <> centre").select("centre", "node", "weight").distinct()
    here = stored(here.join(labels, "node", "left").select("centre", "node", "weight", F.coalesce("label", "node").alias("label")))
    mixed = here.groupBy("centre").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.sum("weight") / TILE).alias("tiles")).where("low <> high")
    rest = stored(here.join(mixed.select("centre", "tiles"), "centre").select("centre", "node", "label", "tiles"))
    discard(here)
    return rest


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of the nodes after more links: the graph is that of classes."""
    known = lambda c, out: F.coalesce(F.col(out), F.col(c)).alias(c)
    ends = links.join(labels.toDF("a", "x"), "a", "left").join(labels.toDF("b", "y"), "b", "left").select(known("a", "x"), known("b", "y"))
    over = labelled(ends)
    alone = over.join(labels.select("node"), "node", "left_anti")
    out = stored(labels.join(over.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")).unionByName(alone.select("node", "label")))
    discard(labels, over)
    return out


def _with_class(every: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, class_id. A text with more than a thousandth of all rows is joined by broadcast, and there are at most a thousand of them."""
    linked = nodes.join(labels, "node")
    least = linked.groupBy("label").agg(F.min("first_id").alias("class_id"))
    of_node = nodes.join(linked.join(least, "label").select("node", "class_id"), "node", "left").select("node", "n", F.coalesce("class_id", "first_id").alias("class_id"))
    of_node = stored(of_node)
    total = every.count()
    hot = F.broadcast(of_node.where(F.col("n") * 1000 > total).select("node", "class_id"))
    discard(nodes, labels)
    rows = every.select("doc_id", "node")
    usual = rows.join(hot, "node", "left_anti").join(of_node.select("node", "class_id"), "node")
    return rows.join(hot, "node").select("doc_id", "class_id").unionByName(usual.select("doc_id", "class_id"))


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of the smallest doc_id of each class, and rows without doc_id."""
    gone = stored(classes(docs, similar).where("doc_id <> class_id").select("doc_id").distinct())
    return anti_join(docs, "doc_id", gone)
