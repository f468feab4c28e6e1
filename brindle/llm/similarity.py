"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with equal shingle sets are one vertex. Vertices that share a band of MinHash values meet; a pair
is dropped once the posterior probability that its similarity reaches the threshold falls below a
tolerance. What is left connects vertices to families, and a family's pairs are compared in blocks: again by
MinHash values, some at a time, and those left exactly on the shingles. A block gives each vertex's number
of links and a spanning star of its links, never the pairs themselves, so that a family of n texts gives
about n * n / block rows. Blocks whose sets differ too much in size for a link don't meet.

A band that many vertices share is refined by each of the others, so that chance and templates don't draw
unlike texts into one family; what many share even then is a family without comparing pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .anchors import Units
from .common import CARRIED, carrying, discard, folded_words, identified, map_rows, scratch, ship, struct_of, table

#: Words of a shingle; the similarity of a link, as a fraction.
SHINGLE, OVER, UNDER = 5, 4, 5
#: MinHash values in bands of 4: of two texts with similarity 0.8 one in 10^9 shares none of the 40 bands.
BANDS, BAND = 40, 4
HASHES = BANDS * BAND
#: MinHash values compared before each look at the posterior, and the tolerance.
LOOK, TOLERANCE = 32, 1e-8
#: Vertices in a block, and bytes of their shingles.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Sizes of sets in one level of a family go up by this factor; a little more than 1.25, so that rounding doesn't matter.
LEVEL = 1.26
#: Vertices that share a band, beyond which it is refined by each of the NEXT bands. Of two texts with similarity 0.8 five in
#: 10^7 share no two bands that lie so close together.
LARGE, NEXT = 256, 8

RANDOM = np.random.default_rng(20240229)
FACTORS = RANDOM.integers(0, 1 << 32, (2, HASHES), np.uint32) | np.uint32(1)
ADDENDS = RANDOM.integers(0, 1 << 32, HASHES, np.uint32)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles of lower-cased words; a text of fewer words is one shingle."""
    words = folded_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(Units(True, size, size, False).grams(h))


def min_hashes(grams: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingle hashes."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(low), 512):
        x = low[lo : lo + 512, None] * FACTORS[0] + ADDENDS
        x ^= x >> np.uint32(15)
        x *= FACTORS[1]
        np.minimum(out, x.min(0), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different from band to band."""
    raw = values.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(raw[k * BAND * 4 : (k + 1) * BAND * 4], seed=k) for k in range(BANDS)], np.uint64).view(np.int64)


def least_matches(threshold: float = OVER / UNDER, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(compared, fewest matches that keep a pair) at each look.

    With a uniform prior the posterior of the similarity after m matches of t is Beta(m + 1, t - m + 1);
    its mass above the threshold is the chance of at most m successes in t + 1 draws at the threshold.
    """
    out = []
    for t in range(LOOK, HASHES + 1, LOOK):
        mass = 0.0
        for m in range(t + 1):
            mass += math.comb(t + 1, m) * threshold**m * (1 - threshold) ** (t + 1 - m)
            if mass >= tolerance:
                out.append((t, m))
                break
    return out


LOOKS = least_matches()


def outlast(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of rows of MinHash values outlast the looks. With 8 bits of each value chance matches keep pairs, and never drop any."""
    alive, same, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for t, least in LOOKS:
        same = same + (left[alive, done:t] == right[alive, done:t]).sum(1)
        alive, same, done = alive[same >= least], same[same >= least], t
    return alive


def connect_members(members: DataFrame) -> DataFrame:
    """Edges (a, b) between vertices of one key that outlast the looks: for each vertex one to the smallest that they lead to.

    members has key, uid and signature. A task takes its rows in order of keys, some keys at a time.
    """
    ship(members.sparkSession)

    def edges(key, uid, signature):
        pairs = []
        for d in range(1, len(key)):
            i = np.flatnonzero(key[d:] == key[:-d])
            if not len(i):
                break
            for lo in range(0, len(i), 1 << 14):
                at = i[lo : lo + (1 << 14)]
                at = at[outlast(signature[at], signature[at + d])]
                pairs.append((at, at + d))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        root = stars(len(key), a, b)
        own = np.flatnonzero(root != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(uid[own]), pa.array(uid[root[own]])], names=["a", "b"])

    def run(batches):
        held: list[np.ndarray] | None = None
        for batch in batches:
            signature = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, HASHES)
            now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), signature]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if whole:
                yield edges(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if held is not None:
            yield edges(*held)

    return members.select("key", "uid", "signature").repartition("key").sortWithinPartitions("key", "uid").mapInArrow(run, struct_of("a long, b long"))


def met(keys: DataFrame) -> DataFrame:
    """uid and key of the keys that several vertices have, with how many (n) and the smallest of them (hub)."""
    several = keys.groupBy("key").agg(F.min("uid").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    return keys.join(several.hint("merge"), "key")


def families_of(seen: DataFrame, vertex: DataFrame, large: int) -> DataFrame:
    """node, label: vertices that similar ones may connect. seen has uid, bands and signature; vertex the uids that are vertices."""
    n_bands = F.size("bands")
    first = scratch(met(seen.join(vertex, "uid", "left_semi").select("uid", F.posexplode("bands").alias("place", "key"))), "bands")
    hot = first.filter(F.col("n") > large).select("uid", "place", F.col("key").alias("band")).join(seen.select("uid", "bands"), "uid")
    others = F.explode(F.array(*(F.get("bands", (F.col("place") + d) % n_bands) for d in range(1, NEXT + 1))))
    refined = scratch(met(hot.select("uid", "band", others.alias("other")).select("uid", F.xxhash64(F.least("band", "other"), F.greatest("band", "other")).alias("key")).distinct()), "refined")
    small = F.col("n") <= large
    members = first.filter(small).select("uid", "key").union(refined.filter(small).select("uid", "key")).join(seen.select("uid", "signature"), "uid")
    # what many share even then: a vertex leads to the least of its hubs, and so do its other hubs
    led = refined.filter(~small).groupBy("uid").agg(F.min("hub").alias("b"), F.collect_set("hub").alias("hubs"))
    edges = connect_members(members).union(led.select(F.col("uid").alias("a"), "b")).union(led.select(F.explode("hubs").alias("a"), "b").distinct())
    return connected(edges, "families")


def candidates(left: np.ndarray, right: np.ndarray, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that outlast the looks; with upper, only pairs a < b of one block."""
    matches = np.zeros((len(left), len(right)), np.int16)
    for k in range(LOOK):
        matches += left[:, k, None] == right[None, :, k]
    alive = matches >= LOOKS[0][1]
    a, b = np.nonzero(np.triu(alive, 1) if upper else alive)
    same = matches[a, b].astype(np.int64)
    for t, least in LOOKS[1:]:
        for lo in range(0, len(a), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            same[part] += (left[a[part], t - LOOK : t] == right[b[part], t - LOOK : t]).sum(1)
        keep = same >= least
        a, b, same = a[keep], b[keep], same[keep]
    return a, b


def verified(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of the threshold or more, exactly."""
    if not len(a):
        return np.zeros(0, bool)
    used = np.unique(np.concatenate([a, b]))
    row = np.full(len(sets), -1)
    row[used] = np.arange(len(used))
    sizes = np.array([len(sets[u]) for u in used])
    value, inverse, count = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    column = (np.cumsum(count > 1) - 1)[inverse]
    owner, shared = np.repeat(np.arange(len(used)), sizes), (count > 1)[inverse]
    owner, column = owner[shared], column[shared]
    common = np.zeros(len(a), np.int64)
    width = max(256, (1 << 22) // len(used))
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        if len(a) * 8 < len(used) ** 2 // 8:  # few pairs: compare rows of bits
            held = np.zeros((len(used), width), bool)
            held[owner[i:j], column[i:j] - lo] = True
            for p in range(0, len(a), 256):
                common[p : p + 256] += (held[row[a[p : p + 256]]] & held[row[b[p : p + 256]]]).sum(1)
        else:
            held = np.zeros((len(used), width), np.float32)
            held[owner[i:j], column[i:j] - lo] = 1
            common += (held @ held.T)[row[a], row[b]].astype(np.int64)
    union = sizes[row[a]] + sizes[row[b]] - common
    return UNDER * common >= OVER * union


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that links lead to."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


CELL = "uid long, links long, root long"


def compare_cell(cell: pa.Table) -> pa.Table:
    """Links within one block, or between two blocks, of a family."""
    cell = cell.sort_by("uid")
    uid = cell["uid"].to_numpy()
    values = np.frombuffer(b"".join(cell["hashes"].to_pylist()), np.uint32).reshape(-1, HASHES)
    sets = [np.frombuffer(s, np.uint64) for s in cell["shingles"].to_pylist()]
    i, j, block = cell["i"][0].as_py(), cell["j"][0].as_py(), cell["block"].to_numpy()
    if i == j:
        left = right = np.arange(len(uid))
    else:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    a, b = candidates(values[left], values[right], i == j)
    a, b = left[a], right[b]
    ok = verified(sets, a, b)
    a, b = a[ok], b[ok]
    links = np.bincount(a, minlength=len(uid)) + np.bincount(b, minlength=len(uid))
    root = stars(len(uid), a, b)
    has = links > 0
    return pa.table({"uid": uid[has], "links": links[has].astype(np.int64), "root": uid[root][has]})


#: Rounds of `connected` beyond which it raises; simulated chains of 131072 nodes took 14 to 17, a bound is not proven.
MOST_ROUNDS = 200


def connected(edges: DataFrame, name: str, rounds: int = MOST_ROUNDS) -> DataFrame:
    """node, label: the smallest node that edges (a, b) lead to.

    Labels go to neighbours, to the label that a neighbour had so far (so that a whole tree follows, wherever a
    smaller label meets it) and then to their labels' labels, until they stand still. Labels that don't stand
    still within the given rounds raise an error.
    """
    both = scratch(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), name)
    labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), name)
    total = None
    for _ in range(rounds):
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            discard(both)
            return labels
        total = now
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        least = F.least("label", "m")
        sent = labels.join(near, "node").select(F.explode(F.array(F.struct("node", least.alias("label")), F.struct(F.col("label").alias("node"), least.alias("label")))).alias("x")).select("x.*")
        step = scratch(sent.groupBy("node").agg(F.min("label").alias("label")), name)
        discard(labels)
        labels = scratch(step.join(step.select(F.col("node").alias("label"), F.col("label").alias("m")), "label", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label")), name)
        discard(step)
    raise RuntimeError(f"{name}: labels still change after {rounds} rounds")


def blocks_of(sized: DataFrame, block: int) -> DataFrame:
    """label, level, base (first block), n (blocks of the level) and others (the blocks that its vertices meet).

    Sets of similarity 0.8 differ in size by a quarter at most, so that in a family of several blocks a level meets
    itself and the next ones alone. A family of one block is left whole. sized: label, level, size of each vertex.
    """
    count = lambda n, size: F.ceil(F.greatest(n / block, 8 * size / BLOCK_BYTES)).cast("long")
    family = W.partitionBy("label")
    levels = sized.groupBy("label", "level").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    levels = levels.withColumns({"whole": count(F.sum("c").over(family), F.sum("s").over(family)), "n": count(F.col("c"), F.col("s"))})
    levels = levels.withColumn("of", F.map_from_entries(F.collect_list(F.struct("level", "n")).over(family)))
    start = lambda level: F.shiftleft(level, 32)
    near = F.flatten(F.transform(F.filter(F.array(*(F.col("level") + d for d in (-1, 0, 1))), lambda x: F.map_contains_key("of", x)), lambda x: F.sequence(start(x), start(x) + F.element_at("of", x) - 1)))
    one, zero = F.col("whole") == 1, F.lit(0).cast("long")
    return levels.select("label", "level", F.when(one, zero).otherwise(start(F.col("level"))).alias("base"), F.when(one, F.lit(1).cast("long")).otherwise(F.col("n")).alias("n"), F.when(one, F.array(zero)).otherwise(near).alias("others"))


def join_similar(docs: DataFrame, block: int = BLOCK, large: int = LARGE) -> DataFrame:
    """Classes of texts linked by a Jaccard similarity of 0.8 or more of their shingle sets.

    docs needs doc_id and text; other columns are left out. Shingles are five lower-cased words (A-Z) of
    [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; a text of one to four words is one shingle. Null and empty
    texts have none and are classes of their own. Texts with equal sets, repeated rows included, are
    copies: one vertex, whose links are counted to other vertices. Every row gives one row, an empty table
    none. Returns doc_id, class_id (smallest doc_id that links or copies lead to), n_links (vertices
    linked to this one), n_copies (rows with this set, itself included).
    """
    rows = identified(docs, F.col("text").cast("binary").alias("text"))
    return classes_of(rows, block, large).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, block: int = BLOCK, large: int = LARGE) -> DataFrame:
    """One row of each class of `join_similar`: that with the smallest doc_id. All columns stay."""
    rows = identified(docs, F.col("text").cast("binary").alias("text"), *carrying(docs, True))
    classes = classes_of(rows.select("uid", "doc_id", "text"), block, large)
    return rows.join(classes.filter("first").select("uid"), "uid", "left_semi").select(f"{CARRIED}.*")


def classes_of(rows: DataFrame, block: int, large: int) -> DataFrame:
    """The join over rows with uid, doc_id and text (binary); first marks one row of each class."""
    ship(rows.sparkSession)

    def sketch(uid, doc_id, text):
        out: list[list] = [[] for _ in range(4)]
        for t in text:
            s = shingles(t)
            values = min_hashes(s) if len(s) else None
            out[0].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            out[1].append(band_keys(values) if len(s) else None)
            out[2].append(values.astype(np.uint8).tobytes() if len(s) else None)
            out[3].append(len(s))
        return [uid, doc_id, *out]

    seen = scratch(map_rows(rows.select("uid", "doc_id", "text"), sketch, "uid long, doc_id long, key binary, bands array<long>, signature binary, size int", as_bytes=True), "sketches")
    vertex = seen.filter("key is not null").groupBy("key").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("o"), "uid"))["uid"].alias("vertex"), F.count("*").alias("n_copies"))
    families = families_of(seen, vertex.select(F.col("vertex").alias("uid")), large)

    sized = families.join(seen.select(F.col("uid").alias("node"), "size"), "node").withColumn("level", F.floor(F.log("size") / math.log(LEVEL)).cast("long"))
    member = sized.join(blocks_of(sized, block), ["label", "level"]).select(F.col("node").alias("uid"), "label", "others", (F.col("base") + F.pmod(F.xxhash64("node"), F.col("n"))).alias("block"))

    def detail(uid, text, label, others, at):
        sets = [shingles(t) for t in text]
        return [uid, label, others, at, [min_hashes(s).tobytes() for s in sets], [s.tobytes() for s in sets]]

    detailed = map_rows(rows.select("uid", "text").join(member.hint("merge"), "uid").select("uid", "text", "label", "others", "block"), detail, "uid long, label long, others array<long>, block long, hashes binary, shingles binary", as_bytes=True, rows=64)
    cells = detailed.withColumn("other", F.explode("others")).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "others")
    found = scratch(cells.groupBy("label", "i", "j").applyInArrow(compare_cell, struct_of(CELL)), "links")

    degree = found.groupBy(F.col("uid").alias("vertex")).agg(F.sum("links").alias("n_links"))
    component = connected(found.select(F.col("uid").alias("a"), F.col("root").alias("b")), "classes").select(F.col("node").alias("vertex"), "label")
    about = vertex.join(degree, "vertex", "left").join(component, "vertex", "left").select("key", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "vertex").alias("label"))
    named = seen.select("uid", "doc_id", "key").join(about, "key", "left").withColumn("label", F.coalesce("label", "uid"))
    ids = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid")).alias("least"))
    return named.join(ids, "label").select("uid", "doc_id", F.col("least.doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), (F.col("uid") == F.col("least.uid")).alias("first"))


def op9_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
shingle AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM words WHERE len(w) > 0)),
sets AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM shingle GROUP BY doc_id),
vertex AS MATERIALIZED (SELECT k, min(doc_id) AS v, any_value(n) AS n, count(*) AS n_copies FROM sets GROUP BY k),
own AS MATERIALIZED (SELECT v, n, g FROM vertex JOIN shingle ON v = doc_id),
link AS MATERIALIZED (SELECT a.v AS a, b.v AS b FROM own a JOIN own b ON a.g = b.g AND a.v <> b.v GROUP BY a.v, b.v, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT v, v FROM vertex UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
class AS (SELECT a AS v, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a AS v, count(*) AS n_links FROM link GROUP BY a)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_copies, 1) AS BIGINT) AS n_copies
FROM words w LEFT JOIN sets s USING (doc_id) LEFT JOIN vertex x USING (k) LEFT JOIN class c ON x.v = c.v LEFT JOIN degree d ON x.v = d.v
"""
