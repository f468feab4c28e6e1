"""Exact top-k search by inner product with a vector-approximation file.

Vectors are whole numbers. Each component is replaced by the number of its cell, cells holding about equally
many components of a sample; the packed cells are the file. A score lies between the sums of the least and
of the greatest product that a query's and a cell's components can have.

1. Equal vectors are one class with the smallest ids that a result can hold (`classes_of`).
2. Queries and cells meet in units, a block of queries with a part of the file; each unit scans its cells
   and keeps for each query what isn't certainly beaten there (`scan`).
3. Over all units the k-th best lower bound of a query leaves few candidates, in the order of their upper bounds.
4. Their exact vectors are read in that order, some at a time, until the k-th best score is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, scratch, ship, struct_of, table

#: Results of a query; a component x counts as floor(SCALE * x), at most LARGEST in size, so that scores fit in 64 bits.
K, SCALE, LARGEST = 20, 64, 1 << 24
#: Bits of a cell's number, and the vectors from which cells are drawn, about.
BITS, SAMPLE, SEED = 7, 4096, 11
#: Distinct queries of a unit, distinct vectors of one at least, and parts of the file at most.
QUERIES, CANDIDATES, PARTS = 4096, 4096, 256
#: Numbers in one matrix of bounds.
MATRIX = 1 << 20
#: Exact vectors read for a query in the first round, and how many times more in each next one.
FIRST, GROWTH = 64, 8
#: Parts into which the query rows of one vector are dealt.
SALTS = 8
#: Where a null vec_id stands in the order of ids.
LAST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and vector (int32, little-endian) of the rows whose components are all there and finite."""
    ship(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            rows = np.flatnonzero(~np.asarray(lists.is_null()))
            lists = lists.take(pa.array(rows))
            offsets = np.asarray(lists.offsets, np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            bad = np.append(0, np.cumsum(~np.isfinite(values)))
            good = bad[offsets[1:]] == bad[offsets[:-1]]
            whole = np.clip(np.floor(scale * np.nan_to_num(values)), -LARGEST, LARGEST).astype("<i4")
            data = [whole[a:b].tobytes() for a, b, g in zip(offsets[:-1].tolist(), offsets[1:].tolist(), good.tolist(), strict=True) if g]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[good])), pa.array(data, pa.binary())], names=["vec_id", "vector"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, vector binary")


def matrix(data: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    if all(len(d) == 4 * width for d in data):
        return np.frombuffer(b"".join(data), "<i4").reshape(len(data), width)
    return np.frombuffer(b"".join(d.ljust(4 * width, b"\0") for d in data), "<i4").reshape(len(data), width)


def classes_of(rows: DataFrame, asked: Column, keep: int) -> DataFrame:
    """Distinct vectors: cid and id (uid and vec_id of the first row), members (the first rows, by vec_id), asked (a row of it is a query)."""
    # Spark drops all but the first rows of each vector before it shuffles them
    by_id = W.partitionBy("vector").orderBy(F.asc_nulls_last("vec_id"), "uid")
    first = rows.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= keep)
    member = F.struct(F.coalesce("vec_id", F.lit(LAST)).alias("id"), "uid", "vec_id")
    grouped = first.groupBy("vector").agg(F.sort_array(F.collect_list(member)).alias("members"))
    queries = rows.filter(asked).select("vector").distinct().withColumn("asked", F.lit(True))
    joined = grouped.join(queries, "vector", "left")
    return joined.select(F.col("members")[0]["uid"].alias("cid"), F.col("members")[0]["id"].alias("id"), "vector", "members", F.coalesce("asked", F.lit(False)).alias("asked"))


class Cells:
    """For each component its cells, ranges of whole numbers [low, high], and how their numbers are packed."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int):
        """sample: some vectors; least, most: the ends of each component over all vectors."""
        self.bits, self.width = bits, len(least)
        points = np.quantile(sample, np.arange(1, 1 << bits) / (1 << bits), axis=0, method="lower").T if len(sample) else np.zeros((self.width, 0))
        self.low = np.repeat(most[:, None], 1 << bits, axis=1)  # a cell that isn't used holds the greatest number alone
        self.high = self.low.copy()
        self.starts: list[np.ndarray] = []
        for d in range(self.width):
            starts = np.unique(points[d]).astype(np.int64)
            starts = starts[(starts > least[d]) & (starts <= most[d])]
            self.starts.append(starts)
            self.low[d, : len(starts) + 1] = np.append(least[d], starts)
            self.high[d, : len(starts) + 1] = np.append(starts - 1, most[d])

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Packed cell numbers, a row of bytes for each vector."""
        cells = np.empty(vectors.shape, np.uint8)
        for d, starts in enumerate(self.starts):
            cells[:, d] = np.searchsorted(starts, vectors[:, d], side="right")
        return np.packbits(np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :].reshape(len(cells), -1), axis=1)

    def ends(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest numbers that the components can be."""
        bits = np.unpackbits(packed, axis=1, count=self.width * self.bits).reshape(len(packed), self.width, self.bits)
        cells = np.packbits(bits, axis=2)[:, :, 0] >> (8 - self.bits)
        of = np.arange(self.width)[None, :]
        return self.low[of, cells], self.high[of, cells]

    def bounds(self, queries: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of all queries with all packed vectors.

        A product lies within |q| times half the cell's width around q times the cell's middle. Sums are of
        floats, and so widened by more than their rounding; scores are whole.
        """
        low, high = self.ends(packed)
        q = queries.astype(np.float64)
        middle, half = q @ ((low + high) / 2).T, np.abs(q) @ ((high - low) / 2).T
        slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(self.low[:, 0]), np.abs(self.high).max(axis=1)).astype(np.float64))[:, None]
        return np.ceil(middle - half - slack), np.floor(middle + half + slack)


def cells_of(classes: DataFrame, n: int, bits: int) -> tuple[Cells, int]:
    """Cells from the ends of all components and from a sample of the classes; the number of components."""
    width = max(1, classes.agg(F.max(F.length("vector"))).first()[0] // 4)

    def ends(batches):
        least, most = np.full(width, LARGEST + 1), np.full(width, -LARGEST - 1)
        for batch in batches:
            step = max(1, MATRIX // max(1, width))
            for lo in range(0, batch.num_rows, step):
                v = matrix(batch.column(0).slice(lo, step).to_pylist(), width)
                least, most = np.minimum(least, v.min(axis=0)), np.maximum(most, v.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(least, pa.int64()), pa.array(most, pa.int64())], names=["d", "least", "most"])

    found = classes.select("vector").mapInArrow(ends, "d int, least long, most long").groupBy("d").agg(F.min("least"), F.max("most")).collect()
    least, most = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for d, a, b in found:
        least[d], most[d] = a, b
    drawn = classes.select("vector").sample(min(1.0, SAMPLE / max(1, n)), SEED).collect()
    return Cells(matrix([bytes(r.vector) for r in drawn], width), least, most, bits), width


class Unit:
    """A block of queries, the best lower bounds that it has met for each, and the candidates that these don't beat."""

    def __init__(self, cids: list[int], queries: np.ndarray, keep: int):
        self.cids, self.queries, self.keep = cids, queries, keep
        self.low = np.full((len(cids), keep), -np.inf)
        self.ids = np.full((len(cids), keep), LAST)
        self.left: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(self, cells: Cells, ids: np.ndarray, cids: np.ndarray, packed: np.ndarray) -> None:
        """Take in candidates, whose ids are no smaller than those before.

        One is beaten if `keep` others have a lower bound over its upper one, or the same and a smaller id.
        """
        step = max(1, MATRIX // len(ids))
        for at in range(0, len(self.cids), step):
            low, high = cells.bounds(self.queries[at : at + step], packed)
            n, m, keep = len(low), len(ids), self.keep
            both = np.concatenate([self.low[at : at + n], low], axis=1)  # in order of ids
            least = np.partition(both, m, axis=1)[:, m]  # the keep-th best
            same = both == least[:, None]
            need = keep - (both > least[:, None]).sum(axis=1)
            last = np.full(n, keep + m - 1)
            for r in np.flatnonzero(same.sum(axis=1) > need).tolist():
                last[r] = np.flatnonzero(same[r])[need[r] - 1]
            best = (both > least[:, None]) | same & (np.arange(keep + m) <= last[:, None])
            self.low[at : at + n] = both[best].reshape(n, keep)
            every = np.concatenate([self.ids[at : at + n], np.broadcast_to(ids, (n, m))], axis=1)
            self.ids[at : at + n] = every[best].reshape(n, keep)
            q, c = np.nonzero((high > least[:, None]) | (high == least[:, None]) & (np.arange(keep, keep + m) <= last[:, None]))
            self.left.append((q + at, cids[c], ids[c], high[q, c]))

    def results(self) -> Iterator[tuple[int, list, list, list, list, list]]:
        """For each query: cid, the best lower bounds and their ids, and cids, ids and upper bounds of what they leave."""
        q, cid, ident, high = (np.concatenate([x[i] for x in self.left]) if self.left else np.zeros(0, np.int64) for i in range(4))
        least = self.low.min(axis=1)
        last = np.where(self.low == least[:, None], self.ids, -LAST).max(axis=1)
        stay = (high > least[q]) | (high == least[q]) & (ident <= last[q])
        q, cid, ident, high = (x[stay] for x in (q, cid, ident, high))
        by = np.argsort(q, kind="stable")
        edge = np.searchsorted(q[by], np.arange(len(self.cids) + 1))
        for k, c in enumerate(self.cids):
            own, there = by[edge[k] : edge[k + 1]], np.isfinite(self.low[k])
            yield c, self.low[k][there], self.ids[k][there], cid[own], ident[own], high[own]


BOUNDS = "q long, lows array<double>, low_ids array<long>, cids array<long>, ids array<long>, highs array<double>"


def scan(classes: DataFrame, cells: Cells, width: int, keep: int, n: int, asked: int, queries: int, candidates: int) -> DataFrame:
    """Bounds of each query with each part of the file."""
    blocks = -(-asked // queries)
    parts = min(PARTS, -(-n // candidates))
    shared = classes.sparkSession.sparkContext.broadcast(cells)  # as many numbers as components times cells

    def pack(batches):
        for batch in batches:
            step = max(1, MATRIX // max(1, width))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                packed = shared.value.encode(matrix(part.column(2).to_pylist(), width))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([p.tobytes() for p in packed], pa.binary())], names=["cid", "id", "data"])

    def run(batches):
        unit, name, kinds = None, None, pa.schema([("q", pa.int64()), ("lows", pa.list_(pa.float64())), ("low_ids", pa.list_(pa.int64())), ("cids", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("highs", pa.list_(pa.float64()))])
        asks: tuple[list[int], list[bytes]] = ([], [])

        def done():
            if unit is not None:
                rows = list(unit.results())
                for lo in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[lo : lo + 256]], f.type) for i, f in enumerate(kinds)], schema=kinds)

        for batch in batches:
            step = max(1, min(candidates, MATRIX // max(1, width)))
            key = np.stack([np.asarray(batch.column(i)) for i in range(3)], axis=1)
            edges = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))), len(key)).tolist()
            for a, b in zip(edges, edges[1:]):  # rows of one unit and one kind
                for lo in range(a, b, step):
                    part = batch.slice(lo, min(step, b - lo))
                    block, piece, kind = key[lo].tolist()
                    if (block, piece) != name:
                        yield from done()
                        unit, name, asks = None, (block, piece), ([], [])
                    data = part.column(5).to_pylist()
                    if kind == 0:
                        asks[0].extend(part.column(4).to_pylist())
                        asks[1].extend(data)
                        continue
                    if unit is None:
                        if not asks[0]:
                            continue
                        unit = Unit(asks[0], matrix(asks[1], width), keep)
                    packed = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
                    unit.meet(shared.value, np.asarray(part.column(3)), np.asarray(part.column(4)), packed)
        yield from done()

    block, piece = F.expr(f"int(pmod(xxhash64(cid), {blocks}))"), F.expr(f"int(pmod(xxhash64(cid, 1), {parts}))")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    file = classes.select("cid", "id", "vector").mapInArrow(pack, "cid long, id long, data binary")
    asks = classes.filter("asked").select(block.alias("block"), every(parts).alias("piece"), F.lit(0).alias("kind"), "id", "cid", F.col("vector").alias("data"))
    met = asks.unionByName(file.select(every(blocks).alias("block"), piece.alias("piece"), F.lit(1).alias("kind"), "id", "cid", "data"))
    return met.repartition("block", "piece").sortWithinPartitions("block", "piece", "kind", "id", "cid").mapInArrow(run, struct_of(BOUNDS))


def candidates_of(bounds: DataFrame, keep: int) -> DataFrame:
    """q, cid, id, high and pos (from 1, in order of upper bounds) of what the lower bounds of all parts leave."""
    order = F.transform(F.arrays_zip("lows", "low_ids"), lambda x: F.struct(x["lows"].alias("low"), (-x["low_ids"]).alias("back")))
    kth = F.get(F.sort_array(F.flatten(F.collect_list(order)), asc=False), F.lit(keep - 1))
    least = bounds.groupBy("q").agg(kth.alias("kth")).select(F.col("q").alias("of"), "kth")
    each = bounds.select("q", F.explode(F.arrays_zip("cids", "ids", "highs")).alias("c")).select("q", F.col("c.cids").alias("cid"), F.col("c.ids").alias("id"), F.col("c.highs").alias("high"))
    left = each.join(least, F.col("q") == F.col("of")).filter(F.expr("kth is null or high > kth.low or high = kth.low and id <= -kth.back"))
    by_bound = W.partitionBy("q").orderBy(F.desc("high"), "id", "cid")
    return left.select("q", "cid", "id", "high", F.row_number().over(by_bound).alias("pos"))


def scored(pairs: DataFrame, classes: DataFrame, keep: int) -> DataFrame:
    """q, score, id, uid and vec_id of the rows of each pair of a query and a class, read from their exact vectors."""

    def run(batches):
        for batch in batches:
            scores = []
            for lo in range(0, batch.num_rows, 1024):
                a, b = (batch.column(i).slice(lo, 1024).to_pylist() for i in (1, 2))
                width = max([0, *(len(x) // 4 for x in a), *(len(x) // 4 for x in b)])
                scores.append(np.einsum("ij,ij->i", matrix(a, width).astype(np.int64), matrix(b, width).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.int64()), batch.column(3)], names=["q", "score", "members"])

    asks = classes.filter("asked").select(F.col("cid").alias("q"), F.col("vector").alias("a"))
    exact = pairs.select("q", "cid").join(asks, "q").join(classes.select("cid", F.col("vector").alias("b"), "members"), "cid").select("q", "a", "b", "members")
    members = classes.schema["members"].dataType.simpleString()
    found = exact.mapInArrow(run, f"q long, score long, members {members}")
    return found.select("q", "score", F.explode("members").alias("m")).select("q", "score", "m.id", "m.uid", "m.vec_id")


def certain(candidates: DataFrame, classes: DataFrame, keep: int, first: int) -> DataFrame:
    """The best `keep` rows of each query, in rounds: the next candidates by upper bound are read until none left can enter."""
    best, old, done, upto = None, [], 0, first
    while True:
        new = scored(candidates.filter((F.col("pos") > done) & (F.col("pos") <= upto)), classes, keep)
        rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id", "uid"))
        best = scratch((new if best is None else best.drop("n").unionByName(new)).withColumn("n", rank).filter(F.col("n") <= keep), "best")
        after = candidates.filter(F.col("pos") == upto + 1).select("q", "high", F.col("id").alias("next"))
        kth = best.filter(F.col("n") == keep).select("q", "score", "id")
        still = after.join(kth, "q", "left").filter("score is null or high > score or high = score and next <= id").select("q")
        still = scratch(still, "open")
        if still.isEmpty():
            break
        old += [best, still]
        candidates = candidates.join(still, "q", "left_semi")
        done, upto = upto, upto * GROWTH
    for x in (*old, still):
        discard(x)
    return best


def search_top_k(vectors: DataFrame, asked: str, k: int = K, scale: int = SCALE, bits: int = BITS, queries: int = QUERIES, candidates: int = CANDIDATES, first: int = FIRST) -> DataFrame:
    """The k highest inner products of each query with all other rows, exact, ties to the smaller vec_id.

    vectors needs vec_id and embedding (an array of numbers), other columns are left out; asked is SQL that says
    by vec_id which rows are queries. Components count as floor(scale * x); beyond 2 ** 24 in size as that. Vectors
    that are null or hold a null or an element that isn't finite take no part. Vectors of different length
    score over the components that both have; an empty one scores 0. A repeated vec_id is another row: each is a query of its own and a candidate for the
    others. A null vec_id is no query, and the last among ties. Fewer rows than k give as many results, one row or
    an empty table none. Returns query_id, rank (from 1), vec_id, score.
    """
    spark, keep = vectors.sparkSession, k + 1  # the query's own row is among the best of its vector
    rows = scratch(whole_vectors(vectors, scale).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    classes = scratch(classes_of(rows, F.expr(asked), keep), "classes")
    n, n_asked = classes.agg(F.count("*"), F.count_if("asked")).first()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells, width = cells_of(classes, n, bits)
    bounds = scratch(scan(classes, cells, width, keep, n, n_asked, queries, candidates), "bounds")
    left = scratch(candidates_of(bounds, keep), "candidates")
    discard(bounds)
    best = certain(left, classes, keep, first)
    # results go back to the query rows by their vector, the rows of one vector in parts
    top = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "uid", "vec_id"))).alias("top"))
    of_vector = top.join(classes.select(F.col("cid").alias("q"), "vector"), "q").select("vector", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asks = rows.filter(asked).select(F.col("vec_id").alias("query_id"), F.col("uid").alias("own"), "vector", F.expr(f"int(pmod(xxhash64(uid), {SALTS}))").alias("salt"))
    others = F.slice(F.filter("top", lambda x: x["uid"] != F.col("own")), 1, k)
    found = asks.join(of_vector, ["vector", "salt"]).select("query_id", F.posexplode(others).alias("pos", "r"))
    out = scratch(found.select("query_id", (F.col("pos") + 1).alias("rank"), "r.vec_id", (-F.col("r.minus")).alias("score")), "top")
    for x in (rows, classes, left, best):
        discard(x)
    return out


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
