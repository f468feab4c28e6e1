"""Conversation prefix trie, its subtrees summed along an Euler tour.

Every distinct sequence of first turns is a node. A node's smallest member names it, and the nodes that
one conversation names are a path downwards: from the first depth at which no smaller conversation goes
along, to its end. The tour enters a node, visits its children and exits it; a path's nodes are entered
one right after the other, its own child first, so that the tour's arcs fall into two pieces a path:

- down: the enter arcs of the path, and the exit arcs of its nodes below the first branch;
- up: the exit arcs of the parent path after this path's subtree, up to the next branch.

These pieces are a list as long as twice the paths. It is ranked by the usual scheme: some elements are
drawn as stops, the others jump along the list, each jump twice as far, until they stand at a stop, and
the list of stops is ranked the same way, until it is small. Subtree sums are differences of the sums at
a node's enter and exit arcs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, halves, scratch, ship, table

#: A conversation takes over the first turns, fewer than HEADS, of the first of its FAMILY.
FAMILY, HEADS = 20, 4
#: Consecutive turns of one conversation that are summed together; longer ones are summed by blocks first.
BLOCK = 4096
#: Parts into which the branches of one node are dealt.
SALTS = 16
#: A list of so many elements is ranked at once; of a longer one, one element in so many is a stop.
SHORT, SPACING = 4096, 16
#: Ids that are joined to one text before they are hashed.
IDS = 4096

PLAIN_WORD = r"[^\x20\x09-\x0D]+"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, p (from 1), c1, c2 (128 bits of role and text) and words of each turn.

    Turns are sorted over all tasks, numbered within each and then by what the tasks before have of the conversation.
    """
    ship(conversations.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter("conv_id is not null")
    turns = turns.select("conv_id", "turn", "role", digest.alias("h"), F.regexp_count("text", F.lit(PLAIN_WORD)).alias("words"))
    c1, c2 = halves(F.col("h"))
    turns = turns.select("conv_id", "turn", "role", c1.alias("c1"), c2.alias("c2"), "words")
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "c1", "c2"]

    def number(batches):
        last, known = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.asarray(batch.column(0))
            begins = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            k = np.arange(len(c)) - np.repeat(begins, np.diff(np.append(begins, len(c))))
            if c[0] == last:
                k[: begins[1] if len(begins) > 1 else len(c)] += known
            last, known = c[-1], k[-1] + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k + 1), *batch.columns[3:]], names=["conv_id", "k", "c1", "c2", "words"])

    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, "conv_id long, k long, c1 long, c2 long, words int")
    placed = scratch(placed.withColumn("task", F.spark_partition_id()), "turns")
    before = W.partitionBy("conv_id").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    tasks = placed.groupBy("conv_id", "task").count().select("conv_id", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    out = scratch(placed.join(tasks, ["conv_id", "task"]).select("conv_id", (F.col("k") + F.col("before")).alias("p"), "c1", "c2", "words"), "numbered")
    discard(placed)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, size), and their turns (conv_id, d from 1, x1, x2, words, size) after the heads are taken over; x1, x2: hashes of a turn at its place."""
    own_head = F.expr(f"crc32(string(conv_id)) % {HEADS}")
    sizes = turns.groupBy("conv_id").agg(F.max("p").alias("n"))
    heads = turns.filter(F.col("p") < HEADS).groupBy(F.col("conv_id").alias("first")).agg(F.sort_array(F.collect_list(F.struct("p", "c1", "c2", "words"))).alias("head"))
    convs = sizes.withColumns({"h": own_head, "of": F.col("conv_id") - F.col("conv_id") % FAMILY}).join(heads, F.col("of") == F.col("first"), "left")
    convs = convs.withColumn("head", F.expr("slice(coalesce(head, array()), 1, int(h))")).withColumn("m", F.size("head"))
    convs = scratch(convs.select("conv_id", "n", "h", "m", "head", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    # a long conversation's turns meet its row in blocks
    each = convs.select("conv_id", "h", "m", "size", F.explode(F.expr(f"sequence(0, n div {BLOCK})")).alias("block"))
    own = turns.filter(F.col("p") > own_head).withColumn("block", F.expr(f"p div {BLOCK}")).join(each, ["conv_id", "block"])
    own = own.select("conv_id", (F.col("m") + F.col("p") - F.col("h")).alias("d"), "c1", "c2", "words", "size")
    taken = convs.select("conv_id", "size", F.posexplode("head").alias("i", "t")).select("conv_id", (F.col("i") + 1).cast("long").alias("d"), "t.c1", "t.c2", "t.words", "size")
    hashed = own.unionByName(taken).select("conv_id", "d", F.xxhash64("c1", "c2", "d").alias("x1"), F.xxhash64("d", "c2", "c1").alias("x2"), "words", "size")
    return convs, hashed


def blockwise(df: DataFrame, key: str, depth: str, size: str, deeper: bool, values: dict[str, Column], how, join) -> DataFrame:
    """For each row the aggregate `how` of values over the rows of its key up to it (or from it on, if deeper), in blocks of consecutive depths.

    join puts together what a block has and what the blocks before have, which is null for the first. size: the key's greatest depth.
    """
    df = df.withColumn("block", F.expr(f"{depth} div {BLOCK}"))
    toward = F.desc if deeper else F.asc
    inner = W.partitionBy(key, "block").orderBy(toward(depth)).rowsBetween(W.unboundedPreceding, W.currentRow)
    outer = W.partitionBy("_key").orderBy(toward("_block")).rowsBetween(W.unboundedPreceding, -1)
    long = df.filter(F.col(size) >= BLOCK).groupBy(F.col(key).alias("_key"), F.col("block").alias("_block")).agg(*(how(c).alias(f"_{n}") for n, c in values.items()))
    before = long.select("_key", "_block", *(how(f"_{n}").over(outer).alias(f"_{n}") for n in values))
    here = df.withColumns({n: how(c).over(inner) for n, c in values.items()})
    met = here.join(before, (F.col(key) == F.col("_key")) & (F.col("block") == F.col("_block")), "left")
    return met.withColumns({n: F.when(F.col(f"_{n}").isNull(), F.col(n)).when(F.col(n).isNull(), F.col(f"_{n}")).otherwise(join(F.col(n), F.col(f"_{n}"))) for n in values}).drop("_key", "_block", "block", *(f"_{n}" for n in values))


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, d (from 0), k1, k2 (128 bits of the first d turns), x1, x2 and words of the last of them, size."""
    xor = lambda c: F.bit_xor(c)
    summed = blockwise(turns, "conv_id", "d", "size", False, {"k1": F.col("x1"), "k2": F.col("x2")}, xor, lambda a, b: a.bitwiseXOR(b))
    none = F.lit(0).cast("long")
    roots = convs.select("conv_id", none.alias("d"), none.alias("k1"), none.alias("k2"), none.alias("x1"), none.alias("x2"), F.lit(0).alias("words"), "size")
    return summed.select("conv_id", "d", "k1", "k2", "x1", "x2", "words", "size").unionByName(roots)


def end_digests(members: DataFrame) -> DataFrame:
    """For each node (d, k1, k2) the SHA-256 of the conv_ids that end there, ascending.

    Ids are sorted over all tasks and joined to texts of bounded size; only these meet by node, and run through the hash.
    """

    def pieces(batches):
        node, ids = None, []

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((*[pa.int64()] * 4, pa.string()))], names=["d", "k1", "k2", "least", "ids"])

        for batch in batches:
            done = []
            for *key, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if key != node or len(ids) == IDS:
                    if ids:
                        done.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = key, []
                ids.append(c)
            yield rows(done)
        if ids:
            yield rows([(*node, ids[0], ",".join(map(str, ids)))])

    def digests(batches):
        node, state = None, None

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((*[pa.int64()] * 3, pa.string()))], names=["d", "k1", "k2", "ends_sha256"])

        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if key == node:
                    state.update(b"," + ids.encode())
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
            yield rows(done)
        if node:
            yield rows([(*node, state.hexdigest())])

    by = ["d", "k1", "k2"]
    joined = members.select(*by, "conv_id").repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id").mapInArrow(pieces, "d long, k1 long, k2 long, least long, ids string")
    return joined.repartition(*by).sortWithinPartitions(*by, "least").mapInArrow(digests, "d long, k1 long, k2 long, ends_sha256 string")


def paths_of(nodes: DataFrame) -> DataFrame:
    """One row for each conversation that names nodes: c, top and low (depths of its first and last node), saved (sum over them), p (the path that the first one's parent is in) and pd (that parent's depth), null for the path of the root."""
    top = F.min_by(F.struct("k1", "k2", "x1", "x2"), "d")
    own = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.min("d").alias("top"), F.max("d").alias("low"), F.sum("saved").alias("saved"), top.alias("t"))
    own = own.select("c", "top", "low", "saved", (F.col("top") - 1).alias("pd"), F.col("t.k1").bitwiseXOR(F.col("t.x1")).alias("p1"), F.col("t.k2").bitwiseXOR(F.col("t.x2")).alias("p2"), F.expr(f"int(pmod(xxhash64(c), {SALTS}))").alias("salt"))
    own = scratch(own, "paths")
    keys = own.filter("pd >= 0").select("pd", "p1", "p2").distinct()
    parents = keys.join(nodes.select(F.col("d").alias("pd"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("p")), ["pd", "p1", "p2"])
    parents = parents.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = scratch(own.join(parents, ["pd", "p1", "p2", "salt"], "left").select("c", "top", "low", "saved", "p", F.when(F.col("pd") >= 0, F.col("pd")).alias("pd"), "salt"), "paths")
    discard(own)
    return out


def tour(paths: DataFrame) -> DataFrame:
    """The tour's pieces as a list: (c, up), the next piece (nc, nup), and what arcs the piece has, leaves among the nodes that it enters, and saved tokens of these.

    The branches of a path go by depth, lowest first, then in parts by a hash, then by id.
    """
    branches = paths.filter("p is not null").select("c", "p", "pd", "salt")
    part = branches.withColumn("nc", F.lead("c").over(W.partitionBy("p", "pd", "salt").orderBy("c")))
    parts = branches.groupBy("p", "pd", "salt").agg(F.min("c").alias("first"), F.max("c").alias("last"))
    along = W.partitionBy("p").orderBy(F.desc("pd"), "salt")
    parts = scratch(parts.withColumns({"after": F.lead("first").over(along), "after_pd": F.lead("pd").over(along), "i": F.row_number().over(along)}), "branches")
    zero, one = F.lit(0).cast("long"), F.lit(1)
    columns = lambda c, up, nc, nup, arcs, leaves, saved: [x.alias(n) for x, n in zip((c, up, nc, nup, arcs, leaves, saved), ("c", "up", "nc", "nup", "arcs", "leaves", "saved"), strict=True)]
    col = F.col
    within = part.filter("nc is not null").select(*columns(col("c"), one, col("nc"), F.lit(0), zero, zero, zero))
    between = parts.filter("after is not null").select(*columns(col("last"), one, col("after"), F.lit(0), col("pd") - col("after_pd"), zero, zero))
    ends = parts.filter("after is null").join(paths.select(col("c").alias("p"), "top"), "p")
    rooted = col("top") == 0
    last = ends.select(*columns(col("last"), one, F.when(~rooted, col("p")), F.when(~rooted, one), col("pd") - col("top") + 1, zero, zero))
    firsts = parts.filter("i = 1").select(col("p").alias("c"), "first", col("pd").alias("first_pd"))
    down, n = paths.join(firsts, "c", "left"), col("low") - col("top") + 1
    leaf = F.coalesce(col("first_pd") < col("low"), F.lit(True)).cast("long")
    bare = col("first").isNull()
    down = down.select(*columns(col("c"), F.lit(0), F.when(bare & (col("top") > 0), col("c")).otherwise(col("first")), F.when(~bare, F.lit(0)).when(col("top") > 0, one), n + F.when(bare, n).otherwise(col("low") - col("first_pd")), leaf, col("saved")))
    out = scratch(within.unionByName(between).unionByName(last).unionByName(down), "tour")
    discard(parts)
    return out


SUMS = ["arcs", "leaves", "saved"]


def rank_short(pieces: DataFrame) -> DataFrame:
    """Rank a list of bounded length in one task."""

    def run(batches):
        rows = [b.to_pydict() for b in batches]
        if not rows:
            return
        c, up, nc, nup, *sums = ([x for r in rows for x in r[n]] for n in ("c", "up", "nc", "nup", *SUMS))
        place = {k: i for i, k in enumerate(zip(c, up, strict=True))}
        before = {place[k]: i for i, k in enumerate(zip(nc, nup, strict=True)) if k[0] is not None}
        order, at = [], next((i for i, x in enumerate(nc) if x is None), None)
        while at is not None:
            order.append(at)
            at = before.get(at)
        totals = [np.cumsum(np.array(s, np.int64)[order]) for s in sums]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)[order]), pa.array(np.array(up, np.int32)[order]), *map(pa.array, totals)], names=["c", "up", *SUMS])

    return pieces.repartition(1).mapInArrow(run, "c long, up int, arcs long, leaves long, saved long")


def rank_list(pieces: DataFrame, short: int = SHORT, spacing: int = SPACING, level: int = 0) -> DataFrame:
    """Sums from each piece of the list (see `tour`) to its end, itself included. pieces: a scratch table."""
    if pieces.count() <= short:
        return scratch(rank_short(pieces), "ranks")
    stop = lambda c, up: F.pmod(F.xxhash64(c, up, F.lit(level)), F.lit(spacing)) == 0
    start = pieces.withColumn("there", F.col("nc").isNull() | stop("nc", "nup"))
    tables, done, moving = [], start.filter("there"), start.filter("not there")
    while True:
        ahead = done.unionByName(moving).select(*(F.col(x).alias(f"_{x}") for x in ("c", "up", "nc", "nup", *SUMS, "there")))
        jump = moving.join(ahead, (F.col("nc") == F.col("_c")) & (F.col("nup") == F.col("_up")))
        moved = scratch(jump.select("c", "up", F.col("_nc").alias("nc"), F.col("_nup").alias("nup"), *((F.col(s) + F.col(f"_{s}")).alias(s) for s in SUMS), F.col("_there").alias("there")), "jumps")
        tables.append(moved)
        done, moving = done.unionByName(moved.filter("there")), moved.filter("not there")
        if moving.isEmpty():
            break
    stops = scratch(done.filter(stop("c", "up")).drop("there"), "stops")
    ranks = rank_list(stops, short, spacing, level + 1)
    ahead = ranks.select(F.col("c").alias("nc"), F.col("up").alias("nup"), *(F.col(s).alias(f"_{s}") for s in SUMS))
    out = done.join(ahead, ["nc", "nup"], "left").select("c", "up", *((F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in SUMS))
    out = scratch(out, "ranks")
    for x in (*tables, stops, ranks):
        discard(x)
    return out


def summed_nodes(nodes: DataFrame, paths: DataFrame, ranks: DataFrame) -> DataFrame:
    """Nodes with their parent's name, children, places of their enter and exit arcs (from 0), leaves and saved tokens of their subtrees."""
    up = paths.filter("p is not null").select("c", "p", "pd").join(ranks.filter("up = 1").drop("up"), "c")
    # what comes later in the tour has less left of it
    branches = up.groupBy(F.col("p").alias("conv_id"), F.col("pd").alias("d")).agg(F.min(F.struct(*SUMS, "pd")).alias("branch"), F.count("*").alias("n_branches"))
    lowest = branches.groupBy(F.col("conv_id").alias("c")).agg(F.max("d").alias("lowest"))
    own = paths.join(lowest, "c", "left").withColumn("leaf", F.coalesce(F.col("lowest") < F.col("low"), F.lit(True)).cast("long"))
    own = own.join(ranks.filter("up = 0").select("c", F.struct(*SUMS).alias("down")), "c")
    own = own.select(F.col("c").alias("conv_id"), "top", "low", "p", "leaf", F.col("saved").alias("all_saved"), "down", F.explode(F.expr(f"sequence(top div {BLOCK}, low div {BLOCK})")).alias("block"))
    met = nodes.withColumn("block", F.expr(f"d div {BLOCK}")).join(own, ["conv_id", "block"]).drop("block").join(branches, ["conv_id", "d"], "left")
    met = blockwise(met, "conv_id", "d", "low", False, {"above": F.col("saved")}, lambda c: F.sum(c), lambda a, b: a + b)
    met = blockwise(met, "conv_id", "d", "low", True, {"out": F.col("branch")}, lambda c: F.min(c), lambda a, b: F.least(a, b))
    inside = F.col("out").isNull()
    left = {
        "enter_left": F.col("down.arcs") - (F.col("d") - F.col("top")),
        "exit_left": F.when(inside, F.col("down.arcs") - (F.col("low") - F.col("top") + 1) - (F.col("low") - F.col("d"))).otherwise(F.col("out.arcs") - (F.col("out.pd") - F.col("d"))),
        "leaves_after": F.when(inside, F.col("down.leaves") - F.col("leaf")).otherwise(F.col("out.leaves")),
        "saved_after": F.when(inside, F.col("down.saved") - F.col("all_saved")).otherwise(F.col("out.saved")),
    }
    return met.withColumns(left).select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") > F.col("top"), F.col("conv_id")).otherwise(F.col("p")).alias("parent_conv_id"), "n_convs",
        ((F.col("d") < F.col("low")).cast("long") + F.coalesce("n_branches", F.lit(0))).alias("n_children"),
        (F.col("down.leaves") - F.col("leaves_after")).alias("n_leaves"),
        (F.col("down.saved") - (F.col("above") - F.col("saved")) - F.col("saved_after")).alias("saved_tokens"),
        "enter_left", "exit_left", "k1", "k2",
    )


def prefix_trie(conversations: DataFrame, short: int = SHORT, spacing: int = SPACING) -> DataFrame:
    """The trie of all conversations, after each has taken over the head of the first of its family.

    conversations needs conv_id, turn, role, text; other columns are left out. Rows without conv_id belong to
    none. Null role or text is empty. Turns go by turn (null first), equal ones by role, then by the MD5 of role and text;
    repeated rows are turns of their own. Sequences are told apart by 128 bits of hashes. An empty table has no
    node. Negative conv_ids: the remainders by which heads are found have their sign, as in SQL. Returns conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter_at and exit_at (places of the node's arcs in the tour, from 0).
    """
    turns = numbered_turns(conversations)
    convs, own = rebuilt(turns)
    every = scratch(prefixes(convs, own), "prefixes")
    nodes = every.groupBy("d", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("x1", "x2", "words")))
    nodes = scratch(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    paths = paths_of(nodes)
    pieces = tour(paths)
    ranks = rank_list(pieces, short, spacing)
    found = summed_nodes(nodes, paths, ranks)
    ends = end_digests(every.filter(F.col("d") == F.col("size"))).withColumnRenamed("d", "depth")
    arcs = 2 * nodes.count()
    out = found.join(ends, ["depth", "k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), (arcs - F.col("enter_left")).alias("enter_at"), (arcs - F.col("exit_left")).alias("exit_at"),
    )
    out = scratch(out, "trie")
    for x in (turns, convs, every, nodes, paths, pieces, ranks):
        discard(x)
    return out


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("enter_at", "exit_at")


ORACLE = r"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY p) AS t FROM turns GROUP BY conv_id),
sums AS (SELECT conv_id, t, CAST(xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
  lambda crc, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), 4294967295), 4294967295) % 4 AS BIGINT) AS h FROM own),
heads AS (SELECT s.conv_id, list_concat(coalesce(f.t, [])[1:s.h], s.t[s.h + 1:]) AS t FROM sums s LEFT JOIN own f ON f.conv_id = s.conv_id - s.conv_id % 20),
members AS (SELECT conv_id, t, unnest(range(len(t) + 1)) AS depth FROM heads),
nodes AS (SELECT t[1:depth] AS seq, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(t) = depth), '') AS ends
  FROM members GROUP BY seq, depth),
weighed AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(seq[depth].text, '[^\x20\x09-\x0D]+')) END AS saved FROM nodes),
parents AS (SELECT c.seq, p.conv_id AS parent_conv_id FROM nodes c JOIN nodes p ON p.depth = c.depth - 1 AND p.seq = c.seq[1:c.depth - 1]),
children AS (SELECT seq[1:depth - 1] AS seq, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT w.*, coalesce(n, 0) AS n_children FROM weighed w LEFT JOIN children c ON c.seq = w.seq),
above AS (SELECT seq[1:d] AS seq, n_children, saved FROM (SELECT seq, n_children, saved, unnest(range(depth + 1)) AS d FROM below)),
subtrees AS (SELECT seq, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY seq)
SELECT b.conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM below b JOIN subtrees s ON s.seq = b.seq LEFT JOIN parents p ON p.seq = b.seq
"""
