"""Repair of conversation structure by cheapest edits, over a suffix-shared automaton of signatures.

A conversation's signature has a letter for each row: what its role begins with (s, u, a or x for others),
in upper case if the text is truncated, or d if the row must go. What the rest of a conversation costs depends
on the rest of its signature and on a grammar state alone. Signatures are therefore read from the end: equal
rests are one node of a directed acyclic word graph, on which the cost-to-go and the first edit of the best
audit suffix are worked out once for each grammar state, for all conversations together.

Distinct signatures are sorted by their reverse, over all tasks. Those that share a rest then come one
after the other, and a task holds only the nodes of the signature at hand.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, halves, scratch, ship, table

#: Grammar states of `(s?(ua)+)?`: nothing yet, after s, after u, after a. The first and the last may be the end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ACCEPTS = (START, AFTER_A)
#: Where a kept row leads by what its role begins with, and where a user or assistant that is set or inserted leads.
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
SET = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
SET_ROLE = {AFTER_U: b"user", AFTER_A: b"assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 60
#: Parts into which the conversations of one signature are dealt.
SALTS = 16

SPACES = " \t\n\x0b\f\r"

Node = tuple[tuple[int, ...], str]


def with_insertions(costs: list[int], edits: list[str]) -> Node:
    """The node's costs and first edits by state, given those without an insertion first. Of equal costs the smaller letter counts."""
    bare, first = list(costs), list(edits)
    for state in (AFTER_U, AFTER_A, START, AFTER_S):
        after = bare[SET[state]] if state in (AFTER_U, AFTER_A) else costs[SET[state]]
        if (INSERT + after, "I") < (costs[state], first[state]):
            costs[state], first[state] = INSERT + after, "I"
    return tuple(costs), "".join(first)


#: The node of the empty rest; a point says that no edit is left.
END = with_insertions([0 if s in ACCEPTS else NEVER for s in range(4)], list("...."))


def node_before(letter: str, rest: Node) -> Node:
    """The node of a rest with one more letter in front."""
    costs, edits = [], []
    role, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
    for state in range(4):
        best = (DELETE + rest[0][state], "D")
        if letter != "d":
            if (to := KEPT.get((state, role))) is not None:
                best = min(best, (KEEP + extra + rest[0][to], "K"))
            best = min(best, (REROLE + extra + rest[0][SET[state]], "R"))
        costs.append(best[0])
        edits.append(best[1])
    return with_insertions(costs, edits)


def audits(reversed_signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """Signature, cost and audit of each reversed signature. Of those that follow each other, nodes of a shared rest are kept."""
    nodes, last = [END], ""
    for back in reversed_signatures:
        shared = len(os.path.commonprefix((back, last)))
        del nodes[shared + 1 :]
        for letter in back[shared:]:
            nodes.append(node_before(letter, nodes[-1]))
        last, state, audit, k = back, START, [], len(back)
        while (edit := nodes[k][1][state]) != ".":
            audit.append(edit)
            if edit != "D":
                state = KEPT[state, back[k - 1].lower()] if edit == "K" else SET[state]
            k -= edit != "I"
        yield back[::-1], nodes[-1][0][START], "".join(audit)


def marked(turns: DataFrame) -> DataFrame:
    """Turns with c1, c2 (128 bits of role and text), kind (what the role begins with), fault (blank, duplicate, truncated or none) and without text."""
    bare = F.rtrim("text", F.lit(SPACES))
    kind = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    out = turns.select("conv_id", "turn", "role", "c1", "c2", kind.alias("kind"), (bare == "").alias("is_blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("is_cut"))
    again = F.expr("row_number() over (partition by conv_id, c1, c2 order by turn nulls first) > 1")
    fault = F.when(F.col("is_blank"), "blank").when(again, "duplicate").when(F.col("is_cut"), "truncated").otherwise("none")
    return out.select("conv_id", "turn", "role", "c1", "c2", "kind", fault.alias("fault"))


FACTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


def facts_of(turns: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, counts of faults and of illegal pairs, and its signature. A conversation's turns run through a task in order."""
    ship(turns.sparkSession)
    types = (pa.int64(),) * 6 + (pa.string(),)

    def run(batches):
        name, begun = None, False
        counts = {"blank": 0, "duplicate": 0, "truncated": 0, "none": 0}
        letters: list[str] = []
        illegal = distinct = 0
        least = most = before = None

        def row():
            return (name, most - least + 1 - distinct if distinct else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, "".join(letters))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"])

        for batch in batches:
            rows = []
            for conv, turn, kind, fault in zip(*(batch.column(i).to_pylist() for i in (0, 1, 5, 6)), strict=True):
                if conv != name or not begun:
                    if begun:
                        rows.append(row())
                    name, begun, letters, illegal, distinct, least, most, before = conv, True, [], 0, 0, None, None, None
                    counts = dict.fromkeys(counts, 0)
                if turn is not None and turn != most:
                    least, most, distinct = turn if least is None else least, turn, distinct + 1
                counts[fault] += 1
                illegal += before is not None and before + kind not in ("su", "ua", "au")
                before = kind
                letters.append("d" if fault in ("blank", "duplicate") else kind.upper() if fault == "truncated" else kind)
            yield batch_of(rows)
        if begun:
            yield batch_of([row()])

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "c1", "c2"]
    return marked(turns).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, FACTS)


def audits_of(signatures: DataFrame) -> DataFrame:
    """signature, cost and audit of distinct signatures."""

    def run(batches):
        found = audits(s for b in batches for s in b.column(0).to_pylist())
        rows = []
        for r in found:
            rows.append(r)
            if len(rows) == 1024:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["signature", "cost", "audit"])

    back = signatures.select(F.reverse("signature").alias("back")).distinct()
    return back.repartitionByRange("back").sortWithinPartitions("back").mapInArrow(run, "signature string, cost long, audit string")


def plain_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, c1, c2; null role or text is one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    c1, c2 = halves(digest)
    return turns.withColumns({"c1": c1, "c2": c2})


def audited(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Facts, cost and audit of every conv_id of ids (distinct); turns: see plain_turns."""
    facts = scratch(facts_of(turns).withColumn("salt", F.expr(f"int(pmod(xxhash64(conv_id), {SALTS}))")), "facts")
    found = audits_of(facts.select("signature")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = facts.join(found, ["signature", "salt"]).drop("signature", "salt")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    out = ids.select(F.col("conv_id").alias("_id")).join(each, F.col("_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("_id", "conv_id")
    out = scratch(out.withColumns(zero | {"audit": F.coalesce("audit", F.lit(""))}), "audits")
    discard(facts)
    return out


class Edits:
    """The audit of one conversation, followed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, bytes, bytes]]:
        while self.audit.startswith("I", self.at):
            self.at += 1
            self.state = SET[self.state]
            yield "I", SET_ROLE[self.state], b""

    def row(self, role: bytes, text: bytes) -> Iterator[tuple[str, bytes, bytes]]:
        """(edit, role, text) of what the next row becomes, insertions before it first."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = SET[self.state]
            yield edit, SET_ROLE[self.state], text
        elif edit == "K":
            self.state = KEPT[self.state, role[:1].decode()]
            yield edit, role, text


def in_order(turns: DataFrame, audit: DataFrame) -> DataFrame:
    """Each conversation's row of audit, then its turns in order, in one task; texts as bytes."""
    facts = [c for c in audit.columns if c != "conv_id"]
    none = [F.lit(None).cast(audit.schema[c].dataType).alias(c) for c in facts]
    binary = lambda c: F.col(c).cast("binary").alias(c)
    rows = turns.select("conv_id", F.lit(1).alias("part"), "turn", "c1", "c2", binary("role"), binary("text"), *none)
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("c1", "long"), ("c2", "long"), ("role", "binary"), ("text", "binary"))]
    both = audit.select("conv_id", F.lit(0).alias("part"), *nothing, *facts).unionByName(rows)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "role", "c1", "c2")


ROWS_AT_ONCE = 512


def repaired_digests(turns: DataFrame, audit: DataFrame) -> DataFrame:
    """The rows of audit with repaired_sha256, of `role:text` of the repaired rows, joined by newlines."""
    facts = [f for f in audit.schema.fields if f.name != "conv_id"]
    names = ["conv_id", *(f.name for f in facts), "repaired_sha256"]

    def run(batches):
        current, edits, state, any_row = None, None, None, False

        def feed(rows):
            nonlocal any_row
            for _, role, text in rows:
                state.update(b"\n" * any_row + role + b":")
                state.update(text)
                any_row = True

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                done = []
                for conv, kind, _, _, _, role, text, *own in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if kind == 0:
                        if current:
                            feed(edits.inserted())
                            done.append((*current, state.hexdigest()))
                        current, edits, state, any_row = (conv, *own), Edits(own[-1]), hashlib.sha256(), False
                    else:
                        feed(edits.row(role, text))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)
        if current:
            feed(edits.inserted())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*current, state.hexdigest()), types, strict=True)], names=names)

    types = [pa.int64(), *(pa.string() if f.dataType.simpleString() == "string" else pa.int64() for f in facts), pa.string()]
    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, types, strict=True))
    return in_order(turns, audit).mapInArrow(run, schema)


def repaired_rows(turns: DataFrame, audit: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I), role, text."""
    types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())

    def run(batches):
        conv, edits, n = None, None, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                done = []
                for to, kind, _, _, _, role, text, *own in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    new = edits.row(role, text) if kind else edits.inserted() if edits else ()
                    for x in new:
                        done.append((conv, n, *x))
                        n += 1
                    if not kind:
                        conv, edits, n = to, Edits(own[-1]), 0
                yield rows(done)
        if edits:
            yield rows([(conv, n + i, *x) for i, x in enumerate(edits.inserted())])

    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=["conv_id", "position", "edit", "role", "text"])

    out = in_order(turns, audit).mapInArrow(run, "conv_id long, position long, edit string, role binary, text binary")
    return out.withColumns({c: F.col(c).cast("string") for c in ("role", "text")})


def repair_conversations(conversations: DataFrame, ids: DataFrame | None = None, with_rows: bool = False) -> DataFrame:
    """What is wrong with each conversation, and the cheapest edits after which its roles go `(s?(ua)+)?`.

    conversations needs conv_id, turn, role, text; other columns are left out. Rows go by turn (null first), equal ones by
    role, then by the MD5 of role and text; repeated rows are rows, all but the first duplicates. Null role or text is one space. Rows
    with null conv_id are one conversation. ids: the conversations to report (their conv_id), by default those that have rows; one
    without rows has zeros, an empty audit and the empty text's hash. An empty table gives no row. Returns conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256; with_rows instead the repaired rows (see repaired_rows).
    """
    turns = plain_turns(conversations)
    every = (turns if ids is None else ids.select(F.col("conv_id").cast("long").alias("conv_id"))).select("conv_id").distinct()
    found = audited(turns, every)
    found = found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return repaired_rows(turns, found) if with_rows else repaired_digests(turns, found)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after a fifth to a quarter of them got a fault, by the CRC-32 of conv_id and turn."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), what.alias("what")).filter("what <> 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(conversations), conversations)


def _options(state: int, kept: str, to: int, role: str) -> str:
    """SQL of the best of deleting, keeping and setting the row r in a grammar state, from f, the results after the row by state (from 1)."""
    return f"""list_sort(list_filter([{{'c': f[{state}].c + 4, 'a': 'D' || f[{state}].a, 'o': f[{state}].o}},
      CASE WHEN NOT gone AND {kept} IS NOT NULL THEN {{'c': f[{kept}].c + extra, 'a': 'K' || f[{kept}].a, 'o': list_prepend(role || ':' || text, f[{kept}].o)}} END,
      CASE WHEN NOT gone THEN {{'c': f[{to}].c + extra + 3, 'a': 'R' || f[{to}].a, 'o': list_prepend('{role}:' || text, f[{to}].o)}} END], lambda x: x IS NOT NULL))[1]"""


def _inserted(rest: str, role: str) -> str:
    return f"{{'c': {rest}.c + 3, 'a': 'I' || {rest}.a, 'o': list_prepend('{role}:', {rest}.o)}}"


def _least(*results: str) -> str:
    return f"list_sort([{', '.join(results)}])[1]"


_U = "CASE WHEN kind = 'u' THEN 3 END"
ORACLE = rf"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
struck AS (SELECT *, CAST(xor(list_reduce(list_transform(string_split(name, ''), lambda s: CAST(ascii(s) AS BIGINT)),
  lambda crc, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), 4294967295), 4294967295) % 20 AS INTEGER) AS what FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS copy FROM struck WHERE what <> 0),
placed AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS kind,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
faults AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
  lag(kind) OVER (PARTITION BY conv_id ORDER BY i) || kind AS pair FROM placed),
marked AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM faults),
facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
steps AS (
  SELECT conv_id, n AS i, [{{'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])}}, {{'c': 6, 'a': 'II', 'o': ['user:', 'assistant:']}}, {{'c': 3, 'a': 'I', 'o': ['assistant:']}}, {{'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])}}] AS f FROM facts
  UNION ALL
  SELECT conv_id, i, [{_least("g[1]", _inserted("h", "user"))}, {_least("g[2]", _inserted("h", "user"))}, h, {_least("g[4]", _inserted("g[3]", "user"))}]
  FROM (SELECT conv_id, i, g, {_least("g[3]", _inserted("g[4]", "assistant"))} AS h FROM (SELECT s.conv_id, s.i - 1 AS i, [{_options(1, "CASE kind WHEN 's' THEN 2 WHEN 'u' THEN 3 END", 3, "user")},
    {_options(2, _U, 3, "user")}, {_options(3, "CASE WHEN kind = 'a' THEN 4 END", 4, "assistant")}, {_options(4, _U, 3, "user")}] AS g
    FROM steps s JOIN marked r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i))),
repaired AS (SELECT conv_id, f[1].c AS cost, f[1].a AS audit, f[1].o AS o FROM steps WHERE i = 0)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN facts a ON a.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""
