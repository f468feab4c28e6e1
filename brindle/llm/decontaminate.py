"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the words of all items (each item added from the root). Training text is
streamed through it word by word; the state and the length of the longest match that ends there give
every window of an item that occurs. Items are taken in blocks of bounded size, one automaton a block.

A benchmark of few blocks, whose size is checked first, is sent to all workers, and documents go through its
automata in one pass (`near`). With more blocks a document meets only those of which it may hold a window
(`routed`): a bit field of bounded size, then a join by window hashes, tell which; the document and the
block's items are shuffled to one place, where the block's automaton is built once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Units
from .common import CARRIED, carrying, discard, folded_words, identified, map_rows, scratch, struct_of, table

#: Consecutive item words that count; an item of fewer words is one window.
WINDOW = 13
#: Bytes of item text in one automaton.
BLOCK_BYTES = 1 << 20

Span = tuple[int, int]


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the items that each window belongs to."""

    def __init__(self, items: Sequence[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {w: i for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.ids[w] for w in words]) for item, words in items if words]
        for _, words in coded:
            last = 0
            for c in words:
                last = self._extend(last, c)
        self.whole: dict[int, list[tuple[int, str]]] = {}
        self.windows: dict[int, set[str]] = {}
        self.shortest = min([window, *(len(w) for _, w in coded)])
        for item, words in coded:
            self._note(item, words)
        self.at_window = [self._above(s, window) for s in range(len(self.step))]
        self.nearest = [-1] * len(self.step)
        for s in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            self.nearest[s] = s if s in self.whole else self.nearest[self.link[s]]

    def _copy(self, p: int, q: int, c: int) -> int:
        clone = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.step[last].get(c)) is not None:  # another item has this sequence
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, q, c)
        new, p = len(self.step), last
        self.step.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, c)
        return new

    def _above(self, state: int, length: int) -> int:
        """The state of the suffix of the given length, or -1 where the state's sequences are shorter."""
        if self.length[state] < length:
            return -1
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _note(self, item: str, words: list[int]) -> None:
        state = 0
        for i, c in enumerate(words):
            state = self.step[state][c]
            if i + 1 >= self.window:
                self.windows.setdefault(self._above(state, self.window), set()).add(item)
        if len(words) < self.window:
            self.whole.setdefault(self._above(state, len(words)), []).append((len(words), item))

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(end, state, length) of the longest match that ends before each word `end`, where it can hold a window."""
        step, link, length, shortest = self.step, self.link, self.length, self.shortest
        state = n = 0
        for end, c in enumerate(map(self.ids.get, words), 1):
            if c is None:
                state = n = 0
                continue
            to = step[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = step[state].get(c)
            if to is None:
                n = 0
                continue
            state = to
            n += 1
            if n >= shortest:
                yield end, state, n

    def matches(self, words: list[bytes]) -> tuple[list[Span], set[str]]:
        """Spans [from, to) of words within windows that occur, merged and in order; the items they are of."""
        spans: list[Span] = []
        items: set[str] = set()
        for end, state, n in self.stream(words):
            most = 0
            if n >= self.window:
                most = n
                items |= self.windows[self.at_window[state]]
            s = self.nearest[state]
            while s >= 0:
                for size, item in self.whole[s]:
                    if size <= n:
                        most = max(most, size)
                        items.add(item)
                s = self.nearest[self.link[s]]
            if most:
                spans.append((end - most, end))
        return merged(spans), items


def merged(spans: Sequence[Span]) -> list[Span]:
    out: list[Span] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


#: Blocks that are sent to all workers at most, and a worker's automata of them.
MOST_NEAR = 4
_BUILT: dict[str, SuffixAutomaton] = {}
#: Bits of the field of window hashes: so many a window, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Documents of one block that go to one task, about, and parts into which pairs of one window are dealt.
DOCUMENTS, SALTS = 2048, 16


def built(key: str, block: Broadcast, window: int) -> SuffixAutomaton:
    if key not in _BUILT:
        if len(_BUILT) >= 2 * MOST_NEAR:  # those of other calls
            _BUILT.clear()
        _BUILT[key] = SuffixAutomaton(block.value, window)
    return _BUILT[key]


def items_of(benchmark: DataFrame, blocks: int) -> DataFrame:
    """item (its id as a string), text (binary) and block of each item with a text; equal items are one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).filter("text is not null").distinct()
    return items.withColumn("block", F.expr(f"int(pmod(xxhash64(item, text), {blocks}))"))


def worded(rows: Iterator[tuple[str | None, bytes]]) -> list[tuple[str | None, list[bytes]]]:
    return [(item, words) for item, text in rows if (words := folded_words(bytes(text)))]


VERDICT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string, items string"


def verdicts(doc_id: list, n_words: list[int], spans: list[list[Span]], items: list[set[str | None]]) -> list[list]:
    """The columns of the result."""
    spans = [merged(s) for s in spans]
    n_hit = [sum(b - a for a, b in s) for s in spans]
    named = [sorted(x for x in i if x is not None) for i in items]
    lists = [",".join(x) for x in named]
    return [
        doc_id, n_words, n_hit, [len(x) for x in named], [hashlib.sha256(x.encode()).hexdigest() for x in lists],
        [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words, strict=True)], [",".join(f"{a}-{b}" for a, b in s) for s in spans], lists,
    ]


def near(docs: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """Documents in one pass, without a shuffle, through the automata of a benchmark of few blocks. docs: doc_id, text, perhaps carried_row."""
    sc, run_id = docs.sparkSession.sparkContext, uuid.uuid4().hex
    parts: list[list[tuple[str | None, bytes]]] = [[] for _ in range(blocks)]
    for r in items.collect():
        parts[r.block].append((r.item, r.text))
    shared = [(f"{run_id}-{k}", sc.broadcast(worded(p))) for k, p in enumerate(parts) if p]

    def run(doc_id, text):
        words = [folded_words(t) for t in text]
        spans: list[list[Span]] = [[] for _ in words]
        of: list[set[str | None]] = [set() for _ in words]
        for key, block in shared:
            automaton = built(key, block, window)
            for w, s, i in zip(words, spans, of, strict=True):
                hit, names = automaton.matches(w)
                s += hit
                i |= names
        return verdicts(doc_id, [len(w) for w in words], spans, of)

    return map_rows(docs, run, VERDICT)


def window_hashes(words: list[bytes], size: int) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return Units(True, size, size, False).grams(h)


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """Hash, number of words and block of each window of the items."""

    def run(_, text, block):
        out: list[list] = [[], [], []]
        for t, b in zip(text, block, strict=True):
            if words := folded_words(t):
                k = min(window, len(words))
                h = window_hashes(words, k).view(np.int64)
                for column, values in zip(out, (h, np.full(len(h), k), np.full(len(h), b)), strict=True):
                    column.append(values)
        return [np.concatenate(c) if c else [] for c in out]

    return scratch(map_rows(items, run, "h long, k int, block int", as_bytes=True).distinct(), "windows")


def screened(docs: DataFrame, windows: DataFrame, most_bits: int) -> DataFrame:
    """docs with n_words and hashes, those of its windows that the field of the benchmark's knows, and text only where there are such."""
    size = min(most_bits, 1 << max(10, (BITS_EACH * windows.count()).bit_length()))
    lengths = sorted(r.k for r in windows.select("k").distinct().collect())
    slot = F.pmod("h", F.lit(size))
    words = windows.groupBy(F.expr("h").alias("h")).agg(F.first("k")).select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 64))")).alias("bits"))
    field = np.zeros(size // 64, np.int64)  # at most MOST_BITS, whatever the benchmark's size
    for word, bits in words.collect():
        field[word] = bits
    shared = docs.sparkSession.sparkContext.broadcast(field.view(np.uint64))

    def run(uid, doc_id, text):
        n_words, hashes, kept = [], [], []
        for t in text:
            words, found = folded_words(t), []
            for k in lengths:
                if len(words) >= k:
                    h = window_hashes(words, k)
                    at = h & np.uint64(size - 1)
                    found.append(h[(shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)])
            some = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            n_words.append(len(words))
            hashes.append(some.view(np.int64))
            kept.append(t if len(some) else None)
        return [uid, doc_id, n_words, hashes, kept]

    return scratch(map_rows(docs.select("uid", "doc_id", "text", *([CARRIED] if CARRIED in docs.columns else [])), run, "uid long, doc_id long, n_words long, hashes array<long>, text binary", as_bytes=True), "screened")


MATCHES = "uid long, spans array<struct<`from`:int,`to`:int>>, items array<string>"


def match_blocks(rows: DataFrame, window: int) -> DataFrame:
    """Matches of documents in the blocks that they met. rows: block, part, uid (null for an item), item, text; one place's items come first and make one automaton."""

    def run(batches):
        name, automaton, held = None, None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                out: list[list] = [[], [], []]
                for block, part, uid, item, text in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                    if (block, part) != name:
                        name, automaton, held = (block, part), None, []
                    if uid is None:
                        held.append((item, text))
                        continue
                    if automaton is None:
                        automaton, held = SuffixAutomaton(worded(held), window), []
                    spans, items = automaton.matches(folded_words(text))
                    if spans:
                        for column, value in zip(out, (uid, [{"from": a, "to": b} for a, b in spans], sorted(items, key=str)), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["uid", "spans", "items"])

    return rows.repartition("block", "part").sortWithinPartitions("block", "part", F.asc_nulls_first("uid")).mapInArrow(run, struct_of(MATCHES))


def routed(docs: DataFrame, items: DataFrame, window: int, documents: int = DOCUMENTS, most_bits: int = MOST_BITS) -> DataFrame:
    """Documents through the automata of the blocks of which they may hold a window. docs: doc_id, text, uid, perhaps carried_row."""
    items = scratch(items, "items")
    windows = windows_of(items, window)
    rows = screened(docs, windows, most_bits)
    salt = F.expr(f"int(pmod(xxhash64(uid), {SALTS}))")
    asked = rows.select("uid", F.explode("hashes").alias("h"), salt.alias("salt"))
    known = windows.select("h", "block").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = scratch(asked.join(known, ["h", "salt"]).select("uid", "block").distinct(), "pairs")
    parts = pairs.groupBy("block").count().select("block", F.expr(f"int(ceil(count / {documents}))").alias("parts"))
    texts = pairs.join(rows.filter("text is not null").select("uid", "text"), "uid").join(parts, "block")
    texts = texts.select("block", F.expr("int(pmod(xxhash64(uid), parts))").alias("part"), "uid", F.lit(None).cast("string").alias("item"), "text")
    own = items.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("uid"), "item", "text")
    found = match_blocks(own.unionByName(texts), window).groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    found = scratch(found, "matches")
    for x in (items, windows, pairs):
        discard(x)

    def run(doc_id, n_words, spans, names):
        return verdicts(doc_id, n_words, [[(x["from"], x["to"]) for x in s or ()] for s in spans], [set(i or ()) for i in names])

    both = rows.select("uid", "doc_id", "n_words", *([CARRIED] if CARRIED in rows.columns else [])).join(found, "uid", "left")
    return map_rows(both.select("doc_id", "n_words", "spans", "items", *([CARRIED] if CARRIED in rows.columns else [])), run, VERDICT)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """Words of documents within windows of benchmark items.

    docs needs doc_id and text, benchmark item_id and text; with carry all columns of docs come along in the
    struct carried_row, else other columns are left out. Null or empty text has no words and is never
    contaminated; an empty benchmark hits nothing. An item_id that is null hits, but is no item of n_items
    or the list. Every row gives one row, so repeated rows give repeated results. An item given twice
    counts once. Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (hit words, as
    from-to, comma-joined), items (item ids as strings, sorted, comma-joined).
    """
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    items, text = items_of(benchmark, blocks), F.col("text").cast("binary").alias("text")
    if blocks <= MOST_NEAR:
        return near(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *carrying(docs, carry)), items, blocks, window)
    return routed(identified(docs, text, *carrying(docs, carry)), items, window)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_window AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM item_window),
doc_window AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM words, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, d.k, p, item_id FROM doc_window d JOIN item_window i ON d.k = i.k AND d.g = i.g),
word AS (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, k, p FROM hit)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM word GROUP BY doc_id),
stretch AS (SELECT doc_id, min(q) - 1 AS lo, max(q) AS hi FROM (SELECT doc_id, q, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS r FROM word) GROUP BY doc_id, r),
span AS (SELECT doc_id, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS spans FROM stretch GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(spans, '') AS spans, coalesce(ids, '') AS items
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN span USING (doc_id)
"""
