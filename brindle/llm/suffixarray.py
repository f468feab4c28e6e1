"""Suffix-array dedup over bytes or words: a run-length index per shard.

Runs of windows meet in shards by their anchors (see `anchors`). Each shard's Burrows-Wheeler transform
is kept as runs, with samples at both ends of each run; the matching statistics of all contents streamed
through it mark what is within long matches.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .anchors import SHARD_BYTES, Units, covered, find_repeats, ranges
from .common import map_rows, table
from .suffixes import RunLengthIndex, join_contents

#: Bytes of a match that is removed, of one that is reported, and of the grams that anchor it. Passages of
#: somewhat over 50 words have 250 bytes or more in texts whose words have 4 letters on average.
WINDOW, REPORTED, GRAM = 400, 250, 32
#: One gram of so many is preferred as anchor.
SPARSE = 16
#: Words of the grams that anchor windows of words.
WORD_GRAM = 5
PLAIN_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Numbers of ranges: of matches that are removed and of those that are reported.
REMOVED, SHARED = 0, 1


def held_again(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Of the strings of a length at some positions, which stand at two of these or more; told apart by 128 bits."""
    if not len(at):
        return np.zeros(0, bool)
    _, of, n = np.unique(np.array([xxhash.xxh3_128_digest(text[k : k + length]) for k in at.tolist()]), return_inverse=True, return_counts=True)
    return n[of] > 1


def search_contents(contents: list[bytes], windows: np.ndarray, count: np.ndarray, window: int, reported: int, words: bool = False) -> list[tuple[list[int], list[int], list[int]]]:
    """For each content, ranges of starts of strings that stand elsewhere too, by length. Only its windows are starts: what follows them may start in other contents of its text."""
    if words:
        number: dict[bytes, int] = {}
        flat, sizes = np.array([number.setdefault(w, len(number)) for c in contents for w in c.split(b" ")]), np.array([c.count(b" ") + 1 for c in contents])
    else:
        flat, sizes = np.frombuffer(b"".join(contents), np.uint8), np.array([len(c) for c in contents])
    text, begins = join_contents(flat, sizes)
    longest = RunLengthIndex(text).matching_statistics(begins, sizes)
    start = np.zeros(len(text) + 1, np.int8)
    start[begins] += 1
    start[begins + windows] -= 1
    longest[np.cumsum(start[:-1]) == 0] = 0
    # what follows the windows is shorter than `window`, so that only shorter matches can be with it
    short = np.flatnonzero((longest >= reported) & (longest < window))
    if len(short) and reported < window:
        long = np.flatnonzero(longest >= window)
        longest[short[~held_again(text, np.concatenate([short, long]), reported)[: len(short)]]] = 0
    for k in np.flatnonzero(count > 1).tolist():  # equal contents match whole
        longest[begins[k] : begins[k] + windows[k]] = sizes[k] - np.arange(windows[k])
    out: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in contents]
    for least, kind in ((window, REMOVED), (reported, SHARED)):
        lo, hi = ranges(longest >= least)
        of = np.searchsorted(begins, lo, side="right") - 1
        for k, a, b in zip(of.tolist(), (lo - begins[of]).tolist(), (hi - begins[of]).tolist(), strict=True):
            out[k][0].append(a)
            out[k][1].append(b)
            out[k][2].append(kind)
    return out


def remove_long_repeats(docs: DataFrame, window: int = WINDOW, reported: int = REPORTED, gram: int | None = None, shard_bytes: int = SHARD_BYTES, carry: bool = False, with_text: bool = True, words: bool = False, **others) -> DataFrame:
    """Remove what is within strings of `window` bytes, or words, that start anywhere else, in the same text or another.

    docs needs doc_id and text; with carry all columns come along in the struct carried_row, else other
    columns are left out. Null and empty texts have nothing. Repeated rows are two places, so that all
    their strings go; null doc_ids are ordinary rows. An empty table gives no row. Strings are judged on
    the input. Words are `[^\\x20\\x09-\\x0D]+`, whatever stands between them; from the first to the last of a string's all bytes go.
    `reported`, at most `window`, is a length from which repeats are counted without being removed. Returns
    doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left), n_shared (bytes, or words, within strings of
    `reported` that start elsewhere too), spans (array of structs from, to: bytes removed), with_text also
    kept (the bytes left as text; a character that is cut goes whole).
    """
    reported = min(reported, window)
    gram = gram or (WORD_GRAM if words else GRAM)

    def run(doc_id, _, text, found, copy):
        out: list[list] = [[] for _ in range(7 + with_text)]
        for d, t, f, c in zip(doc_id, text, found, copy, strict=True):
            raw = t or b""
            places = [m.span() for m in PLAIN_WORD.finditer(raw)] if words and (c or f) else []
            size = len(places) if words else len(raw)
            gone = np.full(size, size >= window) if c else covered(size, window, f, SHARED) if f else np.zeros(size, bool)
            shared = size * (size >= reported) if c else int(covered(size, reported, f, SHARED + 1).sum()) if f else 0
            lo, hi = ranges(gone) if c or f else ([], [])
            edges = [(places[a][0], places[b - 1][1]) if words else (int(a), int(b)) for a, b in zip(lo, hi, strict=True)]
            ends = [0, *(x for e in edges for x in e), len(raw)]
            left = [raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]
            row = [d, len(raw), sum(b - a for a, b in edges), len(edges), hashlib.sha256(b"".join(left)).hexdigest(), shared, [{"from": a, "to": b} for a, b in edges]]
            if with_text:
                row.append("".join(x.decode("utf-8", "ignore") for x in left))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out

    def search(contents, windows, least, count):
        return search_contents(contents, windows, count, window, reported, words)

    found = find_repeats(docs, Units(words, reported, gram, False, window, 1 if words else SPARSE, True), search, shard_bytes, carry, **others)
    return map_rows(found, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, spans array<struct<`from`:int,`to`:int>>" + ", kept string" * with_text, rows=64)


def op8_suffixarray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_long_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("spans")


ORACLE = """
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pieces AS (SELECT r, 1000 * c AS base, x[2000 * c + 1:2000 * c + 2798] AS y FROM (SELECT r, x, unnest(range(0, len(x) // 2000 + 1)) AS c FROM raw)),
starts AS (SELECT r, k, base, y, unnest(range(0, least(1000, len(y) // 2 - k + 1))) AS p FROM pieces, (VALUES (400), (250)) s(k) WHERE len(y) >= 2 * k),
strings AS MATERIALIZED (SELECT r, k, base + p AS p, md5_number(y[2 * p + 1:2 * (p + k)]) AS g FROM starts),
again AS (SELECT k, g FROM strings GROUP BY k, g HAVING count(*) > 1),
hits AS (SELECT r, k, p, coalesce(p > lag(p) OVER w + k, true) AS new FROM strings JOIN again USING (k, g) WINDOW w AS (PARTITION BY r, k ORDER BY p)),
runs AS (SELECT r, k, min(p) AS lo, max(p) + k AS hi FROM (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r, k ORDER BY p) AS n FROM hits) GROUP BY r, k, n),
shared AS (SELECT r, sum(hi - lo) AS n_shared FROM runs WHERE k = 250 GROUP BY r),
cut AS (SELECT r, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, sum(hi - lo) AS n_removed FROM runs WHERE k = 400 GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(los), 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN los IS NULL THEN unhex(x) ELSE unhex(list_aggregate(list_transform(range(1, len(los) + 2), lambda i: x[2 * coalesce(his[i - 1], 0) + 1:2 * coalesce(los[i], len(x) // 2)]), 'string_agg', '')) END) AS kept_sha256,
  CAST(coalesce(n_shared, 0) AS BIGINT) AS n_shared
FROM raw LEFT JOIN cut USING (r) LEFT JOIN shared USING (r)
"""
