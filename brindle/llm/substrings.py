"""Substring dedup over words: a compressed FM-index per shard.

Runs of windows meet in shards by their anchors (see `anchors`). Their texts are streamed through the
shard's FM-index: backward search over the wavelet tree gives for each word how many words up to it stand
in the shard again (the matching statistic, up to the window's length). Intervals of that length are
reported, with the smallest document that the rows found belong to.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .anchors import SHARD_BYTES, Units, covered, find_repeats, ranges
from .common import map_rows, plain_words, table
from .suffixes import FmIndex, join_contents

#: Words of a window, and of the grams that anchor it.
WINDOW, GRAM = 13, 5


def search_words(contents: list[bytes], least: np.ndarray, count: np.ndarray, window: int = WINDOW) -> list[tuple[list[int], list[int], list[int]]]:
    """For each content, ranges of its windows with the smallest document of each, where it or another holds them again."""
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(w, len(number)) for c in contents for w in c.split(b" ")])
    sizes = np.array([c.count(b" ") + 1 for c in contents])
    text, begins = join_contents(flat, sizes)
    documents, rank = np.unique(least, return_inverse=True)
    index = FmIndex(text, np.repeat(rank, sizes + 1))
    windows = sizes - window + 1
    first = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(contents)), windows)
    at = np.arange(len(owner)) - first[owner]
    length, lo, hi = index.stream(text, begins[owner] + at + window, window)
    smallest = least[owner]
    again = np.flatnonzero(length == window)
    smallest[again] = documents[index.smallest_owner(lo[again], hi[again])]
    # stretches of windows of one content with one smallest document; those of its own document alone count only where it stands several times
    begin = np.flatnonzero((at == 0) | np.append(True, smallest[1:] != smallest[:-1]))
    of = owner[begin]
    end = np.append(at[begin[1:] - 1] + 1, windows[-1:]) if len(begin) else begin
    keep = (smallest[begin] < least[of]) | (count[of] > 1)
    out: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in contents]
    for k, a, b, d in zip(of[keep].tolist(), at[begin[keep]].tolist(), end[keep].tolist(), smallest[begin[keep]].tolist(), strict=True):
        out[k][0].append(a)
        out[k][1].append(b)
        out[k][2].append(d)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, with_text: bool = True, **others) -> DataFrame:
    """Remove words within windows that a document with a smaller doc_id holds too.

    docs needs doc_id and text; other columns are left out. Null and empty texts have no words. Repeated
    rows have equal doc_ids and so don't remove each other's words; null doc_ids come after all others
    and are equal. An empty table gives no row. Windows are judged on the input. Returns doc_id, n_words,
    n_removed, kept_sha256, spans (words removed, as from-to, comma-joined), with_text also kept (words left,
    joined by one space).
    """

    def run(doc_id, ord_, text, found, copy):
        out: list[list] = [[] for _ in range(5 + with_text)]
        for d, o, t, f, c in zip(doc_id, ord_, text, found, copy, strict=True):
            words = plain_words(t)
            gone = np.full(len(words), len(words) >= window) if c else covered(len(words), window, f, o) if f else np.zeros(len(words), bool)
            spans = list(zip(*(x.tolist() for x in ranges(gone)), strict=True)) if c or f else []
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words)
            row = [d, len(words), sum(b - a for a, b in spans), hashlib.sha256(kept).hexdigest(), ",".join(f"{a}-{b}" for a, b in spans)]
            for column, value in zip(out, [*row, kept.decode("utf-8", "replace")] if with_text else row, strict=True):
                column.append(value)
        return out

    def search(contents, windows, least, count):
        return search_words(contents, least, count, window)

    found = find_repeats(docs, Units(True, window, gram, True, window), search, shard_bytes, **others)
    return map_rows(found, run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans string" + ", kept string" * with_text)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words WHERE len(w) >= 13)),
firsts AS (SELECT g, min(doc_id) AS d FROM windows GROUP BY g HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM windows JOIN firsts USING (g) WHERE d < doc_id),
each AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS q FROM words),
kept AS (SELECT e.doc_id, string_agg(w[e.q], ' ' ORDER BY e.q) FILTER (g.q IS NULL) AS t, count(g.q) AS n_removed FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.q = g.q GROUP BY e.doc_id),
stretch AS (SELECT doc_id, min(q) - 1 AS lo, max(q) AS hi FROM (SELECT doc_id, q, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS r FROM gone) GROUP BY doc_id, r),
span AS (SELECT doc_id, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS spans FROM stretch GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(spans, '') AS spans FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN span USING (doc_id)
"""
