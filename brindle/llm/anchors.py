"""Meeting places for equal windows of text, and their shards.

A window is a fixed number of consecutive units (words or bytes) of one document. Each window has an
anchor: one of the grams in it, chosen by hashes alone, so that equal windows have equal anchors and a
window can occur again only where its anchor does. Consecutive windows with equal anchors make a run.

1. Runs are drawn from each text (`runs_of`): one row for the anchor's hash, its document and place.
2. Runs are dropped whose anchor stands nowhere else, or (where Units say so) nowhere else beside the same units: a window
   holds, on one side of its anchor at least, half of its other units. Runs of frequent anchors are kept without meeting.
3. The texts of the other runs are cut out. Equal ones are counted once within a task, then once at all.
4. Runs go to shards by anchor; shards of a bounded size are indexed, and each run's windows searched.
5. Results go back to every document with a run of the same text, once for all its places there.

No anchor gathers a large share of the rows. Grams that are frequent in a sample of documents anchor only
windows made of such grams alone, which are few different texts, however often they stand. Runs of an anchor
that many runs have nevertheless are cut into parts and dealt out by nearly all of what stands there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CARRIED, carrying, column_values, discard, identified, map_rows, plain_words, scratch, ship, spread, struct_of

#: Share of rows in which frequent grams are counted. It steers only which gram of a window is its anchor, never which windows are found.
SAMPLE, SEED = 0.02, 7
#: Grams that count as frequent at most, and the documents of the sample that must hold them. A gram beyond these has
#: no more than one part in MOST_FREQUENT of what the sample holds, so that its runs are fewer than a task has on
#: average, for as many tasks.
MOST_FREQUENT, LEAST_FREQUENT = 1 << 18, 20
#: Bits of the first test for frequent grams.
QUICK = 22
#: Runs of an anchor from which on they are dealt out by what stands there, in parts of so many to a string's length.
HOT, PARTS = 1_000, 16
#: Bits of a position within a piece of text; longer texts are taken in pieces.
PLACE = 24
#: Windows of one run at most.
LONGEST = 1024
#: Bytes of distinct run texts in one shard, and of those that a task holds to count equal ones.
SHARD_BYTES, COMBINED_BYTES = 1 << 20, 8 << 20

#: Parts into which the copies of one text are dealt.
SALTS = 16

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BYTE_HASHES = spread(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


class Units(NamedTuple):
    """What windows are made of.

    by_document: a window must occur in another document, not only elsewhere. reach: units that are cut
    out from each window's start on, the window's or more. sparse: one gram of so many (a power of 2) is
    preferred as anchor, so that only these need be counted. beside: runs are dropped by what stands beside their
    anchors, which is worth a number a run where windows are long beside grams.
    """

    words: bool
    window: int
    gram: int
    by_document: bool
    reach: int = 0
    sparse: int = 1
    beside: bool = False

    def hashes(self, text: bytes) -> np.ndarray:
        return self.together([text])[0]

    def together(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the units of some texts, end to end, and how many each text has."""
        if not self.words:
            return BYTE_HASHES[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)
        own = [plain_words(t) for t in texts]
        sizes = np.array([len(w) for w in own], np.int64)
        return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(own)), np.uint64, int(sizes.sum())), sizes

    def grams(self, h: np.ndarray) -> np.ndarray:
        """Hashes of the grams: sums of unit hashes times powers of a multiplier, by doubling."""
        size, out, done = 1, h, 0
        total = np.zeros(max(0, len(h) - self.gram + 1), np.uint64)
        with np.errstate(over="ignore"):
            power = MULTIPLIER | np.uint64(1)
            while True:
                if self.gram & size:
                    total = total * power + out[done : done + len(total)]
                    done += size
                if done == self.gram:
                    return spread(total)
                out = out[: len(out) - size] * power + out[size:]
                power *= power
                size *= 2


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values, by minima within blocks."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Frequent:
    """A set of gram hashes with a quick first test."""

    def __init__(self, grams: np.ndarray):
        self.sorted = np.sort(grams.astype(np.uint64))
        self.quick = np.zeros(1 << QUICK, bool)
        self.quick[self.sorted & np.uint64((1 << QUICK) - 1)] = True

    def holds(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), bool)
        if len(self.sorted):
            maybe = np.flatnonzero(self.quick[grams & np.uint64((1 << QUICK) - 1)])
            i = np.minimum(np.searchsorted(self.sorted, grams[maybe]), len(self.sorted) - 1)
            out[maybe] = self.sorted[i] == grams[maybe]
        return out


class Sides:
    """Hashes of the units beside anchors, of which equal windows share those on one side at least."""

    def __init__(self, units: Units):
        self.words, self.gram, self.size = units.words, units.gram, (units.window - units.gram + 1) // 2

    def of(self, raw: bytes, h: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """32 bits for the units before each anchor and 32 for those after it, 0 where its text [begin, end) has too few. h: unit hashes of the texts."""
        out = np.zeros(len(at), np.uint64)
        for shift, lo in ((32, at - self.size), (0, at + self.gram)):
            there = np.flatnonzero((lo >= begin) & (lo + self.size <= end))
            lo = lo[there]
            if self.words:
                bits = np.zeros(len(lo), np.uint64)
                for k in range(self.size):
                    bits = spread(bits * MULTIPLIER + h[lo + k])
            else:
                bits = np.array([xxhash.xxh3_64_intdigest(raw[k : k + self.size]) for k in lo.tolist()], np.uint64)
            out[there] |= np.maximum(bits >> np.uint64(32), np.uint64(1)) << np.uint64(shift)
        return out


#: Bytes of texts whose runs are drawn together.
TOGETHER = 1 << 15


def batches_of(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Some texts at a time, with the number of the first."""
    first = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def text_runs(texts: list[bytes], units: Units, frequent: Frequent, sides: Sides) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each run in some texts: number of the text, anchor hash, first window, number of windows, kind, and perhaps what stands beside the anchor."""
    h, sizes = units.together(texts)
    if not (sizes >= units.window).any():
        return
    raw = b"" if units.words else b"".join(texts)
    ends = np.cumsum(sizes)
    begins, counts = ends - sizes, np.maximum(0, sizes - units.window + 1)
    grams = units.grams(h)
    wide = units.window - units.gram + 1
    counted = np.flatnonzero(grams & np.uint64(units.sparse - 1) == 0)
    often, level = np.zeros(len(grams), bool), np.full(len(grams), 2 << 62 - PLACE, np.uint64)  # what isn't counted comes last
    often[counted] = frequent.holds(grams[counted])
    level[counted] = often[counted].astype(np.uint64) << np.uint64(62 - PLACE)
    rank = (grams * MULTIPLIER) >> np.uint64(PLACE + 2) | level
    owners = np.repeat(np.arange(len(texts)), counts)
    starts = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)  # windows that no text's end cuts
    piece = (1 << PLACE) - wide
    for lo in range(0, len(h) - units.window + 1, piece):
        part = rank[lo : lo + piece + wide - 1]
        least = lowest(part << np.uint64(PLACE) | np.arange(len(part), dtype=np.uint64), wide)
        here = slice(*np.searchsorted(starts, [lo, lo + piece]))
        start, owner = starts[here], owners[here]
        if not len(start):
            continue
        at = (least[start - lo] & np.uint64((1 << PLACE) - 1)).astype(np.int64) + lo
        anchor = grams[at]
        first = np.append(0, np.flatnonzero((anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])) + 1)
        n = np.diff(np.append(first, len(at)))
        parts = -(-n // LONGEST)  # a text that repeats itself has one anchor for long
        if (parts > 1).any():
            first = np.repeat(first, parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
            n = np.diff(np.append(first, len(at)))
        several = at[first] != at[first + n - 1]
        of, place = owner[first], at[first]
        run = (of, anchor[first].view(np.int64), start[first] - begins[of], n, several * SEVERAL | often[place] * FREQUENT)
        yield (*run, sides.of(raw, h, place, begins[of], ends[of]).view(np.int64)) if units.beside else run


#: Bits of a run's kind: equal anchors stand in several places; the anchor is a frequent gram.
SEVERAL, FREQUENT = 1, 2
#: A run's first window, number of windows and kind are one number: two bits for the kind, PLACES for the windows.
PLACES = 11
RUNS, BESIDE = "uid long, g long, place long", ", beside long"


def runs_of(rows: DataFrame, units: Units, frequent: np.ndarray) -> DataFrame:
    """One row for each run of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    known: list[Frequent] = []
    sides = Sides(units)

    def run(uid, doc_id, ord_, text, *_):
        if not known:
            known.append(Frequent(shared.value))
        out: list[list[np.ndarray]] = [[] for _ in range(3 + units.beside)]
        uids = np.array(uid, np.int64)
        for begin, texts in batches_of([t or b"" for t in text]):
            for of, g, start, n, kind, *beside in text_runs(texts, units, known[0], sides):
                for column, values in zip(out, (uids[begin + of], g, (start << PLACES | n) << 2 | kind, *beside), strict=True):
                    column.append(values)
        return [np.concatenate(c) if c else [] for c in out]

    return map_rows(rows.select("uid", "doc_id", "ord", "text", *(F.col(c).alias("along") for c in rows.columns if c == CARRIED)), run, RUNS + BESIDE * units.beside, as_bytes=True)


def frequent_grams(rows: DataFrame, units: Units) -> np.ndarray:
    """Hashes of the grams that most documents of a sample hold, of all that are preferred as anchors; at most MOST_FREQUENT."""

    def run(text):
        held = []
        for t in text:
            grams = units.grams(h) if len(h := units.hashes(t or b"")) >= units.gram else np.zeros(0, np.uint64)
            held.append(np.unique(grams[grams & np.uint64(units.sparse - 1) == 0]))
        return [np.concatenate(held).view(np.int64)]

    counts = map_rows(rows.sample(SAMPLE, SEED).select("text"), run, "g long", as_bytes=True).groupBy("g").count().filter(F.col("count") >= LEAST_FREQUENT)
    counts = scratch(counts, "grams")
    least, known = LEAST_FREQUENT, 0
    for r in counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).toLocalIterator():  # from which count on there are few enough
        known += r.n
        if known > MOST_FREQUENT:
            least = r["count"] + 1
            break
    found = counts.filter(F.col("count") >= least).select("g").collect()
    discard(counts)
    return np.array([r.g for r in found], np.int64).view(np.uint64)


def content_key(content: bytes, windows: int) -> bytes:
    """96 bits of a run's text and number of windows, by which results find their way back."""
    return xxhash.xxh3_128_digest(content, seed=windows)[:12]


def parts_of(h: np.ndarray, units: Units, g: int, n: int, length: int) -> Iterator[tuple[int, int, int]]:
    """Parts (from, to, group) of the first n windows of a run whose anchor is hot, by what stands there. h: unit hashes from the run's first window on.

    Windows are parted by their distance to their anchor, the leftmost gram of that hash. A part's group is
    a hash of the units that all strings of `length` from its windows have in common, nearly the whole
    strings: equal ones meet, and unlike ones with the same anchor hardly ever do.
    """
    step = max(1, length // PARTS)
    lo = 0
    for a in np.flatnonzero(units.grams(h[: n + units.window - 1]) == np.int64(g).view(np.uint64)).tolist():
        hi = min(n, a + 1)
        while lo < hi:
            nearest = a - (a - lo) // step * step  # the last start of this part, were the run long enough
            end = min(hi, nearest + 1)
            yield lo, end, xxhash.xxh3_64_intdigest(h[nearest : nearest - step + 1 + length].tobytes(), seed=length << 16 | (a - lo) // step)
            lo = end


def cut(text: bytes, units: Units, runs: list[dict]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(group, length, first window, number of windows, content) of the runs of a text; words are joined by one space.

    A content holds the strings of reach that start in its windows. Runs of a hot anchor are cut for each length apart.
    """
    own = plain_words(text) if units.words else text
    for r in runs:
        place = r["place"] >> 2
        start, n = place >> PLACES, place & ((1 << PLACES) - 1)
        parts = [(0, n, r["g"], units.reach)]
        if r["hot"]:
            piece = own[start : start + n + units.reach - 1]
            h = units.hashes(b" ".join(piece) if units.words else piece)
            parts = [(lo, hi, g, length) for length in sorted({units.window, units.reach}) for lo, hi, g in parts_of(h, units, r["g"], min(n, len(h) - length + 1), length)]
        for lo, hi, group, length in parts:
            content = own[start + lo : start + hi + length - 1]
            yield group, length, start + lo, hi - lo, b" ".join(content) if units.words else content


def whole_rows(joined: DataFrame) -> DataFrame:
    """All columns of texts with their runs, so that their shuffle is one."""
    return joined.select("uid", "doc_id", "ord", "text", "runs", *(F.col(c).alias("along") for c in joined.columns if c == CARRIED))


def run_keys(joined: DataFrame, units: Units) -> DataFrame:
    """Digests of the different contents of each document's runs, with the first windows of those that have it: a text that repeats itself has few, at many places."""

    def run(uid, doc_id, ord_, text, runs, *_):
        out: list[list] = [[] for _ in range(3)]
        for u, t, own in zip(uid, text, runs, strict=True):
            starts: dict[bytes, list[int]] = {}
            for _, _, start, n, content in cut(t, units, own):
                starts.setdefault(content_key(content, n), []).append(start)
            for column, values in zip(out, ([u] * len(starts), starts.values(), starts), strict=True):
                column.extend(values)
        return out

    return map_rows(whole_rows(joined), run, "uid long, starts array<int>, key binary", as_bytes=True, rows=64)


def contents_of(joined: DataFrame, units: Units) -> DataFrame:
    """The runs' contents by group; equal ones that a task holds at once are one row, with their smallest document and count."""
    ship(joined.sparkSession)
    types = (("g", pa.int64()), ("length", pa.int32()), ("key", pa.binary()), ("windows", pa.int32()), ("content", pa.binary()), ("least", pa.int64()), ("count", pa.int64()))

    def run(batches):
        held: dict[tuple[int, int, bytes], list] = {}
        size = 0

        def batch_of():
            rows = [(np.uint64(g & ((1 << 64) - 1)).view(np.int64).item(), length, k, *v) for (g, length, k), v in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for o, t, own in zip(*(column_values(c, True) for c in batch.slice(lo, 64).columns[2:5]), strict=True):
                    for g, length, _, n, content in cut(t, units, own):
                        k = (g, length, content_key(content, n))
                        if (known := held.get(k)) is None:
                            held[k] = [n, content, o, 1]
                            size += len(content)
                        else:
                            known[2] = min(known[2], o)
                            known[3] += 1
                    if size > COMBINED_BYTES:
                        yield batch_of()
                        held, size = {}, 0
        if held:
            yield batch_of()

    return whole_rows(joined).mapInArrow(run, struct_of("g long, length int, key binary, windows int, content binary, least long, count long"))


#: Of a shard's contents, with their number of windows, smallest document and count: for each, ranges of windows that occur elsewhere and a number for each range.
Search = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], list[tuple[list[int], list[int], list[int]]]]

FOUND = "key binary, los array<int>, his array<int>, least array<long>"


def search_shards(contents: DataFrame, search: Search, shard_bytes: int) -> DataFrame:
    """Index the contents of some groups at a time, and give the windows of each that occur elsewhere. Contents of different length share no shard: their windows may be the same."""
    types = (("key", pa.binary()), ("los", pa.list_(pa.int32())), ("his", pa.list_(pa.int32())), ("least", pa.list_(pa.int64())))

    def run(batches):
        keys, windows, texts, least, count = [], [], [], [], []
        size, group = 0, None

        def results():
            found = search(texts, np.array(windows, np.int64), np.array(least, np.int64), np.array(count, np.int64))
            rows = [(k, *f) for k, f in zip(keys, found, strict=True) if f[0]]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])

        for batch in batches:
            for *g, key, starts, content, o, n in zip(*(column_values(c) for c in batch.columns), strict=True):
                if g == group and key == keys[-1]:
                    least[-1] = min(least[-1], o)
                    count[-1] += n
                    continue
                if keys and (size >= shard_bytes and g != group or g[1] != group[1]):
                    yield results()
                    keys, windows, texts, least, count, size = [], [], [], [], [], 0
                group = g
                for column, value in zip((keys, windows, texts, least, count), (key, starts, content, o, n), strict=True):
                    column.append(value)
                size += len(content)
        if keys:
            yield results()

    return contents.repartition("g").sortWithinPartitions("length", "g", "key").mapInArrow(run, struct_of(FOUND))


def find_repeats(docs: DataFrame, units: Units, search: Search, shard_bytes: int = SHARD_BYTES, carry: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, ord, text (binary), found and copy: the runs of each text with windows that occur elsewhere (starts, los, his, least), equal ones together.

    docs needs doc_id and text. One row comes back for each, found is null where nothing was. Of texts
    that are equal (by MD5) one is indexed; copy marks, with by_document, those after the smallest doc_id,
    and otherwise all of them: all their windows stand elsewhere. With carry all columns come along as a struct.
    """
    binary = F.col("text").cast("binary").alias("text")
    rows = identified(docs, binary, *carrying(docs, carry, "text")).withColumn("ord", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    digests = rows.select("uid", "ord", F.md5("text").alias("digest"), F.expr(f"int(pmod(xxhash64(uid), {SALTS}))").alias("salt")).filter("digest is not null")
    same = digests.groupBy("digest").agg(F.min(F.struct("ord", "uid")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    later = F.col("ord") > F.col("first.ord")
    copies = digests.join(same, ["digest", "salt"]).select("uid", (later if units.by_document else F.lit(True)).alias("copy"), (later if units.by_document else F.col("uid") != F.col("first.uid")).alias("left_out"))
    # the joins below ask for the same columns and rows of texts, so that Spark shuffles them once
    texts = rows.filter("uid is not null").select("uid", "doc_id", "ord", "text", *([CARRIED] if carry else []))
    indexed = texts.join(copies.filter("left_out").select("uid", "left_out"), "uid", "left").filter("left_out is null")
    runs = runs_of(indexed, units, frequent_grams(rows, units))
    # a frequent anchor's runs are all kept, so they needn't meet to be counted: they are dealt out by document and place
    often, several = F.col("place").bitwiseAND(FREQUENT) > 0, F.col("place").bitwiseAND(SEVERAL) > 0
    alone = F.when(often, F.xxhash64("uid", "place"))
    same_anchor = W.partitionBy("g", alone)
    n = F.count("*").over(same_anchor)

    def stands_again(w: W) -> Column:
        return F.min("uid").over(w) != F.max("uid").over(w) if units.by_document else F.count("*").over(w) > 1

    again = stands_again(same_anchor)
    if units.beside:
        runs = runs.withColumns({"before": F.shiftrightunsigned("beside", 32), "after": F.col("beside").bitwiseAND(F.lit(0xFFFFFFFF))})
        # an anchor that stands several times in a run has several neighbourhoods, of which one is known: all runs of it stay
        kept = F.max(several).over(same_anchor)
        for side in ("before", "after"):
            kept = kept | (F.col(side) != 0) & stands_again(W.partitionBy("g", alone, side))
        again = again & kept
    if not units.by_document:
        again = again | several
    met = runs.withColumns({"again": often | again, "hot": often | (n >= hot)}).filter("again")
    own = met.groupBy("uid").agg(F.collect_list(F.struct("place", "g", "hot")).alias("runs"))
    joined = texts.join(own, "uid")
    found = search_shards(contents_of(joined, units), search, shard_bytes)
    placed = run_keys(joined, units).join(found, "key").groupBy("uid").agg(F.collect_list(F.struct("starts", "los", "his", "least")).alias("found"))
    both = texts.join(placed, "uid", "left").join(copies.filter("copy").select("uid", "copy"), "uid", "left")
    return both.select("doc_id", "ord", "text", "found", "copy", *([CARRIED] if carry else []))


def covered(size: int, window: int, found: list | None, below: int) -> np.ndarray:
    """Units of a text within windows of the ranges whose number is below the given one."""
    change = np.zeros(size + 1, np.int32)
    for run in found or ():
        for lo, hi, least in zip(run["los"], run["his"], run["least"], strict=True):
            if least < below:
                for start in run["starts"]:
                    change[start + lo] += 1
                    change[start + hi + window - 1] -= 1
    return np.cumsum(change[:-1]) > 0


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


