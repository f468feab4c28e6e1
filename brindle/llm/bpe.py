"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut into pre-tokens by the byte-level pattern. For each pre-token a segment tree holds the
merge rank of every adjacent pair, with the position in its low bits: the root is the leftmost pair of
lowest rank. A merge changes three leaves and the nodes above them, until no pair can merge. Pre-tokens
not seen before by a worker are merged many at a time, one tree per row of a numpy array.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: Fixed value: the byte-level pre-tokenizer's pattern; \s is Unicode's White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

NEVER = np.int64(1) << 62
POSITION = 20
#: Pre-tokens of more bytes have a tree of their own, since padding others to their length would waste memory.
LONG = 256
#: A worker's known pre-tokens; beyond it, it forgets them and starts anew.
KNOWN = 400_000
#: Table cells of the trees merged at once.
CELLS = 1 << 21


def byte_characters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_characters()
        self.pattern = regex.compile(PATTERN)
        self.base = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.base[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.bytes_of = {i: bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode() for t, i in (vocab | self.added).items()}
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; added tokens are found first and stand alone."""
        if self.split_added is None or not any(t in text for t in self.added):
            return self.pattern.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.split_added.split(text)):
            out += [part] if i % 2 else self.pattern.findall(part)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is an empty text."""
        if len(self.known) > KNOWN:
            self.known = {}
        if not self.known:
            self.known |= {t: np.array([i], "<u4").tobytes() for t, i in self.added.items()}
        cut = [self.pieces(t) if t else [] for t in texts]
        known = self.known
        self.learn({p for c in cut for p in c if p not in known})
        return [b"".join([known[p] for p in c]) for c in cut]

    def learn(self, pieces: set[str]) -> None:
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            if len(raw) > LONG:
                self.known[p] = np.array(self.merge_one(self.base[np.frombuffer(raw, np.uint8)].tolist()), "<u4").tobytes()
            else:
                by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append((p, raw))
        for size, group in by_size.items():
            at_once = max(1, CELLS // (2 * size))
            for lo in range(0, len(group), at_once):
                part = group[lo : lo + at_once]
                for (p, _), ids in zip(part, self.merge_many([raw for _, raw in part], size), strict=True):
                    self.known[p] = ids

    def pair_values(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of pairs: the rank above the position, or NEVER."""
        key = left << 20 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i] << POSITION | at, NEVER)

    def merge_many(self, raws: list[bytes], size: int) -> list[bytes]:
        """Merge pre-tokens of at most size bytes, all trees in step."""
        n, lengths = len(raws), np.array([len(r) for r in raws])
        text = np.frombuffer(b"".join(r.ljust(size, b"\0") for r in raws), np.uint8).reshape(n, size)
        token = np.zeros((n, size + 1), np.int64)
        token[:, :size] = self.base[text]
        column = np.arange(size)
        tree = np.full((n, 2 * size), NEVER, np.int64)
        if size > 1:
            pair = self.pair_values(token[:, : size - 1], token[:, 1:size], column[: size - 1])
            tree[:, size : 2 * size - 1] = np.where(column[1:] < lengths[:, None], pair, NEVER)
            level = size
            while level > 1:
                tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
                level //= 2
        following = np.tile(np.arange(1, size + 2), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))
        stands = column < lengths[:, None]
        rows = np.flatnonzero(tree[:, 1] < NEVER)
        while len(rows):
            root = tree[rows, 1]
            at = root & ((1 << POSITION) - 1)
            new = self.merged[root >> POSITION]
            gone = following[rows, at]
            after = following[rows, gone]
            token[rows, at] = new
            following[rows, at] = after
            before[rows, np.minimum(after, size)] = at
            stands[rows, gone] = False
            end = lengths[rows]
            prev = before[rows, at]
            inside, first = after < end, prev >= 0
            tree[rows, size + at] = np.where(inside, self.pair_values(new, token[rows, np.minimum(after, size)], at), NEVER)
            tree[rows, size + gone] = NEVER
            has = np.flatnonzero(first)
            tree[rows[has], size + prev[has]] = self.pair_values(token[rows[has], prev[has]], new[has], prev[has])
            for node, row in ((size + at, rows), (size + gone, rows), (size + prev[has], rows[has])):
                while len(node) and node[0] > 1:
                    node = node >> 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            rows = rows[tree[rows, 1] < NEVER]
        kept = token[:, :size].astype("<u4")[stands].tobytes()
        ends = np.cumsum(stands.sum(1)) * 4
        return [kept[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_one(self, token: list[int]) -> list[int]:
        """The same for one long pre-token, with plain lists."""
        n, ranks, never = len(token), self.rank_of, int(NEVER)
        size = 1 << (n - 1).bit_length()
        shift = max(POSITION, n.bit_length())
        leaf = lambda i, j: ranks[k] << shift | i if j < n and (k := token[i] << 20 | token[j]) in ranks else never
        tree = [never] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = leaf(i, i + 1)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        following, before = list(range(1, n + 1)), list(range(-1, n))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                if tree[i] == (low := min(tree[2 * i], tree[2 * i + 1])):
                    break
                tree[i] = low

        stands = [True] * n
        while (root := tree[1]) < never:
            at = root & ((1 << shift) - 1)
            gone = following[at]
            after = following[gone]
            token[at] = int(self.merged[root >> shift])
            following[at], before[after], stands[gone] = after, at, False
            put(at, leaf(at, after))
            put(gone, never)
            if (prev := before[at]) >= 0:
                put(prev, leaf(prev, at))
        return [t for t, s in zip(token, stands, strict=True) if s]

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        of = self.bytes_of
        return b"".join([of.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """A worker's encoder for a vocabulary file, read once."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def vocabulary() -> str:
    """Where the vocabulary file lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | Callable[[], str], with_ids: bool = False) -> DataFrame:
    """Encode each text and decode it again, row by row, without a shuffle.

    docs needs doc_id and text; other columns are left out. Null text is empty: no token, and the digest
    of nothing. Every row gives one row, repeated rows and null doc_id included; an empty table gives none.
    path must be readable on every executor; a function is called there and gives it. Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with
    with_ids also ids (array of int).
    """

    def run(doc_id, text):
        bpe = loaded(path() if callable(path) else path)
        coded = bpe.encode(text)
        out = [doc_id, [len(c) // 4 for c in coded], [hashlib.sha256(c).hexdigest() for c in coded], [hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in coded]]
        return [*out, [np.frombuffer(c, "<u4").astype(np.int32) for c in coded]] if with_ids else out

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(columns, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary)
