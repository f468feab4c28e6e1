"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's chance of being toxic is logistic in the weights of its
words and their beginnings; a document's is the noisy-or of its sentences. The weights are trained from
document labels alone, and then point at the sentences that offend.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, carrying, map_rows, table

#: Labelled documents that the weights are trained on at most: toxic ones and clean ones, chosen by a hash of doc_id.
MOST_TOXIC, MOST_CLEAN = 2000, 3000
#: Bytes of a word's beginnings that are features beside the word itself.
PREFIXES = range(3, 9)
#: A feature must stand in so many toxic documents of the sample, and so many times as often as in clean ones.
LEAST_TOXIC, LEAST_RATIO = 2, 3.0
#: Sentences end at these bytes.
END = b"\x01"
SENTENCES = bytes(1 if b in b".!?\n" else FOLD[b] for b in range(256))
#: Logit of a sentence without any feature, at most.
LEAST_BIAS = -9.0


class Model(NamedTuple):
    weights: dict[bytes, float]
    bias: float


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, with END after each sentence."""
    return text.encode().translate(SENTENCES).replace(END, b" \x01 ").split() if text else []


def features(word: bytes) -> list[bytes]:
    return [b"=" + word, *(word[:k] for k in PREFIXES if k <= len(word))]


def sentences(text: str | None) -> list[set[bytes]]:
    out, now = [], set()
    for w in tokens(text):
        if w == END:
            if now:
                out.append(now)
                now = set()
        else:
            now.add(w)
    return [*out, now] if now else out


class Bags(NamedTuple):
    """Documents as sentences of distinct words, in flat arrays: training holds each word's bytes once."""

    words: list[bytes]
    word: np.ndarray
    sentence: np.ndarray
    doc_of: np.ndarray


def gather(texts: Iterable[str | None]) -> Bags:
    """word and sentence: one entry for each distinct word of each sentence. doc_of: the document of each sentence."""
    number: dict[bytes, int] = {}
    word, sizes, doc_of = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for s in sentences(text):
            word.extend([number.setdefault(w, len(number)) for w in s])
            sizes.append(len(s))
            doc_of.append(d)
    sizes = np.array(sizes, np.int32)
    return Bags(list(number), np.array(word, np.int32), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.array(doc_of, np.int32))


class Lists(NamedTuple):
    """Lists of numbers, end to end."""

    values: np.ndarray
    ends: np.ndarray

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the lists asked for, and how many each has."""
        ends = self.ends[which]
        n = ends - np.where(which > 0, self.ends[which - 1], 0)
        first = ends - n
        return self.values[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def features_of(words: list[bytes]) -> tuple[list[bytes], Lists]:
    """All features, and those of each word."""
    number: dict[bytes, int] = {}
    values, sizes = array("i"), array("i")
    for w in words:
        own = [number.setdefault(f, len(number)) for f in features(w)]
        values.extend(own)
        sizes.append(len(own))
    return list(number), Lists(np.array(values, np.int32), np.cumsum(np.array(sizes, np.int64)))


def choose(bags: Bags, names: list[bytes], of_word: Lists, labels: list[int]) -> np.ndarray:
    """Numbers of the features that stand much oftener in toxic documents, the most telling first."""
    df = np.zeros((2, len(names)), np.int64)
    edges = np.searchsorted(bags.doc_of[bags.sentence], np.arange(len(labels) + 1))
    for toxic, lo, hi in zip(labels, edges[:-1], edges[1:], strict=True):
        df[toxic, np.unique(of_word.take(np.unique(bags.word[lo:hi]))[0])] += 1
    n_toxic = sum(labels)
    ratio = (df[1] + 0.5) / (n_toxic + 1) / ((df[0] + 0.5) / (len(labels) - n_toxic + 1))
    good = np.flatnonzero((df[1] >= LEAST_TOXIC) & (ratio >= LEAST_RATIO)).tolist()
    good.sort(key=lambda f: (-df[1, f] * math.log(ratio[f]), names[f]))
    return np.array(good, np.int64)


def train(rows: Iterable[tuple[str | None, int]], rounds: int = 300, rate: float = 0.3, l1: float = 2e-4) -> Model:
    """Fit weights, none below zero, by proximal gradient steps on the documents' log loss."""
    labels: list[int] = []

    def texts() -> Iterator[str | None]:
        for text, toxic in rows:
            labels.append(int(toxic))
            yield text

    bags = gather(texts())
    if not any(labels):
        return Model({}, LEAST_BIAS)
    names, of_word = features_of(bags.words)
    picked = choose(bags, names, of_word, labels)
    chosen = [names[f] for f in picked]
    place = np.full(len(names), -1, np.int64)
    place[picked] = np.arange(len(picked))
    del names
    # the chosen features of each sentence, once each
    telling = np.flatnonzero(np.add.reduceat(np.append(place[of_word.values] >= 0, False), np.append(0, of_word.ends[:-1]))) if bags.words else np.zeros(0, np.int64)
    held = np.isin(bags.word, telling)
    own, n = of_word.take(bags.word[held])
    pairs = np.repeat(bags.sentence[held], n).astype(np.int64) * max(1, len(chosen)) + place[own]
    pairs = np.unique(pairs[place[own] >= 0])
    sent, feat = pairs // max(1, len(chosen)), pairs % max(1, len(chosen))
    spoken, sent = np.unique(sent, return_inverse=True)
    doc_of = bags.doc_of[spoken]
    silent = (np.bincount(bags.doc_of, minlength=len(labels)) - np.bincount(doc_of, minlength=len(labels))).astype(float)
    del bags, of_word, pairs, own, place
    y = np.array(labels, float)
    theta, bias = np.zeros(len(chosen)), -5.0
    square, square_b = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(sent, theta[feat], len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + math.exp(-bias))
        log_clean = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)) + silent * math.log1p(-p0)
        clean = np.exp(log_clean)
        # d loss / d log_clean: 1 - y / P, since P = 1 - clean
        pull = -(1 - y) + y * clean / np.maximum(1 - clean, 1e-9)
        g_z = -pull[doc_of] * p  # d log_clean / d z = -p
        g = np.bincount(feat, g_z[sent], len(chosen)) / len(y)
        g_b = (g_z.sum() + (-pull * silent).sum() * p0) / len(y)
        square += g * g
        square_b += g_b * g_b
        step = rate / np.sqrt(square)
        theta = np.maximum(0.0, theta - step * (g + l1))
        bias = min(LEAST_BIAS / 2, max(2 * LEAST_BIAS, bias - rate * g_b / math.sqrt(square_b)))
    return Model({f: round(float(t), 9) for f, t in zip(chosen, theta, strict=True) if t > 1e-6}, min(float(bias), LEAST_BIAS / 2))


def labelled(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Iterator[tuple[str | None, int]]:
    """The bounded training sample: rows whose crc32(doc_id as text) mod 5 is not 0, toxic ones and clean ones, one at a time. A doc_id with several texts trains with the least of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.filter("toxic = 1").orderBy(*order).limit(most_toxic).union(known.filter("toxic = 0").orderBy(*order).limit(most_clean))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").select("text", "toxic")
    return ((r.text, r.toxic) for r in rows.toLocalIterator())


def score_tokens(words: list[bytes], of_word: dict[bytes, float], model: Model) -> tuple[float, list[tuple[int, float]]]:
    """Noisy-or of the sentences, and the sentences with a chance of a half or more."""
    weights = model.weights
    hits: dict[int, dict[bytes, None]] = {}
    sentence, begun, n = 0, False, 0
    for w in words:
        if w == END:
            n += begun
            begun = False
            sentence += 1
            continue
        begun = True
        v = of_word.get(w)
        if v is None:
            v = of_word[w] = any(f in weights for f in features(w))
        if v:
            hits.setdefault(sentence, {})[w] = None
    n += begun
    clean = (n - len(hits)) * math.log1p(-1 / (1 + math.exp(-model.bias)))
    offending = []
    for s, own in hits.items():
        z = model.bias + sum(weights[f] for f in sorted({f for w in own for f in features(w)}) if f in weights)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        clean += math.log1p(-min(p, 1 - 1e-9))
        if p >= 0.5:
            offending.append((s, p))
    return 1 - math.exp(clean), offending


#: Words that a worker remembers.
KNOWN = 1_000_000


def score_documents(docs: DataFrame, model: Model, carry: bool = False) -> DataFrame:
    """Toxicity of each text under a trained model, row by row, without a shuffle.

    docs needs doc_id and text; with carry all columns come along in the struct carried_row, else other
    columns are left out. Null and empty texts score 0. Every row gives one row, repeated rows included; a
    null doc_id is never held out. Returns doc_id, held_out, score, predicted, offending (array of structs
    sentence, score: sentences from 0, split at . ! ? and newline, whose own chance is a half or more).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    of_word: dict[bytes, float] = {}

    def run(doc_id, held_out, text):
        if len(of_word) > KNOWN:
            of_word.clear()
        scores, offending = [], []
        for t in text:
            s, o = score_tokens(tokens(t), of_word, shared.value)
            scores.append(s)
            offending.append([{"sentence": k, "score": p} for k, p in o])
        return [doc_id, held_out, scores, [int(s >= 0.5) for s in scores], offending]

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text", *carrying(docs, carry))
    return map_rows(columns, run, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<sentence:int,score:double>>")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(labelled(docs, table(spark, sf_dir, "labels"))))
