"""Operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import time
from collections import Counter
from re import _parser as parser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import anchors, bpe, chat, decontaminate, html, licenses, quality, similarity, substrings, suffixarray, suffixes, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, ord string, found string, g int, words string, kept string"


def folded(t):
    return FOLDED.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def texts():
    rng = np.random.default_rng(5)
    vocab = [f"w{k}" for k in range(40)] + ["É", "the", "of"]
    prose = lambda n: " ".join(rng.choice(vocab, n))
    shared = prose(60)
    out = [None, "", "  \n\t", "one", "a b c d", shared, shared, prose(30) + " " + shared + "\n" + prose(20), shared + " " + prose(200), "ab " * 400, "x" * 1500, "é" * 700, prose(4000)]
    return out + [prose(int(n)) for n in rng.integers(1, 120, 25)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "o", "f", 2, "w", "k") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    own = list(enumerate(texts()))
    return [*own, own[7], (None, own[5][1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


def results(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality_counts(spark, rows, docs):
    def brute(t):
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)

    got = results(quality.judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert quality.judge_quality(table(spark, [])).count() == 0


def brute_distance(p, q):
    half = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt(max(0, (half(p, q) + half(q, p)) / 2))


def brute_quality(text, lang):
    """js_chars, js_words and whether they reject, by plain loops."""
    words = WORD.findall(text)
    if len(words) < quality.LEAST_WORDS or len(text) < quality.LEAST_CHARS or lang not in quality.COMMON:
        return None, None, False
    shares = quality.shares_of(quality.COMMON[lang])
    bare = Counter(w.strip(quality.AROUND).lower() for w in words)
    own = [bare[w] / len(words) for w in shares]
    reference = [*shares.values(), 1 - sum(shares.values())]
    kinds = Counter("s" if c in " \t\n\v\f\r" else "y" if c in "#*$%&|<>" else "b" if c > "\x7f" else "U" if "A" <= c <= "Z" else "9" if c in "0123456789" else "." if c in ".,;:!?'\"()-" else "v" if c in "aeiou" else "o" for c in text)
    by_words, by_chars = brute_distance([*own, 1 - sum(own)], reference), brute_distance([kinds[k] / len(text) for k in "sybU9.vo"], quality.CHARS[lang])
    none = brute_distance([0] * len(own) + [1], reference)
    return round(by_chars, 6), round(by_words, 6), by_chars > quality.MOST_CHARS or by_words > quality.MOST_WORDS * none


def test_quality_verdict(spark):
    rng = np.random.default_rng(6)

    def prose(lang, n=150, share=0.35):
        known = quality.shares_of(quality.COMMON[lang])
        common = rng.choice(list(known), n, p=np.array(list(known.values())) / sum(known.values()))
        odd = ["".join(rng.choice(list("aeiobcdfgklmnrstuv"), 6)) for _ in range(n)]
        return " ".join((c if rng.random() < share else o) + "." * (k % 9 == 0) for k, (c, o) in enumerate(zip(common, odd)))

    rows = [(k, prose(lang), lang) for k, lang in enumerate(["en", "fr", "de", "es"] * 5)]
    bad = [(200, prose("de"), "en"), (201, prose("en", share=0), "en"), (202, " ".join(str(x) for x in rng.integers(10**5, 10**6, 150)), "es"), (203, prose("fr") + " $%&" * 300, "fr")]
    free = [(300, prose("de"), None), (301, prose("en", share=0), "xx"), (302, prose("en", 49, 0), "en"), (303, "é " * 60 + prose("en", 12), "en"), (304, None, "en"), (305, "", "fr"), (305, "", "fr"), (None, prose("es"), "es"), (306, prose("en", 30000), "en")]
    every = [*rows, *bad, *free]
    got = quality.judge_quality(spark.createDataFrame(every, "doc_id long, text string, lang string").withColumn("js_words", F.lit("clash")).withColumn("kept", F.lit(1))).collect()
    assert len(got) == len(every)
    for (i, text, lang), r in zip(sorted(every, key=lambda x: (x[0] is None, x[0])), sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), strict=True):
        by_chars, by_words, rejected = brute_quality(text or "", lang)
        assert (r.js_chars is None, r.js_words is None) == (by_chars is None, by_words is None), i
        assert by_chars is None or abs(r.js_chars - by_chars) < 2e-6 and abs(r.js_words - by_words) < 2e-6, (i, r, by_chars, by_words)
        assert r.kept == (not r.base_failed and not rejected), i
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 100)
    assert sorted(r.doc_id for r in got if r.doc_id in range(200, 300) and not r.kept) == [200, 201, 202, 203]


def test_substrings(spark, rows, docs):
    where = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            where[k] = min(where.get(k, 1 << 62), 1 << 61 if i is None else i)
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {p + k for p in range(len(w) - 12) if where[tuple(w[p : p + 13])] < (1 << 61 if i is None else i) for k in range(13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert results(substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")) == sorted(want, key=repr)
    assert results(substrings.remove_repeats(docs, shard_bytes=1).select("doc_id", "n_removed")) == sorted(((a, c) for a, _, c, _ in want), key=repr)
    assert substrings.remove_repeats(table(spark, [])).count() == 0


def brute_kept(text, flags):
    """Runs of flagged units as from-to, and the units left."""
    edges = [p for p in range(len(flags) + 1) if (p < len(flags) and flags[p]) != (p > 0 and flags[p - 1])]
    return list(zip(edges[::2], edges[1::2], strict=True)), [x for x, g in zip(text, flags, strict=True) if not g]


def test_kept_texts_and_spans(spark, rows, docs):
    """The texts that op2 and op8 leave, and the places that they take out."""
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[p : p + 60] for b in raw for p in range(len(b) - 59))
    want = []
    for (i, _), b in zip(rows, raw, strict=True):
        flags = [any(count[b[q : q + 60]] > 1 for q in range(max(0, p - 59), min(p, len(b) - 60) + 1)) for p in range(len(b))]
        spans, left = brute_kept(b, flags)
        pieces = [b[x:y].decode("utf-8", "ignore") for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)], strict=True)]
        assert bytes(left) == b"".join(b[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)], strict=True))
        want.append((i, spans, "".join(pieces)))
    got = suffixarray.remove_long_repeats(docs, window=60, reported=60, gram=16).collect()
    assert sorted(((r.doc_id, [(x["from"], x["to"]) for x in r.spans], r.kept) for r in got), key=repr) == sorted(want, key=repr)
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, 1 << 62), 1 << 61 if i is None else i)
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        mine = 1 << 61 if i is None else i
        flags = [any(first[tuple(w[q : q + 13])] < mine for q in range(max(0, p - 12), min(p, len(w) - 13) + 1)) for p in range(len(w))]
        spans, left = brute_kept(w, flags)
        want.append((i, ",".join(f"{a}-{b}" for a, b in spans), " ".join(left)))
    assert results(substrings.remove_repeats(docs).select("doc_id", "spans", "kept")) == sorted(want, key=repr)


def brute_bytes(rows, k):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[p : p + k] for b in raw for p in range(len(b) - k + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - k + 1):
            if count[b[p : p + k]] > 1:
                gone[p : p + k] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_array(spark, rows, docs):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    unique = [(i, t) for i, t in rows if i is not None][:-1]
    assert results(suffixarray.remove_long_repeats(docs).select(columns)) == brute_bytes(rows, 400)
    assert results(suffixarray.remove_long_repeats(table(spark, unique), window=60, reported=60, gram=16, shard_bytes=500).select(columns)) == brute_bytes(unique, 60)
    assert suffixarray.remove_long_repeats(table(spark, [])).count() == 0


def test_decontamination(spark, rows, docs):
    items = [(3, "w1"), (10, " ".join(folded(rows[7][1])[10:40])), (2, rows[7][1][:60]), (2, rows[7][1][:60]), (5, None), (6, "..."), (7, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in rows:
        w, hit, of = folded(t), set(), set()
        for item, text in items:
            x = folded(text)
            k = min(13, len(x))
            for p in range(len(x) - k + 1) if x else ():
                for q in range(len(w) - k + 1):
                    if w[q : q + k] == x[p : p + k]:
                        hit |= set(range(q, q + k))
                        of.add(str(item))
        want.append((i, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for block in (1 << 20, 40):
        assert results(decontaminate.find_contamination(docs, bench, block_bytes=block).select(columns)) == sorted(want, key=repr)
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_similarity(spark, rows, docs):
    sets = [frozenset(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if (w := folded(t)) else None for _, t in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    near = {a: [b for b in distinct if b != a and 5 * len(a & b) >= 4 * len(a | b)] for a in distinct}

    def reach(s):
        seen, todo = {s}, [s]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    want = []
    for (i, _), s in zip(rows, sets, strict=True):
        group = reach(s) if s else None
        ids = [j for (j, _), x in zip(rows, sets, strict=True) if x in group and j is not None] if s else []
        want.append((i, min(ids) if ids else i, len(near[s]) if s else 0, sets.count(s) if s else 1))
    for block, large in ((512, 256), (2, 2), (8, 1)):
        assert results(similarity.join_similar(docs, block, large)) == sorted(want, key=repr)
    assert similarity.keep_one(docs).columns == docs.columns
    assert similarity.join_similar(table(spark, [])).count() == 0


def test_connected_long_chains(spark):
    n, rng = 1200, np.random.default_rng(3)
    down = [0, *range(n - 1, 0, -1)]  # a smaller label enters a tree at the end far from its root
    teeth = [x for k in range(0, n, 100) for x in (k, *range(k + 99, k, -1))]
    for order in (down, teeth, [*teeth[::-1]], rng.permutation(n).tolist()):
        edges = [(a, b) for a, b in zip(order, order[1:])] + [(n + a, n + b) for a, b in zip(order[:300], order[1:300])]
        got = {r.node: r.label for r in similarity.connected(spark.createDataFrame(edges, "a long, b long"), "chain").collect()}
        assert got == {**dict.fromkeys(range(n), 0), **{n + x: n + min(order[:300]) for x in order[:300]}}
    with pytest.raises(RuntimeError):
        similarity.connected(spark.createDataFrame(edges, "a long, b long"), "chain", rounds=2)


def test_similarity_long_chain(spark):
    n, words = 1050, np.random.default_rng(4).integers(0, 1 << 40, 8 * 1050 + 104)
    place = {i: p for p, i in enumerate([0, *range(n - 1, 0, -1)])}
    docs = table(spark, [(i, " ".join(f"w{w}" for w in words[8 * p : 8 * p + 104])) for i, p in place.items()])  # neighbours share 92 of 108 shingles
    got = results(similarity.join_similar(docs, 32))
    assert got == sorted(((i, 0, 2 - (place[i] in (0, n - 1)), 1) for i in range(n)), key=repr)
    assert [r.doc_id for r in similarity.keep_one(docs, 32).collect()] == [0]


def test_similarity_of_a_template(spark):
    """More texts share a band than LARGE, and their family has several blocks of sets of different size: links and classes as by comparing all pairs."""
    rng = np.random.default_rng(23)
    base = [f"t{k}" for k in range(260)]
    texts = []
    for k in range(700):
        n = int(rng.choice([90, 110, 140, 200, 260]))
        words = base[:n]
        for at in rng.integers(0, n, int(rng.integers(0, 5))):
            words[at] = f"x{k}"
        texts.append(" ".join(words))
    sets = [frozenset(zip(*(w[i:] for i in range(5)))) for w in map(str.split, texts)]
    first = {}
    vertices = [first.setdefault(s, k) for k, s in enumerate(sets)]
    own = sorted(set(vertices))
    number = {w: i for i, w in enumerate({x for s in sets for x in s})}
    held = np.zeros((len(own), len(number)), np.float32)
    for r, v in enumerate(own):
        held[r, [number[x] for x in sets[v]]] = 1
    common, sizes = held @ held.T, held.sum(1)
    link = 5 * common >= 4 * (sizes[:, None] + sizes[None] - common)
    np.fill_diagonal(link, False)
    root = np.arange(len(own))
    while (low := np.minimum(root, np.where(link, root[None], len(own)).min(1))).tolist() != root.tolist():
        root = low
    row = {v: r for r, v in enumerate(own)}
    want = sorted((k, own[root[row[v]]], int(link[row[v]].sum()), vertices.count(v)) for k, v in enumerate(vertices))
    docs = table(spark, list(enumerate(texts)))
    assert max(Counter(k for t in texts for k in set(similarity.band_keys(similarity.min_hashes(similarity.shingles(t.encode()))).tolist())).values()) > similarity.LARGE
    for block in (similarity.BLOCK, 40):
        assert results(similarity.join_similar(docs, block)) == sorted(want, key=repr)
    # blocks of levels that are two or more apart don't meet
    levels = spark.createDataFrame([(1, k, size) for k in (3, 4, 5, 9) for size in range(200)], "label long, level long, size int")
    met = {r.level: {x >> 32 for x in r.others} for r in similarity.blocks_of(levels, 64).collect()}
    assert met == {3: {3, 4}, 4: {3, 4, 5}, 5: {4, 5}, 9: {9}}


@pytest.fixture(scope="module")
def encoder():
    return bpe.Bpe(bpe.vocabulary()), Tokenizer.from_file(bpe.vocabulary())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("ab<|endoftext>' \n", max_size=60))
def test_bpe_like_the_library(encoder, text):
    mine, library = encoder
    ids = library.encode(text, add_special_tokens=False).ids
    coded = mine.encode([text])[0]
    assert np.frombuffer(coded, "<u4").tolist() == ids
    assert mine.decode(coded) == library.decode(ids, skip_special_tokens=False)


def test_bpe_long(encoder, docs, rows):
    mine, library = encoder
    for text in ("x" * 3000, "the" * 500, " " * 900):
        assert np.frombuffer(mine.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert results(bpe.encode_documents(docs, bpe.vocabulary)) == sorted(want, key=repr)
    assert bpe.encode_documents(docs.limit(0), bpe.vocabulary()).count() == 0


def test_licenses(spark):
    rows = [(1, "x Under the MIT License. y under the mit license"), (2, None), (3, ""), (4, "CC BY-NC 4.0 and Apache License, Version 2.0"), (5, "GNU General Public License, version 3"), (1, "x")]
    got = {(r.doc_id, r.n_words): (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan_licenses(table(spark, rows)).collect()}
    assert got[1, 10] == (2, 1, 6, "mit", "mit")
    assert got[2, 0] == got[3, 0] == (0, None, None, "", "")
    assert got[4, 11] == (2, 0, 6, "apache-2,cc-by-nc", "apache-2,cc-by-nc,cc-by-nc-4.0")
    assert got[5, 6][3:] == ("", "gpl-3")
    assert len(licenses.rules()) > 300


def samples(parsed):
    """Texts that a parsed pattern matches, each alternative and each optional part with and without."""
    out = [""]
    for op, arg in parsed:
        if op is parser.LITERAL:
            more = [chr(arg)]
        elif op is parser.IN:
            more = [chr(v) for _, v in arg]
        elif op is parser.ANY:
            more = ["x"]
        elif op is parser.SUBPATTERN:
            more = samples(arg[3])
        elif op is parser.BRANCH:
            more = [x for branch in arg[1] for x in samples(branch)]
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            more = [*([""] if arg[0] == 0 else []), *samples(arg[2])]
        else:
            assert op is parser.ASSERT_NOT
            more = [""]
        out = [a + b for a in out for b in more]
    return out


def test_licenses_gate():
    for rule in licenses.rules():
        for text in samples(parser.parse(rule.pattern.pattern)):
            if rule.pattern.fullmatch(text):  # "(" and ")" never stand in words
                assert licenses.rules().index(rule) in licenses.tried(text), (text, rule)
    for text in ("an mit style license", "zlib style licence", "2 clause bsd style license", "spdx license identifier expat"):
        assert licenses.detect(text.encode().split()), text


def test_html(spark):
    page = '<body><nav>Menu a b</nav><div id=main><h1>T &amp; x</h1><p>One, two.<p>Three\n <b>fo</b>ur.<br>Five.<div class="comments"><p>Nice post, I say.</div></div><footer>End</footer>'
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "<script>var a='<p>'</script>")], "page_id long, url string, html string")
    assert results(html.extract_pages(rows)) == [(1, "u", "T & x One, two. Three four. Five.", 33), (2, None, "", 0), (3, "u", "", 0)]


def test_html_keeps_content_beside():
    p = "One sentence, and some more words here; then an end. " * 4
    whole = [
        f"<div class=content><h1>Title</h1><div class=text><p>{p}<p>{p}<p>{p}</div></div>", f"<div class=wrap><div class=first><p>{p * 3}</div><div class=second><p>{p}</div></div>",
        f"<div><p>Intro, this is {p}</p><ul>{f'<li>{p}' * 8}</ul></div>", f"<main><article><p>{p * 3}</article><section><h2>More</h2><p>{p}</section></main>",
    ]
    for page in whole:
        assert html.main_text(f"<body><nav>Menu a b</nav>{page}<footer>End</footer>") == " ".join(re.sub("<[^>]*>", " ", page).split())
    assert html.main_text(f"<body><div><p class=lead>{p * 9}</p><p>Short</p></div>").endswith("Short")


def test_perspectives(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 70, "ann", "bye"), (2, 0, "system", "alone"), (3, None, None, "x"), (3, None, None, "x")]
    got = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    view = sorted((r for r in got if r.conv_id == 1 and r.perspective == "ann"), key=lambda r: r.position)
    whole = "".join(r.segment for r in view)
    assert whole == "<|system|>\nS\n<|assistant|>\nhi\n<|user bob|>\n\n<|assistant|>\nbye\n"
    assert [whole[r.mask_start : r.mask_end] for r in view if r.mask_start is not None] == ["hi", "bye"]
    assert all(whole[r.char_start : r.char_end] == r.segment for r in view)
    assert sorted(Counter(r.conv_id for r in got).items()) == [(1, 8), (3, 2)]
    wide = spark.createDataFrame([(None, 1, "ann", "hi", "x", 1), (None, 1, "bob", "", "x", 1)], "conv_id long, turn long, role string, text string, segment string, block int")
    got = chat.rotate_perspectives(wide).collect()
    assert len(got) == 4 and all(r.conv_id is None and r.segment.startswith("<|") for r in got)
    assert chat.rotate_perspectives(wide.limit(0)).count() == 0


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(toxicity.labelled(docs, labels))
    held = toxicity.score_documents(docs, model).filter("held_out").join(labels, "doc_id").collect()
    caught = sum(r.predicted == r.toxic == 1 for r in held)
    assert caught >= 0.85 * sum(r.toxic for r in held) and caught >= 0.85 * sum(r.predicted for r in held)
    assert all(r.offending for r in held if r.score > 0.9)
    odd = {r.doc_id: r.score for r in toxicity.score_documents(table(spark, [(1, None), (2, ""), (None, "x")]), model).collect()}
    assert odd[1] == odd[2] == 0.0 and 0 <= odd[None] < 0.5
    assert toxicity.train([]).weights == {}


def test_licenses_base_places(spark):
    rng = np.random.default_rng(8)
    parts = ["under the", "mit", "license", "apache", "version 2", "cc", "by", "nc", "under", "the", "Version", "2", "x-y"]
    rows = [(i, " ".join(rng.choice(parts, int(rng.integers(0, 60))))) for i in range(60)] + [(None, "cc by nc cc by nc"), (1, None), (2, "")]
    want = []
    for i, t in rows:
        w = folded(t)
        at = [(p, label) for phrase, label in licenses.BASE.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        places = sorted(p for p, _ in at)
        want.append((i, len(w), len(at), *((places[0], places[-1]) if at else (None, None)), ",".join(sorted({label for _, label in at}))))
    got = licenses.scan_licenses(table(spark, rows))
    assert results(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(want, key=repr)
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got.collect() if r.base_labels)
    assert licenses.scan_licenses(table(spark, [])).count() == 0


def test_licenses_phrases():
    labels = lambda t: {f.label for f in licenses.detect(folded_bytes(t))}
    assert labels("licensed under the BSD license") == labels("BSD license") == {"bsd"}
    assert labels("Artistic-2.0, Artistic 2") == {"artistic-2.0"}
    assert labels("apache 2 helicopters") == labels("gpl 3 days later") == labels("we permit discussion") == set()
    assert labels("licensed under GPL 3") == labels("GPLv3") == labels("gpl 3 licensed") == {"gpl-3"}
    assert labels("released under the 3-clause BSD license") == {"bsd-3-clause"}
    assert len(licenses.detect(folded_bytes("under the mit license and gpl v3 or later ") * 8000)) == 16000


def folded_bytes(t):
    return [w.encode() for w in folded(t)]


PARAGRAPH = "One sentence, and some more words here; then an end. "


def test_html_paths_decide(monkeypatch):
    menu = "".join(f"<div><a href=/{k}>Item {k}</a></div>" for k in range(12))
    page = f"<body><div>{menu}</div><div><h1>Title</h1>{f'<p>{PARAGRAPH * 4}' * 6}<div>kept between</div>{f'<p>{PARAGRAPH * 4}' * 3}</div>{'<section>Small print</section>' * 9}"
    found = html.main_text(page)
    assert found.startswith("Title One sentence") and "kept between" in found and "Item" not in found and "Small print" not in found
    monkeypatch.setattr(html, "content_scores", lambda elements, blocks: [0.0 if elements[b.element].outside else 1.0 for b in blocks])
    assert "Item 3" in html.main_text(page)  # without the ratios the menu, which no mark tells, stays


def test_html_marks():
    assert html.main_text('<p>Hello. <span class="ad">x</span> The rest.</p>') == "Hello. The rest."
    assert html.main_text('See <a class="share">this</a> and more text') == "See and more text"
    body = f'<h2 id="legal">Legal</h2><p id="search">{PARAGRAPH}</p><section id="related-work"><p>{PARAGRAPH}</p></section>'
    assert html.main_text(f'<article>{body}<div id="comments"><p>{PARAGRAPH}</div></article>') == " ".join(re.sub("<[^>]*>", " ", body).split())
    assert html.main_text("<p>1 < 2, a <b and more.</p><p>Next, one.</p>").startswith("1 < 2, a")


def test_html_ratios():
    """Ratios by plain sums over a page without marks: text and punctuation of a path's nodes, without the text of links."""
    page = f"<div><p>{PARAGRAPH}</p><p>Ab, c <a>link</a></p></div><ul><li>x<li><a>yz</a></ul>"
    elements, blocks = html.parse(page)
    paths = ["div/p", "div/p", "ul/li", "ul/li"]
    texts, marks = [len(PARAGRAPH) - 1, 6, 1, 0], [3, 1, 0, 0]
    ratio = lambda values, k: sum(v for v, p in zip(values, paths, strict=True) if p == paths[k]) / paths.count(paths[k])

    def smooth(values, k):
        weights = {j: math.exp(-((j - k) ** 2) / 2) for j in range(max(0, k - 2), min(4, k + 3))}
        return sum(w * values[j] for j, w in weights.items()) / sum(weights.values())

    want = [math.sqrt(smooth([ratio(texts, j) for j in range(4)], k) * (1 + smooth([ratio(marks, j) for j in range(4)], k))) for k in range(4)]
    assert [b.text for b in blocks] == [PARAGRAPH.strip(), "Ab, c link", "x", "yz"]
    assert html.content_scores(elements, blocks) == pytest.approx(want)


def test_html_odd_pages(spark):
    for page in ("<a " * 330_000, '<a "' * 250_000, "<x>" * 50_000 + "</y>" * 50_000, "<!--" * 250_000, "<script>" * 100_000):
        began = time.time()
        html.main_text(page)
        assert time.time() - began < 20
    rows = spark.createDataFrame([(1, "u", f"<p>{PARAGRAPH}", "x"), (1, "u", f"<p>{PARAGRAPH}", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert [r.n_chars for r in html.extract_pages(rows).orderBy("page_id").collect()] == [0, len(PARAGRAPH) - 1, len(PARAGRAPH) - 1]
    assert html.extract_pages(rows.limit(0)).count() == 0


def test_many_benchmark_blocks(spark, docs):
    items = [(k, " ".join(f"n{k}x{j}" for j in range(15))) for k in range(198)] + [(500, "w1"), (None, "w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    plan = decontaminate.find_contamination(docs, bench, block_bytes=1)
    assert plan._jdf.queryExecution().toString().count("MapInArrow") <= 8  # one step in each form of the plan
    assert results(plan) == results(decontaminate.find_contamination(docs, bench))


def test_documents_meet_few_blocks(spark, monkeypatch):
    """With many blocks, each automaton is built once, and only documents that may hold one of its windows run through it, those of a hot block in parts."""
    rng = np.random.default_rng(21)
    prose = lambda n: " ".join(f"v{k}" for k in rng.integers(0, 5000, n))
    items = [(k, prose(40)) for k in range(120)] + [(200, "only these four words"), (None, prose(20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [prose(300) for _ in range(300)]
    for k in range(0, 120):  # a third of the documents hold one item, others one each
        texts[k] += " " + items[7][1] + " " + prose(5)
        texts[k + 120] += " " + items[k][1][:90] + " " + prose(5)
    texts[299] = "Only THESE four, words!"
    docs = spark.createDataFrame([*enumerate(texts), (5, texts[5]), (None, texts[6]), (None, None)], "doc_id long, text string")
    met, real = [], decontaminate.match_blocks
    sizes = lambda rows: [r["count"] for r in rows.filter("uid is not null").groupBy("block", "part").count().collect()]
    monkeypatch.setattr(decontaminate, "match_blocks", lambda rows, window: met.extend(sizes(rows)) or real(rows, window))
    monkeypatch.setattr(decontaminate.routed, "__defaults__", (20, 1 << 27))
    got = results(decontaminate.find_contamination(docs, bench, block_bytes=1000))
    assert got == results(decontaminate.find_contamination(docs, bench))
    assert 240 <= sum(met) <= 250 and max(met) <= 40


def test_offending_sentences():
    calm = ["the river runs past the old mill", "we met at noon and walked home", "rain fell on the quiet town"]
    rows = [(". ".join(calm[(k + j) % 3] + f" {k * 7 % 11}" for j in range(3)) + (". you are a vile grumbol" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    model = toxicity.train(rows)
    score, offending = toxicity.score_tokens(toxicity.tokens("The river runs. What a vile grumbol! Rain fell."), {}, model)
    assert score >= 0.5 and [s for s, _ in offending] == [1]
    assert toxicity.score_tokens(toxicity.tokens("The river runs. Rain fell."), {}, model)[0] < 0.5


def test_frequent_and_hot_anchors(spark, monkeypatch):
    """A passage that a third of the texts hold, with frequent grams demoted and with every anchor hot."""
    rng = np.random.default_rng(11)
    prose = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 3000, n))
    passage, near = prose(30), prose(200)
    own = [(i, prose(60) + (" " + passage if i % 3 == 0 else "") + " " + prose(60) + (" " + near[i:] if i % 5 == 0 else "") + (" in" * 300 if i % 7 == 0 else "")) for i in range(60)]
    for name, value in (("SAMPLE", 1.0), ("LEAST_FREQUENT", 5)):
        monkeypatch.setattr(anchors, name, value)
    docs = table(spark, own)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for k in (60, 200):
        assert results(suffixarray.remove_long_repeats(docs, window=k, reported=60, gram=16, shard_bytes=2000, hot=2).select(columns)) == brute_bytes(own, k)
    assert [r.n_shared for r in suffixarray.remove_long_repeats(docs, window=200, reported=60, gram=16, hot=3).orderBy("doc_id").collect()] == [r[2] for r in sorted(brute_bytes(own, 60))]
    assert results(substrings.remove_repeats(docs, hot=2)) == results(substrings.remove_repeats(docs))


def test_hot_anchors_in_texts_that_repeat_themselves(spark, monkeypatch):
    """Each different content of a text is asked for once, not once for each of its places; all places are found."""
    asked, keys = [], anchors.run_keys
    monkeypatch.setattr(anchors, "run_keys", lambda *a: asked.append(keys(*a)) or asked[-1])
    again = [" ".join(x) for x in (["wa"] * 150, ["wb", "wc", "wd"] * 50)]
    own = [(i, f"head{i} {again[i % 2]} mid{i} {again[i // 2 % 2]} tail{i}") for i in range(12)]
    docs = table(spark, own)
    cut = suffixarray.remove_long_repeats(docs, window=50, words=True, hot=2)
    assert results(cut.select("doc_id", "kept", "n_shared")) == results(spark.createDataFrame([(i, f"head{i}  mid{i}  tail{i}", 300) for i, _ in own]), "_1")
    cut = suffixarray.remove_long_repeats(docs, window=60, reported=60, gram=16, hot=2)
    assert results(cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute_bytes(own, 60)
    assert results(substrings.remove_repeats(docs, hot=2)) == results(substrings.remove_repeats(docs))
    for rows in [asked[0].collect(), asked[1].collect(), asked[2].collect()]:
        assert len(rows) == len({(r.uid, bytes(r.key)) for r in rows}) <= 60 * len(own)


def common_length(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_document_listing():
    """The smallest owner of each interval, whatever the sampling of owners."""
    rng = np.random.default_rng(17)
    for sampled in (1, 3, 8):
        for _ in range(40):
            contents = [rng.integers(0, 3, int(rng.integers(1, 30))) for _ in range(int(rng.integers(1, 6)))]
            text, begins = suffixes.join_contents(np.concatenate(contents), sizes := np.array([len(c) for c in contents]))
            owners = rng.integers(0, 9, len(contents))
            index = suffixes.FmIndex(text, np.repeat(owners, sizes + 1), sampled)
            ends = np.concatenate([b + np.arange(1, n + 1) for b, n in zip(begins, sizes, strict=True)])
            length, lo, hi = index.stream(text, ends, 3)
            strings = [tuple(text[e - 3 : e]) for e in ends.tolist()]
            found = np.flatnonzero(length == 3)
            holds = lambda k, s: any(tuple(text[p : p + 3]) == s for p in range(begins[k], begins[k] + sizes[k] - 2))  # noqa: B023, E731
            want = [min(o for k, o in enumerate(owners.tolist()) if holds(k, strings[i])) for i in found.tolist()]
            assert index.smallest_owner(lo[found], hi[found]).tolist() == want
            assert len(index.owner) == sum(-(-(n + 1) // sampled) for n in sizes.tolist())


def some_contents(rng, case):
    contents = [rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(1, 14))).astype(np.uint8) for _ in range(int(rng.integers(1, 5)))]
    return contents + contents[:1] * (case % 3 == 0)


def test_matching_statistics():
    rng = np.random.default_rng(12)
    for case in range(300):
        contents = some_contents(rng, case)
        places = [(c, p) for c in contents for p in range(len(c))]
        want = [max((common_length(c[p:], d[q:]) for j, (d, q) in enumerate(places) if j != i), default=0) for i, (c, p) in enumerate(places)]
        sizes = np.array([len(c) for c in contents])
        text, begins = suffixes.join_contents(np.concatenate(contents), sizes)
        got = suffixes.RunLengthIndex(text).matching_statistics(begins, sizes)
        assert got[text > 0].tolist() == want and not got[text == 0].any()


def test_matching_statistics_of_other_texts():
    """Texts that aren't in the index, with symbols that it doesn't know."""
    rng = np.random.default_rng(13)
    for case in range(300):
        contents = some_contents(rng, case)
        text, begins = suffixes.join_contents(np.concatenate(contents), np.array([len(c) for c in contents]))
        inside = [text[b : b + len(c)] for b, c in zip(begins, contents, strict=True)]
        pattern = rng.integers(1, int(text.max()) + 2, int(rng.integers(1, 20))).astype(text.dtype)
        want = [max(common_length(pattern[i:], c[p:]) for c in inside for p in range(len(c))) for i in range(len(pattern))]
        assert suffixes.RunLengthIndex(text, foreign=True).stream(pattern).tolist() == want


def test_run_length_index_shrinks_with_its_runs():
    rng = np.random.default_rng(15)
    base = rng.integers(1, 27, 20_000).astype(np.uint8)
    sizes = {}
    for copies in (1, 4, 16):
        texts = []
        for _ in range(copies):
            other = base.copy()
            other[rng.integers(0, len(base), 20)] = 1
            texts += [other, np.zeros(1, np.uint8)]
        index = suffixes.RunLengthIndex(text := np.concatenate(texts))
        sizes[copies] = index.bytes / len(text)
    assert sizes[1] <= 16 and sizes[16] < sizes[4] / 2 < sizes[1] / 4


def test_search_of_a_shard():
    """Strings of two lengths in contents of which only the first places are starts, some standing several times."""
    rng = np.random.default_rng(16)
    for _ in range(150):
        reported = int(rng.integers(2, 5))
        window = reported + int(rng.integers(0, 4))
        long = b"".join(rng.choice([b"a", b"b"], 60).tolist())
        contents = list({long[(k := int(rng.integers(0, 40))) : k + window + int(rng.integers(0, 9))] for _ in range(5)})
        windows = np.array([len(c) - window + 1 for c in contents])
        count = rng.integers(1, 3, len(contents))
        for least, kind in ((window, suffixarray.REMOVED), (reported, suffixarray.SHARED)):
            seen = Counter(c[p : p + least] for c, n, m in zip(contents, windows.tolist(), count.tolist(), strict=True) for p in range(n) for _ in range(m))
            want = [[seen[c[p : p + least]] > 1 for p in range(n)] for c, n in zip(contents, windows.tolist(), strict=True)]
            got = [[any(a <= p < b for a, b, x in zip(*f, strict=True) if x == kind) for p in range(n)] for f, n in zip(suffixarray.search_contents(contents, windows, count, window, reported), windows.tolist(), strict=True)]
            assert got == want


def test_suffixes_of_a_large_shard():
    """From 2^21 symbols on three positions don't fit into one number."""
    rng = np.random.default_rng(18)
    again = rng.integers(1, 27, 100_000)
    text = np.concatenate([x for _ in range(11) for x in (rng.integers(1, 27, 100_000), again, [0])]).astype(np.uint8)
    order = suffixes.sort_suffixes(text, suffixes.ends_of(text))
    rank = np.empty(len(text) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(text)), -1
    a, b = order[:-1], order[1:]
    assert len(text) > 1 << 21 and (np.sort(order) == np.arange(len(text))).all()
    assert ((text[a] < text[b]) | (text[a] == text[b]) & np.where(text[a] == 0, a < b, rank[a + 1] < rank[b + 1])).all()


def test_a_passage_in_many_different_texts(spark):
    """What stands around it differs, so that the strings at its edges are one anchor's and more than 2 MB."""
    rng = np.random.default_rng(19)
    prose = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage = prose(420)
    own = [(i, prose(60) + passage + prose(60)) for i in range(6000)]
    got = suffixarray.remove_long_repeats(table(spark, own), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert results(got) == brute_bytes(own, 400)


def test_chance_bands_make_no_families(spark, monkeypatch):
    """Neighbours in a chain of similarity 0.25: some share a band by chance, which alone would draw them into families."""
    words = np.random.default_rng(14).integers(0, 1 << 40, 60 * 200 + 104)
    docs = table(spark, [(i, " ".join(f"w{w}" for w in words[60 * i : 60 * i + 104])) for i in range(200)])
    seen, real = {}, similarity.connected
    monkeypatch.setattr(similarity, "met", lambda keys, met=similarity.met: seen.setdefault("met", met(keys)) if "met" not in seen else met(keys))
    monkeypatch.setattr(similarity, "connected", lambda edges, name: seen.__setitem__(name, edges.count()) or real(edges, name))
    assert {(r.class_id == r.doc_id, r.n_links) for r in similarity.join_similar(docs).collect()} == {(True, 0)}
    assert seen["met"].count() > 0 and seen["families"] == 0
