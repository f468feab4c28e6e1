"""The pipeline's stages against plain Python, with nulls, empty tables, repeated rows and every own column name clashing."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from brindle.llm import bpe, toxicity

#: Names that stages use for columns of their own.
CLASHING = ["predicted", "score", "offending", "held_out", "kept", "spans", "found", "copy", "ord", "uid", "carried_row", "key", "label", "first", "items", "n_bytes", "n_shared", "contaminated", "n_words", "runs", "digest", "band", "hub", "own_text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    prose = lambda n: " ".join(f"{rng.choice(list('bcdfgm'))}{x}" for x in rng.integers(0, 10**6, n))
    passage, item = prose(60), prose(20)
    base = prose(120)
    rows = [(i, prose(int(rng.integers(30, 90)))) for i in range(40)]
    rows += [(100 + k, f"{prose(30)} {passage} {prose(30)}") for k in range(4)]  # a passage in several
    rows += [(200, base), (201, base), (202, base + " one more"), (202, base), (203, base.replace(base.split()[40], "other"))]
    rows += [(300 + k, f"{prose(20)} {item} {prose(20)}") for k in range(2)]
    rows += [(400 + k, f"{prose(20)}. You vile grumbol {k}. {prose(20)}") for k in range(60)]
    rows += [(500, None), (501, ""), (501, ""), (None, prose(40)), (None, None), (502, "x")]
    root = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, int(t is not None and "grumbol" in t)) for i, t in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([("i1", item), ("i2", None), ("i3", "nowhere to be found")], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows


def drop_near(rows):
    """The first row, by id, of each class of equal or similar texts; texts without words stay."""
    sets = [frozenset(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if (w := words(t)) else None for _, t in rows]
    kept, seen = [], set()
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        if sets[k] is None:
            kept.append(rows[k])
        elif k not in seen:
            todo = [k]
            seen.add(k)
            while todo:
                a = todo.pop()
                for b in range(len(rows)):
                    if b not in seen and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                        seen.add(b)
                        todo.append(b)
            kept.append(rows[k])
    return kept


def cut_repeats(rows, k):
    """Texts without runs of k words that stand elsewhere too, from their first character to their last."""
    places = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for _, t in rows]
    strings = [[tuple(t[a:b] for a, b in p[q : q + k]) for q in range(len(p) - k + 1)] for (_, t), p in zip(rows, places, strict=True)]
    count = {}
    for s in strings:
        for x in s:
            count[x] = count.get(x, 0) + 1
    out = []
    for (i, t), p, s in zip(rows, places, strings, strict=True):
        gone = sorted({q + j for q, x in enumerate(s) if count[x] > 1 for j in range(k)})
        text, at = "", 0
        for n, q in enumerate(gone):
            if n == 0 or gone[n - 1] != q - 1:
                text += t[at : p[q][0]]
            at = p[q][1]
        out.append((i, text + (t or "")[at:]))
    return out


def contaminated(t, item):
    w, x = words(t), words(item)
    hit = {p + j for p in range(len(w) - 12) for q in range(len(x) - 12) if w[p : p + 13] == x[q : q + 13] for j in range(13)}
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_run_like_plain_python(spark, tables):
    root, rows = tables
    docs = pipeline.table(spark, root, "documents")
    model = toxicity.train(toxicity.labelled(docs, pipeline.table(spark, root, "labels")))
    want = [(i, t) for i, t in rows if toxicity.score_tokens(toxicity.tokens(t), {}, model)[0] < 0.5]
    assert not any("grumbol" in (t or "") for _, t in want) and len(want) == len(rows) - 60
    stages = dict(pipeline.STAGES)
    item = spark.read.parquet(f"{root}/benchmark.parquet").filter("item_id = 'i1'").first().text
    steps = [("toxicity", want), ("near_copies", want := drop_near(want)), ("long_repeats", want := cut_repeats(want, pipeline.LONG_REPEAT)), ("decontamination", want := [(i, t) for i, t in want if not contaminated(t, item)])]
    for name, expected in steps:
        docs = stages[name](spark, docs, root)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        assert rows_of(docs) == sorted(expected, key=repr), name
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    encoded = stages["bpe"](spark, docs, root).collect()
    library = Tokenizer.from_file(bpe.vocabulary())
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in want]
    assert sorted(((r.doc_id, list(r.ids)) for r in encoded), key=repr) == sorted(((i, x) for (i, _), x in zip(want, ids, strict=True)), key=repr)
    last = sorted(((r.doc_id, r.n_tokens) for r in encoded), key=repr)
    assert last == sorted(((r.doc_id, r.n_tokens) for r in pipeline.run(spark, root).collect()), key=repr)
    assert [i for i, _ in last] == [i for i, _ in sorted(((i, t) for i, t in want), key=repr)]


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES[:-1]])
def test_clashing_columns_and_empty_tables(spark, tables, name):
    root, _ = tables
    docs = pipeline.table(spark, root, "documents")
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    stage = dict(pipeline.STAGES)[name]
    found = stage(spark, wide, root)
    assert found.columns == wide.columns
    assert rows_of(found) == rows_of(stage(spark, docs, root))
    assert all(r.doc_id is None or all(r[c] == f"{c}{r.doc_id}" for c in CLASHING) for r in found.collect())
    assert stage(spark, docs.limit(0), root).count() == 0
