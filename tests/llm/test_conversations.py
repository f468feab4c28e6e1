"""The conversation operators and exact search against brute force."""

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import chat, repair, topk, trie

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators use inside.
SCHEMA = "conv_id long, turn long, role string, text string, p long, d long, c1 string, block int, kind string, size long, salt int, audit string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c", 3, "k", 4, 5, "a") for r in rows], SCHEMA).repartition(3)


def digest(role, text):
    h = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 8], "big", signed=True) for i in (0, 8))


def in_order(rows, null=""):
    """Turns of each conversation, as (turn, role, text)."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        r, x = null if r is None else r, null if x is None else x
        by[c].append((t, r, x))
    for turns in by.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), digest(t[1], t[2])))
    return by


def brute_trie(rows):
    own = {c: [(r, x) for _, r, x in t] for c, t in in_order([r for r in rows if r[0] is not None]).items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    out = []

    def visit(s):
        words = len(PLAIN.findall(s[-1][1])) if s else 0
        leaves, saved = 0 if children[s] else 1, (len(members[s]) - 1) * words
        for c in children[s]:
            a, b = visit(c)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in members[s] if len(built[c]) == len(s))
        out.append((members[s][0], len(s), members[s[:-1]][0] if s else None, len(members[s]), len(children[s]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if built:
        visit(())
    return sorted(out, key=repr)


def dialogues(seed, n, most=7):
    """Dialogues of few different turns, so that they share beginnings; with nulls, ties, repeated rows and odd numbers."""
    rng = np.random.default_rng(seed)
    texts = ["Hi.", "go on", "What is it?", "", None, "  ", "a b c d", "Well, yes!"]
    rows = []
    for _ in range(n):
        c = int(rng.choice([*range(130), -7, -20, -33, 10**12, 10**12 + 5]))
        for k in range(int(rng.integers(0, most))):
            role = rng.choice(["user", "assistant", "system", None, "tool", ""], p=[0.4, 0.4, 0.1, 0.03, 0.04, 0.03])
            rows.append((c, None if rng.random() < 0.05 else int(k + (rng.random() < 0.05)), role, rng.choice(texts, p=[0.5, 0.2, *[0.05] * 6])))
    return [*rows, *rows[:3], (None, 1, "user", "Hi."), (5, 3, None, None), (40, 0, "user", "word " * 3000), *[(41, k, "user", f"{k} long.") for k in range(60)], *[(61, k, "user", f"{k} long.") for k in range(50)]]


@pytest.mark.parametrize(("block", "short", "spacing"), [(4096, 4096, 16), (3, 2, 3)])
def test_trie(spark, monkeypatch, block, short, spacing):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = dialogues(3, 150)
    got = trie.prefix_trie(conversations(spark, rows), short=short, spacing=spacing)
    nodes = got.collect()
    assert sorted((tuple(r)[:8] for r in nodes), key=repr) == brute_trie(rows)
    # arcs nest, and each has a place of its own
    assert sorted(x for r in nodes for x in (r.enter_at, r.exit_at)) == list(range(2 * len(nodes)))
    within = {(r.enter_at, r.exit_at): r for r in nodes}
    for (a, b), r in within.items():
        inside = [x for x in nodes if a <= x.enter_at and x.exit_at <= b]
        assert len(inside) == (b - a + 1) // 2 and r.n_leaves == sum(x.n_children == 0 for x in inside)


def test_trie_of_little(spark):
    assert trie.prefix_trie(conversations(spark, [])).count() == 0
    assert trie.prefix_trie(conversations(spark, [(None, 1, "user", "a")])).count() == 0
    # 23 takes over turns of 20, which isn't there; its own first ones go, so that nothing is left
    h = zlib.crc32(b"23") % 4
    got = trie.prefix_trie(conversations(spark, [(23, k, "user", "a") for k in range(h or 1)])).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_leaves) for r in got if r.depth == 0] == [(23, 0, None, 1)]


def test_trie_of_copies(spark):
    """Most conversations are the same, and many branch off one node."""
    rows = [(c, k, "user", f"{k}") for c in range(1, 400) for k in range(4)] + [(c, 4, "user", f"x{c}") for c in range(200, 400)]
    got = sorted((tuple(r)[:8] for r in trie.prefix_trie(conversations(spark, rows), short=16).collect()), key=repr)
    assert got == brute_trie(rows)


def brute_repair(turns):
    """Facts and all cheapest scripts of one conversation's turns in order."""
    last = [re.sub(r"[\x20\x09-\x0D]+\Z", "", x)[-1:] for _, _, x in turns]
    faults = ["blank" if not e else "duplicate" if turns[i][1:] in [t[1:] for t in turns[:i]] else "truncated" if e not in ".!?" else "" for i, e in enumerate(last)]
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    grammar = re.compile(r"(s?(ua)+)?")
    heap, n, best, found = [(0, 0, "", "", ())], 1, None, []
    while heap:
        cost, _, audit, roles, out = heapq.heappop(heap)
        if best is not None and cost > best:
            break
        i = sum(e != "I" for e in audit)
        if i == len(turns) and grammar.fullmatch(roles):
            best = cost
            found.append((audit, out))
        if not re.fullmatch(r"(s?(ua)*u?)?", roles):
            continue
        nexts = [(3, "I", r, (r, "")) for r in ("user", "assistant")]
        if i < len(turns):
            _, role, text = turns[i]
            nexts.append((4, "D", "", None))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                nexts += [(extra, "K", role or "?", (role, text)), *((3 + extra, "R", r, (r, text)) for r in ("user", "assistant"))]
        for price, e, role, row in nexts:
            heapq.heappush(heap, (cost + price, n, audit + e, roles + role[:1], (*out, row) if row else out))
            n += 1
    audit, out = min(found)
    assert len({o for a, o in found if a == audit}) == 1
    kept = "\n".join(f"{r}:{x}" for r, x in out)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best, audit, hashlib.sha256(kept.encode()).hexdigest()), out


def test_repair(spark):
    rows = [r for r in dialogues(9, 120, 5) if r[0] not in (41, 61)]
    by = in_order(rows, " ")
    expected = {c: brute_repair(t) for c, t in by.items() if len(t) <= 6}
    some = [r for r in rows if r[0] in expected]
    ids = spark.createDataFrame([(c,) for c in [*expected, 777]], "conv_id long")
    got = sorted(map(tuple, repair.repair_conversations(conversations(spark, some), ids).collect()), key=repr)
    nothing = (777, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == sorted([(c, *e[0]) for c, e in expected.items()] + [nothing], key=repr)
    texts = defaultdict(list)
    for r in repair.repair_conversations(conversations(spark, some), with_rows=True).orderBy("conv_id", "position").collect():
        assert r.position == len(texts[r.conv_id])
        texts[r.conv_id].append((r.role, r.text))
    assert {c: tuple(t) for c, t in texts.items()} == {c: e[1] for c, e in expected.items() if e[1]}
    assert repair.repair_conversations(conversations(spark, [])).count() == 0


def test_repair_of_long_conversation(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(3000)] + [(2, 0, "system", "Be brief."), *((2, k, "user", f"{k}.") for k in range(1, 1000))]
    got = {r.conv_id: r for r in repair.repair_conversations(conversations(spark, rows)).collect()}
    assert got[1].cost == 0 and got[1].audit == "K" * 3000
    assert got[2].cost == 3 * 499 + 3 and got[2].illegal == 998 and len(got[2].audit) == 1001


def test_automaton_shares_rests():
    """Each distinct rest of signatures is worked out once, whatever their number."""
    made = []
    plain = repair.node_before
    rng = np.random.default_rng(1)
    signatures = sorted({"".join(rng.choice(list("uasUAd"), int(n)))[::-1] for n in rng.integers(0, 9, 500)})
    try:
        repair.node_before = lambda letter, rest: made.append(letter) or plain(letter, rest)
        found = list(repair.audits(iter(signatures)))
    finally:
        repair.node_before = plain
    assert len(made) == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})
    assert [s[::-1] for s, _, _ in found] == signatures


def test_damage(spark):
    rows = [(c, t, "system", "A. b! c?") for c in (0, 1, None) for t in [*range(200), None]]
    expected = []
    for c, t, role, text in rows:
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if what:
            expected += [(c, t, "user" if what == 4 else role, {1: "", 2: "A b c"}.get(what, text))] * (2 if what == 3 else 1)
    assert sorted(map(tuple, repair.damaged(conversations(spark, rows)).collect()), key=repr) == sorted(expected, key=repr)


def brute_top(rows, every, k):
    whole = lambda x: np.clip(np.floor(64 * np.array(x, np.float64)), -(1 << 24), 1 << 24).astype(object)
    good = [(i, c, whole(e)) for i, (c, e) in enumerate(rows) if e is not None and None not in e and np.isfinite(np.array(e, np.float64)).all()]
    out = []
    for i, q, a in good:
        if q is not None and q % every == 0:
            scores = [(-sum(x * y for x, y in zip(a, b)), c is None, c or 0, j) for j, c, b in good if j != i]
            out += [(q, n, None if none else c, int(-s)) for n, (s, none, c, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(c, e, 1, "v", 2) for c, e in rows], "vec_id long, embedding array<float>, label int, vector string, cid int").repartition(3)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.normal(0, 0.3, 6)).tolist()) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 400)] + [(i, [0.0] * 6) for i in range(400, 420)]  # copies; all scores equal
    rows += [(500, None), (501, []), (520, [1.0, None]), (503, [float("nan")]), (504, [float("inf"), 1.0]), (None, rows[5][1]), (505, [0.5, 0.25]), (540, [2.0] * 9), (506, [1e30, -1e30]), (5, rows[7][1]), (20, rows[20][1])]
    for options in ({}, {"bits": 2, "queries": 4, "candidates": 32, "first": 2}):
        got = sorted((tuple(r) for r in topk.search_top_k(vectors(spark, rows), "vec_id % 20 = 0", k=7, **options).collect()), key=repr)
        assert got == brute_top(rows, 20, 7)
    assert topk.search_top_k(vectors(spark, []), "vec_id % 20 = 0").count() == 0
    assert topk.search_top_k(vectors(spark, [(0, [1.0])]), "vec_id % 20 = 0").count() == 0
    assert topk.search_top_k(vectors(spark, [(0, []), (1, [])]), "vec_id % 20 = 0").collect()[0].score == 0


def test_cells_hold_their_vectors():
    rng = np.random.default_rng(4)
    v = rng.integers(-60, 60, (500, 5)).astype("<i4")
    cells = topk.Cells(v[:50], v.min(axis=0).astype(np.int64), v.max(axis=0).astype(np.int64), 3)
    packed = cells.encode(v)
    low, high = cells.ends(packed)
    assert packed.shape == (500, 2) and (low <= v).all() and (v <= high).all()
    a, b = cells.bounds(v[:20], packed)
    exact = v[:20].astype(np.int64) @ v.astype(np.int64).T
    assert (a <= exact).all() and (exact <= b).all() and (b - a).mean() < 2 * np.abs(exact).max()


@pytest.mark.parametrize("block", [3, chat.BLOCK])
def test_long_dialogues_from_every_side(spark, block):
    """A long dialogue, and one turn number repeated far beyond a block, by plain loops."""
    rng = np.random.default_rng(6)
    rows = [(1, k, str(rng.choice(["user", "assistant", "tool"])), f"{k} {'x' * int(rng.integers(0, 9))}") for k in range(700)]
    rows += [(2, 5, str(rng.choice(["user", "assistant"])), f"{k % 40}") for k in range(200)] + [(3, 0, "system", "alone"), (4, None, None, None), (4, 1, "user", "é")]
    want = []
    for c, turns in in_order(rows).items():
        spoken = [(t, r or "unknown", x) for t, r, x in turns]
        spoken.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        for view in {r for _, r, _ in spoken} - {"system"}:
            at = 0
            for n, (t, r, x) in enumerate(spoken):
                role = "system" if r == "system" else "assistant" if r == view else "user"
                head = f"<|{role} {r}|>\n" if role == "user" else f"<|{role}|>\n"
                mask = (at + len(head), at + len(head) + len(x)) if role == "assistant" else (None, None)
                want.append((c, view, t, n, r, role, r if role == "user" else None, f"{head}{x}\n", at, at + len(head) + len(x) + 1, *mask))
                at += len(head) + len(x) + 1
    got = chat.rotate_perspectives(conversations(spark, rows), block).select("conv_id", "perspective", "turn", "position", "speaker", "role", "name", "segment", "char_start", "char_end", "mask_start", "mask_end")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
