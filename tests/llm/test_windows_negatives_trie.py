"""Brute-force versions and edge cases of substring dedup, hard negatives and the prefix trie."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoblend.llm import negatives, substrings, trie

WORDS = "the river stone light under green house walks slowly over many fields where birds sing about rain".split()
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


# --- substring dedup -------------------------------------------------------------------------------------------------


def plain_left(texts, window):
    """(n_words, n_removed, kept text) of each text by counting every window."""
    words = [SPACE.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((len(w), len(w) - len(kept), " ".join(kept)))
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    shared = [prose(rng, n) for n in (10, 35, 36, 60, 200)]
    texts = [" ".join([prose(rng, rng.randint(0, 60)), rng.choice(shared), prose(rng, rng.randint(0, 60))]) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " more", prose(rng, 34), prose(rng, 35), None, "", " \n\t ", "a " * 300, "b a " * 100, "a\nb\tc " * 40 + "x", shared[4] + " " + shared[4], "é\x1cö\xa0ü " * 50]
    texts += [prose(rng, 40) + " " + shared[3] + f" end{i}" for i in range(40)]
    return texts


@pytest.mark.parametrize("window,mer,hot", [(35, 8, 2000), (35, 8, 3), (5, 8, 10), (35, 1, 2000), (1, 1, 2000)])
def test_windows_against_all(spark, passages, monkeypatch, window, mer, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(passages)], "doc_id long, text string, digest string, m int").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substrings.drop_repeated_windows(df, window, mer).collect()}
    assert [got[i] for i in range(len(passages))] == plain_left(passages, window)


def test_strings_sent_in_parts(spark, passages, monkeypatch):
    df = spark.createDataFrame(list(enumerate(passages)), "doc_id long, text string").repartition(2)
    want = sorted(map(str, substrings.drop_repeated_windows(df).collect()))
    for name in ("HELD", "REPEAT_LIMIT", "EDIT_LIMIT"):
        monkeypatch.setattr(substrings, name, 0)
    assert sorted(map(str, substrings.drop_repeated_windows(df).collect())) == want


def test_super_mers_cover_windows_once(monkeypatch):
    rng = random.Random(8)
    words = [w.encode() for w in prose(rng, 700).split()]
    first, count, mins = substrings.super_mers(words, 35, 8)
    assert count.sum() == len(words) - 34 and (first == np.cumsum(count) - count).all() and len(mins) < len(words) / 5
    monkeypatch.setattr(substrings, "STRETCH", 50)  # minimisers do not depend on where stretches end, runs may be cut there
    again = substrings.super_mers(words, 35, 8)
    assert (np.repeat(mins, count) == np.repeat(again[2], again[1])).all()


def test_substring_edge_cases(spark):
    schema = "doc_id long, text string"
    assert substrings.drop_repeated_windows(spark.createDataFrame([], schema)).collect() == []
    text = prose(random.Random(2), 40)
    rows = [(None, text), (7, text), (7, "short"), (7, None), (8, prose(random.Random(3), 30_000)), (9, "x" * 200_000)]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.drop_repeated_windows(spark.createDataFrame(rows, schema)).collect())
    assert got == {(None, 40, 40): 1, (7, 40, 40): 1, (7, 1, 0): 1, (7, 0, 0): 1, (8, 30_000, 0): 1, (9, 1, 0): 1}


# --- hard negatives --------------------------------------------------------------------------------------------------


def plain_negatives(rows, every=50):
    out, base = [], []
    for k, (i, vec, label) in enumerate(rows):
        if label is not None and vec is not None and all(x is not None and np.isfinite(x) for x in vec):
            label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
            base.append((k, i, label, [int(np.floor(256 * float(x))) for x in vec]))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for k, i, label, a in base:
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, c)), j, other == label) for m, j, other, c in base if m != k]
        for p, j, _ in sorted((s for s in scored if s[2]), key=order)[:5]:
            fits = sorted((s for s in scored if not s[2] and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:3]
            out += [(i, j, r, q, p, n) for r, (n, q, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(df, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in negatives.hard_negatives(df, label, **options).collect()), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, block long, payload binary"


@pytest.mark.parametrize("limits", [{}, {"ROWS": 16, "ANCHORS": 4, "MERGED": 2, "CELL": 2}])
def test_negatives_against_all_pairs(spark, monkeypatch, limits):
    for name, v in limits.items():
        monkeypatch.setattr(negatives, name, v)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(420):
        v = centres[rng.integers(12)] + 0.15 * rng.normal(size=8) if i % 3 else rng.normal(size=8)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 10)) if i % 2 else 3))
    rows += [(500 + i, rows[i][1], rows[i][2]) for i in range(60)]  # equal vectors, ties by id
    rows += [(1000, None, 1), (1050, rows[0][1], None), (1100, [None] * 8, 1), (1150, [float("nan")] * 8, 1), (1200, [float("inf")] + [0.0] * 7, 1), (None, rows[7][1], 3), (1250, [0.0] * 8, 2)]
    rows += [(350, rows[350][1], rows[350][2])]  # a twin of an anchor
    df = spark.createDataFrame([(*r, 1, None) for r in rows], VECTORS).repartition(5)
    assert mined(df, every=10) == plain_negatives(rows, every=10)


def test_bounds_save_scores_on_clusters(spark, monkeypatch):
    """Anchors in tight clusters: most candidates are settled by their parent's score."""
    monkeypatch.setattr(negatives, "ROWS", 128)
    rng = np.random.default_rng(4)
    centres = 3 * rng.normal(size=(4, 16))
    rows = [(i, [float(x) for x in centres[i % 4] + 0.01 * rng.normal(size=16)], i % 4) for i in range(1200)]
    df = spark.createDataFrame([(*r, 1, None) for r in rows], VECTORS)
    blocks = negatives.row_blocks(negatives.integer_rows(df, 256.0, "embedding", "vec_id", F.col("label")))
    trees = negatives.anchor_blocks(blocks, 10)
    first = negatives.cell_lists(trees, blocks, 5, True, negatives._all_scores)
    known = trees.join(negatives.merged_lists(first, negatives.cell_groups(blocks), 5), "a_block").select("a_block", "payload", "lists").mapInArrow(negatives._with_positives, "a_block int, payload binary")
    second = negatives.cell_lists(known, blocks, 3, False, negatives._windows(50, 95))
    computed = second.agg(F.sum("computed")).first()[0]
    assert 0 < computed < 0.5 * 120 * 900, computed


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, size=(40, 3))
    order, parent, edge = negatives.spanning_tree(x)
    at = {int(j): k for k, j in enumerate(order)}
    assert sorted(order) == list(range(40)) and all(parent[j] < 0 or at[int(parent[j])] < at[j] for j in range(40))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    inside, total = {0}, 0.0
    while len(inside) < 40:
        w, j = min((d[i, j], j) for i in inside for j in range(40) if j not in inside)
        inside.add(j)
        total += w
    assert edge.sum() == pytest.approx(total)


def test_negatives_edge_cases(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == []
    assert mined(spark.createDataFrame([(0, [1.0, 2.0], 1, 1, None)], VECTORS)) == []
    assert mined(spark.createDataFrame([(1, [1.0, 2.0], 1, 1, None), (2, [1.0], 1, 1, None)], VECTORS)) == []
    rows = [(50, [1e6, 1.0], 1), (1, [1e6], 1), (2, [6e5, 0.0, 5.0], 2), (100, [], 1), (3, [-1e6, 2.0], 1), (4, [0.0, 0.0], 2)]  # large, of several lengths, empty
    df = spark.createDataFrame([(*r, 1, None) for r in rows], VECTORS)
    pad = [(i, v + [0.0] * (3 - len(v)), label) for i, v, label in rows]
    assert mined(df) == plain_negatives(pad) != []


# --- prefix trie -----------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda k: k[:3])] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + x[h:])
    nodes = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            nodes.setdefault(x[:d], []).append(c)
    out = []
    for node, members in nodes.items():
        below = [m for m in nodes if m[: len(node)] == node]
        leaf = lambda m: not any(len(q) == len(m) + 1 and q[: len(m)] == m for q in nodes)
        saved = sum((len(nodes[m]) - 1) * len(SPACE.findall(m[-1][1])) for m in below if m)
        ends = ",".join(str(c) for c in sorted(c for c in members if built[c] == node))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(m) == len(node) + 1 for m in below), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(df, **options):
    heads = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)).cast("int")
    turns = trie.rebuilt_turns(trie.turn_rows(df), lambda c: c - c % 20, heads, 3)
    return sorted((tuple(r) for r in trie.prefix_trie(turns, **options).collect()), key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string, hi long, depth string"


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(6)
    say = ["ok", "yes  please", "no", "a b c", "", None, "tell me\tmore\n now"]
    rows = []
    for c in [*range(60), *range(-45, -35), 10**15, 10**15 + 1, 2**61]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, t if rng.random() < 0.97 or t else None, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(say[:3]) if rng.random() < 0.7 else rng.choice(say)))
    rows += [(c, t, "user", "hot") for c in range(1000, 1040) for t in range(4)]  # one conversation many times
    rows += [(77, t, "user", f"turn {t} of a long one") for t in range(300)] + [(None, 1, "user", "nobody")]
    return rows


@pytest.mark.parametrize("options", [{}, {"limit": 4, "growth": 3}, {"limit": 1, "growth": 2}])
def test_trie_against_all_prefixes(spark, talks, monkeypatch, options):
    monkeypatch.setattr(trie, "SHARD_ROWS", 40)
    monkeypatch.setattr(trie, "CHUNK", 3)
    df = spark.createDataFrame([(*r, 1, "clash") for r in talks], CONVERSATIONS).repartition(4)
    assert trie_of(df, **options) == plain_trie(talks)


def test_node_table():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        hi, lo = rng.integers(-(2**62), 2**62, n), rng.integers(-(2**62), 2**62, n)
        table = trie.NodeTable(hi, lo)
        assert sorted(table.slot) == list(range(n)) and (table.find(hi, lo) == table.slot).all()
        assert (table.find(hi + 1, lo) == -1).all()


def test_trie_edge_cases(spark):
    assert trie_of(spark.createDataFrame([], CONVERSATIONS)) == []
    rows = [(1, 0, "user", "x " * 50_000), (1, 0, "user", "x " * 50_000), (2, None, None, None)]
    assert trie_of(spark.createDataFrame([(*r, 1, "clash") for r in rows], CONVERSATIONS)) == plain_trie(rows)
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4][0]  # no family head: nothing is left of its turn
    assert trie_of(spark.createDataFrame([(turnless, 0, "user", "gone", 1, "clash")], CONVERSATIONS)) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
