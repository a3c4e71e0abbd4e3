"""Brute-force versions and edge cases of the corpus operators."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoblend.llm import chat, exact, langid, licenses, linededup, mixing, packing, quality, rules, simhash
from geoblend.llm.common import materialize
from geoblend.llm.queries import CONTROL_TEXT, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, fp long, t string, size int, words string"
WORDS = "the river stone light under green house walks slowly over many fields where birds sing about rain and old roads lead home again".split()
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    out += [out[0], out[0], out[1], None, "", "", "   ", "ÄÖÜ ß Éa", out[5] + " extra", " ".join(out[6].split()[1:]), prose(rng, 3000), "a b c a b c a b c", "x\n\nx\ny z\nx"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["b", "a", "Z", None]), 1, "clash", 5, "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int, toxic int")


# --- exact dedup -----------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 2**40), max_size=60))
@settings(max_examples=50, deadline=None)
def test_golomb_round_trip(values):
    gaps = np.array(values, dtype=np.uint64)
    k, unary, rest = exact.golomb_encode(gaps)
    assert len(unary) < 10_000_000
    assert (exact.golomb_decode(len(gaps), k, unary, rest) == gaps).all()


def test_exact_groups(spark, docs, texts):
    got = {r["doc_id"]: r for r in exact.exact_groups(docs).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(g), len(g), i == max(g))
        assert r["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())


@pytest.mark.parametrize("limits", [{"FAMILY": 2}, {"GROUP_LIMIT": 0, "HOT_GROUP": 1, "FAMILY": 3}, {"GROUP_LIMIT": 0, "SUSPECT_LIMIT": 0}])
def test_exact_groups_beyond_the_limits(spark, docs, monkeypatch, limits):
    want = sorted(map(str, exact.exact_groups(docs).collect()))
    for name, v in limits.items():
        monkeypatch.setattr(exact, name, v)
    assert sorted(map(str, exact.exact_groups(docs).collect())) == want


def test_exact_edge_cases(spark, empty):
    assert exact.exact_groups(empty).collect() == []
    same = spark.createDataFrame([(None, "q"), (None, "q"), (7, "q"), (7, "q"), (3, "z")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1), r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(same).collect())
    assert got == [(-1, 7, 4, False), (-1, 7, 4, False), (3, 3, 1, True), (7, 7, 4, False), (7, 7, 4, True)]


def test_exact_keeps_one_row_of_each_text(spark):
    rows = [(None, "a b c", "s")] * 4 + [(9, "q", "s")] * 2 + [(9, "other", "s"), (1, "a b c d", "t"), (None, "alone", "t"), (4, None, "s"), (4, "", "t")]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, source string, row long, digest string").repartition(3)
    groups = exact.exact_groups(df).collect()
    kept = Counter(r["text_sha256"] for r in groups if r["kept"])
    assert len(groups) == len(rows) and set(kept.values()) == {1} and len(kept) == len({t or "" for _, t, _ in rows})
    left = exact.drop_exact_copies(df)
    assert left.columns == df.columns and sorted(r["text"] or "" for r in left.collect()) == sorted({t or "" for _, t, _ in rows})
    near = simhash.drop_near_copies(df)
    assert near.columns == df.columns and max(Counter((r["doc_id"], r["text"]) for r in near.collect()).values()) == 1


# --- SimHash ---------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = SPACE.findall(low)
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_components(docs, texts):
    got = {r["doc_id"]: r for r in simhash.near_components(docs).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert all(got[i]["fingerprint"] == f"{fp:016x}" for i, fp in enumerate(fps))
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = classes(range(len(fps)), near)
    assert {i: r["component_id"] for i, r in got.items()} == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("radius,segments,block", [(4, 3, 4096), (4, 2, 4096), (3, 4, 4096), (4, 3, 8)])
def test_links_keep_all_components(spark, monkeypatch, radius, segments, block):
    """Clusters around few centres; a small block makes every entry hot."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(radius * 10 + segments)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << b
            values.add(v)
    values |= {rng.getrandbits(64) for _ in range(60)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, segments)
    got = [(r["a"], r["b"]) for r in links.collect()]
    mask = (1 << 64) - 1
    want = [(a, b) for a in signed for b in signed if a > b and ((a ^ b) & mask).bit_count() <= radius]
    assert classes(signed, got) == classes(signed, want)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert {v: roots.get(v, v) for v in signed} == classes(signed, want)


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 300)] + [(500, 500)]
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(1, 101)) and all(roots[i] == 200 for i in range(201, 300))


def test_simhash_edge_cases(spark, empty):
    assert simhash.near_components(empty).collect() == []
    df = spark.createDataFrame([(None, "one two"), (4, "ONE two"), (4, "one two"), (9, None), (8, "")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_components(df).collect())
    assert got == [(-1, 4), (4, 4), (4, 4), (8, 8), (9, 8)]


# --- packing ---------------------------------------------------------------------------------------------------------


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = [r.asDict() for r in packing.pack(docs, *vocabulary(), capacity=64).collect()]
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    for i, own in ids.items():
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert [r["start"] for r in mine] == [sum(q["length"] for q in mine[:k]) for k in range(len(mine))]
        assert sum(r["length"] for r in mine) == len(own) and all(r["length"] == 64 for r in mine[1:])
        for r in mine:
            part = np.array(own[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) <= 64
    least = -(-sum(r["length"] for r in rows) // 64)
    assert len(sequences) <= least + 3


def test_very_long_runs_as_in_the_json():
    a, b = packing.PieceTokenizer(*vocabulary()), packing.PieceTokenizer(vocabulary()[0])
    for t in [" " * 1_000_000, "a" * 1_000_000, "b " * 300_000, "\n \t" * 300_000, "\x1c!" * 200_000, "x " + "\u3000" * 50_000, " " * 9_999 + "z"]:
        assert a.ids(t) == b.ids(t), t[:4]


def test_packing_of_very_long_texts(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000), (2, "a" * 1_000_000), (3, "short text"), (4, "word " * 60_000)], "doc_id long, text string")
    rows = packing.pack(df, *vocabulary()).collect()
    for i, t in [(1, " " * 1_000_000), (2, "a" * 1_000_000)]:
        assert sum(r["length"] for r in rows if r["doc_id"] == i) == len(packing.PieceTokenizer(vocabulary()[0]).ids(t)) // 4 + 1


@pytest.mark.parametrize("n,share", [(300, 0.5), (1500, 0.8), (12000, 0.5)])
def test_program_places_most_and_beats_best_fit(n, share):
    rng = np.random.default_rng(n)
    histogram = Counter(np.clip(rng.lognormal(5.3, 0.9, n), 1, 1024).astype(int).tolist())
    program, rest = packing.packing_parts(histogram, 1024)
    placed = sum(c.total() * m for c, m in program)
    assert placed + sum(c.total() * m for c, m in rest) == n and placed >= share * n
    alone = packing.best_fit({k: v for k, v in histogram.items()}, 1024)
    assert sum(m for _, m in program + rest) <= sum(m for _, m in alone)


def test_knapsack_against_all_subsets():
    import itertools

    rng = random.Random(3)
    for _ in range(20):
        sizes, counts = np.array(sorted(rng.sample(range(1, 12), 3))), np.array([rng.randint(1, 4) for _ in range(3)])
        price = np.array([rng.random() for _ in range(3)])
        best, items, took = packing.knapsack(sizes, counts, price, 20)
        for room in (5, 13, 20):
            ways = [n for n in itertools.product(*(range(c + 1) for c in counts)) if np.dot(n, sizes) <= room]
            assert best[room] == pytest.approx(max(np.dot(n, price) for n in ways))
            got = packing._filled(room, items, took, sizes)
            assert all(got[i] <= counts[i] for i in got) and sum(got[i] * sizes[i] for i in got) <= room
            assert sum(got[i] * price[i] for i in got) == pytest.approx(best[room])


def test_tokenizers_agree():
    import public_tokenizers

    a, b = packing.PieceTokenizer(*vocabulary()), packing.PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ["", " ", "a\x1cb \x85c  d\n\n f\t\tg 's don't  \r\n x", "日本語 テスト １２３ <|endoftext|> é́", "x" * 5000, "🙂 ok", "  two  spaces  "]:
        assert a.ids(t) == b.ids(t)


def test_added_token_as_in_the_json():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    for t in ["hello <|endoftext|> world", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n\n  b", "<|endoftext| >", "<|ENDOFTEXT|>", "x" * 300 + "<|endoftext|>\u3000é "]:
        want = np.asarray(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert packing.PieceTokenizer(*vocabulary()).ids(t) == want == packing.PieceTokenizer(path).ids(t), t


def test_packing_materializes_sequences(spark, docs):
    placed = packing.pack(docs, *vocabulary(), capacity=64)
    rows = packing.sequences(docs, placed, *vocabulary(), capacity=64).collect()
    assert sum(len(r["input_ids"]) for r in rows) == placed.agg(F.sum("length")).first()[0]
    assert all(len(r["input_ids"]) <= 64 and sum(s["length"] for s in r["spans"]) == len(r["input_ids"]) for r in rows)


def test_packing_edge_cases(spark, empty):
    assert packing.pack(empty, *vocabulary()).collect() == []
    df = spark.createDataFrame([(None, None), (1, "same"), (1, "same")], "doc_id long, text string")
    rows = packing.pack(df, *vocabulary(), capacity=8).collect()
    assert sorted(((r["doc_id"] or -1), r["length"]) for r in rows) == [(-1, 1), (1, 2), (1, 2)] and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


def test_packing_of_many_rows_of_one_id(spark):
    """Rows with a null or one id lie in many ranking groups, and still gapless."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7, null) as doc_id", "0 as piece", "0L as start", "10 + id % 40 as length", "id as ids_crc32")
    pieces = materialize(rows, "test-pieces")
    got, spans = packing.place_pieces(pieces, 1024, group_rows=500).collect(), {}
    assert sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in got) == sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in pieces.collect())
    for r in got:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in map(sorted, spans.values()):
        ends = [a + n for a, n in parts]
        assert [a for a, _ in parts] == [0, *ends[:-1]] and ends[-1] <= 1024


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 200), min_size=1, max_size=20))
@settings(max_examples=30, deadline=None)
def test_plan_holds_histogram(histogram):
    plan = packing.plan_packing(histogram, 40)
    used = Counter()
    for config, many in plan:
        assert sum(k * n for k, n in config.items()) <= 40
        for k, n in config.items():
            used[k] += n * many
    assert used == Counter(histogram)
    assert sum(m for _, m in plan) <= 1.3 * sum(k * n for k, n in histogram.items()) / 40 + sum(n for k, n in histogram.items() if k > 20) + 2


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_mix_targets_and_taken(docs, texts):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    again = {(r["doc_id"]): r["taken"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    size = {i: len(SPACE.findall(t or "")) for i, t in enumerate(texts)}
    by = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    total = {s: sum(r["size"] for r in by[s]) for s in by}
    weight, left, open_, target = dict(zip(names, [3, 1, 2] * 9)), 1.5 * sum(total.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.discard(s)
    for s, own in by.items():
        assert all(r["target"] == pytest.approx(target[s]) and r["source_size"] == total[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(r["size"] for r in own) / 2 + 1e-6
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def test_mix_importance_changes_the_draw(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.when(F.col("id") < 300, "a").otherwise("b").alias("source"))
    favoured = mixing.mix(df, weights=(1,), share=0.5, importance=F.when(F.col("doc_id") % 2 == 0, 20).otherwise(1)).filter("copies > 0")
    assert favoured.filter("doc_id % 2 = 0").count() > 1.5 * favoured.filter("doc_id % 2 = 1").count()


def test_mix_inclusion_follows_importance(spark):
    """Over many seeds a document's mean number of copies is its expectation: in proportion to its importance, at most 2."""
    rows = [(i, " ".join(["w"] * (3 if i % 2 else 200)), "a" if i < 60 else "b") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    mean = {}
    for seed in range(6):
        for r in mixing.mix(df, weights=(1, 2), share=0.8, seed=seed).groupBy("source", "size", "target", "source_size").agg(F.avg("copies").alias("c")).collect():
            mean.setdefault((r["source"], r["size"], r["target"]), []).append(r["c"])
    for (source, size, target), c in mean.items():
        digits = {3: 2, 200: 8}
        level = target / sum(30 * s * digits[s] for s in digits)
        assert np.mean(c) == pytest.approx(level * digits[size], abs=0.12), (source, size)


def test_mix_edge_cases(spark, empty):
    assert mixing.mix(empty).collect() == []
    df = spark.createDataFrame([(1, None, None), (2, "", "a"), (None, "x y", "a"), (3, "x", "a"), (3, "x", "a")], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert len(rows) == 5 and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert all(r["taken"] == 0 for r in mixing.mix(df.filter("text is null or text = ''")).collect())


# --- quality classifier ----------------------------------------------------------------------------------------------


def quality_docs(spark, n=200):
    rng = random.Random(9)
    junk = lambda: " ".join(w.upper() + rng.choice(["!!", "###", "$$"]) for w in prose(rng, 40).split())
    return spark.createDataFrame([(i, junk() if i % 4 == 0 else prose(rng, rng.randint(20, 90)), "zz", "s") for i in range(n)], "doc_id long, text string, lang string, source string")


def test_quality_learns_and_holds_out(spark):
    df = quality_docs(spark)
    marks = labels_of(spark, [(i, int(i % 4 != 0), 0) for i in range(200)])
    rows = quality.quality_scores(df, marks).collect()
    assert {r["doc_id"] for r in rows if r["held_out"]} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["predicted"] == int(r["doc_id"] % 4 != 0) == int(r["score"] >= 0.3) for r in rows)
    flipped = labels_of(spark, [(i, int(i % 4 != 0) if zlib.crc32(str(i).encode()) % 5 else int(i % 4 == 0), 0) for i in range(200)])
    assert {r["doc_id"]: r["score"] for r in quality.quality_scores(df, flipped).collect()} == pytest.approx({r["doc_id"]: r["score"] for r in rows})
    assert quality.keep_good(df, marks).count() == 150


def test_quality_against_plain_discriminant(spark):
    df = quality_docs(spark, 80)
    marks = labels_of(spark, [(i, int(i % 4 != 0), 0) for i in range(80)])
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(df, marks, pooling=0.2, diagonal=0.1, floor=1e-4).collect()}
    x = {r["doc_id"]: np.array(quality.statistics(r["text"])) for r in df.collect()}
    fit = [i for i in x if zlib.crc32(str(i).encode()) % 5]
    xs = {y: np.array([x[i] for i in fit if int(i % 4 != 0) == y]) for y in (0, 1)}
    cov = {y: np.cov(v.T, bias=True) for y, v in xs.items()}
    pooled = sum(len(v) * cov[y] for y, v in xs.items()) / len(fit)
    log_p = {}
    for y, v in xs.items():
        c = 0.9 * (0.8 * cov[y] + 0.2 * pooled) + 0.1 * np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(pooled))
        log_p[y] = {i: np.log(len(v) / len(fit)) - 0.5 * (q - v.mean(0)) @ np.linalg.solve(c, q - v.mean(0)) - 0.5 * np.linalg.slogdet(c)[1] for i, q in x.items()}
    assert all(got[i] == pytest.approx(1 / (1 + np.exp(np.clip(log_p[0][i] - log_p[1][i], -700, 700))), abs=1e-6) for i in x)


def test_quality_edge_cases(spark, docs, empty):
    none = labels_of(spark, [])
    assert quality.quality_scores(empty, none).collect() == []
    assert all(r["score"] == 1.0 for r in quality.quality_scores(docs, none).collect())
    odd = labels_of(spark, [(None, 1, 0), (1, None, 0), (2, 1, None), (2, 1, None), (3, 0, 0)])
    rows = quality.quality_scores(docs, odd).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)


# --- chat ------------------------------------------------------------------------------------------------------------


NASTY = ["", "plain", CONTROL_TEXT, "\\", "<\\s>", "<s>\\</s>\\\\[INST]", "[\\/INST]", "<s><s>", "line\nbreak </s", "[INST", "é😀 <s>"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<s>odd"]), rng.choice(NASTY)) for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(98, t, ["user", "assistant", "assistant"][t % 3], f"turn {t} <s>") for t in range(700)]  # over many chunks of spans
    rows += [(99, 0, None, None), (None, 1, "user", "x"), (50, 2, "assistant", "b"), (50, 2, "assistant", "a"), (50, None, "user", "first"), (50, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    formatted = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.chat_digests(formatted).collect()}
    raw = {r["conv_id"]: r for r in formatted.collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == convs.keys()
    for c, own in convs.items():
        own.sort()
        r = got[c]
        assert r["n_turns"] == len(own) and r["formatted_chars"] == len(raw[c]["formatted"])
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        blocks = 1 + sum(a[2] != b[2] for a, b in zip(own, own[1:]))
        assert raw[c]["formatted"].count("[/INST]") == blocks == raw[c]["formatted"].count("</s>")
    assert chat.format_chats(df.limit(0)).collect() == []


# --- quality rules ---------------------------------------------------------------------------------------------------


def plain_counts(text):
    words = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_base_counts(spark, docs, texts):
    more = ["a b c x a b c", "a a a a a", "#1 $2 <x>|&% \n\n \t\n#1 $2", "r\rn\x0bq\x0cz", "é ü\n" * 60, " ".join(str(i % 7) for i in range(500))]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    good = labels_of(spark, [(i, 1, 0) for i in range(40)] + [(None, 1, 0), (2, None, 0)])
    want = {i: plain_counts(t) for i, t in [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(more))]}
    for r in rules.quality_rules(df, good).collect():
        n = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r["kept"] == (not r["base_failed"] and r["log_ratio"] >= -0.12)


def test_rules_ratio_against_plain(spark):
    rng = random.Random(5)
    clean = [prose(rng, 80) for _ in range(200)]
    junk = [" ".join(f"{w}%%%" for w in prose(rng, 80).split()) for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    n_buckets = 512
    rows = {r["doc_id"]: r for r in rules.quality_rules(df, labels_of(spark, [(i, 1, 0) for i in range(150)]), buckets=n_buckets).collect()}
    assert all(rows[i]["kept"] for i in range(200) if not rows[i]["base_failed"]) and not any(rows[200 + i]["kept"] for i in range(8))

    def buckets(text):
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        own = [xxhash.xxh64_intdigest(w.encode(), 42) for w in SPACE.findall(text)]
        # A long hashed with another's hash as seed: XXH64 of its 8 bytes.
        pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(own, own[1:])]
        return [signed(x) % n_buckets for x in own + pairs]

    raw, good = Counter(), Counter()
    for i, t in enumerate(clean + junk):
        raw.update(buckets(t))
        if i < 150 and zlib.crc32(str(i).encode()) % 5:  # the held-out fold's labels are not read
            good.update(buckets(t))
    n_raw, n_good = raw.total(), good.total()
    ratio = {x: np.log((good[x] / n_good * n_good + n_buckets * raw[x] / n_raw) / (n_good + n_buckets) / (raw[x] / n_raw)) for x in raw}
    for i, t in enumerate(clean + junk):
        assert rows[i]["log_ratio"] == pytest.approx(np.mean([ratio[x] for x in buckets(t)]), abs=2e-4)


def test_rules_edge_cases(spark, docs, empty):
    assert rules.quality_rules(empty, labels_of(spark, [])).collect() == []
    rows = rules.quality_rules(docs, labels_of(spark, [])).collect()
    assert len(rows) == docs.count() and all(r["log_ratio"] == 0 and r["kept"] == (not r["base_failed"]) for r in rows)


# --- language ID -----------------------------------------------------------------------------------------------------


def brute_chain(emit, trans, start):
    import itertools

    n, k = emit.shape
    paths = list(itertools.product(range(k), repeat=n))
    score = np.array([start[p[0]] + sum(emit[t, p[t]] for t in range(n)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
    w = np.exp(score - score.max())
    w /= w.sum()
    post, pairs = np.zeros((n, k)), np.zeros((k, k))
    for p, x in zip(paths, w):
        for t, y in enumerate(p):
            post[t, y] += x
        for a, b in zip(p, p[1:]):
            pairs[a, b] += x
    return post, pairs


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    emit, trans, start = rng.normal(size=(2, 6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    mask = np.ones((2, 6), dtype=bool)
    mask[1, 4:] = False
    post, pairs = langid.forward_backward(emit, mask, trans, start)
    a, pa_ = brute_chain(emit[0], trans, start)
    b, pb_ = brute_chain(emit[1, :4], trans, start)
    assert np.allclose(post[0], a) and np.allclose(post[1, :4], b) and not post[1, 4:].any() and np.allclose(pairs, pa_ + pb_)
    assert np.allclose(langid.tag_chains(emit, mask, trans, start), post)


LANGS = {"en": "the house with green windows stands there".split(), "de": "das haus mit grünen fenstern steht schön dort".split(), "fr": "la maison avec des fenêtres vertes était là".split()}


def test_languages_and_code_switching(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(LANGS[x]) for _ in range(rng.randint(5, 150))), x) for i in range(120) for x in [rng.choice(list(LANGS))]]
    extra = [(500, None, "en"), (501, "123 ... $$$", "en"), (502, "la maison verte", None), (503, "", None)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify_languages(df).collect()}
    assert all(got[i]["lang_pred"] == x and 0.5 < got[i]["score"] <= 1 for i, _, x in rows)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (500, 501, 503)] == [("und", 0.0)] * 3 and got[502]["lang_pred"] == "fr"
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    tagger = langid.fit_tagger([(x, [t.split()[: langid.CHAIN]]) for _, t, x in rows])
    mixed = LANGS["de"][:6] + LANGS["fr"][:6]
    emit, _ = tagger.emission(mixed)
    post = langid.tag_chains(emit[None], np.ones((1, 12), dtype=bool), tagger.trans, tagger.start)[0]
    assert [tagger.labels[k] for k in post.argmax(axis=1)] == ["de"] * 6 + ["fr"] * 6


def test_languages_edge_cases(spark, empty):
    assert langid.identify_languages(empty).collect() == []
    df = spark.createDataFrame([(1, "abc", None), (None, "abc def", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.identify_languages(df).collect()] == ["und", "und"]


def test_languages_sample_is_bounded_by_rows(spark):
    """One id on most rows, and equal rows: at most the asked number of documents, the same ones for any partitions."""
    rows = [(1, f"word{i} text", "en" if i % 2 else "fr") for i in range(60)] + [(1, "same text", "en")] * 5 + [(i, f"own{i}", "en") for i in range(2, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [langid.fit_sample(df.repartition(n), (4, 2), rows=20) for n in (1, 5)]
    assert len(got[0]) == 20 and got[0] == got[1]
    everything = langid.fit_sample(df, (4, 2), rows=1000)
    assert len(everything) == sum(zlib.crc32(str(r[0]).encode()) % 4 != 2 for r in rows)
    assert langid.fit_sample(df.filter("false"), (4, 2)) == []


# --- line dedup ------------------------------------------------------------------------------------------------------


def test_patience_finds_common_runs():
    assert linededup.patience([1, 2, 3, 4], [1, 2, 3, 4]) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert linededup.patience([1, 2, 3], [9, 1, 2, 8, 3]) == [(0, 1), (1, 2), (2, 4)]
    assert linededup.patience([1, 2], [2, 1]) in ([(0, 1)], [(1, 0)])
    assert linededup.patience([5, 5, 7, 5], [5, 7, 5, 5]) and linededup.patience([], [1]) == []


@given(st.lists(st.integers(0, 5), max_size=12), st.lists(st.integers(0, 5), max_size=12))
@settings(max_examples=100, deadline=None)
def test_patience_is_a_common_subsequence(a, b):
    m = linededup.patience(a, b)
    assert all(a[i] == b[j] for i, j in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))


def test_line_dedup(spark):
    rng = random.Random(6)
    block = [prose(rng, 12) for _ in range(4)]
    line = prose(rng, 30)
    own = lambda: [prose(rng, 10) for _ in range(3)]
    texts = {1: own() + block + own(), 2: own() + block, 3: block + own(), 4: own() + [line], 5: [line] + own(), 6: own(), 7: ["Released under X."] + own(), 8: ["Released under X."] + own()}
    texts[9] = texts[1]
    texts |= {100 + i: own() + [line] for i in range(80)}  # common: over the rare limit
    df = spark.createDataFrame([(i, "\n".join(t), 1) for i, t in texts.items()] + [(None, line, 1), (50, None, 1)], "doc_id long, text string, h int")
    got = {r["doc_id"]: r for r in linededup.drop_common_blocks(df).collect()}
    assert len(got) == len(texts) + 2 and got[None]["text"] == line and got[50]["text"] == ""
    for i, t in texts.items():
        gone = set(block) if i in (2, 3) else set(t) if i == 9 else {line} if i == 5 or i >= 100 else set()
        assert got[i]["text"] == "\n".join(x for x in t if x not in gone), i
        assert got[i]["n_deleted"] == sum(x in gone for x in t)


def test_line_dedup_edge_cases(spark, empty, docs):
    assert linededup.drop_common_blocks(empty).collect() == []
    assert linededup.drop_common_blocks(docs).count() == docs.count()
    same = spark.createDataFrame([(1, prose(random.Random(1), 40))] * 2, "doc_id long, text string")
    assert all(r["n_deleted"] == 0 for r in linededup.drop_common_blocks(same).collect())


def test_line_dedup_over_blank_lines(spark):
    rng = random.Random(7)
    block, own = [prose(rng, 12) for _ in range(5)], [prose(rng, 10) for _ in range(2)]
    texts = {1: "\n".join(block), 2: "\n\n".join(block), 3: "\n \n\n".join([own[0], *block, own[1]])}
    got = {r["doc_id"]: r for r in linededup.drop_common_blocks(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1]["n_deleted"] == 0
    assert (got[2]["text"], got[2]["n_deleted"]) == ("", 9)
    assert (got[3]["text"], got[3]["n_deleted"]) == ("\n".join([own[0], " ", "", " ", "", own[1]]), 13)


def plain_deletions(texts, min_words=20):
    """Line numbers that each document loses: those in runs of adjacent lines that an earlier document has in one piece."""
    gone = {i: set() for i in texts}
    for i, later in texts.items():
        for j, earlier in texts.items():
            for a in range(len(later) if j < i else 0):
                for b in range(len(earlier)):
                    n = 0
                    while a + n < len(later) and b + n < len(earlier) and later[a + n] == earlier[b + n]:
                        n += 1
                    if sum(len(x.split()) for x in later[a : a + n]) >= min_words:
                        gone[i] |= set(range(a, a + n))
    return gone


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(9)
    lines = [prose(rng, rng.randint(4, 14)) + f" {k}" for k in range(12)]
    sections = [[prose(rng, rng.randint(3, 15)) + f" {k}" for _ in range(rng.randint(1, 5))] for k in range(14)]
    a, b, *piece = (prose(rng, 12) for _ in range(7))
    own = lambda: prose(rng, 9)
    texts = {1: [a], 2: [b], 3: [a, b], 4: [a, b], 5: [a, own(), b, own()]}  # compiled from two first holders
    texts |= {6: [piece[3], own(), piece[1], own(), piece[0], own(), piece[2]], 7: piece[:4], 8: piece[:4], 9: [own(), *piece]}  # scattered in the first
    for i in range(10, 60):  # shared lines in any order, some twice
        texts[i] = [y for k in rng.choices(range(12), k=rng.randint(1, 8)) for y in ([lines[k]] if rng.random() < 0.8 else [own(), lines[k]])]
    for i in range(60, 140):  # sections in random order
        texts[i] = [y for k in rng.sample(range(14), rng.randint(1, 7)) for y in sections[k] + [own()] * (rng.random() < 0.3)]
    moved = [prose(rng, 8) for _ in range(10)]
    texts |= {200: moved[:4] + moved[4:], 201: moved[:4], 202: moved[4:] + moved[:4], 203: moved[:4] * 2 + moved[4:]}
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.drop_common_blocks(df).collect()}
    want = plain_deletions(texts)
    for i, gone in want.items():
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(texts[i]) if k not in gone), i
    assert got[4]["n_deleted"] == 2 and got[4]["partners"] == 1 and got[8]["n_deleted"] == 4 and got[7]["n_deleted"] == got[5]["n_deleted"] == 0
    assert got[202]["n_deleted"] == 10 and sum(map(len, want.values())) > 1000


def test_crossing_runs_are_all_deleted():
    run = lambda lines, earlier, later: {"lines": lines, "words": [10] * len(lines), "earlier": earlier, "later": later, "pos": [2 * n + k for n in later for k in range(len(lines))]}
    # a = 1 2 3 4 5 6, b = 3 4 5 6 1 2 and the overlapping run 2 3 nowhere in b.
    blocks = linededup.common_blocks([run([1, 2], [0], [4]), run([3, 4], [2], [0]), run([4, 5], [3], [1]), run([5, 6], [4], [2])], 20)
    assert sorted(blocks) == [(0, 5), (8, 9)]
    assert linededup.common_blocks([], 20) == []


# --- licences --------------------------------------------------------------------------------------------------------


BODY = "nothing to see here but words about rivers and stones " * 5
APACHE_HEADER = """/*
 * Copyright 2020 Acme Corp.
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
int main() { return 0; }"""


def test_licences_and_inheritance(spark, empty):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        (2, "a/x.txt", BODY), (3, "a/b/c/y.txt", BODY), (4, "a/b/c/z.txt", f"Licensed under the Apache License, Version 2.0.\n{BODY}"), (5, "d/q.txt", BODY),
        (6, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (9, "d/LICENSE.txt", BODY), (10, "d/short.txt", "Released under the MIT License."), (7, None, None), (8, "e/f.txt", f"{BODY}\nAll rights reserved.\n{BODY}"), (8, "e/f.txt", f"{BODY}\nAll rights reserved.\n{BODY}"),
    ]
    df = spark.createDataFrame([(*r, 1, "clash", 0.5) for r in rows], "doc_id long, p string, text string, line int, term string, score double")
    got = {r["doc_id"]: r for r in licenses.licence_scan(df, F.col("p")).collect()}
    assert licenses.licence_scan(df, F.col("p")).count() == 11
    # A statement alone licenses its own document, not the directory; a file named as licence but without one gives none.
    assert {i: r["licence"] for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: "GPL-3.0", 4: "Apache-2.0", 5: None, 6: "GPL-3.0", 7: None, 8: "Proprietary", 9: None, 10: "MIT"}
    assert not got[9]["licence_file"] and not got[10]["licence_file"] and got[6]["licence_file"]
    assert got[3]["inherited_from"] == "a/b" and got[2]["inherited_from"] == "a" and not got[4]["licence_file"] and got[1]["licence_file"]
    assert licenses.licence_scan(empty, F.col("source")).collect() == []


def test_licence_rows_of_one_id_and_path(spark):
    mit = licenses.licence_texts()["MIT"]
    rows = [(None, None, BODY * 30), (None, None, mit), (5, "x/y", BODY), (5, "x/y", "Released under the MIT License."), (5, "x/y", None), (None, None, mit)]
    got = licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, p string, text string"), F.col("p")).collect()
    assert Counter((r["doc_id"], r["own_licence"], r["licence_file"]) for r in got) == {(None, None, False): 1, (None, "MIT", True): 2, (5, None, False): 2, (5, "MIT", False): 1}


def plain_inheritance(rows):
    """Licence of each (path, own licence, file score) by walking up from the directory."""
    given = {}
    for path, own, score in rows:
        if score is not None:
            up = path.rsplit("/", 1)[0] if "/" in path else ""
            given[up] = min(given.get(up, (9, "", "")), (-score, path, own))
    out = []
    for path, own, _ in rows:
        at = path.rsplit("/", 1)[0] if "/" in path else ""
        while own is None:
            own = given[at][2] if at in given else None
            if not at:
                break
            at = at.rsplit("/", 1)[0] if "/" in at else ""
        out.append(own)
    return out


def test_inheritance_against_walking_up(spark):
    rng = random.Random(13)
    whole = licenses.licence_texts()
    folder = lambda: "/".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
    rows = []
    for i in range(150):
        kind, name = rng.random(), rng.choice(sorted(whole))
        text = whole[name] if kind < 0.15 else "Released under the MIT License." if kind < 0.25 else BODY
        rows.append((i, f"{folder()}/f{i}".strip("/"), text))
    got = {r["doc_id"]: r for r in licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, p string, text string"), F.col("p")).collect()}
    assert [got[i]["licence_file"] for i, _, _ in rows] == [t in whole.values() for _, _, t in rows]
    found = [(p, got[i]["own_licence"], round(got[i]["own_score"], 9) if got[i]["licence_file"] else None) for i, p, _ in rows]
    assert [got[i]["licence"] for i, _, _ in rows] == plain_inheritance(found) and any(r["inherited_from"] for r in got.values())


def test_licence_files_and_wrapped_headers(spark):
    """Whole licence texts with names and years filled in, set in other widths; headers wrapped in comments."""
    import textwrap

    whole = {name: t.replace("<year>", "2021").replace("<copyright holders>", "Jane Doe") for name, t in licenses.licence_texts().items()}
    narrow = lambda t: "\n\n".join(textwrap.fill(p, 50) for p in t.split("\n\n"))
    rows = [(i, f"{name}/LICENSE", narrow(t)) for i, (name, t) in enumerate(whole.items())]
    rows += [(100 + i, f"{name}/src/deep/x.c", BODY) for i, name in enumerate(whole)]
    lgpl = licenses.STATEMENTS["LGPL-2.1"][1]
    rows += [
        (200, "p/main.c", APACHE_HEADER), (201, "p/other.c", BODY), (202, "q/lib.py", "\n".join("# " + x for x in textwrap.wrap(lgpl, 60)) + f"\n\n{BODY}\n"),
        (203, "r/mit.js", "\n".join("// " + x for x in whole["MIT"].split("\n")) + "\n" + "let words = 1;\n" * 40), (204, "r/plain.js", "let words = 1;\n" * 40),
    ]
    got = {r["doc_id"]: r for r in licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, p string, text string"), F.col("p")).collect()}
    for i, name in enumerate(whole):
        assert (got[i]["licence"], got[i]["licence_file"]) == (name, True) and (got[100 + i]["licence"], got[100 + i]["inherited_from"]) == (name, name)
    assert [(got[i]["own_licence"], got[i]["licence_file"]) for i in (200, 202, 203)] == [("Apache-2.0", False), ("LGPL-2.1", False), ("MIT", False)]
    assert got[201]["licence"] is None and got[204]["licence"] is None


def plain_units(text):
    """(kind, first line, terms) of a text's units."""
    lines = text.split("\n")
    words = [[w for w in re.findall(licenses.TERM.replace(r"\p{L}\p{N}", r"\w"), x.lower()) if w not in licenses.STOP] for x in lines]
    out = [("line", i, t) for i, t in enumerate(words) if t]
    runs, code = [], None
    for i, t in enumerate(words):
        if t and (not i or not words[i - 1]):
            runs.append([i, i])
        if t:
            runs[-1][1] = i
            code = i if code is None and not re.match(licenses.COMMENT, lines[i]) else code
    join = lambda a, z: [w for t in words[a:z] for w in t]
    out += [("paragraph", a, join(a, z + 1)) for a, z in runs if z > a and len(runs) > 1]
    return out + [("header", 0, join(0, code))] * bool(code) + [("document", 0, join(0, len(words)))]


def test_licence_cosine_against_plain(spark):
    import math

    texts = [
        "Licensed under the Apache License, Version 2.0.", "Licensed under some Apache License or other thing", "the license of apes", "plain words only here", APACHE_HEADER, "",
        "copyright 2020 acme corp\n\nLicensed under the\nMIT License\n\nthe end", licenses.licence_texts()["ISC"], "# a\n\n# License\nx = 1\nLicensed under the BSD License",
    ]
    whole = {k: v for k, v in licenses.licence_texts().items() if k in ("MIT", "ISC")}
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, t string")
    words = lambda t: plain_units(t.replace("\n", " "))[-1][2]
    templates = [(n, Counter(words(t)), False) for n, ts in licenses.STATEMENTS.items() for t in ts] + [(n, Counter(words(t)), True) for n, t in whole.items()]
    df_of = Counter(w for t in texts for w in set(words(t)))
    idf = lambda w: math.log((1 + len(texts)) / (1 + df_of[w])) + 1
    for threshold in (0.2, 0.7):
        got = {(r["row_id"], r["kind"], r["at"]): r["score"] for r in licenses.licence_units(df, threshold, whole).collect()}
        want = {}
        for i, t in enumerate(texts):
            for kind, at, own in plain_units(t):
                v = Counter(own)
                norm = math.sqrt(sum((n * idf(w)) ** 2 for w, n in v.items())) or 1.0
                best = max(sum(v[w] * x[w] * idf(w) ** 2 for w in v) / norm / math.sqrt(sum((n * idf(w)) ** 2 for w, n in x.items())) for _, x, big in templates if not big or kind in ("header", "document"))
                if best >= threshold:
                    want[i, kind, at] = best
        assert got == pytest.approx(want) and len(want) > 8


def test_licence_frequencies_cover_all_terms(spark):
    import math

    line = "Copyright 2020 Acme Corp. Licensed under the Apache License, Version 2.0 License"
    lines = [line] + ["copyright 2020 acme corp"] * 60 + ["plain words only here"] * 139
    df = spark.createDataFrame(list(enumerate(lines)), "row_id long, t string")
    got = [(r["row_id"], r["licence"], r["score"]) for r in licenses.licence_units(df, texts={}).filter("kind = 'line'").collect()]
    idf = lambda n: math.log(201 / (1 + n)) + 1
    rare, common = idf(1), idf(61)
    # licensed, under, apache, version, 2.0 once and license twice, against each once; copyright, 2020, acme, corp are common.
    cosine = 7 * rare**2 / math.sqrt(9 * rare**2 + 4 * common**2) / math.sqrt(6 * rare**2)
    assert got == [(0, "Apache-2.0", pytest.approx(cosine))] and cosine > 0.7


# --- every operator on awkward tables --------------------------------------------------------------------------------


def test_very_long_texts_and_clashing_columns(spark):
    """A long text of one line, of many lines, of white space, and of one word; columns named as the operators' own."""
    rng = random.Random(12)
    line = [prose(rng, 12) for _ in range(40)]
    texts = [prose(rng, 60_000), "\n".join(rng.choice(line) for _ in range(8000)), " \n" * 150_000, "x" * 300_000, None, "short one", "short one"]
    clash = dict.fromkeys(["t", "h", "fp", "at", "n", "words", "lines", "hashes", "trusted", "u", "size", "rank", "bucket", "term", "row_id", "path", "cuts", "digest", "block", "piece", "length", "x", "y", "score"], "clash")
    df = spark.createDataFrame([{"doc_id": i, "text": t, "lang": "en", "source": "s", **clash} for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in clash))
    labels = labels_of(spark, [(0, 1, 0), (1, 0, 0), (5, 1, 0)])
    tables_ = [
        linededup.drop_common_blocks(df), langid.identify_languages(df), exact.exact_groups(df), mixing.mix(df), licenses.licence_scan(df, F.col("source")),
        simhash.near_components(df), quality.quality_scores(df, labels), rules.quality_rules(df, labels),
    ]
    for out in tables_:
        assert sorted(r["doc_id"] for r in out.collect()) == list(range(len(texts))), out.columns
    assert sorted({r["doc_id"] for r in packing.pack(df, *vocabulary()).collect()}) == list(range(len(texts)))
    for kept in (exact.drop_exact_copies(df), simhash.drop_near_copies(df), quality.keep_good(df, labels), mixing.mixed_rows(df)):
        assert kept.columns == df.columns and kept.count() <= 2 * len(texts)
    counts = {r["doc_id"]: r for r in rules.quality_rules(df, labels).collect()}
    assert all(tuple(counts[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_counts(t) for i, t in enumerate(texts))
    chats = spark.createDataFrame([(1, 0, "user", texts[0], "x"), (1, 1, "assistant", texts[1], "x")], "conv_id long, turn long, role string, text string, turns string")
    got = chat.chat_digests(chat.format_chats(chats)).first()
    assert got["n_turns"] == 2 and got["loss_sha256"] == hashlib.sha256(texts[1].encode()).hexdigest()
