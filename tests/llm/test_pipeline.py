import random

import corpus_pipeline
from geoblend.llm import exact, mixing, quality, simhash
from geoblend.llm.common import materialize


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(8)
    words = "river stone light under green house walks slowly over many fields where birds sing".split()
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(n))
    rows = [(i, text(rng.randint(30, 200)), "en", f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s0") for i in range(10)]
    rows += [(300 + i, " ".join(w.upper() + "!!" for w in text(60).split()), "en", "s1") for i in range(30)]
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, str(tmp_path)), f"test-{name}")
        if name != "packing":
            assert out.columns == docs.columns
        docs, seen[name] = out, {r["doc_id"] for r in out.collect()}
    assert seen["quality"] == {r[0] for r in rows if r[0] < 300}
    assert seen["exact_dedup"] == seen["quality"] - set(range(10))
    assert seen["simhash_near_dedup"] <= seen["exact_dedup"] and len(seen["simhash_near_dedup"]) > 100
    assert seen["packing"] == seen["source_mix"] <= seen["simhash_near_dedup"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_null_and_repeated_ids_keep_their_rows(spark):
    rows = [(None, "copy of one", "a"), (1, "copy of one", "a"), (None, "alone and clean", "a"), (2, "other text here", "b"), (2, "copy of one", "b"), (3, "last words", None), (None, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [tuple(r) for r in exact.drop_exact_copies(df).collect()]
    assert sorted(kept, key=str) == sorted(rows[2:], key=str)


def test_mixed_rows_hold_what_mix_takes(spark):
    rows = [(None if i % 3 == 0 else i // 4, " ".join(["w"] * (1 + i % 7)), [None, "a", "b"][i % 5 % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    count = lambda t: {(r[0], r[1], r[2]): r[3] for r in t.collect()}
    want = count(mixing.mix(df).filter("taken > 0").groupBy("doc_id", "source", "size").agg({"copies": "sum"}))
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    got = count(out.selectExpr("doc_id", "source", "size(split(text, ' ')) AS size").groupBy("doc_id", "source", "size").count())
    assert got == want and any(k[0] is None for k in want)


CASES = [
    (None, "copy of one text here", "en", "a"), (1, "copy of one text here", "en", "a"), (None, "alone and clean as a text can be", "en", "a"),
    (2, "other text of this id", "en", "b"), (2, "copy of one text here", "en", "b"), (3, "last words", None, None), (None, None, None, "b"),
    (4, "", "en", "b"), (4, "", "en", "b"), (5, "many words " * 3000, "en", "a"),
]


def case_docs(spark, rows=CASES):
    return spark.createDataFrame([(*r, 1, "clash", 7) for r in rows], "doc_id long, text string, lang string, source string, fp long, digest string, gone_id long")


def test_near_dedup_drops_rows_not_ids(spark):
    rng = random.Random(4)
    text = " ".join(f"w{rng.random()}" for _ in range(60))
    rows = [(3, text, "en", "a"), (5, text, "en", "a"), (5, "quite another text that nobody has", "en", "a"), (None, text, "en", "a"), (None, "a text without an id stands alone", "en", "a")]
    kept = simhash.drop_near_copies(case_docs(spark, rows))
    assert sorted((r["doc_id"] or -1, r["text"][:5]) for r in kept.collect()) == [(-1, "a tex"), (3, text[:5]), (5, "quite")]


def test_classifier_drops_rows_not_ids(spark):
    rng = random.Random(6)
    words = "river stone light under green house walks slowly".split()
    good = lambda: " ".join(rng.choice(words) for _ in range(60))
    bad = lambda: " ".join(rng.choice(words).upper() + "!!#" for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), "en", "a") for i in range(150)] + [(999, good(), "en", "a"), (999, bad(), "en", "a"), (None, good(), "en", "a"), (None, bad(), "en", "a")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(case_docs(spark, rows), labels).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, *(i for i in range(150) if i % 3), 999] and not any("!!#" in r["text"] for r in kept)


def test_stages_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (CASES, []):
        docs = case_docs(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, docs, str(tmp_path)), f"test-cases-{name}")
            if name == "packing":
                assert out.count() >= docs.count() and (docs.count() > 0) == (out.count() > 0)
                break
            assert out.columns == docs.columns
            left = sorted({(r["doc_id"], r["text"], r["source"]) for r in out.collect()}, key=str)
            if name == "quality":
                assert left == sorted({(r[0], r[1], r[3]) for r in rows}, key=str)
            if name == "exact_dedup" and rows:  # of equal texts the greatest id stays; null and empty are equal
                assert left == sorted({(r[0], r[1], r[3]) for r in (CASES[2], CASES[3], CASES[4], CASES[5], CASES[7], CASES[9])}, key=str)
            docs = out
