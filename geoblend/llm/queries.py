"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, langid, licenses, linededup, mixing, negatives, packing, quality, rules, simhash, substrings, trie

#: Planted conversation of the chat query.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """The byte-level vocabulary: its tokenizers file, and its ranks (same ids)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document, as a digest."""
    left = linededup.drop_common_blocks(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_deleted", "partners", F.sha2("text", 256).alias("text_sha256"))


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *vocabulary())


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def document_path() -> Column:
    """Paths of the documents, at three depths: under source, under source/language, or under source/language/thousand."""
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    name, depth = F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce(F.col("doc_id") % 3, F.lit(0))
    shard = F.floor(F.col("doc_id") / 1000).cast("string")
    return F.when(depth == 0, F.concat_ws("/", source, name)).when(depth == 1, F.concat_ws("/", source, lang, name)).otherwise(F.concat_ws("/", source, lang, shard, name))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_scan(table(spark, sf_dir, "documents"), document_path())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return chat.chat_digests(chat.format_chats(rows.unionByName(planted)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.drop_repeated_windows(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are shifted by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations share first turns in families of twenty: up to three turns of the family's first one."""
    rows = trie.turn_rows(table(spark, sf_dir, "conversations"))
    heads = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)).cast("int")
    return trie.prefix_trie(trie.rebuilt_turns(rows, lambda c: c - c % 20, heads, 3))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_language_crf, op3_exact_dedup, op4_best_fit_packing, op5_source_mix, op6_licence_scan, op7_simhash, op8_quality, op9_chat, op10_quality_rules,
        op11_substring_dedup, op12_hard_negatives, op13_prefix_trie,
    )
}

ORACLES = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op5_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   (('0x' || substr(md5(doc_id::VARCHAR || '|5'), 1, 12))::UBIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w
            FROM d GROUP BY source),
        c AS (
            SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
        l AS (
            SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
        t AS (
            SELECT *, least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER () * w, cap)) AS target FROM l),
        m AS (
            SELECT source, len(bin(size)) AS i, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
        n AS (
            SELECT m.*, t.source_size, t.target, CASE WHEN sum(words * i) OVER after > 0 THEN (t.target - coalesce(sum(words) OVER before, 0) * 2.0::DOUBLE) / sum(words * i) OVER after END AS lv
            FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source
            WINDOW before AS (PARTITION BY m.source ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   after AS (PARTITION BY m.source ORDER BY i DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        e AS (
            SELECT *, least(2.0::DOUBLE, coalesce(max(CASE WHEN lv * i <= 2.0::DOUBLE * (1 + 1e-12::DOUBLE) THEN lv END) OVER (PARTITION BY source) * i, 2.0::DOUBLE)) AS copies FROM n),
        p AS (
            SELECT source, i, source_size, target, floor(copies) AS sure, copies - floor(copies) AS p, target - sum(floor(copies) * words) OVER (PARTITION BY source) AS want FROM e),
        r AS (
            SELECT d.doc_id, d.size, p.source_size, p.target, p.sure, p.want, d.source,
                   CASE WHEN p.p > 0 AND d.size > 0 THEN d.u / (1 - d.u) / (p.p / (1 - p.p)) END AS rnk
            FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND len(bin(d.size)) = p.i),
        o AS (
            SELECT *, sum(size) OVER (PARTITION BY source, rnk IS NULL ORDER BY rnk, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r)
        SELECT doc_id, size, source_size, target,
               (CASE WHEN size = 0 THEN 0
                     ELSE size * (sure + CASE WHEN rnk IS NOT NULL AND (run <= want OR run - want < want - (run - size)) THEN 1 ELSE 0 END) END)::BIGINT AS taken
        FROM o""",
    "op9_chat": r"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g') AS esc,
                   regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g') AS esc_role,
                   lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same FROM r)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               sum(length(esc) + CASE WHEN same THEN 3 ELSE length(esc_role) + 9 + 7 + 4 END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
        x AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS win FROM s),
        n AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS n FROM x) WHERE n > 1),
        c AS (SELECT DISTINCT r, i + o AS i FROM n, (SELECT unnest(range(0, 35)) AS o)),
        k AS (SELECT d.r, d.i, d.word FROM (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d) d ANTI JOIN c ON d.r = c.r AND d.i = c.i),
        t AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN t ON d.r = t.r""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.vec, c.vec)::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
    "op13_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
        c AS (
            SELECT conv_id, list_reduce(
                       list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END) AS reg
            FROM (SELECT DISTINCT conv_id FROM t)),
        h AS (SELECT conv_id, conv_id - conv_id % 20 AS base, (4294967295 - reg) % 4 AS h FROM c),
        u AS (
            SELECT h.conv_id, 0 AS part, k, role, text FROM h JOIN t ON t.conv_id = h.base AND t.k <= h.h
            UNION ALL SELECT h.conv_id, 1, k, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.k > h.h),
        r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth FROM u),
        p AS (
            SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
                   sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM r
            UNION ALL SELECT conv_id, 0, 0, '' FROM c),
        e AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
        n AS (
            SELECT p.node, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                   sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE p.depth = e.depth), '')) AS ends_sha256
            FROM p JOIN e ON p.conv_id = e.conv_id GROUP BY ALL),
        o AS (SELECT DISTINCT a.node AS up, b.node AS node FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1),
        k AS (SELECT n.*, coalesce(x.n, 0) AS n_children FROM n LEFT JOIN (SELECT up, count(*) AS n FROM o GROUP BY up) x ON n.node = x.up),
        s AS (SELECT DISTINCT a.node AS top, b.node AS node FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
        z AS (SELECT top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM s JOIN k ON s.node = k.node GROUP BY top)
        SELECT k.conv_id, k.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, k.n_convs, k.n_children::BIGINT AS n_children, z.n_leaves, z.saved::BIGINT AS saved_tokens, k.ends_sha256
        FROM k JOIN z ON k.node = z.top LEFT JOIN o ON o.node = k.node LEFT JOIN n up ON up.node = o.up""",
}
