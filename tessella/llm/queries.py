"""Queries of the training-data operators over their whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree, decontam, embedding_dedup, license_scan, line_dedup, minhash_dedup, packing, quality, sharding, substring_dedup
from .common import read, text_of

#: Place of the public vocabulary files.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text under a context tree learnt from six sevenths of the documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = context_tree.score_documents(docs, ~held_out, keep_text=False)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 20 code points in at least 3 documents stay in the largest doc_id alone."""
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words that also start in a smaller doc_id."""
    out = substring_dedup.dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label at cosine 0.98 or more."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embedding_dedup.near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in whole documents."""
    found = license_scan.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["name"])))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(names, ",").alias("names"), F.array_max(F.transform("licenses", lambda x: x["containment"])).alias("best"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 benchmark words in whole documents."""
    found = decontam.find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents at Jaccard 0.85 or more on 3-word shingles."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_dedup.near_duplicates(docs, width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op8_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in one random order over 16 shards; row counts differ by one at most."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    text = text_of()
    return sharding.external_shuffle(docs, n_shards=16).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by their importance for the labelled good ones."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    return quality.resample(docs, quality.good_ids(labels), keep_text=False, bad_ids=quality.bad_ids(labels)).select("doc_id", "log_weight", "draw_key", "kept")


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_tree": op1_context_tree,
    "op2_line_dedup": op2_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_decontaminate": op6_decontaminate,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_shuffle_shards": op8_shuffle_shards,
    "op9_importance_resampling": op9_importance_resampling,
    "op10_best_two_fit": op10_best_two_fit,
}

_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, {_LOWER.format(f'trim(line, {_TRIM})')} AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.keeper IS NOT NULL AND doc_id < c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_WORDS6 = "list_filter(string_split_regex(" + _LOWER.format("coalesce(text, '')") + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS6} AS w FROM documents),
b AS (SELECT item_id, {_WORDS6} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, list_slice(w, i, i + least(10, len(w)) - 1) AS pat
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, m, i, list_slice(w, i, i + m - 1) AS pat
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT doc_id, item_id, i, s.m FROM s JOIN p ON s.pat = p.pat),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS at FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_SPLIT = r"list_filter(string_split_regex({}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
_OP3 = f"""
WITH d AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS at FROM v JOIN f USING (h) WHERE first < doc_id),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d),
s AS (SELECT k.doc_id, count(g.at) AS n_removed, string_agg(word, ' ' ORDER BY k.at) FILTER (WHERE g.at IS NULL) AS kept
      FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.at = k.at GROUP BY k.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""

_OP4 = """
WITH RECURSIVE u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.c = l.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.c) AS component_id, min(r.c) = e.vec_id AS kept
FROM embeddings e JOIN r ON r.vec_id = e.vec_id LEFT JOIN n ON n.x = e.vec_id GROUP BY e.vec_id
"""

_OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 2), ' ')) AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 85 * (a.n + b.n - m)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.c = l.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": _OP2, "op3_substring_dedup": _OP3, "op4_embedding_dedup": _OP4, "op6_decontaminate": _OP6, "op7_minhash_dedup": _OP7}
