"""The operators' registered queries: each applies one of them to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm import ann, bpe, html_text, impact, lm_score, near_dup, negatives, packing, private_data, quality, rans, runs, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    """A public vocabulary file of this machine (the operators take any path)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op2_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, each with end id 2, written as block files and digested from what is read back."""
    files = rans.write_ids(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=2)
    return rans.read_ids(spark, files, digest=True)


def op3_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the rank file and decoded again, with digests of ids and bytes."""
    import public_tokenizers

    ranks = _vocabulary("byte_bpe_50k.tiktoken")
    both = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's loss under a model of the English documents less that under one of all documents."""
    found = lm_score.score(_table(spark, sf_dir, "documents"), target=F.col("lang") == "en")
    return found.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("h_target", "h_background", "score")))


def op5_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by weak labels and the scorer learnt from them."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs))


def op7_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found for each vector whose id is divisible by 50, among all vectors."""
    e = _table(spark, sf_dir, "embeddings")
    return ann.nearest(e, e.where(F.col("vec_id") % 50 == 0))


def op8_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_bag_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dup.classes(_table(spark, sf_dir, "documents"))


def op10_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products for each vector whose id is divisible by 20, among all vectors."""
    e = _table(spark, sf_dir, "embeddings")
    return impact.top_k(e, e.where(F.col("vec_id") % 20 == 0))


def op11_threshold_join_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 3 hard negatives of each vector whose id is divisible by 50 and each of its 5 positives, among all vectors; labels of ids divisible by 7 are one off."""
    e = _table(spark, sf_dir, "embeddings")
    e = e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(e, e.where(F.col("vec_id") % 50 == 0))


def op12_seed_extend_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, whose tails are made periodic in every tenth, with digests of runs and collapsed texts."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = runs.periodic_runs(_table(spark, sf_dir, "documents"), places=runs.planted_tails).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("best.less"), F.col("best.period")
    return found.select("doc_id", "n_runs", "best.start", length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_weak_label_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document: counts and digest of the base spans, and all spans."""
    found = private_data.private_spans(_table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, private_data.KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_grouping_genetic_packing": op1_grouping_genetic_packing,
    "op2_rans_ids": op2_rans_ids,
    "op3_distinct_word_bpe": op3_distinct_word_bpe,
    "op4_cross_entropy_difference": op4_cross_entropy_difference,
    "op5_ftrl_toxicity": op5_ftrl_toxicity,
    "op6_weak_label_quality": op6_weak_label_quality,
    "op7_hash_prefix_forest": op7_hash_prefix_forest,
    "op8_line_block_text": op8_line_block_text,
    "op9_bag_minhash_near_dup": op9_bag_minhash_near_dup,
    "op10_impact_top_k": op10_impact_top_k,
    "op11_threshold_join_negatives": op11_threshold_join_negatives,
    "op12_seed_extend_runs": op12_seed_extend_runs,
    "op13_weak_label_spans": op13_weak_label_spans,
}

ORACLE_SQL: dict[str, str] = {
    "op4_cross_entropy_difference": """
        WITH d AS (
            SELECT doc_id, coalesce(lang = 'en', false) AS t,
                   list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w
            FROM documents),
        k AS (SELECT doc_id, t, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
        p AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM k),
        wc AS (SELECT w, count(*) AS n, count(*) FILTER (t) AS nt FROM k GROUP BY w),
        pc AS (SELECT v, w, count(*) AS n, count(*) FILTER (t) AS nt FROM p WHERE v IS NOT NULL GROUP BY v, w),
        wd AS (SELECT doc_id, w, count(*) AS m FROM k GROUP BY doc_id, w),
        pd AS (SELECT doc_id, v, w, count(*) AS m FROM p WHERE v IS NOT NULL GROUP BY doc_id, v, w),
        s AS (SELECT count(*) AS n, count(*) FILTER (t) AS nt FROM k),
        voc AS (SELECT count(*) + 1 AS size, s.n - coalesce(sum(wc.n), 0) AS unk, s.nt - coalesce(sum(wc.nt), 0) AS unk_t FROM s LEFT JOIN wc ON wc.n >= 2 GROUP BY s.n, s.nt),
        du AS (SELECT doc_id, sum(m) AS m FROM wd JOIN wc USING (w) WHERE n < 2 GROUP BY doc_id),
        x AS (
            SELECT p.doc_id, a.n >= 2 AS known, voc.size AS size,
                   CAST(voc.unk - coalesce(du.m, 0) AS DOUBLE) AS unk_all, CAST(voc.unk_t - (p.t::INT) * coalesce(du.m, 0) AS DOUBLE) AS unk_t,
                   CAST(a.n - am.m AS DOUBLE) AS w_all, CAST(b.n - bm.m AS DOUBLE) AS v_all, CAST(c.n - cm.m AS DOUBLE) AS p_all, CAST(s.n - len(d.w) AS DOUBLE) AS n_all,
                   CAST(a.nt - (p.t::INT) * am.m AS DOUBLE) AS w_t, CAST(b.nt - (p.t::INT) * bm.m AS DOUBLE) AS v_t, CAST(c.nt - (p.t::INT) * cm.m AS DOUBLE) AS p_t,
                   CAST(s.nt - (p.t::INT) * len(d.w) AS DOUBLE) AS n_t
            FROM p JOIN d USING (doc_id) JOIN s ON true JOIN voc ON true LEFT JOIN du USING (doc_id) JOIN wc a ON a.w = p.w JOIN wd am ON am.doc_id = p.doc_id AND am.w = p.w
            LEFT JOIN wc b ON b.w = p.v LEFT JOIN wd bm ON bm.doc_id = p.doc_id AND bm.w = p.v
            LEFT JOIN pc c ON c.v = p.v AND c.w = p.w LEFT JOIN pd cm ON cm.doc_id = p.doc_id AND cm.v = p.v AND cm.w = p.w),
        y AS (
            SELECT doc_id, known, v_all, p_all, v_t, p_t,
                   (CASE WHEN known THEN w_all ELSE unk_all END + 0.1) / (n_all + 0.1 * size) AS u_all,
                   (CASE WHEN known THEN w_t ELSE unk_t END + 0.1) / (n_t + 0.1 * size) AS u_t FROM x),
        h AS (
            SELECT doc_id, count(*) AS n_words,
                   avg(-ln(CASE WHEN v_t > 0 THEN 0.7 * CASE WHEN known THEN p_t / v_t ELSE 0 END + (1 - 0.7) * u_t ELSE u_t END)) AS h_target,
                   avg(-ln(CASE WHEN v_all > 0 THEN 0.7 * CASE WHEN known THEN p_all / v_all ELSE 0 END + (1 - 0.7) * u_all ELSE u_all END)) AS h_background
            FROM y GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(h_target, 6) AS h_target, round(h_background, 6) AS h_background, round(h_target - h_background, 6) AS score
        FROM d LEFT JOIN h USING (doc_id)""",
    "op10_impact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
        r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
    "op11_threshold_join_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
            FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                   row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same),
        n AS (
            SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
                   s.vec_id AS negative_id, positive_score, s.score AS negative_score
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
            WHERE p.r <= 5)
        SELECT * FROM n WHERE rank <= 3""",
}
