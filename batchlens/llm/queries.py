"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm.centroids import cluster_vectors
from batchlens.llm.counting import token_counts
from batchlens.llm.decontam import leaks
from batchlens.llm.filteraudit import audit_filters
from batchlens.llm.lattice import lattice_scores
from batchlens.llm.licences import scan_licences
from batchlens.llm.neardup import near_duplicates
from batchlens.llm.packing import pack
from batchlens.llm.passages import repeated_passages
from batchlens.llm.pii import replace_entities
from batchlens.llm.quality import quality_rules
from batchlens.llm.substrings import remove_repeats
from batchlens.llm.topk import top_k
from batchlens.sources.shared import run_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_bpe(), capacity=2048, end_id=0)


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, which is empty at first."""
    return token_counts(table(spark, sf_dir, "documents"), byte_bpe(), run_folder(spark, "token-cache"), limit=1024)


@query()
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_entities`` and the text without its personal data; the key would come from a vault."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, key="example-key").select("doc_id", "text", "n_entities")


@query()
def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"), threshold=0.8)


@query()
def op10_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), rounds=2)


@query()
def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8)


@query()
def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


@query()
def op5_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that two documents share, up to a fifth of their words; a row for each side."""
    found = repeated_passages(table(spark, sf_dir, "documents"), min_words=50, identity=0.8)
    side = lambda own, other: F.struct(
        F.col(f"doc_{own}").alias("doc_id"), F.col(f"start_{own}").alias("start"), F.col(f"words_{own}").alias("n_words"),
        F.col(f"doc_{other}").alias("partner_id"), F.col(f"start_{other}").alias("partner_start"),
        F.col(f"words_{other}").alias("partner_words"), "n_equal",
    )
    return found.select(F.inline(F.array(side("a", "b"), side("b", "a"))))


@query()
def op4_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS double)) AS bigint))"
_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _clusters_sql(clusters: int, rounds: int) -> str:
    """Each round: all squared distances, the nearest centroid of each vector, the mean of each cluster by component."""
    square = "list_sum(list_transform(list_zip(v.q, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, {_WHOLE} AS q FROM embeddings WHERE {_USABLE} AND len(embedding) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), q) - 1 AS k, q AS p FROM v"
        f" ORDER BY k LIMIT {clusters})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT uid, min(struct_pack(d := d, k := k)) AS s FROM"
            f" (SELECT v.uid, c.k, CAST({square} AS bigint) AS d FROM v, c{r} c) GROUP BY uid)"
        )
        if r < rounds:
            parts.append(
                f"m{r} AS MATERIALIZED (SELECT k, list(m ORDER BY i) AS p FROM (SELECT s.k AS k, i,"
                " CAST(CASE WHEN sum(x) % count(*) < 0 THEN sum(x) // count(*) - 1 ELSE sum(x) // count(*) END AS bigint) AS m FROM"
                f" (SELECT a.s, unnest(v.q) AS x, unnest(range(64)) AS i FROM a{r} a JOIN v USING (uid)) GROUP BY s.k, i) GROUP BY k)"
            )
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.p, c.p) AS p FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k)")
    last = f"a{rounds}"
    return (
        f"WITH {', '.join(parts)} SELECT v.vec_id, CAST(a.s.k AS integer) AS cluster, a.s.d AS distance,"
        " CAST(sum(a.s.d) OVER (PARTITION BY a.s.k) AS bigint) AS cluster_inertia, CAST(sum(a.s.d) OVER () AS bigint) AS inertia,"
        f" sha256(array_to_string(c.p, ',')) AS centroid_sha256 FROM {last} a JOIN v USING (uid) JOIN c{rounds} c ON c.k = a.s.k"
    )


@query(_clusters_sql(40, 5))
def op11_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, dimensions=64, prefix="2:")


@query(
    f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, {_WHOLE} AS q FROM embeddings WHERE {_USABLE}),
    s AS (SELECT a.uid, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS bigint) AS score
          FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.uid <> b.uid),
    t AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS integer) AS rank, vec_id, score FROM t WHERE rank <= 5"""
)
def op12_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


_WORDS = r"[^\x20\x09-\x0D]+"


@query(
    rf"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '{_WORDS}') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
    l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, quality, toxic, [
            len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
            100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
            coalesce(doc_id > least, false)] AS fails FROM w LEFT JOIN l USING (doc_id)),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM x a, x b, x d, x e, x g
          WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
    m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f GROUP BY part, fails),
    s AS (SELECT m.*, filter_order, step, fails[ascii(filter_order[step]) - 64] AS own, len(list_filter(fails, lambda y: y)) AS failed,
            len(list_filter(range(1, step), lambda k: fails[ascii(filter_order[k]) - 64])) > 0 AS earlier
          FROM m, o, (SELECT CAST(unnest(range(1, 6)) AS integer) AS step)),
    p AS (SELECT part, filter_order[step] AS letter, sum(n) FILTER (own AND NOT earlier) AS shapley FROM s GROUP BY ALL),
    r AS (SELECT part, filter_order, step,
            coalesce(sum(n) FILTER (NOT own AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT earlier), 0) AS removed,
            coalesce(sum(n) FILTER (own AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (own AND failed = 1), 0) AS unique_fails,
            coalesce(sum(good) FILTER (own AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT earlier), 0) AS toxic_lost
          FROM s GROUP BY ALL)
    SELECT r.part, filter_order, step, CAST(kept AS bigint) AS kept, CAST(removed AS bigint) AS removed, CAST(redundant AS bigint) AS redundant,
      CAST(unique_fails AS bigint) AS unique_fails, CAST(good_lost AS bigint) AS good_lost, CAST(toxic_lost AS bigint) AS toxic_lost,
      CAST(coalesce(shapley, 0) AS bigint) AS shapley FROM r JOIN p ON r.part = p.part AND r.filter_order[r.step] = p.letter"""
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
