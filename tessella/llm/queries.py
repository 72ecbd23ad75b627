"""The numbered queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import byte_bpe, chat, clustering, collocations, embedding_dedup, exact_dedup, licenses, mixing, ngram_join, packing, toxicity, url_filter, warc
from tessella.llm.tables import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, read(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, conversation -1; rows that the table already has under -1 are turns of the same conversation, and turns with equal numbers are ordered by role and text."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], rows.schema)
    return chat.read_chats(chat.format_chats(rows.unionByName(probe))).withColumnRenamed("conv", "conv_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_copies(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_components(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no rule fits, the verdict is the block list's (`url_filter.BLOCKED`), which sees canonical URLs."""
    return url_filter.judge_urls(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(read(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id").drop("centroid")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(read(spark, sf_dir, "documents"), with_ids=False).withColumnRenamed("id", "doc_id").drop("ids")


def lloyd_sql(k: int, rounds: int, dim: int, scale: int, seed: int) -> str:
    """SQL of cluster_vectors, its rounds one after the other."""
    steps = [f"""
        WITH kept AS (SELECT row_number() OVER () AS v, vec_id, embedding FROM embeddings
                      WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cells AS (SELECT v, generate_subscripts(embedding, 1) AS i, CAST(floor({scale} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
        firsts AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), embedding) - 1 AS c FROM kept QUALIFY c < {k}),
        c0 AS (SELECT c, i, x FROM firsts JOIN cells USING (v))"""]
    for n in range(rounds + 1):
        steps.append(f"""
        d{n} AS (SELECT v, c, sum((cells.x - c{n}.x) * (cells.x - c{n}.x)) AS d FROM cells JOIN c{n} USING (i) GROUP BY v, c),
        a{n} AS (SELECT v, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY v ORDER BY d, c) = 1)""")
        if n < rounds:
            steps.append(f"""
        s{n} AS (SELECT c, i, sum(x) AS s, count(*) AS m FROM a{n} JOIN cells USING (v) GROUP BY c, i),
        c{n + 1} AS (SELECT c, i, CASE WHEN m IS NULL THEN x ELSE (s - ((s % m) + m) % m) // m END AS x FROM c{n} LEFT JOIN s{n} USING (c, i))""")
    return ",".join(steps) + f""",
        digests AS (SELECT c, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
        FROM a{rounds} JOIN kept USING (v) JOIN digests USING (c)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_chat_format": op3_chat_format,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_ngram_join": op6_ngram_join,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_url_filter": op9_url_filter,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op11_phrase_mining": r"""
        WITH pieces AS (
          SELECT lang, row_number() OVER () AS p, ws FROM (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM (
              SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))
          WHERE len(ws) > 0),
        places AS (SELECT lang, p, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces),
        n AS (SELECT lang, sum(len(ws)) AS n FROM pieces GROUP BY lang),
        grams AS (SELECT lang, ws[i : i + k - 1] AS g FROM places, range(1, 6) AS t(k) WHERE i + k - 1 <= len(ws)),
        f AS (SELECT lang, g, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 100),
        c AS (SELECT * FROM f WHERE len(g) >= 2),
        inner_parts AS (SELECT DISTINCT lang, g[i : i + k - 1] AS g, a FROM c, range(1, 5) AS s(i), range(2, 5) AS t(k) WHERE i + k - 1 <= len(g) AND k < len(g)),
        kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_parts x WHERE x.lang = c.lang AND x.g = c.g AND 100 * x.a >= 100 * c.a)),
        cuts AS (SELECT kept.lang, kept.g, kept.a, k, x.a AS l, y.a AS r, n, (1000 * kept.a * n) // (x.a * y.a) AS score
                 FROM kept JOIN n ON n.lang = kept.lang JOIN range(1, 5) AS t(k) ON k < len(kept.g)
                 JOIN f x ON x.lang = kept.lang AND x.g = kept.g[1 : k] JOIN f y ON y.lang = kept.lang AND y.g = kept.g[k + 1 :]),
        lowest AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
               CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM lowest QUALIFY rank <= 2000""",
    "op12_centroid_clustering": lloyd_sql(clustering.CENTROIDS, clustering.ROUNDS, clustering.DIM, clustering.SCALE, clustering.SEED),
}
