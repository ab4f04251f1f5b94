"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.llm import html_text, manifest, mixing, neighbours, ngram_join, packing, paragraphs, pii, secrets, token_cache, toxicity, vectors, whitening
from plumeline.session import use_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("doc", "doc_id")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "class_id", "n_copies", "n_links", "group_id", F.col("stays").alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def own_folder(spark: SparkSession, name: str) -> str:
    """A folder of this run in the storage that all executors share."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def deliveries(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table in two parts, as if the second came a day later; every row is in one of them."""
    second = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    return docs.where(~second), docs.where(second)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in two deliveries: the second scans only the blobs that the first one did not bring, and findings of both come from the ledger."""
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), own_folder(spark, "secret-ledger")
    for delivery in deliveries(docs):
        known = secrets.update(delivery, ledger)
    found = secrets.findings(docs, known)
    spans = F.col("spans")
    counts = [secrets.count(spans, rule.kind).alias(f"n_{rule.kind}") for rule in secrets.RULES]
    listed = secrets.digest(spans)
    return found.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    spans = F.col("spans")
    counts = [secrets.count(spans, kind).alias(f"n_{kind}") for kind in pii.KINDS]
    base = pii.digest(F.filter(spans, lambda s: s["kind"] != "term"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.digest(spans).alias("spans"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, in training order by the first position at which the mix takes it; documents that it does not take come last."""
    found = mixing.sorted_by_position(mixing.assigned(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    position = F.round(F.get("_mx_copies", 0)["position"], 6).alias("position")
    return found.select("doc_id", "size", "source_size", "target", "taken", position)


# The categories that the table `labels` tells apart, in the order of the chain.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fitted(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.scored(docs, chain).select("doc_id", "p_low_quality", "p_toxic", F.col("rejected").alias("toxic"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest.manifest(table(spark, sf_dir, "documents"), tamper=manifest.tampered_every_third)
    folded = made.withColumn("folded_root", manifest.folded(F.col("told"), "proof"))
    proof = F.sha2(manifest.listed("proof").cast("binary"), 256).alias("proof_sha256")
    return folded.select(F.col("doc").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in two deliveries: the second finds the counts of texts that the first one stored, and both read the same cache at the end."""
    docs, cache = table(spark, sf_dir, "documents").select("doc_id", "text"), own_folder(spark, "token-counts")
    for delivery in deliveries(docs):
        token_cache.update(delivery, cache, tokenizer_path())
    return token_cache.counted(docs, cache, tokenizer_path()).withColumnRenamed("doc", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op8_paragraph_dedup": op8_paragraph_dedup,
    "op9_pii": op9_pii,
    "op10_main_text": op10_main_text,
    "op5_source_mix": op5_source_mix,
    "op6_toxicity": op6_toxicity,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op11_whitening": op11_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_counts": op13_token_counts,
}

# Kind, pattern, group, least length and position in the list, as the contract gives them.
_SECRET_RULES = r"""(VALUES
    ('assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6, 0),
    ('access', 'AKIA[A-Z0-9]+', 0, 20, 1),
    ('hex', '[0-9a-f]{24,}', 0, 24, 2)) r(kind, pattern, part, least, pos)"""

SQL: dict[str, str] = {
    "op4_secret_scan": r"""
        WITH m AS (
            SELECT doc_id, coalesce(text, '') AS text, kind, pos, part, least, pattern,
                CASE pos WHEN 0 THEN regexp_extract_all(coalesce(text, ''), '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
                    ELSE regexp_extract_all(coalesce(text, ''), pattern) END AS found,
                string_split_regex(coalesce(text, ''), pattern) AS between
            FROM documents, """
    + _SECRET_RULES
    + r"""
        ),
        e AS (
            SELECT doc_id, kind, pos, part, least, pattern, unnest(found) AS match,
                unnest(list_transform(range(1, len(found) + 1), lambda i: list_sum(list_transform(between[1:i], lambda x: len(x)))
                    + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0)))::INTEGER AS start
            FROM m
        ),
        s AS (
            SELECT doc_id, kind, pos, start, start + len(match) AS stop FROM e
            WHERE len(CASE pos WHEN 0 THEN regexp_extract(match, pattern, 2) ELSE match END) >= least
        ),
        l AS (
            SELECT doc_id, count(*) FILTER (WHERE pos = 0) AS a, count(*) FILTER (WHERE pos = 1) AS k, count(*) FILTER (WHERE pos = 2) AS h,
                string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, pos) AS spans
            FROM s GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
            sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN l USING (doc_id)
    """,
    "op5_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS mark
            FROM documents
        ),
        s AS (
            SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total,
                CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight,
                (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class
            FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
        ),
        filled AS (  -- in the order in which a rising level meets the caps
            SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER before, 0))
                / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM s WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ),
        water AS (SELECT arg_min(level, cap / weight) AS level FROM filled WHERE level * weight <= cap),
        aims AS (
            SELECT source, source_size, class, least(cap, weight * (SELECT level FROM water)) AS target FROM filled
        ),
        r AS (
            SELECT d.*, a.source_size, a.class, a.target, floor(a.target + 0.5)::BIGINT AS most,
                (sum(size) OVER (PARTITION BY d.source ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
            FROM d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source
        )
        SELECT doc_id, size, source_size, target,
            (greatest(0, least(size, most - start)) + greatest(0, least(size, most - start - source_size)))::BIGINT AS taken,
            round(CASE WHEN size = 0 OR start >= most THEN NULL
                WHEN class = 0 THEN 2 * (start / most) / (1.5 + sqrt(2.25::DOUBLE - 2 * (start / most)))
                WHEN class = 1 THEN start / most
                ELSE 2 * (start / most) / (0.5 + sqrt(0.25::DOUBLE + 2 * (start / most))) END, 6) AS position
        FROM r
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce('=' || lang, '-') AS tree, concat(f.id, f.source, f.lang, f.n_chars) AS head, text,
                -- CRC-32 of the decimal digits, bit by bit: a byte is marked by 256, a shift is 0
                doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                    lambda c: list_prepend((256 + ord(c))::BIGINT, list_transform(range(8), lambda i: 0::BIGINT))))),
                    lambda a, b: CASE WHEN b > 0 THEN xor(a, b - 256) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END),
                    4294967295::BIGINT) % 3 = 0 AS tampered
            FROM (SELECT *, {'id': coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), 'source': coalesce(strlen(source) || ':' || source, '-'),
                'lang': coalesce(strlen(lang) || ':' || lang, '-'), 'n_chars': coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')} AS f FROM documents)
        ),
        l AS (
            SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                CASE WHEN tampered THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS told
            FROM d
        ),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n,
                row_number() OVER () AS line
            FROM l
        ),
        nodes(tree, level, idx, n, digest) AS (
            SELECT tree, 0, rank, n, leaf FROM r
            UNION ALL
            SELECT tree, level + 1, idx // 8, n, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 8::BIGINT ** level GROUP BY tree, level, idx // 8, n
        ),
        s AS (
            SELECT *, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n
            FROM (SELECT tree, arg_max(digest, level) AS subroot, max(level) AS top FROM nodes GROUP BY tree)
        ),
        over_nodes(level, idx, n, digest) AS (
            SELECT 0, rank, n, subroot FROM s
            UNION ALL
            SELECT level + 1, idx // 8, n, sha256(string_agg(digest, '' ORDER BY idx)) FROM over_nodes WHERE n > 8::BIGINT ** level GROUP BY level, idx // 8, n
        ),
        sides AS (
            SELECT line, x.level, coalesce(string_agg(x.digest, '' ORDER BY x.idx) FILTER (WHERE x.idx < r.rank // (8::BIGINT ** x.level)::BIGINT), '') AS before,
                coalesce(string_agg(x.digest, '' ORDER BY x.idx) FILTER (WHERE x.idx > r.rank // (8::BIGINT ** x.level)::BIGINT), '') AS after
            FROM r JOIN s USING (tree) JOIN nodes x ON x.tree = r.tree AND x.level < s.top AND x.idx // 8 = r.rank // (8::BIGINT ** (x.level + 1))::BIGINT
            GROUP BY line, x.level
            UNION ALL
            SELECT line, s.top + x.level, coalesce(string_agg(x.digest, '' ORDER BY x.idx) FILTER (WHERE x.idx < s.rank // (8::BIGINT ** x.level)::BIGINT), ''),
                coalesce(string_agg(x.digest, '' ORDER BY x.idx) FILTER (WHERE x.idx > s.rank // (8::BIGINT ** x.level)::BIGINT), '')
            FROM r JOIN s USING (tree) JOIN over_nodes x ON x.idx // 8 = s.rank // (8::BIGINT ** (x.level + 1))::BIGINT
            WHERE x.n > 8::BIGINT ** x.level
            GROUP BY line, s.top, x.level
        ),
        folded(line, level, digest) AS (
            SELECT line, 0, coalesce(told, leaf) FROM r
            UNION ALL
            SELECT line, level + 1, sha256(before || digest || after) FROM folded JOIN sides USING (line, level)
        ),
        ends AS (SELECT line, arg_max(digest, level) AS folded_root FROM folded GROUP BY line),
        proofs AS (SELECT line, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM sides GROUP BY line)
        SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM r JOIN s USING (tree) JOIN ends USING (line) LEFT JOIN proofs USING (line), (SELECT arg_max(digest, level) AS root FROM over_nodes)
    """,
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ),
        reach(vec_id, other) AS (
            SELECT vec_id, vec_id FROM v
            UNION
            SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
        ),
        least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
        counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT l.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, l.vec_id = l.component_id AS kept
        FROM least l LEFT JOIN counted c USING (vec_id)
    """,
}
