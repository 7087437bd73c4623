"""The registered queries of this subpackage: thin calls of the operators over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm import byte_bpe, containment, disclosure, html_cut, line_dedup, mixing, order_minhash, prefix_trie, quality_ledger, secret_scan, token_store, variants, warc

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.digests(token_store.store(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(table(spark, sf_dir, "pages"))


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_ledger.ledger(table(spark, sf_dir, "documents"))
    base_failed = ~quality_ledger.passes("base@1")
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *measures, base_failed.alias("base_failed"), quality_ledger.passes().alias("kept"), "failed")


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.scan(table(spark, sf_dir, "documents")).drop("row_")


def op11_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.damaged_counts(table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digests(*prefix_trie.trie(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_source_mix, op3_warc_revisits, op4_order_minhash, op5_line_dedup,
        op6_token_store, op7_html_cut, op8_quality_ledger, op9_benchmark_leaks, op10_disclosure, op11_forced_boundary_bpe,
        op12_spelling_variants, op13_prefix_trie,
    )
}

def _crc_table() -> str:
    """CRC-32 of the sixteen half bytes, as a SQL list."""
    row = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        row.append(c)
    return str(row)


def crc32_sql(value: str) -> str:
    """CRC-32 of the UTF-8 of a SQL string expression: half bytes, the lower one of each byte first."""
    digits = f"list_transform(range(strlen({value}) * 2), lambda i: instr('0123456789ABCDEF', substr(hex(encode({value})), i + 1 + (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END), 1)) - 1)"
    step = f"lambda c, d: xor(c >> 4, ({_crc_table()}::BIGINT[])[1 + (xor(c, d) & 15)])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({digits}, lambda d: d::BIGINT)), {step}), 4294967295::BIGINT)"


_PAYLOADS = "SELECT page_id, coalesce(html, '') AS payload FROM pages"

ORACLES = {
    "op3_warc_revisits": f"""
        WITH p AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest FROM ({_PAYLOADS})),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op5_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
        ), k AS (
            SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
        ), f AS (
            SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
        ), d AS (
            SELECT k.*, first_id IS NOT NULL AND first_id <> doc_id AS dropped FROM k LEFT JOIN f USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM d GROUP BY doc_id
    """,
    "op12_spelling_variants": f"""
        WITH r AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents) GROUP BY ALL
        ), h AS (
            SELECT run, c, {crc32_sql("key")} AS h FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM r)
        ), v AS MATERIALIZED (
            SELECT word, sum(c)::BIGINT AS n FROM (
                SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h
            ) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
        ), d AS MATERIALIZED (
            SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)
        ), p AS (
            SELECT a.word AS word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT d.word, v.word FROM d JOIN v ON d.rest = v.word
            UNION SELECT v.word, d.word FROM d JOIN v ON d.rest = v.word
        ), s AS (
            SELECT p.word, count(*) AS n_near, arg_min(near, (-n, near)) AS best, max(n) AS best_n FROM p JOIN v ON p.near = v.word GROUP BY p.word
        ), f AS MATERIALIZED (
            SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
            FROM v LEFT JOIN s ON v.word = s.word
        ), u AS (
            WITH RECURSIVE way AS (
                SELECT word, form AS top, 1 AS d FROM f WHERE form IS NOT NULL
                UNION ALL SELECT way.word, f.form, d + 1 FROM way JOIN f ON f.word = way.top WHERE f.form IS NOT NULL
            ) SELECT word, arg_max(top, d) AS root FROM way GROUP BY word
        )
        SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN u ON f.word = u.word
    """,
    "op13_prefix_trie": f"""
        WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i FROM o),
        c AS (SELECT conv_id, conv_id - conv_id % 100 AS stem, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
        r AS (
            SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = stem AND i <= h
            UNION ALL SELECT c.conv_id, h + i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h
        ), d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth FROM r),
        p AS MATERIALIZED (
            SELECT conv_id, depth, length(text) AS chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY depth)
                OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM d
            UNION ALL SELECT conv_id, 0, 0, '' FROM c
        ), n AS MATERIALIZED (
            SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY depth, path
        ), w AS MATERIALIZED (
            SELECT n.*, u.path AS parent_path, v.conv_id AS parent_conv_id
            FROM n LEFT JOIN p u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1 LEFT JOIN n v ON v.path = u.path AND v.depth = u.depth
        ), k AS (SELECT depth - 1 AS depth, parent_path AS path, count(*) AS n_children FROM w WHERE depth > 0 GROUP BY ALL),
        s AS (
            SELECT a.depth, a.path, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
            FROM n LEFT JOIN k ON k.path = n.path AND k.depth = n.depth JOIN p a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.depth, a.path
        ), e AS (
            SELECT depth, path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
            FROM (SELECT conv_id, max(depth) AS depth, arg_max(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY depth, path
        )
        SELECT w.conv_id, w.depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
        FROM w JOIN s ON s.path = w.path AND s.depth = w.depth LEFT JOIN k ON k.path = w.path AND k.depth = w.depth LEFT JOIN e ON e.path = w.path AND e.depth = w.depth
    """,
}
