"""The registered queries of the package, over whole tables with the settings meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.alignment import aligned_documents
from tracewell.llm.chat import formatted_conversations
from tracewell.llm.common import table
from tracewell.llm.jaccard import similar_components
from tracewell.llm.lines import dedup_lines
from tracewell.llm.merkle import tampered_manifest
from tracewell.llm.multi_index import nearest_neighbours
from tracewell.llm.packing import packed_documents
from tracewell.llm.pieces import encoding_digests
from tracewell.llm.pitman_yor import score_documents
from tracewell.llm.sketches import compared_fingerprints
from tracewell.llm.surrogates import with_surrogates
from tracewell.llm.toxicity import toxicity
from tracewell.llm.warc import archived_pages
from tracewell.session import RUNTIME_CONF

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            for key, value in RUNTIME_CONF.items():
                spark.conf.set(key, value)
            return build(spark, folder)

        LLM_QUERIES[name] = run
        if sql is not None:
            LLM_ORACLES[name] = sql
        return build

    return register


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the public tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_sentencepiece")
def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_digests(table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op10_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op5_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return similar_components(table(spark, folder, "documents"))


@query("op9_pitman_yor")
def pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"))


@query("op1_inverted_multi_index")
def inverted_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"))


@query("op6_toxicity")
def weak_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op7_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    g AS (SELECT html, max(page_id) AS kept FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html HAVING count(*) > 1)
    SELECT page_id, octet_length(encode(p.html)) AS payload_bytes, sha1(p.html) AS payload_digest,
        CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN kept <> page_id THEN kept END AS refers_to
    FROM p LEFT JOIN g ON p.html = g.html
    """,
)
def warc(spark: SparkSession, folder: str) -> DataFrame:
    return archived_pages(table(spark, folder, "pages"))


@query("op4_scaled_sketch")
def scaled_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return compared_fingerprints(table(spark, folder, "documents"))


@query(
    "op8_line_dedup",
    r"""
    WITH doc_lines AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    word_sets AS (
        SELECT doc_id, pos, line, list_distinct(list_filter(string_split(translate(line, chr(9) || chr(13), '  '), ' '), lambda w: w <> '')) AS words FROM doc_lines),
    long_lines AS (SELECT doc_id, pos, words, len(words) AS n FROM word_sets WHERE len(words) >= 5),
    frequency AS (SELECT unnest(words) AS word, count(*) AS f FROM long_lines GROUP BY 1),
    tokens AS (SELECT doc_id, pos, n, unnest(words) AS word FROM long_lines),
    ranked AS (
        SELECT t.*, row_number() OVER (PARTITION BY doc_id, pos ORDER BY f, word) AS r FROM tokens t JOIN frequency USING (word)),
    prefixes AS (SELECT doc_id, pos, n, word FROM ranked WHERE r <= n - ceil(n * 0.75) + 1),
    pairs AS (
        SELECT DISTINCT x.doc_id AS xd, x.pos AS xp, y.doc_id AS yd, y.pos AS yp FROM prefixes x JOIN prefixes y ON x.word = y.word
        WHERE (y.doc_id, y.pos) < (x.doc_id, x.pos) AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)),
    gone AS (
        SELECT DISTINCT xd, xp FROM pairs JOIN long_lines a ON a.doc_id = xd AND a.pos = xp JOIN long_lines b ON b.doc_id = yd AND b.pos = yp
        WHERE 100 * len(list_intersect(a.words, b.words)) >= 75 * (a.n + b.n - len(list_intersect(a.words, b.words)))),
    kept AS (
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (xp IS NULL), '') AS text, count(xp) AS lines_removed
        FROM doc_lines LEFT JOIN gone ON doc_id = xd AND pos = xp GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(lines_removed, 0) AS lines_removed
    FROM documents d LEFT JOIN kept k USING (doc_id)
    """,
)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents"), count_col="lines_removed").select("doc_id", "text", "lines_removed")


@query("op2_pii_surrogates")
def pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return with_surrogates(table(spark, folder, "documents"), count_col="entities").select("doc_id", "text", "entities")


@query("op12_token_alignment")
def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return aligned_documents(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def _leaf_sql(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


@query(
    "op13_merkle_manifest",
    f"""
    WITH RECURSIVE leaves AS MATERIALIZED (
        SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
        FROM (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
            CASE WHEN xor(list_reduce([4294967295] || list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))),
                lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
                4294967295) % 3 = 0
            THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents)),
    low AS (
        SELECT 0 AS lvl, lang, pos, leaf AS h, n FROM leaves
        UNION ALL
        SELECT lvl + 1, lang, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM low WHERE n > 1 GROUP BY lvl, lang, pos // 8),
    subroots AS MATERIALIZED (SELECT lang, lvl AS depth, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
    high AS (
        SELECT 0 AS lvl, pos, h, n FROM subroots
        UNION ALL
        SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM high WHERE n > 1 GROUP BY lvl, pos // 8),
    low_runs AS (SELECT lang, lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM low WHERE n > 1 GROUP BY ALL),
    high_runs AS (SELECT lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM high WHERE n > 1 GROUP BY ALL),
    steps AS MATERIALIZED (
        SELECT rid, step, array_to_string(hs[1:k], '') AS before, array_to_string(hs[k + 2:], '') AS after FROM (
            SELECT rid, lvl AS step, hs, (pos >> (3 * lvl)) % 8 AS k FROM leaves l JOIN low_runs r ON l.lang IS NOT DISTINCT FROM r.lang AND r.run = l.pos >> (3 * lvl + 3)
            UNION ALL
            SELECT rid, depth + lvl, hs, (s.pos >> (3 * lvl)) % 8 FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN high_runs r ON r.run = s.pos >> (3 * lvl + 3))),
    folded AS (
        SELECT rid, 0 AS step, coalesce(changed, leaf) AS h FROM leaves
        UNION ALL
        SELECT rid, f.step + 1, sha256(before || h || after) FROM folded f JOIN steps USING (rid, step)),
    tops AS (SELECT rid, arg_max(h, step) AS folded_root FROM folded GROUP BY rid),
    proofs AS (SELECT rid, string_agg(before || after, '' ORDER BY step) AS proof FROM steps GROUP BY rid)
    SELECT l.doc_id, l.leaf, s.h AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN tops USING (rid) LEFT JOIN proofs USING (rid), (SELECT h AS root FROM high WHERE n = 1)
    """,
)
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return tampered_manifest(table(spark, folder, "documents"))


@query(
    "op11_chat_format",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    sized AS (
        SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
            + len(regexp_extract_all(text, '</?s>|<</?SYS>>|\[/?(INST|ROLE|NONE)\]|\[TEXT\]'))
            + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE coalesce(23 + length(role), 17) END AS chars
        FROM turns)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, md5(coalesce('r' || role, 'n') || chr(10) || text))) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, md5(coalesce('r' || role, 'n') || chr(10) || text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
    """,
)
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one that says control strings."""
    says = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return formatted_conversations(rows.unionByName(extra))
