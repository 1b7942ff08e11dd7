"""The queries of this subpackage: one per operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import byte_bpe, chat, embedding_dedup, fim, importance, jaccard_join, line_dedup, lm_score, mixing, packing, quality, token_count, warc
from corvid.llm.shared import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents, their places in bins and in the sequences of bins, and digests of the sequences."""
    return packing.packed_pieces(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those removed, what is left in characters and as a digest, and whether nothing is."""
    found = line_dedup.without_later_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"), "emptied")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents")).drop("failed_rule")  # which rule came first depends on measured costs


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).drop("epochs", "cut")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of documents, with digests of outputs and of the texts rebuilt from them."""
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_byte_bpe, op3_embedding_dedup, op4_best_fit_packing, op5_chat_formatting, op6_line_dedup, op7_quality_rules, op8_warc, op9_jaccard_join, op10_lm_scoring,
        op11_mixing, op12_fill_in_middle, op13_importance_resampling,
    )
}

_COMPONENTS = """reach AS (SELECT id, id AS r FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
    component AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""

#: Of a source's random keys, the first 15 hex digits; the water level of the targets by rounds, as the contract words it.
_MIXTURE = r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '~') AS g, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
            substr(sha256('mix:' || doc_id), 1, 15) AS key FROM documents),
        s AS (SELECT g, CAST(sum(size) AS BIGINT) AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY encode(g)) - 1) % 3 + 1] AS w FROM d GROUP BY g),
        level AS (SELECT 0 AS round, (SELECT 1.5 * sum(source_size) / sum(w) FROM s) AS x
            UNION ALL SELECT round + 1, (SELECT (1.5 * sum(source_size) - coalesce(sum(2 * source_size) FILTER (w * x > 2 * source_size), 0)) / sum(w) FILTER (NOT w * x > 2 * source_size) FROM s) FROM level
            WHERE round < (SELECT count(*) FROM s)),
        t AS (SELECT g, source_size, least(w * (SELECT x FROM level ORDER BY round DESC LIMIT 1), CAST(2 * source_size AS DOUBLE)) AS target FROM s),
        b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget FROM t),
        c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs, budget,
            CAST(coalesce(sum(size) OVER (PARTITION BY d.g ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d JOIN b ON b.g = d.g)
        SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM c
    """

_UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

ORACLE = {
    "op11_mixing": _MIXTURE,
    "op12_fill_in_middle": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_UNITS}') AS u, sha256('42:' || doc_id) AS h FROM documents),
        n AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS r FROM d),
        k AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
        p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM k)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256 FROM p
    """,
    "op3_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), nodes AS (SELECT id FROM v),
        links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.95), {_COMPONENTS},
        degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN degree ON a = id
    """,
    "op5_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 13 AS chars FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op6_line_dedup": r"""
        WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
        w AS (SELECT doc_id, no, line, list_filter(string_split(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM l),
        g AS (SELECT DISTINCT doc_id, no, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, no, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
            UNION ALL SELECT doc_id, no, array_to_string(w, ' ') || ' short' FROM w WHERE len(w) BETWEEN 1 AND 4),
        n AS (SELECT doc_id, no, count(*) AS n FROM g GROUP BY ALL),
        m AS (SELECT x.doc_id AS xd, x.no AS xn, y.doc_id AS yd, y.no AS yn, count(*) AS same FROM g x JOIN g y ON x.g = y.g AND (x.doc_id < y.doc_id OR (x.doc_id = y.doc_id AND x.no < y.no)) GROUP BY ALL),
        gone AS (SELECT DISTINCT yd AS doc_id, yn AS no FROM m JOIN n a ON a.doc_id = xd AND a.no = xn JOIN n b ON b.doc_id = yd AND b.no = yn WHERE 100 * same >= 80 * (a.n + b.n - same)),
        kept AS (SELECT w.doc_id, string_agg(line, chr(10) ORDER BY w.no) FILTER (gone.no IS NULL) AS text, count(*) AS n_lines, count(gone.no) AS n_removed, bool_or(gone.no IS NULL AND len(w) >= 1) AS any_left
            FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.no = w.no GROUP BY w.doc_id)
        SELECT doc_id, n_lines, n_removed, CAST(length(coalesce(text, '')) AS BIGINT) AS kept_chars, sha256(coalesce(text, '')) AS kept_sha256, n_removed > 0 AND NOT any_left AS emptied FROM kept
    """,
    "op7_quality_rules": r"""
        WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
        f AS (SELECT d.doc_id, w, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
            len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
            len(list_filter(w, lambda x: x LIKE '%!!')) AS shouted, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stuttered, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS lettered FROM f)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT (base_failed OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.5 * n_lines OR shouted > 0.1 * n_words OR stuttered > 0.3 * n_words OR lettered < 0.4 * n_words) AS kept FROM b
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, coalesce(html, '') AS html FROM pages),
        latest AS (SELECT html, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY html)
        SELECT p.page_id, url, payload_bytes, sha1(p.html) AS payload_digest,
            CASE WHEN top IS NULL OR top = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN top IS NULL OR top = p.page_id THEN NULL ELSE top END AS refers_to
        FROM p JOIN pages USING (page_id) LEFT JOIN latest ON latest.html = p.html AND payload_bytes >= 1000
    """,
    "op9_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
            UNION ALL SELECT doc_id, array_to_string(w, ' ') || ' short' FROM d WHERE len(w) BETWEEN 1 AND 4)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        nodes AS (SELECT doc_id AS id FROM documents),
        links AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)), {_COMPONENTS}
        SELECT id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM component LEFT JOIN n ON n.doc_id = id
    """,
}
