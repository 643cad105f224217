"""The queries opN_<name> of this subpackage, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, new_path


#: Scores from here on count as good.
QUALITY_THRESHOLD = 0.3


def bpe_path() -> str:
    """The vocabulary that the contracts of packing and token files name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shard_rows(docs, 16, seed=1)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    pieces = pack_documents(_table(spark, sf_dir, "documents"), bpe_path(), end_id=1, capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import Rule, judge_urls

    rules = [Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/")]
    return judge_urls(_table(spark, sf_dir, "pages"), rules)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, with_crc32, write_token_files

    path = new_path(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), path, bpe_path(), end_id=2)
    return with_crc32(read_token_files(spark, path))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import with_leaks

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = with_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return leaks.filter(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out(F.col("doc_id")))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, _table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_neighbours

    return format_neighbours(_table(spark, sf_dir, "conversations"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import branched, prefix_trie

    return prefix_trie(branched(_table(spark, sf_dir, "conversations")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets, fit

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_crf")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_url_filter": op3_url_filter,
    "op4_token_files": op4_token_files,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_nearest": op7_nearest,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality": op9_quality,
    "op10_preferences": op10_preferences,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_secrets": op13_secrets,
}
ORACLE_SQL: dict[str, str] = {
    "op10_preferences": """
WITH said AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, conv_id,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), met AS (
  SELECT pair_id, pos, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same
  FROM said GROUP BY pair_id, pos
), cut AS (
  SELECT pair_id, coalesce(min(pos) FILTER (NOT same), max(pos) + 1) AS prefix_turns FROM met GROUP BY pair_id
), drawn AS (
  SELECT *, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
  FROM said JOIN cut USING (pair_id)
), placed AS (
  SELECT *, coalesce(sum(length(shown)) FILTER (pos >= prefix_turns) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM drawn
), spans AS (
  SELECT *, (first + length(head))::VARCHAR || '-' || (first + length(shown))::VARCHAR AS span FROM placed
)
SELECT pair_id, max(conv_id) FILTER (side = 0) AS chosen_id, max(conv_id) FILTER (side = 1) AS rejected_id,
       CAST(min(prefix_turns) AS INTEGER) AS prefix_turns,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 0 AND pos < prefix_turns), '') AS prompt,
       CASE WHEN count(*) FILTER (side = 0) > 0 THEN coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 0 AND pos >= prefix_turns), '') END AS chosen,
       CASE WHEN count(*) FILTER (side = 1) > 0 THEN coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 1 AND pos >= prefix_turns), '') END AS rejected,
       CASE WHEN count(*) FILTER (side = 0) > 0 THEN coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 0 AND pos >= prefix_turns AND role = 'assistant'), '') END AS chosen_spans,
       CASE WHEN count(*) FILTER (side = 1) > 0 THEN coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 1 AND pos >= prefix_turns AND role = 'assistant'), '') END AS rejected_spans
FROM spans GROUP BY pair_id
""",
    # crc32 of the decimal id, a byte and eight shifts at a time; a conversation
    # counts for a node's saved words and leaves from where it is not its least member.
    "op11_prefix_trie": r"""
WITH said AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 20 AS base, xor(crc, 4294967295) % 4 AS h FROM (
    SELECT c, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: list_prepend(ascii(x)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS crc
    FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL))
), lengths AS (SELECT conv_id, count(*) AS n FROM said GROUP BY conv_id
), built AS (
  SELECT c, pos + 1 AS depth, role, text FROM convs JOIN said ON conv_id = base WHERE pos < h
  UNION ALL SELECT c, pos - h + least(h, coalesce(n, 0)) + 1, role, text FROM convs JOIN said ON said.conv_id = c LEFT JOIN lengths ON lengths.conv_id = base WHERE pos >= h
), paths AS (
  SELECT c, depth, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY depth)) AS node, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM built
  UNION ALL SELECT c, 0, '', 0 FROM convs
), members AS (
  SELECT c, depth, node, words, min(c) OVER (PARTITION BY node, depth) AS least, depth = max(depth) OVER (PARTITION BY c) AS ends, lag(node) OVER (PARTITION BY c ORDER BY depth) AS above FROM paths
), tops AS (
  SELECT node, depth, bool_and(ends) AS childless FROM members GROUP BY node, depth
), sums AS (
  SELECT m.*, sum(CASE WHEN c > least THEN words ELSE 0 END) OVER later AS saved, max(CASE WHEN c = least AND childless THEN 1 ELSE 0 END) OVER later AS leaf
  FROM members m JOIN tops USING (node, depth) WINDOW later AS (PARTITION BY c ORDER BY depth DESC)
), nodes AS (
  SELECT node, depth, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS enders
  FROM sums GROUP BY node, depth
), kids AS (SELECT above AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, n.n_leaves, n.saved_tokens, sha256(n.enders) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.above AND p.depth = n.depth - 1 LEFT JOIN kids k ON k.node = n.node
""",
    "op12_lexical_search": r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counts AS (SELECT doc, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY doc, term
), docs AS (SELECT doc, sum(tf)::BIGINT AS n FROM counts GROUP BY doc
), size AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counts WHERE term IN (SELECT term FROM asked) GROUP BY term), size
), scores AS (
  SELECT item_id, doc, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN docs USING (doc), size GROUP BY item_id, doc
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM scores WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 50
""",
}
