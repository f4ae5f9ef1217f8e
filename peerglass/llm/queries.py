"""One query per operator over the whole tables, and SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerglass.llm import (
    alignment,
    chat,
    exact_dedup,
    fingerprint,
    langid,
    line_dedup,
    minhash,
    mixing,
    packing,
    pseudo_likelihood,
    spelling,
    topk,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, twin: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if twin:
            ORACLES[name] = twin
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: packing ------------------------------------------------------------


@query("op1_mixture_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


# --- 2: exact top-k search -------------------------------------------------

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)
)
SELECT query_id,
  (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id, score
FROM s
QUALIFY rank <= 5
"""


@query("op2_exact_top_k", TOP_K_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


# --- 3: line dedup ---------------------------------------------------------

LINES_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL
), spaced AS (
  SELECT doc_id, line_no,
    trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS s FROM raw
), lines AS (
  SELECT doc_id, line_no, len(string_split(s2, ' ')) > 50 AS long, s2 AS body, string_split(s2, ' ') AS tokens,
    len(string_split(s2, ' ')) || ' ' ||
      array_to_string(list_slice(string_split(s2, ' '), 1, 3), ' ') AS leaf
  FROM (SELECT *, regexp_replace(s, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS s2 FROM spaced)
  WHERE s2 <> ''
), kinds AS (
  SELECT leaf, body, any_value(long) AS long, any_value(tokens) AS tokens,
    count(DISTINCT doc_id) AS docs
  FROM lines GROUP BY leaf, body
), able AS (
  SELECT *, count(*) OVER (PARTITION BY leaf) AS leaf_kinds FROM kinds
  QUALIFY sum(docs) OVER (PARTITION BY leaf) >= CASE WHEN long THEN 2 ELSE 5 END
), words AS (
  SELECT leaf, body, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos
  FROM able WHERE leaf_kinds > 1
), kept AS (
  SELECT leaf, body, pos, CASE WHEN token <> '<*>'
    AND sum(docs) OVER (PARTITION BY leaf, pos, token) >= 5 THEN token ELSE '<*>' END AS word
  FROM words
), wider AS (
  SELECT leaf, body, string_agg(word, ' ' ORDER BY pos) AS template
  FROM kept GROUP BY leaf, body
  HAVING avg((word <> '<*>')::INT::DOUBLE) FILTER (pos > 3) >= 0.6
    AND count(*) FILTER (pos > 3 AND word <> '<*>') >= 2
), named AS (
  SELECT leaf, body, template, true AS wide FROM wider
  UNION ALL
  SELECT leaf, body, body, false FROM able a
  WHERE long OR NOT EXISTS (FROM wider w WHERE a.leaf = w.leaf AND a.body = w.body)
), placed AS (
  SELECT l.doc_id, l.line_no, l.leaf, l.body, l.long, n.template, n.wide,
    row_number() OVER (PARTITION BY l.leaf, n.template, n.wide ORDER BY doc_id, line_no) AS nth
  FROM lines l JOIN named n ON l.leaf = n.leaf AND l.body = n.body
), recurring AS (
  SELECT leaf, template, wide FROM placed GROUP BY leaf, template, wide
  HAVING count(DISTINCT doc_id) >= CASE WHEN any_value(long) AND NOT wide THEN 2 ELSE 5 END
), chosen AS (
  SELECT leaf, body, bool_or(wide) AS wide
  FROM (SELECT DISTINCT leaf, body, template, wide FROM placed) SEMI JOIN recurring USING (leaf, template, wide)
  GROUP BY leaf, body
), gone AS (
  SELECT DISTINCT doc_id, line_no FROM placed JOIN chosen USING (leaf, body, wide) WHERE nth > 1
), rebuilt AS (
  SELECT raw.doc_id, string_agg(line, chr(10) ORDER BY raw.line_no)
      FILTER (gone.line_no IS NULL) AS text,
    count(*) AS n_lines, count(gone.line_no) AS n_dropped
  FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.line_no = gone.line_no
  GROUP BY raw.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text,
  coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_dropped, 0)::INT AS n_dropped
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id
"""


@query("op3_line_dedup", LINES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_recurring_lines(docs)


# --- 4: MinHash near-dedup --------------------------------------------------


@query("op4_minhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return minhash.near_duplicates(docs, words=3, threshold=85)


# --- 5: language ID --------------------------------------------------------


def trains(id_col: str = "doc_id"):
    """The documents that languages are learned from: two thirds, by a checksum of the id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(trains()))
    margin = langid.narrow_margin(docs.where(trains()), model)
    found = docs.withColumn("_found", langid.classify(docs, model, min_margin=margin))
    return found.select("doc_id", (~trains()).alias("held_out"), "_found.*")


# --- 6: URL filters --------------------------------------------------------

URL_RULES = (
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
)

URL_SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r
), m AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""


@query("op6_url_filter", URL_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


# --- 7: chat formatting ----------------------------------------------------

CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, length(regexp_replace(text, X, '#\1', 'g')) + CASE role
      WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 20 + length(regexp_replace(role, X, '#\1', 'g')) END AS n
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
    FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u'
    WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+')
    AS well_formed
FROM m GROUP BY conv_id
""".replace(
    "X",
    r"'(\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[/ROLE\]|\[/TURN\])'",
)


@query("op7_chat_format", CHAT_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
        "conv_id long, turn long, role string, text string",
    )
    return chat.digest_conversations(chat.format_conversations(given.unionByName(more)))


# --- 8: LM scoring ---------------------------------------------------------


@query("op8_pseudo_likelihood")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score_documents(table(spark, sf_dir, "documents"))


# --- 9: mixing sources to target weights -----------------------------------

MIX_SQL = r"""
WITH quality AS (
  SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END AS quality
  FROM labels GROUP BY doc_id
), docs AS (
  SELECT d.doc_id, source, coalesce(quality, 1.0) AS quality,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (('0x' || substr(md5('mix:' || d.doc_id), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE AS u
  FROM documents d LEFT JOIN quality q ON d.doc_id = q.doc_id
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight
  FROM docs GROUP BY source
), levels AS (
  SELECT *, 3 * source_size::DOUBLE AS cap,
    (sum(source_size) OVER ()::DOUBLE - coalesce(sum(3 * source_size::DOUBLE) OVER soonest, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER soonest, 0)) AS level
  FROM sources
  WINDOW soonest AS (ORDER BY 3 * source_size::DOUBLE / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap ELSE weight *
    (SELECT arg_min(level, cap / weight) FROM levels WHERE cap > level * weight) END AS target
  FROM levels
), placed AS (
  SELECT d.doc_id, d.source, size, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / quality, d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + (before + size / 2::DOUBLE <= target - epochs * source_size)::INT))::BIGINT
    AS taken
FROM placed
"""


def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weights: good documents count double, bad ones half, the others 1."""
    best = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return best.select("doc_id", F.when(F.col("q") == 1, 2.0).when(F.col("q") == 0, 0.5).alias("quality"))


@query("op9_mix_sources", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, quality=label_quality(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


# --- 10: document fingerprints ---------------------------------------------


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_with_next(table(spark, sf_dir, "documents"))


# --- 11: spelling variants -------------------------------------------------


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.counted_words(table(spark, sf_dir, "documents")))


# --- 12: exact dedup -------------------------------------------------------

COPIES_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query("op12_exact_dedup", COPIES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


# --- 13: cross-tokenizer alignment -----------------------------------------


@query("op13_cross_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.link_counts(table(spark, sf_dir, "documents"), *paths)
