"""The registered queries of this folder and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import chat, exact, fingerprint, mixing, near, negatives, ngrams, packing, quality, suffix, urls, variants, warc
from offerloom.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    urls.host_path_rule("allow", "org/"), urls.host_path_rule("block", "example.org/es/"), urls.host_path_rule("block", "example.org/en/1"),
    urls.host_path_rule("allow", "com/fr/"), urls.host_path_rule("block", "com/de/"),
]


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query(
    "op3_url_filters",
    r"""
    WITH parts AS (
      SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
      FROM pages),
    rules(rule_host, rule_path, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
    SELECT page_id, host, path, best.rule AS rule, coalesce(best.says, 'allow') AS verdict
    FROM (
      SELECT p.page_id, p.host, p.path, max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path, says := says)) FILTER (WHERE says IS NOT NULL) AS best
      FROM parts p LEFT JOIN rules r ON (p.host = rule_host OR suffix(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
      GROUP BY ALL)
    """,
)
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query(
    "op7_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read_table(spark, sf_dir, "documents"))


MIX_SQL = r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
      FROM documents),
    s AS (
      SELECT source, sum(size)::BIGINT AS source_size,
        [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
      FROM d GROUP BY source),
    total AS (SELECT 1.5 * sum(source_size)::DOUBLE AS budget FROM s),
    rounds AS (
      SELECT 0 AS n, source, source_size, w, false AS capped FROM s
      UNION ALL
      SELECT n + 1, source, source_size, w, capped OR (budget - spent) * w >= 2.0 * source_size * open_w
      FROM (
        SELECT *, coalesce(sum(2.0 * source_size) FILTER (WHERE capped) OVER (), 0) AS spent, coalesce(sum(w) FILTER (WHERE NOT capped) OVER (), 0) AS open_w
        FROM rounds) r, total
      WHERE n < 40),
    t AS (
      SELECT source, source_size,
        CASE WHEN capped THEN 2.0 * source_size::DOUBLE
          ELSE ((budget * 2)::BIGINT - coalesce(sum(4 * source_size) FILTER (WHERE capped) OVER (), 0)::BIGINT)::BIGINT * w::DOUBLE / (sum(w) FILTER (WHERE NOT capped) OVER () * 2)::DOUBLE END AS target,
        capped
      FROM rounds, total WHERE n = 40),
    b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN capped THEN 2 ELSE floor(target / source_size)::BIGINT END AS base FROM t),
    ties AS (SELECT source, h, sum(size) AS words FROM d GROUP BY ALL),
    run AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) - words AS below FROM ties)
    SELECT d.doc_id, d.size::BIGINT AS size, b.source_size, b.target::DOUBLE AS target,
      d.size * (b.base + CASE WHEN target - base * source_size > 0 AND (run.below + run.words <= target - base * source_size OR (run.below <= target - base * source_size AND (target - base * source_size - run.below) * 2 > run.words)) THEN 1 ELSE 0 END)::BIGINT AS taken
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN run ON run.source IS NOT DISTINCT FROM d.source AND run.h = d.h
    """


@query("op9_mix_sources", MIX_SQL)
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op10_chat_rotation",
    r"""
    WITH said AS (
      SELECT DISTINCT conv_id, coalesce(turn, 4611686018427387904) AS turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker,
        regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '< |\1| >', 'g') AS text
      FROM conversations),
    t AS (SELECT conv_id, speaker, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker, text) - 1 AS pos FROM said),
    v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
      UNION ALL SELECT conv_id, NULL FROM t GROUP BY 1 HAVING bool_and(speaker = 'system')),
    p AS (
      SELECT t.conv_id, v.perspective, t.pos // 64 AS part, t.pos, coalesce(t.speaker = v.perspective, false) AS own,
        '<|im_start|>' || CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = v.perspective THEN 'assistant' ELSE 'user name=' || t.speaker END || chr(10) AS head,
        t.text || '<|im_end|>' AS body
      FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
    o AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos) - length(body) - 1 AS start FROM p)
    SELECT conv_id, perspective, part, string_agg(head || body || chr(10), '' ORDER BY pos) AS text,
      coalesce(string_agg(start::BIGINT || '-' || (start + length(body))::BIGINT, ',' ORDER BY pos) FILTER (WHERE own), '') AS mask,
      count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own
    FROM o GROUP BY 1, 2, 3
    """,
)
def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return chat.rotate_perspectives(turns).select("conv_id", "perspective", "part", "text", "mask", "n_turns", "n_own")


def tokenizer_path() -> str:
    """Where the public vocabulary lies; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_pack_documents")
def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


@query(
    "op8_arc_to_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
    f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY 1)
    SELECT page_id, strlen(html) AS payload_bytes,
      array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4)) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
    FROM p JOIN f USING (hex)
    """,
)
def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archived = warc.page_archive(read_table(spark, sf_dir, "pages"))
    return archived.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_fingerprints")
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "votes", "posterior", "score", "accepted")


@query("op4_minhash_near_dedup")
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read_table(spark, sf_dir, "documents"))


@query("op11_quality_rules")
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = ngrams.judge(docs, read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bad_probability")


@query(
    "op12_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, list_dot_product(a.q, r.q)::BIGINT AS score
      FROM v a, v r WHERE a.vec_id % 100 = 0 AND r.vec_id IS DISTINCT FROM a.vec_id),
    p AS (
      SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id NULLS LAST) <= 5),
    n AS (
      SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id NULLS LAST)::INTEGER AS rank,
        other_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score)
    SELECT * FROM n WHERE rank <= 10
    """,
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.mine_negatives(vectors, F.col("vec_id") % 100 == 0, label)


#: Latin-1 letters stand for single bytes in the SQL, whose edit distance counts bytes.
ONE_BYTE = "translate({0}, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{{|')"

VARIANTS_SQL = rf"""
    WITH RECURSIVE crc AS (
      SELECT [list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) FOR i IN range(256)] AS steps),
    runs AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hexed FROM runs GROUP BY ALL),
    hashed AS (
      SELECT run, n, xor(4294967295::BIGINT, list_reduce(
        list_prepend(4294967295::BIGINT, [('0x' || substr(hexed, 2 * i + 1, 2))::BIGINT FOR i IN range(length(hexed) // 2)]),
        lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]))) AS h
      FROM counted, crc),
    words AS (
      SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, sum(n)::BIGINT AS n
      FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
    cuts AS (SELECT word, n, unnest(list_prepend(word, [substr(word, 1, i) || substr(word, i + 2) FOR i IN range(length(word))])) AS cut FROM words),
    met AS (SELECT DISTINCT a.word, b.word AS form, b.n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.word <> b.word),
    near AS (
      SELECT word, count(*) AS n_near, min(struct_pack(less := -n, form := form)) AS best
      FROM met WHERE levenshtein({ONE_BYTE.format('word')}, {ONE_BYTE.format('form')}) = 1 GROUP BY 1),
    formed AS (
      SELECT w.word, CASE WHEN -best.less >= 5 * n THEN best.form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n
      FROM words w LEFT JOIN near USING (word)),
    chain AS (
      SELECT word, word AS root FROM formed
      UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
    FROM formed f JOIN chain c ON c.word = f.word JOIN formed last ON last.word = c.root AND last.form IS NULL
    """


@query("op13_spelling_variants", VARIANTS_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(read_table(spark, sf_dir, "documents"))
