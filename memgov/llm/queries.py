"""The queries of this folder, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memgov.llm import (
    bpe, fingerprints, language, lines, metric_tree, mixing, neardup, packing, quality, reversed_search, spelling, token_files, wrappers,
)
from memgov.llm.common import prepare, table
from memgov.session import new_scratch

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_bpe_round_trip")
def bpe_round_trip(spark, sf_dir):
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_token_files")
def token_orc(spark, sf_dir):
    out = new_scratch(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.layout_digests(token_files.read_token_files(spark, out))


@query("op6_packing")
def pack_documents(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_language")
def languages(spark, sf_dir):
    return language.predict_languages(table(spark, sf_dir, "documents"))


@query("op4_quality")
def qualities(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_fingerprints")
def sketches(spark, sf_dir):
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


@query("op8_simhash_near_dedup")
def near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


TOP_PRODUCTS = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS parts FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.parts, c.parts)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM ranked WHERE n <= 20
"""


@query("op9_top_products", TOP_PRODUCTS)
def top_products(spark, sf_dir):
    return metric_tree.top_products(table(spark, sf_dir, "embeddings"))


@query("op10_page_text")
def page_text(spark, sf_dir):
    return wrappers.extract_text(table(spark, sf_dir, "pages"))


@query("op7_line_dedup")
def line_dedup(spark, sf_dir):
    return lines.line_report(table(spark, sf_dir, "documents"))


SPELLING = r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS crcs FROM bits WHERE k = 8
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), each AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL
), bytes AS (
  SELECT run, n, [('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(encode(id || ':' || run)), '..')] AS b FROM each
), checked AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM checked
), words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk(word, spot, k) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL SELECT walk.word, form, k + 1 FROM walk JOIN forms ON walk.spot = forms.word WHERE form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(spot, k) AS root FROM walk GROUP BY word) USING (word)
"""


@query("op11_spelling_variants", SPELLING)
def spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), spelling.DAMAGE)


SOURCE_MIX = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(md5(text), '') AS tie FROM documents
), spots AS (SELECT *, ('0x' || substr(md5(concat('mix:', coalesce(doc_id::VARCHAR, ''), ':', tie)), 1, 15))::BIGINT AS spot FROM docs
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS weight
  FROM docs GROUP BY source
), levels AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS heavy,
    coalesce(sum(source_size) OVER lower, 0) AS filled, coalesce(sum(weight) OVER lower, 0) AS lighter FROM sources
  WINDOW lower AS (ORDER BY source_size * (6 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, (weight * 2 * filled + 2 * source_size * (heavy - lighter)) * 2 <= 3 * total * weight AS is_full FROM levels
), rest AS (
  SELECT coalesce(sum(source_size) FILTER (is_full), 0) AS done, coalesce(sum(weight) FILTER (is_full), 0) AS kept FROM marked
), targets AS (
  SELECT source, source_size, total, CASE WHEN is_full THEN (2 * source_size)::DOUBLE
    ELSE (weight * (3 * total - 4 * done))::DOUBLE / (2 * (heavy - kept))::DOUBLE END AS target FROM marked, rest
), placed AS (
  SELECT d.doc_id, d.tie, d.size, t.*, row_number() OVER (ORDER BY d.source NULLS LAST, spot, d.doc_id NULLS LAST, tie) AS pos,
    sum(size) OVER (PARTITION BY d.source ORDER BY spot, d.doc_id NULLS LAST, tie ROWS UNBOUNDED PRECEDING) AS upto
  FROM spots d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), served AS (
  SELECT *, (serving * source_size + upto)::DOUBLE / target AS finish FROM placed, (SELECT unnest([0, 1]) AS serving) WHERE size > 0
), summed AS (SELECT *, sum(size) OVER (ORDER BY finish, pos, serving ROWS UNBOUNDED PRECEDING) AS ahead FROM served
), taken AS (SELECT pos, sum(size) FILTER (ahead <= 3 * total // 2) AS taken FROM summed GROUP BY pos)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (pos)
"""


@query("op12_source_mix", SOURCE_MIX)
def source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


BEST_DOCUMENTS = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL
), items AS (
  SELECT item_id, row_number() OVER () AS i, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), asked AS (SELECT item_id, i, unnest(terms) AS term FROM items
), whole AS (SELECT count(*)::BIGINT AS docs_n, sum(len(terms))::BIGINT AS terms_n FROM docs WHERE len(terms) > 0
), counts AS (SELECT doc_id, d, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, d, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, whole GROUP BY term, docs_n
), scored AS (
  SELECT item_id, i, doc_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs_n) // terms_n))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), whole GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 10
"""


@query("op13_best_documents", BEST_DOCUMENTS)
def best_documents(spark, sf_dir):
    return reversed_search.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
