"""The registered queries of the training-data operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, fingerprints, html_text, licenses, media, mixing, near_dedup, nearest, packing, ranking, token_counts, toxicity, warc
from .common import Shelf, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2).select("doc_id", "n_shingles", "component_id", "kept")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = Shelf(spark, "warc").path("archives")
    warc.write_archives(table(spark, sf_dir, "pages"), where, least=0)
    return warc.resolve_revisits(warc.read_archives(spark, where)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "draws")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0).select("vec_id"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_minhash_near_dedup, op4_html_extraction, op6_toxicity, op8_warc, op9_source_mixing, op10_nearest)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w
), n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s
), class AS MATERIALIZED (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)
), member AS MATERIALIZED (SELECT s.doc_id, c.rep FROM s JOIN class c ON list_sort(s.s) = c.s
), x AS MATERIALIZED (SELECT rep, unnest(s) AS g FROM class
), pair AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL
), link AS MATERIALIZED (
  SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)
), edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (SELECT rep AS a, rep AS b FROM class UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
), comp AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(comp.c, n.doc_id) AS component_id, n.doc_id = coalesce(comp.c, n.doc_id) AS kept
FROM n LEFT JOIN member m ON m.doc_id = n.doc_id LEFT JOIN comp ON comp.rep = m.rep
"""

ORACLE_SQL["op8_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x FROM p
), b AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest
  FROM d
), f AS (SELECT payload_digest, min(page_id) AS first FROM b GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b JOIN f USING (payload_digest)
"""

ORACLE_SQL["op9_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || doc_id::VARCHAR) AS key FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST)) - 1) % 3] AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s
), f AS (
  SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below, (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open, row_number() OVER o AS place
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source COLLATE "binary" NULLS LAST)
), g AS (SELECT *, min(CASE WHEN (total - below) * weight <= cap * open THEN place END) OVER () AS first FROM f
), t AS (
  SELECT source, source_size, CASE WHEN place < first THEN cap::DOUBLE
    ELSE (max(CASE WHEN place = first THEN total - below END) OVER ())::DOUBLE * weight / (max(CASE WHEN place = first THEN open END) OVER ()) END AS target
  FROM g
), u AS (
  SELECT *, floor(target)::BIGINT AS want, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) AS no FROM t
), n AS (
  SELECT *, ceil(want / 256)::BIGINT AS need, (sum(want) OVER (ORDER BY no))::HUGEINT AS hi, (sum(want) OVER ())::HUGEINT AS everything FROM u WHERE want > 0
), i AS (
  SELECT *, (hi - want) * 2147483648 // everything AS low, hi * 2147483648 // everything AS high FROM n
), point AS (SELECT slot, slot % 2147483648 * 1327217885 % 2147483648 AS point FROM (SELECT unnest(range(0, (SELECT sum(need)::BIGINT FROM n))) AS slot)
), hit AS (
  SELECT slot, no, need, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS turn FROM point JOIN i ON point >= low AND point < high
), late AS (
  SELECT (SELECT sum(need) FROM n)::BIGINT + row_number() OVER (ORDER BY turn, no) - 1 AS slot, no, turn
  FROM (SELECT no, unnest(range(coalesce(has, 0), need)) AS turn FROM n LEFT JOIN (SELECT no AS k, count(*) AS has FROM hit GROUP BY no) ON no = k)
), slots AS (SELECT slot, no, turn FROM hit WHERE turn < need UNION ALL SELECT slot, no, turn FROM late
), p AS (SELECT d.*, u.no, u.want, u.source_size, u.target, (sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
), met AS (SELECT doc_id, no, k * source_size + start AS lo, least(k * source_size + start + size, want) AS hi FROM p, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0 AND k * source_size + start < want
), drawn AS (
  SELECT doc_id, sum(least(hi, 256 * (turn + 1)) - greatest(lo, 256 * turn))::BIGINT AS taken, min(slot) AS first_slot, count(*) AS draws
  FROM met JOIN slots ON met.no = slots.no AND turn >= lo // 256 AND turn <= (hi - 1) // 256 GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, coalesce(draws, 0)::BIGINT AS draws FROM p LEFT JOIN drawn USING (doc_id)
"""

ORACLE_SQL["op10_nearest"] = r"""
WITH v AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licences(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_join("families", ",").alias("families"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES |= {f.__name__: f for f in (op5_licence_scan, op7_token_counts)}


def op3_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.image_copies(media.vector_images(table(spark, sf_dir, "embeddings")))


QUERIES["op3_media_copies"] = op3_media_copies


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op11_source_divergence, op12_ranked_search, op13_fingerprints)}

ORACLE_SQL["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT doc, lang, source, term, count(*)::HUGEINT AS n FROM (SELECT doc, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), kept AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), l AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d
), c AS MATERIALIZED (SELECT t.lang, t.source, t.term, sum(t.n)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL
), p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(s.total, 0) + 5 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * l.v) AS q
  FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.a = a.source AND x.b = b.source
), everything AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
), r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary"))::INT AS rank FROM everything)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""

ORACLE_SQL["op12_ranked_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), n AS MATERIALIZED (SELECT doc, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0
), a AS MATERIALIZED (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n
), t AS MATERIALIZED (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(w) AS term FROM d) GROUP BY ALL
), i AS MATERIALIZED (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, a WHERE term IN (SELECT term FROM i) GROUP BY term, docs
), m AS (SELECT doc, doc_id, 100 - 25 + (25 * n * docs) // terms AS m FROM n, a
), s AS (
  SELECT item_id, doc_id, doc, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN t USING (term) JOIN m USING (doc) GROUP BY ALL
), r AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, doc))::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
