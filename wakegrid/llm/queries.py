"""Registered queries of the subpackage: the contracts' digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from .tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_best_fit_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), tokenizer_path())


@query("op5_license_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, folder, "documents"))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM words WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM starts
), firsts AS (
  SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM windows JOIN firsts USING (k) WHERE doc_id > first
), places AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), judged AS (
  SELECT p.doc_id, p.word, p.i, g.i IS NOT NULL AS removed FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT removed), '') AS t FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


@query("op1_substring_dedup", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from .substring import dedup_substrings

    found = dedup_substrings(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[s:s + 4], ' ') FOR s IN range(1, len(w) - 3)]) END AS s FROM words
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), repeated AS (
  SELECT t FROM tokens GROUP BY t HAVING count(*) > 1
), able AS (
  SELECT doc_id FROM tokens JOIN repeated USING (t) GROUP BY doc_id, n HAVING 100 * count(*) >= 75 * n
), held AS (
  SELECT doc_id, n, t FROM tokens JOIN able USING (doc_id) JOIN repeated USING (t)
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  WITH RECURSIVE r(doc_id, c) AS (
    SELECT doc_id, doc_id FROM sets UNION SELECT p.b, r.c FROM r JOIN pairs p ON p.a = r.doc_id
  ) SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id FROM sets s JOIN reach r USING (doc_id)
"""


@query("op10_jaccard_join", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, folder, "documents"))


@query("op4_quality_classifier")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from .labelled import fold
    from .quality import score_quality, train_quality

    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(fold(4) != 2).select("doc_id", F.col("quality").alias("label"))
    scored = score_quality(docs, train_quality(docs, labels))
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from .labelled import fold
    from .toxicity import score_toxicity, train_toxicity

    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(fold(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    scored = score_toxicity(docs, train_toxicity(docs, labels))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from .suffixes import dedup_bytes

    found = dedup_bytes(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), ds AS (
  SELECT doc_id, len(w) AS n, unnest(range(greatest(len(w) - 4, 1))) AS p, unnest([array_to_string(w[s + 1:s + 5], ' ') FOR s IN range(greatest(len(w) - 4, 1))]) AS t FROM d WHERE len(w) > 0
), bs AS (
  SELECT item_id, len(w) AS n, unnest([array_to_string(w[s + 1:s + 5], ' ') FOR s IN range(greatest(len(w) - 4, 1))]) AS t FROM b WHERE len(w) > 0
), bc AS (
  SELECT item_id, t, count(*) AS c FROM bs GROUP BY ALL
), bn AS (
  SELECT item_id, n, count(*) AS m FROM bs GROUP BY ALL
), hits AS (
  SELECT ds.doc_id, ds.n, bc.item_id, ds.p FROM ds JOIN bc USING (t)
), able AS (
  SELECT h.doc_id, h.item_id, least(h.n, bn.n) AS size, greatest(least(h.n, bn.n) - 4, 1) AS m, bn.m AS bm, greatest(h.n - 4, 1) AS own FROM hits h JOIN bn USING (item_id)
  GROUP BY h.doc_id, h.item_id, h.n, bn.n, bn.m HAVING 100 * count(*) >= 75 * bn.m
), starts AS (
  SELECT DISTINCT a.*, unnest(range(greatest(h.p - a.m + 1, 0), least(h.p, a.own - a.m) + 1)) AS s FROM able a JOIN hits h USING (doc_id, item_id)
), windows AS (
  SELECT s.doc_id, s.item_id, s.s, s.size, s.m, s.bm, ds.t, count(*) AS c FROM starts s JOIN ds ON ds.doc_id = s.doc_id AND ds.p >= s.s AND ds.p < s.s + s.m GROUP BY ALL
), shared AS (
  SELECT w.doc_id, w.item_id, w.s, w.size, w.m, w.bm, sum(least(w.c, bc.c)) AS x FROM windows w JOIN bc ON bc.item_id = w.item_id AND bc.t = w.t GROUP BY ALL
)
SELECT doc_id, item_id, arg_min(s, (-CAST(x AS DOUBLE) / CAST(m + bm - x AS DOUBLE), s)) AS start, any_value(size) AS n_words, max(CAST(x AS DOUBLE) / CAST(m + bm - x AS DOUBLE)) AS similarity
FROM shared WHERE 100 * x >= 75 * (m + bm - x) GROUP BY doc_id, item_id
"""


@query("op9_benchmark_decontamination", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from .decontam import contaminated

    found = contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")


@query("op8_document_fingerprints")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from .fingerprints import version_fingerprints

    return version_fingerprints(table(spark, folder, "documents"))


@query("op2_html_extraction")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from .wrapper import extract_pages

    found = extract_pages(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents
), l AS (
  SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), common AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, c.key IS NOT NULL AND c.last <> doc_id AS dropped FROM k LEFT JOIN common c ON c.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op11_line_dedup", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from .lineruns import dedup_lines

    found = dedup_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)
  )
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dw AS (
  SELECT doc_id, unnest(w) AS w FROM d
), bw AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), words AS (
  SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)
), bytes AS (
  SELECT w, [CAST(instr('0123456789ABCDEF', substr(hex(w), 2 * i + 1, 1)) * 16 + instr('0123456789ABCDEF', substr(hex(w), 2 * i + 2, 1)) - 17 AS BIGINT) FOR i IN range(strlen(w))] AS b FROM words
), buckets AS (
  SELECT w, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table
), own AS (
  SELECT bucket, count(*) AS s FROM dw JOIN buckets USING (w) GROUP BY bucket
), target AS (
  SELECT bucket, count(*) AS t FROM bw JOIN buckets USING (w) GROUP BY bucket
), totals AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM own) AS big_s, (SELECT coalesce(sum(t), 0) FROM target) AS big_t
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(big_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(big_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM own LEFT JOIN target USING (bucket), totals
), weights AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY doc_id
), noisy AS (
  SELECT doc_id, list_reduce([CAST(0 AS BIGINT)] || [CAST(instr('0123456789abcdef', substr(sha256('2024:' || doc_id), i, 1)) - 1 AS BIGINT) FOR i IN range(1, 9)], lambda a, x: a * 16 + x) AS h FROM d
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d JOIN noisy USING (doc_id) LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= (10 * n) // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed USING (doc_id)
"""


@query("op12_importance_resampling", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from .importance import resample

    found = resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def lloyd_sql(rounds: int = 5) -> str:
    """The rounds one after the other, each as an assignment and the centroids that follow from it."""

    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT v.r, c.cluster, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.x, c.x)]) AS BIGINT) AS d FROM v, c{k} c
  ) GROUP BY r
)"""

    def moved(k: int) -> str:
        return f"""m{k} AS (
  SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS x, unnest(range(64)) AS i FROM a{k} JOIN v USING (r)) GROUP BY cluster, i
), c{k + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{k} c
  LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{k} GROUP BY cluster) m USING (cluster)
)"""

    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT 40))",
    ]
    for k in range(rounds):
        parts += [assigned(k), moved(k)]
    parts += [assigned(rounds)]
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.cluster = a.cluster"""


@query("op13_centroid_clusters", lloyd_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from .centroids import cluster_vectors

    return cluster_vectors(table(spark, folder, "embeddings"))
