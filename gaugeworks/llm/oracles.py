"""SQL for the queries of this subpackage whose whole result SQL can express.

The others learn a model (1, 4), encode by a vocabulary file (2, 8, 13), follow a method whose
sketches or labels SQL has no means for (5, 6), need components over a quadratic self-join (9),
or have many right results (10); tests hold them against brute-force versions.
"""

from __future__ import annotations

CLUSTERS = 8
CLUSTER_ROUNDS = 10

# 13-word windows by their text; the least document a window starts in; words that a window of
# a lesser document covers.
SUBSTRING_DEDUP = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split)
),
least AS (SELECT words, min(doc_id) AS first_doc FROM windows GROUP BY words),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place
  FROM windows JOIN least USING (words) WHERE first_doc < doc_id
),
placed AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS word FROM split),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS words, count(*) AS n
  FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT s.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(words, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id"""

TOPK = """
WITH kept AS (
  SELECT vec_id, len(embedding) AS dim, list_transform(embedding,
    lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(
    CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS score
  FROM kept q JOIN kept d ON q.dim = d.dim AND q.vec_id <> d.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM scored WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 10"""

# The CRC-32 of each different word, byte by byte, from the table of its polynomial.
RESAMPLING = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS entries FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
      lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) t(i))
),
split AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
counted AS (
  SELECT side, id, word, count(*) AS n
  FROM (SELECT side, id, unnest(w) AS word FROM split) GROUP BY ALL
),
named AS MATERIALIZED (
  SELECT word, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(CAST(len(h) // 2 AS BIGINT)),
      lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM counted), crc_table
),
buckets AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t
  FROM range(10000) b(bucket)
  LEFT JOIN (SELECT side, n, bucket FROM counted JOIN named USING (word)) f ON f.bucket = b.bucket
  GROUP BY b.bucket
),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(
    (CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000)
    / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM buckets
),
weights AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS features, CAST(sum(n * gain) AS BIGINT) AS total
  FROM counted JOIN named USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
),
weighed AS (
  SELECT id AS doc_id, coalesce(features, 0) AS n_features,
    coalesce((total - ((total % features) + features) % features) // features, 0) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296))) AS BIGINT) AS draw
  FROM split LEFT JOIN weights USING (id) WHERE side = 0
),
scored AS (SELECT doc_id, n_features, weight, weight + draw AS score FROM weighed),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""


def clustering() -> str:
    """One pair of common tables per round: assignments, then floored means."""
    distance = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assigned(number: int) -> str:
        return f"""a{number} AS MATERIALIZED (
  SELECT k.row, min(struct_pack(d := {distance}, c := c.c)) AS best
  FROM kept k, c{number} c GROUP BY k.row)"""

    def means(number: int) -> str:
        return f"""c{number + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{number} c LEFT JOIN (
    SELECT c, list(mean ORDER BY place) AS v FROM (
      SELECT c, place, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean
      FROM (SELECT best.c AS c, unnest(v) AS x, unnest(range(64)) AS place
            FROM a{number} JOIN kept USING (row))
      GROUP BY c, place) GROUP BY c) m ON m.c = c.c)"""

    steps = [part for n in range(CLUSTER_ROUNDS) for part in (assigned(n), means(n))]
    last = CLUSTER_ROUNDS
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding,
    lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS c, v
  FROM kept QUALIFY c < {CLUSTERS}
),
{",".join(steps)},
{assigned(last)}
SELECT vec_id, best.c AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{last} JOIN kept USING (row) JOIN c{last} c ON c.c = best.c"""


ORACLES: dict[str, str] = {
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op7_topk_search": TOPK,
    "op11_resampling": RESAMPLING,
    "op12_clustering": clustering(),
}
