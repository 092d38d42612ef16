"""DuckDB SQL that checks the queries of `vectors`."""

from __future__ import annotations

from lexiframe.plans.oracle_texts import FRAMES, INDEXED, SENTENCES, SETTINGS, VOCAB, tokens_of
from lexiframe.operators.skipgram import DIGITS, NOISE_UNIT
from lexiframe.plans.vectors import FACTORS, SMOOTHING, VECTOR_SIZE

KEPT = SENTENCES + VOCAB + tokens_of("sents", "toks") + f""",
probs AS (
  SELECT id, word, least(1.0::DOUBLE, sqrt({SETTINGS.sample!r}::DOUBLE /
    (cnt / (SELECT sum(cnt) FROM vocab)::DOUBLE))) AS keep FROM vocab),
survivors AS (
  SELECT doc_id, sent_id, pos, word, id FROM toks JOIN probs USING (word)
  WHERE ('0x' || substr(md5(doc_id || '|' || sent_id || '|' || pos), 1, 6))::BIGINT
        / 16777216.0::DOUBLE < keep)
"""

PAIRS = KEPT + f""",
dense AS (
  SELECT doc_id, sent_id, id,
         row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS place FROM survivors),
stepped AS (
  SELECT doc_id, sent_id, id, place, place + unnest(range(1, {SETTINGS.window + 1})) AS other
  FROM dense),
near AS (
  SELECT s.id AS x, d.id AS y FROM stepped s JOIN dense d
  ON s.doc_id = d.doc_id AND s.sent_id = d.sent_id AND s.other = d.place),
directed AS (
  SELECT x AS center, y AS context, count(*) AS n FROM near GROUP BY ALL
  UNION ALL SELECT y, x, count(*) FROM near GROUP BY ALL),
pairs AS (
  SELECT center, context, sum(n)::BIGINT AS cnt FROM directed GROUP BY ALL)
"""

ORACLE = {
    "subsampled_tokens": f"WITH {KEPT} SELECT doc_id, sent_id, pos, word FROM survivors",
    "skipgram_pairs": f"WITH {PAIRS} SELECT center, context, cnt FROM pairs",
    "noise_distribution": f"""WITH {SENTENCES} {VOCAB}
SELECT id, word, cnt, round(cnt ** 0.75 / sum(cnt ** 0.75) OVER (), 9) AS prob FROM vocab""",
    "negative_samples": f"""WITH {PAIRS},
weights AS (
  SELECT id, floor(sqrt(cnt::DOUBLE) * sqrt(sqrt(cnt::DOUBLE)) * {NOISE_UNIT})::BIGINT AS w FROM vocab),
ranges AS (
  SELECT id, (sum(w) OVER (ORDER BY id) - w)::BIGINT AS low, (sum(w) OVER (ORDER BY id))::BIGINT AS high FROM weights),
total AS (SELECT sum(w)::BIGINT AS t, (sum(w) / 4096)::BIGINT + 1 AS width FROM weights),
buckets AS (
  SELECT id, low, high, unnest(range(low // width, (high - 1) // width + 1)) AS bucket FROM ranges, total),
draws AS (
  SELECT center, context, draw, ('0x' || substr(md5('1|' || center || '|' || context || '|' || draw), 1, {DIGITS}))::BIGINT
         % t AS point, width
  FROM pairs, total, unnest(range(1, {SETTINGS.negative + 1})) AS d(draw)),
found AS (
  SELECT center, context, list_sort(list(draw * 4294967296 + id)) AS ids
  FROM draws JOIN buckets ON point // width = bucket AND point >= low AND point < high GROUP BY center, context)
SELECT center, context, array_to_string(list_transform(ids, lambda x: x % 4294967296), ' ') AS noise FROM found""",
    "sgns_vectors": f"""WITH {SENTENCES} {VOCAB}
SELECT id, {VECTOR_SIZE} AS width, true AS loss_falls FROM vocab""",
    "sppmi": f"""WITH {PAIRS},
sums AS (SELECT center, sum(cnt)::DOUBLE AS n FROM pairs GROUP BY center),
whole AS (SELECT sum(cnt)::DOUBLE AS n FROM pairs)
SELECT p.center, p.context, p.cnt, round(greatest(0.0::DOUBLE,
  ln(p.cnt::DOUBLE * w.n / (a.n * b.n)) - ln({SETTINGS.negative}.0::DOUBLE)), 6) AS sppmi
FROM pairs p JOIN sums a ON p.center = a.center JOIN sums b ON p.context = b.center, whole w""",
    "sppmi_vectors": f"""WITH {PAIRS},
sums AS (SELECT center, sum(cnt)::DOUBLE AS n FROM pairs GROUP BY center),
whole AS (SELECT sum(cnt)::DOUBLE AS n FROM pairs)
SELECT DISTINCT p.center AS id, {VECTOR_SIZE} AS width
FROM pairs p JOIN sums a ON p.center = a.center JOIN sums b ON p.context = b.center, whole w
WHERE ln(p.cnt::DOUBLE * w.n / (a.n * b.n)) - ln({SETTINGS.negative}.0::DOUBLE) > 0""",
    "svd_vectors": f"""WITH {PAIRS},
sums AS (SELECT center, sum(cnt)::DOUBLE AS n FROM pairs GROUP BY center),
whole AS (SELECT sum(cnt)::DOUBLE AS n FROM pairs),
words_in AS (
  SELECT count(DISTINCT p.center) AS n_words
  FROM pairs p JOIN sums a ON p.center = a.center JOIN sums b ON p.context = b.center, whole w
  WHERE ln(p.cnt::DOUBLE * w.n / (a.n * b.n)) - ln({SETTINGS.negative}.0::DOUBLE) > 0)
SELECT component::INT AS component, n_words, true AS falls, true AS holds
FROM words_in, range(1, {FACTORS + 1}) AS r(component) WHERE component <= n_words""",
    "doc_vectors": f"""WITH {INDEXED},
given AS (SELECT vec_id, embedding, (SELECT count(*) FROM embeddings) AS n FROM embeddings),
words_in AS (
  SELECT doc_id, sent_id, id FROM ided),
cells AS (
  SELECT doc_id, sent_id, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x
  FROM words_in JOIN given ON id % n = vec_id),
sentence_means AS (
  SELECT doc_id, sent_id, dim, avg(x) AS x FROM cells GROUP BY ALL),
doc_means AS (
  SELECT doc_id, dim, avg(x) AS x FROM sentence_means GROUP BY ALL)
SELECT d.doc_id, m.dim, round(m.x, 6) AS value
FROM documents d LEFT JOIN doc_means m ON d.doc_id = m.doc_id""",
    "unit_vectors": """
SELECT vec_id, dim, round(CASE WHEN norm > 0 THEN x / norm ELSE x END, 6) AS value FROM (
  SELECT vec_id, dim, x, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS norm FROM (
    SELECT vec_id, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x
    FROM embeddings))""",
    "masked_cost": f"""WITH {FRAMES["next"]},
cells AS (
  SELECT md5(doc_id::VARCHAR)[1] <> '0' AS train, unnest("out")::BIGINT AS prev, unnest(target)::BIGINT AS next,
         unnest(range(len(target))) AS place, out_len FROM frames),
steps AS (SELECT train, prev, next FROM cells WHERE place < out_len),
trained AS (SELECT prev, next, count(*) AS c FROM steps WHERE train GROUP BY ALL),
ahead AS (SELECT prev, count(*) AS c FROM steps WHERE train GROUP BY ALL),
tested AS (SELECT prev, next, count(*) AS n FROM steps WHERE NOT train GROUP BY ALL)
SELECT (SELECT count(*) FROM steps WHERE train) AS n_train, sum(n)::BIGINT AS n_targets,
       round(sum(n * -ln((coalesce(t.c, 0) + {SMOOTHING}::DOUBLE)
         / (coalesce(a.c, 0) + {SMOOTHING}::DOUBLE * ((SELECT count(*) FROM vocab) + 4)))) / sum(n), 6) AS cost
FROM tested s LEFT JOIN trained t ON s.prev = t.prev AND s.next = t.next LEFT JOIN ahead a ON s.prev = a.prev""",
    "bigram_perplexity": f"""WITH {INDEXED},
steps AS (
  SELECT md5(doc_id::VARCHAR)[1] <> '0' AS train, unnest(list_concat([3], ids)) AS prev,
         unnest(list_concat(ids, [1])) AS next FROM indexed),
trained AS (SELECT prev, next, count(*) AS c FROM steps WHERE train GROUP BY ALL),
ahead AS (SELECT prev, count(*) AS c FROM steps WHERE train GROUP BY ALL),
tested AS (SELECT prev, next, count(*) AS n FROM steps WHERE NOT train GROUP BY ALL),
scored AS (
  SELECT n, -ln((coalesce(t.c, 0) + {SMOOTHING}::DOUBLE)
     / (coalesce(a.c, 0) + {SMOOTHING}::DOUBLE * ((SELECT count(*) FROM vocab) + 4))) AS cost
  FROM tested s LEFT JOIN trained t ON s.prev = t.prev AND s.next = t.next
  LEFT JOIN ahead a ON s.prev = a.prev)
SELECT (SELECT count(*) FROM steps WHERE train) AS n_train, sum(n)::BIGINT AS n_targets,
       round(sum(n * cost) / sum(n), 6) AS cross_entropy,
       round(exp(sum(n * cost) / sum(n)), 3) AS perplexity FROM scored""",
}
