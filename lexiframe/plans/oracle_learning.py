"""DuckDB SQL that checks what the data fix of the queries of `learning`."""

from __future__ import annotations

from lexiframe.operators.boosting import BINS, LEAST_GAIN, UNIT
from lexiframe.plans.oracle_runs import METRICS, RUNS
from lexiframe.plans.learning import STAGES
from lexiframe.plans.oracle_texts import COUNTS, SENTENCES, TOKEN_IDS
from lexiframe.plans.oracle_vectors import KEPT
from lexiframe.plans.vectors import VECTOR_SIZE

# Labelled documents that hold a known word, in the test part.
TESTED = f"""{TOKEN_IDS},
known AS (SELECT DISTINCT doc_id FROM ided WHERE id IS NOT NULL),
tested AS (
  SELECT count(*) AS n FROM known JOIN labels USING (doc_id)
  WHERE md5(doc_id::VARCHAR)[1] IN ('0', '1', '2', '3'))
"""



def _level(level: int) -> str:
    """Best splits of the nodes of a level, and the rows one level below."""
    old, new, sides = f"r{level}", f"r{level + 1}", "lr::DOUBLE * lr::DOUBLE / ln"
    return f"""
hist{level} AS (
  SELECT c, node, f, bin, sum(r) AS r, count(*) AS n FROM {old} JOIN binned USING (vec_id) GROUP BY ALL),
cum{level} AS (
  SELECT c, node, f, bin, sum(r) OVER w AS lr, sum(n) OVER w AS ln, sum(r) OVER (PARTITION BY c, node, f) AS tr,
         sum(n) OVER (PARTITION BY c, node, f) AS tn
  FROM hist{level} WINDOW w AS (PARTITION BY c, node, f ORDER BY bin)),
gain{level} AS (
  SELECT *, {sides} + (tr - lr)::DOUBLE * (tr - lr)::DOUBLE / (tn - ln) AS gain FROM cum{level} WHERE ln < tn),
split{level} AS (
  SELECT c, node, f, bin FROM (
    SELECT *, row_number() OVER (PARTITION BY c, node ORDER BY gain DESC, f, bin) AS place FROM gain{level})
  WHERE place = 1 AND gain > tr::DOUBLE * tr::DOUBLE / tn + {LEAST_GAIN}),
{new} AS (
  SELECT t.vec_id, t.c, t.r, t.h, 2 * t.node + CASE WHEN b.bin > s.bin THEN 1 ELSE 0 END AS node
  FROM {old} t LEFT JOIN split{level} s ON t.c = s.c AND t.node = s.node
  LEFT JOIN binned b ON b.vec_id = t.vec_id AND b.f = s.f)"""


FIRST_STAGE = f"""
WITH given AS (SELECT vec_id, embedding, label FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
cells AS (
  SELECT vec_id, unnest(range(len(embedding)))::INT AS f, unnest(embedding)::DOUBLE AS x FROM given),
bounds AS (SELECT f, min(x) AS lo, max(x) AS hi FROM cells GROUP BY f),
binned AS (
  SELECT vec_id, f, CASE WHEN hi > lo THEN least({BINS - 1}, floor((x - lo) * {BINS} / (hi - lo)))::INT ELSE 0 END AS bin
  FROM cells JOIN bounds USING (f)),
size AS (SELECT count(*) AS n, max(label) + 1 AS k FROM given),
classes AS (SELECT unnest(range(k))::INT AS c, n, k FROM size),
shares AS (SELECT c, k, (SELECT count(*) FROM given WHERE label = c) / n::DOUBLE AS p FROM classes),
r0 AS (
  SELECT vec_id, c, round((CASE WHEN label = c THEN 1 ELSE 0 END - p) * {UNIT})::BIGINT AS r,
         round(p * (1 - p) * {UNIT})::BIGINT AS h, 0 AS node
  FROM given, shares),
{",".join(_level(level) for level in range(3))},
leaves AS (
  SELECT c, node, sum(r)::DOUBLE / sum(h)::DOUBLE AS step FROM r3 GROUP BY ALL)
{" UNION ALL ".join(f"SELECT c AS class, {level} AS level, node, f AS feature, bin, NULL::DOUBLE AS value FROM split{level}"
                    for level in range(3))}
UNION ALL
SELECT shares.c, 3, nodes.node::INT, NULL, NULL, round(coalesce(step, 0) * (k - 1) / k, 6)
FROM shares CROSS JOIN (SELECT unnest(range(8)) AS node) AS nodes
LEFT JOIN leaves ON leaves.c = shares.c AND leaves.node = nodes.node"""

HELD_OUT = """
SELECT count(*) AS n FROM embeddings WHERE md5(vec_id::VARCHAR)[1] IN ('0', '1', '2', '3')
  AND embedding IS NOT NULL AND label IS NOT NULL"""

ORACLE = {
    "joint_first_stage": FIRST_STAGE,
    "joint_boosted": f"""
SELECT stage::INT AS stage, n::BIGINT AS n_rows, CASE WHEN stage = {STAGES} THEN true END AS last_is_model
FROM ({HELD_OUT}), range(1, {STAGES + 1}) AS r(stage)""",
    "incremental_counts": f"""WITH {SENTENCES} {COUNTS}
SELECT word, cnt, (SELECT count(*) FROM documents WHERE doc_id % 5 = 4) AS read_rows FROM counts""",
    "stream_fits": "SELECT name, true AS fitted FROM (VALUES ('raw'), ('unit')) AS v(name)",
    "learned_doc_vectors": f"""WITH {TOKEN_IDS}, known AS (
  SELECT doc_id, count(*) FILTER (id > 0) AS n FROM ided GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN n > 0 THEN {VECTOR_SIZE} END AS width, CASE WHEN n > 0 THEN true END AS moved
FROM documents LEFT JOIN known USING (doc_id)""",
    "learned_boosting": f"""WITH {TESTED.replace("id IS NOT NULL", "id > 0")}
SELECT stage::INT AS stage, n::BIGINT AS n_rows, true AS recall_is_accuracy
FROM tested, range(1, {STAGES + 1}) AS r(stage)""",
    "word_vectors": f"""WITH {KEPT}
SELECT DISTINCT word, {VECTOR_SIZE} AS width, 1.0::DOUBLE AS norm FROM survivors""",
    "boosted_stages": f"""WITH {TESTED}
SELECT stage::INT AS stage, n::BIGINT AS n_rows, true AS recall_is_accuracy
FROM tested, range(1, {STAGES + 1}) AS r(stage)""",
    "boosted_trees": f"""WITH {TESTED}
SELECT {STAGES}::BIGINT AS n_stages, 0::BIGINT AS n_better, n::BIGINT AS n_rows FROM tested""",
    "scored_experiments": """
SELECT name, name = 'raw' AS reused, name = 'unit' AS fitted FROM (VALUES ('raw'), ('unit')) AS v(name)""",
    "softmax_regression": """
SELECT count(*) AS n_rows, true AS cost_falls, true AS recall_is_accuracy FROM embeddings
WHERE md5(vec_id::VARCHAR)[1] IN ('0', '1', '2', '3')""",
    "stream_tokens": f"WITH {TOKEN_IDS} SELECT doc_id, sent_id, pos, id FROM ided",
    "stream_pending": f"""WITH {RUNS}
SELECT name, {METRICS} FROM named
QUALIFY row_number() OVER (
  PARTITION BY name ORDER BY o_orderstatus <> 'F', run_time DESC, o_orderkey DESC) = 1""",
}
