"""DuckDB SQL that checks the queries of `runs`."""

from __future__ import annotations

from lexiframe.plans.runs import TOP, TOP_PER_GROUP

RUNS = """
fields AS (
  SELECT *, CASE WHEN o_orderstatus = 'O' THEN 'self' ELSE 'next' END AS inf_mode,
         CASE WHEN o_orderkey % 2 = 0 THEN 'gru' ELSE 'lstm' END AS cell_type,
         CASE WHEN o_custkey % 2 = 0 THEN 'uni' ELSE 'bi' END AS rnn_direction,
         (64 * (1 + o_orderkey % 4))::INT AS batch_size,
         (10 * (2 + o_custkey % 5))::INT AS sentence_length,
         (128 * (1 + o_custkey % 3))::INT AS num_unit, (1 + o_orderkey % 6)::INT AS num_layer,
         5 * (1 + o_orderkey % 20) AS epoch,
         date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400 AS run_time,
         round(o_totalprice * 100)::BIGINT AS cents FROM orders),
runs AS (
  SELECT *, inf_mode || '_cell_' || cell_type || '_dir_' || rnn_direction || '_bat_' || batch_size
         || '_maxlen_' || sentence_length || '_unit_' || num_unit || '_layer_' || num_layer AS model,
         (cents % 10007) / 10007.0::DOUBLE AS accuracy, (cents % 9973) / 9973.0::DOUBLE AS precision,
         (cents % 10007) / 10007.0::DOUBLE AS recall, (cents % 9949) / 9949.0::DOUBLE AS f_measure
  FROM fields),
named AS (
  SELECT *, o_orderpriority <> '5-LOW' AS good, CASE WHEN o_orderpriority = '5-LOW'
         THEN 'notes_' || o_orderkey || '.txt'
         ELSE model || '_epoch_' || epoch || '_' || run_time END AS name FROM runs)
"""

FIELDS = ("inf_mode, cell_type, rnn_direction, batch_size, sentence_length, num_unit, num_layer, "
          "epoch::INT AS epoch")
METRICS = "accuracy, precision, recall, f_measure"

ORACLE = {
    "experiment_names": f"WITH {RUNS} SELECT o_orderkey, name FROM named",
    "experiment_parse": f"""WITH {RUNS}
SELECT o_orderkey, {FIELDS}, run_time::BIGINT AS run_time FROM named WHERE good""",
    "experiment_rejects": f"WITH {RUNS} SELECT o_orderkey, name FROM named WHERE NOT good",
    "experiment_files": f"WITH {RUNS} SELECT o_orderkey, name FROM named WHERE o_orderstatus <> 'F'",
    "experiment_latest": f"""WITH {RUNS}
SELECT model, epoch, run_time, o_orderkey, {METRICS} FROM named
QUALIFY row_number() OVER (PARTITION BY model, epoch ORDER BY run_time DESC, o_orderkey DESC) = 1""",
    "experiment_pending": f"""WITH {RUNS}
SELECT name, max(CASE WHEN o_orderstatus = 'F' THEN f_measure END) AS f_measure
FROM named GROUP BY name""",
    "experiment_splits": f"""WITH {RUNS},
sides AS (
  SELECT model || '_epoch_' || epoch AS name,
         o_orderpriority IN ('1-URGENT', '2-HIGH') AS train FROM named),
train AS (SELECT name, count(*) AS n_train FROM sides WHERE train GROUP BY name),
test AS (SELECT name, count(*) AS n_test FROM sides WHERE NOT train GROUP BY name)
SELECT name, n_train, n_test FROM train JOIN test USING (name)""",
    "experiment_ready": f"""WITH {RUNS}
SELECT model || '_epoch_' || epoch AS name,
       count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_train,
       count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS n_test
FROM named WHERE o_orderstatus = 'F' GROUP BY model, epoch HAVING n_train > 0 AND n_test > 0""",
    "labelled_vectors": """
SELECT doc_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, quality, toxic
FROM embeddings JOIN labels ON vec_id = doc_id""",
    "leaderboard": f"""WITH {RUNS}
SELECT o_orderkey, name, {METRICS} FROM named WHERE good
ORDER BY f_measure DESC, name, o_orderkey LIMIT {TOP}""",
    "leaderboard_by_cell": f"""WITH {RUNS}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY inf_mode, cell_type, rnn_direction
    ORDER BY f_measure DESC, name, o_orderkey) AS place FROM named WHERE good)
SELECT inf_mode, cell_type, rnn_direction, place::INT AS place, name, f_measure
FROM placed WHERE place <= {TOP_PER_GROUP}""",
    "report_table": f"""WITH {RUNS}
SELECT row_number() OVER (ORDER BY inf_mode, cell_type, rnn_direction, batch_size,
         sentence_length, num_unit, num_layer, epoch, run_time, name, o_orderkey) - 1 AS row_index,
       {FIELDS}, {METRICS} FROM named WHERE good""",
    "resume_epoch": f"""WITH {RUNS}
SELECT model, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN epoch END) + 1, 0) AS next_epoch
FROM named GROUP BY model""",
    "epoch_cost": f"""WITH {RUNS}
SELECT epoch, round(avg(o_totalprice), 4) AS mean_cost, count(*) AS n_batches
FROM named GROUP BY epoch""",
    "stored_reports": f"WITH {RUNS} SELECT name, {METRICS} FROM named",
    "stored_vectors": """
SELECT 'label_' || label AS experiment,
       CASE WHEN md5(vec_id::VARCHAR)[1] = '0' THEN 'test' ELSE 'train' END AS split,
       count(*) AS n_docs, sum(len(embedding))::BIGINT AS n_values
FROM embeddings GROUP BY ALL""",
}
