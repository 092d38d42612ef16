"""DuckDB SQL that checks the queries of `scores`."""

from __future__ import annotations

from lexiframe.plans.arrays import CLASSES
from lexiframe.plans.scores import STAGE_CHARS, STAGES

PREDICTED = f"""
scored AS (
  SELECT label, ((list_position(embedding, list_max(embedding)) - 1) % {CLASSES})::INT AS prediction
  FROM embeddings)
"""

STAGED = f"""
scored AS (
  SELECT lang, stage::INT AS stage, quality AS label,
         (n_chars > stage * {STAGE_CHARS})::INT AS prediction
  FROM documents JOIN labels USING (doc_id), range(1, {STAGES + 1}) AS r(stage))
"""


def reports(by: list[str]) -> str:
    """Scores per class and their weighted means, straight from the rows."""
    keys = ", ".join(by)
    lead = f"{keys}, " if by else ""
    using = f"USING ({lead}class)"
    grouping = f"GROUP BY {keys}" if by else ""
    return f""",
support AS (
  SELECT {lead}label AS class, count(*) AS support, sum((label = prediction)::INT) AS hits
  FROM scored GROUP BY ALL),
chosen AS (SELECT {lead}prediction AS class, count(*) AS predicted FROM scored GROUP BY ALL),
per_class AS (
  SELECT {lead}class, coalesce(support, 0)::BIGINT AS support,
         coalesce(predicted, 0)::BIGINT AS predicted, coalesce(hits, 0)::BIGINT AS hits,
         CASE WHEN predicted > 0 THEN coalesce(hits, 0) / predicted ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall
  FROM support FULL JOIN chosen {using}),
scores AS (
  SELECT *, CASE WHEN precision + recall > 0
    THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f_measure FROM per_class),
reports AS (
  SELECT {lead}sum(support)::BIGINT AS n_rows,
         sum(hits) / sum(support) AS accuracy,
         sum(precision * support) / sum(support) AS precision,
         sum(recall * support) / sum(support) AS recall,
         sum(f_measure * support) / sum(support) AS f_measure
  FROM scores {grouping})
"""


ROUNDED = ("round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, "
           "round(recall, 6) AS recall, round(f_measure, 6) AS f_measure")
STAGE_REPORTS = STAGED + reports(["lang", "stage"])

ORACLE = {
    "confusion": f"""WITH {PREDICTED}
SELECT label, prediction, count(*) AS n FROM scored GROUP BY ALL""",
    "class_scores": f"""WITH {PREDICTED} {reports([])}
SELECT class, support, predicted, hits, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f_measure, 6) AS f_measure FROM scores""",
    "weighted_metrics": f"WITH {PREDICTED} {reports([])} SELECT n_rows, {ROUNDED} FROM reports",
    "stage_metrics": f"WITH {STAGE_REPORTS} SELECT lang, stage, n_rows, {ROUNDED} FROM reports",
    "stage_best": f"""WITH {STAGE_REPORTS}
SELECT lang, stage, n_rows, {ROUNDED} FROM reports QUALIFY row_number() OVER (
  PARTITION BY lang ORDER BY f_measure DESC, stage) = 1""",
    "running_best": f"""WITH {STAGE_REPORTS}
SELECT lang, stage, round(f_measure, 6) AS f_measure,
       round(max(f_measure) OVER (PARTITION BY lang ORDER BY stage), 6) AS best_f
FROM reports""",
    "staged_votes": f"""WITH cells AS (
  SELECT vec_id AS row_id, (unnest(range(len(embedding))))::INT AS cell,
         unnest(embedding)::DOUBLE AS vote FROM embeddings),
stages AS (SELECT DISTINCT row_id, (cell // {CLASSES}) + 1 AS stage FROM cells),
scores AS (
  SELECT row_id, cell % {CLASSES} AS class, stage,
         sum(CASE WHEN cell < {CLASSES} THEN vote * 1.0::DOUBLE ELSE vote * 0.1::DOUBLE END ORDER BY cell) AS score
  FROM cells JOIN stages USING (row_id) WHERE (cell // {CLASSES}) + 1 <= stage GROUP BY ALL)
SELECT row_id, stage::INT AS stage, class::INT AS prediction FROM scores
QUALIFY row_number() OVER (PARTITION BY row_id, stage ORDER BY score DESC, class) = 1""",
}
