"""DuckDB SQL that checks the queries of `arrays`."""

from __future__ import annotations

from lexiframe.functions.chars import DEFAULT_ALPHABET

WORDS = """
items AS (
  SELECT item_id, list_filter(
    string_split(lower(regexp_replace(text, '[^a-zA-Z]', ' ', 'g')), ' '),
    lambda w: w <> '') AS words FROM benchmark),
placed AS (
  SELECT item_id, (unnest(range(len(words))))::INT AS pos, unnest(words) AS word FROM items),
pairs AS (
  SELECT a.item_id, a.pos, a.word AS source, b.word AS target
  FROM placed a JOIN placed b ON a.item_id = b.item_id AND a.pos + 1 = b.pos)
"""


def ids(text: str) -> str:
    return (f"array_to_string(list_transform(string_split({text}, ''), "
            f"lambda c: strpos('{DEFAULT_ALPHABET}', c) - 1), ' ')")


CELLS = """
cells AS (
  SELECT vec_id, label, (unnest(range(len(embedding))))::INT AS dim,
         unnest(embedding)::DOUBLE AS x FROM embeddings)
"""

ORACLE = {
    "char_frames": f"""WITH {WORDS}
SELECT item_id, pos, {ids('source')} AS input, {ids("'S' || target")} AS output,
       {ids("target || 'E'")} AS target_ids, {ids("repeat('P', length(source))")} AS filler
FROM pairs""",
    "char_decode": f"""WITH {WORDS}
SELECT item_id, pos, 'target' AS side, target AS word, true AS ended FROM pairs
UNION ALL SELECT item_id, pos, 'source', source, false FROM pairs""",
    "char_rewrite": r"""
SELECT item_id, array_to_string(
  string_split(replace(replace(replace(text, E'\r', ' '), E'\n', ' '), ' ', '_'), ''), ' ') AS chars FROM benchmark""",
    "line_splits": r"""WITH lines AS (
  SELECT replace(replace(text, E'\r', ' '), E'\n', ' ') AS line,
         CASE WHEN md5(item_id::VARCHAR)[1] IN ('0', '1', '2', '3') THEN 'test'
              WHEN md5(item_id::VARCHAR)[1] IN ('4', '5') THEN 'valid' ELSE 'train' END AS split
  FROM benchmark)
SELECT split, count(*) AS n_lines, sum(len(list_filter(string_split(line, ' '), lambda w: w <> '')))::BIGINT
       AS n_words, sum(length(line))::BIGINT AS n_chars FROM lines GROUP BY split""",
    "one_hot_labels": f"""
SELECT vec_id, class::INT AS class, (class = label)::INT AS hot
FROM embeddings, range((SELECT max(label) + 1 FROM embeddings)) AS r(class)""",
    "vector_argmax": """
SELECT vec_id, label, (list_position(embedding, list_max(embedding)) - 1)::INT AS argmax
FROM embeddings""",
    "vector_softmax": f"""WITH {CELLS},
raised AS (
  SELECT vec_id, dim, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM cells)
SELECT vec_id, dim, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM raised""",
    "vector_grid": f"""WITH {CELLS},
shape AS (
  SELECT n, (n // max(r))::INT AS cols FROM (SELECT max(len(embedding)) AS n FROM embeddings), range(1, 10000) AS t(r)
  WHERE n % r = 0 AND r * r <= n GROUP BY n)
SELECT vec_id, 'rows' AS view, dim // cols AS row, dim % cols AS col, round(x, 6) AS x FROM cells, shape
UNION ALL
SELECT vec_id, 'cols', dim % cols, dim // cols, round(x, 6) FROM cells, shape""",
    "vector_scores": f"""WITH {CELLS},
centers AS (SELECT label AS class, dim, avg(x) AS w FROM cells GROUP BY ALL),
bias AS (SELECT class, -sum(w * w) / 2 AS b FROM centers GROUP BY class)
SELECT vec_id, class, round(sum(x * w) + any_value(b), 6) AS score
FROM cells JOIN centers USING (dim) JOIN bias USING (class) GROUP BY vec_id, class""",
}
