"""DuckDB SQL that checks the queries of `texts`."""

from __future__ import annotations

from lexiframe.config import STOP_WORDS, Settings
from lexiframe.functions.hashing import FEISTEL_ROUNDS

SETTINGS = Settings()
L = SETTINGS.max_len
WIDTH = L + 1


def _literal(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


STOPS = "[" + ", ".join(_literal(w) for w in STOP_WORDS) + "]"

RAW = r"""
marked AS (
  SELECT doc_id, lang, regexp_replace(trim(replace(text, chr(1), ' '), E' \t\r\n'),
         E'([.!?]+)[ \t\r\n]+', '\1' || chr(1), 'g') AS body
  FROM documents WHERE text IS NOT NULL),
parts AS (
  SELECT doc_id, lang, list_filter(string_split(body, chr(1)), lambda s: s <> '') AS parts
  FROM marked),
raw AS (
  SELECT doc_id, lang, (unnest(range(len(parts))))::INT AS sent_id, unnest(parts) AS sentence
  FROM parts)
"""

SENTENCES = RAW + """,
sents AS (
  SELECT doc_id, lang, sent_id, list_filter(
    string_split(lower(regexp_replace(sentence, '[^a-zA-Z]', ' ', 'g')), ' '),
    lambda w: w <> '') AS words
  FROM raw)
"""

CONTENT = SENTENCES + f""",
stops AS (SELECT {STOPS} AS list),
kept AS (
  SELECT doc_id, lang, sent_id, list_filter(words, lambda w:
    length(w) > 1 AND NOT list_contains(list, w)) AS words
  FROM sents, stops)
"""

COUNTS = """,
words AS (SELECT unnest(words) AS word FROM sents),
counts AS (SELECT word, count(*) AS cnt FROM words GROUP BY word)
"""

VOCAB = COUNTS + f""",
vocab AS (
  SELECT (row_number() OVER (ORDER BY cnt DESC, word) + 3)::INT AS id, word, cnt
  FROM counts WHERE cnt >= {SETTINGS.min_count})
"""


def tokens_of(source: str, name: str) -> str:
    return f""",
{name} AS (
  SELECT doc_id, lang, sent_id, (unnest(range(len(words))))::INT AS pos, unnest(words) AS word
  FROM {source})
"""


TOKEN_IDS = CONTENT + VOCAB + tokens_of("kept", "toks") + """,
ided AS (
  SELECT doc_id, lang, sent_id, pos, word, coalesce(id, 0) AS id
  FROM toks LEFT JOIN vocab USING (word))
"""

INDEXED = TOKEN_IDS + """,
grouped AS (
  SELECT doc_id, sent_id, list(id ORDER BY pos) AS ids FROM ided GROUP BY ALL),
indexed AS (
  SELECT k.doc_id, k.sent_id, coalesce(ids, []) AS ids
  FROM kept k LEFT JOIN grouped g ON k.doc_id = g.doc_id AND k.sent_id = g.sent_id)
"""

PAIRS = {
    "self": INDEXED + f""",
pairs AS (
  SELECT doc_id, sent_id, ids[1:{L}] AS in_ids, ids[1:{L}] AS out_ids FROM indexed)
""",
    "next": INDEXED + f""",
pairs AS (
  SELECT a.doc_id, a.sent_id, a.ids[1:{L}] AS in_ids, b.ids[1:{L}] AS out_ids
  FROM indexed a JOIN indexed b ON a.doc_id = b.doc_id AND a.sent_id + 1 = b.sent_id)
""",
}

PADDING = f"list_transform(range({WIDTH}), lambda i: 2)"


def padded(ids: str) -> str:
    return f"list_concat({ids}, {PADDING})[1:{WIDTH}]"


FRAMES = {mode: sql + f""",
frames AS (
  SELECT doc_id, sent_id, {padded('in_ids')} AS "in",
         {padded('list_concat([3], out_ids)')} AS "out",
         (len(out_ids) + 1)::INT AS out_len,
         {padded('list_concat(out_ids, [1])')} AS target
  FROM pairs)
""" for mode, sql in PAIRS.items()}

SHOW_FRAMES = """
SELECT doc_id, sent_id, array_to_string("in", ' ') AS "in",
       array_to_string("out", ' ') AS "out", out_len,
       array_to_string(target, ' ') AS target FROM frames
"""


def batches(epoch: int) -> str:
    return FRAMES["next"] + f""",
ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('{SETTINGS.seed}|{epoch}|' || doc_id || '|' || sent_id),
                               doc_id, sent_id) - 1 AS place,
         count(*) OVER () AS n FROM frames),
batched AS (
  SELECT *, place // {SETTINGS.batch_size} AS batch_id,
         (place % {SETTINGS.batch_size})::INT AS row_in_batch FROM ranked)
"""


ABBREVIATIONS = r"""
pieces AS (
  SELECT unnest(string_split(regexp_replace(text, E'[ \t\r\n]+', chr(1), 'g'), chr(1))) AS token
  FROM documents WHERE text IS NOT NULL),
typed AS (SELECT regexp_replace(lower(token), '^[^\p{L}]+|[^\p{L}.]+$', '', 'g') AS token FROM pieces),
seen AS (SELECT rtrim(token, '.') AS word, regexp_matches(token, '[^.]\.$') AS period FROM typed),
period_counts AS (
  SELECT word, count(*) FILTER (period) AS n_with, count(*) FILTER (NOT period) AS n_without
  FROM seen WHERE word <> '' GROUP BY word),
share AS (SELECT sum(n_with)::DOUBLE / sum(n_with + n_without)::DOUBLE AS p FROM period_counts),
formed AS (
  SELECT word, n_with, n_without, length(word) - length(replace(word, '.', '')) AS periods, p,
         length(replace(word, '.', ''))::DOUBLE AS letters
  FROM period_counts, share
  WHERE regexp_matches(word, '^\p{L}[\p{L}.]*$') AND n_with > 0),
abbreviations AS (
  SELECT word, n_with, n_without,
         2 * (n_with * ln(0.99) + n_without * ln(1 - 0.99) - n_with * ln(p) - n_without * ln(1 - p))
         * exp(-letters) * (periods + 1) * pow(letters, -n_without::DOUBLE) AS score FROM formed)
"""

KNOWN_SENTENCES = ABBREVIATIONS + r""",
listed AS (SELECT list(word || '.') FILTER (score >= 0.3) AS words FROM abbreviations),
cut AS (
  SELECT doc_id, string_split(regexp_replace(trim(replace(text, chr(1), ' '), E' \t\r\n'),
         E'([.!?][ \t\r\n]+)', '\1' || chr(1), 'g'), chr(1)) AS parts
  FROM documents WHERE text IS NOT NULL),
joined AS (
  SELECT doc_id, string_split(array_to_string(list_transform(parts, lambda p: p || CASE WHEN list_contains(
           coalesce(words, []), regexp_replace(lower(regexp_extract(p, E'([^ \t\r\n]*)[ \t\r\n]*$', 1)),
             '^[^\p{L}]+|[^\p{L}.]+$', '', 'g'))
         THEN '' ELSE chr(1) END), ''), chr(1)) AS parts
  FROM cut, listed),
known AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda p: trim(p, E' \t\r\n')), lambda p: p <> '') AS parts
  FROM joined)
"""


def _feistel(key: str) -> str:
    """Six rounds over `cell` of a grid of `a` rows and `b` columns, as nested queries."""
    sql = "SELECT doc_id, sent_id, n, a, b, cell // b AS l, cell % b AS r FROM given"
    for turn in range(FEISTEL_ROUNDS):
        side, other, size = ("l", "r", "a") if turn % 2 == 0 else ("r", "l", "b")
        hashed = f"('0x' || substr(md5('{key}|{turn}|' || {other}), 1, 8))::BIGINT"
        sql = f"SELECT doc_id, sent_id, n, a, b, ({side} + {hashed}) % {size} AS {side}, {other} FROM ({sql})"
    return sql


PERMUTED = f"""WITH RECURSIVE {FRAMES["next"]},
rows AS (
  SELECT doc_id, sent_id, row_number() OVER (ORDER BY doc_id, sent_id) - 1 AS cell, count(*) OVER () AS n FROM frames),
sides AS (
  SELECT *, CASE WHEN sqrt(n)::BIGINT * sqrt(n)::BIGINT >= n THEN sqrt(n)::BIGINT ELSE sqrt(n)::BIGINT + 1 END AS a
  FROM rows),
walk AS (
  SELECT doc_id, sent_id, n, a, (n + a - 1) // a AS b, cell, 0 AS step FROM sides
  UNION ALL
  SELECT doc_id, sent_id, n, a, b, l * b + r AS cell, 1 AS step FROM (
    {_feistel(f"{SETTINGS.seed}|1").replace("FROM given", "FROM walk WHERE step = 0 OR cell >= n")}))
SELECT doc_id, sent_id, cell // {SETTINGS.batch_size} AS batch_id, (cell % {SETTINGS.batch_size})::INT AS row_in_batch
FROM walk WHERE step = 1 AND cell < n"""

ORACLE = {
    "permuted_batches": PERMUTED,
    "abbreviations": f"WITH {ABBREVIATIONS} SELECT word, n_with, n_without, round(score, 6) AS score "
                     "FROM abbreviations WHERE score >= 0.3",
    "split_sentences": f"WITH {KNOWN_SENTENCES} SELECT doc_id, unnest(range(len(parts)))::INT AS sent_id, "
                       "unnest(parts) AS sentence FROM known",
    "document_status": """
SELECT source, sum((text IS NOT NULL)::INT)::BIGINT AS n_kept,
       sum((text IS NULL)::INT)::BIGINT AS n_rejected,
       count(*) FILTER (trim(text, ' ') = '') AS n_blank
FROM documents GROUP BY source""",
    "labelled_corpus": """
SELECT doc_id, n_chars, quality::INT AS label,
       CASE WHEN md5(doc_id::VARCHAR)[1] = '0' THEN 'test' ELSE 'train' END AS split
FROM documents JOIN labels USING (doc_id)""",
    "raw_sentences": f"WITH {RAW} SELECT doc_id, sent_id, sentence FROM raw",
    "sentence_tokens": f"WITH {SENTENCES} {tokens_of('sents', 'toks')} "
                       "SELECT doc_id, sent_id, pos, word FROM toks",
    "word_counts": f"WITH {SENTENCES} {COUNTS} SELECT word, cnt FROM counts",
    "vocab_min20": f"""WITH {SENTENCES} {VOCAB}
SELECT id, word, cnt FROM vocab UNION ALL
SELECT * FROM (VALUES (0, '<UNK>', NULL), (1, '<EOS>', NULL), (2, '<PAD>', NULL), (3, '<GO>', NULL))""",
    "corpus_size": f"""WITH {SENTENCES} {VOCAB}
SELECT count(*) AS n_sentences, sum((len(words) = 0)::INT)::BIGINT AS n_empty,
       sum(len(words))::BIGINT AS n_words, ((SELECT count(*) FROM vocab) + 4)::INT AS vocab_size
FROM sents""",
    "tokens_no_stop": f"WITH {CONTENT} {tokens_of('kept', 'toks')} "
                      "SELECT doc_id, sent_id, pos, word FROM toks",
    "token_ids": f"WITH {TOKEN_IDS} SELECT doc_id, sent_id, pos, id FROM ided",
    "oov_rate_by_lang": f"""WITH {TOKEN_IDS}
SELECT lang, count(*) AS n_tokens, sum((id = 0)::INT)::BIGINT AS n_unknown,
       round(avg((id = 0)::INT), 6) AS unknown_rate FROM ided GROUP BY lang""",
    "decoded_sentences": f"""WITH {TOKEN_IDS}
SELECT k.doc_id, k.sent_id,
       coalesce(string_agg(CASE WHEN id = 0 THEN '<UNK>' ELSE word END, ' ' ORDER BY pos), '') AS sentence
FROM kept k LEFT JOIN ided i ON k.doc_id = i.doc_id AND k.sent_id = i.sent_id GROUP BY ALL""",
    **{f"{mode}_pairs": f"""WITH {PAIRS[mode]}
SELECT doc_id, sent_id, array_to_string(in_ids, ' ') AS in_ids,
       array_to_string(out_ids, ' ') AS out_ids FROM pairs""" for mode in PAIRS},
    "pair_frames": f"WITH {FRAMES['next']} {SHOW_FRAMES}",
    "self_frames": f"WITH {FRAMES['self']} {SHOW_FRAMES}",
    "pair_mask": f"""WITH {FRAMES['next']}
SELECT doc_id, sent_id, out_len, array_to_string(
  list_transform(range({WIDTH}), lambda i: (i < out_len)::INT), ' ') AS mask FROM frames""",
    "reversed_inputs": f"""WITH {FRAMES['next']}
SELECT doc_id, sent_id, array_to_string(list_reverse("in"), ' ') AS "in",
       "in"[1] AS last_id FROM frames""",
    "sentence_matrix": f"""WITH {INDEXED}
SELECT doc_id, sent_id, array_to_string({padded(f'ids[1:{L}]')}, ' ') AS "in" FROM indexed""",
    "shuffled_batches": f"""WITH {batches(0)}
SELECT doc_id, sent_id, out_len, batch_id, row_in_batch FROM batched""",
    "full_batches": f"""WITH {batches(1)}
SELECT doc_id, sent_id, batch_id, row_in_batch FROM batched
WHERE batch_id < n // {SETTINGS.batch_size}""",
    "quoted_corpus": r"""WITH given AS (
  SELECT doc_id, replace(coalesce(text, ''), '. ', E'.\n') AS text FROM documents)
SELECT 'train' AS split, doc_id::INT AS doc_id, len(string_split(text, E'\n'))::INT AS n_lines, md5(text) AS digest
FROM given""",
    "batch_stats": f"""WITH {batches(0)}
SELECT batch_id, count(*) AS n_rows, sum(out_len)::BIGINT AS n_targets,
       max(out_len) AS longest FROM batched GROUP BY batch_id""",
}
