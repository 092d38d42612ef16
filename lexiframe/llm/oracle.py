"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t
  FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
b AS (
  SELECT *, len(words) AS n, length(t) AS chars,
         [length(regexp_replace(t, '[^\p{L}]+', '', 'g')), length(regexp_replace(t, '[^\p{N}]+', '', 'g')),
          length(regexp_replace(t, '[^\x20\x09-\x0D]+', '', 'g')),
          length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')),
          length(regexp_replace(t, '[^.,;:!?''"()\-]+', '', 'g'))] AS classes
  FROM w),
starts AS (SELECT rid, words, unnest(range(1, n - 6)) AS i FROM b WHERE n >= 8),
windows AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win FROM starts),
again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows),
gaps AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS g
         FROM again WHERE c > 1),
repeated AS (SELECT rid, sum(g) AS r FROM gaps GROUP BY rid),
lang_chars AS (
  SELECT lang, sum(chars) AS chars, list_concat(
    [sum(classes[1]), sum(classes[2]), sum(classes[3]), sum(classes[4]), sum(classes[5])],
    [sum(chars) - sum(classes[1]) - sum(classes[2]) - sum(classes[3]) - sum(classes[4]) - sum(classes[5])]
    ) AS ref FROM b GROUP BY lang),
tokens AS (SELECT rid, lang, unnest(words) AS word FROM b),
lang_words AS (SELECT lang, word, count(*) AS n FROM tokens GROUP BY lang, word),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total,
                  row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM lang_words),
top AS (SELECT lang, word, n / total AS q FROM ranked WHERE k <= 24),
totals AS (SELECT lang, any_value(total) AS total FROM ranked GROUP BY lang),
seen AS (SELECT rid, lang, word, count(*) AS c FROM tokens GROUP BY rid, lang, word),
shares AS (
  SELECT b.rid, top.word, coalesce(seen.c, 0) / b.n AS p, top.q
  FROM b JOIN top USING (lang) LEFT JOIN seen ON seen.rid = b.rid AND seen.word = top.word
  WHERE b.n >= 50),
bins AS (
  SELECT rid, p, q FROM shares
  UNION ALL SELECT rid, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) FROM shares GROUP BY rid),
halves AS (
  SELECT rid, CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
            + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END AS x FROM bins),
word_distance AS (SELECT rid, sqrt(greatest(0, sum(x) / 2)) AS dist FROM halves GROUP BY rid),
class_bins AS (
  SELECT rid, unnest(list_append(classes, b.chars - list_sum(classes))) / b.chars AS p,
         unnest(ref) / lang_chars.chars AS q
  FROM b JOIN lang_chars USING (lang) WHERE n >= 50),
class_distance AS (
  SELECT rid, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
       + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS dist
  FROM class_bins GROUP BY rid),
judged AS (
  SELECT b.*, coalesce(r, 0) AS r, b.n < 20 OR 100 * coalesce(r, 0) > 30 * b.n AS failed,
         b.n >= 50 AND totals.total >= 1000 AS checked, w.dist AS wd, c.dist AS cd
  FROM b LEFT JOIN repeated USING (rid) LEFT JOIN totals USING (lang)
  LEFT JOIN word_distance w USING (rid) LEFT JOIN class_distance c USING (rid))
SELECT doc_id, n::BIGINT AS n_words, (chars - classes[3])::BIGINT AS word_chars,
       classes[4]::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
       r::BIGINT AS n_repeat_words, failed AS base_failed,
       NOT failed AND (NOT coalesce(checked, false) OR (cd <= 0.28 AND wd <= 0.42)) AS kept
FROM judged
"""

LINE_DEDUP = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
l AS (SELECT *, trim(regexp_replace(lower(raw), '[\x09-\x0D\x20\x{85}\x{A0}]+', ' ', 'g')) AS norm FROM cut),
firsts AS (SELECT norm, min((doc_id, pos)) AS first_at FROM l WHERE norm <> '' GROUP BY norm),
sized AS (SELECT *, unnest([length(norm), length(norm) + 1]) AS m FROM firsts WHERE length(norm) >= 16),
keyed AS (
  SELECT norm, first_at, m, 0 AS side, left(norm, m // 2) AS k FROM sized
  UNION ALL SELECT norm, first_at, m, 1, right(norm, m - m // 2) FROM sized),
near AS (
  SELECT DISTINCT a.first_at FROM keyed a JOIN keyed b USING (m, side, k)
  WHERE b.first_at < a.first_at AND levenshtein(a.norm, b.norm) <= 1),
stays AS (
  SELECT doc_id, raw, pos, norm,
         norm = '' OR ((doc_id, pos) IN (SELECT first_at FROM firsts) AND (doc_id, pos) NOT IN (SELECT first_at FROM near)) AS s
  FROM l)
SELECT doc_id, count(*) FILTER (norm <> '') AS n_lines, count(*) FILTER (norm <> '' AND s) AS n_kept,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (s), '')) AS text_sha256
FROM stays GROUP BY doc_id
"""


def licences() -> str:
    """The scan in SQL, from the raw known texts."""
    from lexiframe.llm.licences import NOTICES, SPELLINGS, TEXTS
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    known = [(name, t) for name, (title, body) in TEXTS.items() for t in (body, f"{title}\n\n{body}")]
    known += [(name, t) for name, notices in NOTICES.items() for t in notices]
    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in known)

    def canonical(text: str) -> str:
        out = (r"trim(regexp_replace(regexp_replace(lower(%s), '(?m)^[ \t#/*;%%>-]*(?:copyright[ \t]*(?:\(c\)|©|"
               r"[0-9<\[{]|:)|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*$', ' ', 'g'), "
               r"'[^\p{L}\p{N}]+', ' ', 'g'))" % text)
        for old, new in SPELLINGS.items():
            out = f"replace({out}, '{old}', '{new}')"
        return out

    return rf"""
WITH known AS (
  SELECT DISTINCT name, sha256({canonical('t')}) AS digest FROM (VALUES {values}) v(name, t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
units AS (
  SELECT rid, 0 AS kind, 0 AS pos, t AS u FROM d
  UNION ALL SELECT rid, 1, unnest(range(len(string_split(t, chr(10))))), unnest(string_split(t, chr(10))) FROM d
  UNION ALL SELECT rid, 2, unnest(range(len(regexp_split_to_array(t, '\n[ \t\r]*\n')))),
                   unnest(regexp_split_to_array(t, '\n[ \t\r]*\n')) FROM d
                   WHERE len(regexp_split_to_array(t, '\n[ \t\r]*\n')) > 1),
hits AS (
  SELECT rid, kind, pos, name FROM (SELECT *, {canonical('u')} AS c FROM units WHERE kind < 2 OR contains(u, chr(10)))
  JOIN known ON digest = sha256(c) WHERE c <> ''),
found AS (
  SELECT rid, min(name) FILTER (kind = 0) AS license, count(DISTINCT (kind, pos)) FILTER (kind > 0) AS n,
         string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM hits GROUP BY rid)
SELECT doc_id, sha256({canonical('t')}) AS text_digest, license, coalesce(n, 0)::BIGINT AS n_matches,
       coalesce(names, '') AS licenses
FROM d LEFT JOIN found USING (rid)
"""


def conversations() -> str:
    """Damage and cheapest repair of conversations: a dynamic programme over whole suffixes.

    Each state (nothing, s, u or a read last) holds the cost, the edits and the turns of the best
    way to the end, and rows are taken one by one from the last.
    """
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    keep = {0: "CASE ini WHEN 's' THEN s1 WHEN 'u' THEN s2 END", 1: "CASE ini WHEN 'u' THEN s2 END",
            2: "CASE ini WHEN 'a' THEN s3 END", 3: "CASE ini WHEN 'u' THEN s2 END"}
    name = {2: "user", 3: "assistant"}

    def way(cost: str, edit: str, said: str, rest: str) -> str:
        turns = f"list_concat([{said}], {rest}.o)" if said else f"{rest}.o"
        return f"{{'c': {rest}.c + {cost}, 'a': '{edit}' || {rest}.a, 'o': {turns}}}"

    def row(state: int) -> str:
        rest, kept = f"s{after[state]}", f"k{state}"
        return (f"least({way('3', 'D', '', f's{state}')}, CASE WHEN f < 2 THEN "
                f"{way('2 + f', 'R', f"'{name[after[state]]}:' || t", rest)} END, "
                f"CASE WHEN f < 2 AND {kept} IS NOT NULL THEN {way('f', 'K', "role || ':' || t", kept)} END) AS s{state}")

    def added(state: int) -> str:
        return f"least(s{state}, {way('2', 'I', f"'{name[after[state]]}:'", f's{after[state]}')}) AS s{state}"

    def each(make) -> str:
        return ", ".join(make(state) for state in range(4))

    return f"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' ||
           coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::BIGINT),
           lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 20 AS x
  FROM conversations, tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role,
         CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS t
  FROM src, unnest(range(CASE x WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(copy)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t) AS k FROM damaged),
faults AS (
  SELECT *, left(role, 1) AS ini,
         CASE WHEN NOT regexp_matches(t, '[^\\x20\\x09-\\x0D]') THEN 2
              WHEN row_number() OVER (PARTITION BY conv_id, role, t ORDER BY k) > 1 THEN 3
              WHEN regexp_matches(t, '[^.!?\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*\\z') THEN 1
              ELSE 0 END AS f,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (f = 2) AS blank, count(*) FILTER (f = 3) AS duplicate,
         count(*) FILTER (f = 1) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
ways AS (
  SELECT conv_id, n + 1 AS k, {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}} AS s0,
         {{'c': 4::BIGINT, 'a': 'II', 'o': ['user:', 'assistant:']}} AS s1,
         {{'c': 2::BIGINT, 'a': 'I', 'o': ['assistant:']}} AS s2,
         {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}} AS s3
  FROM counted
  UNION ALL
  SELECT conv_id, k, {each(added)} FROM (
    SELECT conv_id, k, {each(added)} FROM (
      SELECT conv_id, k, {each(row)} FROM (
        SELECT w.conv_id, r.k, r.role, r.t, r.f, s0, s1, s2, s3,
               {", ".join(f"{sql} AS k{state}" for state, sql in keep.items())}
        FROM ways AS w JOIN faults AS r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k - 1)))),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit,
       sha256(coalesce(array_to_string(s0.o, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN ways ON ways.k = 1 AND ways.conv_id IS NOT DISTINCT FROM ids.conv_id"""
