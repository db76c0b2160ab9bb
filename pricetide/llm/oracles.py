"""DuckDB SQL for the queries of this subpackage that SQL can express, written apart from the operators."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    """List of the words of a text."""
    return rf"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


OP1 = f"""
    WITH RECURSIVE words AS (
      SELECT doc_id, {_words(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents
    ), sets AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
      FROM words
    ), shingles AS (
      SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
    ), pairs AS (
      SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
      FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
    ), links AS (
      SELECT a, b FROM pairs WHERE 100 * k >= 80 * (na + nb - k)
    ), edges AS (
      SELECT a, b FROM links UNION ALL SELECT b, a FROM links
    ), reach(node, root) AS (
      SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON r.node = e.a
    )
    SELECT s.doc_id, len(s.s)::bigint AS n_shingles, (SELECT min(root) FROM reach r WHERE r.node = s.doc_id) AS component_id,
      CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY list_sort(s.s)) END AS rep_id
    FROM sets s"""


def _escaped(text: str) -> str:
    """Length of a text with its three control characters escaped by one more character each."""
    return f"3 * length({text}) + length({text}) - " + " - ".join(
        f"length(replace({text}, {char}, ''))" for char in ("chr(92)", "'<'", "'['")
    )


OP7 = f"""
    WITH turns AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
      coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
      sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length('<s>[INST]  [/INST]</s>') + {_escaped("role")} + {_escaped("t")})::bigint AS formatted_chars
    FROM turns GROUP BY conv_id"""

OP9 = f"""
    WITH sized AS (
      SELECT doc_id, source, len({_words("text")})::bigint AS size, md5(coalesce(doc_id::varchar, '')) AS key FROM documents
    ), sources AS (
      SELECT source, sum(size)::bigint AS source_size FROM sized GROUP BY source
    ), weighed AS (
      SELECT *, 2.0::double * source_size AS cap,
        [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int]::double AS weight
      FROM sources
    ), levels AS (
      -- The level if all sources with a lower cap by weight were full and the others shared the rest.
      SELECT w.source, w.cap, w.weight,
        (1.5::double * (SELECT sum(source_size) FROM sources) - coalesce(sum(o.cap) FILTER (o.cap / o.weight < w.cap / w.weight), 0))
          / sum(o.weight) FILTER (o.cap / o.weight >= w.cap / w.weight) AS level
      FROM weighed w CROSS JOIN weighed o GROUP BY w.source, w.cap, w.weight
    ), targets AS (
      SELECT w.source, w.source_size,
        least(w.cap, coalesce((SELECT max(level) FROM levels WHERE level <= cap / weight) * w.weight, w.cap)) AS target
      FROM weighed w
    ), queued AS (
      SELECT s.doc_id, s.source, s.size, s.key, t.source_size, t.target,
        sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size) AS served
      FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    ), asked AS (
      SELECT *, (served + turn * source_size) / target AS finish
      FROM queued, (VALUES (0), (1)) copies(turn) WHERE target > 0
    ), summed AS (
      SELECT *, sum(size) OVER (ORDER BY finish, coalesce('s' || source, ''), key, doc_id, size, turn) AS total FROM asked
    ), taken AS (
      SELECT doc_id, sum(size) AS taken FROM summed
      WHERE total <= (SELECT sum(target) FROM targets) * (1 + 1e-9) GROUP BY doc_id
    )
    SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::bigint AS taken
    FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id"""

#: crc32 of a text of ASCII characters: the table by eight shifts of each byte, then a fold over the characters.
_CRC_TABLE = """
    SELECT list(c ORDER BY i) AS steps FROM (
      SELECT i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
      FROM range(256) r(i))"""


def _crc32(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda s: ord(s)::bigint)"
    fold = f"list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]))"
    return f"xor(4294967295, {fold})"


OP11 = f"""
    WITH crc AS ({_CRC_TABLE}), texts AS (
      SELECT doc_id, {_words("text")} AS w, {_crc32("doc_id::varchar")} AS h FROM documents, crc
    ), sized AS (
      SELECT *, len(w) AS n, h // 10 AS g FROM texts
    ), edits AS (
      SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM sized
    ), placed AS (
      SELECT doc_id, n, list_transform(range(n),
        lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) AS w FROM edits
    ), words AS (
      SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM placed
    ), equal AS (
      SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y
      ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
    ), islands AS (
      SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal
    ), stretches AS (
      SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM islands GROUP BY doc_id, q, island
    ), runs AS (
      SELECT doc_id, start, length, min(q) AS period FROM stretches
      WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length
    ), best AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::double / period DESC, start, period) AS place FROM runs
    ), told AS (
      SELECT doc_id, count(*) AS n_runs,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
      FROM runs GROUP BY doc_id
    ), gone AS (
      SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
    ), kept AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
    )
    SELECT p.doc_id, coalesce(t.n_runs, 0)::bigint AS n_runs, b.start::bigint AS start, b.length::bigint AS length,
      b.period::bigint AS period, (1000 * b.length // b.period)::bigint AS exponent_milli,
      sha256(coalesce(t.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
    FROM placed p LEFT JOIN told t ON p.doc_id = t.doc_id LEFT JOIN kept k ON p.doc_id = k.doc_id
    LEFT JOIN best b ON p.doc_id = b.doc_id AND b.place = 1"""

ORACLES: dict[str, str] = {"op1_jaccard_join": OP1, "op7_chat": OP7, "op9_mixing": OP9, "op11_periodic_runs": OP11}
