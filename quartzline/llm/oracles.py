"""Results of the registered queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from quartzline.llm import line_cleaning

_MERKLE = """
WITH RECURSIVE
field AS (
    SELECT doc_id, lang,
           CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR END
           || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
           || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS front,
           n_chars,
           CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS rear,
           list_reduce(
               list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, 1 + length(doc_id::VARCHAR)), lambda i: [ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT + 1000, 0, 0, 0, 0, 0, 0, 0, 0]))),
               lambda crc, x: CASE WHEN x >= 1000 THEN xor(crc, x - 1000) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END
           ) AS crc
    FROM documents
),
leaf AS (
    SELECT doc_id, coalesce('=' || lang, '') AS g,
           sha256(front || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR END || rear) AS h,
           sha256(front || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR END || rear) AS changed,
           coalesce(xor(crc, 4294967295) % 7 = 0, false) AS tampered
    FROM field
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaf
),
tree AS (
    SELECT g, 0 AS lvl, idx AS i, n, h FROM placed
    UNION ALL
    SELECT g, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, lvl, i // 2, n
),
subroot AS (SELECT g, lvl AS height, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (
    SELECT 0 AS lvl, idx AS i, n, h FROM subroot
    UNION ALL
    SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY lvl, i // 2, n
),
nodes AS (
    SELECT g, lvl, i, n, h FROM tree WHERE n > 1
    UNION ALL
    SELECT s.g, s.height + u.lvl, u.i, u.n, u.h FROM subroot s, upper u
),
climb AS (
    SELECT p.doc_id, p.g, p.idx AS start, 0 AS lvl, p.idx AS i, s.height, s.idx AS place,
           CASE WHEN p.tampered THEN p.changed ELSE p.h END AS h, '' AS proof
    FROM placed p JOIN subroot s USING (g)
    UNION ALL
    SELECT c.doc_id, c.g, c.start, c.lvl + 1, CASE WHEN c.lvl + 1 = c.height THEN c.place ELSE spot // 2 END, c.height, c.place,
           sha256(CASE WHEN spot % 2 = 1 THEN coalesce(o.h, '') || c.h ELSE c.h || coalesce(o.h, '') END),
           c.proof || coalesce(o.h, '')
    FROM (SELECT *, CASE WHEN lvl = height THEN place ELSE i END AS spot FROM climb) c
    JOIN nodes me ON me.g = c.g AND me.lvl = c.lvl AND me.i = c.spot AND me.n > 1
    LEFT JOIN nodes o ON o.g = c.g AND o.lvl = c.lvl AND o.i = xor(c.spot, 1)
)
SELECT c.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = r.h AS verified
FROM (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY g, start ORDER BY lvl DESC) = 1) c
JOIN placed p ON p.g = c.g AND p.idx = c.start
JOIN subroot s ON s.g = c.g, (SELECT h FROM upper WHERE n = 1) r
"""

_NEAR = r"""
WITH RECURSIVE
worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
    SELECT doc_id,
           CASE WHEN len(w) = 0 THEN []
                WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
    FROM worded
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(least(l.b, s.doc_id), s.doc_id) AS component_id,
       coalesce(least(l.b, s.doc_id), s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN least l ON l.a = s.doc_id
"""

# windows of 400 bytes as 800 hexadecimal digits
_REPEATS = r"""
WITH texts AS (SELECT doc_id, lower(hex(coalesce(text, ''))) AS h FROM documents),
pieces AS (
    SELECT doc_id, x.s AS s, x.h AS h
    FROM (SELECT doc_id, unnest(list_transform(range(0, length(h) // 2 - 399, 1000), lambda i: {'s': i, 'h': substr(h, 2 * i::INT + 1, 2798)})) AS x FROM texts)
),
windows AS (
    SELECT doc_id, s + x.p AS p, x.name AS name
    FROM (SELECT doc_id, s, unnest(list_transform(range(0, length(h) // 2 - 399), lambda i: {'p': i, 'name': md5(substr(h, 2 * i::INT + 1, 800))})) AS x FROM pieces)
),
twice AS (SELECT name FROM windows GROUP BY name HAVING count(*) > 1),
starts AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prior FROM windows WHERE name IN (SELECT name FROM twice)),
runs AS (SELECT doc_id, p, sum(CASE WHEN prior IS NULL OR p > prior + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM starts),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b FROM runs GROUP BY doc_id, run),
ordered AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM spans),
cut AS (
    SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
           string_agg(substr(h, 2 * from_::INT + 1, 2 * (a - from_)::INT), '' ORDER BY a)
           || max(CASE WHEN next IS NULL THEN substr(h, 2 * b::INT + 1) ELSE '' END) AS kept
    FROM ordered JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT t.doc_id, (length(t.h) // 2)::BIGINT AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(c.kept, t.h))) AS kept_sha256,
       CASE WHEN t.h = '' THEN 0 ELSE coalesce(c.n_removed, 0)::DOUBLE / (length(t.h) // 2) END AS removed_share
FROM texts t LEFT JOIN cut c USING (doc_id)
"""

_PHRASES = " OR ".join(f"contains(low, '{p}')" for p in line_cleaning.BOILERPLATE)
_LINES = rf"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS held
    FROM documents
),
lines AS (SELECT doc_id, line, lower(line) AS low, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
                 len(regexp_extract_all(line, '[|»«›‹•·]')) AS marks, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols
          FROM (SELECT doc_id, unnest(list_distinct(held)) AS line FROM texts)),
passed AS (
    SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM lines
    WHERE NOT ((marks >= 2 AND marks * 4 >= words) OR (symbols >= 2 AND symbols * 3 >= words)
               OR (words < 4 AND NOT regexp_matches(line, '[.!?…:;。！？]["''”’»)\]\x20\x09-\x0D]*$'))
               OR (words <= 40 AND ({_PHRASES})))
    GROUP BY doc_id
),
runs AS (
    SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.k) AS n
    FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'k': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}})) AS x FROM texts)
),
repeated AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM runs WHERE n > 1) GROUP BY doc_id),
counted AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(held) - len(list_distinct(held)))::BIGINT AS n_dup_lines,
           coalesce(r.n, 0)::BIGINT AS n_repeat_words, (len(held) - coalesce(p.n, 0))::BIGINT AS lines_failed, coalesce(p.chars, 0)::BIGINT AS kept_word_chars
    FROM texts LEFT JOIN passed p USING (doc_id) LEFT JOIN repeated r USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_word_chars > 0 AND kept_word_chars * 100 >= word_chars * 50 AS kept
FROM counted
"""

# The rules of the scan: prefix, secret, what follows it, least characters of the secret.
_SECRETS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?""", "[A-Za-z0-9+/_.=-]+", "", 6),
    "access": ("", "AKIA[A-Z0-9]+", "", 20),
    "hex": ("", "[0-9a-f]+", "", 24),
    "private_key": ("", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "", 1),
    "web_token": ("", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "", 1),
    "bearer": (r"[Bb]earer\x20+", "[A-Za-z0-9+/_.=-]{16,}", "", 1),
    "url_login": (r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:", "[^\\s/:@]{3,64}", "@", 1),
}
_MARKED = " UNION ALL ".join(
    rf"SELECT doc_id, {place} AS place, '{kind}' AS kind, {least} AS least, "
    rf"string_split(regexp_replace(t, '({prefix})({secret}){after}', chr(57344) || '\1' || chr(57345) || '\2' || chr(57346) || '{after}', 'g'), chr(57344)) AS pieces FROM texts"
    for place, (kind, (prefix, secret, after, least)) in enumerate(_SECRETS.items())
)
_LEDGER = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS raw, translate(coalesce(text, ''), chr(57344) || chr(57345) || chr(57346), repeat(chr(65533), 3)) AS t FROM documents),
marked AS ({_MARKED}),
each AS (SELECT doc_id, place, kind, least, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM marked WHERE len(pieces) > 1),
sized AS (
    SELECT *, instr(piece, chr(57345)) AS mid, instr(piece, chr(57346)) AS last,
           sum(length(piece) - CASE WHEN contains(piece, chr(57346)) THEN 2 ELSE 0 END) OVER (PARTITION BY doc_id, place ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start
    FROM each
),
found AS (SELECT doc_id, place, kind, start::BIGINT AS start, (start + last - 2)::BIGINT AS finish FROM sized WHERE i > 1 AND last - mid - 1 >= least),
listed AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, place) FILTER (place < 3) AS base,
           string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, place) AS spans
    FROM found GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(raw) AS blob
FROM texts LEFT JOIN listed USING (doc_id)
"""

SQL = {"op2_minhash_dedup": _NEAR, "op6_blob_ledger": _LEDGER, "op9_repeated_spans": _REPEATS, "op10_line_cleaning": _LINES, "op13_merkle_manifest": _MERKLE}
