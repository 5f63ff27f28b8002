"""DuckDB SQL for the queries that SQL can express, written independently of the operators."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

OP6 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '{_WORD}') AS ws FROM t),
grams AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
          FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 5)) AS u(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_text_lines, count(*) - count(DISTINCT l) AS n_dup
          FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS l FROM t)
          WHERE regexp_matches(l, '{_WORD}') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda s: length(s))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
             coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(n_text_lines, 0) AS n_text_lines,
             len(regexp_extract_all(x, '!')) AS n_ex
      FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id),
b AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END
              + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
              + CASE WHEN 100 * n_symbols > 7 * word_chars THEN 4 ELSE 0 END
              + CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_text_lines THEN 8 ELSE 0 END
              + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
              + CASE WHEN 4 * n_ex > n_words THEN 32 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed,
       bits = 0 AS kept, bits & 15 = 0 AS kept_web_1, bits::BIGINT AS fail_bits, sole_rule,
       CASE WHEN sole_rule IS NOT NULL THEN count(*) OVER (PARTITION BY sole_rule) END AS n_sole
FROM (SELECT *, CASE bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines'
             WHEN 16 THEN 'word_length' WHEN 32 THEN 'exclamations' END AS sole_rule FROM b)
"""

_KEY = ("translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

OP7 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM d),
k AS (SELECT doc_id, i, l, {_KEY} AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
j AS (SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common ON common.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_FIVE = "('0x' || substr(h, 1 + 5 * k, 5))::BIGINT"

OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
d AS (SELECT page_id, strlen(x)::BIGINT AS payload_bytes, sha1(x) AS h, max(page_id) OVER (PARTITION BY x) AS leader FROM p),
q AS (SELECT page_id, k, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ({_FIVE} >> 15)::INT, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_FIVE} >> 10) & 31)::INT, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_FIVE} >> 5) & 31)::INT, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ({_FIVE} & 31)::INT, 1) AS s
      FROM d, unnest(range(0, 8)) AS u(k)),
b AS (SELECT page_id, string_agg(s, '' ORDER BY k) AS payload_digest FROM q GROUP BY page_id)
SELECT d.page_id, payload_bytes, payload_digest,
       CASE WHEN d.page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> leader THEN leader END AS refers_to
FROM d JOIN b ON b.page_id = d.page_id
"""

OP1 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(k.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN k ON k.a = v.vec_id
"""

_PLAIN = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({_PLAIN.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_PLAIN.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS w
        FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS u(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
       FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS u(i)),
hit AS MATERIALIZED (SELECT DISTINCT r, i, dw.n, item_id FROM dw JOIN win ON win.w = dw.w AND win.n = dw.n),
nh AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS u(k) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l
        FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh ON nh.r = d.r LEFT JOIN its ON its.r = d.r
"""

OP12 = rf"""
WITH RECURSIVE crc(t) AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i)
                          FROM range(256) AS u(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_PLAIN.format("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
many AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS x, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(x, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
          ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM many),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
typed AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (SELECT word, i, substring(word, 1, i - 1) AS a, substring(word, i + 1) AS z FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
near AS MATERIALIZED (SELECT x.word AS word, y.word AS other FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
         UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = a || z
         UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = a || z),
best AS (SELECT near.word, count(*) AS n_near, arg_min(o.word, (-o.n, o.word)) AS other, max(o.n) AS n FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
forms AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.n >= 5 * words.n THEN other END AS form,
          CASE WHEN best.n >= 5 * words.n THEN best.n END::BIGINT AS form_n FROM words LEFT JOIN best ON best.word = words.word),
chain(word, tail) AS (SELECT word, word FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.tail WHERE form IS NOT NULL),
ends AS (SELECT chain.word, chain.tail AS root FROM chain JOIN forms ON forms.word = chain.tail WHERE form IS NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ends ON ends.word = forms.word
"""

OP13 = rf"""
WITH pieces AS MATERIALIZED (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_PLAIN.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS MATERIALIZED (SELECT lang, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase, count(*) AS a
          FROM pieces, range(1, 5) AS s(m), unnest(range(1, len(ws) - m + 2)) AS u(i) GROUP BY ALL HAVING count(*) >= 30),
cand AS MATERIALIZED (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM grams WHERE m > 1),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS f, array_to_string(w[k + 1:], ' ') AS g FROM cand, unnest(range(1, m)) AS u(k)),
scored AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, 2000000::HUGEINT * c.a // (x.a::HUGEINT + y.a) AS score
           FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = f JOIN grams y ON y.lang = c.lang AND y.phrase = g),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_of AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS longer
             FROM cand, range(2, 4) AS s(z), unnest(range(1, m - z + 2)) AS u(i) WHERE z < m GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inner_of o ON o.lang = lowest.lang AND o.phrase = lowest.phrase
         WHERE NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op1_embedding_near_dup": OP1, "op2_warc_archive": OP2, "op6_quality_ledger": OP6, "op7_line_dedup": OP7,
                           "op11_winnowing": OP11, "op12_spelling_variants": OP12, "op13_collocations": OP13}
