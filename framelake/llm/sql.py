"""DuckDB SQL of the contract queries that SQL can express."""

from __future__ import annotations

from framelake.llm.licenses import RULES, SENTENCES, known_pieces

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def lowered(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


def _license_sql() -> str:
    """Word sequences between sentence ends, looked up in the same tables; then rules over the joined identifiers."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in known_pieces(SENTENCES).items())
    rule = ", ".join(f"('{r.name}', '{r.license}', ' {' '.join(r.sequence)} ')" for r in RULES)
    hides = ", ".join(f"('{r.name}', '{h}')" for r in RULES for h in r.hides)
    ends = r"[.!?;:,]*[.!?;:]([\x20\x09-\x0D]|$)|\n[\x20\x09\x0B-\x0D]*\n"
    plain = r"[\x00\x02-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
        WITH known(piece, id) AS (VALUES {known}), rules(name, license, seq) AS (VALUES {rule}),
        hides(name, hidden) AS (VALUES {hides}),
        cut AS (
            SELECT doc_id, string_split(regexp_replace(regexp_replace({lowered("coalesce(text, '')")},
                '{ends}', chr(1) || '\\1', 'g'), '{plain}', ' ', 'g'), chr(1)) AS parts
            FROM documents
        ), s AS (
            SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i FROM cut
        ), c AS (
            SELECT doc_id, i, 0 AS j, trim(regexp_replace(piece, '[ \\n]+', ' ', 'g')) AS piece FROM s
            UNION ALL
            SELECT doc_id, i, generate_subscripts(ls, 1), trim(unnest(ls)) FROM (
                SELECT doc_id, i, string_split(piece, chr(10)) AS ls FROM s
                WHERE contains(trim(piece, ' ' || chr(10)), chr(10)))
        ), ids AS (
            SELECT doc_id, count(*) AS n_known, string_agg(id, ',' ORDER BY i, j) AS sentence_ids
            FROM c JOIN known ON c.piece = known.piece GROUP BY doc_id
        ), met AS (
            SELECT doc_id, name, license FROM ids JOIN rules
            ON contains(' ' || replace(sentence_ids, ',', ' ') || ' ', seq)
        ), shown AS (
            SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM met m
            WHERE NOT EXISTS (SELECT 1 FROM hides h JOIN met o ON o.name = h.name
                              WHERE o.doc_id = m.doc_id AND h.hidden = m.name)
            GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_known, 0) AS n_known, coalesce(sentence_ids, '') AS sentence_ids,
               coalesce(licenses, '') AS licenses
        FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id LEFT JOIN shown ON d.doc_id = shown.doc_id
    """


ORACLES = {
    "op4_license_scan": _license_sql(),
    "op2_line_dedup": f"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
        ), l AS (
            SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM split
        ), k AS (
            SELECT doc_id, line, i, {lowered(f"trim(line, {BLANKS})")} AS key FROM l
        ), r AS (
            SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        )
        SELECT k.doc_id, count(*) AS n_lines,
               count(*) FILTER (WHERE r.key IS NOT NULL AND k.doc_id <> r.last) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i)
                   FILTER (WHERE r.key IS NULL OR k.doc_id = r.last), '')) AS kept_sha256
        FROM k LEFT JOIN r ON k.key = r.key GROUP BY k.doc_id
    """,
    "op6_host_quality_rules": f"""
        WITH d AS (
            SELECT doc_id, source AS host, coalesce(text, '') AS body FROM documents
        ), w AS (
            SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
            FROM (SELECT doc_id, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)
        ), tri AS (
            SELECT doc_id, i, length(word) AS chars,
                   CASE WHEN lead(word, 2) OVER s IS NOT NULL
                        THEN word || ' ' || lead(word, 1) OVER s || ' ' || lead(word, 2) OVER s END AS t
            FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i)
        ), flagged AS (
            SELECT doc_id, i, chars, t IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, t) > 1 AS again FROM tri
        ), covered AS (
            SELECT doc_id, chars, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS 2 PRECEDING) AS hit
            FROM flagged
        ), per_doc AS (
            SELECT doc_id, count(*) AS n_words, sum(chars)::BIGINT AS word_chars,
                   count(*) FILTER (WHERE hit) AS n_repeat_words
            FROM covered GROUP BY doc_id
        ), lines AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
            FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM d)
            WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
        ), counts AS (
            SELECT d.doc_id, host, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                   length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM d LEFT JOIN per_doc p ON d.doc_id = p.doc_id LEFT JOIN lines l ON d.doc_id = l.doc_id
        ), fails AS (
            SELECT *, unnest([
                {{'r': 1, 'f': n_words < 50}},
                {{'r': 2, 'f': 100 * n_repeat_words > 50 * n_words}},
                {{'r': 3, 'f': n_symbols > 0.1::DOUBLE * n_words}},
                {{'r': 4, 'f': 100 * n_dup_lines > 5 * n_words}},
                {{'r': 5, 'f': NOT (word_chars / greatest(n_words, 1)::DOUBLE BETWEEN 2 AND 15)}}], recursive := true)
            FROM counts
        ), host_rates AS (
            SELECT host, r, count(*) AS n, count(*) FILTER (WHERE f) AS k FROM fails GROUP BY host, r
        ), means AS (
            SELECT r, sum(k) / sum(n)::DOUBLE AS m, sum(n) AS total FROM host_rates GROUP BY r
        ), priors AS (
            SELECT h.r, any_value(m) AS m, sum(n * (k / n::DOUBLE - m) ** 2) / any_value(total) AS v
            FROM host_rates h JOIN means USING (r) GROUP BY h.r
        ), verdicts AS (
            SELECT host, h.r, (k + weight * m) / (n + weight) > 0.5 AS bad
            FROM host_rates h JOIN (
                SELECT r, m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1e6 END, 1), 1e6) AS weight
                FROM priors) p ON h.r = p.r
        )
        SELECT doc_id, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars,
               any_value(n_symbols) AS n_symbols, any_value(n_dup_lines) AS n_dup_lines,
               any_value(n_repeat_words) AS n_repeat_words, bool_or(f AND fails.r <= 2) AS base_failed,
               NOT bool_or(f AND (fails.r <= 2 OR bad)) AND count(*) FILTER (WHERE f) < 2 AS kept
        FROM fails LEFT JOIN verdicts v ON fails.host IS NOT DISTINCT FROM v.host AND fails.r = v.r
        GROUP BY doc_id
    """,
    "op10_benchmark_decontamination": f"""
        WITH tokens AS (
            SELECT kind, id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n
            FROM (
                SELECT kind, id, regexp_extract_all(body, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM (
                    SELECT 'd' AS kind, doc_id::VARCHAR AS id, {lowered("coalesce(text, '')")} AS body FROM documents
                    UNION ALL
                    SELECT 'b', item_id::VARCHAR, {lowered("coalesce(text, '')")} FROM benchmark))
        ), sizes AS (
            SELECT DISTINCT least(n, 10) AS size FROM tokens WHERE kind = 'b'
        ), runs AS (
            SELECT kind, id, n, size, i, list_aggregate(list(word) OVER (PARTITION BY kind, id, size ORDER BY i
                ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)[1:size], 'string_agg', ' ') AS gram
            FROM tokens, sizes WHERE kind = 'd' OR size = least(n, 10)
        ), whole AS (
            SELECT * FROM runs WHERE i + size - 1 <= n
        ), windows AS (
            SELECT DISTINCT id AS item, size, gram FROM whole WHERE kind = 'b'
        ), met AS (
            SELECT d.id, d.i, d.size, w.item
            FROM whole d JOIN windows w ON d.gram = w.gram AND d.size = w.size WHERE d.kind = 'd'
        ), hit AS (
            SELECT id, count(DISTINCT p) AS n_hit
            FROM (SELECT id, unnest(range(i, i + size)) AS p FROM met) GROUP BY id
        ), items AS (
            SELECT id, count(DISTINCT item) AS n_items, list_sort(list(DISTINCT item)) AS names FROM met GROUP BY id
        )
        SELECT d.doc_id, coalesce(t.n, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM documents d
        LEFT JOIN (SELECT id, max(n) AS n FROM tokens WHERE kind = 'd' GROUP BY id) t ON d.doc_id::VARCHAR = t.id
        LEFT JOIN hit ON d.doc_id::VARCHAR = hit.id LEFT JOIN items ON d.doc_id::VARCHAR = items.id
    """,
    "op12_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
                   sha256('1:' || doc_id) AS h
            FROM documents
        ), k AS (
            SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS k1,
                   CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS k2,
                   CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS k3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS k4
            FROM d
        ), p AS (
            SELECT doc_id, n, body, array_to_string(units[1:least(k1, k2)], '') AS a,
                   array_to_string(units[least(k1, k2) + 1:greatest(k1, k2)], '') AS b,
                   array_to_string(units[greatest(k1, k2) + 1:], '') AS c,
                   CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR k3 >= 90
                        THEN 'plain' WHEN k4 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM k
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN concat('<P>', a, '<S>', c, '<M>', b)
                      ELSE concat('<S>', c, '<P>', a, '<M>', b) END) AS output_sha256,
               sha256(body) AS restored_sha256
        FROM p
    """,
    "op13_conversation_trie": """
        WITH crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t
        ), t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place, digest, words
            FROM (SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', role, text)) AS digest,
                         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
                  FROM conversations WHERE conv_id IS NOT NULL)
        ), ids AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295,
                list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM t), crc
        ), turns AS (
            SELECT i.conv_id, 0 AS own, t.place, digest, words FROM ids i JOIN t ON t.conv_id = i.base AND t.place <= i.h
            UNION ALL
            SELECT i.conv_id, 1, t.place, digest, words FROM ids i JOIN t ON t.conv_id = i.conv_id AND t.place > i.h
        ), paths AS (
            SELECT i.conv_id, coalesce(list(digest ORDER BY own, place) FILTER (WHERE digest IS NOT NULL), []) AS ds,
                   coalesce(list(words ORDER BY own, place) FILTER (WHERE digest IS NOT NULL), []) AS ws
            FROM ids i LEFT JOIN turns t ON t.conv_id = i.conv_id GROUP BY i.conv_id
        ), steps AS (
            SELECT conv_id, unnest(range(len(ds) + 1)) AS depth, ds, ws FROM paths
        ), opened AS (
            SELECT conv_id, depth, ds[1:depth] AS node, ds[1:depth - 1] AS above, coalesce(ws[depth], 0) AS words, depth = len(ds) AS ended FROM steps
        ), nodes AS (
            SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(above) AS above, count(*) AS n_convs,
                   (count(*) - 1) * any_value(words) AS saved,
                   sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
            FROM opened GROUP BY node
        ), sized AS (
            SELECT n.*, coalesce(k.n_children, 0) AS n_children
            FROM nodes n LEFT JOIN (SELECT above, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above) k ON k.above = n.node
        ), sums AS (
            SELECT o.node, count(*) FILTER (WHERE s.n_children = 0) AS n_leaves, sum(s.saved) AS saved_tokens
            FROM sized s JOIN opened o ON o.conv_id = s.conv_id AND o.depth <= s.depth GROUP BY o.node
        )
        SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, s.ends_sha256
        FROM sized s JOIN sums ON sums.node = s.node LEFT JOIN nodes p ON s.depth > 0 AND p.node = s.above
    """,
}
