"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: A-Z of a text in lower case.
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Value of the k-th 5 bits of a string of 0 and 1.
BASE32_DIGIT = " + ".join(f"substr(bits, 5 * k + {j + 1}, 1)::INTEGER * {16 >> j}" for j in range(5))

#: All terms of a text, A-Z in lower case.
TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(ASCII_LOWER.format("coalesce(text, '')"))
#: A value as its UTF-8 byte count, a colon and itself, or - if null; the digest of a document's values.
FIELD = "coalesce(concat(strlen(({})::VARCHAR), ':') || ({})::VARCHAR, '-')"
LEAF = "sha256(concat(" + ", ".join(FIELD.format(c, c) for c in ("doc_id", "source", "lang", "{n}", "text")) + "))"
#: CRC-32 of the decimal doc_id, bit by bit.
CRC32 = "xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, c: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(a, c)), 4294967295::BIGINT))"

SQL = {
    "op1_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS win
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
        least_doc AS (SELECT win, min(doc_id) AS m FROM win GROUP BY win HAVING min(doc_id) < max(doc_id)),
        cut AS (SELECT DISTINCT doc_id, s + k AS p
                FROM (SELECT win.doc_id, s FROM win JOIN least_doc USING (win) WHERE win.doc_id > m), range(13) AS r(k)),
        word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op7_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
        win AS (SELECT doc_id, s, array_to_string(w[s:s + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)),
        twice AS (SELECT doc_id, win FROM win GROUP BY ALL HAVING count(*) > 1),
        rep AS (SELECT doc_id, count(DISTINCT s + k) AS n FROM win JOIN twice USING (doc_id, win), range(5) AS r(k) GROUP BY doc_id),
        line AS (SELECT doc_id, l, list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
        worded AS (SELECT doc_id, l, len(lw) AS nw, len(array_to_string(lw, '')) AS solid,
                   len(l) - len(regexp_replace(l, '[#*$%&|<>]', '', 'g')) AS sym, len(l) - len(regexp_replace(l, '[|»>•·›]', '', 'g')) AS items FROM line WHERE len(lw) > 0),
        judged AS (SELECT *, sym > 0.1 * solid OR (items >= 3 AND nw - items <= 2.5 * (items + 1))
                   OR (nw <= 25 AND regexp_matches(l, '(?i)all rights reserved|terms (of|and) (use|service|conditions)|privacy policy|cookie(s| policy| settings)|sign (up|in) (for|to|now)|log ?in to|subscribe (to|now)|newsletter|click here|read more|share (this|on)|powered by|enable javascript|javascript is (disabled|required)|lorem ipsum|skip to (main )?content|back to top'))
                   OR NOT regexp_matches(l, '[.!?…:;。！？।؟]["''”’»)\]}}*_ \t\r]*$') AS bad FROM worded),
        per_line AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup, coalesce(sum(nw) FILTER (bad), 0) AS lost FROM judged GROUP BY doc_id),
        base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
                 FROM d LEFT JOIN per_line USING (doc_id) LEFT JOIN rep USING (doc_id)),
        failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 * n_words AND n_words - lost >= 10 AS kept FROM failed
    """,
    "op9_ngram_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS s FROM d)),
        size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
        sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(s, v) AS (SELECT DISTINCT a, a FROM sym UNION SELECT s, b FROM reach JOIN sym ON v = a),
        comp AS (SELECT s, min(v) AS c FROM reach GROUP BY s)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
        FROM d LEFT JOIN size USING (doc_id) LEFT JOIN comp ON s = d.doc_id
    """,
    "op3_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top,
              array_to_string(list_transform(string_split(sha1(h), ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + {BASE32_DIGIT})::BIGINT, 1)), '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
        FROM g
    """,
    "op6_url_rules": rf"""
        WITH r AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, url, {ASCII_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        j AS (SELECT *, CASE WHEN suffix(concat('.', host), '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                             WHEN suffix(concat('.', host), '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                             WHEN suffix(concat('.', host), '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                             WHEN suffix(concat('.', host), '.com') AND starts_with(path, '/de/') THEN 'com/de/'
                             WHEN suffix(concat('.', host), '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM h),
        v AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS listed FROM j),
        tok AS (SELECT DISTINCT page_id, listed, rule, unnest(list_concat(
                  [concat('scheme=', {ASCII_LOWER.format("split_part(url, '://', 1)")}), concat('top=', string_split(host, '.')[-1])],
                  list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: concat('host=', x)),
                  list_transform(list_filter(string_split_regex({ASCII_LOWER.format("path")}, '[/.\-_]'), lambda x: x <> ''), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN concat('number=', x[1]) ELSE concat('path=', x) END),
                  list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: concat('query=', split_part(x, '=', 1))))) AS t
                FROM v WHERE host <> ''),
        combo AS (SELECT page_id, listed, [t] AS items FROM tok
                  UNION ALL SELECT a.page_id, a.listed, [a.t, b.t] FROM tok a JOIN tok b ON a.page_id = b.page_id AND a.t < b.t
                  UNION ALL SELECT a.page_id, a.listed, [a.t, b.t, c.t] FROM tok a JOIN tok b ON a.page_id = b.page_id AND a.t < b.t JOIN tok c ON c.page_id = a.page_id AND b.t < c.t
                  UNION ALL SELECT a.page_id, a.listed, [a.t, b.t, c.t, d.t] FROM tok a JOIN tok b ON a.page_id = b.page_id AND a.t < b.t JOIN tok c ON c.page_id = a.page_id AND b.t < c.t JOIN tok d ON d.page_id = a.page_id AND c.t < d.t),
        whole AS (SELECT items, count(*) AS n FROM combo WHERE listed IS NOT NULL GROUP BY items),
        strong AS (SELECT items, listed AS label, count(*) AS m, count(*) / any_value(n) AS confidence FROM combo JOIN whole USING (items) WHERE listed IS NOT NULL GROUP BY ALL
                   HAVING count(*) >= ceil(0.005 * (SELECT count(*) FROM v WHERE listed IS NOT NULL)) AND count(*) / any_value(n) >= 0.9),
        mined AS (SELECT * FROM strong s WHERE NOT EXISTS (SELECT 1 FROM strong p WHERE p.label = s.label AND len(p.items) < len(s.items) AND list_has_all(s.items, p.items))),
        best AS (SELECT page_id, label, items, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, m DESC, label = 'allow' DESC, label DESC, items DESC) AS k
                 FROM combo JOIN mined USING (items) WHERE combo.listed IS NULL)
        SELECT v.page_id, host, path, rule, coalesce(listed, label, 'allow') AS verdict, array_to_string(items, ' ') AS matched
        FROM v LEFT JOIN best ON best.page_id = v.page_id AND k = 1
    """,
    "op11_merkle_manifest": rf"""
        WITH RECURSIVE base AS (SELECT doc_id, lang, {LEAF.format(n="n_chars")} AS leaf, CASE WHEN {CRC32} % 7 = 0 THEN {LEAF.format(n="n_chars + 1")} END AS other FROM documents),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM base),
        up(lang, level, i, h) AS (
            SELECT lang, 0, i, leaf FROM placed
            UNION ALL
            SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS m FROM up) WHERE m > 1 GROUP BY lang, level, i // 2),
        sub AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT lang, level AS height, h AS subroot FROM up QUALIFY level = max(level) OVER (PARTITION BY lang))),
        top(level, i, h) AS (
            SELECT 0, g, subroot FROM sub
            UNION ALL
            SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS m FROM top) WHERE m > 1 GROUP BY level, i // 2),
        whole AS (SELECT level AS top_height, h AS root FROM top ORDER BY level DESC LIMIT 1),
        doc AS (SELECT row_number() OVER () AS k, placed.*, subroot, height, g, root, top_height FROM placed JOIN sub ON sub.lang IS NOT DISTINCT FROM placed.lang, whole),
        step AS (SELECT k, x.level AS s, (doc.i >> x.level) & 1 AS side, up.h AS sibling FROM doc, LATERAL (SELECT unnest(range(height)) AS level) x LEFT JOIN up ON up.lang IS NOT DISTINCT FROM doc.lang AND up.level = x.level AND up.i = xor(doc.i >> x.level, 1)
                 UNION ALL
                 SELECT k, height + x.level, (g >> x.level) & 1, top.h FROM doc, LATERAL (SELECT unnest(range(top_height)) AS level) x LEFT JOIN top ON top.level = x.level AND top.i = xor(g >> x.level, 1)),
        proofs AS (SELECT k, sha256(coalesce(string_agg(sibling, '' ORDER BY s), '')) AS proof FROM doc LEFT JOIN step USING (k) GROUP BY k),
        fold(k, s, h) AS (
            SELECT k, 0, coalesce(other, leaf) FROM doc
            UNION ALL
            SELECT fold.k, fold.s + 1, sha256(CASE WHEN side = 1 THEN concat(sibling, h) ELSE concat(h, sibling) END) FROM fold JOIN step ON step.k = fold.k AND step.s = fold.s)
        SELECT doc_id, leaf, subroot, root, proof AS proof_sha256, h AS folded_root, h = root AS verified
        FROM doc JOIN proofs USING (k) JOIN fold ON fold.k = doc.k AND fold.s = height + top_height
    """,
    "op13_k2_treap": rf"""
        WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents),
        s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM d),
        tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
        weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, s GROUP BY term, docs),
        q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
        scored AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
                   FROM q JOIN weight USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 50
    """,
}
