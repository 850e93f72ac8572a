"""SQL for the queries of this package that SQL can express on small tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
   GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
 reach AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT link.y, root FROM reach JOIN link ON link.x = reach.doc_id)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, min(root) = w.doc_id AS kept FROM w JOIN reach ON reach.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
 d AS (SELECT x, count(*) AS n FROM link GROUP BY x),
 reach AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT link.y, root FROM reach JOIN link ON link.x = reach.vec_id)
SELECT v.vec_id, coalesce(any_value(d.n), 0)::BIGINT AS n_links, min(root) AS component_id, min(root) = v.vec_id AS kept FROM v JOIN reach ON reach.vec_id = v.vec_id LEFT JOIN d ON d.x = v.vec_id GROUP BY v.vec_id
"""

OP10 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
 rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
 cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE k IN (SELECT k FROM rep)),
 pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM pos WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.doc_id = pos.doc_id AND cov.p = pos.p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP11 = r"""
WITH RECURSIVE bits AS (SELECT b::BIGINT AS b, b::BIGINT AS v, 0 AS k FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
 step AS (SELECT b, v FROM bits WHERE k = 8),
 words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
   FROM (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark)),
 runs AS (SELECT doc_id, array_to_string(ws[i:i + n], ' ') AS f FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 1)) AS i FROM words, range(3) r(n) WHERE len(ws) > n)),
 f AS (SELECT row_number() OVER () AS i, f, encode(f) AS e FROM (SELECT DISTINCT f FROM runs)),
 longest AS (SELECT max(octet_length(e)) AS n FROM f),
 far AS (SELECT 0 AS d, b, v FROM step UNION ALL SELECT d + 1, far.b, xor(far.v >> 8, step.v) FROM far JOIN step ON step.b = far.v & 255 WHERE d + 1 < (SELECT n FROM longest)),
 none AS (SELECT 0 AS n, 4294967295::BIGINT AS v UNION ALL SELECT n + 1, xor(none.v >> 8, step.v) FROM none JOIN step ON step.b = none.v & 255 WHERE n < (SELECT n FROM longest)),
 bytes AS (SELECT i, octet_length(e) AS n, unnest(range(octet_length(e))) AS k, hex(e) AS h FROM f),
 crc AS (SELECT bytes.i, xor(xor(bit_xor(far.v), any_value(none.v)), 4294967295) % 10000 AS bucket FROM bytes JOIN far ON far.d = bytes.n - 1 - bytes.k AND far.b = ('0x' || substr(h, 2 * bytes.k + 1, 2))::BIGINT JOIN none ON none.n = bytes.n GROUP BY bytes.i),
 found AS (SELECT doc_id, bucket, count(*) AS n FROM runs JOIN f ON f.f = runs.f JOIN crc ON crc.i = f.i GROUP BY doc_id, bucket),
 counts AS (SELECT bucket, coalesce(sum(n) FILTER (doc_id IS NOT NULL), 0)::BIGINT AS s, coalesce(sum(n) FILTER (doc_id IS NULL), 0)::BIGINT AS t FROM (FROM found UNION ALL SELECT NULL, b, 0 FROM range(10000) r(b)) GROUP BY bucket),
 total AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM counts),
 gain AS (SELECT bucket, floor(1000 * ln(((counts.t + 1) * (total.s + 10000)) / ((counts.s + 1) * (total.t + 10000))))::BIGINT AS g FROM counts, total),
 w AS (SELECT doc_id, sum(n * g)::BIGINT AS weight, sum(n)::BIGINT AS n FROM found JOIN gain USING (bucket) WHERE doc_id IS NOT NULL GROUP BY doc_id),
 d AS (SELECT doc_id, len(ws) AS n_words, coalesce(w.n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT AS h FROM words LEFT JOIN w USING (doc_id) WHERE doc_id IS NOT NULL),
 scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
 place AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM scored LEFT JOIN place USING (doc_id)
"""

OP12 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
 l AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM p),
 b AS (SELECT *, array_to_string(list_transform(str_split(sha1(body), ''), lambda c: list_extract(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'], strpos('0123456789abcdef', c)::INTEGER)), '') AS bits FROM l)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: (16 >> j) * substr(bits, (5 * k + j + 1)::BIGINT, 1)::INTEGER))::INTEGER, 1)), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
 w AS (SELECT i, lang, source, unnest(ws) AS term FROM d),
 kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
 v AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS n FROM kept GROUP BY lang),
 own AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
 g AS (SELECT lang, source, coalesce(v.v, 0) AS v, coalesce(v.n, 0) AS lang_n, coalesce(any_value(o.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
   LEFT JOIN (SELECT lang, source, sum(c)::BIGINT AS n FROM own GROUP BY lang, source) o USING (lang, source) GROUP BY lang, source, v.v, v.n),
 p AS (SELECT g.lang, g.source, kept.term, coalesce(own.c, 0) AS c, 1 + (1000000000 * (coalesce(own.c, 0) + 2)) // (g.n + 2 * g.v) AS p, 1 + (1000000000 * (kept.total + 2)) // (g.lang_n + 2 * g.v) AS q
   FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
 f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
 t AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE c > 0 AND p > q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (FROM pair UNION ALL FROM t))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""

ORACLE = {"op5_hamming_near_dedup": OP5, "op9_polytope_near_dedup": OP9, "op10_fm_substring_dedup": OP10, "op11_radix_importance_resampling": OP11, "op12_splittable_warc": OP12, "op13_source_divergence_audit": OP13}
