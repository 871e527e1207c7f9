"""DuckDB SQL for the queries whose whole result SQL can express: plain definitions over whole tables."""

#: Labels of connected nodes: `pairs(a, b)` in both directions.
REACH = """reach AS (SELECT a AS node, a AS root FROM pairs UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.node),
    component AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""

OP2 = f"""WITH RECURSIVE one AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings GROUP BY vec_id),
    sound AS (SELECT vec_id, v FROM one WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    pairs AS (SELECT p.vec_id AS a, q.vec_id AS b FROM sound p JOIN sound q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v) AND list_cosine_similarity(p.v, q.v) >= 0.95),
    {REACH}
    SELECT o.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.root, o.vec_id) AS component_id, o.vec_id IS NOT DISTINCT FROM coalesce(c.root, o.vec_id) AS kept
    FROM one o LEFT JOIN component c ON c.node = o.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) n ON n.a = o.vec_id"""

OP4 = """SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha1(p), CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = lead_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead_id THEN lead_id END AS refers_to, true AS verified
    FROM (SELECT page_id, p, min(page_id) OVER (PARTITION BY p) AS lead_id FROM (SELECT page_id, coalesce(html, '') AS p FROM pages) a) b"""

OP5 = f"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(lower(min(coalesce(text, ''))), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
    grams AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' ')))) AS g FROM words WHERE len(w) > 0),
    sets AS (SELECT min(doc_id) AS rep, count(*) AS copies, g FROM grams GROUP BY g),
    tokens AS (SELECT rep, len(g) AS n, unnest(g) AS t FROM sets),
    common AS (SELECT x.rep AS a, y.rep AS b, x.n AS na, y.n AS nb, count(*) AS c FROM tokens x JOIN tokens y ON x.t = y.t AND x.rep <> y.rep GROUP BY ALL),
    pairs AS (SELECT a, b FROM common WHERE c >= 0.8 * (na + nb - c) - 1e-9),
    {REACH},
    linked AS (SELECT p.a, sum(s.copies) AS n FROM pairs p JOIN sets s ON s.rep = p.b GROUP BY p.a),
    member AS (SELECT d.doc_id, s.rep, s.copies FROM grams d JOIN sets s ON s.g = d.g)
    SELECT w.doc_id, CAST(coalesce(m.copies - 1, 0) + coalesce(l.n, 0) AS BIGINT) AS n_links, coalesce(c.root, m.rep, w.doc_id) AS class_id, w.doc_id = coalesce(c.root, m.rep, w.doc_id) AS kept
    FROM words w LEFT JOIN member m ON m.doc_id = w.doc_id LEFT JOIN component c ON c.node = m.rep LEFT JOIN linked l ON l.a = m.rep"""

#: The slot at virtual time v is what all sources have had by then: each the smaller of its blocks and its weight times v.
OP7 = """WITH RECURSIVE docs AS (SELECT doc_id, source, n_chars, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(source, '')) AS h FROM documents),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CAST('0x' || substr(h, 1, 8) AS BIGINT) % greatest(16, (SELECT count(*) FROM docs) // 8192), h, doc_id) - 1 AS source_rank FROM docs),
    sizes AS (SELECT source, count(*) AS n, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM docs GROUP BY source),
    share AS (SELECT source, n, n // 4 AS full_blocks, CAST(greatest(1, round(w / max(w) OVER () / sum(w / (SELECT max(w) FROM sizes)) OVER () * least(CAST(1125899906842624 AS DOUBLE), CAST(2305843009213693952 AS DOUBLE) / (sum((n + 3) // 4) OVER () + 2)))) AS HUGEINT) AS a FROM sizes),
    live AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM share WHERE full_blocks > 0),
    edges AS (SELECT i, a, full_blocks, CAST(unnest(range(0, full_blocks + 1)) AS BIGINT) AS k FROM live),
    reached AS (SELECT e.i, e.k, e.a, e.full_blocks, sum(least(s.full_blocks * e.a, e.k * s.a)) AS t FROM edges e CROSS JOIN live s GROUP BY e.i, e.k, e.a, e.full_blocks),
    timed AS (SELECT i, k, CAST(t // a AS BIGINT) AS release, CAST((lead(t) OVER (PARTITION BY i ORDER BY k) + a - 1) // a AS BIGINT) AS deadline FROM reached),
    windows AS (SELECT i, list(struct_pack(r := release, d := deadline) ORDER BY k) AS w FROM timed WHERE deadline IS NOT NULL GROUP BY i),
    everything AS (SELECT list(w ORDER BY i) AS w, sum(len(w)) AS last FROM windows),
    run AS (SELECT CAST(-1 AS BIGINT) AS slot, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS k, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ran FROM everything
        UNION ALL SELECT slot + 1, list_transform(range(1, len(k) + 1), lambda j: k[j] + CASE WHEN j = p.i THEN 1 ELSE 0 END), p.i, k[p.i] FROM (
            SELECT r.slot, r.k, list_min(list_transform(list_filter(range(1, len(r.k) + 1), lambda j: r.k[j] < len(e.w[j]) AND e.w[j][r.k[j] + 1].r <= r.slot + 1), lambda j: {'d': e.w[j][r.k[j] + 1].d, 'i': j})) AS p FROM run r, everything e WHERE r.slot + 1 < e.last) q),
    placed AS (SELECT s.source, r.ran AS k, r.slot, t.release, t.deadline FROM run r JOIN live s ON s.i = r.i JOIN timed t ON t.i = r.i AND t.k = r.ran WHERE r.slot >= 0),
    tails AS (SELECT source, coalesce((SELECT last FROM everything), 0) + row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tail FROM share WHERE n % 4 > 0)
    SELECT r.doc_id, r.source, r.n_chars, CAST(r.source_rank AS BIGINT) AS source_rank, CAST(coalesce(p.slot, t.tail) AS BIGINT) AS mix_slot, p.release, p.deadline, CAST(coalesce(p.slot, t.tail) * 4 + r.source_rank % 4 AS BIGINT) AS mix_pos, p.slot IS NOT NULL AS in_mix
    FROM ranked r LEFT JOIN placed p ON p.source IS NOT DISTINCT FROM r.source AND p.k = r.source_rank // 4 LEFT JOIN tails t ON t.source IS NOT DISTINCT FROM r.source"""

#: Texts as hexadecimal digits; every window of 100 bytes, cut out of overlapping stretches of a text.
OP8 = """WITH texts AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS t FROM documents),
    stretches AS (SELECT doc_id, CAST(unnest(range(0, length(t) // 2, 1000)) AS BIGINT) AS b, t FROM texts),
    cut AS (SELECT doc_id, b, substr(t, CAST(b * 2 + 1 AS BIGINT), 2198) AS t FROM stretches),
    windows AS (SELECT doc_id, b + unnest(range(0, least(1000, length(t) // 2 - 99))) AS s, t, b FROM cut WHERE length(t) >= 200),
    hashed AS (SELECT doc_id, s, substr(t, CAST((s - b) * 2 + 1 AS BIGINT), 200) AS w FROM windows),
    again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS n FROM hashed) x WHERE n > 1),
    opened AS (SELECT *, CASE WHEN s <= lag(s) OVER o + 100 THEN 0 ELSE 1 END AS fresh FROM again WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM opened),
    spans AS (SELECT doc_id, span, min(s) AS s, max(s) + 100 AS e FROM numbered GROUP BY doc_id, span),
    gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS s, s AS e FROM spans UNION ALL SELECT doc_id, max(e), NULL FROM spans GROUP BY doc_id),
    kept AS (SELECT g.doc_id, string_agg(substr(t.t, CAST(g.s * 2 + 1 AS BIGINT), CAST(coalesce(g.e - g.s, length(t.t)) * 2 AS BIGINT)), '' ORDER BY g.s) AS k FROM gaps g JOIN texts t ON t.doc_id = g.doc_id GROUP BY g.doc_id),
    sums AS (SELECT doc_id, sum(e - s) AS n, count(*) AS c FROM spans GROUP BY doc_id)
    SELECT t.doc_id, CAST(length(t.t) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, t.t))) AS kept_sha256
    FROM texts t LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)"""

#: All combinations of frequent tokens of all urls are counted; the rules are those of the registered query.
OP1 = """WITH rules(verdict, rule) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
    cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    parts AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
    fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id),
    labels AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS l FROM parts),
    tokens AS (SELECT page_id, url, list_distinct(list_concat(list_transform(range(1, len(l) + 1), lambda i: 'host:' || array_to_string(l[i:], '.')),
        list_transform(list_filter(string_split(array_to_string(l[1 : len(l) - 2], '-'), '-'), lambda x: x <> ''), lambda x: 'word:' || x),
        list_transform(list_filter(string_split_regex(lower(path), '[/._-]'), lambda x: x <> ''), lambda x: 'path:' || x),
        list_transform(list_filter(string_split_regex(regexp_extract(url, '[?]([^#]*)', 1), '[&;]'), lambda x: x <> ''), lambda x: 'key:' || split_part(x, '=', 1)))) AS t FROM labels WHERE url IS NOT NULL),
    bound AS (SELECT count(*) AS n, ceil(least(1, greatest(CAST(0.01 AS DOUBLE), CAST(20 AS DOUBLE) / count(*))) * count(*)) AS least_n FROM tokens),
    common AS (SELECT t FROM (SELECT unnest(t) AS t FROM tokens) x GROUP BY t HAVING count(*) >= (SELECT least_n FROM bound)),
    known AS (SELECT page_id, verdict, list_sort(list_filter(t, lambda x: list_contains(everything, x))) AS t FROM tokens LEFT JOIN fit USING (page_id) CROSS JOIN (SELECT list(t) AS everything FROM common) e),
    sets AS (SELECT verdict, list_filter(t, lambda x, i: (m >> CAST(i - 1 AS INT)) & 1 = 1) AS s FROM (SELECT verdict, t, unnest(range(1, CAST(1 AS BIGINT) << len(t))) AS m FROM known) x),
    counted AS (SELECT s, v.v, count(*) AS n, count(CASE WHEN verdict = v.v THEN 1 END) AS k FROM sets CROSS JOIN (VALUES ('allow'), ('block')) v(v) GROUP BY s, v.v),
    mined AS (SELECT s, v, CAST(k AS DOUBLE) / n AS sure, CAST(k AS DOUBLE) / (SELECT n FROM bound) AS share FROM counted WHERE k >= (SELECT least_n FROM bound) AND CAST(k AS DOUBLE) / n >= 0.9),
    pruned AS (SELECT * FROM mined m WHERE NOT EXISTS (SELECT 1 FROM mined q WHERE q.v = m.v AND q.sure >= m.sure AND len(q.s) < len(m.s) AND list_has_all(m.s, q.s))),
    best AS (SELECT page_id, arg_min(struct_pack(v := v, s := s), struct_pack(a := -sure, b := -share, c := -len(s), d := s)) AS b FROM known JOIN pruned ON list_has_all(t, s) WHERE verdict IS NULL GROUP BY page_id)
    SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, b.b.v, 'allow') AS verdict, array_to_string(b.b.s, ' ') AS mined_rule FROM parts p LEFT JOIN fit f USING (page_id) LEFT JOIN best b USING (page_id)"""

#: What lies in the article of a page, its tags taken out and its character references read.
OP11 = r"""WITH article AS (SELECT page_id, url, regexp_replace(regexp_replace(coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), ''), '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
    decoded AS (SELECT page_id, url, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g') AS t FROM article),
    tidy AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM decoded)
    SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM tidy"""

#: All products of anchors and rows; integers below 2^53 are exact as doubles.
OP12 = """WITH sound AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    scored AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM sound a JOIN sound r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
    positive AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    fit AS (SELECT p.anchor_id, positive_id, n.id AS negative_id, positive_score, n.score AS negative_score FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INT) AS rank, negative_id, positive_score, negative_score FROM fit
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) <= 3"""

ORACLE_SQL = {"op1_url_rules": OP1, "op2_embedding_near_dedup": OP2, "op4_warc_archive": OP4, "op5_jaccard_join": OP5, "op7_pfair_mixing": OP7, "op8_suffix_dedup": OP8, "op11_html_text": OP11, "op12_hard_negatives": OP12}
