"""DuckDB statements with the results of those queries that SQL can express on whole tables."""

_KEYS = r"""
keys AS (
  SELECT id, sentence, list_sort(list_filter(list_transform(string_split_regex(lower(sentence), '[,;]'),
      lambda p: regexp_replace(p, '[\p{Z}\p{P}\p{S}\t\n\x0B\f\r\x{85}]+', '', 'g')), lambda p: p <> '')) AS k
  FROM training_rows
  WHERE sentence IS NOT NULL AND regexp_matches(sentence, '[^\p{Z}\t\n\x0B\f\r\x{85}]'))"""

SQL = {
    "p1_found": f"""WITH {_KEYS}, firsts AS (SELECT k, min(id) AS first_id FROM keys GROUP BY k)
SELECT first_id, id AS copy_id FROM keys JOIN firsts USING (k) WHERE id <> first_id""",
    "p1_records": f"""WITH {_KEYS}
SELECT min(id) AS first_id, arg_min(sentence, id) AS sentence, count(*) AS n_copies, count(DISTINCT sentence) AS n_spellings
FROM keys GROUP BY k""",
    "p2_groups": r"""WITH r AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(sentence), '[\p{L}\p{N}]+'))) AS w FROM training_rows
  WHERE sentence IS NOT NULL AND regexp_matches(sentence, '[^\p{Z}\t\n\x0B\f\r\x{85}]')),
c AS (SELECT w, min(id) AS class_id FROM r GROUP BY w), t AS (SELECT class_id, len(w) AS n, unnest(w) AS x FROM c),
p AS (SELECT a.class_id AS class_id, b.class_id AS other, min(a.n) AS na, min(b.n) AS nb, count(*) AS o FROM t a JOIN t b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY 1, 2),
l AS (SELECT class_id, count(*) AS n_links FROM p WHERE o >= 0.6 * (na + nb - o) - 1e-9 GROUP BY 1)
SELECT r.id, c.class_id, coalesce(l.n_links, 0) AS n_links FROM r JOIN c USING (w) LEFT JOIN l USING (class_id)""",
    "p8_found": r"""WITH item AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
item_runs AS (SELECT DISTINCT item_id, md5(array_to_string(w[i:i + 19], ' ')) AS run FROM item, unnest(range(1, len(w) - 18)) AS t(i)),
doc_runs AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 19], ' ')) AS run FROM doc, unnest(range(1, len(w) - 18)) AS t(i))
SELECT DISTINCT doc_id, item_id FROM doc_runs JOIN item_runs USING (run)""",
}
