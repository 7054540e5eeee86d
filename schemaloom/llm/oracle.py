"""DuckDB SQL of the operators that SQL can express."""

WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH item AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS m,
               array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
              FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format('text')} AS w FROM documents),
sizes AS (SELECT DISTINCT m FROM win),
place AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, sizes WHERE len(w) >= m),
hit AS (SELECT r, i, p.m, item_id FROM place p
        JOIN win ON win.m = p.m AND win.g = array_to_string(w[i:i + p.m - 1], ' ')),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM hit)
      GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
       FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""

WARC = """
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM h WHERE payload_bytes >= 100
      GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id <> first_id THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM h LEFT JOIN f USING (payload_digest)
"""

AUDIT = r"""
WITH doc AS (
  SELECT doc_id, coalesce(source::VARCHAR, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
good AS (SELECT doc_id, max((quality = 1)::INT) AS g, max((toxic = 1)::INT) AS t
         FROM labels GROUP BY doc_id),
cell AS (
  SELECT part, n_short + n_plain + n_loud + n_mark + n_twin AS mask, count(*) AS n,
         sum(coalesce(g, 0)) AS g, sum(coalesce(t, 0)) AS t
  FROM (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END AS n_short,
               CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END AS n_plain,
               CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text)
                    THEN 4 ELSE 0 END AS n_loud,
               CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END AS n_mark,
               CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS n_twin FROM doc)
  LEFT JOIN good USING (doc_id) GROUP BY ALL),
letter AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(l, bit)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit,
         list_sum(list_concat([0], bits[1:step - 1]))::INT AS prior
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
told AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (prior | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & prior = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & prior <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & prior = 0 THEN g ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & prior = 0 THEN t ELSE 0 END) AS toxic_lost
  FROM cell, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM told
"""



def _codes() -> str:
    """k-means over parts, each round spelled out: assign, then move."""
    def nearest(book: str) -> str:
        return f"""SELECT k, p, min({{'d': norm - 2 * list_inner_product(x, c), 'e': e}}).e AS e
        FROM part JOIN (SELECT *, list_inner_product(c, c) AS norm FROM {book}) USING (p)
        GROUP BY k, p"""
    rounds = "".join(f"""
own{r} AS MATERIALIZED ({nearest(f'book{r}')}),
book{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c FROM book{r} LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS m FROM (
      SELECT p, e, i, floor(sum(x[i]) / count(*)) AS m
      FROM part JOIN own{r} USING (k, p), (SELECT unnest(range(1, w + 1)) AS i FROM wide)
      GROUP BY p, e, i) GROUP BY p, e) USING (p, e)),""" for r in range(4))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND list_aggregate(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), 'bool_and')),
wide AS (SELECT max(len(v)) // 4 AS w FROM kept),
part AS MATERIALIZED (
  SELECT k, p, v[p * w + 1:p * w + w] AS x
  FROM kept, wide, (SELECT unnest(range(0, 4)) AS p)),
book0 AS MATERIALIZED (SELECT p, k - 1 AS e, x AS c FROM part WHERE k <= 256),{rounds}
last AS MATERIALIZED ({nearest('book4')}),
error AS MATERIALIZED (
  SELECT k, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code,
         sum(list_inner_product(x, x) + list_inner_product(c, c)
             - 2 * list_inner_product(x, c))::BIGINT AS error
  FROM last JOIN part USING (k, p) JOIN book4 USING (p, e) GROUP BY k)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c::BIGINT[], ','), ',' ORDER BY p, e))
        FROM book4) AS codebooks_sha256
FROM kept JOIN error USING (k)
"""


ORACLE = {"op4_decontaminate": DECONTAMINATE, "op8_warc_revisits": WARC,
          "op11_vector_codes": _codes(), "op13_filter_audit": AUDIT}
