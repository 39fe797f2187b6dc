"""The registered queries as SQL, for those that SQL can express on whole tables.

Each is the plain definition: all windows, all pairs that share a shingle, all products.
Windows are told apart by md5 of their words.
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
_BENCHMARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_MINHASH = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
    ELSE array_to_string(list_slice(w, i, i + 2), ' ') END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i
        FROM texts WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * c >= 85 * (a.n + b.n - c)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y
)
SELECT r.doc_id, coalesce(sizes.n, 0) AS n_shingles, r.component_id, r.doc_id = r.component_id AS kept
FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) r
LEFT JOIN sizes ON sizes.doc_id = r.doc_id
"""

_SUBSTRING = f"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM texts WHERE len(w) >= 50)
), firsts AS (
  SELECT s, min(doc_id) AS least FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p
  FROM (SELECT doc_id, i FROM windows JOIN firsts ON firsts.s = windows.s WHERE least < doc_id)
), kept AS (
  SELECT a.doc_id, a.word, a.p FROM
    (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM texts WHERE len(w) > 0) a
  LEFT JOIN gone ON gone.doc_id = a.doc_id AND gone.p = a.p WHERE gone.p IS NULL
), joined AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM kept GROUP BY doc_id
)
SELECT texts.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN joined ON joined.doc_id = texts.doc_id
"""

_WINNOWING = f"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_BENCHMARK_WORD}') AS w FROM documents
), items AS (
  SELECT item_id, w, least(len(w), 10) AS size FROM
    (SELECT item_id, regexp_extract_all({_LOWER}, '{_BENCHMARK_WORD}') AS w FROM benchmark)
  WHERE len(w) > 0
), prints AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, size, md5(array_to_string(list_slice(w, i, i + size - 1), ' ')) AS s
  FROM (SELECT item_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM items)
), windows AS (
  SELECT doc_id, i, size, md5(array_to_string(list_slice(w, i, i + size - 1), ' ')) AS s
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
        FROM texts JOIN (SELECT DISTINCT size FROM items) z ON len(w) >= size)
), hits AS (
  SELECT doc_id, i, windows.size AS size, item FROM windows
  JOIN prints ON prints.s = windows.s AND prints.size = windows.size
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p
        FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT texts.doc_id, len(w) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(t, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM texts LEFT JOIN places ON places.doc_id = texts.doc_id LEFT JOIN named ON named.doc_id = texts.doc_id
"""

_KDTREE = """
WITH parts AS (
  SELECT vec_id, unnest(generate_series(1, len(embedding))) AS k, unnest(embedding) AS x FROM embeddings
), bad AS (
  SELECT DISTINCT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x)
), whole AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM bad)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, vec_id, score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op3_minhash": _MINHASH,
    "op6_substring": _SUBSTRING,
    "op7_winnowing": _WINNOWING,
    "op8_kdtree": _KDTREE,
}
