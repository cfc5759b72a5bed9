"""DuckDB SQL for the corpus queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH d AS (SELECT doc_id, {LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(LOWER)
OP5 = f"""
WITH items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) >= 10 THEN 10 ELSE len(w) END AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM docs WHERE len(w) > 0),
sized AS (SELECT DISTINCT n FROM wins),
occ AS (
  SELECT a.doc_id, a.i, s.n, array_to_string(a.w[a.i:a.i + s.n - 1], ' ') AS win
  FROM places a, sized s WHERE a.i + s.n - 1 <= len(a.w)),
hits AS (SELECT o.doc_id, o.i, o.n, wins.item_id FROM occ o JOIN wins ON o.win = wins.win AND o.n = wins.n),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM (SELECT x.doc_id AS xd, y.doc_id AS yd, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n x ON x.doc_id = xd JOIN n y ON y.doc_id = yd WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text])) + ")"


CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""
#: Levels of every tree: those of languages, then the one of their roots, whose leaves are numbered in order of the languages.
OP13 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('v' || lang, 'n') AS tree, {_leaf("text")} AS leaf,
         CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(f"(CASE WHEN text IS NOT NULL THEN {LOWER} END)")} END AS tampered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
lower AS (
  SELECT tree, 0 AS level, i, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, min(level) + 1, i // 8, (min(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM lower WHERE n > 1 GROUP BY tree, i // 8),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM lower WHERE n = 1),
upper AS (
  SELECT '' AS tree, 0 AS level, i, n, digest FROM subroots
  UNION ALL
  SELECT tree, min(level) + 1, i // 8, (min(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY tree, i // 8),
climb AS (
  SELECT doc_id, tree, i AS at, 0 AS level, i, n, coalesce(tampered, leaf) AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT c.doc_id, c.tree, c.at, min(c.level) + 1, min(c.i) // 8, (min(c.n) + 7) // 8,
         sha256(string_agg(CASE WHEN l.i = c.i THEN c.folded ELSE l.digest END, '' ORDER BY l.i)),
         min(c.proof) || coalesce(string_agg(CASE WHEN l.i <> c.i THEN l.digest END, '' ORDER BY l.i), '')
  FROM climb c JOIN lower l ON l.tree = c.tree AND l.level = c.level AND l.i // 8 = c.i // 8 WHERE c.n > 1 GROUP BY c.doc_id, c.tree, c.at),
higher AS (
  SELECT c.tree, c.at, 0 AS level, s.i, s.n, c.folded, c.proof FROM climb c JOIN subroots s USING (tree) WHERE c.n = 1
  UNION ALL
  SELECT h.tree, h.at, min(h.level) + 1, min(h.i) // 8, (min(h.n) + 7) // 8,
         sha256(string_agg(CASE WHEN l.i = h.i THEN h.folded ELSE l.digest END, '' ORDER BY l.i)),
         min(h.proof) || coalesce(string_agg(CASE WHEN l.i <> h.i THEN l.digest END, '' ORDER BY l.i), '')
  FROM higher h JOIN upper l ON l.level = h.level AND l.i // 8 = h.i // 8 WHERE h.n > 1 GROUP BY h.tree, h.at)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(h.proof) AS proof_sha256, h.folded AS folded_root, h.folded = r.digest AS verified
FROM placed p JOIN subroots s USING (tree) JOIN higher h ON h.tree = p.tree AND h.at = p.i AND h.n = 1 JOIN upper r ON r.n = 1
"""

ORACLES = {"op4_exact_dedup": OP4, "op5_decontaminate": OP5, "op10_jaccard_join": OP10, "op13_merkle": OP13}
