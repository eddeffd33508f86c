"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"


def _shingles(table: str, key: str, k: int) -> str:
    """key, s: distinct shingles; with fewer than k words the whole sequence."""
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + {k - 1}], ' ') s FROM (
SELECT {key}, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) i FROM (SELECT {key}, regexp_extract_all({_LOWER}, '{_WORDS}') w FROM {table} WHERE text IS NOT NULL) WHERE len(w) > 0)"""


_REACH = """reach(id, c) AS (SELECT id, id FROM ids UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id)"""

#: The table of crc32, by its rule.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) t FROM range(256) r(i))"


def _crc(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text of code points up to U+00FF; t is the table."""
    cut = f"list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)"
    data = f"flatten(list_transform({cut}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLES = {
    "op2_ngram_jaccard_join": f"""WITH RECURSIVE ids AS MATERIALIZED (SELECT doc_id id FROM documents),
s AS MATERIALIZED ({_shingles("documents", "doc_id", 3)}),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY 1),
links AS MATERIALIZED (SELECT a.doc_id a, b.doc_id b FROM s a JOIN s b USING (s) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
{_REACH}
SELECT id AS doc_id, coalesce(n.n, 0)::BIGINT n_shingles, min(c)::BIGINT component_id FROM reach LEFT JOIN n ON n.doc_id = id GROUP BY 1, 2""",
    "op3_embedding_near_dedup": f"""WITH RECURSIVE ids AS MATERIALIZED (SELECT vec_id id FROM embeddings),
v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
{_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id)::BIGINT n_links, min(c)::BIGINT component_id, id = min(c) AS kept FROM reach GROUP BY id""",
    "op4_substring_dedup": f"""WITH w AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORDS}'), []) w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) i FROM w)),
dup AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) r FROM win) WHERE r > 1),
word AS (SELECT doc_id, unnest(w) x, generate_subscripts(w, 1) i FROM w),
gone AS (SELECT doc_id, word.i, x, max(dup.i IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY word.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) g FROM word LEFT JOIN dup USING (doc_id, i)),
kept AS (SELECT doc_id, count(*) FILTER (WHERE g) n_removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT g) t FROM gone GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT n_words, coalesce(n_removed, 0)::BIGINT n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op7_benchmark_decontamination": f"""WITH d AS MATERIALIZED ({_shingles("documents", "doc_id", 5)}), b AS MATERIALIZED ({_shingles("benchmark", "item_id", 5)}),
n AS (SELECT item_id, count(*) n FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*)::BIGINT n_shared, n.n::BIGINT n_item, count(*)::DOUBLE / n.n AS containment FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n.n HAVING 5 * count(*) >= 4 * n.n""",
    "op12_conversation_trie": f"""WITH {_CRC_TABLE},
turns AS (SELECT conv_id c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) r,
  {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} s FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT c, list(s ORDER BY r) s FROM turns GROUP BY c),
h AS MATERIALIZED (SELECT c, s, ({_crc("c::VARCHAR")} % 4)::BIGINT h FROM own, crc),
conv AS MATERIALIZED (SELECT h.c, list_concat(coalesce(b.s, [])[1:h], h.s[h + 1:]) s FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20),
pre AS MATERIALIZED (SELECT c, d, s[1:d] p, d = len(s) ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) d FROM conv)),
node AS MATERIALIZED (SELECT p, d, min(c) c, count(*) n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) e FROM pre GROUP BY p, d),
kids AS MATERIALIZED (SELECT p[1:d - 1] p, count(*) k FROM node WHERE d > 0 GROUP BY 1),
own_sums AS (SELECT node.p, d, kids.k IS NULL leaf, CASE WHEN d > 0 THEN (n - 1) * len(regexp_extract_all(node.p[d].text, '{_WORDS}')) ELSE 0 END saved FROM node LEFT JOIN kids ON kids.p = node.p),
sums AS (SELECT p[1:u] p, count(*) FILTER (WHERE leaf) leaves, sum(saved) saved FROM (SELECT p, leaf, saved, unnest(range(0, d + 1)) u FROM own_sums) GROUP BY 1)
SELECT node.c::BIGINT conv_id, node.d::BIGINT AS depth, up.c::BIGINT parent_conv_id, node.n::BIGINT n_convs, coalesce(kids.k, 0)::BIGINT n_children, leaves::BIGINT n_leaves, saved::BIGINT saved_tokens, node.e ends_sha256
FROM node JOIN sums ON sums.p = node.p LEFT JOIN kids ON kids.p = node.p LEFT JOIN node up ON node.d > 0 AND up.p = node.p[1:node.d - 1]""",
    "op13_spelling_variants": f"""WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, {_LOWER.replace("text", "unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+'))")} w FROM documents),
each AS MATERIALIZED (SELECT doc_id, w, count(*) n FROM runs WHERE length(w) >= 7 GROUP BY 1, 2),
hashed AS (SELECT w, n, ({_crc("coalesce(doc_id::VARCHAR, '') || ':' || w")})::BIGINT h FROM each, crc),
word AS MATERIALIZED (SELECT w, sum(n)::BIGINT n FROM (SELECT CASE WHEN h % 31 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END w, n FROM hashed) WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT DISTINCT w, length(w) l, i, substring(w, 1, i - 1) || substring(w, i + 1) x FROM (SELECT w, unnest(range(1, length(w) + 1)) i FROM word)),
pairs AS MATERIALIZED (SELECT DISTINCT a, b FROM (
  SELECT p.w a, q.w b FROM less p JOIN less q ON p.x = q.x AND p.i = q.i AND p.w <> q.w
  UNION ALL SELECT p.w, q.w FROM less p JOIN word q ON p.x = q.w
  UNION ALL SELECT q.w, p.w FROM less p JOIN word q ON p.x = q.w)),
near AS MATERIALIZED (SELECT a, count(*) k, first({{'w': b, 'n': y.n}} ORDER BY y.n DESC, b) best FROM pairs JOIN word y ON y.w = b GROUP BY a),
one AS MATERIALIZED (SELECT word.w, word.n, coalesce(k, 0) k, CASE WHEN best.n >= 10 * word.n THEN best END f FROM word LEFT JOIN near ON a = word.w),
chain(w, cur, i) AS (SELECT w, w, 0 FROM one UNION ALL SELECT chain.w, one.f.w, i + 1 FROM chain JOIN one ON one.w = chain.cur WHERE one.f IS NOT NULL)
SELECT one.w AS word, f.w AS form, r.root, n, k::BIGINT n_near, f.n::BIGINT form_n FROM one JOIN (SELECT w, arg_max(cur, i) root FROM chain GROUP BY w) r ON r.w = one.w""",
}
