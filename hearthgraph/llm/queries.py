"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .binary_ids import op8_binary_ids
from .bpe import op6_bpe_round_trip
from .exact_topk import op1_exact_top_k
from .learned_partitions import op3_learned_partitions
from .lexical import op11_lexical_search
from .packing import op5_packing
from .pieces import op13_pieces_round_trip
from .prefix_trie import op12_conversation_trie
from .quality import op2_quality
from .secrets import op9_secrets
from .simhash import op4_simhash
from .token_counts import op10_token_counts
from .toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_quality, op3_learned_partitions, op4_simhash, op5_packing, op6_bpe_round_trip, op7_toxicity, op8_binary_ids, op9_secrets, op10_token_counts, op11_lexical_search, op12_conversation_trie, op13_pieces_round_trip)}
#: SQL has neither the tokenizers, the fingerprints' hash, the trained models nor the tests of
#: randomness; those queries are held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op1_exact_top_k": """
WITH z AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
           FROM z q JOIN z c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op11_lexical_search": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
     i AS (SELECT item_id, text, term, count(*) AS q FROM (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term,
                  generate_subscripts(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), 1) AS at FROM benchmark) GROUP BY ALL),
     c AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
     p AS (SELECT doc_id, r, n, term, count(*) AS tf FROM (SELECT doc_id, r, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
     f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
     s AS (SELECT i.item_id, i.text, p.r, p.doc_id,
                  CAST(sum(q * CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total)))) AS BIGINT) AS score
           FROM i JOIN p ON i.term = p.term JOIN f ON f.term = p.term CROSS JOIN c GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s
WINDOW w AS (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER w <= 20""",
    "op12_conversation_trie": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS o,
                  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base,
                  xor(4294967295, list_reduce(list_concat([4294967295], range(0, 8 * strlen(CAST(conv_id AS VARCHAR)))), lambda s, j:
                    list_transform([CASE WHEN j % 8 = 0 THEN xor(s, CAST(ascii(substring(CAST(conv_id AS VARCHAR), CAST(j // 8 AS INTEGER) + 1, 1)) AS BIGINT)) ELSE s END],
                                   lambda b: CASE WHEN b % 2 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)[1])) % 9 AS h FROM t WHERE o = 1),
     z AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS kept, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS size FROM c LEFT JOIN c b ON b.conv_id = c.base),
     r AS (SELECT z.conv_id, kept + o - h AS pos, role, text FROM z JOIN t ON t.conv_id = z.conv_id AND o > h
           UNION ALL SELECT z.conv_id, o, role, text FROM z JOIN t ON t.conv_id = base AND o <= h),
     k AS (SELECT conv_id, pos AS d, strlen(text) AS bytes, sha256(string_agg(sha256(len(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS key FROM r
           UNION ALL SELECT conv_id, 0, 0, '' FROM z),
     m AS (SELECT k.*, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM k),
     n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, min(parent) AS parent FROM m GROUP BY key, d),
     g AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.parent = n.key AND x.d = n.d + 1) AS n_children FROM n),
     s AS (SELECT m.key, m.d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * g.bytes) AS saved_tokens FROM g JOIN m ON m.conv_id = g.conv_id AND m.d <= g.d GROUP BY m.key, m.d),
     e AS (SELECT key, m.d, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) AS ids FROM m JOIN z ON z.conv_id = m.conv_id AND m.d = z.size GROUP BY key, m.d)
SELECT g.conv_id, g.d AS depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM g JOIN s ON s.key = g.key AND s.d = g.d LEFT JOIN e ON e.key = g.key AND e.d = g.d LEFT JOIN n p ON p.key = g.parent AND p.d = g.d - 1""",
}
