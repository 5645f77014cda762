"""Queries of this subpackage for the entry module: ``opN_<name>`` over whole tables."""

from __future__ import annotations

from chronopath.llm.bpe import op6_bpe_encode_decode, op7_token_counts
from chronopath.llm.conversation_repair import SQL as _CONVERSATION_REPAIR
from chronopath.llm.conversation_repair import op12_conversation_repair
from chronopath.llm.embedding_dedup import op1_embedding_dedup
from chronopath.llm.filter_audit import SQL as _FILTER_AUDIT
from chronopath.llm.filter_audit import op13_filter_audit
from chronopath.llm.fingerprints import op3_document_fingerprints
from chronopath.llm.licenses import op10_license_scan
from chronopath.llm.line_dedup import SQL as _LINE_DEDUP
from chronopath.llm.line_dedup import op11_line_dedup
from chronopath.llm.mixing import op9_mix_to_targets
from chronopath.llm.ngram_join import op8_ngram_jaccard_join
from chronopath.llm.suffix_dedup import op2_suffix_array_dedup
from chronopath.llm.token_files import op4_token_files
from chronopath.llm.toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_suffix_array_dedup, op3_document_fingerprints, op4_token_files, op5_toxicity, op6_bpe_encode_decode, op7_token_counts, op8_ngram_jaccard_join, op9_mix_to_targets, op10_license_scan, op11_line_dedup, op12_conversation_repair, op13_filter_audit)}
#: Over whole tables. The SQL of op2 and op8 compares all windows and all pairs that share a shingle.
SQL: dict[str, str] = {
    "op1_embedding_dedup": """WITH RECURSIVE g AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT r.n, l.b FROM r JOIN l ON l.a = r.m),
k AS (SELECT n, min(m) AS m FROM r GROUP BY n), d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(d.n, 0) AS n_links, CAST(k.m AS bigint) AS component_id, vec_id = k.m AS kept FROM embeddings LEFT JOIN k ON k.n = vec_id LEFT JOIN d ON d.a = vec_id""",
    "op2_suffix_array_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 400) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY hash(g), md5(g)) AS c FROM w) WHERE c > 1),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 200 THEN 0 ELSE 1 END AS new FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s) GROUP BY doc_id, run),
q AS (SELECT d.doc_id, d.h, r.a, r.z, coalesce(lag(r.z) OVER (PARTITION BY d.doc_id ORDER BY r.a), 0) AS p FROM d JOIN r USING (doc_id)),
k AS (SELECT doc_id, string_agg(substring(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substring(any_value(h), 2 * max(z) + 1) AS kept, sum(z - a) AS gone, count(*) AS n FROM q GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS bigint) AS n_bytes, CAST(coalesce(gone, 0) AS bigint) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op8_ngram_jaccard_join": r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS n, doc_id AS m FROM documents UNION SELECT r.n, l.b FROM r JOIN l ON l.a = r.m),
k AS (SELECT n, min(m) AS m FROM r GROUP BY n)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, CAST(k.m AS bigint) AS component_id FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN k ON k.n = t.doc_id""",
    "op11_line_dedup": _LINE_DEDUP,
    "op12_conversation_repair": _CONVERSATION_REPAIR,
    "op13_filter_audit": _FILTER_AUDIT,
}
