"""The registered queries as plain SQL over the given tables, for an independent engine."""

from __future__ import annotations

# --- building blocks: named common table expressions -------------------------------------

JUDGMENTS = r"""
judgments AS (
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS example_id,
         lower(concat(p.p_type, ' ', p.p_brand)) AS query,
         CAST(l_partkey AS VARCHAR) AS product_id,
         l_returnflag AS product_locale,
         CASE l_linenumber % 4 WHEN 3 THEN 'E' WHEN 2 THEN 'S' WHEN 1 THEN 'C' ELSE 'I' END AS esci_label,
         l_suppkey AS source_key
  FROM lineitem JOIN part p ON p.p_partkey = l_suppkey)"""

GRADED = r"""
graded AS (
  SELECT *, CAST(CASE esci_label WHEN 'E' THEN 3 WHEN 'S' THEN 2 WHEN 'C' THEN 1 ELSE 0 END AS INTEGER) AS relevance_score
  FROM judgments WHERE esci_label IN ('E', 'S', 'C', 'I'))"""

CATALOG = r"""
catalog AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_title, p_type AS product_description,
         p_brand AS product_brand, split_part(p_name, ' ', 1) AS product_color,
         trim(regexp_replace(concat_ws(' ', coalesce(p_name, ''), coalesce(p_type, ''), coalesce(p_brand, ''),
              split_part(p_name, ' ', 1)), '\s+', ' ', 'g')) AS product_text
  FROM part)"""

QRELS = r"""
qrels AS (
  SELECT query AS query_id, product_id AS doc_id, max(relevance_score) AS rel FROM graded GROUP BY 1, 2)"""

UNIT_VECTORS = r"""
unit AS (
  SELECT vec_id, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS vec
  FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)))"""

LETTERS = ", ".join(
    f"CAST(length(lo) - length(replace(lo, '{chr(c)}', '')) AS DOUBLE)" for c in range(97, 123)
)


def letter_vectors(name: str, source: str, key: str) -> str:
    return f"""
{name} AS (
  SELECT {key}, text, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS vec
  FROM (SELECT {key}, text, v, sqrt(list_dot_product(v, v)) AS n
        FROM (SELECT {key}, text, [{LETTERS}] AS v FROM (SELECT {key}, text, lower(coalesce(text, '')) AS lo FROM {source}))))"""


SHOP = (
    JUDGMENTS
    + ","
    + GRADED
    + ","
    + CATALOG
    + ","
    + QRELS
    + ","
    + letter_vectors("queries", "(SELECT DISTINCT query AS query_id, query AS text FROM judgments)", "query_id")
    + ","
    + letter_vectors("goods", "(SELECT product_id AS doc_id, product_text AS text FROM catalog)", "doc_id")
    + r""",
docs AS (
  SELECT c.product_id AS doc_id, c.product_title AS title, c.product_brand AS brand, c.product_color AS color,
         c.product_text AS text, g.vec
  FROM catalog c JOIN goods g ON g.doc_id = c.product_id)"""
)

TEXTS = (
    letter_vectors("queries", "(SELECT item_id AS query_id, text FROM benchmark)", "query_id")
    + ","
    + letter_vectors("docs", "documents", "doc_id")
)


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '\\s+'), lambda x: x <> '')"


def bm25_scores(queries: str = "queries", docs: str = "docs") -> str:
    return f"""
b_tok AS (SELECT doc_id, {_tokens("text")} AS tk FROM {docs}),
b_stat AS (SELECT count(*) AS n, sum(len(tk)) * 1.0 / count(*) AS avgdl FROM b_tok),
b_post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl
           FROM (SELECT doc_id, len(tk) AS dl, unnest(tk) AS term FROM b_tok) GROUP BY 1, 2),
b_raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS i
          FROM (SELECT term, count(*) AS df FROM b_post GROUP BY 1), b_stat),
b_idf AS (SELECT term, CASE WHEN i < 0 THEN 0.25 * (SELECT avg(i) FROM b_raw) ELSE i END AS idf FROM b_raw),
b_q AS (SELECT query_id, term, count(*) AS qtf
        FROM (SELECT query_id, unnest({_tokens("text")}) AS term FROM {queries}) GROUP BY 1, 2),
bm25 AS (SELECT q.query_id, p.doc_id,
                sum(CAST(qtf * idf * tf * 2.5 AS DOUBLE) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
         FROM b_q q JOIN b_idf USING (term) JOIN b_post p USING (term), b_stat GROUP BY 1, 2)"""


def tfidf_scores(queries: str = "queries", docs: str = "docs") -> str:
    def grams(source: str, key: str) -> str:
        words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
        return f"""
           SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
           FROM (SELECT {key}, {words} AS w FROM {source})"""

    return f"""
t_gram AS ({grams(docs, "doc_id")}),
t_vocab AS (SELECT term FROM t_gram GROUP BY term ORDER BY count(*) DESC, term LIMIT 50000),
t_tf AS (SELECT doc_id, term, count(*) AS tf FROM t_gram JOIN t_vocab USING (term) GROUP BY 1, 2),
t_idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM {docs})) / (1.0 + count(*))) + 1.0 AS idf FROM t_tf GROUP BY 1),
t_w AS (SELECT doc_id, term, tf * idf AS w FROM t_tf JOIN t_idf USING (term)),
t_dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM t_w GROUP BY 1),
t_qw AS (SELECT query_id, term, count(*) * any_value(idf) AS w
         FROM ({grams(queries, "query_id")}) JOIN t_idf USING (term) GROUP BY 1, 2),
t_qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM t_qw GROUP BY 1),
tfidf AS (SELECT q.query_id, d.doc_id, sum((q.w / qn.n) * (d.w / dn.n)) AS score
          FROM t_qw q JOIN t_qn qn USING (query_id) JOIN t_w d USING (term) JOIN t_dn dn ON dn.doc_id = d.doc_id
          GROUP BY 1, 2)"""


def dense_scores(queries: str = "queries", docs: str = "docs") -> str:
    return f"""
emb AS (SELECT q.query_id, d.doc_id, list_dot_product(q.vec, d.vec) AS score FROM {queries} q CROSS JOIN {docs} d)"""


def ranked(name: str, source: str, k: int, by: str = "query_id", tie: str = "doc_id") -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (
      PARTITION BY {by} ORDER BY round(score, 9) DESC, {tie}) AS INTEGER) AS rank FROM {source}) WHERE rank <= {k})"""


def pool(size: int = 100) -> str:
    return (
        ranked("b_top", "bm25", size)
        + ","
        + ranked("e_top", "emb", size)
        + r""",
members AS (SELECT query_id, doc_id FROM b_top UNION SELECT query_id, doc_id FROM e_top),
raw_pool AS (
  SELECT m.query_id, m.doc_id, b_top.rank AS bm25_rank, e_top.rank AS emb_rank,
         coalesce(bm25.score, 0) AS bm25, emb.score AS emb
  FROM members m LEFT JOIN bm25 USING (query_id, doc_id) LEFT JOIN emb USING (query_id, doc_id)
       LEFT JOIN b_top USING (query_id, doc_id) LEFT JOIN e_top USING (query_id, doc_id)),
pool AS (
  SELECT *, CASE WHEN b1 - b0 < 1e-12 THEN 0.0 ELSE (bm25 - b0) / (b1 - b0) END AS bm25_norm,
            CASE WHEN e1 - e0 < 1e-12 THEN 0.0 ELSE (emb - e0) / (e1 - e0) END AS emb_norm
  FROM (SELECT *, min(bm25) OVER w AS b0, max(bm25) OVER w AS b1, min(emb) OVER w AS e0, max(emb) OVER w AS e1
        FROM raw_pool WINDOW w AS (PARTITION BY query_id)))"""
    )


def hybrid(k: int, alpha: str = "0.4", beta: str = "0.6", name: str = "hyb") -> str:
    return f"""
{name}_s AS (SELECT *, {alpha} * bm25_norm + {beta} * emb_norm AS score FROM pool),""" + ranked(
        name, f"{name}_s", k
    )


def _cosine(query: str, text: str) -> str:
    a, b = f"list_distinct({_tokens(query)})", f"list_distinct({_tokens(text)})"
    return (
        f"CASE WHEN len({a}) * len({b}) > 0 THEN len(list_intersect({a}, {b}))"
        f" / sqrt(CAST(len({a}) * len({b}) AS DOUBLE)) ELSE 0.0 END"
    )


def pair_scored(depth: int = 50, max_chars: int | None = None) -> str:
    text = "coalesce(d.text, '')" if max_chars is None else f"substring(coalesce(d.text, ''), 1, {max_chars})"
    return (
        hybrid(depth, name="top")
        + f""",
scored AS (
  SELECT t.query_id, t.doc_id, t.rank AS hybrid_rank, t.score AS hybrid_score, t.bm25_norm, t.emb_norm,
         {_cosine("q.text", text)} AS score
  FROM top t JOIN queries q USING (query_id) LEFT JOIN docs d USING (doc_id))"""
    )


RERANKED = ranked("reranked", "scored", 10, tie="hybrid_rank")

FIVE_METHODS = (
    SHOP
    + ","
    + bm25_scores()
    + ","
    + dense_scores()
    + ","
    + tfidf_scores()
    + ","
    + pool()
    + ","
    + pair_scored()
    + ","
    + RERANKED
    + ","
    + ranked("tfidf_top", "tfidf", 10)
    + r""",
rankings AS (
  SELECT 'bm25' AS method, query_id, doc_id, score, rank FROM b_top WHERE rank <= 10
  UNION ALL SELECT 'embedding', query_id, doc_id, score, rank FROM e_top WHERE rank <= 10
  UNION ALL SELECT 'hybrid', query_id, doc_id, hybrid_score, hybrid_rank FROM scored WHERE hybrid_rank <= 10
  UNION ALL SELECT 'tfidf', query_id, doc_id, score, rank FROM tfidf_top
  UNION ALL SELECT 'rerank', query_id, doc_id, score, rank FROM reranked)"""
)

METHOD_LIST = "(SELECT unnest(['tfidf', 'bm25', 'embedding', 'hybrid', 'rerank']) AS method)"


def metrics(methods: str = METHOD_LIST) -> str:
    """Per-query metrics of `rankings` at 10 as `per_query`."""
    return f"""
ideal AS (
  SELECT query_id, sum(CASE WHEN place <= 10 THEN rel / log2(place + 1) ELSE 0 END) AS idcg,
         sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) AS n_rel
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS place FROM qrels) GROUP BY 1),
seen AS (
  SELECT *, sum(hit) OVER (PARTITION BY method, query_id ORDER BY rank) AS run
  FROM (SELECT r.method, r.query_id, r.rank, coalesce(g.rel, 0) AS rel,
               CASE WHEN coalesce(g.rel, 0) >= 1 THEN 1 ELSE 0 END AS hit
        FROM rankings r LEFT JOIN qrels g USING (query_id, doc_id) WHERE r.rank <= 10)),
got AS (
  SELECT method, query_id, sum(hit) AS hits, sum(rel / log2(rank + 1)) AS dcg, sum(hit * run * 1.0 / rank) AS aps,
         min(CASE WHEN hit = 1 THEN rank END) AS first_hit
  FROM seen GROUP BY 1, 2),
per_query AS (
  SELECT m.method, q.query_id, coalesce(hits, 0) / 10.0::DOUBLE AS precision,
         CASE WHEN n_rel > 0 THEN coalesce(hits, 0)::DOUBLE / n_rel::DOUBLE END AS recall,
         CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg END AS ndcg,
         CASE WHEN n_rel > 0 THEN coalesce(aps, 0)::DOUBLE / least(n_rel, 10)::DOUBLE END AS ap,
         CASE WHEN n_rel > 0 THEN coalesce(1.0::DOUBLE / first_hit, 0) END AS rr
  FROM queries q CROSS JOIN {methods} m LEFT JOIN got g ON g.method = m.method AND g.query_id = q.query_id
       LEFT JOIN ideal i ON i.query_id = q.query_id)"""


MEANS = r"""
means AS (
  SELECT method, coalesce(avg(precision), 0) AS precision, coalesce(avg(recall), 0) AS recall,
         coalesce(avg(ndcg), 0) AS ndcg, coalesce(avg(ap), 0) AS ap, coalesce(avg(rr), 0) AS rr
  FROM per_query GROUP BY 1)"""

EVALUATED = FIVE_METHODS + "," + metrics() + "," + MEANS

SPLITS = r"""
placed AS (
  SELECT query_id, row_number() OVER (ORDER BY md5(concat('42|', query_id)), query_id) AS place,
         count(*) OVER () AS n FROM queries),
splits AS (
  SELECT query_id, CASE WHEN place <= greatest(1, floor(floor(n * 0.75) * 0.15)) AND place <= floor(n * 0.75) THEN 'validation'
                        WHEN place <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM placed)"""


def side_by_side(a: str, b: str) -> str:
    return f"""
sides AS (
  SELECT query_id, max(CASE WHEN method = '{a}' THEN ndcg END) AS a_ndcg, max(CASE WHEN method = '{b}' THEN ndcg END) AS b_ndcg,
         max(CASE WHEN method = '{a}' THEN recall END) AS a_recall, max(CASE WHEN method = '{b}' THEN recall END) AS b_recall
  FROM per_query WHERE method IN ('{a}', '{b}') GROUP BY 1),
changed AS (
  SELECT query_id, a_ndcg AS before, b_ndcg AS after, b_ndcg - a_ndcg AS diff,
         CASE WHEN b_ndcg - a_ndcg > 1e-9 THEN 'improved' WHEN b_ndcg - a_ndcg < -1e-9 THEN 'worsened'
              ELSE 'unchanged' END AS outcome
  FROM sides WHERE a_ndcg IS NOT NULL AND b_ndcg IS NOT NULL)"""


FEATURE_ROWS = f"""
feats AS (
  SELECT s.query_id, s.doc_id, s.score AS ce_score,
         CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 9) DESC, hybrid_rank) AS DOUBLE) AS ce_rank,
         hybrid_score, bm25_norm, emb_norm, bm25_norm - emb_norm AS bm25_emb_gap,
         CAST(hybrid_rank AS DOUBLE) AS hybrid_rank,
         CAST(greatest(len({_tokens("q.text")}), 1) AS DOUBLE) AS query_len,
         CAST(len({_tokens("d.title")}) AS DOUBLE) AS title_len,
         ln(1.0::DOUBLE + len({_tokens("d.text")})) AS text_len_log,
         CAST(len(list_intersect(list_distinct({_tokens("q.text")}), list_distinct({_tokens("d.title")}))) AS DOUBLE) AS title_overlap_count,
         len(list_intersect(list_distinct({_tokens("q.text")}), list_distinct({_tokens("d.title")})))::DOUBLE
           / greatest(len({_tokens("q.text")}), 1) AS title_overlap_ratio,
         CASE WHEN length(q.text) > 0 AND contains(lower(d.title), lower(q.text)) THEN 1.0::DOUBLE ELSE 0.0 END AS title_exact_contains,
         CASE WHEN list_has_any({_tokens("q.text")}, {_tokens("d.brand")}) THEN 1.0::DOUBLE ELSE 0.0 END AS brand_match,
         CASE WHEN list_has_any({_tokens("q.text")}, {_tokens("d.color")}) THEN 1.0::DOUBLE ELSE 0.0 END AS color_match
  FROM scored s JOIN queries q USING (query_id) JOIN docs d USING (doc_id))"""

FEATURE_NAMES = (
    "ce_score ce_rank hybrid_score bm25_norm emb_norm bm25_emb_gap hybrid_rank query_len title_len text_len_log "
    "title_overlap_count title_overlap_ratio title_exact_contains brand_match color_match"
).split()
ROUNDED_FEATURES = ", ".join(f"round(CAST({f} AS DOUBLE), 6) AS {f}" for f in FEATURE_NAMES)

FEATURED = ",".join(
    [SHOP, bm25_scores(), dense_scores(), pool(), pair_scored(), FEATURE_ROWS]
)

FOREST = (
    "(CASE WHEN ce_score <= 0.25 THEN -0.5 WHEN title_overlap_count <= 1 THEN 0.25 ELSE 0.75 END"
    " + CASE WHEN hybrid_rank <= 10 THEN 0.125 ELSE -0.125 END)::DOUBLE"
)

STRIPPED = r"regexp_replace(coalesce(query, ''), '^\s+|\s+$', '', 'g')"

VALIDATED = f"""
requests AS (
  SELECT conv_id * 100 + turn AS request_id, text AS query,
         CASE WHEN turn = 4 AND conv_id % 2 = 1 THEN 'ltr' ELSE CASE turn WHEN 0 THEN 'tfidf' WHEN 1 THEN 'bm25' WHEN 2 THEN 'embedding' WHEN 3 THEN 'hybrid' WHEN 4 THEN 'rerank'
                   WHEN 5 THEN ' BM25 ' WHEN 6 THEN 'magic' END END AS method,
         CASE turn WHEN 3 THEN 20 WHEN 5 THEN 0 END AS top_k, turn * 0.2 AS alpha, NULL::DOUBLE AS beta,
         turn * 5 AS candidate_depth
  FROM conversations),
resolved AS (
  SELECT request_id, {STRIPPED} AS query, lower(trim(coalesce(method, 'hybrid'))) AS method,
         CAST(coalesce(top_k, 10) AS INTEGER) AS top_k, CAST(coalesce(alpha, 0.4) AS DOUBLE) AS alpha,
         CAST(coalesce(beta, 0.6) AS DOUBLE) AS beta, CAST(coalesce(candidate_depth, 50) AS INTEGER) AS candidate_depth,
         count(*) OVER (PARTITION BY request_id) AS times
  FROM requests),
validated AS (
  SELECT * EXCLUDE (times), CASE WHEN request_id IS NULL THEN 'missing_request_id'
                 WHEN times > 1 THEN 'repeated_request_id'
                 WHEN method NOT IN ('tfidf', 'bm25', 'embedding', 'hybrid', 'rerank', 'ltr') THEN 'unsupported_method'
                 WHEN length(query) < 1 THEN 'empty_query'
                 WHEN length(query) > 256 THEN 'query_too_long'
                 WHEN top_k NOT BETWEEN 1 AND 100 THEN 'invalid_parameter'
                 WHEN method = 'hybrid' AND (alpha NOT BETWEEN 0 AND 1 OR beta NOT BETWEEN 0 AND 1) THEN 'invalid_parameter'
                 WHEN method IN ('rerank', 'ltr') AND candidate_depth NOT BETWEEN 1 AND 100 THEN 'invalid_parameter'
            END AS error
  FROM resolved)"""

SEARCHED = (
    VALIDATED
    + ","
    + r"""
asked AS (SELECT *, query AS query_id FROM validated WHERE error IS NULL),
texts AS (SELECT DISTINCT query_id, query AS text FROM asked),"""
    + letter_vectors("queries", "texts", "query_id")
    + ","
    + letter_vectors("docs", "documents", "doc_id")
    + ","
    + bm25_scores()
    + ","
    + dense_scores()
    + ","
    + tfidf_scores()
    + ","
    + pool()
    + ","
    + pair_scored(100)
    + ","
    + ranked("tfidf_top", "tfidf", 100)
    + r""",
hybrid_lists AS (
  SELECT a.request_id, a.method, p.doc_id, a.alpha * bm25_norm + a.beta * emb_norm AS score, a.top_k
  FROM asked a JOIN pool p USING (query_id) WHERE a.method = 'hybrid'),
rerank_lists AS (
  SELECT a.request_id, a.method, s.doc_id, s.score, s.hybrid_rank, a.top_k
  FROM asked a JOIN scored s USING (query_id) WHERE a.method = 'rerank' AND s.hybrid_rank <= a.candidate_depth),
ltr_rows AS (
  SELECT a.request_id, a.method, s.doc_id, s.score AS ce_score, s.hybrid_rank, a.top_k,
         len(list_intersect(list_distinct(""" + _tokens("a.query") + """), list_distinct(""" + _tokens("concat_ws(' ', d.lang, d.source)") + """))) AS title_overlap_count
  FROM asked a JOIN scored s USING (query_id) JOIN documents d ON d.doc_id = s.doc_id
  WHERE a.method = 'ltr' AND s.hybrid_rank <= a.candidate_depth),
ltr_lists AS (SELECT *, """ + FOREST + """ AS score FROM ltr_rows),"""
    + ranked("hybrid_r", "hybrid_lists", 100, by="request_id")
    + ","
    + ranked("rerank_r", "rerank_lists", 100, by="request_id", tie="hybrid_rank")
    + ","
    + ranked("ltr_r", "ltr_lists", 100, by="request_id", tie="hybrid_rank")
    + r""",
answers AS (
  SELECT a.request_id, a.method, t.doc_id, t.score, t.rank FROM asked a JOIN tfidf_top t USING (query_id)
    WHERE a.method = 'tfidf' AND t.rank <= a.top_k
  UNION ALL SELECT a.request_id, a.method, t.doc_id, t.score, t.rank FROM asked a JOIN b_top t USING (query_id)
    WHERE a.method = 'bm25' AND t.rank <= a.top_k
  UNION ALL SELECT a.request_id, a.method, t.doc_id, t.score, t.rank FROM asked a JOIN e_top t USING (query_id)
    WHERE a.method = 'embedding' AND t.rank <= a.top_k
  UNION ALL SELECT request_id, method, doc_id, score, rank FROM hybrid_r WHERE rank <= top_k
  UNION ALL SELECT request_id, method, doc_id, score, rank FROM rerank_r WHERE rank <= top_k
  UNION ALL SELECT request_id, method, doc_id, score, rank FROM ltr_r WHERE rank <= top_k),
response_items AS (
  SELECT request_id, method, rank, a.doc_id AS product_id, coalesce(concat_ws(' ', lang, source), '') AS title,
         round(score, 6) AS score,
         round(CASE WHEN method IN ('rerank', 'ltr') THEN 1.0::DOUBLE / (1.0 + exp(-greatest(-30, least(30, score))))
                    WHEN method = 'bm25' THEN greatest(0, score) / (greatest(0, score) + 8.0)
                    ELSE least(1, greatest(0, score)) END, 6) AS confidence
  FROM answers a LEFT JOIN documents d ON d.doc_id = a.doc_id)"""
)

# First-round gradients: all scores are equal, so a list is in the order of its ids.
LAMBDAS = r"""
listed AS (
  SELECT query_id, doc_id, coalesce(rel, 0) AS label, pow(2.0, coalesce(rel, 0)) - 1 AS gain,
         row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place
  FROM feats LEFT JOIN qrels USING (query_id, doc_id)),
best AS (
  SELECT query_id, sum(CASE WHEN r <= 30 THEN gain / log2(r + 1) ELSE 0 END) AS ideal
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS r FROM listed) GROUP BY 1),
mates AS (
  SELECT a.query_id, a.doc_id AS a, b.doc_id AS b, CASE WHEN a.label > b.label THEN 1 ELSE -1 END AS sign,
         abs(a.gain - b.gain) * abs(1 / log2(a.place + 1) - 1 / log2(b.place + 1)) / ideal AS worth
  FROM listed a JOIN listed b ON b.query_id = a.query_id AND b.place > a.place AND b.label <> a.label
       JOIN best ON best.query_id = a.query_id
  WHERE a.place <= 30 AND ideal > 0),
pushes AS (
  SELECT query_id, a AS doc_id, sign * 0.5 * worth AS g, 0.25 * worth AS h FROM mates
  UNION ALL SELECT query_id, b, -sign * 0.5 * worth, 0.25 * worth FROM mates),
totals AS (SELECT query_id, sum(worth) AS t FROM mates GROUP BY 1),
lambdas AS (
  SELECT l.query_id, l.doc_id, l.label, coalesce(sum(p.g), 0) * coalesce(any_value(log2(1 + t) / t), 1) AS grad,
         coalesce(sum(p.h), 0) * coalesce(any_value(log2(1 + t) / t), 1) AS hess
  FROM listed l LEFT JOIN pushes p ON p.query_id = l.query_id AND p.doc_id = l.doc_id
       LEFT JOIN totals t ON t.query_id = l.query_id GROUP BY 1, 2, 3)"""

TURNS = "queries AS (SELECT conv_id * 100 + turn AS query_id, text FROM conversations)"


VALIDATED_TURNS = rf"""queries AS (
  SELECT conv_id * 100 + turn AS query_id, {STRIPPED.replace("query", "text")} AS text FROM conversations
  WHERE length({STRIPPED.replace("query", "text")}) BETWEEN 1 AND 256)"""


def first_tree() -> str:
    """Root split and the better split of its two sides, each from a histogram per feature."""
    bins = ", ".join(
        f"CAST(least(832, greatest(0, ceil(({f} + 0.9863) * 16))) AS INTEGER)" for f in FEATURE_NAMES
    )
    signs = "[1, -1, 1, 1, 1, 0, -1, 0, 0, 0, 1, 1, 1, 1, 1]"

    def out(g: str, h: str) -> str:
        return f"greatest(low, least(high, ({g}) / ({h} + 5.0)))"

    def worth(g: str, h: str, o: str) -> str:
        return f"(2.0 * ({g}) * ({o}) - ({h} + 5.0) * ({o}) * ({o}))"

    def best(name: str, rows: str) -> str:
        """The best split of `rows(g, h, b, low, high)`: one row, or none."""
        left, right, whole = out("gl", "hl"), out("ga - gl", "ha - hl"), out("ga", "ha")
        gain = f"{worth('gl', 'hl', left)} + {worth('ga - gl', 'ha - hl', right)} - {worth('ga', 'ha', whole)}"
        return f"""
{name}_h AS (
  SELECT feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n, any_value(low) AS low, any_value(high) AS high
  FROM (SELECT g, h, low, high, unnest(range(1, 16)) AS feature, unnest(b) AS bin FROM {rows}) GROUP BY 1, 2),
{name}_c AS (
  SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
         sum(g) OVER f AS ga, sum(h) OVER f AS ha, sum(n) OVER f AS na
  FROM {name}_h WINDOW w AS (PARTITION BY feature ORDER BY bin), f AS (PARTITION BY feature)),
{name}_g AS (
  SELECT feature, bin, low, high, {left} AS ol, {right} AS o_r, {gain} AS gain
  FROM {name}_c WHERE nl >= 50 AND na - nl >= 50 AND hl >= 1e-3 AND ha - hl >= 1e-3
    AND {signs}[feature] * ({right} - {left}) >= 0),
{name} AS (
  SELECT * FROM {name}_g WHERE gain > 1e-12 AND gain >= (SELECT max(gain) FROM {name}_g) * (1 - 1e-9)
  ORDER BY feature, bin LIMIT 1)"""

    def side(name: str, test: str, sign: int) -> str:
        """Rows of one side of the root with the bounds that its split leaves."""
        middle = "(ol + o_r) / 2.0"
        return f"""
{name} AS (
  SELECT t.g, t.h, t.b,
         CASE WHEN {sign} * s.sign < 0 THEN greatest(s.low, {middle}) ELSE s.low END AS low,
         CASE WHEN {sign} * s.sign > 0 THEN least(s.high, {middle}) ELSE s.high END AS high
  FROM t JOIN (SELECT *, {signs}[feature] AS sign FROM root) s ON t.b[s.feature] {test} s.bin)"""

    return (
        f"""
t AS (
  SELECT grad AS g, hess AS h, [{bins}] AS b, -1e300::DOUBLE AS low, 1e300::DOUBLE AS high
  FROM lambdas JOIN feats USING (query_id, doc_id) JOIN splits USING (query_id) WHERE split = 'train'),"""
        + best("root", "t")
        + ","
        + side("lt", "<=", 1)
        + ","
        + side("rt", ">", -1)
        + ","
        + best("lbest", "lt")
        + ","
        + best("rbest", "rt")
        + """,
second AS (
  SELECT * FROM (SELECT 1 AS side, * FROM lbest UNION ALL SELECT 2 AS side, * FROM rbest)
  ORDER BY gain DESC, side LIMIT 1),
nodes AS (
  SELECT 0 AS node, feature, bin, 1 AS left, 2 AS right, 0.0 AS value, gain FROM root
  UNION ALL SELECT k, s.feature, s.bin, coalesce(s.l, -1), coalesce(s.r, -1), r.value * 0.03, coalesce(s.gain, 0)
  FROM (SELECT 1 AS k, ol AS value FROM root UNION ALL SELECT 2, o_r FROM root) r
       LEFT JOIN (SELECT *, 3 AS l, 4 AS r FROM second) s ON s.side = r.k
  UNION ALL SELECT 3, NULL, NULL, -1, -1, ol * 0.03, 0 FROM second
  UNION ALL SELECT 4, NULL, NULL, -1, -1, o_r * 0.03, 0 FROM second)"""
    )


FIRST_TREE_ROWS = f"""SELECT CAST(node AS INTEGER) AS node, {FEATURE_NAMES!r}[feature] AS feature,
       round(coalesce(-0.9863 + bin / 16.0, 0)::DOUBLE, 6) AS threshold, CAST("left" AS INTEGER) AS "left",
       CAST("right" AS INTEGER) AS "right", round(value::DOUBLE, 6) AS value, round(gain::DOUBLE, 6) AS gain FROM nodes"""

LOG = r"""
log AS (
  SELECT event_id, ts AS time, event_type AS method, '/' || event_type AS path,
         CASE WHEN user_id % 2 = 1 THEN 'warm' ELSE 'cold' END AS phase, CAST(user_id % 2 = 1 AS INTEGER) AS cached,
         value AS latency_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code
  FROM events)"""

SAMPLED = r"""
hashed AS (
  SELECT *, md5(concat('42|', example_id)) AS h FROM graded),
first_draw AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY relevance_score ORDER BY h, example_id) AS place FROM hashed)
  WHERE place <= floor(50000 / (SELECT count(DISTINCT relevance_score) FROM hashed))),
rest AS (
  SELECT *, row_number() OVER (ORDER BY h, example_id) AS place FROM hashed
  WHERE example_id NOT IN (SELECT example_id FROM first_draw))"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


RANKED = "query_id, doc_id, round(score, 6) AS score, rank"
FIVE = ("precision", "recall", "ndcg", "ap", "rr")
R5 = ", ".join(f"round({m}, 6) AS {m}" for m in FIVE)


def statements() -> dict[str, str]:
    sql = {
        "profile_nulls": _with(JUDGMENTS)
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_nulls, count(*) AS n_rows FROM judgments"
            for c in ("example_id", "query", "product_id", "product_locale", "esci_label")
        ),
        "first_rows": _with(JUDGMENTS)
        + "SELECT example_id, query, product_id, product_locale, esci_label FROM judgments ORDER BY example_id LIMIT 5",
        "label_counts": _with(JUDGMENTS)
        + "SELECT esci_label, count(*) AS n FROM judgments GROUP BY 1",
        "distinct_counts": _with(JUDGMENTS)
        + "SELECT count(DISTINCT query) AS n_query, count(DISTINCT product_id) AS n_product_id FROM judgments",
        "query_length_stats": "WITH q AS (SELECT len("
        + _tokens("text")
        + """) AS n FROM conversations)
SELECT round(avg(n), 6) AS mean_len, CAST(min(n) AS INTEGER) AS min_len, CAST(max(n) AS INTEGER) AS max_len,
       round(avg(CASE WHEN n BETWEEN 1 AND 2 THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_1_2,
       round(avg(CASE WHEN n BETWEEN 3 AND 5 THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_3_5,
       round(avg(CASE WHEN n >= 6 THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_6_plus FROM q""",
        "query_length_hist": "SELECT CAST(least(len("
        + _tokens("text")
        + "), 15) AS INTEGER) AS words, count(*) AS n_queries FROM (SELECT DISTINCT text FROM conversations) GROUP BY 1",
        "graded_locale_rows": _with(JUDGMENTS, GRADED)
        + "SELECT example_id, query, product_id, esci_label, relevance_score FROM graded WHERE lower(product_locale) = 'r'",
        "locale_fallback": _with(JUDGMENTS, GRADED)
        + "SELECT relevance_score, count(*) AS n FROM graded GROUP BY 1",
        "product_text": _with(CATALOG)
        + "SELECT product_id, product_text FROM catalog WHERE length(product_text) > 0",
        "text_preview": r"""WITH d AS (
  SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE substring(t, 1, 59) || '…' END AS preview FROM d""",
        "judgments_join_catalog": _with(JUDGMENTS, GRADED, CATALOG)
        + "SELECT example_id, query, product_id, relevance_score, product_title, product_text FROM graded JOIN catalog USING (product_id)",
        "judgments_join_catalog_locale": _with(JUDGMENTS, CATALOG)
        + """SELECT j.example_id, j.product_id, j.product_locale, c.product_title
FROM judgments j JOIN (SELECT * FROM catalog CROSS JOIN (VALUES ('A'), ('R')) v(product_locale)) c
  ON c.product_id = j.product_id AND c.product_locale = j.product_locale""",
        "balanced_sample": _with(JUDGMENTS, GRADED, SAMPLED)
        + "SELECT example_id, query, product_id, relevance_score FROM first_draw",
        "balanced_sample_topup": _with(JUDGMENTS, GRADED, SAMPLED)
        + """SELECT example_id, query, product_id, relevance_score FROM first_draw UNION ALL
SELECT example_id, query, product_id, relevance_score FROM rest WHERE place <= 50000 - (SELECT count(*) FROM first_draw)""",
        "eval_queries": _with(JUDGMENTS, GRADED, QRELS)
        + """SELECT query_id FROM qrels GROUP BY 1 HAVING max(rel) >= 1 ORDER BY md5(concat('42|', query_id)), query_id LIMIT 3000""",
        "display_queries": _with(JUDGMENTS, GRADED, QRELS)
        + """SELECT query_id FROM (SELECT DISTINCT query_id FROM qrels) ORDER BY md5(concat('42|', query_id)), query_id LIMIT 10""",
        "query_split": _with(
            "queries AS (SELECT item_id AS query_id FROM benchmark)", SPLITS
        )
        + "SELECT query_id, split FROM splits",
        "corpus_dedup": _with(JUDGMENTS, CATALOG)
        + """SELECT doc_id, first_query, product_text FROM (
  SELECT product_id AS doc_id, query AS first_query, product_text,
         row_number() OVER (PARTITION BY product_id ORDER BY example_id) AS place
  FROM judgments JOIN catalog USING (product_id)) WHERE place = 1""",
        "qrels_max": _with(JUDGMENTS, GRADED, QRELS) + "SELECT query_id, doc_id, rel FROM qrels",
        "bm25_topk": _with(
            "queries AS (SELECT item_id AS query_id, text FROM benchmark)",
            bm25_scores(docs="documents"),
            ranked("r", "bm25", 10),
        )
        + f"SELECT {RANKED} FROM r",
        "bm25_fill": _with(
            SHOP,
            bm25_scores(),
            """full_s AS (SELECT q.query_id, d.doc_id, coalesce(b.score, 0) AS score, CASE WHEN b.score IS NULL THEN 1 ELSE 0 END AS pad
  FROM queries q CROSS JOIN docs d LEFT JOIN bm25 b ON b.query_id = q.query_id AND b.doc_id = d.doc_id)""",
            ranked("r", "full_s", 150, tie="pad, doc_id"),
        )
        + f"SELECT {RANKED} FROM r",
        "tfidf_topk": _with(
            "queries AS (SELECT item_id AS query_id, text FROM benchmark)",
            tfidf_scores(docs="documents"),
            ranked("r", "tfidf", 10),
        )
        + f"SELECT {RANKED} FROM r",
        "bm25_many_queries": _with(TURNS, bm25_scores(docs="documents"), ranked("r", "bm25", 10))
        + "SELECT query_id, doc_id, round(score, 4) AS score, rank FROM r",
        "tfidf_many_queries": _with(TURNS, tfidf_scores(docs="documents"), ranked("r", "tfidf", 10))
        + f"SELECT {RANKED} FROM r",
        **dict.fromkeys(
            ["dense_topk", "dense_cells_topk"],
            _with(
                UNIT_VECTORS,
                "queries AS (SELECT vec_id AS query_id, vec FROM unit)",
                "docs AS (SELECT vec_id AS doc_id, vec FROM unit)",
                dense_scores(),
                ranked("r", "emb", 10),
            )
            + f"SELECT {RANKED} FROM r",
        ),
        "encoded_dense_topk": _with(
            letter_vectors("docs", "documents", "doc_id"),
            letter_vectors(
                "queries", "(SELECT item_id AS query_id, text FROM benchmark)", "query_id"
            ),
            dense_scores(),
            ranked("r", "emb", 10),
        )
        + f"SELECT {RANKED} FROM r",
        "pair_similarity": _with(
            "turns AS (SELECT conv_id AS k, turn, text FROM conversations)",
            letter_vectors("enc", "(SELECT k * 100 + turn AS id, text FROM turns)", "id"),
        )
        + """SELECT a.k AS conv_id, a.turn, round(list_dot_product(x.vec, y.vec), 6) AS similarity
FROM turns a JOIN turns b ON b.k = a.k AND b.turn = a.turn + 1
     JOIN enc x ON x.id = a.k * 100 + a.turn JOIN enc y ON y.id = b.k * 100 + b.turn""",
        "hybrid_candidates": _with(TEXTS, bm25_scores(), dense_scores(), pool())
        + """SELECT query_id, doc_id, bm25_rank, emb_rank, round(bm25, 6) AS bm25, round(emb, 6) AS emb,
       round(bm25_norm, 6) AS bm25_norm, round(emb_norm, 6) AS emb_norm FROM pool""",
        "hybrid_topk": _with(TEXTS, bm25_scores(), dense_scores(), pool(), hybrid(10, "0.5", "0.5"))
        + f"SELECT {RANKED} FROM hyb",
        "pair_rerank": _with(
            SHOP, bm25_scores(), dense_scores(), pool(), pair_scored(50, None), RERANKED
        )
        + f"SELECT {RANKED}, hybrid_rank FROM reranked",
        "pair_text_cut": _with(SHOP, bm25_scores(), dense_scores(), pool(), pair_scored(50, 20))
        + "SELECT query_id, doc_id, round(score, 6) AS ce_score FROM scored",
        "score_store_resume": _with(SHOP, bm25_scores(), dense_scores(), pool(), pair_scored())
        + "SELECT query_id, doc_id, round(score, 6) AS ce_score FROM scored",
        "missing_pairs": _with(TEXTS, bm25_scores(), dense_scores(), pool(), hybrid(50), hybrid(50, "0.6", "0.4", "other"))
        + """SELECT o.query_id, o.doc_id FROM other o
WHERE NOT EXISTS (SELECT 1 FROM hyb h WHERE h.query_id = o.query_id AND h.doc_id = o.doc_id)""",
        "cache_id_check": """SELECT count(*) FILTER (WHERE e.vec_id IS NULL) AS only_in_a, count(*) FILTER (WHERE d.doc_id IS NULL) AS only_in_b,
       count(*) FILTER (WHERE e.vec_id IS NULL OR d.doc_id IS NULL) = 0 AS same_ids
FROM documents d FULL JOIN embeddings e ON e.vec_id = d.doc_id""",
        "ltr_features": _with(FEATURED) + f"SELECT query_id, doc_id, {ROUNDED_FEATURES} FROM feats",
        "ltr_training_rows": _with(FEATURED, SPLITS)
        + f"""SELECT query_id, doc_id, {ROUNDED_FEATURES}, coalesce(rel, 0) AS label, split
FROM feats LEFT JOIN qrels USING (query_id, doc_id) JOIN splits USING (query_id)""",
        "unjudged_zero": _with(FIVE_METHODS)
        + """SELECT method, q.text AS query, r.doc_id AS product_id, round(score, 6) AS score, rank, coalesce(rel, 0) AS relevance_score
FROM rankings r JOIN queries q USING (query_id) LEFT JOIN qrels g ON g.query_id = r.query_id AND g.doc_id = r.doc_id""",
        "metrics_per_query": _with(EVALUATED) + f"SELECT method, query_id, {R5} FROM per_query",
        "metrics_by_method": _with(EVALUATED) + f"SELECT method, {R5} FROM means",
        "best_method": _with(EVALUATED)
        + """SELECT method, round(ndcg, 6) AS value FROM means
ORDER BY round(ndcg, 9) DESC, list_position(['tfidf', 'bm25', 'embedding', 'hybrid', 'rerank'], method) LIMIT 1""",
        "heldout_comparison": _with(FIVE_METHODS, metrics(), SPLITS)
        + """SELECT method, """
        + ", ".join(f"round(coalesce(avg({m}), 0), 6) AS {m}" for m in FIVE)
        + """ FROM per_query JOIN splits USING (query_id) WHERE split = 'test' GROUP BY 1""",
        "relative_change": _with(
            EVALUATED,
            "long AS (" + " UNION ALL ".join(f"SELECT method, '{m}' AS metric, {m} AS value FROM means" for m in FIVE) + ")",
        )
        + """SELECT o.metric, o.method, round(CASE WHEN o.value <> 0 THEN (n.value - o.value) / o.value * 100 ELSE 'nan'::DOUBLE END, 6) AS change_pct
FROM long o JOIN long n ON n.metric = o.metric AND n.method = 'rerank' WHERE o.method <> 'rerank'""",
        "weight_sweep": _with(
            SHOP,
            bm25_scores(),
            dense_scores(),
            pool(),
            """grid AS (SELECT * FROM (VALUES ('0', 0.5, 0.5), ('1', 0.7, 0.3), ('2', 0.6, 0.4), ('3', 0.4, 0.6)) v(method, alpha, beta)),
tried AS (SELECT method, query_id, doc_id, alpha * bm25_norm + beta * emb_norm AS score FROM pool CROSS JOIN grid)""",
            ranked("rankings", "tried", 10, by="method, query_id"),
            metrics("(SELECT method FROM grid)"),
            MEANS,
        )
        + """SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM means JOIN grid USING (method)""",
        "a_fails_b_succeeds": _with(EVALUATED, side_by_side("embedding", "bm25"))
        + """SELECT query_id, round(coalesce(b_ndcg, 0) - coalesce(a_ndcg, 0), 6) AS gain FROM sides
WHERE a_recall = 0 AND b_recall > 0 ORDER BY round(coalesce(b_ndcg, 0) - coalesce(a_ndcg, 0), 9) DESC, query_id LIMIT 5""",
        "a_beats_b": _with(EVALUATED, side_by_side("hybrid", "bm25"))
        + """SELECT query_id, round(a_ndcg - b_ndcg, 6) AS gain FROM sides WHERE round(a_ndcg, 9) > round(b_ndcg, 9)
ORDER BY round(a_ndcg - b_ndcg, 9) DESC, query_id LIMIT 10""",
        "win_loss_counts": _with(EVALUATED, side_by_side("hybrid", "rerank"))
        + """SELECT o.outcome, count(c.query_id) AS queries,
       round(count(c.query_id)::DOUBLE / (SELECT count(*) FROM changed), 6) AS share
FROM (SELECT unnest(['improved', 'unchanged', 'worsened']) AS outcome) o LEFT JOIN changed c USING (outcome) GROUP BY 1""",
        "largest_changes": _with(EVALUATED, side_by_side("hybrid", "rerank"))
        + " UNION ALL ".join(
            f"""(SELECT query_id, outcome, round(diff, 6) AS diff FROM changed WHERE outcome = '{o}'
ORDER BY round(abs(diff), 9) DESC, query_id LIMIT 10)"""
            for o in ("improved", "worsened")
        ),
        "largest_changes_lists": _with(
            EVALUATED,
            side_by_side("hybrid", "rerank"),
            "cases AS ("
            + " UNION ALL ".join(
                f"""(SELECT query_id, outcome, diff FROM changed WHERE outcome = '{o}'
ORDER BY round(abs(diff), 9) DESC, query_id LIMIT 10)"""
                for o in ("improved", "worsened")
            )
            + ")",
        )
        + """SELECT query_id, any_value(outcome) AS outcome, round(any_value(diff), 6) AS diff,
       string_agg(doc_id, ',' ORDER BY rank) FILTER (WHERE method = 'hybrid') AS hybrid,
       string_agg(doc_id, ',' ORDER BY rank) FILTER (WHERE method = 'rerank') AS rerank
FROM cases LEFT JOIN (SELECT * FROM rankings WHERE rank <= 5) USING (query_id) GROUP BY 1""",
        "stage_examples": _with(
            EVALUATED,
            side_by_side("hybrid", "rerank"),
            "cases AS (SELECT * FROM changed ORDER BY round(abs(diff), 9) DESC, query_id LIMIT 6)",
        )
        + """SELECT query_id, round(any_value(before), 6) AS before, round(any_value(after), 6) AS after,
       string_agg(doc_id, ',' ORDER BY rank) FILTER (WHERE method = 'bm25') AS bm25,
       string_agg(doc_id, ',' ORDER BY rank) FILTER (WHERE method = 'hybrid') AS hybrid,
       string_agg(doc_id, ',' ORDER BY rank) FILTER (WHERE method = 'rerank') AS rerank
FROM cases LEFT JOIN (SELECT * FROM rankings WHERE rank <= 5) USING (query_id) GROUP BY 1""",
        "known_judgments": _with(
            EVALUATED,
            side_by_side("hybrid", "rerank"),
            "cases AS (SELECT * FROM changed ORDER BY round(abs(diff), 9) DESC, query_id LIMIT 6)",
        )
        + "SELECT query_id, doc_id, rel FROM qrels WHERE query_id IN (SELECT query_id FROM cases)",
        "csv_round_trip": r"""WITH d AS (
  SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, replace(CASE WHEN length(t) <= 80 THEN t ELSE substring(t, 1, 79) || '…' END, 'e', '"') AS text FROM d""",
        "sample_round_trip": _with(JUDGMENTS, GRADED, CATALOG)
        + """SELECT example_id, query, product_id, relevance_score, product_text FROM graded JOIN catalog USING (product_id)
WHERE length(product_text) > 0""",
        "preview_rows": _with(JUDGMENTS)
        + "SELECT example_id, query, product_id, product_locale, esci_label FROM judgments ORDER BY example_id LIMIT 100",
        "shuffled_rows": _with(JUDGMENTS)
        + "SELECT example_id, row_number() OVER (ORDER BY md5(concat('42|', example_id)), example_id) AS position FROM judgments",
        "resumed_vectors": _with(letter_vectors("v", "documents", "doc_id"))
        + "SELECT doc_id, round(vec[5], 6) AS e_share FROM v",
        "arrow_encoder": _with(
            letter_vectors("v", "(SELECT item_id AS query_id, text FROM benchmark)", "query_id")
        )
        + "SELECT query_id, round(vec[5], 6) AS e_share FROM v",
        "arrow_pair_scores": _with(SHOP, bm25_scores(), dense_scores(), pool(), pair_scored())
        + "SELECT query_id, doc_id, round(score, 6) AS ce_score FROM scored",
        "forest_scores": _with(FEATURED)
        + f"SELECT query_id, doc_id, round({FOREST}, 6) AS ltr_score FROM feats",
        "ltr_lambdas": _with(FEATURED, LAMBDAS)
        + "SELECT query_id, doc_id, round(grad, 6) AS grad, round(hess, 6) AS hess FROM lambdas",
        "ltr_root_sums": _with(FEATURED, LAMBDAS)
        + """SELECT label, title_overlap_count, round(sum(grad), 4) AS grad, round(sum(hess), 4) AS hess, count(*) AS n
FROM lambdas JOIN feats USING (query_id, doc_id) GROUP BY 1, 2""",
        "ltr_first_tree": _with(FEATURED, LAMBDAS, SPLITS, first_tree()) + FIRST_TREE_ROWS,
        "request_validation": _with(VALIDATED)
        + "SELECT request_id, query, method, top_k, round(alpha, 6) AS alpha, beta, candidate_depth, error FROM validated",
        "search_batch": _with(SEARCHED)
        + "SELECT request_id, method, doc_id, round(score, 6) AS score, rank FROM answers",
        "response_rows": _with(SEARCHED)
        + """SELECT a.request_id, a.query, a.method AS ranking_method, a.top_k, CAST(count(i.rank) AS INTEGER) AS count,
       string_agg(concat_ws(':', i.rank, i.product_id, i.title), ';' ORDER BY i.rank) AS results,
       round(sum(i.score), 6) AS score_sum, round(sum(i.confidence), 6) AS confidence_sum
FROM asked a LEFT JOIN response_items i USING (request_id) GROUP BY 1, 2, 3, 4""",
        "display_labels": """SELECT event_id, printf('%.1f%%', value / 1000.0::DOUBLE * 100.0) AS share_label,
       CASE WHEN value * 10 < 1000 THEN printf('%.1f ms', value * 10) ELSE printf('%.2f s', value * 10 / 1000.0) END AS duration_label
FROM events""",
        "latency_stats": _with(LOG)
        + """SELECT method, phase, count(latency_ms) AS calls, round(avg(latency_ms), 6) AS mean_ms, round(median(latency_ms), 6) AS median_ms,
       min(latency_ms) AS min_ms, max(latency_ms) AS max_ms FROM log GROUP BY 1, 2""",
        "stage_averages": _with(LOG)
        + """SELECT round((SELECT avg(m) FROM (SELECT avg(latency_ms) AS m FROM log WHERE phase = 'cold' GROUP BY method)), 6) AS cold_mean_of_means,
       round((SELECT avg(latency_ms) FROM log WHERE phase = 'warm'), 6) AS warm_mean""",
        "hit_rate": _with(LOG)
        + """SELECT CAST(sum(cached) AS BIGINT) AS hits, CAST(sum(1 - cached) AS BIGINT) AS misses, round(avg(cached), 4) AS hit_rate FROM log""",
        "throughput": _with(LOG)
        + """SELECT method, count(*) AS pairs, round(sum(latency_ms) / 1000.0, 6) AS seconds,
       round(count(*) / (sum(latency_ms) / 1000.0), 6) AS pairs_per_second, round(sum(latency_ms) / count(*), 6) AS ms_per_pair
FROM log GROUP BY 1""",
        "report_extract": _with(LOG)
        + """SELECT method, arg_max(round(latency_ms, 2), event_id) FILTER (WHERE phase = 'cold') AS cold,
       arg_max(round(latency_ms, 2), event_id) FILTER (WHERE phase = 'warm') AS warm FROM log GROUP BY 1""",
        "report_numbers": _with(LOG)
        + """SELECT ['search', 'rerank', 'ltr', 'cached', 'rss_before_mb', 'rss_after_mb', 'rss_peak_mb', 'load_footprint_mb',
        'startup_s', 'logical_cpus', 'physical_cpus', 'corpus'][event_id % 12 + 1] AS name,
       arg_min(round(latency_ms, 2), event_id) AS value FROM log GROUP BY 1""",
        "windowed_latency": _with(LOG)
        + """SELECT strftime(date_trunc('hour', time), '%Y-%m-%d %H:%M') AS window_start, path, count(*) AS requests,
       round(avg(latency_ms), 6) AS mean_ms, max(latency_ms) AS max_ms,
       quantile_disc(latency_ms, 0.95) AS p95_ms, count(*) FILTER (WHERE status_code >= 500) AS errors
FROM log GROUP BY 1, 2""",
    }
    sql["best_weights"] = sql["weight_sweep"].split("SELECT CAST(alpha AS DOUBLE)")[0] + (
        """SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta, round(ndcg, 6) AS ndcg
FROM means JOIN grid USING (method) ORDER BY round(ndcg, 9) DESC, method LIMIT 1"""
    )
    sql["train_weights"] = (
        sql["best_weights"]
        .replace("\nmeans AS (", SPLITS + ",\nmeans AS (")
        .replace("FROM per_query GROUP BY 1)", "FROM per_query JOIN splits USING (query_id) WHERE split <> 'test' GROUP BY 1)")
    )
    sql["report_round_trip"] = sql["latency_stats"]
    sql["stream_index_refresh"] = (
        _with(VALIDATED_TURNS, bm25_scores(docs="documents"), ranked("r", "bm25", 5))
        + """SELECT r.query_id AS request_id, r.rank, r.doc_id, CASE WHEN r.query_id % 200 < 100 THEN t.title ELSE upper(t.title) END AS title,
       round(r.score, 6) AS score
FROM r JOIN (SELECT doc_id, concat_ws(' ', lang, source) AS title FROM documents) t USING (doc_id)"""
    )
    sql["incremental_bm25_topk"] = sql["bm25_topk"]
    sql["scoring_runs"] = (
        _with(SHOP, bm25_scores(), dense_scores(), pool(), pair_scored())
        + """, pairs AS (SELECT query_id, doc_id, min(hybrid_rank) AS place FROM scored GROUP BY 1, 2),
counts AS (SELECT count(*) AS n, count(*) FILTER (WHERE place <= 25) AS half FROM pairs)
SELECT 1 AS run, half AS new_pairs, 0::BIGINT AS reused_pairs, half > 0 AS timed FROM counts
UNION ALL SELECT 2, n - half, half, n > half FROM counts UNION ALL SELECT 3, 0, n, false FROM counts"""
    )
    sql["stream_requests"] = sql["search_batch"]
    sql["stream_latency"] = sql["windowed_latency"]
    return sql
