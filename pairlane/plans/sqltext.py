"""DuckDB SQL fragments for the oracle statements (plain SQL text).

They mirror the column expressions in ``pairlane.functions.text`` so every
registered query has an independent SQL formulation."""

from __future__ import annotations

from pairlane.functions.text import MAX_DESC_CHARS, STRIP_RE, TOKEN_RE


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP_RE}', '', 'g')"


def clean(x: str) -> str:
    return f"coalesce({strip(f'CAST({x} AS VARCHAR)')}, '')"


def product_text(title: str, brand: str, desc: str, price: str | None = None,
                 cur: str | None = None, include_price: bool = False) -> str:
    t, b, d = clean(title), clean(brand), clean(desc)
    parts = [f"CASE WHEN {t} <> '' THEN '[TITLE] ' || {t} END",
             f"CASE WHEN {b} <> '' THEN '[BRAND] ' || {b} END",
             f"CASE WHEN {d} <> '' THEN '[DESC] ' || substring({d}, 1, {MAX_DESC_CHARS}) END"]
    if include_price:
        p, c = clean(price), clean(cur)
        parts.append(f"CASE WHEN {p} <> '' THEN '[PRICE] ' || CASE WHEN {c} <> '' THEN {c} || ' ' || {p} ELSE {p} END END")
    j = f"concat_ws(' ', {', '.join(parts)})"
    return f"(CASE WHEN {j} = '' THEN '[EMPTY]' ELSE {j} END)"


def side_text(side: str, include_price: bool = False, alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return product_text(f"{a}title_{side}", f"{a}brand_{side}", f"{a}description_{side}",
                        f'{a}price_{side}', f'{a}"priceCurrency_{side}"', include_price)


def tokens(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({x})), '{TOKEN_RE}')"


def uni_bi_grams(toks: str) -> str:
    return (f"list_concat({toks}, list_transform(range(1, len({toks})), "
            f"lambda i: {toks}[i] || ' ' || {toks}[i + 1]))")


def ngram_ctes(name: str, src: str, id_col: str, text: str) -> str:
    """CTEs ending in ``name(id_col, term)``: word uni- and bigrams, one row
    per occurrence.  Bigrams come from a join on token position (a list
    lambda over long token lists is quadratic in DuckDB)."""
    return f"""{name}_t AS (SELECT {id_col} AS id, {tokens(text)} AS t FROM {src}),
{name}_u AS (SELECT id, unnest(t) AS tok, unnest(generate_series(1, len(t))) AS pos FROM {name}_t),
{name} AS (SELECT id AS {id_col}, tok AS term FROM {name}_u
    UNION ALL SELECT a.id, a.tok || ' ' || b.tok FROM {name}_u a JOIN {name}_u b ON b.id = a.id AND b.pos = a.pos + 1)"""


def tfidf_ctes(pairs: str = "pairs", max_features: int = 50000) -> str:
    """CTEs corpus, queries, dtf, vocab, dv, qv, scores, ranks, for TF-IDF
    evaluation of the pair table ``pairs``."""
    rt, lt = side_text("right"), side_text("left")
    return f"""
corpus_raw AS (SELECT {rt} AS text, min(pair_id) AS first_pair_id FROM {pairs} GROUP BY 1),
corpus AS (SELECT row_number() OVER (ORDER BY first_pair_id, text) - 1 AS corpus_idx, text FROM corpus_raw),
q_raw AS (SELECT {lt} AS query_text, {rt} AS positive_text, count(*) AS n_rows, min(pair_id) AS first_pair_id
          FROM {pairs} WHERE label = 1 GROUP BY 1, 2),
queries AS (SELECT row_number() OVER (ORDER BY q.first_pair_id, q.query_text, q.positive_text) - 1 AS query_id,
            q.query_text, q.n_rows, c.corpus_idx AS pos_idx, q.first_pair_id
            FROM q_raw q JOIN corpus c ON c.text = q.positive_text),
{ngram_ctes('dterm', 'corpus', 'corpus_idx', 'text')},
dtf AS (SELECT corpus_idx, term, count(*) AS tf FROM dterm GROUP BY 1, 2),
tstats AS (SELECT term, sum(tf) AS cnt, count(*) AS df FROM dtf GROUP BY 1),
vocab AS (SELECT term, df, ln((1.0 + (SELECT count(*) FROM corpus)) / (1.0 + df)) + 1.0 AS idf
          FROM tstats ORDER BY cnt DESC, term LIMIT {max_features}),
dw0 AS (SELECT corpus_idx, t.term, (1 + ln(tf)) * idf AS w0 FROM dtf t JOIN vocab v ON v.term = t.term),
dv AS (SELECT corpus_idx, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY corpus_idx)) AS w FROM dw0),
{ngram_ctes('qterm', 'queries', 'query_id', 'query_text')},
qtf AS (SELECT query_id, term, count(*) AS tf FROM qterm GROUP BY 1, 2),
qw0 AS (SELECT query_id, t.term, (1 + ln(tf)) * idf AS w0 FROM qtf t JOIN vocab v ON v.term = t.term),
qv AS (SELECT query_id, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY query_id)) AS w FROM qw0),
scores AS (SELECT query_id, corpus_idx, round(sum(qv.w * dv.w), 9) AS score
           FROM qv JOIN dv ON qv.term = dv.term GROUP BY 1, 2),
spos AS (SELECT q.query_id, q.pos_idx, q.n_rows, coalesce(s.score, 0.0) AS s_pos FROM queries q
         LEFT JOIN scores s ON s.query_id = q.query_id AND s.corpus_idx = q.pos_idx),
cnts AS (SELECT p.query_id, count_if(s.score > p.s_pos) AS n_gt,
          count_if(s.score = p.s_pos AND s.corpus_idx < p.pos_idx) AS n_tie,
          count_if(s.corpus_idx < p.pos_idx) AS n_before
         FROM spos p JOIN scores s ON s.query_id = p.query_id GROUP BY 1),
ranks AS (SELECT p.query_id, p.n_rows,
          1 + coalesce(n_gt, 0) + coalesce(n_tie, 0)
            + CASE WHEN p.s_pos = 0 THEN p.pos_idx - coalesce(n_before, 0) ELSE 0 END AS rank
          FROM spos p LEFT JOIN cnts c ON c.query_id = p.query_id)"""


def metrics_select(ranks: str = "ranks", weight: str = "n_rows", ks=(1, 5)) -> str:
    accs = ", ".join(
        f"round(sum(CASE WHEN rank <= {k} THEN {weight} ELSE 0 END) / sum({weight}), 6) AS acc_at_{k}"
        for k in ks)
    return (f"SELECT round(sum({weight} / rank) / sum({weight}), 6) AS mrr, {accs}, "
            f"CAST(sum({weight}) AS DOUBLE) AS n_queries FROM {ranks} HAVING sum({weight}) > 0")


#: Every query with every document; 0 where they share no term.
EVERY_SCORE = """,
every_score AS (SELECT q.query_id, c.corpus_idx, coalesce(s.score, 0.0) AS score FROM queries q CROSS JOIN corpus c
                LEFT JOIN scores s ON s.query_id = q.query_id AND s.corpus_idx = c.corpus_idx)"""


def topk_select(k: int) -> str:
    """The k best of all documents, those without a shared term by index."""
    return f"""
SELECT query_id, corpus_idx, score, rank FROM (
 SELECT q.query_id, c.corpus_idx, coalesce(s.score, 0.0) AS score,
        row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(s.score, 0.0) DESC, c.corpus_idx) AS rank
 FROM queries q CROSS JOIN corpus c LEFT JOIN scores s ON s.query_id = q.query_id AND s.corpus_idx = c.corpus_idx)
WHERE rank <= {k}"""
