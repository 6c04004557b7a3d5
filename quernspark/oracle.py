"""DuckDB SQL for the queries of catalog.py."""

from .operators.chunk import SENTENCE_SEPARATORS, SEPARATORS
from .operators.generate import SYSTEM

_PROMPT = "\n\nCONTEXT:\n" + "\n\nQUESTION: " + "\n\nANSWER:"

BLANKS = r"[\s\x{00A0}]+"
_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _strip(x):
    return rf"regexp_replace({x}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"


_NORM_BLANKS = "lower(" + _strip(f"regexp_replace({{}}, '{BLANKS}', ' ', 'g')") + ")"
_NORM_BLANKS = _NORM_BLANKS.replace("{00A0}", "{{00A0}}")
_GONE = ("script", "style", "nav", "header", "footer")


def _decoded(x):
    for a, b in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&mdash;", "'—'"), ("&ndash;", "'–'"), ("&hellip;", "'…'"), ("&amp;", "'&'")):
        b = "' '" if a == "&nbsp;" else b
        x = f"replace({x}, '{a}', {b})"
    return x


def _body():
    m = r"regexp_extract(html, '(?is)<main\b[^>]*>(.*)</main\s*>', 1)"
    x = f"CASE WHEN {m} = '' THEN html ELSE {m} END"
    x = rf"regexp_replace({x}, '(?s)<!--.*?-->|<![^>]*>', '', 'g')"
    for t in _GONE:
        x = rf"regexp_replace({x}, '(?is)<{t}\b[^>]*>.*?</{t}\s*>', '', 'g')"
    return x


_HTML_TEXT = f"array_to_string(list_filter(list_transform(string_split({_decoded(f"regexp_replace({_body()}, '<[^>]*>', chr(10), 'g')")}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10))"
_HTML_FLAT = _strip(f"regexp_replace({_decoded(f"regexp_replace({_body()}, '<[^>]*>', ' ', 'g')")}, '{BLANKS}', ' ', 'g')")

_PAGES = rf"SELECT page_id, {_strip(_decoded(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)"))} AS title, {_HTML_TEXT} AS text FROM pages"
_TERMS = f"""
tok AS (SELECT doc_id AS chunk_id, unnest({_TOK.format('text')}) AS term FROM documents),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id AS chunk_id, coalesce(len({_TOK.format('text')}), 0) AS dl FROM documents),
nn AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, nn),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_BM25 = f"""{_TERMS},
q AS (SELECT item_id AS query_id, unnest({_TOK.format('text')}) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, round(sum(times * (idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id), nn GROUP BY ALL),
every AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, coalesce(s.score, 0.0) AS score FROM benchmark b, documents d LEFT JOIN sc s ON s.query_id = b.item_id AND s.chunk_id = d.doc_id),
bm AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM every QUALIFY rank <= 20)"""
_DENSE = """
dd AS (SELECT item_id AS query_id, v.vec_id AS chunk_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS distance
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings v),
de AS (SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM dd QUALIFY rank <= 20)"""
_RRF = f"""{_BM25},{_DENSE},
fu AS (SELECT query_id, chunk_id, round(coalesce(1.0 / (60 + de.rank), 0) + coalesce(1.0 / (60 + bm.rank), 0), 9) AS score, coalesce(de.rank, 1000000 + bm.rank) AS seen FROM de FULL JOIN bm USING (query_id, chunk_id)),
hy AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM fu QUALIFY rank <= 20)"""
_COVER = f"round(coalesce(len(list_intersect(list_distinct({_TOK.format('b.text')}), {_TOK.format('d.text')}))::DOUBLE / nullif(len(list_distinct({_TOK.format('b.text')})), 0), 0), 6)"


def _rerank(src):
    return f"""(SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS rank FROM
  (SELECT r.query_id, r.chunk_id, r.rank AS was, {_COVER} AS score FROM {src} r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.chunk_id) QUALIFY rank <= 5)"""


_ALL = f"""{_RRF}, hr AS {_rerank('hy')},
ranked AS (SELECT 'dense_only' AS mode, query_id, chunk_id, rank FROM de WHERE rank <= 5 UNION ALL SELECT 'sparse_only', query_id, chunk_id, rank FROM bm WHERE rank <= 5
  UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM hy WHERE rank <= 5 UNION ALL SELECT 'hybrid_rerank', query_id, chunk_id, rank FROM hr)"""
_GOLD = f"""
gold AS (SELECT item_id, doc_id FROM (SELECT item_id, {_NORM.format('text')} AS p FROM benchmark) b JOIN (SELECT doc_id, {_NORM.format('text')} AS d FROM documents) t ON contains(t.d, b.p) AND b.p <> '')"""
_SENTENCES = r"string_split(regexp_replace({}, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(2), 'g'), chr(2))"
_RUNS = f"""{_ALL},{_GOLD},
g2 AS (SELECT item_id AS query_id, source, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1 AS gold_idx FROM gold JOIN documents USING (doc_id)),
ex AS (SELECT item_id AS query_id, text AS question, {_strip("concat_ws(' ', substr(text, 1, 40), text)")} AS reference, coalesce(n, 0) AS golds
  FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS n FROM g2 GROUP BY query_id) ON query_id = item_id),
cx AS (SELECT mode, query_id, list(text ORDER BY rank) AS contexts, list_sort(list(DISTINCT coalesce(source, 'unknown'))) AS sources,
  string_agg('[Passage ' || rank || ' | source: ' || coalesce(source, 'unknown') || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
  FROM ranked JOIN documents ON doc_id = chunk_id GROUP BY ALL),
se AS (SELECT mode, query_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT mode, query_id, {_SENTENCES.format("array_to_string(contexts, chr(2))")} AS l FROM cx)),
ra AS (SELECT mode, query_id, s, i, len(list_intersect(qt, {_TOK.format('s')}))::DOUBLE / nullif(len(qt), 0) AS share
  FROM se JOIN (SELECT query_id, list_distinct({_TOK.format('question')}) AS qt FROM ex) USING (query_id)),
be AS (SELECT mode, query_id, s, share FROM ra QUALIFY row_number() OVER (PARTITION BY mode, query_id ORDER BY share DESC NULLS LAST, i) = 1),
runs AS (SELECT mode, query_id, query_id::VARCHAR AS id, contexts, sources, context, question, reference, golds, CASE WHEN share >= 0.5 THEN trim(s) ELSE 'insufficient context' END AS answer
  FROM cx JOIN be USING (mode, query_id) JOIN ex USING (query_id))"""


def _set(x):
    return f"list_distinct({_TOK.format(x)})"


def _held(text):
    one = f"CASE WHEN len({_set('x')}) > 0 AND len(list_intersect({_set('x')}, seen))::DOUBLE / len({_set('x')}) >= 0.5 THEN 1 ELSE 0 END"
    told = f"list_transform(list_filter({_SENTENCES.format(text)}, lambda x: x <> ''), lambda x: {one})"
    return f"coalesce(list_sum({told})::DOUBLE / nullif(len({told}), 0), 0)"


_FACTS = f"""{_RUNS},
facts AS (SELECT mode, id, golds > 0 AS answerable, starts_with(lower({_strip('answer')}), 'insufficient context') AS refused, answer,
  CASE WHEN golds > 0 THEN EXISTS (SELECT 1 FROM g2 WHERE g2.query_id = runs.query_id AND list_contains(sources, g2.source)) END AS file_hit,
  CASE WHEN golds > 0 THEN contains({_NORM.format("array_to_string(contexts, ' ')")}, {_NORM.format('question')}) END AS passage_hit,
  (SELECT string_agg(source, ' | ' ORDER BY gold_idx) FROM g2 WHERE g2.query_id = runs.query_id) AS gold_source FROM runs)"""
_SCORES = f"""{_FACTS},
sets AS (SELECT *, {_set("array_to_string(contexts, ' ')")} AS seen, {_set('reference')} AS wanted, {_set('question')} AS asked, {_set('answer')} AS told FROM runs WHERE golds > 0),
rel AS (SELECT *, list_transform(contexts, lambda c: CASE WHEN len(list_intersect(wanted, {_TOK.format('c')}))::DOUBLE / len(wanted) >= 0.5 THEN 1 ELSE 0 END) AS r FROM sets),
scores AS (SELECT mode, id, query_id, golds, {_held('answer')} AS faithfulness,
  len(list_intersect(asked, told))::DOUBLE / nullif(len(list_distinct(list_concat(asked, told))), 0) AS answer_relevancy,
  coalesce(list_sum(list_transform(range(1, len(r) + 1), lambda i: r[i] * list_sum(r[1:i])::DOUBLE / i)) / nullif(list_sum(r), 0), 0) AS context_precision,
  {_held('reference')} AS context_recall FROM rel)"""
_FLAWED = f"""{_GOLD},
bx AS (SELECT item_id, item_id % 7 AS kind, text, EXISTS (SELECT 1 FROM gold g WHERE g.item_id = b.item_id) AS known FROM benchmark b),
fl AS (SELECT CASE WHEN kind <> 6 THEN item_id::VARCHAR END AS id, kind, text, known, CASE WHEN kind = 2 THEN 'odd' WHEN known THEN 'simple' ELSE 'unanswerable' END AS query_type,
  CASE WHEN kind = 1 THEN ' ' ELSE text END AS question, CASE WHEN kind = 3 THEN ' ' WHEN known THEN substr(text, 1, 40) ELSE 'insufficient context' END AS answer,
  CASE WHEN kind = 5 THEN ' ' WHEN known THEN text ELSE '' END AS passage, item_id FROM bx),
gs AS (SELECT item_id, source, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS nth FROM gold JOIN documents USING (doc_id)),
ff AS (SELECT fl.*, CASE WHEN kind = 4 THEN 'nowhere' ELSE coalesce((SELECT source FROM gs WHERE gs.item_id = fl.item_id AND nth = 1), '') END AS file FROM fl),
gg AS (SELECT id, answer, passage, file FROM ff WHERE query_type <> 'unanswerable'
  UNION ALL SELECT id, CASE WHEN known THEN substr(text, 1, 40) ELSE 'insufficient context' END, text, source FROM ff JOIN gs USING (item_id) WHERE nth > 1 AND query_type <> 'unanswerable')"""
_J = """
j AS (SELECT ['dense_only', 'sparse_only', 'hybrid', 'hybrid_rerank'][(doc_id % 4 + 1)::INT] AS mode, doc_id // 4 AS id, n_chars % 3 AS gold_idx, n_chars::DOUBLE AS latency_ms,
  quality * 0.5::DOUBLE + n_chars % 7 / 14.0::DOUBLE AS faithfulness, n_chars % 11 / 11.0::DOUBLE AS answer_relevancy, 1.0::DOUBLE - toxic * 0.5::DOUBLE AS context_precision, n_chars % 5 / 5.0::DOUBLE AS context_recall,
  quality = 1 AS passage_hit, quality = 1 AS file_hit, coalesce(toxic, 0) = 1 AS refused, n_chars % 20 + 1 AS words, repeat('word ', (n_chars % 20 + 1)::INT) AS answer, quality IS NOT NULL AS answerable
  FROM documents LEFT JOIN labels USING (doc_id)),
modes AS (SELECT unnest(['dense_only', 'sparse_only', 'hybrid', 'hybrid_rerank']) AS mode)"""
_DIAG = """CASE WHEN passage_hit IS NULL OR faithfulness IS NULL THEN 'unknown' WHEN NOT passage_hit AND refused THEN 'retrieval miss' WHEN NOT passage_hit THEN 'adjudicate'
  WHEN faithfulness < 0.5 AND words <= 12 THEN 'suspected judge artifact' WHEN faithfulness < 0.5 THEN 'grounding failure' ELSE 'ok' END"""
_METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
_WORDS = rf"len(list_filter(regexp_split_to_array(text, '{BLANKS}'), lambda x: x <> ''))"
_CHUNKS = """
w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS w FROM documents),
ch AS (SELECT doc_id, lang, pos, array_to_string(w[pos * 150 + 1 : pos * 150 + 200], ' ') AS text FROM (SELECT doc_id, lang, w, unnest(range(0, greatest(ceil((len(w) - 50) / 150.0)::BIGINT - 1, 0) + 1)) AS pos FROM w WHERE len(w) > 0))"""
_means = ", ".join(f"round_even(avg({m}), 4) AS {m}" for m in _METRICS)
_names = ", ".join(_METRICS)


def _n_tokens(x):
    return rf"len(regexp_extract_all({x}, '\p{{L}}+|\p{{N}}+|[^\s\v\x{{85}}\p{{Z}}\p{{L}}\p{{N}}]'))"


def _split(source, separators, size=512, overlap=50):
    """CTEs that end in cut(id, e, text): the chunks of source (id, text) in the order of e.

    Pieces that are too long are cut before the next separator, level by level. Of the pieces' running sums c, a chunk
    takes pieces b to e: e is the last with c[e] - c[b] within size, and the next b the first that leaves at most
    overlap tokens and room for the piece after e.
    """
    parts = "[text]"
    for sep in separators:
        quoted = "'" + sep.replace("\n", "' || chr(10) || '") + "'"
        opened = f"list_filter(list_transform(string_split(x, {quoted}), lambda s, i: CASE WHEN i = 1 THEN s ELSE {quoted} || s END), lambda s: s <> '')"
        parts = f"flatten(list_transform({parts}, lambda x: CASE WHEN {_n_tokens('x')} > {size} AND contains(x, {quoted}) THEN {opened} ELSE [x] END))"
    return f"""parts AS (SELECT id, {parts} AS parts FROM {source}),
n AS (SELECT id, parts, list_transform(parts, lambda x: {_n_tokens('x')}) AS n FROM parts),
c AS (SELECT id, parts, len(n) AS many, list_prepend(0, list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i])::BIGINT)) AS c FROM n),
walk AS (SELECT id, 0 AS b, greatest(1, len(list_filter(c, lambda x: x <= {size})) - 1) AS e FROM c
  UNION ALL SELECT id, b, greatest(b + 1, len(list_filter(c, lambda x: x <= c[b + 1] + {size})) - 1) FROM
  (SELECT id, c, least(greatest(len(list_filter(c, lambda x: x < greatest(c[e + 1] - {overlap}, c[e + 2] - {size}))), b), e) AS b FROM walk JOIN c USING (id) WHERE e < many)),
cut AS (SELECT id, e, {_strip("array_to_string(parts[b + 1:e], '')")} AS text FROM walk JOIN c USING (id))"""


_SPLIT_DOCS = f"""WITH RECURSIVE source AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {_split('source', SEPARATORS)},
ch AS (SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY e)::INT - 1 AS pos, text FROM cut WHERE text <> '' AND {_n_tokens('text')} >= 100)"""

_SPLIT_PAGES = f"""WITH RECURSIVE body AS (SELECT page_id AS id, page_id::VARCHAR AS name, {_strip(f"regexp_replace(text, '{BLANKS}', ' ', 'g')")} AS text FROM ({_PAGES})),
sized AS (SELECT id, text, {_n_tokens('text')} <= 512 - {_n_tokens('name')} - 2 AS fits FROM body), source AS (SELECT id, text FROM sized WHERE NOT fits), {_split('source', SENTENCE_SEPARATORS)},
named AS (SELECT id, e, id::VARCHAR || chr(10) || chr(10) || text AS text FROM (SELECT * FROM cut UNION ALL SELECT id, 0, text FROM sized WHERE fits) WHERE text <> ''),
ch AS (SELECT id AS source, row_number() OVER (PARTITION BY id ORDER BY e)::INT - 1 AS pos, text FROM named WHERE {_n_tokens('text')} >= 10)"""


ORACLE = {
    "html_clean": _PAGES,
    "page_texts": _PAGES,
    "html_flat": f"SELECT page_id, {_HTML_FLAT} AS text FROM pages",
    "tokenize": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY term",
    "norm_text": f"SELECT doc_id, md5({_NORM.format('text')}) AS norm_md5, length({_NORM_BLANKS.format('text')})::BIGINT AS n FROM documents",
    "doc_stats": f"SELECT doc_id AS chunk_id, coalesce(len({_TOK.format('text')}), 0)::BIGINT AS dl FROM documents",
    "term_stats": f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_top20": f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM bm",
    "l2_top20": f"WITH {_DENSE} SELECT query_id, chunk_id, distance, rank FROM de",
    "rrf_fusion": f"WITH {_RRF} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hy",
    "rerank_top5": f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM {_rerank('bm')}",
    "mode_topn_ablation": f"WITH {_ALL} SELECT mode, count(*) AS rows, count(DISTINCT query_id) AS questions, count(DISTINCT chunk_id) AS chunks, max(rank) AS cut FROM ranked GROUP BY mode",
    "context_block": f"WITH {_BM25} SELECT query_id, string_agg('[Passage ' || rank || ' | source: ' || coalesce(source, 'unknown') || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 5 GROUP BY query_id",
    "sources_set": f"WITH {_BM25} SELECT query_id, string_agg(DISTINCT coalesce(source, 'unknown'), ',' ORDER BY coalesce(source, 'unknown')) AS sources FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 5 GROUP BY query_id",
    "gold_expand": f"WITH {_GOLD} SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1 AS gold_idx FROM gold",
    "answerable_split": f"WITH {_GOLD} SELECT kind, count(*) AS n FROM (SELECT b.item_id, CASE count(doc_id) WHEN 0 THEN 'unanswerable' WHEN 1 THEN 'single' ELSE 'multi' END AS kind FROM benchmark b LEFT JOIN gold USING (item_id) GROUP BY b.item_id) GROUP BY kind",
    "answers": f"""WITH {_RUNS} SELECT query_id, answer, array_to_string(sources, ',') AS sources, {len(SYSTEM) + len(_PROMPT)} + length(context) + length(question) AS prompt_chars
  FROM runs WHERE mode = 'hybrid_rerank'""",
    "judge_input": f"""WITH {_RUNS} SELECT mode, id, gold_idx, md5(reference) AS reference_md5, md5(answer) AS response_md5, len(contexts) AS contexts FROM runs JOIN g2 USING (query_id)""",
    "judged_runs": f"WITH {_SCORES} SELECT mode, id, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM scores",
    "run_facts": f"WITH {_FACTS} SELECT mode, id, answerable, refused, file_hit, passage_hit, gold_source FROM facts",
    "call_budget": f"WITH {_RUNS} SELECT count(*) * (3 + max(len(contexts))) AS strong, count(*) AS light FROM runs WHERE golds > 0",
    "right_file": f"WITH {_FACTS} SELECT mode, string_agg(id, ',' ORDER BY id) AS ids FROM facts WHERE file_hit AND NOT passage_hit GROUP BY mode",
    "diagnosed_runs": f"""WITH {_SCORES}, dg AS (SELECT mode, {_WORDS.replace('text', 'answer')} AS words, passage_hit, refused, faithfulness FROM scores JOIN facts USING (mode, id))
SELECT mode, {_DIAG} AS diagnosis, count(*) AS n FROM dg GROUP BY ALL""",
    "rescored": f"""WITH {_SCORES}, ch AS (SELECT mode, id, round(context_precision - 0.25, 6) AS context_precision, round(context_recall - 0.25, 6) AS context_recall FROM scores WHERE golds > 1)
SELECT * FROM ch WHERE abs(context_precision) > 1e-9 OR abs(context_recall) > 1e-9""",
    "side_by_side": f"""WITH {_RRF}, hr AS {_rerank('hy')} SELECT query_id, 'dense' AS list, rank, chunk_id FROM de WHERE rank <= 3 UNION ALL SELECT query_id, 'sparse', rank, chunk_id FROM bm WHERE rank <= 3
  UNION ALL SELECT query_id, 'hybrid', rank, chunk_id FROM hy WHERE rank <= 3 UNION ALL SELECT query_id, 'reranked', rank, chunk_id FROM hr""",
    "eval_violations": f"""WITH {_FLAWED}, wh AS (SELECT source AS file, {_NORM_BLANKS.format("string_agg(text, ' ' ORDER BY doc_id)")} AS whole FROM documents GROUP BY source)
SELECT id, problem, count(*) AS n FROM (
  SELECT id, 'missing id' AS problem FROM ff WHERE id IS NULL
  UNION ALL SELECT id, 'unknown type' FROM ff WHERE query_type = 'odd' UNION ALL SELECT id, 'blank question' FROM ff WHERE kind = 1
  UNION ALL SELECT id, 'answer of an unanswerable question' FROM ff WHERE query_type = 'unanswerable' AND answer <> 'insufficient context'
  UNION ALL SELECT id, 'source of an unanswerable question' FROM ff WHERE query_type = 'unanswerable' AND (passage <> '' OR file <> '')
  UNION ALL SELECT id, 'blank answer' FROM gg WHERE trim(answer) = '' UNION ALL SELECT id, 'blank passage' FROM gg WHERE trim(passage) = ''
  UNION ALL SELECT id, 'file not in corpus' FROM gg WHERE file NOT IN (SELECT file FROM wh)
  UNION ALL SELECT id, 'passage not in file' FROM gg JOIN wh USING (file) WHERE trim(passage) <> '' AND NOT contains(whole, {_NORM_BLANKS.format('passage')}))
GROUP BY ALL""",
    "type_targets": f"""WITH {_FLAWED}, tt AS (SELECT unnest(['simple', 'keyword_heavy', 'paraphrase_heavy', 'unanswerable']) AS query_type, unnest([20, 10, 10, 10]) AS low, unnest([25, 10, 10, 10]) AS high)
SELECT query_type, low, high, coalesce(n, 0) AS n, coalesce(n, 0) BETWEEN low AND high AS ok FROM tt LEFT JOIN (SELECT query_type, count(*) AS n FROM fl GROUP BY query_type) USING (query_type)""",
    "hit_rates": f"""WITH {_ALL},{_GOLD},
h AS (SELECT mode, query_id, max(CASE WHEN EXISTS (SELECT 1 FROM gold g JOIN documents x USING (doc_id) WHERE g.item_id = query_id AND x.source = d.source) THEN 1 ELSE 0 END) AS f,
  max(CASE WHEN EXISTS (SELECT 1 FROM gold g WHERE g.item_id = query_id AND g.doc_id = chunk_id) THEN 1 ELSE 0 END) AS p FROM ranked JOIN documents d ON d.doc_id = chunk_id GROUP BY ALL)
SELECT mode, round(avg(f) FILTER (a), 6) AS file_hit, round(avg(p) FILTER (a), 6) AS passage_hit, count(*) FILTER (a) AS n FROM (SELECT *, query_id IN (SELECT item_id FROM gold) AS a FROM h) GROUP BY mode""",
    "refusal_rate": f"SELECT role, count(*) AS n, count(*) FILTER (starts_with(lower({_strip('text')}), 'insufficient context')) AS refused, round(avg({_WORDS}), 6) AS words, count(*) FILTER ({_WORDS} <= 12) AS terse FROM conversations GROUP BY role",
    "turn_pairs": f"""SELECT conv_id, turn, md5({_strip("concat_ws(' ', text, answer)")}) AS reference_md5 FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""",
    "percentile_latency": "SELECT source, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, count(*) AS n FROM documents GROUP BY source",
    "ablation_table": f"""WITH {_J} SELECT mode, {_means}, round_even(avg(refused::INT) FILTER (NOT answerable), 4) AS refusal_rate_unanswerable, round_even(coalesce(quantile_cont(latency_ms, 0.5), 0), 0) AS latency_p50_ms, round_even(coalesce(quantile_cont(latency_ms, 0.95), 0), 0) AS latency_p95_ms,
  count(*) FILTER (answerable) AS n_answerable, count(*) FILTER (NOT answerable) AS n_unanswerable FROM modes JOIN j USING (mode) GROUP BY mode""",
    "collapse_multi_ref": f"WITH {_J} SELECT mode, id // 3 AS id, round(max(context_precision), 6) AS context_precision, round(max(context_recall), 6) AS context_recall FROM j GROUP BY ALL",
    "poison_guard": f"WITH {_J} SELECT {', '.join(f'count(*) FILTER ({m} IS NULL) AS {m}' for m in _METRICS)} FROM j",
    "diagnosis_hist": f"WITH {_J} SELECT mode, {_DIAG} AS diagnosis, count(*) AS n FROM j GROUP BY ALL",
    "failure_rows": f"WITH {_J} SELECT * FROM (SELECT mode, id, {_DIAG} AS diagnosis, substr(answer, 1, 200) AS answer FROM j) WHERE diagnosis <> 'ok'",
    "abstention": f"WITH {_J} SELECT mode, sum(refused::INT)::BIGINT AS refused, count(*) AS n FROM modes LEFT JOIN j USING (mode) WHERE NOT answerable GROUP BY mode",
    "worst_n": f"WITH {_J} SELECT mode, id, round(list_sum(l) / len(l), 6) AS mean FROM (SELECT mode, id, list_filter([{_names}], lambda x: x IS NOT NULL) AS l FROM j) ORDER BY mean, mode, id LIMIT 8",
    "rerank_delta": f"""WITH {_J}, d AS (SELECT id, {', '.join(f'round(b.{m} - a.{m}, 6) AS {m}' for m in _METRICS)}, coalesce(b.passage_hit AND NOT a.passage_hit, false) AS gained, coalesce(a.passage_hit AND NOT b.passage_hit, false) AS lost
  FROM (SELECT * FROM j WHERE mode = 'hybrid') a FULL JOIN (SELECT * FROM j WHERE mode = 'hybrid_rerank') b USING (id))
SELECT * FROM d WHERE gained OR lost OR {' OR '.join(f'coalesce(abs({m}) > 0.01, false)' for m in _METRICS)}""",
    "summary_grid": f"""WITH {_J} SELECT mode, {_means}, round_even(avg(file_hit::INT), 3) AS file_hit, round_even(avg(passage_hit::INT), 3) AS passage_hit, sum(refused::INT) FILTER (NOT answerable)::BIGINT AS refused, count(*) FILTER (NOT answerable) AS n FROM j GROUP BY mode""",
    "eval_validate": f"""SELECT doc_id, problem FROM (SELECT doc_id, unnest(list_filter([CASE WHEN b = '' THEN 'blank' END, CASE WHEN first <> doc_id THEN 'repeated' END, CASE WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'unknown language' END, CASE WHEN n_chars <> length(text) THEN 'length' END], lambda x: x IS NOT NULL)) AS problem
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY b) AS first FROM (SELECT *, {_NORM_BLANKS.format('text')} AS b FROM documents)))""",
    "type_counts": "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang",
    "window_chunks": f"WITH {_CHUNKS} SELECT doc_id, pos, md5(text) AS text_md5 FROM ch",
    "midsentence_ratio": rf"WITH {_CHUNKS} SELECT lang, round(avg(regexp_matches(ltrim(text), '^\p{{Ll}}')::INT), 6) AS ratio, count(*) AS n FROM ch GROUP BY lang",
    "chunk_documents": f"{_SPLIT_DOCS} SELECT doc_id, pos, doc_id || '::' || pos AS chunk_id, text FROM ch",
    "chunk_stats": f"{_SPLIT_DOCS} SELECT doc_id, count(*) AS chunks, min({_n_tokens('text')})::INT AS least, max({_n_tokens('text')})::INT AS most, round(avg({_n_tokens('text')}), 6) AS mean FROM ch GROUP BY doc_id",
    "section_chunks": f"{_SPLIT_PAGES} SELECT source, source || '::' || pos AS chunk_id, pos, 'page' AS kind, '' AS member, text FROM ch",
    "top_sources": "SELECT source, count(*) AS chunks FROM documents GROUP BY source ORDER BY chunks DESC, source LIMIT 5",
    "anti_join_worklist": "SELECT mode, doc_id AS id FROM documents, (SELECT unnest(['dense_only', 'sparse_only', 'hybrid', 'hybrid_rerank']) AS mode) m WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND ['dense_only', 'sparse_only', 'hybrid', 'hybrid_rerank'][(l.doc_id % 4 + 1)::INT] = mode)",
    "token_batches": r"""WITH RECURSIVE t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i,
  len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\v\x{85}\p{Z}\p{L}\p{N}]')) AS n FROM documents),
r AS (SELECT source, doc_id, i, n, n AS held, 0 AS batch FROM t WHERE i = 1
  UNION ALL SELECT t.source, t.doc_id, t.i, t.n, CASE WHEN r.held > 0 AND r.held + t.n > 25000 THEN t.n ELSE r.held + t.n END,
    r.batch + CASE WHEN r.held > 0 AND r.held + t.n > 25000 THEN 1 ELSE 0 END FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source AND t.i = r.i + 1)
SELECT source, batch, sum(n)::BIGINT AS tokens, count(*) AS rows, min(doc_id) AS first FROM r GROUP BY source, batch""",
    "avg_precision": """SELECT source, round(coalesce(sum(p * quality) / nullif(sum(quality), 0), 0), 6) AS ap FROM (SELECT source, quality, sum(quality) OVER w::DOUBLE / row_number() OVER w AS p
  FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY source ORDER BY doc_id)) GROUP BY source""",
    "verdict_shares": "SELECT source, round(avg(quality), 6) AS faithfulness FROM documents JOIN labels USING (doc_id) GROUP BY source",
}
