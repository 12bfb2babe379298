"""SQL counterparts of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from paperlake.functions.vocab import LIFE_SCIENCE_STEMS, STOP_WORDS

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


STOP, STEMS = _list(STOP_WORDS), _list(LIFE_SCIENCE_STEMS)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def split(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def kw(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))"


TITLE = collapse("split_part(text, chr(10), 1)")
ABSTRACT = "CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END"

DOCS = f"""docs AS MATERIALIZED (
  SELECT doc_id AS paper_id, {TITLE} AS title, {ABSTRACT} AS abstract FROM documents)"""

RUNS = """runs AS (
  SELECT item_id AS run_id, text AS prompt, 100 + item_id % 3 * 100 AS max_papers,
         greatest((100 + item_id % 3 * 100) // 3, 50) AS budget, item_id % 4 = 3 AS no_preprint
  FROM benchmark)"""

QUERIES = f"""{RUNS},
words AS (
  SELECT run_id, list_filter({split('prompt')}, lambda w: length(w) > 3)[1:6] AS w FROM runs),
q AS MATERIALIZED (
  SELECT run_id, query_no, query, {kw('query')} AS k
  FROM (SELECT run_id, unnest([0, 1, 2]) AS query_no,
          unnest([array_to_string(w[1:4], ' '), array_to_string(w[1:3], ' ') || ' recent',
                  array_to_string(w[2:5], ' ')]) AS query FROM words))"""

TOKENED = f"""{DOCS},
tok AS MATERIALIZED (
  SELECT paper_id, list_distinct({tokens('title')}) AS t, list_distinct({tokens('abstract')}) AS a,
         list_distinct({tokens("title || ' ' || abstract")}) AS e FROM docs)"""

HITS = f"""{QUERIES}, {TOKENED},
hits AS MATERIALIZED (
  SELECT run_id, query_no, 1 AS strategy_no, paper_id, len(k[1:5])::INT AS matched
  FROM q JOIN tok ON list_has_all(e, k[1:5]) WHERE len(k) > 0
  UNION ALL SELECT run_id, query_no, 2, paper_id, 3
  FROM q JOIN tok ON list_has_all(e, k[1:3]) WHERE len(k) >= 3
  UNION ALL SELECT run_id, query_no, 3, paper_id,
    len(list_filter(k[1:6], lambda x: list_contains(a, x)))::INT
  FROM q JOIN tok ON list_has_any(a, k[1:6]) WHERE len(k) > 0
  UNION ALL SELECT run_id, query_no, 4, paper_id, len(k[1:3])::INT
  FROM q JOIN tok ON list_has_all(t, k[1:3]) WHERE len(k) > 0)"""

SEARCH = f"""{HITS},
phrase AS (
  SELECT run_id, query_no, 5 AS strategy_no, paper_id, 1 AS matched
  FROM q JOIN docs ON contains(lower(title), {strip('lower(query)')}) OR contains(lower(abstract), {strip('lower(query)')})
  WHERE len(k) = 0 AND {strip('query')} <> ''),
bounded AS (
  SELECT * FROM (
    SELECT h.*, budget, row_number() OVER (PARTITION BY h.run_id, query_no, strategy_no
                                   ORDER BY matched DESC, paper_id) AS position
    FROM (SELECT * FROM hits UNION ALL SELECT * FROM phrase) h JOIN runs USING (run_id))
  WHERE position <= ceil(budget / least(budget, 100)) * least(budget, 100)),
per_query AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, query_no ORDER BY strategy_no, position) AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id, query_no, paper_id
                                       ORDER BY strategy_no, position) AS seen FROM bounded)
    WHERE seen = 1)
  WHERE place <= budget),
first_union AS (
  SELECT run_id, paper_id, 1 AS source_no, query_no, strategy_no AS step_no, position FROM per_query)"""


def finish(union: str, titles: str) -> str:
    return f"""unique_titles AS (
  SELECT * FROM (
    SELECT u.*, row_number() OVER (
        PARTITION BY run_id, {strip('lower(title)')}
        ORDER BY source_no, query_no, step_no, position, paper_id) AS rn
    FROM {union} u JOIN {titles} USING (paper_id) WHERE {strip('lower(title)')} <> '')
  WHERE rn = 1),
selected AS (
  SELECT * FROM (
    SELECT u.*, max_papers, row_number() OVER (
        PARTITION BY u.run_id ORDER BY source_no, query_no, step_no, position, paper_id)::INT AS paper_no
    FROM unique_titles u JOIN runs USING (run_id))
  WHERE paper_no <= max_papers)"""


PREPRINTS = f"""pre AS MATERIALIZED (
  SELECT page_id + 1000000000000 AS paper_id,
    {collapse("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
    {collapse("regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g')")} AS abstract,
    DATE '2024-06-30' - (page_id * 7 % 200)::INT AS published,
    (page_id % 2)::INT AS server_no, page_id AS feed_pos
  FROM pages),
run_days AS (SELECT item_id AS run_id, RUN_DAY AS as_of FROM benchmark),
windowed AS (
  SELECT pre.*, as_of, window_no, row_number() OVER (PARTITION BY as_of, server_no, window_no ORDER BY feed_pos) AS n
  FROM (SELECT DISTINCT as_of FROM run_days) d, pre
  JOIN (VALUES (0, 30, 0), (1, 90, 30), (2, 180, 90)) w(window_no, old, new)
    ON published BETWEEN d.as_of - old AND d.as_of - new)"""

ONE_DAY, OWN_DAY = "DATE '2024-06-30'", "DATE '2024-06-30' - (item_id % 5 * 20)::INT"

SECOND = f"""{PREPRINTS},
once AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY as_of, paper_id ORDER BY server_no, window_no, feed_pos) AS r
    FROM windowed) WHERE r = 1),
wanted AS MATERIALIZED (
  SELECT run_id, budget, CASE WHEN len({kw('prompt')}) > 0 THEN {kw('prompt')}
    ELSE list_transform(list_filter({split('prompt')}, lambda w: length(w) > 2), lambda w: lower(w)) END AS k
  , as_of FROM runs JOIN run_days USING (run_id) WHERE NOT no_preprint),
second_union AS (
  SELECT run_id, paper_id, server_no + 2 AS source_no, 0 AS query_no, window_no AS step_no, position FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY server_no, window_no, feed_pos) AS position
    FROM wanted JOIN once
      ON wanted.as_of = once.as_of
      AND (len(k) = 0 OR len(list_filter(k, lambda w: contains(lower(title || ' ' || abstract), w))) >= 1))
  WHERE position <= budget)"""

DAY = "(DATE '2020-01-01' + (n_chars % 1000)::INT)"
DOI = "CASE WHEN doc_id % 3 = 0 THEN '' ELSE '10.5555/' || doc_id END"

FULL = f"""full_docs AS MATERIALIZED (
  SELECT *, CASE WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE '' END AS url,
    CASE WHEN doi <> '' THEN 'https://www.' || lower(server) || '.org/content/' || doi || 'v1.full.pdf' ELSE '' END AS pdf_url
  FROM (SELECT doc_id AS paper_id, {TITLE} AS title, {ABSTRACT} AS abstract, source AS src, lang,
    'Author ' || source || ', ' || lang AS authors, {DAY} AS day, {DOI} AS doi,
    CASE WHEN doc_id % 2 = 0 THEN 'bioRxiv' ELSE 'medRxiv' END AS server
  FROM documents))"""

INSTRUCTION = """'Turn the paper at the end of this message into records.' || chr(10)
  || 'Reply with one JSON array and nothing around it. Each record is an object with the keys listed under Keys, '
  || 'spelled as they are there; a key whose value the paper leaves open gets null. A paper without any record gets [].'"""

BLOCK = """'TITLE: ' || title || chr(10) || 'AUTHORS: ' || authors || chr(10) || 'DATE: ' || day::VARCHAR
  || chr(10) || 'DOI: ' || doi || chr(10) || 'CATEGORY: ' || lang || chr(10) || 'ABSTRACT: ' || abstract"""


def greedy(n_query: str, near_query: str, id_name: str) -> str:
    """Greedy removal by walking the rows in order; ``near_query`` gives (i, j) with i < j."""
    return f"""near AS MATERIALIZED ({near_query}),
lists AS (SELECT j, list(i) AS ns FROM near GROUP BY j),
rows_in_order AS MATERIALIZED (
  SELECT id, row_number() OVER (ORDER BY id) AS rn, coalesce(ns, []) AS ns
  FROM ({n_query}) LEFT JOIN lists ON j = id),
walk AS (
  SELECT 0::BIGINT AS rn, []::BIGINT[] AS kept
  UNION ALL
  SELECT walk.rn + 1, CASE WHEN list_has_any(walk.kept, r.ns) THEN walk.kept
                           ELSE list_append(walk.kept, r.id) END
  FROM walk JOIN rows_in_order r ON r.rn = walk.rn + 1)
SELECT unnest(kept) AS {id_name} FROM (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1)"""


NEAR_VECTORS = """SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3"""


def near_texts(run: str, text: str) -> str:
    """Pairs of documents whose hashed word counts have a cosine above 0.92."""
    return f"""counts AS MATERIALIZED (
  SELECT run_id, id, bucket, count(*)::DOUBLE AS n FROM (
    SELECT run_id, id, ('0x' || substr(md5(w), 1, 4))::BIGINT % 512 AS bucket
    FROM (SELECT {run} AS run_id, paper_id AS id, unnest({split(f'lower({text})')}) AS w FROM full_docs))
  GROUP BY ALL),
norms AS MATERIALIZED (SELECT run_id, id, sqrt(sum(n * n)) AS norm FROM counts GROUP BY ALL),
near AS MATERIALIZED (
  SELECT run_id, i, j FROM (
    SELECT a.run_id, a.id AS i, b.id AS j, sum(a.n * b.n) AS dot
    FROM counts a JOIN counts b ON a.run_id = b.run_id AND a.bucket = b.bucket AND a.id < b.id
    GROUP BY ALL)
  JOIN norms x ON x.run_id = p.run_id AND x.id = i JOIN norms y ON y.run_id = p.run_id AND y.id = j
  WHERE dot / (x.norm * y.norm) > 0.92)""".replace("    GROUP BY ALL)\n  JOIN", "    GROUP BY ALL) p\n  JOIN").replace(
        "SELECT run_id, i, j FROM (\n    SELECT a.run_id", "SELECT p.run_id, i, j FROM (\n    SELECT a.run_id")


def expected_records(kinds: str) -> str:
    return kinds


EVENT = """ev AS (SELECT event_id AS paper_id, event_type, value::VARCHAR AS v, props, user_id,
  strftime(ts, '%Y-%m-%d') AS day FROM events),
objects AS (
  SELECT paper_id, 0 AS element_no,
    ['title', 'Event-Type', 'value', 'props', 'tags', 'url', 'source'] AS ks,
    [NULL, event_type, v, replace(props, ': ', ':'), '["a",null,3]', '0', 'given'] AS vs
  FROM ev WHERE paper_id % 6 IN (0, 1) AND paper_id % 7 <> 0 AND paper_id % 9 <> 4
  UNION ALL SELECT paper_id, 1, ['title'], ['u'] FROM ev WHERE paper_id % 6 = 1 AND paper_id % 7 <> 0
    AND paper_id % 9 <> 4)"""

EVERY_EVENT = EVENT.replace("AND paper_id % 9 <> 4", "")

LABELLED = """lab AS (
  SELECT regexp_extract(source, '[0-9]+')::BIGINT AS run_id, lang, quality, toxic
  FROM documents LEFT JOIN labels USING (doc_id)),
att AS (
  SELECT run_id, attempt, CASE WHEN run_id % 2 = 0 THEN 3 ELSE 2 END AS n_fields,
    (CASE WHEN quality <> 0 AND attempt >= 1 THEN 1 ELSE 0 END) AS hit,
    (CASE WHEN quality <> 0 AND attempt >= 1 THEN 1 ELSE 0 END)
    + (CASE WHEN toxic <> 0 THEN 1 ELSE 0 END)
    + (CASE WHEN run_id % 2 = 0 AND attempt = 2 AND lang <> '' THEN 1 ELSE 0 END) AS filled
  FROM lab, (VALUES (0), (1), (2)) t(attempt)),
tally AS (
  SELECT run_id, attempt, count(*) AS n, sum(filled) / sum(n_fields) AS cov, sum(hit) AS hits
  FROM att GROUP BY ALL),
marks AS (
  SELECT *, hits / n AS prim, round((CASE WHEN cov < 0.3 THEN 0.5 ELSE 1.0 END)::DOUBLE
    * (CASE WHEN hits / n < 0.4 THEN 0.7 ELSE 1.0 END)::DOUBLE, 2) AS score FROM tally),
chosen AS (
  SELECT run_id, coalesce(min(attempt) FILTER (score >= 0.5), max(attempt)) AS attempt FROM marks GROUP BY 1)"""

PARTS = """parts AS (
  SELECT regexp_extract(p_brand, '[0-9]+')::BIGINT AS run_id, p_partkey AS paper_no, p_name AS title,
    CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS part_size, p_brand AS authors,
    ' "q", é ' || p_type AS a_key_longer_than_twenty_six FROM part)"""

FEED_COLUMNS = """paper_id, title, {abstract} AS abstract, {authors} AS authors, {categories} AS categories,
  day AS published, {doi} AS doi, {pdf} AS pdf_url"""


def feed(rows: str) -> str:
    return f"""WITH {FULL} SELECT 'http://a.b/' || paper_id AS paper_id, title,
  {collapse('abstract')} AS abstract, authors, lang || ', x.Y' AS categories, day AS published,
  CASE WHEN url <> '' THEN url ELSE 'http://a.b/' || paper_id END AS doi,
  'http://a.b/p/' || paper_id AS pdf_url
FROM full_docs WHERE title <> '' AND {rows}"""


ORACLES: dict[str, str] = {
    "keywords": f"""SELECT item_id, unnest(range(len(k)))::INT AS pos, unnest(k) AS kw
FROM (SELECT item_id, {kw('text')} AS k FROM benchmark)""",
    "query_expansion": f"WITH {QUERIES} SELECT run_id AS item_id, query_no, query FROM q",
    "topic_flag": f"""SELECT lang,
  len(list_filter({STEMS}, lambda s: contains(lower(text), s))) > 0 AS life_science, count(*) AS n_docs
FROM documents GROUP BY ALL""",
    "document_keywords": f"""SELECT kw, count(*) AS n FROM (SELECT unnest({kw('text')}) AS kw FROM documents)
GROUP BY kw""",
    "filter_words": f"""WITH {DOCS}
SELECT paper_id, unnest(range(len(w)))::INT AS pos, unnest(w) AS word FROM (
  SELECT paper_id, CASE WHEN len({kw('title')}) > 0 THEN {kw('title')} ELSE
    list_transform(list_filter({split('title')}, lambda w: length(w) > 2), lambda w: lower(w)) END AS w FROM docs)""",
    "markup_links": """WITH l AS (
  SELECT page_id, unnest(h) AS h, unnest(range(len(h))) AS i
  FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)),
k AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 'https://doi.org/10.1' || h WHEN 1 THEN h || '.pdf' ELSE h END AS href,
    i % 5 = 2 AS titled FROM l),
a AS (
  SELECT page_id, max_by(href, i) FILTER (titled OR contains(href, 'pdf')) AS pdf_url,
    max_by(href, i) FILTER (contains(href, 'doi.org')) AS doi,
    string_agg(h, ', ' ORDER BY i) FILTER (h <> '') AS authors FROM k GROUP BY page_id),
t AS (
  SELECT page_id, unnest(g) AS g, unnest(range(len(g))) AS i
  FROM (SELECT page_id, regexp_extract_all(html, '<([a-z0-9]+)', 1) AS g FROM pages)),
c AS (
  SELECT page_id, string_agg(g, ', ' ORDER BY i) AS rest
  FROM (SELECT page_id, g, min(i) AS i FROM t WHERE g <> 'p' GROUP BY ALL) GROUP BY page_id)
SELECT p.page_id, coalesce(pdf_url, '') AS pdf_url, coalesce(doi, '') AS doi,
  concat_ws(', ', 'p', rest) AS categories, coalesce(authors, '') AS authors
FROM pages p LEFT JOIN a USING (page_id) LEFT JOIN c USING (page_id)""",
    "text_block": f"""WITH {FULL} SELECT paper_id, url, {BLOCK} AS text, pdf_url, day AS published,
  doi AS doi_norm FROM full_docs""",
    "metadata_record": f"""WITH {FULL},
r AS (
  SELECT paper_id, url AS source_url, server AS source,
    unnest(['title', 'authors', 'published_date', 'doi', 'url', 'pdf_url', 'categories', 'source']) AS key,
    unnest([title, authors, day::VARCHAR, doi, url, pdf_url, lang, server]) AS value FROM full_docs)
SELECT paper_id, source_url, source, key, value FROM r WHERE value <> ''
UNION ALL SELECT paper_id, url, server, 'abstract',
  {strip("abstract || chr(10) || 'JOURNAL: ' || src")} FROM full_docs
UNION ALL SELECT paper_id, url, server, 'journal', src FROM full_docs""",
    "prompt_rendering": f"""WITH {FULL},
p AS (SELECT *, regexp_extract(src, '[0-9]+')::BIGINT AS run_id FROM full_docs)
SELECT run_id, paper_id, 1 AS attempt, {INSTRUCTION}
  || CASE WHEN run_id % 2 = 0 THEN chr(10) || 'The last reply fell short: few fields; no doi' ELSE '' END
  || chr(10) || 'Keys: title | abstract | doi' || chr(10) || '<paper>' || chr(10) || {BLOCK} || chr(10) || '</paper>' AS prompt
FROM p""",
    "prompt_window": f"""WITH {FULL}
SELECT paper_id, attempt::INT AS attempt, {INSTRUCTION} || chr(10) || 'Keys: title' || chr(10) || '<paper>' || chr(10)
  || left({BLOCK}, 300) || chr(10) || '</paper>' AS prompt
FROM full_docs, range(2) t(attempt)""",
    "match_strategies": f"WITH {HITS} SELECT run_id, query_no, paper_id, strategy_no, matched FROM hits",
    "bounded_strategies": f"""WITH {HITS},
numbered AS (SELECT h.*, least(budget, 100) AS page, budget, row_number() OVER (
    PARTITION BY h.run_id, query_no, strategy_no ORDER BY matched DESC, paper_id) AS position FROM hits h JOIN runs USING (run_id))
SELECT run_id, query_no, strategy_no, paper_id, matched FROM numbered WHERE position <= ceil(budget / page) * page""",
    "phrase_match": f"""WITH {DOCS},
l AS (SELECT item_id AS run_id, string_split(array_to_string(list_transform({split('lower(text)')},
    lambda w: CASE WHEN list_contains({STOP}, w) THEN w ELSE '|' END), ' '), '|') AS l FROM benchmark),
p AS (SELECT run_id, (unnest(range(len(l))))::INT AS query_no, trim(unnest(l)) AS phrase FROM l)
SELECT run_id, query_no, paper_id FROM p JOIN docs
  ON contains(lower(title), phrase) OR contains(lower(abstract), phrase) WHERE phrase <> ''""",
    "substring_filter": f"""WITH {RUNS}, {DOCS},
k AS (SELECT run_id, {kw('prompt')} AS k FROM runs),
d AS MATERIALIZED (SELECT paper_id, lower({strip('title')} || ' ' || {strip('abstract')}) AS txt FROM docs)
SELECT * FROM (
  SELECT run_id, paper_id, len(list_filter(k, lambda w: contains(txt, w)))::BIGINT AS matches FROM k, d)
WHERE matches >= 1""",
    "date_window_items": """SELECT o_orderkey, window_no FROM orders
JOIN (VALUES (0, 30, 0), (1, 90, 30), (2, 180, 90)) w(window_no, old, new)
  ON o_orderdate::DATE BETWEEN DATE '1998-01-15' - old AND DATE '1998-01-15' - new""",
    "ordered_union_cap": f"""WITH {SEARCH}, {finish('first_union', 'docs')}
SELECT run_id, paper_no, paper_id, query_no, step_no FROM selected""",
    "two_source_search": f"""WITH {SEARCH}, {SECOND},
both_sources AS (SELECT * FROM first_union UNION ALL SELECT * FROM second_union),
titles AS (SELECT paper_id, title FROM docs UNION ALL SELECT paper_id, title FROM pre),
{finish('both_sources', 'titles')}
SELECT run_id, paper_no, paper_id, source_no, step_no FROM selected""".replace("RUN_DAY", ONE_DAY),
    "daily_search": f"""WITH {SEARCH}, {SECOND},
both_sources AS (SELECT * FROM first_union UNION ALL SELECT * FROM second_union),
titles AS (SELECT paper_id, title FROM docs UNION ALL SELECT paper_id, title FROM pre),
{finish('both_sources', 'titles')}
SELECT run_id, paper_no, paper_id, source_no, step_no FROM selected""".replace("RUN_DAY", OWN_DAY),
    "search_counters": f"""WITH {SEARCH}, {finish('first_union', 'docs')},
n AS (SELECT run_id, source_no, query_no, step_no, count(*) AS c FROM unique_titles GROUP BY ALL)
SELECT run_id, source_no, query_no, step_no, matched, coalesce(c, 0) AS new_unique
FROM (SELECT run_id, source_no, query_no, step_no, count(*) AS matched FROM first_union GROUP BY ALL)
LEFT JOIN n USING (run_id, source_no, query_no, step_no)""",
    "window_counters": f"""WITH {PREPRINTS}
SELECT as_of, server_no, window_no, count(*) AS scanned FROM windowed GROUP BY ALL""".replace("RUN_DAY", OWN_DAY),
    "bounded_window_counters": f"""WITH {PREPRINTS}
SELECT as_of, server_no, window_no, count(*) AS scanned FROM windowed WHERE n <= 10 GROUP BY ALL""".replace("RUN_DAY", OWN_DAY),
    "run_window_counters": f"""WITH {RUNS}, {SECOND},
scanned AS (SELECT as_of, server_no, window_no, count(*) AS scanned FROM windowed GROUP BY ALL),
hit AS (
  SELECT run_id, server_no, window_no, paper_id,
    row_number() OVER (PARTITION BY run_id, paper_id ORDER BY server_no, window_no, feed_pos) AS r
  FROM wanted JOIN windowed ON wanted.as_of = windowed.as_of
    AND len(list_filter(k, lambda w: contains(lower(title || ' ' || abstract), w))) >= 1)
SELECT run_id, s.server_no, s.window_no, scanned, count(paper_id) AS matched, count(*) FILTER (r = 1) AS new
FROM wanted JOIN scanned s USING (as_of) LEFT JOIN hit USING (run_id, server_no, window_no)
WHERE len(k) > 0 GROUP BY ALL""".replace("RUN_DAY", OWN_DAY),
    "title_dedup": f"""WITH {DOCS}
SELECT min(paper_id) AS paper_id, title_key FROM (SELECT paper_id, {strip('lower(title)')} AS title_key FROM docs)
WHERE title_key <> '' GROUP BY title_key""",
    "atom_column": feed("paper_id % 10 <> 9"),
    "atom_files": feed("true"),
    "preprint_files": f"""WITH {FULL}
SELECT CASE WHEN url <> '' THEN url ELSE 'bioRxiv:' || {strip('lower(title)')} END AS paper_id, title,
  {strip('abstract')} AS abstract, authors, lang AS categories, day AS published, doi,
  CASE WHEN doi <> '' THEN 'https://www.biorxiv.org/content/' || doi || 'v'
    || CASE WHEN paper_id % 2 = 0 THEN '2' ELSE '1' END || '.full.pdf' ELSE '' END AS pdf_url
FROM full_docs""",
    "noisy_json": f"""WITH {EVERY_EVENT}
SELECT paper_id, element_no, unnest(ks) AS key, unnest(vs) AS value FROM objects""",
    "back_fill": f"""WITH {EVENT},
meta AS (
  SELECT paper_id, unnest(['title', 'authors', 'published_date', 'doi', 'url', 'pdf_url', 'categories', 'source']) AS key,
    unnest([event_type, 'user ' || user_id, day, '', 'http://e/' || paper_id, '', event_type, 'bioRxiv']) AS value
  FROM ev),
ends AS (SELECT paper_id, CASE WHEN paper_id % 7 = 0 AND paper_id % 9 <> 4 THEN 'failed' ELSE 'meta' END AS kind FROM ev
  WHERE paper_id % 7 = 0 OR paper_id % 9 = 4 OR paper_id % 6 NOT IN (0, 1)),
own AS (SELECT paper_id, element_no, unnest(ks) AS key, unnest(vs) AS value FROM objects),
rows_out AS (
  SELECT paper_id, element_no, key, value FROM own
  WHERE key NOT IN ('title', 'url', 'source') OR (value IS NOT NULL AND value <> '0')
  UNION ALL
  SELECT o.paper_id, o.element_no, m.key, m.value FROM objects o JOIN meta m USING (paper_id)
  WHERE NOT EXISTS (SELECT 1 FROM own w WHERE w.paper_id = o.paper_id AND w.element_no = o.element_no
    AND w.key = m.key AND w.value IS NOT NULL AND w.value <> '0')
  UNION ALL SELECT paper_id, 0, key, value FROM ends JOIN meta USING (paper_id) WHERE kind = 'meta' OR value <> ''
  UNION ALL SELECT paper_id, 0, 'abstract', props FROM ends JOIN ev USING (paper_id) WHERE kind = 'failed')
SELECT paper_id, element_no, key, value, 'http://e/' || paper_id AS source_url, 'bioRxiv' AS source FROM rows_out""",
    "extraction_errors": """SELECT event_id::VARCHAR AS ref, 'Extract http://e/' || event_id
  || CASE WHEN event_id % 9 = 4 THEN ': no response' ELSE ': timeout' END AS message
FROM events WHERE event_id % 7 = 0 OR event_id % 9 = 4""",
    "coverage": f"""WITH {LABELLED}
SELECT run_id, n AS n_records, round(cov, 6) AS coverage, round(prim, 6) AS primary_rate, score,
  concat_ws('; ',
    CASE WHEN cov < 0.3 THEN 'Overall field coverage low (' || printf('%.0f', cov * 100) || '%)' END,
    CASE WHEN prim < 0.4 THEN 'Primary field ''quality'' sparse (' || hits || '/' || n || ')' END) AS issues
FROM marks WHERE attempt = 2""",
    "attempt_select": f"""WITH {LABELLED}
SELECT run_id, attempt, score FROM marks JOIN chosen USING (run_id, attempt)""",
    "conditional_retries": f"""WITH {LABELLED}
SELECT run_id, m.attempt, n AS n_asked, n AS n_records, score, CASE WHEN m.attempt = c.attempt THEN n ELSE 0 END AS n_accepted
FROM marks m JOIN chosen c USING (run_id) WHERE m.attempt <= c.attempt""",
    "run_summary": f"""WITH {LABELLED},
d AS (SELECT regexp_extract(source, '[0-9]+')::BIGINT AS run_id, doc_id, quality, toxic
  FROM documents LEFT JOIN labels USING (doc_id)),
e AS (SELECT run_id, doc_id, row_number() OVER (PARTITION BY run_id ORDER BY doc_id) AS rn FROM d WHERE toxic = 1)
SELECT run_id, count(quality) AS n_records, count(*) AS n_papers, any_value(attempt) AS n_retries,
  count(*) FILTER (toxic = 1) AS n_errors,
  coalesce((SELECT string_agg('toxic ' || doc_id, '; ' ORDER BY doc_id) FROM e
            WHERE e.run_id = d.run_id AND rn <= 5), '') AS first_errors
FROM d JOIN chosen USING (run_id) GROUP BY run_id""",
    "normalise": """SELECT p_partkey, unnest(['part_name', 'type', 'size', 'note']) AS key,
  unnest(['[1] ' || p_name, p_type || ', ' || p_brand, p_size::VARCHAR, '']) AS value FROM part""",
    "exact_dedup": f"""WITH {FULL}
SELECT list_position(['de', 'en', 'es', 'fr'], lang)::BIGINT AS run_id, min(paper_id) AS paper_id
FROM full_docs GROUP BY lang, title, src""",
    "semantic_dedup": "WITH RECURSIVE " + greedy(
        "SELECT vec_id AS id FROM embeddings", NEAR_VECTORS, "vec_id"),
    "similarity_join": f"SELECT DISTINCT j AS vec_id FROM ({NEAR_VECTORS})",
    "text_semantic_dedup": "WITH RECURSIVE " + FULL + ", " + near_texts(
        "0", "title || ' ' || abstract || ' ' || lang") + ", " + greedy(
        "SELECT paper_id AS id FROM full_docs", "SELECT i, j FROM near", "paper_id").replace(
        "near AS MATERIALIZED (SELECT i, j FROM near),\n", ""),
    "label_dedup": "WITH RECURSIVE " + FULL + ", " + near_texts(
        "regexp_extract(src, '[0-9]+')::BIGINT", "title || ' ' || lang || ' ' || src") + ", " + greedy(
        "SELECT paper_id AS id FROM full_docs", "SELECT i, j FROM near", "paper_id").replace(
        "near AS MATERIALIZED (SELECT i, j FROM near),\n", "").replace(
        "SELECT unnest(kept) AS paper_id FROM (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1)",
        "SELECT regexp_extract(src, '[0-9]+')::BIGINT AS run_id, paper_id FROM full_docs JOIN "
        "(SELECT unnest(kept) AS paper_id FROM (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1)) "
        "USING (paper_id)"),
    "metadata_harvest": f"""WITH {SEARCH}, {finish('first_union', 'docs')}, {FULL},
recs AS (
  SELECT run_id, paper_no, paper_id, {strip('f.title')} AS title, {strip('f.abstract')} AS abstract, f.server
  FROM selected JOIN full_docs f USING (paper_id))
SELECT run_id, paper_no, paper_id, title, length(abstract)::BIGINT AS abstract_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, title, abstract, server ORDER BY paper_no) AS rn FROM recs)
WHERE rn = 1""",
    "key_discovery": "SELECT unnest(['title', 'authors', 'a_key_longer_than_twenty_six', 'part_size']) AS key",
    "ordered_export": f"""WITH {PARTS} SELECT *,
  'title,part_size,authors,a_key_longer_than_twenty_six' AS column_order FROM parts""",
    "preview": f"""WITH {PARTS} SELECT paper_no, title, coalesce(part_size, '') AS part_size, authors
FROM parts ORDER BY paper_no LIMIT 10""",
    "csv_export": f"""WITH {PARTS}
SELECT 0::BIGINT AS line_no, 'title,part_size,authors,a_key_longer_than_twenty_six' AS value
UNION ALL SELECT row_number() OVER (ORDER BY run_id, paper_no), title || ',' || coalesce(part_size, '') || ',' || authors
  || ',"' || replace(a_key_longer_than_twenty_six, '"', '""') || '"' FROM parts""",
    "wide_csv_export": """WITH ks AS (
  SELECT p_partkey, 'k' || lpad(p_partkey::VARCHAR, 9, '0') AS k, p_partkey <> 7 AS later FROM part),
b AS (SELECT DISTINCT p_brand FROM part)
SELECT 0::BIGINT AS line_no, md5(string_agg(k, ',' ORDER BY later, k)) AS value FROM ks
UNION ALL SELECT row_number() OVER (ORDER BY p_brand), md5(line) FROM (
  SELECT b.p_brand, string_agg(coalesce(p_name, ''), ',' ORDER BY later, k) AS line
  FROM b CROSS JOIN ks LEFT JOIN part ON part.p_brand = b.p_brand AND part.p_partkey = ks.p_partkey GROUP BY b.p_brand)""",
    "json_export": f"""WITH {PARTS} SELECT title, part_size, authors, a_key_longer_than_twenty_six, 'internal' AS _raw, 'arXiv' AS _source,
  'u' || paper_no AS _source_url FROM parts""",
    "json_array_export": f"""WITH {PARTS},
r AS (SELECT *, row_number() OVER (ORDER BY run_id, paper_no) AS no FROM parts)
SELECT 0::BIGINT AS line_no, '[' AS mark, '' AS record
UNION ALL SELECT no, CASE WHEN no = 1 THEN ' ' ELSE ',' END, 'a_key_longer_than_twenty_six=' || a_key_longer_than_twenty_six
  || ';authors=' || authors || coalesce(';part_size=' || part_size, '') || ';title=' || title FROM r
UNION ALL SELECT count(*) + 1, ']', '' FROM parts""",
    "no_records_export": "SELECT p_partkey, false AS wrote, false AS made FROM part WHERE p_partkey <= 3",
    "text_export": f"""WITH {PARTS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY paper_no) AS no FROM parts),
lines AS (
  SELECT run_id, paper_no, unnest(range(8)) AS j, unnest([repeat('─', 60), 'Record ' || no, repeat('─', 60),
    printf('  %-26s: %s', 'title', title), printf('  %-26s: %s', 'part_size', coalesce(part_size, '')),
    printf('  %-26s: %s', 'authors', authors), '  a_key_longer_than_twenty_six: ' || a_key_longer_than_twenty_six, '']) AS value
  FROM numbered)
SELECT row_number() OVER (ORDER BY run_id, paper_no, j) - 1 AS line_no, value FROM lines""",
    "response_queries": f"""WITH {RUNS},
w AS (SELECT run_id, {split('prompt')} AS w FROM runs),
own AS (SELECT run_id, CASE WHEN run_id % 5 IN (0, 1) THEN
    [array_to_string(w[1:3], ' '), array_to_string(w[4:5], ' '), ''] ELSE [] END AS listed FROM w),
l AS (SELECT run_id, len(listed) AS n, listed FROM own)
SELECT run_id, unnest(range(n))::INT AS query_no, unnest(listed) AS query, n::INT AS n_queries FROM l WHERE n > 0
UNION ALL SELECT run_id, query_no, query, 3 FROM (WITH {QUERIES} SELECT run_id, query_no, query FROM q) WHERE run_id % 5 NOT IN (0, 1)""",
}
ORACLES["harvest_stream"] = ORACLES["title_dedup"]
ORACLES["harvest_batches"] = f"""WITH {DOCS},
keyed AS (SELECT paper_id, {strip('lower(title)')} AS title_key, (paper_id % 6)::INT AS batch_id FROM docs)
SELECT batch_id, paper_id, title_key FROM keyed WHERE title_key <> ''
QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY batch_id, paper_id) = 1"""
ORACLES["first_by_state"] = f"""WITH {DOCS},
keyed AS (SELECT paper_id, {strip('lower(title)')} AS title_key, ([0, 20, 100, 110])[paper_id % 4 + 1] * 3600 AS arrived FROM docs)
SELECT paper_id, title_key, arrived::BIGINT AS arrived FROM keyed WHERE title_key <> ''
QUALIFY row_number() OVER (PARTITION BY title_key, arrived > 200000 ORDER BY arrived, paper_id) = 1"""
ORACLES["rejected_papers"] = f"""WITH {DOCS}, {PREPRINTS},
every AS (SELECT 'corpus' AS stage, paper_id, title FROM docs UNION ALL SELECT 'feed', paper_id, title FROM pre),
shaped AS (SELECT stage, CASE WHEN paper_id % 40 = 7 THEN '' ELSE paper_id::VARCHAR END AS ref,
  CASE WHEN paper_id % 25 = 3 THEN '' ELSE {strip('lower(title)')} END AS t FROM every)
SELECT stage, ref, CASE WHEN t = '' THEN 'no title' ELSE 'no id' END AS message FROM shaped WHERE t = '' OR ref = ''
""".replace("RUN_DAY", ONE_DAY)

# Landed feeds: abstracts of Atom pages lose their line breaks, papers without a title do not reach the search.
LANDED_DOCS = DOCS.replace(ABSTRACT, collapse(ABSTRACT)).replace("FROM documents)", "FROM documents WHERE title <> '')")
ORACLES["landed_search"] = ORACLES["two_source_search"].replace(DOCS, LANDED_DOCS).replace(
    "FROM pages)", "FROM pages WHERE title <> '')")
ORACLES["landed_faults"] = f"""WITH {DOCS}, {PREPRINTS},
docs_of AS (SELECT 'atom' AS stage, paper_id // 16 AS page, title <> '' AS good, 0 AS server FROM docs
  UNION ALL SELECT 'preprint', feed_pos // 10, title <> '', server_no FROM pre)
SELECT stage, page, count(*) AS n_papers FROM docs_of WHERE good GROUP BY ALL
UNION ALL SELECT stage, page + 1000000, -1 FROM (SELECT DISTINCT stage, page, server FROM docs_of) WHERE page % 5 = 0
UNION ALL SELECT stage, NULL, -1 FROM docs_of WHERE stage = 'preprint' AND NOT good""".replace("RUN_DAY", ONE_DAY)
