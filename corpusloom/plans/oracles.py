"""The registered queries as DuckDB SQL, written independently of the operators. Only the HTML converter has none."""

from __future__ import annotations

NL = "chr(10)"
FILES = """files AS (
  SELECT doc_id, source || '/' || CASE WHEN doc_id % 5 = 0 THEN 'test_' ELSE '' END || doc_id
         || ['.py', '.md', '.go', '.txt', '.ts', '.yaml', '.conf', ''][doc_id % 8 + 1] AS filepath, text AS content FROM documents)"""
SUFFIX = "['.py', '.md', '.go', '.txt', '.ts', '.yaml', '.conf', ''][doc_id % 8 + 1]"
LANGUAGE = "['python', 'markdown', 'go', 'unknown', 'typescript', 'yaml', 'config', 'unknown'][doc_id % 8 + 1]"


def split(text: str) -> str:
    parts = rf"string_split_regex(coalesce({text}, ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def by_lines(source: str, size: int = 50, step: int = 45) -> str:
    """CTEs that end in chunks(key, content, chunk_index, line_start, line_end) of source(key, content)."""
    return f"""
split_lines AS (SELECT key, {split("content")} AS lines FROM {source}),
windows AS (SELECT key, lines, unnest(range(0, len(lines), {step})) AS s FROM split_lines),
chunks AS (SELECT key, array_to_string(lines[s + 1:s + {size}], {NL}) AS content, (s // {step})::INT AS chunk_index,
                  (s + 1)::INT AS line_start, least(s + {size}, len(lines))::INT AS line_end FROM windows)"""


HEADING = r"'^(#{1,6})[\s\x1c-\x1f\x{85}\p{Z}]+(.+)$'"


def by_heading(source: str, size: int, step: int) -> str:
    """CTEs that end in sections(key, content, chunk_index, line_start, line_end, type, symbol) of source(key, content)."""
    return f"""
md_lines AS (SELECT key, {split("content")} AS lines FROM {source}),
md_heads AS (SELECT key, lines, i, regexp_matches(lines[i + 1], {HEADING}) AS h FROM (SELECT key, lines, unnest(range(len(lines))) AS i FROM md_lines)),
md_begins AS (SELECT key, lines, h, i AS b, lead(i, 1, len(lines)) OVER (PARTITION BY key ORDER BY i) AS e,
                     bool_or(h) OVER (PARTITION BY key) AS any_head FROM md_heads WHERE h OR i = 0),
md_windows AS (SELECT *, unnest(range(b, e, {step})) AS s FROM md_begins),
sections AS (SELECT key, array_to_string(lines[s + 1:least(s + {size}, e)], {NL}) AS content, (row_number() OVER (PARTITION BY key ORDER BY s) - 1)::INT AS chunk_index,
    (s + 1)::INT AS line_start, least(s + {size}, e)::INT AS line_end,
    CASE WHEN NOT any_head THEN NULL WHEN h THEN 'markdown_h' || length(regexp_extract(lines[b + 1], {HEADING}, 1)) ELSE 'markdown_intro' END AS type,
    CASE WHEN h THEN regexp_extract(lines[b + 1], {HEADING}, 2) ELSE '' END AS symbol FROM md_windows)"""


PAGES = rf"""page_lines AS (
  SELECT page_id, url, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g'),
    '(?i)<h1[^>]*>', {NL} || '# ', 'g'), '<[^>]*>', {NL}, 'g'), {NL}), lambda x: trim(x) <> '') AS ls FROM pages),
md_pages AS (
  SELECT page_id, url, array_to_string(list_transform(ls, lambda x, i: CASE WHEN (i - 1) % 7 = 5 AND NOT starts_with(x, '#')
    THEN CASE WHEN (i - 1) % 2 = 0 THEN '## ' ELSE '### ' END || x ELSE x END), {NL}) AS markdown FROM page_lines),
one_page AS (SELECT url AS key, any_value(markdown) AS content FROM md_pages GROUP BY url)"""
LABELS = """labelled AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY chunk_index) - 1 AS number,
  CASE WHEN symbol <> '' THEN symbol WHEN type = 'markdown_intro' THEN '(preamble)' ELSE '(section ' || chunk_index || ')' END AS section,
  CASE WHEN type = 'markdown_intro' THEN 'intro' WHEN starts_with(type, 'markdown_h') THEN upper(right(type, 2)) ELSE coalesce(type, '') END AS level FROM sections)"""


def terms(source: str, name: str) -> str:
    """CTEs that end in <name>(key, idx, val) and <name>_tf(key, idx, tf) of source(key, content)."""
    return rf"""
{name}_tokens AS (SELECT key, unnest(regexp_extract_all(lower(coalesce(content, '')), '[a-zA-Z_][\p{{L}}\p{{N}}_]*')) AS t FROM {source}),
{name}_tf AS (SELECT key, (cast(('0x' || md5(t)) AS UHUGEINT) % 50000)::INT AS idx, count(*) AS tf FROM {name}_tokens GROUP BY ALL),
{name} AS (SELECT key, idx, tf / sqrt(sum(tf * tf) OVER (PARTITION BY key)) AS val FROM {name}_tf)"""


DOC = "doc AS (SELECT doc_id AS key, text AS content FROM documents)"
ITEM = "item AS (SELECT item_id AS key, text AS content FROM benchmark WHERE item_id = 0)"
DENSE = """dense AS (
  SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) AS score FROM embeddings)"""
PAYLOAD = f"payload AS (SELECT doc_id AS vec_id, filepath, content, {LANGUAGE} AS language, 1 AS line_start, len({split('content')}) AS line_end FROM files)"


def hybrid(k: int) -> str:
    return f"""{DENSE}, {DOC}, {ITEM}, {terms("doc", "p")}, {terms("item", "q")},
sparse AS (SELECT p.key AS vec_id, round(sum(p.val * q.val), 12) AS score FROM p JOIN q USING (idx) GROUP BY 1),
parts AS (
  SELECT vec_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) AS part FROM (SELECT * FROM dense ORDER BY score DESC, vec_id LIMIT {2 * k})
  UNION ALL
  SELECT vec_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) FROM (SELECT * FROM sparse ORDER BY score DESC, vec_id LIMIT {2 * k})),
fused AS (SELECT vec_id, sum(part) AS score FROM parts GROUP BY 1 ORDER BY score DESC, vec_id LIMIT {k})"""


def uuid5(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return f"""substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' ||
  ['8', '9', 'a', 'b'][(('0x' || substr({h}, 17, 1))::INT & 3) + 1] || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"""


KEYED = f"{FILES}, keyed AS (SELECT doc_id AS key, content FROM files)"
LINE_CHUNKS = "SELECT key AS doc_id, chunk_index, line_start, line_end, md5(content) AS content_md5 FROM chunks"
BY_SIZE = f"""{FILES}, sized AS (SELECT doc_id, filepath, content, unnest(range(0, length(content), 450)) AS s FROM files),
pieces AS (SELECT doc_id, filepath, (s // 450)::INT AS chunk_index, substring(content, s + 1, 500) AS piece,
  (1 + length(substring(content, 1, s)) - length(replace(substring(content, 1, s), {NL}, '')))::INT AS line_start FROM sized)"""
STATE = """st AS (
  SELECT i AS doc_id, i::VARCHAR AS path, 1000000 + i * 60 - CASE WHEN i % 3 = 0 THEN 0 ELSE 5 END AS last_modified, CASE WHEN i % 2 = 0 THEN sha256(text) ELSE 'old' END AS checksum,
         1 AS chunk_count, CASE WHEN i % 7 = 0 THEN (i % 11)::INT END AS embed_retries, CASE WHEN i % 7 = 0 THEN 2000000.0::DOUBLE - (i % 100) * 60 END AS last_embed_attempt, CASE WHEN i % 13 = 0 THEN true END AS failed
  FROM (SELECT d.doc_id AS i, text FROM labels l JOIN documents d ON d.doc_id = l.doc_id)),
fl AS (SELECT doc_id, doc_id::VARCHAR AS path, 1000000 + doc_id * 60 AS mtime, sha256(text) AS sha256 FROM documents)"""
ASKED_URL = "url || CASE WHEN page_id % 4 = 0 THEN '?q=' || page_id WHEN page_id % 4 = 1 THEN '/' ELSE '' END"
URL = r"'^([A-Za-z][A-Za-z0-9+.-]*:)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?'"

# Documents as source files: per language the first line, and text, lines, kind and symbols of the three kinds of blocks.
BLOCKS = {
    0: ("import os", [("def f%k(a):" + chr(10) + "    return '%s'", 2, "function_definition", "f%k"), ("class C%k:" + chr(10) + "    def m%k(self):" + chr(10) + "        return '%s'", 3, "class_definition", "C%k"), ("x%k = '%s'", 1, "general", "")]),
    1: ('import "fmt"', [("func F%k(a int) string {" + chr(10) + chr(9) + 'return "%s"' + chr(10) + "}", 3, "function_declaration", "F%k"), ("type T%k struct {" + chr(10) + chr(9) + "A string // %s" + chr(10) + "}", 3, "type_declaration", ""), ("// %s", 1, "general", "")]),
    2: ("import x from 'y'", [("function f%k(a) {" + chr(10) + "  return '%s';" + chr(10) + "}", 3, "function_declaration", "f%k"), ("class C%k {" + chr(10) + "  m%k(a) {" + chr(10) + "    return '%s';" + chr(10) + "  }" + chr(10) + "}", 5, "class_declaration", "C%k"), ("// %s", 1, "general", "")]),
    3: ("kind: x", [("f%k: 1 # %s", 1, "general", ""), ("c%k:" + chr(10) + "  m%k: 2 # %s", 2, "general", ""), ("# %s", 1, "general", "")]),
}


def _case(pick) -> str:
    """A CASE over language and kind of block; kind 0 is the first line."""
    arms = []
    for language, (first, kinds) in BLOCKS.items():
        for kind, block in enumerate([(first, 1, "general", ""), *kinds]):
            value = pick(block)
            arms.append(f"WHEN lang = {language} AND kind = {kind} THEN " + (str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"))
    return f"CASE {' '.join(arms)} END"


def _filled(text: str) -> str:
    return f"replace(replace({text}, '%k', k::VARCHAR), '%s', coalesce(line, ''))"


CODE = f"""code_lines AS (SELECT doc_id, doc_id % 4 AS lang, list_transform(string_split(coalesce(text, ''), {NL}), lambda x: regexp_replace(x, '[^A-Za-z0-9 ]', '_', 'g')) AS ls FROM documents),
numbered AS (SELECT doc_id, lang, unnest(range(len(ls) + 1)) AS k, ls FROM code_lines),
kinds AS (SELECT doc_id, lang, k, CASE WHEN k = 0 THEN 0 ELSE (k - 1) % 3 + 1 END AS kind, CASE WHEN k > 0 THEN ls[k] END AS line FROM numbered),
filled AS (SELECT doc_id, lang, k, kind, {_case(lambda b: b[1])} AS n, {_filled(_case(lambda b: b[0]))} AS block, {_case(lambda b: b[2])} AS type, {_filled(_case(lambda b: b[3]))} AS symbol FROM kinds),
code AS (SELECT *, (coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::INT AS first FROM filled),
code_text AS (SELECT doc_id AS key, string_agg(block, {NL} ORDER BY k) AS content, any_value(lang) AS lang, count(*) - 1 AS blocks FROM code GROUP BY doc_id)"""
STRIP = r"""regexp_replace(regexp_replace({0}, '[A-Za-z0-9+/]{{100,}}=*', '[BASE64_DATA_STRIPPED]', 'g'), '"[^"]{{500,}}"|''[^'']{{500,}}''', '[LONG_STRING_STRIPPED]', 'g')"""

ORACLES: dict[str, str] = {
    # YAML has no definitions at the top, so such a file is one stretch, in windows.
    "chunk_definitions": f"""WITH {CODE}, yaml AS (SELECT key, content FROM code_text WHERE lang = 3), {by_lines('yaml')}, n AS (SELECT key, max(line_end) AS n_lines FROM chunks GROUP BY key)
        SELECT doc_id, k::INT AS chunk_index, first AS line_start, (first + n - 1)::INT AS line_end, type, symbol AS symbols, md5(CASE WHEN type = 'general' THEN block ELSE {STRIP.format('block')} END) AS content_md5 FROM code WHERE lang < 3
        UNION ALL SELECT key, chunk_index, line_start, line_end, 'general', '', md5(content) FROM chunks JOIN n USING (key) WHERE chunk_index = 0 OR n_lines > 50""",
    "chunk_hybrid": f"""WITH {CODE}, {by_lines('code_text')},
        marks AS (SELECT doc_id AS key, first AS spot, symbol AS name, split_part(type, '_', 1) AS short FROM code WHERE symbol <> '' UNION ALL SELECT doc_id, first + 1, 'm' || k, 'function' FROM code WHERE lang = 0 AND kind = 2),
        named AS (SELECT c.key, c.chunk_index, string_agg(m.name, ',' ORDER BY spot) AS symbols, string_agg(short || ':' || m.name, ', ' ORDER BY spot) AS hints FROM chunks c JOIN marks m ON c.key = m.key AND spot BETWEEN c.line_start AND c.line_end GROUP BY 1, 2)
        SELECT c.key AS doc_id, c.chunk_index, c.line_start, c.line_end, coalesce(n.symbols, '') AS symbols, md5(c.content || CASE WHEN n.hints IS NULL THEN '' ELSE {NL} || {NL} || '/* Symbols: ' || n.hints || ' */' END) AS content_md5
        FROM chunks c LEFT JOIN named n ON c.key = n.key AND c.chunk_index = n.chunk_index""",
    # Nodes: those of Python's parser (a module; an import with a name; five in a function with an argument and a constant, six in a class around one, four in an assignment), words and marks elsewhere.
    "complexity": rf"""WITH {CODE}, per AS (SELECT doc_id, lang, blocks, content, (SELECT count(*) FILTER (kind = 1) * 5 + count(*) FILTER (kind = 2) * 6 + count(*) FILTER (kind = 3) * 4 FROM code c WHERE c.doc_id = t.key) AS inner_nodes,
          (SELECT count(*) FILTER (kind = 1) FROM code c WHERE c.doc_id = t.key) AS a, (SELECT count(*) FILTER (kind = 2) FROM code c WHERE c.doc_id = t.key) AS b, (SELECT sum(n) FROM code c WHERE c.doc_id = t.key) AS lines
          FROM (SELECT key AS doc_id, * FROM code_text) t),
        counts AS (SELECT doc_id || ['.py', '.go', '.ts', '.yaml'][lang + 1] AS filepath, ['python', 'go', 'typescript', 'yaml'][lang + 1] AS language, lines::INT AS line_count,
          CASE lang WHEN 0 THEN CASE WHEN b > 0 THEN 4 ELSE 3 END WHEN 1 THEN 2 WHEN 2 THEN CASE WHEN b > 0 THEN 3 ELSE 2 END ELSE CASE WHEN b > 0 THEN 2 ELSE 1 END END AS max_depth,
          CASE lang WHEN 0 THEN 3 + inner_nodes ELSE 1 + len(regexp_extract_all(content, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]')) END::INT AS node_count,
          CASE lang WHEN 3 THEN 1 + a + 2 * b WHEN 1 THEN a + b ELSE a + 2 * b END::INT AS def_count, CASE lang WHEN 3 THEN 0 ELSE 1 END AS import_count FROM per),
        scored AS (SELECT *, round(0.4::DOUBLE * max_depth + 0.01::DOUBLE * node_count + 0.5::DOUBLE * def_count + 0.2::DOUBLE * import_count, 2) AS complexity_score FROM counts)
        SELECT *, NULL::VARCHAR AS error, CASE WHEN complexity_score > 50 THEN 'Escalate to Flagship' END AS triage FROM scored""",
    "embed_chunks": rf"""WITH {KEYED}, {by_lines('keyed')}, toks AS (SELECT key, chunk_index, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+')) AS t FROM chunks),
        hashed AS (SELECT key, chunk_index, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM toks), sums AS (SELECT key, chunk_index, h % 32 AS d, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END) AS c FROM hashed GROUP BY ALL),
        cells AS (SELECT key, chunk_index, d, coalesce(c, 0) AS c, coalesce(min(CASE WHEN c <> 0 THEN abs(c) END) OVER (PARTITION BY key, chunk_index), 1) AS least
          FROM (SELECT key, chunk_index, unnest(range(32)) AS d FROM chunks) LEFT JOIN sums USING (key, chunk_index, d))
        SELECT key AS doc_id, chunk_index, md5(string_agg(round(c::DOUBLE / least, 2)::DECIMAL(12,2)::VARCHAR, ',' ORDER BY d)) AS vector_md5 FROM cells GROUP BY 1, 2""",
    "chunk_by_lines": f"WITH {KEYED}, {by_lines('keyed')} {LINE_CHUNKS}",
    "chunk_by_size": f"WITH {BY_SIZE} SELECT doc_id, chunk_index, line_start, (line_start + length(piece) - length(replace(piece, {NL}, '')))::INT AS line_end, md5(piece) AS content_md5 FROM pieces",
    "chunk_counts": f"SELECT source, sum(ceil(n / 45.0))::BIGINT AS n_chunks, count(*) FILTER (n > 0) AS n_files FROM (SELECT source, len({split('text')}) AS n FROM documents) GROUP BY source HAVING sum(n) > 0",
    "chunk_markdown": f"WITH {PAGES}, src AS (SELECT page_id AS key, markdown AS content FROM md_pages), {by_heading('src', 5, 4)} SELECT key AS page_id, chunk_index, line_start, line_end, type, symbol, md5(content) AS content_md5 FROM sections",
    "chunk_routed": rf"""WITH {FILES}, routed AS (SELECT doc_id AS key, content, {SUFFIX} = '.md' OR ({SUFFIX} IN ('.txt', '') AND regexp_matches(content, '^(---|# )')) AS md FROM files),
        plain AS (SELECT key, content FROM routed WHERE NOT md), marked AS (SELECT key, content FROM routed WHERE md), {by_lines('plain')}, {by_heading('marked', 100, 90)}
        {LINE_CHUNKS} UNION ALL SELECT key, chunk_index, line_start, line_end, md5(content) FROM sections""",
    "symbols_in_window": f"""WITH {KEYED}, {by_lines('keyed')},
        marks AS (SELECT key, i AS start_line, regexp_extract(lines[i], '^(The|En|Is|La) ', 1) AS name FROM (SELECT key, lines, unnest(range(1, len(lines) + 1)) AS i FROM split_lines)),
        named AS (SELECT c.key, c.chunk_index, string_agg(m.name, ',' ORDER BY start_line) AS symbols, string_agg('function:' || m.name, ', ' ORDER BY start_line) AS hints
          FROM chunks c JOIN marks m ON c.key = m.key AND m.name <> '' AND m.start_line BETWEEN c.line_start AND c.line_end GROUP BY 1, 2)
        SELECT c.key AS doc_id, c.chunk_index, coalesce(n.symbols, '') AS symbols, md5(c.content || CASE WHEN n.hints IS NULL THEN '' ELSE {NL} || {NL} || '/* Symbols: ' || n.hints || ' */' END) AS content_md5
        FROM chunks c LEFT JOIN named n ON c.key = n.key AND c.chunk_index = n.chunk_index""",
    "sanitize_text": r"""WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN regexp_replace(text, '[^A-Za-z0-9+/]', '', 'g') WHEN 1 THEN '''' || replace(text, '''', '') || ''' tail' ELSE text END AS t FROM documents),
        c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[A-Za-z0-9+/]{100,}=*', '[BASE64_DATA_STRIPPED]', 'g'), '"[^"]{500,}"|''[^'']{500,}''', '[LONG_STRING_STRIPPED]', 'g') AS t FROM s)
        SELECT doc_id, md5(t) AS clean_md5, length(t)::INT AS clean_length FROM c""",
    "sparse_tf": f"WITH {DOC}, {terms('doc', 'p')} SELECT key AS doc_id, idx, tf FROM p_tf",
    "sparse_norms": f"WITH {DOC}, {terms('doc', 'p')} SELECT key AS doc_id, round(sum(val * val), 6) AS norm2, count(*) AS n_terms FROM p GROUP BY 1",
    "sparse_search": f"""WITH {KEYED}, {by_lines('keyed')}, pts AS (SELECT key || '_' || chunk_index AS key, content FROM chunks), {ITEM}, {terms('pts', 'p')}, {terms('item', 'q')}
        SELECT point_id, round(score, 6) AS score FROM (SELECT p.key AS point_id, round(sum(p.val * q.val), 12) AS score FROM p JOIN q USING (idx) GROUP BY 1 ORDER BY score DESC, point_id LIMIT 10)""",
    "sparse_batch_search": f"""WITH {DOC}, items AS (SELECT item_id AS key, text AS content FROM benchmark), {terms('doc', 'p')}, {terms('items', 'q')},
        hits AS (SELECT q.key AS query_id, p.key AS doc_id, round(sum(p.val * q.val), 12) AS score FROM p JOIN q USING (idx) GROUP BY 1, 2),
        top AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3)
        SELECT query_id, round(sum(score), 5) AS total, round(max(score), 5) AS best, count(*) AS n FROM top GROUP BY 1""",
    "indexed_sparse_search": f"""WITH {DOC}, {ITEM}, {terms('doc', 'p')}, {terms('item', 'q')}
        SELECT p.key AS doc_id, round(sum(p.val * q.val), 12) AS score FROM p JOIN q USING (idx) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10""",
    "indexed_dense_search": f"WITH {DENSE} SELECT vec_id, round(score, 6) AS score FROM dense ORDER BY dense.score DESC, vec_id LIMIT 10",
    "indexed_dense_filtered": f"""WITH {DENSE}, {FILES} SELECT vec_id, round(score, 6) AS score FROM dense JOIN files ON vec_id = files.doc_id JOIN documents d ON d.doc_id = files.doc_id
        WHERE contains(filepath, 'src1') AND lang = 'en' AND NOT regexp_matches(filepath, 'test|spec') ORDER BY dense.score DESC, vec_id LIMIT 10""",
    "skipping_read": f"WITH {FILES} SELECT filepath, {LANGUAGE} AS language, doc_id % 5 = 0 AS is_test FROM files WHERE contains(filepath, '/test_1') AND {LANGUAGE} = 'python' AND doc_id % 5 = 0",
    "dense_topk": f"WITH {DENSE} SELECT vec_id, round(score, 6) AS score FROM dense ORDER BY dense.score DESC, vec_id LIMIT 10",
    "dense_topk_filtered": f"""WITH {DENSE}, {FILES} SELECT vec_id, round(score, 6) AS score FROM dense JOIN files ON vec_id = files.doc_id JOIN documents d ON d.doc_id = files.doc_id
        WHERE contains(filepath, 'src1') AND lang = 'en' AND NOT regexp_matches(filepath, 'test|spec') ORDER BY dense.score DESC, vec_id LIMIT 10""",
    "dense_batch_topk": """SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (
        SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s,
          row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id)::INT AS rank
        FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE rank <= 5""",
    "hybrid_rrf": f"WITH {hybrid(10)} SELECT vec_id, round(score, 9) AS score FROM fused",
    "rag_dense_postfilter": f"""WITH {DENSE}, {FILES}, {PAYLOAD}, hits AS (SELECT * FROM dense ORDER BY score DESC, vec_id LIMIT 20)
        SELECT vec_id, filepath, round(score, 6) AS score FROM hits JOIN payload USING (vec_id) WHERE score >= 0.2 AND length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) >= 500 ORDER BY hits.score DESC, vec_id LIMIT 10""".replace("\\\\", "\\"),
    "rag_hybrid_postfilter": f"""WITH {FILES}, {PAYLOAD}, {hybrid(20)}
        SELECT vec_id, filepath, round(score, 9) AS score FROM fused JOIN payload USING (vec_id) WHERE length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) >= 500 ORDER BY fused.score DESC, vec_id LIMIT 10""".replace("\\\\", "\\"),
    "citations": f"""WITH {DENSE}, {FILES}, {PAYLOAD}, hits AS (SELECT * FROM dense ORDER BY score DESC, vec_id LIMIT 10)
        SELECT vec_id, printf('- [`%s`](%s:%d) (score: %.2f, lines %d-%d)', filepath, filepath, line_start, score, line_start, line_end) AS citation FROM hits JOIN payload USING (vec_id)""",
    "qa_context": f"""WITH {DENSE}, {FILES}, {PAYLOAD}, hits AS (SELECT * FROM dense ORDER BY score DESC, vec_id LIMIT 5),
        n AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS i FROM hits JOIN payload USING (vec_id)),
        t AS (SELECT string_agg('### [' || i || '] ' || filepath || ' (lines ' || line_start || '-' || line_end || ')' || {NL} || '```' || language || {NL} || content || {NL} || '```' || {NL}, {NL} ORDER BY i) AS text FROM n)
        SELECT md5(text) AS text_md5, length(text)::INT AS n FROM t""",
    "payload_filters": f"WITH {FILES} SELECT doc_id, filepath FROM files WHERE contains(filepath, 'src0') AND {SUFFIX} = '.py' AND doc_id % 5 = 0",
    "derived_columns": f"""WITH {FILES} SELECT doc_id, {LANGUAGE} AS language, doc_id % 5 = 0 AS is_test, 'a' AS part0, string_split(filepath, '/')[1] AS part1, string_split(filepath, '/')[2] AS part2,
        NULL::VARCHAR AS part3, NULL::VARCHAR AS part4, sha256(content) AS sha256 FROM files""",
    "point_ids": f"WITH {BY_SIZE} SELECT doc_id, chunk_index, {uuid5('''(filepath || '_chunk_' || chunk_index)''')} AS point_id FROM pieces",
    "handled_files": f"SELECT doc_id, {SUFFIX} <> '' AND doc_id % 5 IN (0, 3) AS handled, doc_id % 5 IN (1, 2, 4) AS refused FROM documents",
    "upsert_collection": f"""WITH {FILES}, p AS (SELECT doc_id, {uuid5("(filepath || '_chunk_0')")} AS point_id, filepath, content FROM files)
        SELECT point_id, filepath, CASE WHEN doc_id % 2 = 0 THEN md5(content || '!') ELSE md5(content) END AS content FROM p WHERE doc_id % 2 = 0 OR doc_id % 3 > 0""",
    "stale_points": f"""WITH {BY_SIZE}, short AS (SELECT doc_id, ceil((length(content) // 2) / 450.0) AS n FROM files WHERE length(content) > 1)
        SELECT {uuid5('''(filepath || '_chunk_' || chunk_index)''')} AS point_id, filepath FROM pieces JOIN short USING (doc_id) WHERE chunk_index >= n""",
    "should_reindex": f"""WITH {STATE} SELECT fl.path, CASE WHEN st.path IS NULL THEN true WHEN st.failed THEN false
          WHEN coalesce(embed_retries, 0) > 0 AND 2000000 - last_embed_attempt < least(pow(2, embed_retries), 60) * 60 THEN false
          WHEN last_modified = mtime THEN false ELSE checksum <> sha256 END AS reindex FROM fl LEFT JOIN st ON fl.path = st.path""",
    "state_after_failure": f"""WITH {STATE}, bad AS (SELECT path FROM fl WHERE doc_id % 4 = 0)
        SELECT coalesce(st.path, bad.path) AS path, CASE WHEN bad.path IS NULL THEN embed_retries ELSE coalesce(embed_retries, 0) + 1 END AS embed_retries,
          CASE WHEN bad.path IS NULL THEN last_embed_attempt ELSE 2000000.0::DOUBLE END AS last_embed_attempt, CASE WHEN bad.path IS NOT NULL AND coalesce(embed_retries, 0) + 1 > 5 THEN true ELSE failed END AS failed
        FROM st FULL JOIN bad ON st.path = bad.path""",
    "state_after_success": f"""WITH {STATE}, good AS (SELECT * FROM fl WHERE doc_id % 4 = 1)
        SELECT path, checksum, chunk_count, embed_retries, failed FROM st WHERE path NOT IN (SELECT path FROM good) UNION ALL SELECT path, sha256, 2, NULL, NULL FROM good""",
    "skip_existing_urls": "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^(https?://|file://|raw:)') AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)",
    "url_paths": f"""WITH u AS (SELECT page_id, {ASKED_URL} AS url FROM pages), x AS (SELECT page_id, url, replace(regexp_extract(url, {URL}, 3), '.', '_') AS host, regexp_extract(url, {URL}, 4) AS p, regexp_extract(url, {URL}, 6) AS q FROM u)
        SELECT page_id, CASE WHEN host = '' THEN '' ELSE host || '/' END || CASE WHEN trim(p, '/') = '' THEN 'index' WHEN ends_with(p, '/') THEN trim(p, '/') || '/index' ELSE trim(p, '/') END
          || CASE WHEN q <> '' THEN '_' || substr(md5(q), 1, 6) ELSE '' END || '.md' AS path, substr(sha256(url), 1, 16) AS cache_key FROM x""",
    "expand_urls": """SELECT page_id, url || '/' || unnest(CASE WHEN page_id % 5 <= page_id % 3 THEN range(page_id % 5, page_id % 3 + 1) ELSE range(page_id % 5, page_id % 3 - 1, -1) END) || '/x' AS url FROM pages WHERE page_id % 2 = 0
        UNION ALL SELECT page_id, url FROM pages WHERE page_id % 2 = 1""",
    "toc": f"WITH {PAGES}, {by_heading('one_page', 100, 90)}, {LABELS} SELECT key AS url, number::INT AS number, section, level, line_start || '-' || line_end AS lines, (length(content) // 4)::INT AS est_tokens FROM labelled",
    "toc_text": f"""WITH {PAGES}, {by_heading('one_page', 100, 90)}, {LABELS}
        SELECT key AS url, md5('## Table of Contents: ' || key || {NL} || {NL} || '| # | Section | Level | Lines | ~Tokens |' || {NL} || '|---|---------|-------|-------|---------|' || {NL}
          || string_agg('| ' || number || ' | ' || section || ' | ' || level || ' | ' || line_start || '-' || line_end || ' | ' || (length(content) // 4) || ' |', {NL} ORDER BY number)
          || {NL} || {NL} || '---' || {NL} || 'To read specific sections, call ``scout_urls`` with ``mode=''sections''``' || {NL} || 'and pass the section names or numbers as ``sections=[...]``.' || {NL}) AS toc_md5 FROM labelled GROUP BY key""",
    "sections": f"WITH {PAGES}, {by_heading('one_page', 100, 90)}, {LABELS} SELECT key AS url, number::INT AS number, md5(content) AS content_md5 FROM labelled WHERE number = 1 OR contains(lower(section), 'the')",
    "shorten_pages": f"""WITH {PAGES}, {by_heading('one_page', 100, 90)},
        n AS (SELECT key, count(*) AS n, max(content) FILTER (chunk_index = 0) AS a, max(content) FILTER (chunk_index = 1) AS b FROM sections GROUP BY key),
        s AS (SELECT p.key AS url, CASE WHEN length(p.content) <= 800 THEN p.content WHEN n > 2 THEN a || {NL} || {NL} || '... [TRUNCATED - page too large. This page has ' || n || ' sections. Re-call with mode=''toc'' to browse sections, then use mode=''sections'' to read specific sections.] ...' || {NL} || {NL} || b
          ELSE substring(p.content, 1, 800) || {NL} || {NL} || '... [TRUNCATED - page too large] ...' END AS shown FROM one_page p LEFT JOIN n ON p.key = n.key)
        SELECT url, length(shown)::INT AS n, md5(shown) AS shown_md5 FROM s""",
    "ttl_evict": "SELECT event_id FROM events WHERE epoch((SELECT max(ts) FROM events)) - epoch(ts) <= 600000",
    "crawled_pages": "SELECT url FROM pages",
    "crawl_run": f"SELECT DISTINCT url, '---' || {NL} || 'source_url: ' || url || {NL} || '---' AS front FROM pages WHERE page_id % 2 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)",
    "crawl_recursive": """WITH RECURSIVE r(seed, id, depth) AS (SELECT page_id, page_id, 0 FROM pages WHERE page_id % 10 = 1
          UNION SELECT seed, p.page_id, depth + 1 FROM r JOIN pages p ON p.page_id = r.id + 5 OR p.page_id = r.id + 10 WHERE depth < 3)
        SELECT 'https://s' || seed % 5 || '.org/' || seed AS seed_url, 'https://s' || id % 5 || '.org/' || id AS url, min(depth)::INT AS depth FROM r GROUP BY 1, 2""",
    "change_parts": f"""WITH {FILES}, b AS (SELECT filepath, row_number() OVER (ORDER BY filepath) - 1 AS i, coalesce(sum(length(content)) OVER (ORDER BY filepath ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM files)
        SELECT filepath AS path, (i // 100 + before // 50000)::BIGINT AS part FROM b""",
    "state_as_changes": f"WITH {FILES} SELECT filepath AS path, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE md5(content) END AS checksum FROM files WHERE doc_id % 7 <> 0",
    "tracked_files": f"WITH {FILES} SELECT doc_id, filepath AS path FROM files WHERE doc_id % 3 = 1",
    "commit_columns": """WITH c AS (SELECT user_id, event_id::VARCHAR AS commit_hash, event_type AS commit_author FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT doc_id::VARCHAR AS filepath, commit_hash, commit_author FROM documents LEFT JOIN c ON user_id = doc_id""",
    "metadata_ids": f"""SELECT DISTINCT source, {uuid5("(source || '_indexing_metadata')")} AS id FROM documents""",
    "hits_json": f"""WITH {DENSE}, {FILES}, {PAYLOAD}, hits AS (SELECT * FROM dense ORDER BY score DESC, vec_id LIMIT 10)
        SELECT vec_id, '{{"id":' || vec_id || ',"score":' || round(score, 6)::VARCHAR || ',"payload":{{"filepath":"' || filepath || '","content":"' || md5(content) || '","language":"' || language || '","chunk_index":0}}}}' AS json FROM hits JOIN payload USING (vec_id)""",
    "search_results": f"""WITH {DENSE}, {FILES}, {PAYLOAD}, hits AS (SELECT * FROM dense ORDER BY score DESC, vec_id LIMIT 10),
        t AS (SELECT string_agg('### ' || filepath || printf(' (Score: %.2f)', round(score, 6)) || {NL} || '```' || language || {NL} || md5(content) || {NL} || '```' || {NL}, {NL} ORDER BY round(score, 6) DESC, vec_id) AS text FROM hits JOIN payload USING (vec_id))
        SELECT md5(text) AS text_md5, length(text)::INT AS n FROM t""",
    "section_texts": f"""WITH {PAGES}, {by_heading('one_page', 100, 90)}, {LABELS}, c AS (SELECT *, count(*) OVER (PARTITION BY key) AS total FROM labelled),
        t AS (SELECT key AS url, '## Selected Sections from: ' || key || {NL} || '(' || count(*) || ' of ' || any_value(total) || ' chunks returned)' || {NL} || {NL} ||
            string_agg('---' || {NL} || '### ' || section || '  (' || level || ', ~' || (length(content) // 4) || ' tokens)' || {NL} || {NL} || content || {NL}, {NL} ORDER BY chunk_index) AS text
          FROM c WHERE number = 0 OR contains(lower(section), '0') GROUP BY key)
        SELECT url, md5(text) AS text_md5, length(text)::INT AS n FROM t""",
    "results_and_answers": """SELECT md5(html) AS title, url, substring(html, 1, 40) AS snippet FROM pages
        UNION ALL SELECT 'Answer', CASE WHEN item_id % 2 = 0 THEN 'https://a.org/' || item_id ELSE '' END, text FROM benchmark""",
    "crawl_globs": """WITH RECURSIVE r(seed, id, depth) AS (SELECT page_id, page_id, 0 FROM pages WHERE page_id % 10 = 0
          UNION SELECT seed, p.page_id, depth + 1 FROM r JOIN pages p ON p.page_id BETWEEN r.id + 1 AND r.id + 3
          WHERE depth < 4 AND p.page_id > 0 AND p.page_id % 10 <> 7 AND NOT (p.page_id BETWEEN 10 AND 99 AND p.page_id % 10 = 2))
        SELECT 'https://s.org/p' || seed AS seed_url, 'https://s.org/p' || id AS url, min(depth)::INT AS depth FROM r GROUP BY 1, 2""",
    "collection_versions": f"""WITH {FILES} SELECT {uuid5("(filepath || '_chunk_0')")} AS point_id, filepath, CASE WHEN doc_id % 2 = 0 THEN 'again' ELSE md5(content) END AS content FROM files WHERE doc_id % 7 <> 0""",
    "collection_lookup": f"""WITH {FILES} SELECT {uuid5("(filepath || '_chunk_0')")} AS point_id, filepath, CASE WHEN doc_id % 2 = 0 THEN 'again' ELSE md5(content) END AS content FROM files WHERE doc_id % 7 <> 0 AND doc_id < 10""",
    "complexity_score": f"""SELECT doc_id, round(0.4::DOUBLE * 3 + 0.01::DOUBLE * len(string_split(text, ' ')) + 0.5::DOUBLE * len(string_split(text, {NL})) + 0.2::DOUBLE * (doc_id % 7), 2) AS complexity_score FROM documents""",
    "read_range": f"""WITH l AS (SELECT doc_id, string_split(text, {NL}) AS ls FROM documents), n AS (SELECT doc_id, ls, unnest(range(3, 7)) AS i FROM l)
        SELECT doc_id, lpad(i::VARCHAR, 6, ' ') || ' | ' || ls[i] AS line FROM n WHERE i <= len(ls)""",
    "language_stats": f"WITH {FILES} SELECT {LANGUAGE} AS language, count(*) AS n_files, sum(length(content))::BIGINT AS n_chars FROM files GROUP BY 1",
    "git_latest": """SELECT user_id::VARCHAR AS path, event_id::VARCHAR AS commit_hash, event_type AS commit_author, strftime(ts, '%Y-%m-%d %H:%M:%S') AS commit_date, props AS commit_subject
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "search_rendering": "SELECT conv_id, turn, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '...' ELSE text END AS snippet FROM conversations",
    "stripped_lengths": r"SELECT doc_id, length(regexp_replace(text, '^[\s\x1c-\x1f\x{85}\p{Z}]+|[\s\x1c-\x1f\x{85}\p{Z}]+$', '', 'g'))::INT AS n FROM documents",
    "index_points": f"""WITH {FILES}, f AS (SELECT filepath AS key, content, {LANGUAGE} AS language, {SUFFIX} = '.md' OR ({SUFFIX} IN ('.txt', '') AND regexp_matches(content, '^(---|# )')) AS md FROM files),
        plain AS (SELECT key, content FROM f WHERE NOT md), marked AS (SELECT key, content FROM f WHERE md), {by_lines('plain')}, {by_heading('marked', 100, 90)},
        a AS (SELECT key FROM chunks UNION ALL SELECT key FROM sections)
        SELECT language, count(*) AS n_points, count(DISTINCT a.key) AS n_files FROM a JOIN f ON a.key = f.key GROUP BY 1""",
}
