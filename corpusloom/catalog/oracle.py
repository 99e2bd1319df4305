"""DuckDB twins of the registered queries, written row-wise and independently of Spark."""

from ..functions import fixed
from ..functions.dialect import WHITE_SPACE, any_of, re2
from ..operators.prompts import DEFAULT_TEMPLATES, FALLBACK_TEMPLATE
from ..sources.tables import DIRS, EXTS, STEMS
from .samples import ENTRY_LIKE_NAMES, USER_TEMPLATE
from .stored import ROUND_TOKENS


def q(value: str) -> str:
    """SQL literal; control characters spelled with chr()."""
    return "'" + value.replace("'", "''") + "'"


def words(values) -> str:
    return ", ".join(q(v) for v in values)


def has_any(value: str, parts) -> str:
    return "(" + " OR ".join(f"contains({value}, {q(p)})" for p in parts) + ")"


def base(path: str) -> str:
    return f"regexp_extract(rtrim({path}, '/'), '[^/]*\\z')"


def raw_ext(path: str) -> str:
    return f"(CASE WHEN {base(path)} = '..' THEN '' ELSE regexp_extract({base(path)}, '(?s)\\A.+(\\.[^.]*)\\z', 1) END)"


def stem(path: str) -> str:
    return f"left({base(path)}, length({base(path)}) - length({raw_ext(path)}))"


def dirname(path: str) -> str:
    return (
        f"(CASE WHEN rtrim({path}, '/') = '' AND starts_with({path}, '/') THEN '/' WHEN NOT contains(rtrim({path}, '/'), '/') THEN '.' "
        f"WHEN regexp_extract(rtrim({path}, '/'), '(?s)\\A(.*)/[^/]*\\z', 1) = '' THEN '/' "
        f"ELSE regexp_extract(rtrim({path}, '/'), '(?s)\\A(.*)/[^/]*\\z', 1) END)"
    )


def strip(value: str) -> str:
    return f"trim({value}, {q(WHITE_SPACE)})"


def escape(value: str) -> str:
    for old, new in fixed.HTML_ESCAPES:
        value = f"replace({value}, {q(old)}, {q(new)})"
    return value


def utf16(value: str) -> str:
    return f"(length({value}) + length(regexp_replace({value}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def tokens(value: str) -> str:
    return f"CAST(ceil({utf16(value)} / 4.0) AS BIGINT)"


FILES = f"""
k AS (SELECT doc_id, source, text, CAST(floor(doc_id / 20) AS BIGINT) AS k FROM documents),
d AS (
  SELECT doc_id, source, text,
         split_part('{STEMS}', ',', CAST(k % 10 AS INT) + 1) || '_' || CAST(CAST(floor(k / 10) AS BIGINT) % 5 AS STRING) AS stem,
         split_part('{STEMS}', ',', CAST((k * 7 + 3) % 10 AS INT) + 1) || '_' || CAST(k % 2 AS STRING) AS dep,
         split_part('{EXTS}', ',', CAST((k + CAST(floor(k / 8) AS BIGINT)) % 8 AS INT) + 1) AS ext,
         split_part('{DIRS}', ',', CAST((k * 3 + CAST(floor(k / 5) AS BIGINT)) % 5 AS INT) + 1) AS dir
  FROM k),
files AS (
SELECT doc_id AS file_id, source AS project, dir || '/' || stem || ext AS relative_path,
       CASE ext
         WHEN '.js' THEN 'import helper from ''' || dep || ''';' || chr(10) || 'const db = require(''mysql/promise'');' || chr(10)
           || 'function getItem' || CAST(doc_id % 4 AS STRING) || '(a) {{' || chr(10) || '  return fetch("https://api.example.com/v1");' || chr(10) || '}}' || chr(10)
         WHEN '.ts' THEN 'import {{ x }} from ''@scope/kit'';' || chr(10) || 'const saveAll = (a) => a;' || chr(10)
           || 'class Box {{' || chr(10) || '  handleEvent(e) {{' || chr(10) || '  }}' || chr(10) || '}}' || chr(10)
         WHEN '.py' THEN 'from ' || dep || ' import run' || chr(10) || 'import os' || chr(10) || 'def validate_row(r):' || chr(10)
           || '    return connect("host=db01.example.org;password=hunter2")' || chr(10) || 'if __name__ == "__main__":' || chr(10) || '    main()' || chr(10)
         WHEN '.java' THEN 'import java.util.List;' || chr(10) || 'public class Box {{ public static void main(String[] a) {{ formatAll(a); }} }}' || chr(10)
         WHEN '.go' THEN 'import "fmt"' || chr(10) || 'func main() {{ }}' || chr(10) || 'func CheckSum(a int) int {{ return a }}' || chr(10)
         WHEN '.rs' THEN 'use serde;' || chr(10) || 'fn convert_all(a: i32) {{ }}' || chr(10)
         WHEN '.md' THEN '```mermaid' || chr(10) || 'flowchart TD' || chr(10) || '  A --> B' || chr(10) || '```' || chr(10)
           || '<table><tr><td>' || stem || '</td></tr></table>' || chr(10) || '```markdown' || chr(10) || '# ' || dep || chr(10) || '```' || chr(10)
         ELSE '' END || text AS content
FROM d)"""

PAGE_FILES = "files AS (SELECT page_id AS file_id, regexp_extract(url, '//([^/:?#]+)', 1) AS project, url AS relative_path, html AS content FROM pages)"

LANGUAGES = "languages(ext, language) AS (VALUES " + ", ".join(f"({q(e)}, {q(v)})" for e, v in fixed.LANGUAGES.items()) + ")"
DESCRIBED = f"""{LANGUAGES},
described AS (SELECT f.*, coalesce(l.language, 'plaintext') AS language FROM files f LEFT JOIN languages l ON l.ext = lower({raw_ext('relative_path')}))"""


def included(match: str = "substring") -> str:
    literals = [p for p in fixed.EXCLUDES if "*" not in p]
    globs = [p.replace("_", "\\_").replace("*", "%") for p in fixed.EXCLUDES if "*" in p]
    if match == "segment":
        literal = " OR ".join(f"contains('/' || relative_path || '/', {q('/' + p + '/')})" for p in literals)
    else:
        literal = " OR ".join(f"contains(relative_path, {q(p)})" for p in literals)
    name = base("relative_path")
    glob = " OR ".join(f"{name} LIKE {q(g)} ESCAPE '\\'" for g in globs)
    return (
        f"NOT starts_with({name}, {q(fixed.OUTPUT_PREFIX)}) AND lower({raw_ext('relative_path')}) IN ({words(fixed.CODE_EXTENSIONS)}) "
        f"AND NOT ({literal}) AND NOT ({glob})"
    )


# --- extraction -----------------------------------------------------------------------------------


def raw_matches(patterns, value: str = "content") -> str:
    """Rows (project, file_id, pno, mno, v1, v2) over (pattern, groups) pairs; 0 groups is the whole match."""
    selects = []
    for no, (pattern, groups) in enumerate(patterns):
        first = f"regexp_extract_all({value}, {q(re2(pattern))}, {min(groups, 1)})"
        second = f"regexp_extract_all({value}, {q(re2(pattern))}, 2)" if groups == 2 else f"list_transform({first}, lambda x: '')"
        selects.append(
            f"SELECT project, file_id, {no} AS pno, generate_subscripts(l1, 1) AS mno, unnest(l1) AS v1, unnest(l2) AS v2 "
            f"FROM (SELECT project, file_id, {first} AS l1, {second} AS l2 FROM files)"
        )
    return "\nUNION ALL ".join(selects)


def first_seen(source: str, value: str) -> str:
    """Distinct values per file with their position in first-seen order."""
    return (
        f"SELECT project, file_id, {value}, row_number() OVER (PARTITION BY file_id ORDER BY seen) - 1 AS pos "
        f"FROM (SELECT project, file_id, {value}, min(CAST(pno AS BIGINT) * 1000000000 + mno) AS seen FROM {source} GROUP BY ALL)"
    )


FUNCTION_ROWS = f"""
fn_raw AS ({raw_matches([(p, 1) for p in fixed.FUNCTION_PATTERNS])}),
fn_ok AS (SELECT project, file_id, pno, mno, v1 AS name FROM fn_raw WHERE length(v1) > 1 AND lower(v1) NOT IN ({words(fixed.RESERVED_FUNCTIONS)})
  AND NOT regexp_matches(v1, {q(any_of(fixed.UNSAFE_FUNCTION, re2))})),
fn AS ({first_seen('fn_ok', 'name')})"""


def _dynamic(pattern: str, name: str) -> str:
    before, after = re2(pattern).split("NAME")
    return f"regexp_matches(content, {q(before)} || {name} || {q(after)})"


def function_type(name: str) -> str:
    rules = "".join(f" WHEN {has_any(f'lower({name})', ws)} THEN {q(label)}" for ws, label in fixed.FUNCTION_NAME_RULES)
    return (
        f"CASE{rules} WHEN {_dynamic(fixed.ASYNC_PATTERN, name)} THEN 'async-function' "
        f"WHEN {_dynamic(fixed.ARROW_PATTERN, name)} THEN 'arrow-function' ELSE 'function' END"
    )


FUNCTION_TYPES = f"{FUNCTION_ROWS},\nfn_typed AS (SELECT fn.project, fn.file_id, pos, name, {function_type('name')} AS type FROM fn JOIN files f ON f.file_id = fn.file_id)"

BLANK = re2(r"^\s*$")
DEPENDENCY_ROWS = f"""
dep_raw AS ({raw_matches(fixed.DEPENDENCY_PATTERNS)}),
dep_one AS (SELECT project, file_id, pno, mno, CASE WHEN v1 IS NULL OR regexp_matches(v1, {q(BLANK)}) THEN coalesce(v2, '') ELSE v1 END AS v FROM dep_raw),
dep_cut AS (SELECT project, file_id, pno, mno, CASE WHEN starts_with(v, '@') THEN v ELSE split_part(v, '/', 1) END AS dependency
  FROM dep_one WHERE NOT regexp_matches(v, {q(BLANK)}) AND NOT starts_with(v, '.')),
dep_ok AS (SELECT * FROM dep_cut WHERE NOT regexp_matches(dependency, {q(any_of(fixed.UNSAFE_DEPENDENCY, re2))})
  AND NOT regexp_matches(dependency, {q(any_of(fixed.INVALID_PACKAGE, re2))})),
dep AS ({first_seen('dep_ok', 'dependency')})"""

DATABASE_ROWS = f"""
db_raw AS ({raw_matches([(p, 0) for p in fixed.DATABASE_PATTERNS])}),
db_ok AS (SELECT project, file_id, pno, mno, CASE WHEN pno = 2 THEN regexp_extract(lower(v1), {q(re2(r'^\S+'))}) ELSE lower(v1) END AS database FROM db_raw),
db AS ({first_seen('db_ok', 'database')})"""

API_ROWS = f"""
api_raw AS ({raw_matches([(p, 0) for p in fixed.API_PATTERNS])}),
api_ok AS (SELECT project, file_id, pno, mno, lower(v1) AS api FROM api_raw),
api AS ({first_seen('api_ok', 'api')})"""


def masked(value: str, masks) -> str:
    for pattern, replacement in masks:
        value = f"regexp_replace({value}, {q(re2(pattern))}, {q(replacement)}, 'g')"
    return value


def unsafe(value: str, patterns) -> str:
    return f"regexp_matches({value}, {q(any_of(patterns, re2))})"


def sanitized(value: str, masks, patterns, generic: str) -> str:
    return f"(CASE WHEN {unsafe(masked(value, masks), patterns)} THEN {q(generic)} ELSE {masked(value, masks)} END)"


def connection(value: str) -> str:
    return sanitized(value, fixed.CONNECTION_MASKS, fixed.UNSAFE_CONNECTION, fixed.GENERIC_CONNECTION)


def endpoint(value: str) -> str:
    return sanitized(value, fixed.ENDPOINT_MASKS, fixed.UNSAFE_ENDPOINT, fixed.GENERIC_ENDPOINT)


def component(value: str) -> str:
    cleaned = f"replace(replace({value}, '\"', '\\\"'), chr(10), ' ')"
    return f"regexp_replace({cleaned}, {q(re2(fixed.NAME_MASK))}, '***', 'g')"


DB_CONNECTION_ROWS = f"""
dbc_raw AS ({raw_matches(fixed.DB_CONNECTION_PATTERNS)}),
dbc_ok AS (SELECT project, file_id, pno, mno, {connection('v1')} AS connection FROM dbc_raw WHERE NOT {unsafe('v1', fixed.UNSAFE_CONNECTION)}),
dbc AS ({first_seen('dbc_ok', 'connection')})"""
API_CONNECTION_ROWS = f"""
apc_raw AS ({raw_matches(fixed.API_CONNECTION_PATTERNS)}),
apc_ok AS (SELECT project, file_id, pno, mno, {endpoint('v1')} AS connection FROM apc_raw WHERE NOT {unsafe('v1', fixed.UNSAFE_ENDPOINT)}),
apc AS ({first_seen('apc_ok', 'connection')})"""

NAME = base("relative_path")
ENTRY = (
    f"(lower({NAME}) IN ({words(fixed.ENTRY_NAMES)}) OR "
    + " OR ".join(f"starts_with(lower({NAME}), {q(p)})" for p in fixed.ENTRY_PREFIXES)
    + f" OR regexp_matches(content, {q(any_of(fixed.ENTRY_PATTERNS, re2))}))"
)


def component_type(name: str = f"lower({NAME})") -> str:
    rules = "".join(f" WHEN {has_any(name, ws)} THEN {q(label)}" for ws, label in fixed.COMPONENT_NAME_RULES)
    rules += "".join(f" WHEN {has_any('content', ws)} THEN {q(label)}" for ws, label in fixed.COMPONENT_TEXT_RULES)
    return f"CASE{rules} ELSE 'Component' END"


def shape(part: int) -> str:
    rules = "".join(f" WHEN {has_any('type', ws)} THEN {q(values[part])}" for ws, values in fixed.SHAPE_RULES)
    return f"CASE{rules} ELSE {q(fixed.SHAPE_DEFAULT[part])} END"


PURPOSE = (
    "CASE"
    + "".join(f" WHEN {has_any('content', fixed.PURPOSE_GATE)} AND {has_any('relative_path', ws)} THEN {q(s)}" for ws, s in fixed.PURPOSE_RULES)
    + f" ELSE 'Contains code for ' || {stem('relative_path')} || ' module' END"
)

COMPONENTS = f"""
comps AS (SELECT project, file_id, row_number() OVER (PARTITION BY project ORDER BY file_id) AS idx, {stem('relative_path')} AS name, {component_type()} AS type FROM files),
entries AS (SELECT project, file_id, row_number() OVER (PARTITION BY project ORDER BY file_id) AS idx, {stem('relative_path')} AS name, relative_path AS file FROM files WHERE {ENTRY})"""
CLASSIFIED = "cls AS (SELECT dep.*, EXISTS (SELECT 1 FROM comps c WHERE c.project = dep.project AND c.name = dep.dependency) AS is_internal FROM dep)"
EDGES = """
edge AS (SELECT dep.project, s.idx AS src, t.dst, dep.pos, dep.dependency FROM dep
  JOIN (SELECT project, name, max(idx) AS dst FROM comps GROUP BY ALL) t ON t.project = dep.project AND t.name = dep.dependency
  JOIN comps s ON s.file_id = dep.file_id WHERE s.idx <> t.dst),
loose AS (SELECT * FROM comps c WHERE (contains(type, 'Main') OR contains(type, 'Entry'))
  AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.project = c.project AND e.name = c.name))"""
COUNTS = """
counts AS (SELECT c.project, c.file_id, c.name, c.type, (SELECT count(*) FROM fn WHERE fn.file_id = c.file_id) AS functions,
  (SELECT count(*) FROM cls WHERE cls.file_id = c.file_id AND is_internal) AS internal_deps,
  (SELECT count(*) FROM cls WHERE cls.file_id = c.file_id AND NOT is_internal) AS external_deps FROM comps c)"""
PROJECT_DEPS = """
pdep AS (SELECT *, row_number() OVER (PARTITION BY project, kind ORDER BY first_file_id, first_pos) - 1 AS ord, count(*) OVER (PARTITION BY project, kind) AS n_unique FROM (
  SELECT project, dependency, CASE WHEN bool_or(is_internal) THEN 'internal' ELSE 'external' END AS kind,
         min(file_id) AS first_file_id, arg_min(pos, file_id) AS first_pos FROM cls GROUP BY project, dependency))"""
LINKS = """
links AS (SELECT project, type, name, min(file_id) AS first_file_id, arg_min(pos, file_id) AS first_pos FROM (
  SELECT project, file_id, pos, 'Database' AS type, connection AS name FROM dbc UNION ALL SELECT project, file_id, pos, 'API', connection FROM apc) GROUP BY project, type, name)"""
METRICS = f"""
metrics AS (SELECT project, count(*) AS components,
  CAST(sum((SELECT count(*) FROM fn WHERE fn.file_id = f.file_id)) AS BIGINT) AS total_functions,
  count(*) FILTER (WHERE {ENTRY}) AS entry_points,
  (SELECT count(*) FROM links l WHERE l.project = f.project AND type = 'Database') AS db_connections,
  (SELECT count(*) FROM links l WHERE l.project = f.project AND type = 'API') AS api_connections
  FROM files f GROUP BY project)"""
DRAWN = f"""
drawn AS (SELECT c.project, c.idx, fn.pos AS slot_no, CAST(fn.pos + 1 AS VARCHAR) AS slot, {component('fn.name')} || '()' AS label
    FROM fn JOIN comps c ON c.file_id = fn.file_id WHERE fn.pos < 2
  UNION ALL SELECT project, idx, 2, 'MORE', CAST(functions - 2 AS VARCHAR) || ' more funcs' FROM (
    SELECT c.project, c.idx, count(*) AS functions FROM fn JOIN comps c ON c.file_id = fn.file_id GROUP BY ALL) WHERE functions > 2)"""
ALL_GRAPH = ",".join([FILES, FUNCTION_ROWS, DEPENDENCY_ROWS, COMPONENTS, CLASSIFIED, EDGES, COUNTS, PROJECT_DEPS, DRAWN])
ALL_LINKS = ",".join([DB_CONNECTION_ROWS, API_CONNECTION_ROWS, LINKS])
COMP_LABEL = f"{component('name')} || ' - ' || replace(type, '\"', '\\\"')"

# --- cache, prompts, answers ---------------------------------------------------------------------------

KEY_PATH = "project || '/' || CAST(file_id AS VARCHAR) || '/' || relative_path"
PLACE = (
    "project || '/' || CASE WHEN g % 13 = 0 THEN '_' ELSE '' END || CAST(g AS VARCHAR) || CASE WHEN g % 11 = 0 THEN ':v' ELSE '' END || '/' || "
    f"{dirname('relative_path')} || '/' || {stem('relative_path')} || '-' || CAST(file_id AS VARCHAR) || {raw_ext('relative_path')}"
)
PLACED = f"placed AS (SELECT g, project, relative_path AS inner_path, content, {PLACE} AS relative_path, {PLACE} AS whole_path FROM (SELECT *, file_id % 40 AS g FROM files))"


def ignored_file(top: bool = True) -> str:
    """An ignored folder is final; else the file's own folder decides, then its project, then the top."""
    return f"""(CASE WHEN g % 10 = 0 AND g % 11 <> 0 THEN true
      WHEN g % 7 = 0 AND starts_with(inner_path, 'docs/') THEN true
      WHEN g % 7 = 0 AND regexp_matches(inner_path, '^src/[^/]*[.]py$') THEN false
      WHEN g % 7 = 0 AND ends_with(inner_path, '.js') THEN true
      ELSE ends_with(inner_path, '.py') AND {top} END)"""


SIDE = f"side AS (SELECT *, strlen(content) AS file_size, 1704067200000 + file_id * 1000 AS mtime_ms, {KEY_PATH} AS key_path, md5({KEY_PATH} || '-explain-beginner-stub-stub-1') AS cache_key FROM files)"
SEED = """
seed AS (SELECT cache_key, CASE WHEN file_id % 4 = 2 THEN sha256('stale' || content) ELSE sha256(content) END AS file_hash, file_size,
  mtime_ms + CASE WHEN file_id % 4 = 0 THEN 0 ELSE 60000 END AS mtime_ms, 'cached answer ' || CAST(file_id AS VARCHAR) AS explanation FROM side WHERE file_id % 4 <> 3)"""
LOOKUP = """
looked AS (SELECT s.project, s.file_id, s.cache_key, sha256(s.content) AS file_hash, s.file_size, s.mtime_ms,
  CASE WHEN c.file_size = s.file_size AND c.mtime_ms = s.mtime_ms THEN 'hit'
       WHEN c.file_size = s.file_size AND c.file_hash = sha256(s.content) THEN 'refresh' ELSE 'miss' END AS cache_status,
  c.explanation FROM side s LEFT JOIN seed c ON c.cache_key = s.cache_key)"""
CACHED = ",".join([FILES, SIDE, SEED, LOOKUP])
CACHED_TEXT = "CASE WHEN cache_status <> 'miss' THEN explanation END"


def rendered(template: str, level: str, path: str = "relative_path") -> str:
    """A template as SQL concatenation, cut at its placeholders."""
    values = {"levelDescription": q(level), "language": "language", "filePath": path, "codeContent": "content"}
    pieces, rest = [], template + fixed.PROMPT_SUFFIX
    while rest:
        at = {rest.find("{{" + name + "}}"): name for name in values if "{{" + name + "}}" in rest}
        if not at:
            pieces.append(q(rest))
            break
        first = min(at)
        pieces += [q(rest[:first]), values[at[first]]]
        rest = rest[first + len(at[first]) + 4 :]
    return " || ".join(pieces)


EXPLAIN_PROMPT = rendered(USER_TEMPLATE, fixed.LEVEL_DEFAULT)
SUMMARY_PROMPT = rendered(DEFAULT_TEMPLATES["summary"], fixed.LEVEL_DEFAULT)


def answered(prompt: str, source: str = "described") -> str:
    text = f"'summary of ' || relative_path || ' (' || CAST({tokens('prompt')} AS VARCHAR) || ' tokens)'"
    return f"""
answers AS (SELECT *, CASE WHEN file_id % 50 = 7 THEN 'Error generating explanation: ' || error ELSE answer END AS explanation,
    CASE WHEN error IS NOT NULL THEN 0 ELSE {tokens('answer')} END AS output_tokens FROM (
  SELECT *, {tokens('prompt')} AS input_tokens, {text} AS answer, CASE WHEN file_id % 50 = 7 THEN 'no answer for ' || CAST(file_id AS VARCHAR) END AS error
  FROM (SELECT *, {prompt} AS prompt FROM {source})))"""


EXPLAINED = f"""{CACHED}, {DESCRIBED}, {answered(EXPLAIN_PROMPT)},
explained AS (SELECT a.project, a.file_id, a.relative_path, a.language, l.cache_status <> 'miss' AS cached,
  CASE WHEN l.cache_status = 'miss' THEN a.explanation ELSE l.explanation END AS explanation,
  CASE WHEN l.cache_status = 'miss' THEN a.error END AS error, a.input_tokens, a.output_tokens FROM answers a JOIN looked l ON l.file_id = a.file_id)"""


def preview(value: str, chars: int, suffix: str) -> str:
    return f"CASE WHEN length({value}) > {chars} THEN left({value}, {chars}) || {q(suffix)} ELSE {value} END"


def overview(source: str) -> str:
    """Pieces of the summary document; ``source`` has file rows with a ``summary``."""
    return f"""
listing AS (SELECT *, {dirname('relative_path')} AS dir FROM {source}),
dirs AS (SELECT project, dir, min(file_id) AS dir_first FROM listing GROUP BY ALL),
stack AS (SELECT project, kind, value, row_number() OVER (PARTITION BY project, kind ORDER BY min(file_id)) - 1 AS ord FROM (
   SELECT project, file_id, 'language' AS kind, language AS value FROM {source} UNION ALL SELECT project, file_id, 'extension', {raw_ext('relative_path')} FROM {source}) GROUP BY project, kind, value),
keyed AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file_id) AS rank FROM {source} WHERE {has_any('relative_path', fixed.KEY_FILE_PARTS)}),
projects AS (SELECT DISTINCT project FROM {source}),
pieces AS (
  SELECT project, 0 AS section, 0 AS i, 0 AS j, 0 AS k, {q('# Codebase Summary' + chr(10) * 2 + '## Project Structure' + chr(10) * 2)} AS piece FROM projects
  UNION ALL SELECT project, 1, dir_first, 0, 0, '### ' || CASE WHEN dir = '.' THEN 'Root Directory' ELSE dir END || {q(chr(10) * 2)} FROM dirs
  UNION ALL SELECT l.project, 1, dir_first, 1, file_id, '- **' || {base('relative_path')} || '** (' || language || '): ' || summary || chr(10)
     FROM listing l JOIN dirs d ON d.project = l.project AND d.dir = l.dir
  UNION ALL SELECT project, 1, dir_first, 2, 0, chr(10) FROM dirs
  UNION ALL SELECT project, 2, 0, 0, 0, {q('## Technology Stack' + chr(10) * 2)} FROM projects
  UNION ALL SELECT project, 2, CASE kind WHEN 'language' THEN 1 ELSE 3 END, ord, 0,
     CASE WHEN ord > 0 THEN ', ' WHEN kind = 'language' THEN '- **Languages**: ' ELSE '- **File Types**: ' END || value FROM stack
  UNION ALL SELECT project, 2, 2, 0, 0, chr(10) FROM projects
  UNION ALL SELECT project, 2, 4, 0, 0, {q(chr(10) * 2)} FROM projects
  UNION ALL SELECT project, 3, 0, 0, 0, {q('## Key Files Content' + chr(10) * 2)} FROM projects
  UNION ALL SELECT project, 3, 1, rank, 0, '### ' || relative_path || {q(chr(10) * 2 + '```')} || language || chr(10)
     || {preview('content', 1000, fixed.TRUNCATION_MARK)} || {q(chr(10) + '```' + chr(10) * 2)} FROM keyed WHERE rank <= 5)"""


def numbered_toc(columns: str) -> str:
    return f"SELECT project, row_number() OVER (PARTITION BY project ORDER BY file_id) - 1 AS index, {columns} FROM files"


def sections(source: str, with_source: bool) -> str:
    code = f" || '<pre><code>' || {escape('content')} || '</code></pre>'" if with_source else ""
    return f"""SELECT project, 1 AS section, ord, '<section id="file-' || CAST(ord AS VARCHAR) || '" data-path="' || {escape('relative_path')} || '"><h2>' || {escape('relative_path')}
  || '</h2><span class="badge">' || language || '</span>'{code} || '<div class="explanation">' || coalesce(nullif(explanation, ''), 'No explanation available.') || '</div></section>' AS html
  FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file_id) - 1 AS ord FROM {source})
UNION ALL SELECT DISTINCT project, 0, 0, '<!DOCTYPE html><html><head><title>' || {escape('project')} || '</title></head><body>' FROM {source}
UNION ALL SELECT DISTINCT project, 2, 0, '</body></html>' FROM {source}"""


def bytes_text(value: str, places: int = 2) -> str:
    def scaled(power: int) -> str:
        amount = f"CAST(CAST(round({value} / {float(1024**power)!r}, {places}) AS DECIMAL(30,{places})) AS VARCHAR)"
        amount = f"regexp_replace({amount}, '\\.?0+\\z', '')" if places else amount
        return f"{amount} || ' {fixed.BYTE_UNITS[power]}'"

    cases = "".join(f" WHEN {value} < {1024 ** (p + 1)} THEN {scaled(p) if p else f'CAST({value} AS VARCHAR) || ' + q(' Bytes')}" for p in range(4))
    return f"CASE WHEN {value} = 0 THEN '0 Bytes'{cases} ELSE {scaled(4)} END"


def human_list(items: str) -> str:
    return (
        f"CASE WHEN len({items}) <= 2 THEN array_to_string({items}, ' and ') "
        f"ELSE array_to_string({items}[1:len({items}) - 1], ', ') || ', and ' || {items}[len({items})] END"
    )


def truncated(value: str, limit: int) -> str:
    cut = "'...'" if limit <= 3 else f"left({value}, {limit - 3}) || '...'"
    return f"CASE WHEN length({value}) <= {limit} THEN {value} ELSE {cut} END"


def rewritten(pattern: str, filler: str) -> str:
    """The content with each block replaced by ``filler`` over (body, i); empty bodies stay."""
    p = q(re2(pattern))
    return f"""array_to_string(list_transform(range(0, len(regexp_split_to_array(content, {p}))), lambda i: regexp_split_to_array(content, {p})[i + 1] || coalesce(
   CASE WHEN {strip(f"regexp_extract_all(content, {p}, 1)[i + 1]")} = '' THEN regexp_extract_all(content, {p})[i + 1] ELSE {filler.replace('BODY', strip(f"regexp_extract_all(content, {p}, 1)[i + 1]"))} END, '')), '')"""


DIAGRAM_ID = "'mermaid-diagram-' || left(sha256(CAST(file_id AS VARCHAR) || '-' || CAST({} AS VARCHAR)), 16)"


def block_rows(pattern: str, out: str) -> str:
    return (
        f"blocks AS (SELECT project, file_id, generate_subscripts(l, 1) - 1 AS pos, {strip('unnest(l)')} AS {out} FROM "
        f"(SELECT project, file_id, regexp_extract_all(content, {q(re2(pattern))}, 1) AS l FROM files))"
    )


def merged_stats() -> str:
    m = "CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(json_extract_string(props, '$.k') AS VARCHAR) END"
    return f"SELECT event_id, {m} AS k, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS u, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS size FROM events"


def sql(ctes: str | None, select: str) -> str:
    return f"WITH {ctes}\n{select}" if ctes else select


# what the three ignore rules of the samples mean, last rule first
IGNORED = """CASE WHEN starts_with(relative_path, 'docs/index_0') THEN false WHEN starts_with(relative_path, 'docs/') THEN true
  WHEN contains('/' || relative_path, '/node_modules/') THEN true ELSE false END"""

MODE_OF_FIVE = "['explain', 'issues', 'linebyline', 'summary', 'nosuchmode'][CAST(file_id % 5 AS INT) + 1]"
PROMPT_OF_MODE = "CASE mode " + "".join(
    f"WHEN {q(m)} THEN {rendered(USER_TEMPLATE if m == 'explain' else DEFAULT_TEMPLATES[m], 'an expert developer')} " for m in ("explain", "issues", "linebyline", "summary")
) + f"ELSE {rendered(FALLBACK_TEMPLATE, 'an expert developer')} END"

WORDS = "words AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n]')) AS word FROM documents)"
LABEL = f"nullif(CASE WHEN {strip('word')} = '' THEN '' ELSE translate(word, '<>&', '') END, '')"

ARCH_PROMPT_HEAD, ARCH_PROMPT_TAIL = (DEFAULT_TEMPLATES["architecture"].replace("{{levelDescription}}", fixed.LEVEL_DEFAULT) + fixed.PROMPT_SUFFIX).split("{{codebaseSummary}}")

ORACLE = {
    "describe_files": sql(
        f"{FILES}, {DESCRIBED}",
        f"SELECT file_id, project, relative_path, {base('relative_path')} AS file_name, {stem('relative_path')} AS stem, {dirname('relative_path')} AS dir, "
        f"lower({raw_ext('relative_path')}) AS extension, sha256(content) AS hash, strlen(content) AS size, language FROM described",
    ),
    "included_files": sql(FILES, f"SELECT project, file_id, relative_path FROM files WHERE {included()}"),
    "included_by_segment": sql(FILES, f"SELECT project, file_id, relative_path FROM files WHERE {included('segment')}"),
    "forced_files": sql(FILES, f"SELECT project, file_id, relative_path FROM files WHERE NOT starts_with({base('relative_path')}, {q(fixed.OUTPUT_PREFIX)})"),
    "ignore_rules": sql(FILES, f"SELECT project, file_id, relative_path FROM files WHERE NOT ({IGNORED})"),
    "size_limit": sql(FILES, "SELECT project, file_id, strlen(content) AS size FROM files WHERE strlen(content) <= 4194"),
    "count_files": sql(FILES, f"SELECT project, count(*) AS files FROM files WHERE {included()} GROUP BY project"),
    "language_counts": sql(f"{FILES}, {DESCRIBED}", "SELECT project, language, count(*) AS files FROM described GROUP BY ALL"),
    "primary_language": sql(
        f"{FILES}, {DESCRIBED}",
        "SELECT project, language FROM (SELECT project, language, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, min(file_id) DESC) AS r "
        "FROM described GROUP BY project, language) WHERE r = 1",
    ),
    "tech_stack": sql(
        f"{FILES}, {DESCRIBED}",
        f"SELECT project, kind, value, min(file_id) AS first_file_id, row_number() OVER (PARTITION BY project, kind ORDER BY min(file_id)) - 1 AS ord FROM ("
        f"SELECT project, file_id, 'language' AS kind, language AS value FROM described UNION ALL SELECT project, file_id, 'extension', {raw_ext('relative_path')} FROM described) GROUP BY project, kind, value",
    ),
    "by_directory": sql(
        FILES,
        f"SELECT project, file_id, CASE WHEN dir = '.' THEN 'Root Directory' ELSE dir END AS dir, file_name, count(*) OVER w AS dir_files, min(file_id) OVER w AS dir_first "
        f"FROM (SELECT project, file_id, {dirname('relative_path')} AS dir, {base('relative_path')} AS file_name FROM files) WINDOW w AS (PARTITION BY project, dir)",
    ),
    "key_files": sql(
        FILES,
        f"SELECT * FROM (SELECT project, file_id, relative_path, row_number() OVER (PARTITION BY project ORDER BY file_id) AS rank FROM files "
        f"WHERE {has_any('relative_path', fixed.KEY_FILE_PARTS)}) WHERE rank <= 5",
    ),
    "file_preview": sql(FILES, f"SELECT project, file_id, {preview('content', 1000, fixed.TRUNCATION_MARK)} AS preview, {preview('content', 200, '...')} AS short FROM files"),
    "relative_paths": sql(FILES, f"SELECT project, file_id, relative_path AS below, {base('relative_path')} AS bare FROM files"),
    "offline_results": sql(f"{FILES}, {DESCRIBED}", f"SELECT project, file_id, language, {q(fixed.OFFLINE_FILE)} AS explanation FROM described"),
    "offline_projects": sql(
        FILES,
        f"SELECT DISTINCT project, 'Project Architecture' AS relative_path, 'project-architecture' AS path, 'arch' AS language, {q(fixed.OFFLINE_PROJECT)} AS explanation FROM files",
    ),
    "mode_labels": sql(
        FILES,
        "SELECT project, file_id, ['explain','architecture','architecture','onboarding','flowchart'][CAST(file_id % 5 AS INT) + 1] AS mode, "
        "[NULL,'Project Architecture','Project Architecture','Developer Onboarding','Project Flowchart'][CAST(file_id % 5 AS INT) + 1] AS label, "
        "[NULL,'project-architecture','project-architecture','developer-onboarding','project-flowchart'][CAST(file_id % 5 AS INT) + 1] AS slug FROM files",
    ),
    "batches": sql(FILES, "SELECT project, file_id, (row_number() OVER (PARTITION BY project ORDER BY file_id) - 1) // 3 AS batch FROM files"),
    "progress": sql(
        FILES,
        "SELECT project, file_id, completed, total, CAST(floor(100.0 * completed / total + 0.5) AS BIGINT) AS percent FROM ("
        "SELECT project, file_id, row_number() OVER (PARTITION BY project ORDER BY file_id) AS completed, count(*) OVER (PARTITION BY project) AS total FROM files)",
    ),
    "deduped_paths": sql(
        FILES,
        f"SELECT project, file_id, relative_path, index, CASE WHEN r = 1 THEN relative_path ELSE {dirname('relative_path')} || '/' || {stem('relative_path')} || '_' || CAST(index AS VARCHAR) || {raw_ext('relative_path')} END AS tree_path "
        "FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file_id) - 1 AS index, row_number() OVER (PARTITION BY project, relative_path ORDER BY file_id) AS r FROM files)",
    ),
    "path_tree": sql(
        f"""{FILES}, named AS (SELECT project, file_id, CASE WHEN r = 1 THEN relative_path ELSE {dirname('relative_path')} || '/' || {stem('relative_path')} || '_' || CAST(index AS VARCHAR) || {raw_ext('relative_path')} END AS p
        FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file_id) - 1 AS index, row_number() OVER (PARTITION BY project, relative_path ORDER BY file_id) AS r FROM files)),
        parts AS (SELECT project, file_id, string_split(p, '/') AS l, unnest(range(0, len(string_split(p, '/')))) AS depth FROM named)""",
        "SELECT DISTINCT project, array_to_string(l[1:depth], '/') AS parent, l[depth + 1] AS part, depth, depth = len(l) - 1 AS is_file, CASE WHEN depth = len(l) - 1 THEN file_id END AS file_id FROM parts",
    ),
    "neighbours": sql(
        FILES,
        "SELECT project, file_id, relative_path, lag(file_id) OVER w AS prev_file_id, lead(file_id) OVER w AS next_file_id FROM files WINDOW w AS (PARTITION BY project ORDER BY file_id)",
    ),
    "toc": sql(
        FILES,
        f"SELECT project, index, file_id, {escape('relative_path')} AS title, '<li><a href=\"#file-' || CAST(index AS VARCHAR) || '\">' || {escape('relative_path')} || '</a></li>' AS item "
        f"FROM ({numbered_toc('file_id, relative_path')})",
    ),
    "functions": sql(f"{FILES}, {FUNCTION_ROWS}", "SELECT project, file_id, pos, name FROM fn"),
    "functions_top15": sql(f"{FILES}, {FUNCTION_TYPES}", "SELECT project, file_id, pos, name, type FROM fn_typed WHERE pos < 15"),
    "function_types": sql(f"{FILES}, {FUNCTION_TYPES}", "SELECT project, type, count(*) AS functions FROM fn_typed GROUP BY ALL"),
    "dependencies": sql(f"{FILES}, {DEPENDENCY_ROWS}", "SELECT project, file_id, pos, dependency FROM dep"),
    "dependencies_strict": sql(
        f"{FILES}, {DEPENDENCY_ROWS}",
        "SELECT project, file_id, row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS pos, dependency FROM dep WHERE dependency <> '{'",
    ),
    "databases": sql(f"{FILES}, {DATABASE_ROWS}", "SELECT project, file_id, pos, database FROM db"),
    "apis": sql(f"{FILES}, {API_ROWS}", "SELECT project, file_id, pos, api FROM api"),
    "page_apis": sql(f"{PAGE_FILES}, {API_ROWS}", "SELECT project, file_id, pos, api FROM api"),
    "page_functions": sql(f"{PAGE_FILES}, {FUNCTION_TYPES}", "SELECT project, file_id, pos, name, type FROM fn_typed WHERE pos < 15"),
    "db_connections": sql(f"{FILES}, {DB_CONNECTION_ROWS}", "SELECT project, file_id, pos, connection FROM dbc"),
    "api_connections": sql(f"{FILES}, {API_CONNECTION_ROWS}", "SELECT project, file_id, pos, connection FROM apc"),
    "page_connections": sql(f"{PAGE_FILES}, {API_CONNECTION_ROWS}", "SELECT project, file_id, pos, connection FROM apc"),
    "entry_points": sql(f"{FILES}, {COMPONENTS}", "SELECT project, file_id, name, file FROM entries"),
    "component_types": sql(FILES, f"SELECT project, file_id, {component_type()} AS type, {component_type(q('x'))} AS type_by_text FROM files"),
    "node_shapes": sql(f"{FILES}, {COMPONENTS}", f"SELECT project, file_id, type, {shape(0)} AS shape, {shape(1)} AS opening, {shape(2)} AS closing FROM comps"),
    "purposes": sql(FILES, f"SELECT project, file_id, {PURPOSE} AS purpose FROM files"),
    "dependency_class": sql(ALL_GRAPH, "SELECT project, file_id, pos, dependency, is_internal FROM cls"),
    "internal_deps": sql(ALL_GRAPH, "SELECT project, dependency FROM dep INTERSECT SELECT project, name FROM comps"),
    "external_deps": sql(ALL_GRAPH, "SELECT project, dependency FROM dep EXCEPT SELECT project, name FROM comps"),
    "project_dependencies": sql(ALL_GRAPH, "SELECT project, dependency, kind, first_file_id, first_pos, ord, n_unique FROM pdep"),
    "project_connections": sql(f"{FILES}, {ALL_LINKS}", "SELECT project, type, name, first_file_id, first_pos FROM links"),
    "component_counts": sql(ALL_GRAPH, "SELECT project, file_id, name, type, functions, internal_deps, external_deps FROM counts"),
    "component_summary": sql(
        ALL_GRAPH,
        "SELECT project, idx, CAST(idx AS VARCHAR) || '. **' || name || '** (' || type || ') - ' || CAST(functions AS VARCHAR) || ' functions, ' || CAST(internal_deps AS VARCHAR) || ' internal deps, ' "
        "|| CAST(external_deps AS VARCHAR) || ' external deps' AS line FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file_id) AS idx FROM counts)",
    ),
    "named_entry_points": (
        f"SELECT doc_id, path AS relative_path, lower(name) IN ('index', 'main', 'app', 'program', 'start', 'run', 'init', 'bootstrap') OR starts_with(lower(name), 'main.') "
        f"OR starts_with(lower(name), 'app.') OR starts_with(lower(name), 'index.') AS is_entry "
        f"FROM (SELECT doc_id, name, 'src/' || name AS path FROM (SELECT doc_id, [{words(ENTRY_LIKE_NAMES)}][CAST(doc_id % {len(ENTRY_LIKE_NAMES)} AS INT) + 1] AS name FROM documents))"
    ),
    "own_output_files": sql(
        f"{FILES}, renamed AS (SELECT project, file_id, 'src/' || CASE WHEN file_id % 3 = 0 THEN 'corpusloom-output-' ELSE 'x-' END || {base('relative_path')} AS relative_path FROM files)",
        f"SELECT project, file_id, relative_path FROM renamed WHERE {included()}",
    ),
    "diagram_validity": (
        "SELECT doc_id AS file_id, doc_id % 4 IN (0, 3) OR contains(t, 'flowchart') OR contains(t, 'graph') OR contains(t, 'pie') OR contains(t, 'gantt') OR contains(t, 'journey') AS is_valid "
        "FROM (SELECT doc_id, left(text, 40) AS t FROM documents) WHERE doc_id % 4 <> 2"
    ),
    "hot_key_lookup": (
        "SELECT d.doc_id, d.source, s.good FROM documents d LEFT JOIN (SELECT source, CAST(sum(quality) AS BIGINT) AS good FROM documents JOIN labels USING (doc_id) GROUP BY source) s ON s.source = d.source"
    ),
    "dependency_parts": sql(
        f"{ALL_GRAPH}, parts AS (SELECT project, kind, CAST(floor(ord / 2) AS BIGINT) AS part, string_agg('<code>' || translate(dependency, '<>&', '') || '</code>', ', ' ORDER BY ord) AS body FROM pdep GROUP BY ALL), "
        "sizes AS (SELECT project, kind, count(*) AS n FROM pdep GROUP BY ALL)",
        "SELECT p.project, k.kind, coalesce(d.part, 0) AS part, CASE WHEN d.part IS NULL THEN '**' || upper(left(k.kind, 1)) || k.kind[2:] || ' Dependencies:** None detected' "
        "WHEN d.part = 0 THEN '**' || upper(left(k.kind, 1)) || k.kind[2:] || ' Dependencies (' || CAST(s.n AS VARCHAR) || ' unique):** ' || d.body ELSE ', ' || d.body END AS text "
        "FROM (SELECT DISTINCT project FROM files) p CROSS JOIN (VALUES ('external'), ('internal')) k(kind) "
        "LEFT JOIN parts d ON d.project = p.project AND d.kind = k.kind LEFT JOIN sizes s ON s.project = p.project AND s.kind = k.kind",
    ),
    "dependency_summary": sql(
        ALL_GRAPH,
        "SELECT p.project, k.kind, 0 AS part, CASE WHEN count(d.dependency) = 0 THEN '**' || upper(left(k.kind, 1)) || k.kind[2:] || ' Dependencies:** None detected' "
        "ELSE '**' || upper(left(k.kind, 1)) || k.kind[2:] || ' Dependencies (' || CAST(count(d.dependency) AS VARCHAR) || ' unique):** ' "
        "|| string_agg('<code>' || translate(d.dependency, '<>&', '') || '</code>', ', ' ORDER BY d.ord) END AS text "
        "FROM (SELECT DISTINCT project FROM files) p CROSS JOIN (VALUES ('external'), ('internal')) k(kind) LEFT JOIN pdep d ON d.project = p.project AND d.kind = k.kind GROUP BY p.project, k.kind",
    ),
    "component_edges": sql(ALL_GRAPH, "SELECT project, src, dst, pos, dependency FROM edge"),
    "start_edges": sql(ALL_GRAPH, "SELECT project, 'entry' AS target, idx, name FROM entries UNION ALL SELECT project, 'component', idx, name FROM loose"),
    "graph_nodes": sql(
        ALL_GRAPH,
        f"""SELECT DISTINCT project, 'START' AS node_id, 'START' AS kind, 'Start' AS label, 'ENTRY' AS shape FROM files UNION ALL SELECT DISTINCT project, 'END', 'END', 'End', 'ENTRY' FROM files
        UNION ALL SELECT project, 'ENTRY' || idx, 'ENTRY', {component('name')} || ' (entry point)', 'ENTRY' FROM entries
        UNION ALL SELECT project, 'COMP' || idx, 'COMPONENT', {COMP_LABEL}, {shape(0)} FROM comps
        UNION ALL SELECT project, 'FUNC' || idx || '_' || slot, 'FUNCTION', label, 'DEFAULT' FROM drawn""",
    ),
    "graph_edges": sql(
        ALL_GRAPH,
        """SELECT project, 'START' AS src, 'ENTRY' || idx AS dst, 'start' AS kind FROM entries UNION ALL SELECT project, 'START', 'COMP' || idx, 'start' FROM loose
        UNION ALL SELECT project, 'COMP' || src, 'COMP' || dst, 'dependency' FROM edge UNION ALL SELECT project, 'COMP' || idx, 'FUNC' || idx || '_' || slot, 'function' FROM drawn
        UNION ALL SELECT project, 'COMP' || idx, 'END', 'end' FROM comps""",
    ),
    "graph_text": sql(
        ALL_GRAPH,
        f"""SELECT DISTINCT project, 0 AS section, 0 AS i, 0 AS j, 0 AS k, 'flowchart TD' AS line FROM files UNION ALL SELECT DISTINCT project, 1, 0, 0, 0, '    START[("Start")]' FROM files
        UNION ALL SELECT project, 2, idx, 0, 0, '    ENTRY' || idx || '[("' || {component('name')} || ' (entry point)")]' FROM entries UNION ALL SELECT project, 2, idx, 1, 0, '    START --> ENTRY' || idx FROM entries
        UNION ALL SELECT project, 3, idx, 0, 0, '    COMP' || idx || {shape(1)} || {COMP_LABEL} || {shape(2)} FROM comps UNION ALL SELECT project, 3, idx, 1, 0, '    START --> COMP' || idx FROM loose
        UNION ALL SELECT project, 3, src, 2, pos, 'COMP' || src || ' --> COMP' || dst FROM edge
        UNION ALL SELECT project, 3, idx, 3, slot_no, '    COMP' || idx || ' --> FUNC' || idx || '_' || slot || '["' || label || '"]' FROM drawn
        UNION ALL SELECT DISTINCT project, 4, 0, 0, 0, '    END[("End")]' FROM files UNION ALL SELECT project, 5, idx, 0, 0, '    COMP' || idx || ' --> END' FROM comps""",
    ),
    "project_metrics": sql(f"{FILES}, {FUNCTION_ROWS}, {ALL_LINKS}, {METRICS}", "SELECT * FROM metrics"),
    "architecture_report": sql(
        f"{ALL_GRAPH}, {ALL_LINKS}, {METRICS}, {DESCRIBED}",
        f"""SELECT project, 'overview' AS section, 0 AS ord, '<h1>Project structure (' || upper(language) || ')</h1>' AS html FROM (
           SELECT project, language, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, min(file_id) DESC) AS r FROM described GROUP BY project, language) WHERE r = 1
        UNION ALL SELECT project, 'components', row_number() OVER (PARTITION BY project ORDER BY file_id) - 1, '<tr><td>' || {escape('name')} || '</td><td>' || type || '</td><td>' || functions
           || '</td><td>' || internal_deps || ' int</td><td>' || external_deps || ' ext</td></tr>' FROM counts
        UNION ALL SELECT project, 'dependencies', ord * 2 + CASE kind WHEN 'external' THEN 0 ELSE 1 END, '<span class="' || kind || '"><code>' || translate(dependency, '<>&', '') || '</code></span>' FROM pdep
        UNION ALL SELECT project, 'metrics', n, '<tr><td>' || m || '</td><td>' || v || '</td></tr>' FROM (
           SELECT project, unnest([0, 1, 2, 3, 4]) AS n, unnest(['entry_points', 'db_connections', 'api_connections', 'total_functions', 'components']) AS m,
                  unnest([entry_points, db_connections, api_connections, total_functions, components]) AS v FROM metrics)""",
    ),
    "cache_keys": sql(f"{FILES}, {SIDE}", "SELECT project, file_id, cache_key, md5(key_path || '-issues-undefined-p-undefined') AS partial_key FROM side"),
    "cache_lookup": sql(CACHED, f"SELECT project, file_id, cache_key, file_hash, cache_status, {CACHED_TEXT} AS cached_explanation FROM looked"),
    "cache_lookup_by_metadata": sql(CACHED, f"SELECT project, file_id, cache_status, {CACHED_TEXT} AS cached_explanation FROM looked"),
    "cache_bypass": sql(FILES, "SELECT project, file_id, 'miss' AS cache_status FROM files"),
    "cache_misses": sql(CACHED, "SELECT project, file_id, cache_key, file_hash, file_size, mtime_ms FROM looked WHERE cache_status = 'miss'"),
    "cache_upsert": sql(
        CACHED,
        "SELECT cache_key, file_hash, file_size, mtime_ms, CASE WHEN cache_status = 'miss' THEN 'answer ' || CAST(file_id AS VARCHAR) ELSE explanation END AS explanation FROM looked",
    ),
    "file_prompts": sql(f"{FILES}, {DESCRIBED}", f"SELECT project, file_id, prompt, {tokens('prompt')} AS input_tokens FROM (SELECT *, {EXPLAIN_PROMPT} AS prompt FROM described)"),
    "prompt_modes": sql(
        f"{FILES}, {DESCRIBED}", f"SELECT project, file_id, mode, md5({PROMPT_OF_MODE}) AS prompt_md5 FROM (SELECT *, {MODE_OF_FIVE} AS mode FROM described)"
    ),
    "token_estimates": (
        f"SELECT conv_id, turn, {tokens('text')} AS estimate, coalesce(CASE WHEN turn % 2 = 1 AND conv_id % 3 = 0 THEN conv_id + turn END, CASE WHEN turn % 2 = 1 THEN 5 END, {tokens('text')}) AS with_reported FROM conversations"
    ),
    "infer_stub": sql(
        f"{FILES}, {DESCRIBED}, {answered(EXPLAIN_PROMPT)}", "SELECT project, file_id, explanation, error, 1 AS attempts, input_tokens, output_tokens FROM answers"
    ),
    "map_batches": "SELECT doc_id, strip_accents(text) AS plain FROM documents",
    "answered_only": sql(f"{FILES}, {DESCRIBED}, {answered(EXPLAIN_PROMPT)}", "SELECT project, file_id, explanation FROM answers WHERE error IS NULL"),
    "explain_corpus_stub": sql(EXPLAINED, "SELECT project, file_id, relative_path, language, explanation, cached, error FROM explained"),
    "explain_corpus_cache": sql(
        EXPLAINED,
        "SELECT l.cache_key, l.file_hash, l.file_size, l.mtime_ms, e.explanation FROM explained e JOIN looked l ON l.file_id = e.file_id WHERE l.cache_status = 'refresh' OR (l.cache_status = 'miss' AND e.error IS NULL)",
    ),
    "usage_summary": sql(
        EXPLAINED,
        "SELECT project, CAST(coalesce(sum(input_tokens) FILTER (WHERE NOT cached), 0) AS BIGINT) AS total_input_tokens, CAST(coalesce(sum(output_tokens) FILTER (WHERE NOT cached), 0) AS BIGINT) AS total_output_tokens, "
        "CAST(coalesce(sum(input_tokens + output_tokens) FILTER (WHERE NOT cached AND error IS NULL), 0) AS BIGINT) AS total_tokens, count(*) FILTER (WHERE cached) AS cached_files, "
        "count(*) FILTER (WHERE NOT cached) AS processed_files FROM explained GROUP BY project",
    ),
    "codebase_summary": sql(
        f"{FILES}, {DESCRIBED}, rows_ AS (SELECT *, {PURPOSE} AS summary FROM described), {overview('rows_')}", "SELECT project, section, i, j, k, piece FROM pieces"
    ),
    "attached_summaries": sql(
        f"{FILES}, {DESCRIBED}",
        f"SELECT d.project, d.file_id, coalesce('summary ' || CAST(s.first_id AS VARCHAR), {PURPOSE}) AS summary FROM described d LEFT JOIN ("
        "SELECT project AS sp, relative_path AS sr, min(file_id) AS first_id FROM described WHERE language = 'javascript' GROUP BY ALL) s ON s.sp = d.project AND s.sr = d.relative_path",
    ),
    "project_summaries_stub": sql(
        f"""{FILES}, {DESCRIBED}, {answered(SUMMARY_PROMPT)},
        firsts AS (SELECT project AS sp, relative_path AS sr, arg_min(explanation, file_id) AS summary FROM answers GROUP BY project, relative_path),
        rows_ AS (SELECT d.*, f.summary FROM described d JOIN firsts f ON f.sp = d.project AND f.sr = d.relative_path), {overview('rows_')},
        docs AS (SELECT project, {q(ARCH_PROMPT_HEAD)} || string_agg(piece, '' ORDER BY section, i, j, k) || {q(ARCH_PROMPT_TAIL)} AS prompt FROM pieces GROUP BY project)""",
        f"SELECT project, 'Project Architecture' AS relative_path, 'architecture' AS language, {tokens('prompt')} AS input_tokens, "
        f"'summary of Project Architecture (' || CAST({tokens('prompt')} AS VARCHAR) || ' tokens)' AS explanation FROM docs",
    ),
    "diagram_blocks": sql(
        f"{FILES}, {block_rows(fixed.DIAGRAM_BLOCK, 'code')}",
        f"SELECT project, file_id, pos, code, {DIAGRAM_ID.format('pos')} AS diagram_id, {has_any('code', fixed.DIAGRAM_KINDS)} AS is_valid FROM blocks WHERE code <> ''",
    ),
    "wrapped_diagrams": sql(
        FILES, "SELECT project, file_id, " + rewritten(fixed.DIAGRAM_BLOCK, "'<div class=\"mermaid\" id=\"' || " + DIAGRAM_ID.format("i") + " || '\">' || BODY || '</div>'") + " AS wrapped FROM files"
    ),
    "markdown_blocks": sql(f"{FILES}, {block_rows(fixed.MARKDOWN_BLOCK, 'body')}", "SELECT project, file_id, pos, body FROM blocks WHERE body <> ''"),
    "unwrapped_markdown": sql(FILES, "SELECT project, file_id, " + rewritten(fixed.MARKDOWN_BLOCK, "BODY") + " AS unwrapped FROM files"),
    "html_tables": sql(
        f"{FILES}, t AS (SELECT project, file_id, content, regexp_extract_all(content, {q(re2(fixed.HTML_TABLE))}) AS l, regexp_split_to_array(content, {q(re2(fixed.HTML_TABLE))}) AS s FROM files)",
        "SELECT project, file_id, array_to_string(list_transform(range(0, len(s)), lambda i: s[i + 1] || CASE WHEN i < len(l) THEN '___TABLE_' || CAST(i AS VARCHAR) || '_PLACEHOLDER___' ELSE '' END), '') AS without_tables, "
        "generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS table_html FROM t",
    ),
    "tables_roundtrip": sql(FILES, f"SELECT project, file_id, true AS same, len(regexp_extract_all(content, {q(re2(fixed.HTML_TABLE))})) AS tables FROM files"),
    "page_titles_plain": f"SELECT page_id, {strip(f'regexp_replace(html, {q(re2(fixed.HTML_TAG))}, {q(str())}, {q(chr(103))})')} AS plain FROM pages",
    "page_paths": f"SELECT page_id, {base('url')} AS base, {dirname('url')} AS dir, lower({raw_ext('url')}) AS ext, {stem('url')} AS stem FROM pages",
    "resolved_imports": sql(
        f"""{FILES}, f AS (SELECT project, file_id, regexp_replace(relative_path, 'index_[0-9]', 'index') AS p FROM files),
        g AS (SELECT *, {dirname('p')} AS dir, {stem('p')} AS stem, {base('p')} AS name FROM f),
        named AS (SELECT project, file_id, p, p AS target, 0 AS rank FROM f {''.join(
            f" UNION ALL SELECT project, file_id, p, left(p, length(p) - {len(ext)}), {1 + n} FROM f WHERE ends_with(p, '{ext}')"
            f" UNION ALL SELECT project, file_id, p, {dirname('p')}, {1 + len(fixed.IMPORT_EXTENSIONS) + n} FROM f WHERE ends_with(p, '/{fixed.IMPORT_INDEX}{ext}')"
            for n, ext in enumerate(fixed.IMPORT_EXTENSIONS))}),
        best AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY project, target ORDER BY rank, file_id) = 1),
        asked AS (SELECT project, file_id, 0 AS pos, './' || stem AS specifier, dir || '/' || stem AS target FROM g
          UNION ALL SELECT project, file_id, 1, '../web/./' || stem, CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') || '/' ELSE '' END || 'web/' || stem FROM g
          UNION ALL SELECT project, file_id, 2, '../../../out', NULL FROM g UNION ALL SELECT project, file_id, 3, '.', dir FROM g
          UNION ALL SELECT project, file_id, 4, './x/../' || name, p FROM g)""",
        "SELECT a.project, a.file_id, pos, specifier, b.file_id AS target_id, b.p AS target_path FROM asked a LEFT JOIN best b ON b.project = a.project AND b.target = a.target",
    ),
    "path_labels": sql(FILES, f"SELECT project, file_id, 'Report: ' || {base('relative_path')} || ', b.py, ' || project AS label FROM files"),
    "report_sections": sql(
        f"{FILES}, {DESCRIBED}, results AS (SELECT *, CASE WHEN file_id % 3 <> 0 THEN {PURPOSE} END AS explanation FROM described)", sections("results", True)
    ),
    "project_sections": sql(
        f"{FILES}, results AS (SELECT DISTINCT project, 0 AS file_id, 'Project Architecture' AS relative_path, 'architecture' AS language, {q(fixed.OFFLINE_PROJECT)} AS explanation FROM files)",
        sections("results", False),
    ),
    "format_bytes": (
        f"SELECT doc_id, {bytes_text('strlen(text)')} AS bytes, {bytes_text('(strlen(text) * 1000)')} AS larger, {bytes_text('(strlen(text) * 1048576)', 0)} AS rounded, {bytes_text('(doc_id % 2)')} AS tiny FROM documents"
    ),
    "kebab": sql(
        FILES,
        f"SELECT project, file_id, lower(regexp_replace({stem('relative_path')}, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS kebab, upper(left({stem('relative_path')}, 1)) || {stem('relative_path')}[2:] AS capital, "
        "regexp_replace(relative_path, '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g') AS escaped, left(sha256(CAST(file_id AS VARCHAR)), 16) AS unique_id FROM files",
    ),
    "truncated": f"SELECT doc_id, {truncated('text', 100)} AS t100, {truncated('text', 3)} AS t3, {truncated('source', 4)} AS t4 FROM documents",
    "escaped_html": f"SELECT page_id, {escape('html')} AS escaped FROM pages",
    "human_lists": (
        f"SELECT doc_id, {human_list('w')} AS listed, {human_list('w[1:2]')} AS pair, CAST(len(w) AS VARCHAR) || CASE WHEN len(w) = 1 THEN ' word' ELSE ' words' END AS counted "
        "FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)"
    ),
    "event_dates": "SELECT event_id, strftime(ts, '%B %-d, %Y at %I:%M %p') AS shown FROM events",
    "normal_lines": f"SELECT doc_id, {strip('text')} AS unix FROM documents",
    "safe_names": sql(
        WORDS,
        f"SELECT word, NOT {unsafe('word', fixed.INVALID_PACKAGE)} AS package, NOT {unsafe('word', fixed.UNSAFE_FUNCTION)} AS function, NOT {unsafe('word', fixed.UNSAFE_DEPENDENCY)} AS dependency, "
        f"NOT {unsafe('word', fixed.UNSAFE_CONNECTION)} AS connection, NOT {unsafe('word', fixed.UNSAFE_ENDPOINT)} AS endpoint FROM words",
    ),
    "masked_names": sql(
        WORDS,
        f"SELECT word, CASE WHEN {unsafe('word', fixed.UNSAFE_DEPENDENCY)} THEN 'External Module' ELSE word END AS dependency, {connection('word')} AS connection, {endpoint('word')} AS endpoint, "
        f"{component('word')} AS component, {component('word')} AS function, {LABEL} AS label FROM words",
    ),
    "secret_masking": f"SELECT doc_id, {component('text')} AS component, {connection('text')} AS connection, {endpoint('text')} AS endpoint FROM documents",
    "overlay_labels": (
        "WITH votes AS (SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), best AS (SELECT source, quality FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, quality DESC) AS r FROM votes) WHERE r = 1) "
        "SELECT d.doc_id, CAST(coalesce(l.quality, b.quality, 0) AS BIGINT) AS value, CAST(CASE WHEN l.quality IS NOT NULL THEN 3 WHEN b.quality IS NOT NULL THEN 2 ELSE 1 END AS BIGINT) AS layer_priority "
        "FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN best b ON b.source = d.source"
    ),
    "merge_props": merged_stats(),
    "merge_variants": (
        "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS VARCHAR) END AS k, "
        "CASE WHEN event_id % 5 = 0 THEN user_id END AS u, CASE WHEN event_id % 5 IN (0, 2) THEN NULL ELSE 1 END AS n, "
        "event_id % 5 = 0 AS n_is_null, CASE event_id % 5 WHEN 1 THEN '[' || CAST(event_id AS VARCHAR) || ']' WHEN 2 THEN NULL ELSE '[1,2]' END AS list, "
        "CASE WHEN event_id % 5 = 1 THEN '{\"t\":1}' ELSE '\"x\"' END AS tag, "
        "CASE WHEN event_id % 5 = 2 THEN 'flat' ELSE NULL END AS flat FROM events"
    ),
    "merge_structs": (
        "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE event_type END AS a, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS x, value AS y, 'z' AS z FROM events"
    ),
    "scanned_files": sql(
        f"{FILES}, {PLACED}", f"SELECT relative_path, strlen(content) AS file_size, md5(content) AS content_md5 FROM placed WHERE {included()}"
    ),
    "scan_ignored": sql(f"{FILES}, {PLACED}", f"SELECT relative_path, 32 AS file_size, md5(content) AS content_md5 FROM placed WHERE {included()} AND NOT {ignored_file()}"),
    "scan_counts": sql(
        f"{FILES}, {PLACED}, found AS (SELECT * FROM placed WHERE {included()}), below AS (SELECT * REPLACE (substr(relative_path, 6) AS relative_path) FROM placed WHERE project = 'src1')",
        f"SELECT 'all' AS scope, count(*) AS files FROM found WHERE NOT {ignored_file()} UNION ALL "
        f"SELECT 'src1', count(*) FROM below WHERE {included()} AND NOT {ignored_file(False)} UNION ALL SELECT 'missing', 0",
    ),
    "scan_union": sql(
        f"{FILES}, {PLACED}, below AS (SELECT * REPLACE (substr(relative_path, 6) AS relative_path) FROM placed WHERE project = 'src0')",
        f"SELECT whole_path, content, count(*) AS times, count(*) AS ids FROM (SELECT whole_path, md5(content) AS content FROM placed WHERE {included()} "
        f"UNION ALL SELECT whole_path, md5(content) FROM below WHERE {included()}) GROUP BY ALL",
    ),
    "scan_skipped": sql(
        f"{FILES}, {PLACED}", f"SELECT whole_path, strlen(content) AS size FROM placed WHERE strlen(content) > 4194 AND {included()} AND NOT {ignored_file()}"
    ),
    "scan_in_order": sql(
        f"{FILES}, {PLACED}",
        f"SELECT row_number() OVER (ORDER BY encode(relative_path)) - 1 AS file_id, relative_path, md5(content) AS content_md5 FROM placed WHERE {included()}",
    ),
    "decoded_text": "SELECT doc_id, text || chr(65533) || chr(65533) AS decoded FROM documents",
    "loaded_templates": "SELECT CAST(doc_id AS VARCHAR) AS mode, md5(CASE WHEN doc_id % 2 = 0 THEN 'user ' ELSE '' END || text) AS template_md5 FROM documents",
    "written_results": sql(f"{FILES}, {DESCRIBED}", "SELECT project, file_id, relative_path, language FROM described"),
    "written_one_project": sql(
        f"{FILES}, {DESCRIBED}", "SELECT project, file_id, relative_path, CASE WHEN project = 'src1' THEN 'again' ELSE language END AS language FROM described"
    ),
    "written_report": sql(
        f"{FILES}, results AS (SELECT DISTINCT project, 0 AS file_id, 'Project Architecture' AS relative_path, 'architecture' AS language, {q(fixed.OFFLINE_PROJECT)} AS explanation FROM files)",
        f"SELECT project, html AS line FROM ({sections('results', False)})",
    ),
    "written_file_report": sql(
        f"{FILES}, {DESCRIBED}, results AS (SELECT *, 'about ' || relative_path AS explanation FROM described)",
        f"SELECT project, unnest(string_split(html, chr(10))) AS line FROM ({sections('results', True)})",
    ),
    "cache_store_latest": sql(
        f"{FILES}, {SIDE}, {SEED}", "SELECT cache_key, CASE WHEN file_size % 2 = 0 THEN 'newer ' ELSE '' END || explanation AS explanation FROM seed"
    ),
    "cache_same_path_projects": (
        "SELECT p AS project, doc_id AS file_id, 'ans ' || p || '/src/' || CAST(doc_id AS VARCHAR) || '.js' AS explanation, true AS cached FROM documents, (VALUES ('a'), ('b')) AS t(p)"
    ),
    "retried_answers": sql(
        FILES,
        "SELECT project, file_id, CASE WHEN file_id % 4 = 3 THEN 'Error generating explanation: busy' ELSE 'answer ' || CAST(file_id AS VARCHAR) END AS explanation, "
        "CASE WHEN file_id % 4 = 3 THEN 'busy' END AS error, least(file_id % 4 + 1, 3) AS attempts FROM files",
    ),
    "resumed_answers": sql(
        FILES,
        "SELECT project, file_id, CASE WHEN file_id % 3 = 0 THEN 'second ' ELSE 'first ' END || md5(content) AS explanation, CAST(NULL AS VARCHAR) AS error, 1 AS attempts FROM files",
    ),
    "infer_odd_replies": sql(
        f"{FILES}, kinds(k, reason, text, reported, tokens) AS (VALUES (0, 'NoneType', NULL, NULL, 0), (1, 'dict', NULL, NULL, 0), (2, 'int', NULL, NULL, 0), (3, 'dict', NULL, NULL, 0), "
        "(4, NULL, 'ok', NULL, 1), (5, NULL, 'sur?rogate', 9, 9), (6, NULL, 'plain', NULL, 2))",
        "SELECT project, file_id, coalesce(text, 'Error generating explanation: the reply has no text: ' || reason) AS explanation, 'the reply has no text: ' || reason AS error, "
        "CAST(reported AS BIGINT) AS reported_tokens, CAST(tokens AS BIGINT) AS output_tokens FROM files JOIN kinds ON k = file_id % 7",
    ),
    "report_same_ids": sql(
        f"{FILES}, {DESCRIBED}, results AS (SELECT * REPLACE (p AS project, p || content AS content), p || ' says ' || CAST(file_id AS VARCHAR) AS explanation "
        "FROM described, (VALUES ('a'), ('b')) AS t(p))",
        sections("results", True),
    ),
    "observed_progress": sql(EXPLAINED, "SELECT count(*) AS completed, count(error) AS failed, count(*) FILTER (WHERE cached) AS cached FROM explained"),
    "project_summaries_rounds": sql(
        f"""{FILES}, {DESCRIBED}, {answered(SUMMARY_PROMPT)},
        firsts AS (SELECT project AS sp, relative_path AS sr, arg_min(explanation, file_id) AS summary FROM answers GROUP BY project, relative_path),
        lines AS (SELECT d.project, '- **' || {base('relative_path')} || '** (' || language || '): ' || f.summary || chr(10) AS line
          FROM described d JOIN firsts f ON f.sp = d.project AND f.sr = d.relative_path)""",
        f"SELECT project, CASE WHEN sum({tokens('line')}) <= {ROUND_TOKENS} OR count(*) = 1 THEN 1 ELSE 2 END AS rounds, 0 AS failed_parts, true AS answered FROM lines GROUP BY project",
    ),
    "stream_progress": sql(
        FILES, "SELECT count(*) AS completed, count(*) FILTER (WHERE file_id % 5 = 0) AS failed, count(*) FILTER (WHERE file_id % 7 = 0) AS cached FROM files GROUP BY file_id % 3"
    ),
    "stream_results": sql(EXPLAINED, "SELECT project, file_id, relative_path, language, explanation, cached, error FROM explained"),
    "stream_cache": sql(
        f"""{EXPLAINED}, fresh AS (SELECT l.cache_key, l.file_hash, l.file_size, l.mtime_ms, e.explanation FROM explained e JOIN looked l ON l.file_id = e.file_id
          WHERE l.cache_status = 'refresh' OR (l.cache_status = 'miss' AND e.error IS NULL))""",
        "SELECT * FROM fresh UNION ALL SELECT cache_key, file_hash, file_size, mtime_ms, explanation FROM seed WHERE cache_key NOT IN (SELECT cache_key FROM fresh)",
    ),
    "stream_usage": sql(
        f"{FILES}, {DESCRIBED}, keyed_rows AS (SELECT * REPLACE ({KEY_PATH} AS relative_path) FROM described), {answered(EXPLAIN_PROMPT, 'keyed_rows')}",
        "SELECT project, count(*) AS files, 0 AS cached_files, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM answers GROUP BY project",
    ),
}
