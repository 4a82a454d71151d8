"""Registry of queries with their DuckDB counterparts, and the inputs both sides share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlstrata import fixtures as X
from sqlstrata.functions import patterns as P
from sqlstrata.operators import definitions as D, refs as R, statements as S
from sqlstrata.session import cut
from sqlstrata.sources.corpus import from_query_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query; `sql` is its DuckDB counterpart and may use the relations of CTES by name."""
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = compose(sql)
        return fn
    return add


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return from_query_log(X.query_log(spark, d), "sql", "doc_id", "path")


def stmts(spark: SparkSession, d: str) -> DataFrame:
    return S.statements(X.query_log(spark, d))


def base_refs(spark: SparkSession, d: str) -> DataFrame:
    """References as a stored index table: the text is read once, the joins read the table."""
    return cut(R.base_table_refs(stmts(spark, d)), "refs")


def defs(spark: SparkSession, d: str) -> DataFrame:
    return cut(D.definitions(stmts(spark, d)), "defs")


def stored_stmts(spark: SparkSession, d: str) -> DataFrame:
    return cut(stmts(spark, d), "stmts")


def join_text(df: DataFrame, *cols: str) -> DataFrame:
    """Arrays as text, so that both engines hash the same values."""
    for c in cols:
        df = df.withColumn(c, F.array_join(c, "|", "~"))
    return df


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_NAME = r"""(?:(\w+)\.)?["''`]?(\w+)["''`]?(?:\s+(?:AS\s+)?(\w+))?"""


def _ref_branch(context: str, keyword: str, kind: str) -> str:
    pattern = rf"(?i)\b{keyword}\s+{_NAME}"
    part = lambda g: f"unnest(regexp_extract_all(txt, '{pattern}', {g}))"
    return (f"SELECT doc_id, path, stmt_idx, start_line, sql, '{context}' AS context, '{kind}' AS ref_type, {part(0)} AS m, {part(1)} AS s0, {part(2)} AS n, {part(3)} AS al, "
            f"unnest(range(len(regexp_extract_all(txt, '{pattern}', 0)))) AS pos FROM reftext")


_PLAIN = [("INSERT INTO", r"INSERT\s+INTO", "insert"), ("UPDATE", "UPDATE", "update"), ("DELETE FROM", r"DELETE\s+FROM", "delete"),
          ("FROM", "FROM", "select"), ("JOIN", "JOIN", "join"), ("FROM", r"FROM\s+\w+\s*,", "select"), ("USING", r"DELETE\s+FROM\s+\w+\s+USING", "select")]
_MORE = [("INSERT OVERWRITE TABLE", r"INSERT\s+OVERWRITE\s+TABLE", "insert"), ("MERGE INTO", r"MERGE\s+INTO", "merge"), ("USING", "USING", "select")]


def _refs_sql(branches: str) -> str:
    """Distinct references per statement, the first one's alias kept, with the line of its first appearance."""
    return (
        "SELECT doc_id, path, stmt_idx, CASE WHEN arg_min(s, pos) = '' THEN NULL ELSE arg_min(s, pos) END AS schema_name, arg_min(n, pos) AS table_name, "
        "lower(CASE WHEN min(s) = '' THEN '' ELSE min(s) || '.' END || min(n)) AS table_key, "
        f"arg_min(CASE WHEN al = '' OR lower(al) IN ({quoted(P.NOT_AN_ALIAS)}) THEN '~' ELSE al END, pos) AS alias0, ref_type, arg_min(context, pos) AS context, "
        "arg_min(CASE WHEN instr(lower(sql), lower(m)) = 0 THEN start_line ELSE start_line + len(left(sql, instr(lower(sql), lower(m)) - 1)) "
        "- len(replace(left(sql, instr(lower(sql), lower(m)) - 1), chr(10), '')) END, pos) AS line "
        f"FROM (SELECT *, coalesce(s0, '') AS s FROM ({branches})) WHERE lower(n) NOT IN ({quoted(sorted(set(P.REFERENCE_RESERVED)))}) AND len(n) >= 2 AND NOT regexp_full_match(n, '\\d+') "
        "GROUP BY doc_id, path, stmt_idx, ref_type, lower(s), lower(n)")


# Relations the DuckDB side builds from the same tables, each from the ones it names.
CTES = {
    "qlog": X.QLOG_SQL,
    "dag": X.DAG_SQL,
    "cyclic": X.CYCLIC_SQL,
    # Statement texts: a routine stays whole, anything else is cut at separators outside quotes and comments.
    "pieces": r"""SELECT doc_id, path, kind, a, b, c, unnest(ps) AS p, unnest(range(len(ps))) AS stmt_idx FROM (SELECT *, list_filter(list_transform(
        CASE WHEN sql ILIKE 'create or replace function%' THEN [sql]
             ELSE regexp_extract_all(sql, '(?:''[^'']*''|--[^\n]*|/\*(?:[^*]|\*[^/])*\*/|[^;''])+') END,
        lambda x: x), lambda x: trim(x) <> '') AS ps FROM qlog)""",
    "stmts0": r"""SELECT *, regexp_replace(p, '^\s+|\s+$', '', 'g') AS sql, 1 AS start_line0 FROM pieces""",
    "stmts": r"""SELECT doc_id, path, kind, a, b, c, stmt_idx, 1 AS start_line, 1 + len(sql) - len(replace(sql, chr(10), '')) AS end_line, sql, clean,
        regexp_replace(clean, '''[^'']*''', '''''', 'g') AS masked FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
          regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(sql, '\{\{\s*config\([^)]*\)\s*\}\}', '', 'g'),
          '\{\{\s*ref\(''([^'']+)''\)\s*\}\}', '\1', 'g'), '\{\{\s*source\(''([^'']+)'', ''([^'']+)''\)\s*\}\}', '\1.\2', 'g'),
          '\{%\s*else\s*%\}[^%]*\{%\s*endif\s*%\}', '', 'g'), '\{%[^%]*%\}', '', 'g'),
          '/\*(?:[^*]|\*[^/])*\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), '#[^\n]*', ' ', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM stmts0)""",
    "reftext": r"""SELECT *, regexp_replace(masked, '(?i)\b(extract|substring|trim|position)(\s*\()[^()]*\)', '\1\2)', 'g') AS txt FROM stmts""",
    "refs": _refs_sql(" UNION ALL ".join(_ref_branch(*b) for b in _PLAIN)),
    "refx": _refs_sql(" UNION ALL ".join(_ref_branch(*b) for b in _PLAIN + _MORE)
                      + " UNION ALL SELECT * FROM (" + _ref_branch("INTO", r"INTO", "insert") + ") WHERE NOT regexp_matches(sql, '(?i)^\\s*(?:INSERT|MERGE)\\s+INTO')"),
    # What the templates define, by construction.
    "ctes": """SELECT doc_id, path, 0 AS stmt_idx, v.position, v.cte_name, v.kind = 29 AS is_recursive, 1 AS line FROM qlog q JOIN (VALUES (2, 0, 'src'), (2, 1, 'spare'), (29, 0, 'r'), (43, 0, 'base'))
        v(kind, position, cte_name) ON q.kind = v.kind""",
    "local_names": "SELECT doc_id, 0 AS stmt_idx, cte_name AS n FROM ctes UNION SELECT doc_id, 0, 'u' FROM qlog WHERE kind = 40",
    "brefs": "SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM local_names l WHERE l.doc_id = r.doc_id AND l.stmt_idx = r.stmt_idx AND r.schema_name IS NULL AND l.n = lower(r.table_name))",
    "bxrefs": "SELECT * FROM refx r WHERE NOT EXISTS (SELECT 1 FROM local_names l WHERE l.doc_id = r.doc_id AND l.stmt_idx = r.stmt_idx AND r.schema_name IS NULL AND l.n = lower(r.table_name))",
    "defs": """SELECT doc_id, path, 0 AS stmt_idx, CASE WHEN kind = 5 THEN 'view' ELSE 'table' END AS def_type, CAST(NULL AS VARCHAR) AS schema_name,
        CASE kind WHEN 5 THEN 'v' || b WHEN 6 THEN 't' || c WHEN 36 THEN 't' || b ELSE 'tmp' || b END AS name,
        CASE kind WHEN 5 THEN 'v' || b WHEN 6 THEN 't' || c WHEN 36 THEN 't' || b ELSE 'tmp' || b END AS table_key, 1 AS line, kind IN (36, 39) AS is_ctas FROM qlog WHERE kind IN (5, 6, 36, 39)""",
    "cols": """SELECT q.doc_id, q.path, 't' || q.c AS table_key, v.position, v.column_name, v.data_type, v.nullable, v.primary_key,
        CASE v.position WHEN 2 THEN 't' || a WHEN 3 THEN 'raw.t' || b END AS ref_table, CASE v.position WHEN 2 THEN 'id' WHEN 3 THEN 'w' END AS ref_column FROM qlog q,
        (VALUES (0, 'id', 'INT', false, true), (1, 'v', 'DECIMAL(10,2)', false, false), (2, 'p_id', 'INT', true, false), (3, 'w', 'INT', true, false)) v(position, column_name, data_type, nullable, primary_key)
        WHERE q.kind = 6""",
    # Catalog resolution: exact key, else by name.
    "def_keys": "SELECT DISTINCT table_key AS def_key, CASE WHEN instr(table_key, '.') > 0 THEN substr(table_key, instr(table_key, '.') + 1) ELSE table_key END AS def_name, instr(table_key, '.') > 0 AS has_schema FROM defs",
    "ref_keys": "SELECT DISTINCT table_key AS ref_key, CASE WHEN instr(table_key, '.') > 0 THEN substr(table_key, instr(table_key, '.') + 1) ELSE table_key END AS ref_name FROM brefs",
    "resolution": """SELECT ref_key, def_key, 1 AS tier FROM ref_keys JOIN def_keys ON ref_key = def_key UNION ALL
        SELECT ref_key, def_key, 2 FROM ref_keys JOIN def_keys ON ref_name = def_name AND NOT (instr(ref_key, '.') > 0 AND has_schema) WHERE ref_key NOT IN (SELECT def_key FROM def_keys)""",
    # Lineage by statement: reads x writes, then node ids.
    "io_in": "SELECT DISTINCT doc_id, path, stmt_idx, table_key FROM brefs WHERE ref_type IN ('select', 'join')",
    "io_out": "SELECT DISTINCT doc_id, path, stmt_idx, table_key FROM brefs WHERE ref_type IN ('insert', 'update', 'delete') UNION SELECT doc_id, path, stmt_idx, table_key FROM defs WHERE def_type = 'view' OR is_ctas",
    "key_edges": """SELECT i.table_key AS src_key, o.table_key AS dst_key, i.doc_id, i.path, i.stmt_idx FROM io_in i JOIN io_out o ON i.doc_id = o.doc_id AND i.stmt_idx = o.stmt_idx
        WHERE NOT EXISTS (SELECT 1 FROM io_out x WHERE x.doc_id = i.doc_id AND x.stmt_idx = i.stmt_idx AND x.table_key = i.table_key)""",
    "edge_keys": "SELECT src_key AS key FROM key_edges UNION SELECT dst_key FROM key_edges",
    "all_keys": "SELECT key, CASE WHEN instr(key, '.') > 0 THEN substr(key, instr(key, '.') + 1) ELSE key END AS kname FROM edge_keys",
    "node_of": """SELECT key, coalesce((SELECT min(def_type || ':' || table_key) FROM defs WHERE table_key = key), (SELECT min(def_type || ':' || table_key) FROM defs WHERE table_key = kname AND instr(key, '.') > 0), 'external:' || key) AS id FROM all_keys""",
    "flow": """SELECT s.id AS src, d.id AS dst, count(*) AS statements, min(path) AS file_path FROM key_edges e JOIN node_of s ON s.key = src_key JOIN node_of d ON d.key = dst_key WHERE s.id <> d.id GROUP BY 1, 2""",
    "def_nodes": "SELECT def_type || ':' || table_key AS id, def_type AS type, arg_min(name, (path, line, name)) AS name, min(path) AS file_path, count(*) AS definitions, count(DISTINCT path) AS files FROM defs GROUP BY def_type, table_key",
    "col_nodes": """SELECT 'column:' || table_key || '.' || lower(column_name) AS id, 'column' AS type, min(column_name) AS name, 'table:' || table_key AS parent_id, min(data_type) AS data_type,
        arg_min(ref_table, (path, doc_id)) AS ref_table, arg_min(ref_column, (path, doc_id)) AS ref_column FROM cols GROUP BY table_key, lower(column_name)""",
    "ext_nodes": "SELECT DISTINCT id, 'external' AS type, substr(id, 10) AS name FROM (SELECT src AS id FROM flow UNION SELECT dst FROM flow) WHERE id LIKE 'external:%'",
    "cte_nodes": "SELECT 'cte:' || cte_name AS id, 'cte' AS type, cte_name AS name FROM ctes GROUP BY cte_name",
    "nodes": """SELECT id, type, name, CAST(NULL AS VARCHAR) AS parent_id FROM def_nodes UNION ALL SELECT id, type, name, NULL FROM cte_nodes UNION ALL SELECT id, type, name, NULL FROM ext_nodes
        UNION ALL SELECT id, type, name, parent_id FROM col_nodes""",
    # The operator chain of each template's statements, read off the template.
    "chains": "SELECT doc_id, stmt_idx, v.chain, len(string_split(v.chain, '>')) AS ops, v.kind NOT IN (4, 29, 32, 35) AS has_table FROM qlog q JOIN (VALUES (0, 0, 'SELECT>RESULT'), (1, 0, 'JOIN>WHERE>GROUP BY>SELECT>RESULT'), (2, 0, 'SELECT>ORDER BY>LIMIT>RESULT'), (4, 0, 'WHERE'), (5, 0, 'GROUP BY>SELECT>RESULT'), (8, 0, 'SELECT>UNION ALL>RESULT'), (8, 1, 'SELECT>RESULT'), (9, 0, 'CROSS JOIN>WHERE>WINDOW>SELECT>RESULT'), (10, 0, 'CROSS JOIN>JOIN>WHERE>SELECT>RESULT'), (11, 0, 'WHERE>CASE>SELECT>RESULT'), (12, 0, 'GROUP BY>SELECT>RESULT'), (13, 0, 'WINDOW>SELECT>RESULT'), (14, 0, 'WHERE>SELECT>RESULT'), (15, 0, 'WHERE>SELECT>RESULT'), (21, 0, 'SELECT>RESULT'), (23, 2, 'SELECT>RESULT'), (25, 0, 'SELECT>RESULT'), (26, 0, 'GROUP BY>HAVING>SELECT>RESULT'), (27, 0, 'WHERE>SELECT>RESULT'), (28, 0, 'JOIN>SELECT>RESULT'), (29, 0, 'SELECT>RESULT'), (30, 0, 'JOIN>LEFT JOIN>RIGHT JOIN>INNER JOIN>FULL OUTER JOIN>JOIN>SELECT>RESULT'), (31, 0, 'SELECT>UNION>RESULT'), (32, 0, 'WHERE'), (33, 0, 'JOIN>SELECT>RESULT'), (34, 0, 'JOIN>WHERE'), (35, 0, 'WHERE'), (36, 0, 'WHERE>SELECT>RESULT'), (37, 0, 'SELECT>RESULT'), (38, 0, 'WHERE>SELECT>RESULT'), (39, 0, 'SELECT>RESULT'), (40, 0, 'JOIN>SELECT>RESULT'), (41, 0, 'GROUP BY>SELECT>RESULT'), (42, 0, 'JOIN>JOIN>WHERE>SELECT>RESULT'), (43, 0, 'JOIN>JOIN>SELECT>RESULT'), (44, 0, 'WHERE>SELECT>RESULT'), (45, 0, 'WHERE>SELECT>RESULT'), (46, 0, 'WHERE>SELECT>RESULT'), (47, 0, 'SELECT>RESULT'), (49, 0, 'WHERE>SELECT>RESULT')) v(kind, stmt_idx, chain) ON q.kind = v.kind",
    "edges": "SELECT src, dst, 'flow' AS relationship FROM flow UNION ALL SELECT parent_id, id, 'contains' FROM col_nodes",
}


def _uses(sql: str) -> list[str]:
    bare = re.sub(r"'(?:[^']|'')*'", "''", sql)
    return [n for n in CTES if re.search(rf"(?<![\w.']){n}\b(?!\s*\()", bare)]


def compose(body: str) -> str:
    """Put the relations a query names, and theirs, in front of it."""
    order: list[str] = []
    def visit(sql: str, stack: tuple[str, ...]) -> None:
        for n in _uses(sql):
            if n not in order and n not in stack:
                visit(CTES[n], stack + (n,))
                order.append(n)
    body = body.strip()
    visit(body, ())
    own = re.match(r"(?is)^WITH\s+(?:RECURSIVE\s+)?", body)
    own_names = set(re.findall(r"(?i)(?:WITH\s+(?:RECURSIVE\s+)?|\),\s*)(\w+)(?:\s*\([^()]*\))?\s+AS\s+(?:MATERIALIZED\s*)?\(", body)) if own else set()
    head = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order if n not in own_names)
    if not head:
        return body
    return f"WITH RECURSIVE {head}, {body[own.end():]}" if own else f"WITH RECURSIVE {head} {body}"
