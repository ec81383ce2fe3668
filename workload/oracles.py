"""The answers of the registered queries as SQL over the plain tables.

They work from column arithmetic, never from the JSON the queries build.
"""

from __future__ import annotations

from .bodies import answer_kind

RULE = "cannot be represented (names must match [A-Za-z_][A-Za-z0-9_.-]*)"
NOT_RECORDS = "response does not describe records (cannot infer a table schema)"


def _values(*rows: str) -> str:
    return "(VALUES " + ", ".join(f"({r})" for r in rows) + ")"


ORACLES: dict[str, str] = {}

# --- screening -----------------------------------------------------------

ORACLES["json_validity"] = f"""
SELECT event_id AS id, form, form IN ('whole', 'listed') AS valid
FROM events, {_values("'whole'", "'cut'", "'trailing'", "'two'", "'listed'", "'bracket'")} t(form)
UNION ALL SELECT page_id, 'html', false FROM pages"""

ORACLES["status_screen"] = """
SELECT event_id, status < 300 AS ok,
       CASE WHEN status < 300 THEN '' ELSE 'request to `/events/' || event_id || '` failed with status ' || status || ': ' || props END AS message
FROM (SELECT *, CASE event_type WHEN 'click' THEN 200 WHEN 'purchase' THEN 204 WHEN 'signup' THEN 301 WHEN 'view' THEN 404 ELSE 500 END AS status FROM events)"""

ORACLES["error_snippets"] = r"""
SELECT doc_id, CASE WHEN regexp_full_match(text, '\s*') THEN '(empty body)' WHEN length(text) > 256 THEN left(text, 256) || '…' ELSE text END AS snippet
FROM documents"""

ORACLES["envelope_detect"] = """
SELECT o_orderkey // 32 AS page, CASE o_orderkey // 32 % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'data' ELSE 'items' END AS name,
       CASE o_orderkey // 32 % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'data' ELSE 'items' END AS envelope, count(*) AS record_count
FROM orders GROUP BY ALL"""

ORACLES["envelope_unwrap"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderkey // 32 AS page,
       row_number() OVER (PARTITION BY o_orderkey // 32 ORDER BY o_orderkey) - 1 AS place
FROM orders"""

_ENDPOINTS = f"""ends AS (
    SELECT source, 'n' || c_nationkey AS endpoint, c_nationkey AS nation, count(*) AS customers, count(DISTINCT page) AS pages,
           {answer_kind("source", "c_nationkey")} AS answer,
           c_nationkey % 6 <> 5 AND source <> 'household' AS was_recorded,
           c_nationkey % 6 <> 5 AND source NOT IN ('household', 'building') AS recorded
    FROM (SELECT lower(c_mktsegment) AS source, c_nationkey, c_custkey // 32 AS page FROM customer) GROUP BY source, c_nationkey)"""

ORACLES["records_guard"] = f"""
WITH {_ENDPOINTS} SELECT source, endpoint, answer = 'good' AS is_record, customers AS record_count
FROM ends WHERE answer IN ('good', 'numbers')"""

# --- inference -----------------------------------------------------------

ORACLES["path_stats_events"] = """
SELECT event_type, '' AS path, 'record' AS kind, count(*) AS n FROM events GROUP BY event_type
UNION ALL
SELECT event_type, 'k', CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' ELSE 'other' END AS kind, count(*)
FROM events GROUP BY ALL"""

ORACLES["path_stats_lineitem"] = f"""
SELECT l_returnflag, path, kind, sum(CASE WHEN path = 'refs[].off' THEN CAST(l_discount <> 0 AS BIGINT) ELSE times END)::BIGINT AS n
FROM lineitem, {_values("'', 'record', 1", "'key', 'record', 1", "'key.order', 'int', 1", "'key.line', 'int', 1", "'amounts', 'array', 1",
                        "'amounts[]', 'float', 2", "'refs', 'array', 1", "'refs[]', 'record', 2", "'refs[].id', 'int', 2",
                        "'refs[].off', 'float', 1", "'shipped', 'date', 1")} t(path, kind, times)
GROUP BY ALL HAVING n > 0"""

_ORDER_FIELDS = _values("'', 'record', 'orders'", "'o_orderkey', 'int', 'int'", "'o_custkey', 'int', 'int'", "'o_orderstatus', 'string', 'string'",
                        "'o_totalprice', 'float', 'float'", "'o_orderdate', 'date', 'date'")

ORACLES["node_flatten"] = f"""
SELECT o_orderkey // 32 AS page, path, kind, count(*) AS n FROM orders, {_ORDER_FIELDS} t(path, kind, label) GROUP BY ALL"""

ORACLES["value_kinds"] = f"""
SELECT o_orderkey, form, kind FROM orders, {_values("'int', 'int'", "'point', 'float'", "'exponent', 'float'", "'unsigned', 'int'", "'huge', 'float'",
                                                    "'negative', 'int'", "'text', 'string'", "'bool', 'bool'", "'null', 'null'", "'array', 'array'",
                                                    "'record', 'record'", "'date', 'date'", "'datetime', 'datetime'")} t(form, kind)"""

ORACLES["iso_kinds"] = f"""
SELECT event_id, form, form = 'day' AS is_date, form IN ('plain', 'zulu', 'fraction', 'colon', 'short', 'hours', 'low') AS is_datetime,
       form IN ('colon', 'short', 'hours') AS is_offset
FROM events, {_values(*[f"'{f}'" for f in ("day", "plain", "zulu", "fraction", "colon", "short", "hours", "space", "month", "packed", "minutes",
                                           "line", "offset", "dot", "low")])} t(form)"""

ORACLES["infer_events"] = f"""
SELECT DISTINCT event_type, path, label, false AS optional FROM events, {_values("'', 'record'", "'k', 'int'")} t(path, label)"""

ORACLES["infer_optional"] = """
SELECT c_nationkey, 'id' AS path, 'int' AS label, false AS optional FROM customer GROUP BY 1
UNION ALL SELECT c_nationkey, 'bal', 'float', bool_or(c_custkey % 5 = 0) FROM customer GROUP BY 1 HAVING bool_or(c_custkey % 5 <> 0)
UNION ALL SELECT c_nationkey, 'seg', CASE WHEN bool_and(c_custkey % 7 = 0) THEN 'null' ELSE 'string' END,
                 bool_or(c_custkey % 7 = 0) AND bool_or(c_custkey % 7 <> 0) FROM customer GROUP BY 1
UNION ALL SELECT c_nationkey, 'gone', 'null', false FROM customer GROUP BY 1"""

ORACLES["optional_fields"] = """
SELECT 'id' AS path, false AS optional
UNION ALL SELECT 'bal', bool_or(c_custkey % 5 = 0) FROM customer
UNION ALL SELECT 'seg', bool_or(c_custkey % 7 = 0) FROM customer
UNION ALL SELECT 'gone', false"""

ORACLES["infer_union"] = """
SELECT p_brand, CASE WHEN nk IS NULL THEN t WHEN tk IS NULL THEN n WHEN nk < tk THEN n || ' | ' || t ELSE t || ' | ' || n END AS label, false AS optional
FROM (SELECT p_brand, min(p_partkey) FILTER (WHERE p_partkey % 4 IN (0, 3)) AS nk, min(p_partkey) FILTER (WHERE p_partkey % 4 IN (1, 2)) AS tk,
             CASE WHEN bool_or(p_partkey % 4 = 3) THEN 'float' ELSE 'int' END AS n, CASE WHEN bool_or(p_partkey % 4 = 1) THEN 'string' ELSE 'date' END AS t
      FROM part GROUP BY p_brand)"""

ORACLES["infer_null_array"] = """
WITH firsts AS (
    SELECT s_nationkey, 'null' AS kind, min(CASE s_suppkey % 3 WHEN 1 THEN s_suppkey * 10 WHEN 2 THEN s_suppkey * 10 + 1 END) AS first_at FROM supplier GROUP BY 1
    UNION ALL SELECT s_nationkey, 'float', min(CASE s_suppkey % 3 WHEN 1 THEN s_suppkey * 10 + 1 END) FROM supplier GROUP BY 1
    UNION ALL SELECT s_nationkey, 'string', min(CASE s_suppkey % 3 WHEN 2 THEN s_suppkey * 10 END) FROM supplier GROUP BY 1)
SELECT s_nationkey, coalesce('(' || string_agg(kind, ' | ' ORDER BY first_at) FILTER (WHERE first_at IS NOT NULL) || ')[]', 'unknown[]') AS label
FROM firsts GROUP BY 1"""

ORACLES["infer_nested"] = f"""
SELECT l_returnflag, path, label, path = 'refs[].off' AS optional
FROM lineitem, {_values("'', 'line'", "'key', 'key'", "'key.order', 'int'", "'key.line', 'int'", "'amounts', 'float[]'", "'amounts[]', 'float'",
                        "'refs', 'refs[]'", "'refs[]', 'refs'", "'refs[].id', 'int'", "'refs[].off', 'float'", "'shipped', 'date'")} t(path, label)
WHERE path <> 'refs[].off' OR l_discount <> 0 GROUP BY ALL"""

ORACLES["infer_responses"] = f"""
SELECT 'shop' AS source, 'orders' AS endpoint, path, label, false AS optional
FROM (SELECT DISTINCT 1 FROM orders), {_ORDER_FIELDS} t(path, kind, label)"""

# --- diff ----------------------------------------------------------------

ORACLES["schema_diff"] = """
WITH o AS (SELECT *, 'p' || left(o_orderpriority, 1) AS endpoint, o_orderdate < TIMESTAMP '1998-01-01' AS early FROM orders),
late AS (SELECT endpoint, bool_or(o_custkey % 3 = 0) AS mail, bool_or(o_custkey % 3 <> 0) AS nomail, bool_or(o_orderkey % 2 = 0) AS day,
                bool_or(o_orderkey % 2 = 1) AS noday FROM o WHERE NOT early AND endpoint IN (SELECT endpoint FROM o WHERE early) GROUP BY 1),
c AS (
    SELECT endpoint, '~' AS op, 'id' AS path, 'int' AS was, 'string' AS now FROM late
    UNION ALL SELECT endpoint, '-', 'rush', 'bool', '' FROM late
    UNION ALL SELECT endpoint, '~', 'day', 'date', 'date?' FROM late WHERE day AND noday
    UNION ALL SELECT endpoint, '-', 'day', 'date', '' FROM late WHERE NOT day
    UNION ALL SELECT endpoint, '+', 'buyer.state', '', 'string' FROM late
    UNION ALL SELECT endpoint, '+', 'note', '', CASE WHEN nomail THEN 'string?' ELSE 'string' END FROM late WHERE mail)
SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY path = 'note', path) AS place, op || ' ' || path || ': ' || CASE op WHEN '~' THEN was || ' -> ' || now ELSE was || now END AS line FROM c"""

ORACLES["diff_nested_suppressed"] = f"""
SELECT DISTINCT lower(c_mktsegment) AS endpoint, line FROM customer, {_values("'~ c.addr: addr -> string'", "'~ tags[]: int -> string'")} t(line)"""

ORACLES["fingerprints"] = """
SELECT min('n' || n) AS first_endpoint, count(*) AS endpoints FROM (SELECT DISTINCT c_nationkey AS n FROM customer) GROUP BY n % 3 = 2"""

# --- registry ------------------------------------------------------------

_CONTACTS = """tabs AS (
    SELECT *, count(*) OVER (PARTITION BY source) = 2 AND even AS contested, endpoint = min(endpoint) OVER (PARTITION BY source) AS leads
    FROM (SELECT DISTINCT 's' || c_nationkey % 5 AS source, 'customer' AS endpoint, c_nationkey % 5 % 2 = 0 AS even FROM customer
          UNION SELECT DISTINCT 's' || s_nationkey % 5, 'supplier', s_nationkey % 5 % 2 = 0 FROM supplier)),
recs AS (
    SELECT source, endpoint, 'address' AS path, 'address' AS name, CASE WHEN contested THEN endpoint || '.address' ELSE 'address' END AS record_name, contested OR leads AS declares, even, 1 AS ord FROM tabs
    UNION ALL SELECT source, endpoint, 'home', 'home', 'home', leads, even, 2 FROM tabs
    UNION ALL SELECT source, endpoint, 'home.geo', 'geo', 'geo', leads, even, 3 FROM tabs)"""

ORACLES["record_names"] = f"WITH {_CONTACTS} SELECT source, endpoint, path, record_name, declares FROM recs"
ORACLES["record_declarations"] = f"WITH {_CONTACTS} SELECT source, name, endpoint, path FROM recs WHERE declares"
ORACLES["unqualified_names"] = f"""
WITH {_CONTACTS} SELECT source, endpoint, path, name AS label FROM recs
UNION ALL SELECT source, endpoint, '', endpoint FROM tabs"""

_CONTRACT = f"""{_CONTACTS},
decls AS (
    SELECT t.source, 0 AS part, t.endpoint, 0 AS ord, 'table ' || t.endpoint || E' {{\\n  address: ' || r.record_name || E'\\n  home: home\\n  id: int\\n}}\\n' AS text
    FROM tabs t JOIN recs r ON t.source = r.source AND t.endpoint = r.endpoint AND r.path = 'address'
    UNION ALL
    SELECT source, 1, endpoint, ord, 'record ' || record_name || E' {{\\n' || CASE path
        WHEN 'address' THEN E'  city: string\\n' || CASE WHEN endpoint = 'supplier' AND even THEN '' ELSE E'  zip: int\\n' END
        WHEN 'home' THEN E'  geo: geo\\n' ELSE E'  lat: float\\n' END || E'}}\\n'
    FROM recs WHERE declares),
texts AS (SELECT source, string_agg(text, E'\\n' ORDER BY part, endpoint, ord) AS text FROM decls GROUP BY source)"""

ORACLES["contract_text"] = f"WITH {_CONTRACT} SELECT source, text FROM texts"
ORACLES["contract_line_rows"] = f"""
WITH {_CONTRACT} SELECT source, line AS text, count(*) AS n
FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE line <> '' GROUP BY ALL"""

ORACLES["registry_problems"] = f"""
SELECT DISTINCT p_brand AS endpoint, 'table name `' || p_brand || '` {RULE}' AS problem FROM part WHERE NOT regexp_full_match(p_brand, '[A-Za-z_][A-Za-z0-9_.-]*')
UNION ALL SELECT DISTINCT p_brand, 'field name `part no` {RULE}' FROM part WHERE p_size % 2 = 1
UNION ALL SELECT DISTINCT p_brand, 'record name `int` collides with a primitive type name' FROM part WHERE p_size % 2 = 0
UNION ALL SELECT DISTINCT lower(p_type), 'the top-level type must be a record' FROM part
UNION ALL SELECT DISTINCT lower(p_type), 'table name `' || lower(p_type) || '` {RULE}' FROM part WHERE NOT regexp_full_match(lower(p_type), '[A-Za-z_][A-Za-z0-9_.-]*')"""

ORACLES["registry_roundtrip"] = f"""
WITH {_CONTACTS}, kept AS (SELECT * FROM tabs WHERE NOT (source = 's1' AND endpoint = 'supplier'))
SELECT k.source, k.endpoint, path, CASE WHEN path = '' THEN k.endpoint WHEN path = 'address' AND contested THEN k.endpoint || '.address' ELSE label END AS label, false AS optional
FROM kept k, {_values("'', ''", "'id', 'int'", "'address', 'address'", "'address.city', 'string'", "'address.zip', 'int'", "'home', 'home'",
                      "'home.geo', 'geo'", "'home.geo.lat', 'float'")} t(path, label)
WHERE NOT (path = 'address.zip' AND k.endpoint = 'supplier' AND even)"""

ORACLES["registry_states"] = f"""
WITH {_ENDPOINTS} SELECT source, CASE WHEN NOT bool_or(was_recorded) THEN 'missing' WHEN source = 'building' THEN 'unreadable' ELSE 'ok' END AS state
FROM ends GROUP BY source"""

# --- jobs ----------------------------------------------------------------

_OUTCOMES = f"""{_ENDPOINTS}, outs AS (
    SELECT *, CASE answer WHEN 'empty' THEN 'no_records' WHEN 'good' THEN 'inferred' ELSE 'failed' END AS outcome,
           answer = 'empty' AND recorded AS kept_schema,
           CASE answer WHEN 'busy' THEN 'request to `' || endpoint || '` failed with status 503: busy'
                WHEN 'lost' THEN 'request to `' || endpoint || '` failed with status unknown: cut off'
                WHEN 'html' THEN 'response is not valid JSON (content type: text/html)' WHEN 'numbers' THEN '{NOT_RECORDS}' ELSE '' END AS detail
    FROM ends)"""

ORACLES["introspect_outcomes"] = f"""
WITH {_OUTCOMES} SELECT source, endpoint, nation AS ordinal, outcome, CASE outcome WHEN 'inferred' THEN customers ELSE -1 END AS record_count, kept_schema, detail FROM outs"""

ORACLES["carry_forward"] = f"""
WITH {_OUTCOMES} SELECT source, endpoint, path, CASE WHEN kept_schema AND nation % 4 = 1 AND path = 'c_acctbal' THEN 'string' ELSE label END AS label
FROM outs, {_values("'c_custkey', 'int'", "'c_name', 'string'", "'c_acctbal', 'float'")} t(path, label) WHERE outcome = 'inferred' OR kept_schema"""

ORACLES["publish_gate"] = f"""
WITH {_OUTCOMES} SELECT source, bool_and(outcome <> 'failed') AS clean, count(*) FILTER (WHERE outcome = 'inferred' OR kept_schema) AS tables, clean AND tables > 0 AS publish
FROM outs GROUP BY source"""

# Of the two segments that never fail, one has a table name that cannot be written.
ORACLES["publish_registry"] = f"""
WITH {_OUTCOMES}, gate AS (
    SELECT source, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'inferred' OR kept_schema) AS tables, count(*) AS n FROM outs GROUP BY source)
SELECT source, CASE source WHEN 'furniture' THEN n ELSE failed END AS failed,
       CASE source WHEN 'furniture' THEN 'cannot write the types file: table name `n 3` {RULE}' ELSE '' END AS problem,
       CASE WHEN failed = 0 AND source <> 'furniture' THEN tables ELSE 0 END AS tables
FROM gate"""

_STEPS = f"""{_ENDPOINTS},
srcs AS (SELECT source, count(*) AS n FROM ends GROUP BY source),
steps AS (
    SELECT source, '' AS endpoint, 'config' AS step, CASE source WHEN 'furniture' THEN 'failed' ELSE 'passed' END AS outcome,
           CASE source WHEN 'furniture' THEN 'cannot parse' ELSE '' END AS detail FROM srcs
    UNION ALL SELECT source, '', 'endpoints', CASE source WHEN 'furniture' THEN 'skipped' ELSE 'passed' END, CASE source WHEN 'furniture' THEN '' ELSE n::VARCHAR END FROM srcs
    UNION ALL SELECT 'bare', '', 'config', 'passed', '' FROM srcs WHERE source = 'machinery'
    UNION ALL SELECT 'bare', '', 'endpoints', 'failed', 'no endpoints configured' FROM srcs WHERE source = 'machinery'
    UNION ALL
    SELECT source, endpoint, 'connected', CASE WHEN source = 'furniture' THEN 'skipped' WHEN answer IN ('busy', 'html', 'lost') THEN 'failed' ELSE 'passed' END,
           CASE WHEN source = 'furniture' THEN '' WHEN answer = 'busy' THEN 'request to `' || endpoint || '` failed with status 503: busy'
                WHEN answer = 'lost' THEN 'request to `' || endpoint || '` failed with status unknown: cut off'
                WHEN answer = 'html' THEN 'HTTP 200 but the response is not valid JSON (content type: text/html)' ELSE '200, ' || 7 * pages || 'ms' END FROM ends
    UNION ALL
    SELECT source, endpoint, 'contract',
           CASE WHEN source = 'furniture' OR answer IN ('busy', 'html', 'lost') THEN 'skipped' WHEN why IN ('', 'no records sampled') THEN 'passed' ELSE 'failed' END,
           CASE WHEN source = 'furniture' OR answer IN ('busy', 'html', 'lost') THEN '' ELSE why END
    FROM (SELECT *, CASE WHEN source = 'building' THEN 'cannot read the types file: damaged'
                         WHEN answer = 'empty' AND recorded THEN 'no records sampled'
                         WHEN answer = 'empty' THEN 'nothing to verify: no records sampled, and no table recorded for `' || endpoint || '` yet'
                         WHEN source = 'household' THEN 'no types file; introspect `household` to record the contract'
                         WHEN NOT recorded THEN 'table `' || endpoint || '` is missing from the types file; introspect `' || source || '` to update it'
                         WHEN answer = 'numbers' THEN '{NOT_RECORDS}'
                         WHEN nation % 4 = 1 THEN '~ c_acctbal: string -> float' ELSE '' END AS why FROM ends))"""

ORACLES["contract_steps"] = f"WITH {_STEPS} SELECT source, endpoint, step, outcome, detail FROM steps"

ORACLES["source_rollup"] = f"""
WITH {_STEPS}, lost AS (SELECT source, count(*) FILTER (WHERE recorded AND nation % 10 = 0) AS unmatched FROM ends GROUP BY source)
SELECT s.source, bool_and(outcome = 'passed') AND coalesce(any_value(unmatched), 0) = 0 AS passed,
       bool_and(outcome = 'passed' OR step = 'contract') AS connected, coalesce(any_value(unmatched), 0) AS unmatched
FROM steps s LEFT JOIN lost l ON s.source = l.source GROUP BY s.source"""

ORACLES["orphan_tables"] = f"WITH {_ENDPOINTS} SELECT source, 'old_' || endpoint AS endpoint FROM ends WHERE recorded AND nation % 10 = 0"

ORACLES["source_connectivity"] = f"WITH {_ENDPOINTS} SELECT source, bool_and(answer NOT IN ('busy', 'html', 'lost')) AS connected FROM ends GROUP BY source"

ORACLES["source_listing"] = f"""
WITH {_ENDPOINTS} SELECT source, 'api' AS kind, 'http://' || source || '/v1' AS url, count(*) AS endpoints, bool_or(recorded) AS types,
       bool_and(answer NOT IN ('busy', 'html', 'lost')) AS connected
FROM ends GROUP BY source"""

# --- rules and URLs ------------------------------------------------------

_ABSOLUTE = "must be a path relative to the base URL, not an absolute URL"

ORACLES["path_violations"] = f"""
SELECT page_id, form, CASE form WHEN 'absolute' THEN '{_ABSOLUTE}' WHEN 'host' THEN 'must not start with `//`, which replaces the host'
       WHEN 'back' THEN 'must not contain backslashes' WHEN 'up' THEN CASE WHEN url LIKE '%?%' OR url LIKE '%#%' THEN '' ELSE 'must not contain `..` segments' END
       ELSE '' END AS problem
FROM pages, {_values(*[f"'{f}'" for f in ("absolute", "host", "path", "up", "back", "query")])} t(form)"""

ORACLES["first_violations"] = f"""
WITH named AS (
    SELECT split_part(url, '/', 3) AS host, page_id, CASE WHEN page_id % 9 = 4 THEN upper(split_part(url, '/', 4)) ELSE split_part(url, '/', 4) || '_' || page_id % 5 END AS name
    FROM pages),
judged AS (
    SELECT *, CASE WHEN page_id % 9 = 4 THEN 'endpoint name may only contain lowercase letters, digits, and underscores'
                   WHEN page_id % 7 = 3 THEN 'path {_ABSOLUTE}'
                   WHEN row_number() OVER (PARTITION BY host, name ORDER BY page_id) > 1 THEN 'duplicate endpoint name' END AS problem FROM named)
SELECT host, page_id, name, problem FROM judged WHERE problem IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1"""

_LINKS = """links AS (
    SELECT page_id, url, u.place - 1 AS place, u.href FROM (
        SELECT page_id, url, unnest(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x, i: {'href': x, 'place': i})) AS u FROM pages))"""

ORACLES["url_join"] = f"""
WITH {_LINKS} SELECT page_id, place, CASE WHEN ltrim(href, '/') = '' THEN base ELSE base || '/' || ltrim(href, '/') END AS joined,
       CASE WHEN ltrim(href, '/') = '' THEN base || '/?x=1' ELSE base || '/' || ltrim(href, '/') END AS slashed
FROM (SELECT *, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || '/' || split_part(url, '/', 4) AS base FROM links)"""

ORACLES["link_scope"] = f"""
WITH {_LINKS} SELECT page_id, place, form, CASE form WHEN 'root' THEN href = '/shop' OR href LIKE '/shop/%' ELSE inside END AS inside
FROM links, {_values("'below', true", "'root', false", "'base', true", "'sibling', false", "'scheme', false", "'host', false", "'port', true",
                     "'other_port', false", "'up', false", "'coded', false", "'query', true")} t(form, inside)"""

ORACLES["link_scope_normalised"] = f"""
WITH {_LINKS} SELECT page_id, place, form, CASE form WHEN 'zero_port' THEN url LIKE 'http:%' ELSE inside END AS inside
FROM links, {_values("'userinfo', false", "'tab_up', false", "'backslash_up', false", "'inner_up', true", "'coded_single', true",
                     "'encoded_host', true", "'backslashes', true", "'padded', true", "'zero_port', NULL")} t(form, inside)"""

ORACLES["quarantine"] = """
SELECT 'supplier-' || s_suppkey AS name, CASE s_suppkey % 8 WHEN 1 THEN 'not valid JSON'
       WHEN 2 THEN 'declared name `xsupplier-' || s_suppkey || '` does not match the file name `supplier-' || s_suppkey || '`'
       WHEN 3 THEN 'not a source definition: `base_url` is missing' WHEN 4 THEN 'not a source definition: `name` is missing'
       WHEN 5 THEN 'endpoint name may only contain lowercase letters, digits, and underscores'
       WHEN 6 THEN 'path `//x` must not start with `//`, which replaces the host' WHEN 7 THEN 'duplicate endpoint name `low`' ELSE 'good' END AS verdict
FROM supplier"""

ORACLES["rest_endpoints"] = """
SELECT s_name AS endpoint, CASE WHEN s_suppkey % 3 = 0 THEN 404 ELSE 200 END AS status, s_suppkey % 3 <> 0 AS ok,
       'http://h' || s_nationkey || '/api/items/' || s_suppkey || ' 0 9' AS body
FROM supplier"""

# --- table sets, typed loads and sum types -------------------------------

ORACLES["ts_join_collapse"] = """
SELECT o_orderkey AS o_o_orderkey, c_name AS c_c_name, c_mktsegment AS c_c_mktsegment, o_totalprice AS o_o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey"""
ORACLES["ts_relate_orphans"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"
ORACLES["ts_extend"] = "SELECT c_custkey, c_name || ' ' || c_mktsegment AS full_name FROM customer"
ORACLES["ts_split"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_totalprice > 250000 THEN 'big' ELSE 'rest' END AS part FROM orders"""
ORACLES["ts_merge"] = """
SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, s_acctbal, 'none' FROM supplier"""
ORACLES["enum_parse"] = "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' ELSE 'none' END AS state FROM orders"
ORACLES["enum_unmatched"] = "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1"
ORACLES["variant_tag"] = """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Titled' WHEN 1 THEN 'Sized' ELSE 'none' END AS tag,
       CASE p_partkey % 3 WHEN 0 THEN p_name ELSE '' END AS title, CASE p_partkey % 3 WHEN 1 THEN p_size ELSE -1 END AS size
FROM part"""
ORACLES["union_conform"] = "SELECT event_id, event_id % 4 IN (0, 1) AS id, event_id % 4 = 3 AS flag FROM events"
ORACLES["typed_load"] = """
SELECT o_orderkey AS id, o_totalprice AS price, CASE WHEN o_orderkey % 10 = 0 THEN 'lost' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
       strftime(o_orderdate + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') AS at, o_custkey AS buyer
FROM orders"""
ORACLES["typed_load_unsigned"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '18446744073709551615' ELSE o_orderkey::VARCHAR END AS wide,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS local, 'wide:decimal(20,0) local:timestamp_ntz' AS kinds FROM orders"""
ORACLES["typed_load_report"] = f"""
SELECT "column", CAST(count(*) * n AS BIGINT) AS present, count(*) FILTER (WHERE dated AND o_orderkey % 10 = 0) AS lost
FROM orders, {_values("'id', 1, false", "'price', 1, false", "'day', 1, true", "'wide', 1, false", "'at', 1, false", "'local', 1, false",
                      "'buyer.id', 1, false", "'buyer.days[]', 2, true")} t("column", n, dated) GROUP BY "column", n"""
ORACLES["ts_load_source"] = """
SELECT 'one_customer' AS name, c_custkey AS id, c_name AS city, c_acctbal AS lat FROM customer WHERE c_nationkey % 5 = 1
UNION ALL SELECT 'one_supplier', s_suppkey, s_name, s_acctbal FROM supplier WHERE s_nationkey % 5 = 1"""
_LEVELS = "(SELECT unnest([12, 140]) AS levels)"
ORACLES["infer_deep"] = f"""
SELECT levels, CAST(0 AS BIGINT) AS depth, '' AS step, 'deep' AS label, false AS optional FROM {_LEVELS}
UNION ALL SELECT levels, d, '.d', 'd', d = 2 FROM {_LEVELS}, range(1, levels + 1) AS t(d)
UNION ALL SELECT levels, levels + 1, '.key', 'int', false FROM {_LEVELS}
UNION ALL SELECT levels, levels + 1, '.who', 'int[]', false FROM {_LEVELS}
UNION ALL SELECT levels, levels + 2, '[]', 'int', false FROM {_LEVELS}
UNION ALL SELECT levels, 2, '.flat', 'string', true FROM {_LEVELS}"""
ORACLES["flatten_deep"] = """
WITH n AS (SELECT count(*) FILTER (WHERE o_orderkey % 2 = 0) AS deep, count(*) FILTER (WHERE o_orderkey % 2 <> 0) AS flat FROM orders)
SELECT CAST(0 AS BIGINT) AS depth, '' AS step, 'record' AS kind, deep + flat AS n FROM n
UNION ALL SELECT d, '.d', 'record', CASE d WHEN 1 THEN deep + flat ELSE deep END FROM n, range(1, 13) AS t(d)
UNION ALL SELECT 2, '.flat', 'string', flat FROM n UNION ALL SELECT 13, '.key', 'int', deep FROM n
UNION ALL SELECT 13, '.who', 'array', deep FROM n UNION ALL SELECT 14, '[]', 'int', deep FROM n"""
ORACLES["infer_nested_array_order"] = """
SELECT o_orderpriority, CASE WHEN min(o_orderkey) % 2 = 0 THEN '(string | int)[][][][]' ELSE '(int | string)[][][][]' END AS label
FROM orders GROUP BY 1"""
