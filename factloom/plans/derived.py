"""More queries with SQL: text functions, linkers, ownership and incremental maintenance over lines and facts made of
the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema, synth
from ..functions import text
from ..graph import FactSet, Graph, GraphError, check_overlay, compact
from ..operators import answers, components, link, lookup, maintain
from ..session import scratch
from .registry import ARCH, ORACLE_SQL, QUERIES, _orders, query
from .workload import ctes, facts, graph, key_of, numbered_facts, referenced_facts, sql, tables

def _case(number: Column, parts: int, *values: Column | str) -> Column:
    """The value with the number's place modulo ``parts``."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, v in enumerate(values):
        out = out.when(number % parts == i, F.lit(v) if isinstance(v, str) else v)
    return out


def _sql_case(number: str, parts: int, *values: str) -> str:
    return f"CASE CAST({number} AS BIGINT) % {parts} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


__all__ = ["ORACLE_SQL", "QUERIES"]

# Text functions


@query(rf"""WITH r AS (SELECT page_id, {_sql_case('page_id', 7, "'src' || chr(92) || 'lib//./f' || page_id", "'/abs/' || page_id", "'C:/d/' || page_id", "'a/../b' || page_id", "'./'", "'x' || chr(7) || page_id", "'a..b/.c/' || page_id")} AS raw FROM pages),
  t AS (SELECT page_id, replace(raw, chr(92), '/') AS p, string_split(replace(raw, chr(92), '/'), '/') AS l FROM r)
  SELECT page_id, CASE WHEN starts_with(p, '/') OR regexp_matches(p, '^[A-Za-z]:') OR regexp_matches(p, '[\x00-\x1f\x7f]') OR list_contains(l, '..') THEN NULL
    ELSE coalesce(nullif(array_to_string(list_filter(l, lambda x: x <> '' AND x <> '.'), '/'), ''), '.') END AS path FROM t""")
def t2_normalize_path(spark, d):
    n = F.col("page_id")
    raw = _case(n, 7, F.concat(F.lit("src\\lib//./f"), n), F.concat(F.lit("/abs/"), n), F.concat(F.lit("C:/d/"), n), F.concat(F.lit("a/../b"), n), "./", F.concat(F.lit("x\x07"), n), F.concat(F.lit("a..b/.c/"), n))
    return tables(spark, d)["pages"].select("page_id", text.normalize_path_col(raw).alias("path"))


@query("SELECT doc_id, CASE WHEN octet_length(b) <= 6000 THEN text ELSE coalesce(try(decode(b[1:6000])), try(decode(b[1:5999])), try(decode(b[1:5998])), try(decode(b[1:5997]))) END AS text FROM (SELECT doc_id, text, encode(text) AS b FROM documents)")
def t5_bounded_bytes(spark, d):
    return tables(spark, d)["documents"].select("doc_id", text.bounded_bytes(F.col("text")).alias("text"))


_ROUTES = [("/api//v1/./{id}/", "/api/v1/{param}"), (":slug/<int:n>", "/{param}/{param}"), ("https://h.example/a/%s?q=1#f", "/a/{param}"), ("res://x/y", ""), ("http://host", ""), ("${base}/api/u/../w/", "/api/w")]


@query(f"""SELECT page_id, route, replace(route, '{{param}}', '{{}}') AS shape FROM (SELECT page_id, CASE CAST(page_id AS BIGINT) % 6 {' '.join(f"WHEN {i} THEN '{b}' || {repr('/k') + ' || page_id' if b else repr('')}" for i, (_, b) in enumerate(_ROUTES))} END AS route FROM pages)""")
def t8_route_shape(spark, d):
    """Each form of route with the page's number as its last part (before a query)."""
    tail = F.concat(F.lit("/k"), F.col("page_id"))
    raw = _case(F.col("page_id"), 6, *(F.concat(F.lit(a.split("?")[0]), tail, F.lit(a[len(a.split("?")[0]) :])) if b else F.lit(a) for a, b in _ROUTES))
    route = text.normalize_route(raw)
    return tables(spark, d)["pages"].select("page_id", route.alias("route"), text.route_shape(route).alias("shape"))


_CALL_LINES = [("x = client.get(url)", "GET", True), ("requests.post_json(u, b)", "POST", True), ("m = METHOD_PUT", "PUT", False), ("fetch(u, {method: 'patch'})", "PATCH", True), ("mux.HandleFunc('/a', get(h))", "GET", False), ("plain line", "", False), ("o.Handler(x).delete(y)", "DELETE", False)]


@query("SELECT page_id, " + _sql_case("page_id", 7, *(f"'{m}'" for _, m, _ in _CALL_LINES)) + " AS method, " + _sql_case("page_id", 7, *(str(c).lower() for *_, c in _CALL_LINES)) + " AS is_call FROM pages")
def t9_http_method(spark, d):
    line = F.concat(_case(F.col("page_id"), 7, *(x for x, *_ in _CALL_LINES)), F.lit(" # "), F.col("page_id"))
    return tables(spark, d)["pages"].select("page_id", text.http_method(line).alias("method"), text.client_call(line).alias("is_call"))


@query("""SELECT p_partkey, array_to_string(list_transform(regexp_split_to_array(lower(replace(p_type, ' ', '_')) || '-x' || p_partkey, '[_-]+'), lambda s: upper(s[1]) || s[2:]), '') AS camel,
  lower(regexp_replace('get' || replace(p_brand, '#', '') || 'Url' || p_partkey || 'Key', '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS kebab, '@signal/' || substr(sha256(p_name), 1, 16) AS synthetic FROM part""")
def t10_names(spark, d):
    snake = F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.lit("-x"), F.col("p_partkey"))
    mixed = F.concat(F.lit("get"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("Url"), F.col("p_partkey"), F.lit("Key"))
    return tables(spark, d)["part"].select("p_partkey", text.camelize(snake).alias("camel"), text.camel_to_kebab(mixed).alias("kebab"), text.synthetic_path("signal", F.col("p_name")).alias("synthetic"))


@query("SELECT page_id, " + _sql_case("page_id", 4, "'services/s' || page_id", "'lib' || page_id", "'repository'", "'services'") + " AS component FROM pages")
def t11_component(spark, d):
    n = F.col("page_id")
    path = _case(n, 4, F.concat(F.lit("./services\\s"), n, F.lit("/a.go")), F.concat(F.lit("././lib"), n, F.lit("/b/c.py")), F.concat(F.lit("/x"), n), "services")
    return tables(spark, d)["pages"].select("page_id", text.component_of(path).alias("component"))


@query("""SELECT c_custkey, lower(lpad(to_hex(list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(regexp_extract_all(hex(encode(c_name)), '..'), lambda x: CAST('0x' || x AS UBIGINT))),
  lambda h, b: CAST((CAST(xor(h, b) AS HUGEINT) * 1099511628211) % 18446744073709551616 AS UBIGINT))), 16, '0')) AS fnv, lower(lpad(to_hex(c_custkey * 7919), 16, '0')) AS hex FROM customer""")
def t12_fnv(spark, d):
    return tables(spark, d)["customer"].select("c_custkey", text.fnv1a64(F.col("c_name")).alias("fnv"), text.hex16(F.col("c_custkey") * 7919).alias("hex"))


@query("SELECT page_id, " + _sql_case("page_id", 4, "'pkg' || page_id", "'a.b' || page_id", "NULL", "'s' || page_id || '.typed'") + " AS module FROM pages")
def t14_module_name(spark, d):
    n = F.col("page_id")
    path = _case(n, 4, F.concat(F.lit("pkg"), n, F.lit("/__init__.py")), F.concat(F.lit("a/b"), n, F.lit(".py")), F.concat(F.lit("a/b"), n, F.lit(".go")), F.concat(F.lit("s"), n, F.lit("/typed.pyi")))
    return tables(spark, d)["pages"].select("page_id", text.module_name(path).alias("module"))


@query("""SELECT p_partkey, 'v = "a//b" ' || repeat(' ', length('// ' || p_name)) || chr(10) || 'w' || p_partkey || repeat(' ', 5) || chr(10) || repeat(' ', 5) || 'z' AS masked FROM part""")
def t16_mask(spark, d):
    """A string that looks like a comment, a line comment and a block comment over two lines."""
    src = F.concat(F.lit('v = "a//b" // '), F.col("p_name"), F.lit("\nw"), F.col("p_partkey"), F.lit("/* a \n b */z"))
    return tables(spark, d)["part"].select("p_partkey", text.mask_comments(src, "slash").alias("masked"))


# Lookups and views


@query(sql("SELECT key, kind, path, name FROM n WHERE path = 'r1/n1' AND kind = 'directory'"))
def f11_show(spark, d):
    return lookup.show(facts(spark, d).nodes, "r1/n1").select(F.col("id").alias("key"), "kind", "path", "name")


@query(sql("SELECT least(x, total) AS \"offset\", total, CASE WHEN least(x, total) + 700 < total THEN least(x, total) + 700 END AS next_offset, greatest(least(total - least(x, total), 700), 0) AS \"rows\" FROM (SELECT count(*) AS total FROM n WHERE kind = 'function'), (VALUES (0), (700), (1000000000)) v(x)"))
def w4_pages(spark, d):
    g, out = graph(spark, d), []
    total = lookup.selected(g, "function").count()
    for x in (0, 700, 1_000_000_000):
        p = lookup.page(total, x, 700)
        out.append((p.offset, p.total, p.next_offset, lookup.list_nodes(g, "function", None, p.offset, 700).count()))
    return spark.createDataFrame(out, "offset long, total long, next_offset long, rows long")


@query(sql(f""", sel AS MATERIALIZED (SELECT node_id FROM n WHERE path = 'r1' OR starts_with(path, 'r1/')),
  ae AS (SELECT src, dst FROM e WHERE relation IN ({ARCH}) AND src IN (FROM sel) AND dst IN (FROM sel)), be AS MATERIALIZED (SELECT src AS x, dst AS y FROM ae UNION SELECT dst, src FROM ae),
  c0(node_id, c) USING KEY (node_id) AS (SELECT node_id, node_id FROM sel UNION (SELECT o.node_id, min(v.c) FROM recurring.c0 o JOIN be ON x = o.node_id JOIN c0 v ON v.node_id = y WHERE v.c < o.c GROUP BY o.node_id)),
  comp AS (SELECT node_id, c AS component FROM c0)
  SELECT component, count(*) AS nodes FROM comp GROUP BY component HAVING count(*) >= 2 ORDER BY nodes DESC, component LIMIT 1000"""))
def g16_architecture(spark, d):
    """The default relations among all nodes below a path."""
    return components.summary(graph(spark, d), "r1", None, 2, 1000)[1].select("component", "nodes")


@query(sql("""SELECT 'view' AS what, count(*) AS rows, sum(CAST(src AS BIGINT) * 7 + dst + code) AS s FROM (SELECT src, dst, code FROM e WHERE NOT (relation = 'references' AND (src + dst) % 5 = 0) UNION ALL SELECT dst, src, 24 FROM e WHERE relation = 'calls' AND (src + dst) % 3 = 0)"""))
def x5_compact(spark, d):
    """An overlay of references and calls, checked, compacted and read again."""
    g = graph(spark, d)
    removed, added = _overlay(g, 5, 3)
    new = compact(g.nodes, g.edges, added, removed, scratch(spark, "compact"))
    return new.agg(F.count("*").alias("rows"), F.sum(F.col("src").cast("long") * 7 + F.col("dst") + F.col("code")).alias("s")).select(F.lit("view").alias("what"), "rows", "s")


def _overlay(g: Graph, drop: int, add: int) -> tuple[DataFrame, DataFrame]:
    removed = g.edges.where((F.col("relation") == "references") & ((F.col("src") + F.col("dst")) % drop == 0))
    added = g.edges.where((F.col("relation") == "calls") & ((F.col("src") + F.col("dst")) % add == 0)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("similar-to").alias("relation"), F.lit(24).cast("short").alias("code"))
    return removed, added


@query("SELECT * FROM (VALUES ('', 'none'), ('removed_missing', 'removed_missing'), ('added_present', 'added_present')) v(expected, code)")
def j7_overlay_rules(spark, d):
    """A good overlay, one that removes what isn't there and one that adds what is: the rule that each breaks."""
    g, out = graph(spark, d), []
    removed, added = _overlay(g, 5, 3)
    for rule, a, r in (("", added, removed), ("removed_missing", added.limit(0), added), ("added_present", removed, removed.limit(0))):
        try:
            check_overlay(g.edges, a, r)
            out.append((rule, "none"))
        except GraphError as err:
            out.append((rule, err.code))
    return spark.createDataFrame(out, "expected string, code string")


_ASKED = "(SELECT 'functions' AS workload, node_id AS node FROM n WHERE kind = 'function' UNION ALL SELECT 'modules', node_id FROM n WHERE kind = 'module')"


def _visible(drop: int, add: int) -> str:
    return f"(SELECT src, dst FROM e WHERE NOT (relation = 'references' AND (src + dst) % {drop} = 0) UNION ALL SELECT dst, src FROM e WHERE relation = 'calls' AND (src + dst) % {add} = 0)"


@query(sql(" UNION ALL ".join(f"SELECT '{m}' AS mutation, workload, '{way}' AS direction, count(*) AS rows, count(*) AS rebuilt_rows, true AS same FROM {_ASKED} a JOIN {_visible(x, y)} v ON v.{col} = a.node GROUP BY workload" for m, x, y in (("small", 97, 101), ("large", 2, 2)) for way, col in (("outgoing", "src"), ("incoming", "dst")))))
def g24_overlay_equals_rebuild(spark, d):
    """Overlay view against rebuilt graph for two mutations and two workloads of all functions and all modules."""
    g = graph(spark, d)
    made = {m: tuple(reversed(_overlay(g, x, y))) for m, x, y in (("small", 97, 101), ("large", 2, 2))}
    asked = g.nodes.where("kind in ('function', 'module')").select(F.concat("kind", F.lit("s")).alias("workload"), F.col("node_id").alias("node"))
    return synth.compare_overlay(g.nodes, g.edges, made, asked, scratch(spark, "rebuilt"))


# Linkers over lines made of the tables


def _lines(spark, d, *values: Column | str, parts: int) -> DataFrame:
    """One line a page in files of up to 50 pages."""
    n = F.col("page_id").cast("long")
    return tables(spark, d)["pages"].select(F.concat(F.lit("src/f"), F.floor(n / 50), F.lit(".x")).alias("path"), n.alias("line_no"), _case(n, parts, *values).alias("line"))


_PAGE_LINES = "(SELECT 'src/f' || (CAST(page_id AS BIGINT) // 50) || '.x' AS path, CAST(page_id AS BIGINT) AS line_no, CAST(page_id AS BIGINT) % {parts} AS k FROM pages)"
def _n() -> Column:
    return F.col("page_id").cast("long")


@query(f"""SELECT path, line_no, CASE k WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN '*' ELSE 'DELETE' END AS method,
  CASE k WHEN 0 THEN '/api/v' || line_no || '/{{param}}' WHEN 1 THEN '/x/{{param}}/' || line_no WHEN 2 THEN '/plain' || line_no ELSE '/d' || line_no END AS route,
  CASE k WHEN 0 THEN '/api/v' || line_no || '/{{}}' WHEN 1 THEN '/x/{{}}/' || line_no WHEN 2 THEN '/plain' || line_no ELSE '/d' || line_no END AS shape,
  CASE k WHEN 0 THEN 'handle' || line_no WHEN 1 THEN 'bound' || line_no WHEN 2 THEN 'mw' END AS handler, CAST(CASE k WHEN 1 THEN 0.95 WHEN 3 THEN 0.7 ELSE 1.0 END AS DOUBLE) AS confidence
  FROM {_PAGE_LINES.format(parts=5)} WHERE k < 4""")
def m3_routes(spark, d):
    """Four forms of registrations, one of them through a binding, and lines without any."""
    lines = _lines(
        spark, d, F.concat(F.lit('\tr.HandleFunc("GET /api/v'), _n(), F.lit('/{id}", s.handle'), _n(), F.lit(")")), F.concat(F.lit("app.post('/x/:id/"), _n(), F.lit("', var"), _n(), F.lit(")")),
        F.concat(F.lit('mux.Handle("/plain'), _n(), F.lit('", &mw)')), F.concat(F.lit('g.DELETE("/d'), _n(), F.lit('", 7)')), "nothing", parts=5,
    )
    bound = lines.where("line_no % 5 = 1").select("path", F.concat(F.lit("var"), "line_no").alias("variable"), F.concat(F.lit("bound"), "line_no").alias("handler"))
    return link.routes(lines, bound)


_RAILS = (("namespace :api do", None), ("  scope '/v1' do", None), ("    get 'items/N', to: 'items#show'", ("GET", "/api/v1/items/N", "items#show")), ("    resources :things do", None), ("      post :mark", ("POST", "/api/v1/mark", None)), ("    end", None), ("  end", None), ("end", None), ("delete 'root/N' => 'root#gone'", ("DELETE", "/root/N", "root#gone")), ("# get 'no'", None))


@query("SELECT 's' || n_nationkey || '/config/routes.rb' AS path, CAST(i AS INT) AS line_no, method, replace(route, 'N', CAST(n_nationkey AS VARCHAR)) AS route, handler FROM nation, (VALUES " + ", ".join(f"({i}, '{x[0]}', '{x[1]}', {repr(x[2]) if x[2] else 'NULL'})" for i, (_, x) in enumerate(_RAILS) if x) + ") v(i, method, route, handler)")
def m4_rails(spark, d):
    """One routes file a nation, with nested blocks."""
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(_RAILS)], "line_no int, line string")
    lines = tables(spark, d)["nation"].join(rows).select(F.concat(F.lit("s"), "n_nationkey", F.lit("/config/routes.rb")).alias("path"), "line_no", F.replace("line", F.lit("N"), F.col("n_nationkey").cast("string")).alias("line"))
    return link.rails_routes(lines)


@query(f"""SELECT path, line_no, 'fn' || (line_no // 10) || CASE (line_no // 10) % 2 WHEN 0 THEN '_url' ELSE '' END AS owner, CASE k WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE '' END AS method,
  CASE k WHEN 0 THEN '/a/' || line_no ELSE '/b/{{param}}/' || line_no END AS route, CASE k WHEN 0 THEN '/a/' || line_no ELSE '/b/{{}}/' || line_no END AS shape
  FROM (SELECT path, line_no, CASE k WHEN 2 THEN CASE (line_no // 10) % 2 WHEN 0 THEN 2 ELSE 9 END ELSE k END AS k FROM {_PAGE_LINES.format(parts=4)}) WHERE k IN (0, 1, 2)""")
def m5_producers(spark, d):
    """Client calls, and routes that functions named ``*_url`` return; every ten lines are a function."""
    lines = _lines(spark, d, F.concat(F.lit("x = client.get('/a/"), _n(), F.lit("')")), F.concat(F.lit('requests.post("/b/${id}/'), _n(), F.lit('")')), F.concat(F.lit("return '/b/:k/"), _n(), F.lit("'")), "skip", parts=4)
    start = F.floor(F.col("line_no") / 10) * 10
    f = lines.select("path", start.alias("start_line")).distinct().select("path", F.concat(F.lit("fn"), (F.col("start_line") / 10).cast("long"), F.when((F.col("start_line") / 10).cast("long") % 2 == 0, "_url").otherwise("")).alias("owner"), "start_line", F.lit(0).alias("start_column"), (F.col("start_line") + 9).alias("end_line"))
    return link.producers(lines, f)


@query(f"""SELECT coalesce(e.name, h.name) AS name, e.shape, h.handler, h.confidence FROM (SELECT DISTINCT 'GET /k' || (line_no % 30) AS name, '/k' || (line_no % 30) AS shape FROM {_PAGE_LINES.format(parts=1)}) e
  JOIN (SELECT 'GET /k' || (line_no % 30) AS name, 'h' || (line_no % 60) AS handler, CAST(max(CASE WHEN line_no % 2 = 0 THEN 1.0 ELSE 0.7 END) AS DOUBLE) AS confidence FROM {_PAGE_LINES.format(parts=1)} GROUP BY ALL) h ON h.name = e.name""")
def m6_contracts(spark, d):
    n = F.col("line_no")
    found = _lines(spark, d, "x", parts=1).select(F.lit("GET").alias("method"), F.concat(F.lit("/k"), n % 30).alias("route"), F.concat(F.lit("/k"), n % 30).alias("shape"), F.concat(F.lit("h"), n % 60).alias("handler"), F.when(n % 2 == 0, 1.0).otherwise(0.7).alias("confidence"))
    ends, handled = link.http_contracts(found)
    return ends.select("name", "shape").join(handled, "name").select("name", "shape", "handler", "confidence")


@query(f"""SELECT path, line_no, CASE k WHEN 0 THEN 'publishes' ELSE 'consumes' END AS role, CASE k WHEN 1 THEN 'const_chan_' || (line_no % 9) ELSE 'chan_' || line_no END AS channel FROM {_PAGE_LINES.format(parts=4)} WHERE k < 2 OR k = 2""")
def m8_messages(spark, d):
    """Assigned types, and registrations by name and through constants."""
    lines = _lines(spark, d, F.concat(F.lit('msg = {"type": "chan_'), _n(), F.lit('"}')), F.concat(F.lit("bus.register_handler(CHAN_"), _n() % 9, F.lit(", f)")), F.concat(F.lit("on_message('chan_"), _n(), F.lit("', f)")), "skip", parts=4)
    known = spark.range(9).select(F.concat(F.lit("CHAN_"), "id").alias("name"), F.concat(F.lit("const_chan_"), "id").alias("value"))
    return link.messages(lines, known)


@query(f"""SELECT path, line_no, CASE k WHEN 0 THEN 'KEY_' || line_no WHEN 1 THEN 'VALUE_' || (line_no % 9) WHEN 2 THEN 'P_' || line_no WHEN 3 THEN 'R_' || line_no END AS key FROM {_PAGE_LINES.format(parts=5)} WHERE k < 4""")
def m9_config(spark, d):
    lines = _lines(spark, d, F.concat(F.lit('v := os.Getenv("KEY_'), _n(), F.lit('")')), F.concat(F.lit("os.getenv(NAME_"), _n() % 9, F.lit(")")), F.concat(F.lit("process.env.P_"), _n()), F.concat(F.lit("ENV['R_"), _n(), F.lit("']")), "env.other", parts=5)
    known = spark.range(9).select(F.concat(F.lit("NAME_"), "id").alias("name"), F.concat(F.lit("VALUE_"), "id").alias("value"))
    return link.config_reads(lines, known)


@query(f"SELECT path, line_no, 'save' AS what, 'alpha' AS name FROM {_PAGE_LINES.format(parts=3)} WHERE k IN (0, 2) UNION ALL SELECT path, line_no, 'save', 'beta' FROM {_PAGE_LINES.format(parts=3)} WHERE k = 2 UNION ALL SELECT path, line_no, 'invokes-process', 'convert' FROM {_PAGE_LINES.format(parts=3)} WHERE k = 1")
def m10_m11_rules(spark, d):
    """Boundary keys and process rules; a line may hold several."""
    lines = _lines(spark, d, "use alpha", "exec convert --all", "beta before alpha", parts=3)
    keys = link.boundary_keys(lines, ["alpha", "beta"]).select("path", "line_no", F.lit("save").alias("what"), F.col("key").alias("name"))
    rules = link.rule_links(lines, [("exec convert", "invokes-process", "process", "convert"), ("exec other", "invokes-process", "process", "other")])
    return keys.unionByName(rules.select("path", "line_no", F.col("relation").alias("what"), "name"))


@query(sql("SELECT key AS owner, CASE name WHEN 'order_1' THEN 'reads' ELSE 'writes' END AS relation, 'state' || CASE name WHEN 'order_1' THEN 1 ELSE 2 END AS name FROM n WHERE kind = 'function' AND name IN ('order_1', 'order_2')"))
def m12_state(spark, d):
    c = graph(spark, d).nodes.where("kind = 'function'").select(F.col("key").alias("owner"), "name")
    return link.state_roles(c, [("state1", "order_1", "reads"), ("state2", "order_2", "writes"), ("state3", "absent", "reads")])


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def m13_last_wins(spark, d):
    return link.last_wins(tables(spark, d)["events"].select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query(f"""SELECT 'http_' || CASE k WHEN 0 THEN 'linked' WHEN 1 THEN 'missing_target' ELSE 'ambiguous_target' END AS counter, count(*) AS value FROM {_PAGE_LINES.format(parts=3)} GROUP BY k
  UNION ALL SELECT 'message_' || CASE k WHEN 0 THEN 'publishes' ELSE 'consumes' END, count(*) FROM {_PAGE_LINES.format(parts=2)} GROUP BY k UNION ALL SELECT 'config_reads', count(*) FROM pages
  UNION ALL SELECT 'links_' || CASE k WHEN 0 THEN 'reads_config' ELSE 'publishes' END, count(*) FROM {_PAGE_LINES.format(parts=2)} GROUP BY k""")
def a9_linker_summary(spark, d):
    p = tables(spark, d)["pages"]
    http = p.select(_case(_n(), 3, "linked", "missing-target", "ambiguous-target").alias("status"))
    return link.linker_summary(p.select(_case(_n(), 2, "reads-config", "publishes").alias("relation")), http, p.select("page_id"), p.select(_case(_n(), 2, "publishes", "consumes").alias("role")))


@query("""WITH w AS (SELECT DISTINCT 'f' || (p_partkey % 40) AS name, 'services/s' || (p_partkey % 5) || '/w/x.py' AS path FROM part), c AS (SELECT 'f' || (s_suppkey % 60) AS name, 'services/s' || (s_suppkey % 7) || CASE s_suppkey % 3 WHEN 0 THEN '/w/y.py' ELSE '/z.py' END AS cpath, CAST(s_suppkey AS VARCHAR) AS owner FROM supplier),
  s AS (SELECT w.name, path, owner, CASE WHEN split_part(cpath, '/', 2) = split_part(path, '/', 2) THEN 4 ELSE 0 END + CASE WHEN starts_with(cpath, regexp_replace(path, '/[^/]*$', '/')) THEN 2 ELSE 0 END AS score FROM w JOIN c ON c.name = w.name),
  b AS (SELECT name, path, max(score) AS score FROM s GROUP BY ALL)
  SELECT name, path, min(owner) AS owner FROM s JOIN b USING (name, path, score) GROUP BY ALL HAVING count(*) = 1""")
def j10_callable_by_name(spark, d):
    t = tables(spark, d)
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    wanted = t["part"].select(F.concat(F.lit("f"), p % 40).alias("name"), F.concat(F.lit("services/s"), p % 5, F.lit("/w/x.py")).alias("path"))
    c = t["supplier"].select(F.concat(F.lit("f"), s % 60).alias("name"), F.concat(F.lit("services/s"), s % 7, F.when(s % 3 == 0, "/w/y.py").otherwise("/z.py")).alias("path"), s.cast("string").alias("owner"))
    return link.callable_by_name(wanted, c)


# Ownership and incremental maintenance


_SPAN = "named_struct('path', {}, 'start_line', 1L, 'start_column', 0L, 'end_line', 2L, 'end_column', 0L)"


def _owned(spark, d, version: int = 1) -> FactSet:
    """The facts with spans on parts' nodes and on references, and no owners yet."""
    f = referenced_facts(spark, d, version)
    none = F.expr(_SPAN.format("cast(null as string)"))
    n = f.nodes.withColumns({"owner": F.lit(None).cast("string"), "span": F.when(F.col("kind") == "type", F.expr(_SPAN.format("concat('span/', path)"))).otherwise(none)})
    e = f.edges.distinct().withColumns({"owner": F.lit(None).cast("string"), "span": F.when(F.col("relation") == "depends-on", F.expr(_SPAN.format("'span/dep'"))).otherwise(none)})
    u = f.unresolved.distinct().withColumns({"owner": F.lit(None).cast("string"), "span": none})
    return FactSet(n, e, u)


_NODE_OWNER = "CASE WHEN kind = 'type' THEN 'span/' || path WHEN kind NOT IN ('repository', 'directory') AND contains(string_split(path, '/')[-1], '.') THEN path END"


@query(sql(f", o AS (SELECT key, {_NODE_OWNER} AS owner FROM n), w AS (SELECT 'node' AS record, owner FROM o UNION ALL SELECT relation, coalesce(CASE relation WHEN 'depends-on' THEN 'span/dep' END, x.owner, y.owner) FROM re JOIN o x ON x.key = a JOIN o y ON y.key = b UNION ALL SELECT 'unresolved', owner FROM u JOIN n ON n.node_id = source_node_id JOIN o USING (key)) SELECT record, owner, count(*) AS count FROM w GROUP BY ALL"))
def m14_graph_owners(spark, d):
    return _owners(maintain.graph_owners(_owned(spark, d)))


@query(sql(", o AS (SELECT key, CASE WHEN kind = 'type' THEN 'span/' || path WHEN kind = 'file' THEN path END AS owner FROM n), w AS (SELECT 'node' AS record, owner FROM o UNION ALL SELECT relation, coalesce(CASE relation WHEN 'depends-on' THEN 'span/dep' END, x.owner) FROM re JOIN o x ON x.key = a UNION ALL SELECT 'unresolved', owner FROM u JOIN n ON n.node_id = source_node_id JOIN o USING (key)) SELECT record, owner, count(*) AS count FROM w GROUP BY ALL"))
def m15_fact_owners(spark, d):
    return _owners(maintain.fact_owners(_owned(spark, d)))


def _owners(f: FactSet) -> DataFrame:
    parts = [f.nodes.select(F.lit("node").alias("record"), "owner"), f.edges.select(F.col("relation").alias("record"), "owner"), f.unresolved.select(F.lit("unresolved").alias("record"), "owner")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("record", "owner").count()


def _plain(spark, d, version: int) -> FactSet:
    """Facts by references; edges whose source is no node have no owner and go, so they may be in the facts, and
    duplicates may, since the operators make sets of them."""
    f = referenced_facts(spark, d, version, exact=False)
    n = f.nodes.withColumn("owner", F.when(~F.col("kind").isin("repository", "directory"), F.col("path")))
    owner = n.select(F.col("id").alias("source"), "owner")
    return FactSet(n, f.edges.join(owner, "source"), f.unresolved.join(owner, "source"))


#: Both versions' facts; nodes with owners (a function's customer file, a part's own file, none for folders); changed files.
_TWO = f"""WITH {ctes()}, {ctes(" WHERE o_orderkey % 10 <> 0", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'renamed_' || c_name ELSE c_name END", "2")},
  o1 AS (SELECT key, name, CASE WHEN kind NOT IN ('repository', 'directory') THEN path END AS owner FROM n), o2 AS (SELECT key, name, CASE WHEN kind NOT IN ('repository', 'directory') THEN path END AS owner FROM n2),
  ch AS (SELECT DISTINCT path AS owner FROM n WHERE starts_with(path, 'r1/') AND kind NOT IN ('repository', 'directory'))"""


def _changed(owner: Column) -> Column:
    """Whether an owner is one of the files below region 1. Owners are the files of the first version's nodes, whatever
    the version, so the folder says the same as their list, which grows with the tables."""
    return owner.startswith("r1/")


def _records(f: FactSet) -> DataFrame:
    """Nodes and edges, with keys in place of references."""
    n = f.nodes.select(F.lit("node").alias("record"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "name")
    e = f.edges.select(F.col("relation").alias("record"), F.col("source").alias("a"), F.col("target").alias("b"), F.lit(None).cast("string").alias("name"))
    return n.unionByName(e).select("record", key_of(F.col("a")).alias("a"), F.when(F.col("record") == "node", F.col("name")).otherwise(key_of(F.col("b"))).alias("b"))


@query(f"""{_TWO} SELECT 'node' AS record, key AS a, name AS b FROM o1 WHERE owner IS NOT NULL AND owner NOT IN (FROM ch) UNION SELECT 'node', key, name FROM o2 WHERE owner IS NULL OR owner IN (FROM ch)
  UNION ALL (SELECT relation, a, b FROM re JOIN o1 ON o1.key = a WHERE owner IS NOT NULL AND owner NOT IN (FROM ch) UNION SELECT relation, a, b FROM re2 JOIN o2 ON o2.key = a WHERE owner IS NULL OR owner IN (FROM ch))""")
def m16_replace_changed(spark, d):
    return _records(maintain.replace_changed(_plain(spark, d, 1), _plain(spark, d, 2), _changed))


@query(f"""{_TWO}, nn AS (SELECT key, name FROM o1 WHERE owner IS NULL OR owner NOT IN (FROM ch) UNION SELECT key, name FROM o2 WHERE owner IS NULL OR owner IN (FROM ch)),
  ee AS (SELECT relation, a, b FROM re JOIN o1 ON o1.key = a WHERE owner IS NULL OR owner NOT IN (FROM ch) UNION SELECT relation, a, b FROM re2 JOIN o2 ON o2.key = a WHERE owner IS NULL OR owner IN (FROM ch))
  SELECT 'node' AS record, key AS a, name AS b FROM nn UNION ALL SELECT relation, a, b FROM ee WHERE a IN (SELECT key FROM nn) AND b IN (SELECT key FROM nn)""")
def m17_apply_incremental(spark, d):
    """The second version's files below one region, put into the first; shared facts are added to."""
    return _records(maintain.apply_incremental(_plain(spark, d, 1), _plain(spark, d, 2), _changed, [], False))


@query("SELECT CAST(b.doc_id AS VARCHAR) AS owner, b.o AS object_id FROM (SELECT doc_id, sha256(coalesce(text, '')) AS o FROM documents WHERE doc_id % 3 <> 0) a RIGHT JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE sha256(coalesce(text, '')) END AS o FROM documents) b USING (doc_id) WHERE a.o IS DISTINCT FROM b.o")
def m18_changed_objects(spark, d):
    t = tables(spark, d)["documents"].select("doc_id", F.col("doc_id").cast("string").alias("owner"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("object_id"))
    new = t.withColumn("object_id", F.when(F.col("doc_id") % 7 == 0, "new").otherwise(F.col("object_id")))
    return maintain.changed_objects(t.where("doc_id % 3 != 0").drop("doc_id"), new.drop("doc_id"))


@query(sql("SELECT 'removed' AS side, src, dst, relation FROM e WHERE relation = 'references' AND dst % 6 = 1 UNION ALL SELECT 'added', x.node_id, y.node_id, 'communicates-with' FROM n x JOIN n y ON x.name = 'order_1' AND y.kind = 'module'"))
def g19_incremental_compile(spark, d):
    """New facts over the same nodes: some references are gone, and one order talks with every module."""
    g, f = graph(spark, d), numbered_facts(spark, d)
    n = g.numbered
    lost = n.where("node_id % 6 = 1").select(F.col("ref").alias("target_ref")).hint("merge")
    talk = n.where("name = 'order_1'").select(F.col("ref").alias("source_ref")).join(n.where("kind = 'module'").select(F.col("ref").alias("target_ref"))).withColumn("relation", F.lit("communicates-with"))
    stay = f.edges.where("relation = 'references'").join(lost, "target_ref", "left_anti").select("source_ref", "target_ref", "relation")
    new = f.edges.where("relation != 'references'").unionByName(stay).unionByName(talk)
    added, removed = maintain.incremental_compile(g, FactSet(f.nodes, new, f.unresolved))
    return removed.withColumn("side", F.lit("removed")).unionByName(added.withColumn("side", F.lit("added"))).select("side", "src", "dst", "relation")


_DEPS = "SELECT DISTINCT 'o' || (l_orderkey % 500) AS file, 'p' || (l_partkey % 300) AS needs FROM lineitem"


def _deps(spark, d) -> DataFrame:
    return tables(spark, d)["lineitem"].select(F.concat(F.lit("o"), F.col("l_orderkey") % 500).alias("file"), F.concat(F.lit("p"), F.col("l_partkey") % 300).alias("needs")).distinct()


@query(f"WITH d AS ({_DEPS}), em AS (SELECT path FROM (VALUES ('p7'), ('o3')) v(path) UNION SELECT file FROM d WHERE needs IN ('p7', 'o3')) SELECT path, 'emit' AS role FROM em UNION ALL SELECT DISTINCT needs, 'context' FROM d WHERE file IN (FROM em) AND needs NOT IN (FROM em)")
def g20_closure(spark, d):
    deps = _deps(spark, d)
    files = deps.select(F.col("file").alias("path")).unionByName(deps.select(F.col("needs").alias("path"))).distinct()
    return maintain.closure(deps, files, ["p7", "o3"])


@query(sql(f", d AS ({_DEPS}), f AS (SELECT a, b, x.path AS xp, y.path AS yp FROM re JOIN n x ON x.key = a JOIN n y ON y.key = b) SELECT file, needs FROM d WHERE file NOT IN ('o1', 'o2') UNION SELECT xp, yp FROM f WHERE xp <> yp AND xp = (SELECT cpath FROM cu WHERE c_custkey = 7)"))
def m27_dependency_delta(spark, d):
    """Dependencies of two files go, those of another come from its facts."""
    f = referenced_facts(spark, d)
    n = f.nodes.withColumn("owner", F.col("path"))
    e = f.edges.join(n.select(F.col("id").alias("source"), "owner"), "source")
    path = n.where("kind = 'file' and path like '%/c7.cust'").first()["path"]
    return maintain.dependencies_delta(_deps(spark, d), FactSet(n, e, f.unresolved), [path, "o1", "o2"])


@query(sql("SELECT 'outside' AS problem, count(*) AS count FROM re JOIN n ON key = a WHERE relation = 'references' AND starts_with(path, 'r') AND NOT (path = (SELECT cpath FROM cu WHERE c_custkey = 7)) HAVING count(*) > 0 UNION ALL SELECT 'unresolved', count(*) FROM u WHERE reason = 'dynamic-target' HAVING count(*) > 0"))
def m20_unsafe(spark, d):
    """The first scan had no references and no dynamic targets; the next one, of one file, must not find any elsewhere."""
    f = referenced_facts(spark, d)
    n = f.nodes
    owner = n.select(F.col("id").alias("source"), F.col("path").alias("owner"))
    after = FactSet(n, f.edges.join(owner, "source").distinct(), f.unresolved.withColumn("reason", F.when(F.col("reason") == "dynamic-target", "generated-target").otherwise(F.col("reason"))))
    before = FactSet(n, after.edges.where("relation != 'references'"), after.unresolved.where("reason != 'generated-target'"))
    path = n.where("kind = 'file' and path like '%/c7.cust'").first()["path"]
    return maintain.unsafe_topology(before, after, [path]).groupBy("problem").count()


@query("""WITH f AS (SELECT 'pkg' || (p_partkey % 9) || '/m' || p_partkey || '.py' AS path, 'pkg' || (p_partkey % 9) AS pkg, p_partkey AS k FROM part), i AS (SELECT DISTINCT pkg || '/__init__.py' AS path FROM f)
  SELECT path FROM i WHERE path IN ('pkg1/__init__.py', 'pkg2/__init__.py', 'pkg3/__init__.py') UNION SELECT path FROM f WHERE path IN ('pkg2/m11.py', 'pkg3/m12.py', 'pkg1/m19.py')""")
def m28_import_context(spark, d):
    """One root imports a module by name, one member of a package and a sibling."""
    p = F.col("p_partkey")
    f = tables(spark, d)["part"].select(F.concat(F.lit("pkg"), p % 9, F.lit("/m"), p, F.lit(".py")).alias("path"))
    files = f.unionByName(f.select(F.concat(F.substring_index("path", "/", 1), F.lit("/__init__.py")).alias("path")).distinct())
    lines = spark.createDataFrame([("pkg1/m10.py", 1, "import pkg2.m11"), ("pkg1/m10.py", 2, "from pkg3 import m12"), ("pkg1/m10.py", 3, "from . import m19"), ("pkg4/m4.py", 1, "import pkg5.m5")], "path string, line_no int, line string")
    return maintain.import_context(lines, files, ["pkg1/m10.py"])


@query("""WITH f AS (SELECT 'c' || (p_partkey % 6) || '/src/d' || (p_partkey % 4) || '/f' || p_partkey || CASE p_partkey % 2 WHEN 0 THEN '.go' ELSE '.rs' END AS path, p_partkey AS k FROM part)
  SELECT 'go' AS language, path FROM f WHERE starts_with(path, 'c2/src/d0/') UNION ALL SELECT 'rust', path FROM f WHERE starts_with(path, 'c1/') UNION ALL SELECT 'rust', 'c1/Cargo.toml' UNION ALL SELECT 'other', path FROM f WHERE k = 8""")
def m29_analysis_scope(spark, d):
    p = F.col("p_partkey")
    f = tables(spark, d)["part"].select(F.concat(F.lit("c"), p % 6, F.lit("/src/d"), p % 4, F.lit("/f"), p, F.when(p % 2 == 0, ".go").otherwise(".rs")).alias("path"))
    f = f.unionByName(spark.range(6).select(F.concat(F.lit("c"), "id", F.lit("/Cargo.toml")).alias("path")))
    out = None
    for lang, root in (("go", "c2/src/d0/f8.go"), ("rust", "c1/src/d3/f7.rs"), ("other", "c2/src/d0/f8.go")):
        one = maintain.analysis_scope(f, [root], lang).select(F.lit(lang).alias("language"), "path")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{_TWO} SELECT 'node' AS record, count(*) AS count FROM (SELECT key, kind, path, name FROM n UNION SELECT key, kind, path, name FROM n2) UNION ALL SELECT 'edge', count(*) FROM (SELECT a, b, relation FROM re UNION SELECT a, b, relation FROM re2)""")
def x1_union(spark, d):
    f = facts(spark, d, 1).union(facts(spark, d, 2))
    return f.nodes.agg(F.count("*").alias("count")).select(F.lit("node").alias("record"), "count").unionByName(f.edges.agg(F.count("*").alias("count")).select(F.lit("edge").alias("record"), "count"))


@query("""WITH b AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'catch' WHEN 1 THEN 'report' WHEN 2 THEN 'action' ELSE 'other' END AS head FROM conversations), i AS (SELECT DISTINCT conv_id, turn, head FROM b)
  SELECT conv_id || ':' || turn AS id FROM i WHERE head = 'catch' AND conv_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM i j WHERE j.conv_id = i.conv_id AND j.turn = i.turn + 1 AND j.head = 'report')""")
def f15_semantic_rules(spark, d):
    """Turns as behaviour nodes: a catch contains the next turn; only even conversations declare the capability."""
    t = tables(spark, d)["conversations"].select("conv_id", "turn").distinct()
    head = _case(F.col("turn"), 4, "catch", "report", "action", "other")
    n = t.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat(head, F.lit(":x")).alias("name"), F.concat(F.lit("c"), "conv_id").alias("path"))
    cap = t.where("conv_id % 2 = 0").select(F.concat(F.lit("cap"), "conv_id").alias("id"), F.lit("capability:errors").alias("name"), F.concat(F.lit("c"), "conv_id").alias("path")).distinct()
    e = t.select(F.concat_ws(":", "conv_id", "turn").alias("source"), F.concat_ws(":", "conv_id", F.col("turn") + 1).alias("target"), F.lit("contains").alias("relation"))
    return lookup.missing_behaviour(n.unionByName(cap), e, "catch", ("report",), "errors").select("id")


@query(sql(f", st AS (SELECT node_id, kind, name FROM n WHERE kind = 'function' ORDER BY node_id LIMIT 1) SELECT direction, relation, count, (SELECT count(DISTINCT src) FROM e, st WHERE dst = node_id AND relation IN ('calls', 'possible-calls', 'observed-calls')) AS callers, (SELECT count(DISTINCT dst) FROM e, st WHERE src = node_id AND relation IN ('calls', 'possible-calls', 'observed-calls')) AS callees FROM (SELECT 'incoming' AS direction, relation, count(*) AS count FROM e, st WHERE dst = node_id GROUP BY relation UNION ALL SELECT 'outgoing', relation, count(*) FROM e, st WHERE src = node_id GROUP BY relation)"))
def g10_operational_role(spark, d):
    from ..operators import traverse

    r = traverse.operational_role(graph(spark, d), _orders(spark, d, 1)[0])
    rows = [(way, rel, n, r["caller_count"], r["callee_count"]) for way in ("incoming", "outgoing") for rel, n in r[way].items()]
    return spark.createDataFrame(rows, "direction string, relation string, count long, callers long, callees long")


# Agents' answers


@query("""WITH a AS (SELECT conv_id, turn, lower(text) || CASE WHEN turn % 2 = 0 THEN chr(10) || 'evidence_json: {"k": 1}' || chr(10) || 'see src/a.py:12' ELSE '' END AS hay, turn % 2 = 0 AS cited FROM conversations WHERE text IS NOT NULL),
  s AS (SELECT *, contains(hay, 'the') AS forbidden, contains(hay, 'src/a.py') AS found FROM a)
  SELECT conv_id || ':' || turn AS run_id, CAST(found AS BIGINT) AS required_recovered, CAST(1 AS BIGINT) AS required_total, CAST(cited AS BIGINT) AS citation_count, cited AS evidence_valid, CASE WHEN forbidden THEN ['The'] ELSE [] END AS forbidden_hits, NOT forbidden AND cited AS correct FROM s""")
def a16_answer_scores(spark, d):
    """Turns as answers; even ones cite a file and give an evidence line."""
    c = tables(spark, d)["conversations"].where("text is not null")
    even = F.col("turn") % 2 == 0
    a = c.select(F.concat_ws(":", "conv_id", "turn").alias("run_id"), F.lit("c").alias("case_id"), F.concat("text", F.when(even, '\nEVIDENCE_JSON: {"k": 1}\nsee src/a.py:12').otherwise("")).alias("answer"))
    evidence = spark.createDataFrame([("c", "required", "SRC\\a.py:3-9", ["", " "])], "case_id string, `group` string, path string, symbols array<string>")
    forbidden = spark.createDataFrame([("c", "The"), ("other", "x")], "case_id string, pattern string")
    outcomes = spark.createDataFrame([("c", "any", ["", "never"])], "case_id string, label string, any array<string>")
    out = answers.score_answers(a, evidence, forbidden, outcomes)
    return out.select("run_id", "required_recovered", "required_total", "citation_count", "evidence_valid", "forbidden_hits", "correct")


@query("""WITH r AS (SELECT CASE user_id % 2 WHEN 0 THEN 'g' ELSE 'c' END AS system, event_type AS task, event_id % 5 <> 0 AS complete, event_id % 3 = 0 AS correct, CAST(event_id % 4 AS BIGINT) AS got, value FROM events), b AS (FROM r UNION ALL SELECT system, 'all', complete, correct, got, value FROM r)
  SELECT system, task, count(*) AS runs, count(*) FILTER (complete) AS completed, count(*) FILTER (complete AND correct) AS correct, CAST(coalesce(sum(got) FILTER (complete), 0) AS BIGINT) AS required_recovered, round(median(value) FILTER (complete), 3) AS median_value FROM b GROUP BY ALL""")
def a16_run_summary(spark, d):
    e = tables(spark, d)["events"]
    zero = {c: F.lit(0).cast("long") for c in ("required_total", "structural_recovered", "structural_total")}
    runs = e.select(F.when(F.col("user_id") % 2 == 0, "g").otherwise("c").alias("system"), F.col("event_type").alias("task"), (F.col("event_id") % 5 != 0).alias("complete"), (F.col("event_id") % 3 == 0).alias("correct"), (F.col("event_id") % 4).cast("long").alias("required_recovered"), "value").withColumns(zero)
    return answers.summarize_runs(runs, ["value"]).select("system", "task", "runs", "completed", "correct", "required_recovered", "median_value")
