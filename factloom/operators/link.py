"""Extraction from source lines and links between programs: routes, messages, configuration, processes, state."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import client_call, component_of, http_method, last_identifier, normalize_route, parent_path, route_shape

#: A quote, a string's content between quotes, a name.
Q, INNER, NAME = "[\"']", "[^\"']+", r"[A-Za-z_]\w*"
CALLABLE = ("function", "method", "constructor", "test")
_MODS = r"(?:(?:abstract|async|export|extern|final|internal|open|private|protected|pub|public|static|unsafe)\s+)*"
IMPORT_PATTERNS = (
    r"""^[ \t]*#[ \t]*(import|include)[ \t]*[<"]([^<>"]+)""",
    r"^\s*(from)\s+([\w./:-]+)\s+import\b",
    r"""(require)(?:_once)?[\s(]+["']([^"']+)""",
    r"""(?i)^[ \t]*(import|include|use|using)\s+(?:public\s+|weak\s+|namespace\s+)?["']?([\w./:\\-]+)""",
)
DECLARATIONS = (
    (rf"(?i)^\s*{_MODS}(class|contract|enum|interface|message|object|protocol|record|service|struct|trait|union)\s+([A-Za-z_]\w*)", "type"),
    (rf"(?i)^\s*{_MODS}(module|namespace|package)\s+([A-Za-z_][\w.]*)", "namespace"),
    (rf"(?i)^\s*{_MODS}(def|fn|fun|func|function|proc|procedure|rpc|sub)\s+([A-Za-z_][\w.:]*)", "function"),
    (r"(?i)^[ \t]*create (?:or replace )?(table|type|view)\s+([A-Za-z_][\w.$]*)", "type"),
    (r"(?i)^[ \t]*create (?:or replace )?(function|procedure|trigger)\s+([A-Za-z_][\w.$]*)", "function"),
)


def _first(line: Column, patterns) -> Column:
    """``(key, name)`` of the first pattern that fits, else null."""
    hits = [F.when(F.regexp_extract(line, p, 2) != "", F.struct(F.lower(F.regexp_extract(line, p, 1)).alias("key"), F.regexp_extract(line, p, 2).alias("name"))) for p in patterns]
    return F.coalesce(*hits)


def extract(lines: DataFrame) -> DataFrame:
    """``path, line_no, fact, key, name`` of ``lines(path, line_no, line)``: a line's first import, its first declaration.

    ``fact`` is ``import`` or the declared kind.
    """
    imports = lines.withColumn("x", _first(F.col("line"), IMPORT_PATTERNS)).where("x is not null").select("path", "line_no", F.lit("import").alias("fact"), "x.key", "x.name")
    kinds = [F.when(F.regexp_extract("line", p, 2) != "", F.struct(F.lit(k).alias("fact"), F.lower(F.regexp_extract("line", p, 1)).alias("key"), F.regexp_extract("line", p, 2).alias("name"))) for p, k in DECLARATIONS]
    declared = lines.withColumn("x", F.coalesce(*kinds)).where("x is not null").select("path", "line_no", "x.fact", "x.key", "x.name")
    return imports.unionByName(declared)


# Who owns a line


def owners(lines: DataFrame, callables: DataFrame, bin_lines: int = 64) -> DataFrame:
    """``path, line_no, owner``: of the callables of a file, the first by start that contains the line, else the last
    that starts at or before it, else null.

    ``callables(path, owner, start_line, start_column, end_line)``. Intervals are dealt into bins of lines, so the join
    is an equality; the fallback looks back by a window over starts and lines of the file.
    """
    asked = lines.select("path", "line_no").distinct()
    c = callables.select("path", "owner", "start_line", "start_column", "end_line")
    binned = c.where("end_line >= start_line").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_line") / bin_lines), F.floor(F.col("end_line") / bin_lines))))
    inside = asked.withColumn("bin", F.floor(F.col("line_no") / bin_lines)).join(binned, ["path", "bin"]).where("start_line <= line_no and line_no <= end_line")
    inside = inside.groupBy("path", "line_no").agg(F.min(F.struct("start_line", "start_column", "owner")).alias("m")).select("path", "line_no", F.col("m.owner").alias("inner"))
    starts = c.groupBy("path", F.col("start_line").alias("line_no")).agg(F.max(F.struct("start_column", "owner")).alias("m")).select("path", "line_no", F.col("m.owner").alias("started"), F.lit(0).alias("ask"))
    both = starts.unionByName(asked.select("path", "line_no", F.lit(None).cast("string").alias("started"), F.lit(1).alias("ask")))
    w = Window.partitionBy("path").orderBy("line_no", "ask").rowsBetween(Window.unboundedPreceding, 0)
    before = both.withColumn("last", F.last("started", True).over(w)).where("ask = 1").select("path", "line_no", "last")
    return before.join(inside, ["path", "line_no"], "left").select("path", "line_no", F.coalesce("inner", "last").alias("owner"))


def with_owner(found: DataFrame, callables: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Adds ``owner`` to rows with ``path, line_no``; ``files(path, owner)`` owns what no callable does."""
    out = found.join(owners(found, callables), ["path", "line_no"], "left")
    if files is not None:
        out = out.join(files.select("path", F.col("owner").alias("_file")), "path", "left").withColumn("owner", F.coalesce("owner", "_file")).drop("_file")
    return out


def callable_by_name(wanted: DataFrame, callables: DataFrame) -> DataFrame:
    """``name, path, owner`` of the one best callable: 4 for the same component, 2 for a path below the same folder;
    ties give none. ``wanted(name, path)``, ``callables(name, path, owner)``."""
    c = callables.select("name", F.col("path").alias("cpath"), "owner")
    prefix = parent_path(F.col("path"))
    near = (prefix != ".") & F.col("cpath").startswith(F.concat(prefix, F.lit("/")))
    score = F.when(component_of(F.col("cpath")) == component_of(F.col("path")), 4).otherwise(0) + F.when(near, 2).otherwise(0)
    scored = wanted.select("name", "path").distinct().join(c, "name").withColumn("score", score)
    best = scored.groupBy("name", "path", "score").agg(F.count("*").alias("n"), F.min("owner").alias("owner"))
    return best.groupBy("name", "path").agg(F.max(F.struct("score", "n", "owner")).alias("b")).where("b.n = 1").select("name", "path", F.col("b.owner").alias("owner"))


def constants(lines: DataFrame) -> DataFrame:
    """``name, value`` of constants with exactly one string value in all files."""
    value = rf"\s*{Q}({INNER}){Q}"
    p = (rf"^\s*(?:(?:export|pub(?:\([^)]*\))?)\s+)?const\s+({NAME})[^=]*={value}", rf"^\s*([A-Z][A-Z\d_]*)\s*={value}")
    hit = F.coalesce(*[F.when(F.regexp_extract("line", x, 2) != "", F.struct(F.regexp_extract("line", x, 1).alias("name"), F.regexp_extract("line", x, 2).alias("value"))) for x in p])
    found = lines.select(hit.alias("x")).where("x is not null").select("x.*")
    return found.groupBy("name").agg(F.min("value").alias("value"), F.max("value").alias("_max")).where("value = _max").drop("_max")


# HTTP

VERBS = ("delete", "get", "patch", "post", "put")
QUOTED = r"""["'`]((?:https?://[^"'`\s]+)?/[^"'`\s]*)["'`]"""


def routes(lines: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """``path, line_no, method, route, shape, handler, confidence`` of router registrations.

    A handler that is a name counts 1.0, one found through ``bindings(path, variable, handler)`` 0.95, else the
    registering function stands in with 0.7 (handler null here).
    """
    call = rf"(?i)\.(handlefunc|handle|{'|'.join(VERBS)})\(" + r"""\s*["']((?:[A-Z]+ )?/[^"']*)["']\s*,\s*&?([A-Za-z_][\w.]*)?"""
    x = lines.select("path", "line_no", *[F.regexp_extract("line", call, i).alias(n) for i, n in ((1, "verb"), (2, "text"), (3, "name"))]).where("text != ''")
    method = F.coalesce(*[F.when(c != "", F.upper(c)) for c in (F.regexp_extract("text", r"^([A-Z]+) ", 1), F.when(F.lower("verb").isin("handlefunc", "handle"), "").otherwise(F.col("verb")))], F.lit("*"))
    route = normalize_route(F.regexp_replace("text", r"^[A-Z]+ ", ""))
    out = x.select("path", "line_no", method.alias("method"), route.alias("route"), route_shape(route).alias("shape"), F.when(F.col("name") != "", last_identifier(F.col("name"))).alias("handler"), "name")
    if bindings is None:
        return out.withColumn("confidence", F.when(F.col("handler").isNotNull(), 1.0).otherwise(0.7)).drop("name")
    b = bindings.select("path", F.col("variable").alias("name"), F.col("handler").alias("_bound"))
    out = out.join(b, ["path", "name"], "left")
    return out.select("path", "line_no", "method", "route", "shape", F.coalesce("_bound", "handler").alias("handler"), F.when(F.col("_bound").isNotNull(), 0.95).when(F.col("handler").isNotNull(), 1.0).otherwise(0.7).alias("confidence"))


RAILS = "path string, line_no int, method string, route string, handler string"


def rails_routes(lines: DataFrame) -> DataFrame:
    """Routes of ``config/routes.rb`` files; ``namespace`` and ``scope`` blocks nest, so a file is read in order."""
    import re

    block = re.compile(r"^\s*(namespace|scope|resources?|constraints|concern|member|collection)\b\s*\(?\s*[:\"']?/?([\w/-]*)")
    verb = re.compile(rf"^\s*({'|'.join(VERBS)})\s+[\"':]([^\"',\s]+)[\"']?(?:.*?(?:to:|=>)\s*[\"']([\w/]+#\w+))?")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, stack = [], []
        for r in pdf.sort_values("line_no").itertuples():
            line = r.line.split("#!")[0]
            if m := verb.match(line):
                route = "/" + "/".join(x for x in ([s for s in stack if s] + [m[2].strip("/")]) if x)
                rows.append((r.path, r.line_no, m[1].upper(), route, m[3]))
            if re.search(r"\bdo\b(\s*\|[^|]*\|)?\s*$", line):
                b = block.match(line)
                stack.append(b[2].strip("/") if b and b[1] in ("namespace", "scope") else "")
            elif re.match(r"^\s*end\b", line) and stack:
                stack.pop()
        return pd.DataFrame(rows, columns=["path", "line_no", "method", "route", "handler"])

    src = lines.where(F.col("path").endswith("config/routes.rb")).select("path", F.col("line_no").cast("int").alias("line_no"), "line")
    return src.groupBy("path").applyInPandas(one, RAILS)


def call_blocks(lines: DataFrame, most: int = 12) -> DataFrame:
    """``path, line_no, block``: each client call with the lines up to its closing bracket, ``most`` at most."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(0, most - 1)
    seen = lines.withColumn("next", F.collect_list(F.trim("line")).over(w)).where(client_call(F.col("line")))
    balance = lambda xs: F.length(F.regexp_replace(xs, r"[^(]", "")) - F.length(F.regexp_replace(xs, r"[^)]", ""))
    pick = F.filter(F.sequence(F.lit(1), F.size("next")), lambda n: F.array_join(F.slice("next", 1, n), "\n").contains("(") & (balance(F.array_join(F.slice("next", 1, n), "\n")) <= 0))
    n = F.coalesce(F.get(pick, F.lit(0)), F.size("next"))
    return seen.select("path", "line_no", F.array_join(F.slice("next", 1, n), "\n").alias("block"))


def producers(lines: DataFrame, callables: DataFrame) -> DataFrame:
    """``path, line_no, owner, method, route, shape``: routes in client calls, and in what functions named ``*_path``,
    ``*_url`` or ``*_endpoint`` return."""
    calls = call_blocks(lines).select("path", "line_no", http_method(F.col("block")).alias("method"), F.explode(F.regexp_extract_all("block", F.lit(QUOTED), F.lit(1))).alias("text"))
    calls = with_owner(calls, callables)
    returned = lines.where(F.lower("line").contains("return")).select("path", "line_no", F.lit("").alias("method"), F.explode(F.regexp_extract_all("line", F.lit(QUOTED), F.lit(1))).alias("text"))
    returned = with_owner(returned, callables).where(F.lower("owner").rlike("_(path|url|endpoint)$"))
    route = normalize_route(F.col("text"))
    return calls.unionByName(returned).select("path", "line_no", "owner", "method", route.alias("route"), route_shape(route).alias("shape")).where("route != ''").distinct()


def link_http(made: DataFrame, contracts: DataFrame) -> DataFrame:
    """``producer_id, status, endpoint_id, confidence, evidence``.

    ``made(producer_id, method, shape)``, ``contracts(endpoint_id, method, shape)``. An equality on the shape and a
    test of the methods; one match links, several are ambiguous, none is missing. Contracts of one shape and method
    are one row first, so a popular shape doesn't multiply.
    """
    c = contracts.groupBy("shape", F.col("method").alias("cmethod")).agg(F.min("endpoint_id").alias("endpoint_id"), F.countDistinct("endpoint_id").alias("n"))
    fits = (F.col("cmethod").isNull()) | (F.col("method") == "") | (F.col("cmethod") == "*") | (F.col("method") == F.col("cmethod"))
    met = made.join(c, "shape", "left").withColumn("ok", fits & F.col("cmethod").isNotNull())
    out = met.groupBy("producer_id", "method", "shape").agg(F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("n"), F.min(F.when(F.col("ok"), F.col("endpoint_id"))).alias("e"))
    one = F.col("n") == 1
    return out.select("producer_id", "method", "shape", F.when(one, "linked").when(F.col("n") > 1, "ambiguous-target").otherwise("missing-target").alias("status"), F.when(one, F.col("e")).alias("endpoint_id"), F.when(one, F.when(F.col("method") == "", 0.85).otherwise(1.0)).alias("confidence"), F.when(one, F.when(F.col("method") == "", "unique-route").otherwise("method-and-route")).alias("evidence"))


def http_contracts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Endpoint rows (``name, method, route, shape``) and ``handled-by`` rows (``name, handler, confidence``, null
    handlers being unresolved)."""
    name = F.concat_ws(" ", "method", "route")
    return found.select(name.alias("name"), "method", "route", "shape").distinct(), found.groupBy(name.alias("name"), "handler").agg(F.max("confidence").alias("confidence"))


# Messages, configuration, processes, state

_TOKEN = rf"({NAME}(?:[.:]+\w+)*|{Q}{INNER}{Q})"
REGISTRATION = rf"(?i)\b(?:register|subscribe|on|handle)_(?:handler|message|packet)\s*\(\s*{_TOKEN}"
ASSIGNED = rf"(?i){Q}?\btype{Q}?\s*(?::=|:|=)\s*{_TOKEN}"
BRANCH = rf"^\s*(?:case\s+)?{_TOKEN}\s*(?::|=>)\s*(?:$|[^=])"


def _value(token: Column, name: str = "value") -> Column:
    bare = F.trim(F.regexp_replace(token, r"""^["'\s]+|["'\s]+$""", ""))
    return bare.alias(name)


def messages(lines: DataFrame, known: DataFrame, dispatch_lines: int = 120) -> DataFrame:
    """``path, line_no, role, channel`` (``publishes`` or ``consumes``).

    A type assignment publishes. A registration consumes, and so does a branch within ``dispatch_lines`` after a
    switch or match on a type. Lower-case names with an underscore are channels themselves; other names must be
    constants with one value (``known``) of that form.
    """
    low = F.lower(F.trim("line"))
    opens = (low.contains("switch ") | low.contains("match ")) & (low.contains(".type") | low.contains('["type"]') | low.contains("packet"))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("opened", F.last(F.when(opens, F.col("line_no")), True).over(w))
    inside = F.col("opened").isNotNull() & (F.col("line_no") <= F.col("opened") + dispatch_lines) & (F.col("line_no") > F.col("opened"))
    branch = F.split(F.when(inside, F.regexp_extract("line", BRANCH, 1)), ",")
    tokens = [
        marked.select("path", "line_no", F.lit("publishes").alias("role"), F.regexp_extract("line", ASSIGNED, 1).alias("token")),
        marked.select("path", "line_no", F.lit("consumes").alias("role"), F.regexp_extract("line", REGISTRATION, 1).alias("token")),
        marked.select("path", "line_no", F.lit("consumes").alias("role"), F.explode(branch).alias("token")),
    ]
    t = tokens[0].unionByName(tokens[1]).unionByName(tokens[2]).where("token != ''").select("path", "line_no", "role", _value(F.col("token"), "token"))
    t = t.withColumn("name", last_identifier(F.col("token"))).join(known.select("name", "value"), "name", "left")
    form = r"^[a-z0-9]+(_[a-z0-9]+)+$"
    channel = F.when(F.col("token").rlike(form), F.col("token")).when(F.col("value").rlike(form), F.col("value"))
    return t.select("path", "line_no", "role", channel.alias("channel")).where("channel is not null").distinct()


_KEY = rf"({NAME}|{Q}{NAME}{Q})"
CONFIG_READS = tuple(p + _KEY for p in (r"\bos\.(?:Getenv|LookupEnv|getenv|environ\.get)\(\s*", r"\bENV\s*\[\s*", r"\bENV\.fetch\(\s*", r"\bOS\.get_environment\(\s*")) + (rf"\bprocess\.env\.({NAME})",)


def config_reads(lines: DataFrame, known: DataFrame) -> DataFrame:
    """``path, line_no, key``: environment variables read in a line; a bare name goes through its constant."""
    src = lines.where(F.col("line").rlike(r"\bos\.|ENV|process\.env\.|OS\."))
    found = src.select("path", "line_no", F.explode(F.concat(*[F.regexp_extract_all("line", F.lit(p), F.lit(1)) for p in CONFIG_READS])).alias("token"), F.col("line").contains("process.env.").alias("direct"))
    quoted = F.col("token").rlike("^[\"']")
    t = found.withColumn("name", _value(F.col("token"))).join(known.select("name", "value"), "name", "left")
    key = F.when(quoted | F.col("direct"), F.col("name")).otherwise(F.coalesce("value", F.when(F.col("name") == F.upper("name"), F.col("name"))))
    return t.select("path", "line_no", key.alias("key")).where("key is not null").distinct()


def boundary_keys(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``path, line_no, key`` where a line names one of the keys."""
    return lines.select("path", "line_no", F.explode(F.array_compact(F.array(*[F.when(F.col("line").contains(k), F.lit(k)) for k in keys]))).alias("key"))


def rule_links(lines: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """``path, line_no, relation, kind, name`` for processes, commands and protocols; a rule is (literal, relation, kind, name)."""
    made = [F.when(F.col("line").contains(text), F.struct(F.lit(rel).alias("relation"), F.lit(kind).alias("kind"), F.lit(name).alias("name"))) for text, rel, kind, name in rules]
    return lines.select("path", "line_no", F.explode(F.array_compact(F.array(*made))).alias("x")).select("path", "line_no", "x.*").distinct()


def state_roles(callables: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``owner, relation, name``: which callable reads or writes a state path; a rule is (name, callable, relation)."""
    known = F.broadcast(callables.sparkSession.createDataFrame(rules, "state string, name string, relation string"))  # a fixed table
    return callables.select("owner", "name").join(known, "name").select("owner", "relation", F.col("state").alias("name")).distinct()


def last_wins(records: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of records with the same key the one emitted last."""
    return records.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def linker_summary(links: DataFrame, http: DataFrame, config: DataFrame, msgs: DataFrame) -> DataFrame:
    """``counter, value`` of all that the linkers found."""
    parts = [
        http.groupBy(F.concat(F.lit("http_"), F.regexp_replace("status", "-", "_")).alias("counter")).count(),
        msgs.groupBy(F.concat(F.lit("message_"), F.col("role")).alias("counter")).count(),
        config.groupBy(F.lit("config_reads").alias("counter")).count(),
        links.groupBy(F.concat(F.lit("links_"), F.regexp_replace("relation", "-", "_")).alias("counter")).count(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("count", "value")
