"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x):
    """A-Z to a-z and nothing else, for a string or a column."""
    return x.translate(str.maketrans(UPPER, LOWER)) if isinstance(x, str) else F.translate(x, UPPER, LOWER)


def normalize_path(path: str) -> str:
    """Slashes forward, empty and ``.`` parts dropped; absolute, drive, parent and control parts raise ValueError."""
    p = path.replace("\\", "/")
    if p.startswith("/") or re.match(r"^[A-Za-z]:", p) or any(ord(c) < 32 or ord(c) == 127 for c in p):
        raise ValueError(f"invalid_path: {path!r}")
    parts = [x for x in p.split("/") if x not in ("", ".")]
    if ".." in parts:
        raise ValueError(f"invalid_path: {path!r}")
    return "/".join(parts) or "."


def normalize_path_col(path: Column) -> Column:
    """As ``normalize_path``; null where that raises."""
    p = F.translate(path, "\\", "/")
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    bad = p.startswith("/") | p.rlike(r"^[A-Za-z]:") | p.rlike(r"[\x00-\x1f\x7f]") | F.array_contains(parts, "..")
    out = F.array_join(parts, "/")
    return F.when(~bad, F.when(out == "", ".").otherwise(out))


def parent_path(path: Column) -> Column:
    """What stands before the last slash, else ``.``."""
    return F.when(path.contains("/"), F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def identifier_terms(name: Column) -> Column:
    """Words of an identifier, lower-cased: cut at other signs, before capitals after small letters or digits, and
    before the last capital of a run that a small letter follows."""
    x = F.regexp_replace(name, r"[^\p{L}\p{N}]+", " ")
    x = F.regexp_replace(x, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " ")
    x = F.regexp_replace(x, r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.trim(F.lower(x))


_HOLE = "|".join((r"\$?\{[^}/]*\}", r":(?!\d)\w+", "<[^>/]+>", "%[sdv]", r"#\{[^}]*\}"))
#: A verb as the name of a called function.
_VERB_CALL = "(?i)(?:^|\\W)(" + "|".join(("delete", "get", "patch", "post", "put")) + r")(?:_json)?\s*\("


def clean_route(path: Column) -> Column:
    """Empty and ``.`` parts go, ``..`` takes its predecessor along; begins with a slash."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def normalize_route(value: Column) -> Column:
    """A URL or quoted route to its path with ``{param}`` holes; empty for resource paths and for the bare root.

    Without a scheme, text before the first of the usual service markers is dropped.
    """
    v = F.replace(F.trim(value), F.lit("\\/"), F.lit("/"))
    marker = F.coalesce(*[F.when(v.contains(m), F.substr(v, F.instr(v, m))) for m in "/api/ /internal/ /health /ws".split()], v)
    rest = F.regexp_extract(v, r"(?s)^.*?://(.*)$", 1)
    path = F.when(v.contains("://"), F.when(rest.contains("/"), F.substr(rest, F.instr(rest, "/"))).otherwise("/")).otherwise(marker)
    path = F.regexp_replace(F.regexp_extract(path, r"(?s)^([^?#]*)", 1), _HOLE, "{param}")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    out = clean_route(path)
    return F.when(F.lower(v).rlike(r"^(res|user)://") | (out == "/"), F.lit("")).otherwise(out)


def route_shape(path: Column) -> Column:
    return F.regexp_replace(path, r"\{[^}/]*\}", "{}")


def http_method(line: Column) -> Column:
    """The verb of a client call or setting in a line, upper-cased; empty if none."""
    call = F.regexp_extract(line, _VERB_CALL, 1)
    constant = F.regexp_extract(F.upper(line), "METHOD_?(GET|PUT|POST|PATCH|DELETE)", 1)
    setting = F.regexp_extract(line, r"""(?i)method["']?\s*[:=]\s*["'](put|post|patch|get|delete)""", 1)
    return F.upper(F.coalesce(*[F.when(x != "", x) for x in (call, constant, setting)], F.lit("")))


def client_call(line: Column) -> Column:
    low = F.lower(line)
    server = low.contains("handlefunc(") | low.contains(".handler(")
    return ~server & ((F.regexp_extract(line, _VERB_CALL, 1) != "") | low.rlike(r"request\(|fetch\(|axios\.|requests\.|httpclient|net::http"))


def last_identifier(token: Column) -> Column:
    return F.regexp_extract(token, r"((?!\d)\w+)\W*$", 1)


def camelize(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "[_-]+"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), "")


def camel_to_kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "-"))


def synthetic_path(kind: str, name: Column) -> Column:
    """A path for a node that stands for no file."""
    return F.concat(F.lit(f"@{kind}/"), F.substring(F.sha2(name, 256), 1, 16))


def component_of(path: Column) -> Column:
    """First path segment, or the first two below ``services``."""
    parts = F.split(F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", ""), "/")
    first = parts[0]
    two = (first == "services") & (F.size(parts) >= 2)
    return F.when(two, F.concat_ws("/", first, F.element_at(parts, F.when(two, 2).otherwise(1)))).when(first == "", F.lit("repository")).otherwise(first)


def module_name(path: Column) -> Column:
    """``pkg/new/__init__.py`` to ``pkg.new``; null for other files than Python's."""
    stem = F.regexp_extract(path, r"^(.*)\.pyi?$", 1)
    return F.when(stem != "", F.translate(F.regexp_replace(stem, r"(^|/)__init__$", ""), "/", "."))


def hex16(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def shard(key: Column, shards: int = 64) -> Column:
    """First byte of the key's SHA-256, modulo the number of shards."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int") % shards).cast("int")


def node_identity(language: Column, kind: Column, identity: Column, domain: str = "factloom:v1") -> Column:
    """``sha256:`` and the digest of domain, language, kind and identity, apart by null characters."""
    zero = F.char(F.lit(0))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(domain), zero, language, zero, kind, zero, identity), 256))


@F.pandas_udf(T.StringType())
def fnv1a64(values):
    """64-bit FNV-1a of the UTF-8 bytes as 16 hex digits, for parity with files that carry it."""
    import pandas as pd

    def one(x):
        h = 0xCBF29CE484222325
        for b in x.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return pd.Series([None if x is None else one(x) for x in values])


@F.pandas_udf(T.StringType())
def bounded_bytes(values):
    """The longest prefix of whole characters within 6,000 bytes."""
    import pandas as pd

    return pd.Series([None if x is None else x.encode()[:6000].decode("utf-8", "ignore") for x in values])


_COMMENTS = {"hash": r"#[^\n]*", "slash": r"//[^\n]*|/\*.*?\*/", "dash": r"--[^\n]*"}


def mask_comments(text: Column, style: str = "slash") -> Column:
    """Comments become nothing, line by line: strings are kept, line feeds too.

    ``style`` is ``slash``, ``hash`` or ``dash``; a block comment over several lines keeps its line feeds.
    """
    return mask_udf(style)(text)


def mask_udf(style: str, strings: bool = False):
    pattern = re.compile(rf"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|({_COMMENTS[style]})""", re.S)

    def blank(m: re.Match) -> str:
        if m[1] is not None:
            return m[1][0] + " " * (len(m[1]) - 2) + m[1][-1] if strings else m[1]
        return re.sub(r"[^\n]", " ", m[2])

    @F.pandas_udf(T.StringType())
    def run(values):
        import pandas as pd

        return pd.Series([None if x is None else pattern.sub(blank, x) for x in values])

    return run
