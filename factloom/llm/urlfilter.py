"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host (with all its subdomains) and a path prefix. Its literal tokens are the host's labels and the path's
complete segments; it is indexed under the one that the fewest URLs contain (counted over all URLs). The tokens of a
URL fetch candidate rules, and only those run their regular expressions on it. A rule without a literal token (no host,
no whole path segment) is a candidate for every URL that has a host or a path. The longest fitting rule wins; among
rules of the same length a block wins, then the first in order of text.

Up to ``MOST_RULES`` rules the index is broadcast (its size is checked). Beyond that the same index is joined by token
over the distinct URLs, each token dealt into ``SALTS`` keys, so that a frequent one isn't one task.

Edge cases: a null URL or one without ``://`` has an empty host and path and fits no rule; URLs of any length are read
whole; repeated URLs and rows get equal results; a rule without host fits every host; an empty rule set gives the
default verdict; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MOST_RULES, SALTS = 200_000, 32
#: The token of rules that have none, which every URL with a host or a path has.
ANY = "*"
_TOKEN = re.compile(r"[^./]+")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str

    @classmethod
    def parse(cls, action: str, text: str) -> Rule:
        """``com/en/`` is host ``com`` and path ``/en/``."""
        host, slash, path = text.partition("/")
        return cls(host.lower(), slash + path, action)

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        """Over host and path joined by a null character."""
        host = rf"(?:.*\.)?{re.escape(self.host)}" if self.host else "[^\\x00]*"
        return rf"(?s)\A{host}\x00{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that each URL which the rule fits must have: ``h:`` host labels, ``p:`` whole path segments."""
        whole = self.path[: self.path.rfind("/") + 1] if "/" in self.path else ""
        return [f"h:{t}" for t in _TOKEN.findall(self.host)] + [f"p:{t}" for t in whole.split("/") if t]


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _url_tokens(host: str, path: str) -> set[str]:
    return {ANY} | {f"h:{t}" for t in _TOKEN.findall(host)} | {f"p:{t}" for t in path.split("/") if t}


def _tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.filter(F.split(host, r"\."), lambda t: t != ""), lambda t: F.concat(F.lit("h:"), t))
    parts = F.transform(F.filter(F.split(path, "/"), lambda t: t != ""), lambda t: F.concat(F.lit("p:"), t))
    return F.array_distinct(F.concat(labels, parts))


def build_index(urls: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; ``urls`` has columns host and path. Ties go to the earlier token in order."""
    spark = urls.sparkSession
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {ANY: list(rules)} if rules else {}
    known = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "token string"))
    seen = urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token")).join(known, "token").groupBy("token").count()
    counts = {r["token"]: r["count"] for r in seen.collect()}  # as many as the rules have tokens
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=ANY), []).append(r)
    return index


def _order(r: Rule) -> tuple:
    return (-len(r.text), r.action != "block", r.text)


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """``id, host, path, rule, verdict`` of each row; ``rule`` is null and the verdict ``default`` where none fits."""
    spark = pages.sparkSession
    common.arrow_limits(spark)
    host, path = host_path(F.col(url_col))
    src = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    index = build_index(src, rules)
    if len(rules) > most_rules:
        return _judge_by_join(src, index, id_col, default)
    kind = src.schema["id"].dataType.simpleString()
    held = spark.sparkContext.broadcast({t: [(r.regex, r.text, r.action) for r in sorted(rs, key=_order)] for t, rs in index.items()})
    rank = spark.sparkContext.broadcast({r.text: _order(r) for r in sorted(rules, key=_order, reverse=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_token = {t: [(re.compile(x), text, action) for x, text, action in rs] for t, rs in held.value.items()}
        order = rank.value
        for b in batches:
            named, verdicts = [], []
            for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                best = None
                if h or p:
                    for t in _url_tokens(h, p) & by_token.keys():
                        for x, text, action in by_token[t]:
                            if (best is None or order[text] < order[best[0]]) and x.match(f"{h}\x00{p}"):
                                best = (text, action)
                named.append(best and best[0])
                verdicts.append(best[1] if best else default)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(named, pa.string()), pa.array(verdicts, pa.string())], [id_col, "host", "path", "rule", "verdict"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def _judge_by_join(src: DataFrame, index: dict[str, list[Rule]], id_col: str, default: str) -> DataFrame:
    """For rule sets too large to broadcast: distinct URLs meet the index by token in a shuffle."""
    spark = src.sparkSession
    rows = [(t, r.regex, r.text, r.action, len(r.text), int(r.action == "block")) for t, rs in index.items() for r in rs]
    table = spark.createDataFrame(rows, "token string, regex string, rule string, action string, n int, block int")
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    urls = src.select("host", "path").where("host != '' or path != ''").distinct()
    tokens = F.explode(F.concat(F.array(F.lit(ANY)), _tokens(F.col("host"), F.col("path"))))
    met = urls.select("host", "path", tokens.alias("token"), F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int").alias("salt")).join(table, ["token", "salt"])
    fits = met.where(F.expr(r"regexp_like(concat(host, char(0), path), regex)"))
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "action"), F.struct(-F.col("n"), -F.col("block"), F.col("rule"))).alias("b"))
    return src.join(best, ["host", "path"], "left").select(F.col("id").alias(id_col), "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.action", F.lit(default)).alias("verdict"))
