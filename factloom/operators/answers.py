"""Scoring of agents' answers against expected evidence, and medians over their runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Starts the line that holds an answer's evidence as a JSON object.
EVIDENCE = "EVIDENCE_JSON:"
CITATION = r"(?:[A-Za-z0-9_.@-]+/)+[A-Za-z0-9_.@-]+:\d+(?:-\d+)?"
GROUPS = ("ownership", "required", "structural")


def _evidence(answer: Column, prefix: str) -> tuple[Column, Column]:
    """The JSON text of the answer's first evidence line (null if there is none), and whether it is an object."""
    line = F.get(F.filter(F.split(answer, r"\r\n|\r|\n"), lambda x: x.startswith(prefix)), F.lit(0))
    text = F.trim(F.substr(line, F.lit(len(prefix) + 1)))
    return text, F.coalesce(F.try_parse_json(text).isNotNull() & text.startswith("{"), F.lit(False))


def score_answers(answers: DataFrame, evidence: DataFrame, forbidden: DataFrame, outcomes: DataFrame, prefix: str = EVIDENCE) -> DataFrame:
    """One row for each of ``answers(run_id, case_id, answer)``: what of its case it recovers.

    ``evidence(case_id, group, path, symbols)``: an item counts if its path and, where it has any, one of its symbols
    occur in the answer (case and direction of slashes don't matter). ``forbidden(case_id, pattern)`` must not occur;
    of each of ``outcomes(case_id, label, any)`` one text must. An answer is correct if no outcome is missing, nothing
    forbidden occurs, its evidence line holds an object and it cites a file and line. What the cases ask is broadcast: it is
    written by hand, and doesn't grow with the answers.
    """
    _, valid = _evidence(F.col("answer"), prefix)
    hay = F.lower(F.translate(F.coalesce("answer", F.lit("")), "\\", "/"))
    a = answers.select("run_id", "case_id", hay.alias("hay"), F.coalesce(valid, F.lit(False)).alias("evidence_valid"), F.coalesce(F.size(F.regexp_extract_all("answer", F.lit(CITATION), F.lit(0))), F.lit(0)).alias("citation_count"))
    # what is asked of a case goes to its answers in one row, so that these stay where they are, however many a case has
    path = F.lower(F.regexp_replace(F.trim(F.translate("path", "\\", "/")), r":\d+(?:-\d+)?$", ""))
    symbols = F.filter(F.coalesce("symbols", F.array().cast("array<string>")), lambda s: F.trim(s) != "")
    asked = _by_case(evidence, "items", group="group", path=path, symbols=symbols)
    asked = asked.join(_by_case(forbidden, "bad", pattern="pattern"), "case_id", "full").join(_by_case(outcomes, "needs", label="label", any="any"), "case_id", "full")
    a = a.join(F.broadcast(asked), "case_id", "left")
    hay = F.col("hay")

    def recovered(i: Column) -> Column:
        return hay.contains(i["path"]) & (i["path"] != "") & ((F.size(i["symbols"]) == 0) | F.exists(i["symbols"], lambda s: hay.contains(F.lower(s))))

    def count(group: str, test=lambda i: F.lit(True)) -> Column:
        return F.coalesce(F.size(F.filter("items", lambda i: (i["group"] == group) & test(i))), F.lit(0)).cast("long")

    def names(items: str, field: str, test) -> Column:
        hits = F.transform(F.filter(items, lambda i: test(i) & i[field].isNotNull()), lambda i: i[field])
        return F.coalesce(F.array_sort(F.array_distinct(hits)), F.array().cast("array<string>"))

    sums = [x for g in GROUPS for x in (count(g, recovered).alias(f"{g}_recovered"), count(g).alias(f"{g}_total"))]
    bad = names("bad", "pattern", lambda i: hay.contains(F.lower(i["pattern"]))).alias("forbidden_hits")
    lack = names("needs", "label", lambda i: ~F.exists(i["any"], lambda s: hay.contains(F.lower(s)))).alias("outcome_missing")
    out = a.select("run_id", "case_id", "evidence_valid", "citation_count", *sums, bad, lack)
    return out.withColumn("correct", (F.size("forbidden_hits") == 0) & (F.size("outcome_missing") == 0) & F.col("evidence_valid") & (F.col("citation_count") > 0))


def _by_case(df: DataFrame, name: str, **fields: str | Column) -> DataFrame:
    """``case_id`` and the array of what the case asks."""
    parts = [(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in fields.items()]
    return df.groupBy("case_id").agg(F.collect_list(F.struct(*parts)).alias(name))


def summarize_runs(runs: DataFrame, measures: list[str], task: str = "task") -> DataFrame:
    """``system``, the task or ``all``: runs, completed and correct ones, sums of recovered items, medians of measures.

    ``runs`` has the columns of ``score_answers`` with ``system``, ``task`` and ``complete``; medians are of complete runs.
    """
    done = F.col("complete")
    sums = [F.coalesce(F.sum(F.when(done, F.col(f"{g}_{x}"))), F.lit(0)).alias(f"{g}_{x}") for g in ("required", "structural") for x in ("recovered", "total")]
    both = runs.unionByName(runs.withColumn(task, F.lit("all")))
    return both.groupBy("system", task).agg(F.count("*").alias("runs"), F.count_if(done).alias("completed"), F.count_if(done & F.col("correct")).alias("correct"), *sums, *[F.round(F.median(F.when(done, F.col(m))), 3).alias(f"median_{m}") for m in measures])
