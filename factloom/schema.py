"""Vocabulary and schemas of fact graphs: node kinds, relations with both of their orders, reasons, record types."""

from __future__ import annotations

from pyspark.sql import types as T

NODE_KINDS = tuple(
    """
    cli-command config-key constant constructor directory export field file function http-endpoint import
    interface message-channel method module namespace parameter process protocol repository signal state-path
    symbol test trait type variable
    """.split()
)

#: In traversal order: it breaks ties in traversals and orders echoed relation lists.
RELATIONS = tuple(
    """
    contains defines references imports calls possible-calls passes-to observed-calls converts-to implements
    extends uses-trait overrides reads writes annotates includes depends-on routes-to communicates-with tests
    documents generates similar-to calls-endpoint handled-by publishes consumes reads-config invokes-process
    produces-message consumes-message
    """.split()
)
TRAVERSAL_ORDER = {r: i for i, r in enumerate(RELATIONS)}

_STORED = """
    contains defines references imports calls implements extends includes depends-on tests documents generates
    possible-calls converts-to uses-trait overrides reads writes annotates passes-to observed-calls routes-to
    communicates-with similar-to calls-endpoint handled-by publishes consumes reads-config invokes-process
    produces-message consumes-message
""".split()
#: Storage codes: they order adjacency, so what ``neighbors`` returns.
RELATION_CODE = {r: i + 1 for i, r in enumerate(_STORED)}

REASONS = tuple(
    """
    ambiguous-target builtin-target compiler-analysis-failed compiler-identity-mismatch dynamic-target
    external-target generated-target macro-argument-mismatch macro-expansion-cycle macro-expansion-depth
    missing-target self-target type-conversion unsupported-form unsupported-macro-expansion
    """.split()
)

_EVENTS = frozenset("calls-endpoint consumes consumes-message handled-by invokes-process produces-message publishes".split())
CALL_RELATIONS = frozenset({"calls", "observed-calls"}) | _EVENTS
IMPACT_RELATIONS = CALL_RELATIONS | {"possible-calls", "passes-to", "references", "reads-config"}
ARCHITECTURE_RELATIONS = CALL_RELATIONS | frozenset(
    """
    communicates-with depends-on extends implements imports includes overrides possible-calls reads-config
    routes-to uses-trait
    """.split()
)
ROLE_RELATIONS = frozenset({"calls", "possible-calls", "observed-calls"})
DEAD_KINDS = ("function", "method", "constructor")

#: How much a relation says about what a node does; smaller comes first in documents.
RELATION_PRIORITY = {
    r: p
    for p, names in enumerate((
        "calls observed-calls calls-endpoint routes-to handled-by publishes consumes communicates-with invokes-process produces-message consumes-message",
        "possible-calls passes-to",
        "implements extends uses-trait overrides",
        "generates depends-on includes reads-config converts-to",
        "defines contains documents tests",
        "references imports annotates similar-to",
        "reads writes",
    ))
    for r in names.split()
}

#: Kinds that never get a semantic document.
NOT_SEMANTIC = tuple("constant directory export field import parameter repository test variable".split())


def call_relations(include_possible: bool = True) -> frozenset[str]:
    return CALL_RELATIONS | ({"possible-calls"} if include_possible else set())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _L = T.StringType(), T.LongType()
SPAN = _struct(path=_S, start_line=_L, start_column=_L, end_line=_L, end_column=_L)
HEADER = _struct(
    record=_S, schema_version=T.IntegerType(), adapter_version=_S, language=_S, repository=_S, mode=_S,
    changed_files=T.ArrayType(_S), removed_files=T.ArrayType(_S), shared_complete=T.BooleanType(),
)
#: ``attributes`` stays JSON text.
NODE = _struct(id=_S, kind=_S, name=_S, path=_S, qualified_name=_S, content_id=_S, owner=_S, span=SPAN, attributes=_S)
EDGE = _struct(source=_S, target=_S, relation=_S, owner=_S, span=SPAN, attributes=_S)
UNRESOLVED = _struct(
    source=_S, relation=_S, expression=_S, reason=_S, candidate_name=_S, candidate_namespace=_S, owner=_S, span=SPAN, attributes=_S,
)
RECORDS = {"node": NODE, "edge": EDGE, "unresolved": UNRESOLVED}
SCHEMA_VERSION = 1
