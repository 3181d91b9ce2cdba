"""Constraint checks over JSON documents that emit a violations frame.

``documents`` has (row_id, doc). A family of rules is an array of violations as a column over the parsed document, so any
number of families is one scan, one parse and one explode (``violations``). Every check is row-local, without a shuffle,
and runs unchanged on a batch or a stream. The result is (row_id, rule, path, observed, expected); an empty result
means valid.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION = (
    "struct<rule:string,path:string,observed:string,expected:string>"
)

# The variant type names that count as each JSON type.
JSON_TYPES = {
    "object": "^OBJECT",
    "array": "^ARRAY",
    "string": "^STRING$",
    "boolean": "^BOOLEAN$",
    "null": "^VOID$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
}


@dataclass(frozen=True)
class Field:
    """Rules of one path. ``parent`` must be there before ``required`` is asked."""

    path: str
    types: tuple[str, ...]
    required: bool = False
    enum: tuple = ()
    pattern: str | None = None
    min_length: int | None = None
    minimum: float | None = None
    maximum: float | None = None

    @property
    def parent(self) -> str:
        return self.path.rpartition(".")[0]


def _violation(when: Column, rule: str, path: Column, observed: Column, expected: str) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(rule).alias("rule"),
            path.alias("path"),
            observed.cast("string").alias("observed"),
            F.lit(expected).alias("expected"),
        ),
    )


def _get(doc: str, path: str, typ: str = "variant") -> Column:
    full = "$" if not path else f"$.{path}"
    return F.expr(f"try_variant_get({doc}, '{full}', '{typ}')")


def _schema(v: Column) -> Column:
    return F.call_function("schema_of_variant", v)


def _is(schema: Column, types: Sequence[str]) -> Column:
    return schema.rlike("|".join(f"(?:{JSON_TYPES[t]})" for t in types))


def field_checks(field: Field) -> list[Column]:
    """Violations of one field, from the columns ``_t_<path>`` (type) and ``_x_<path>`` (text)."""
    kind, text = F.col(f"`_t_{field.path}`"), F.col(f"`_x_{field.path}`")
    at = F.lit(field.path)
    right = _is(kind, field.types)
    out = [
        _violation(kind.isNotNull() & ~right, "type", at, kind, "/".join(field.types)),
    ]
    if field.required:
        there = (
            F.col(f"`_t_{field.parent}`").startswith("OBJECT") if field.parent else F.lit(True)
        )
        out.append(_violation(kind.isNull() & there, "required", at, F.lit(None), "present"))
    if field.enum:
        allowed = text.isin(*[e for e in field.enum if e is not None])
        if None in field.enum:
            allowed = allowed | (kind == "VOID")
        listed = ", ".join("null" if e is None else e for e in field.enum)
        out.append(
            _violation(right & ~F.coalesce(allowed, F.lit(False)), "enum", at, text, listed)
        )
    if field.pattern:
        out.append(
            _violation((kind == "STRING") & ~text.rlike(field.pattern), "pattern", at, text, field.pattern)
        )
    if field.min_length is not None:
        short = (kind == "STRING") & (F.length(text) < field.min_length)
        out.append(_violation(short, "min_length", at, text, str(field.min_length)))
    number = text.try_cast("double")
    for name, bound, broken in (
        ("minimum", field.minimum, lambda b: number < b),
        ("maximum", field.maximum, lambda b: number > b),
    ):
        if bound is not None:
            out.append(
                _violation(right & _is(kind, ["number"]) & broken(bound), name, at, text, str(bound))
            )
    return out


@dataclass(frozen=True)
class Family:
    """Rules over one parsed document: ``found``, a function that gives the array of violations, and the paths whose type
    and text it reads from the columns ``_t_<path>`` and ``_x_<path>``."""

    found: Callable[[], Column]
    paths: tuple[str, ...] = ()


def violations(documents: DataFrame, families: Sequence[Family], keep: Sequence[str] = ()) -> DataFrame:
    """What all ``families`` find; each document is read and parsed once. ``keep``: further columns that they read."""
    paths = list(dict.fromkeys(p for f in families for p in f.paths))
    parsed = documents.select("row_id", *keep, F.expr("try_parse_json(doc)").alias("_d"))
    seen = parsed.select(
        "row_id", *keep, "_d",
        *[_schema(_get("_d", p)).alias(f"_t_{p}") for p in paths],
        *[_get("_d", p, "string").alias(f"_x_{p}") for p in paths],
    )
    none = F.array().cast(f"array<{VIOLATION}>")
    found = F.concat(*[F.coalesce(f.found(), none) for f in families])
    return seen.select("row_id", F.explode(found).alias("v")).select("row_id", "v.*")


def _those(checks: Sequence[Column]) -> Column:
    """The violations among ``checks``."""
    return F.filter(F.array(*checks), lambda v: v.isNotNull())


def _each(items: Column, checks: Callable[[Column], Sequence[Column]]) -> Column:
    """The violations of every element of an array."""
    return F.flatten(F.transform(items, lambda x: _those(checks(x))))


def _field(v: Column, name: str, typ: str) -> Column:
    return F.try_variant_get(v, f"$.{name}" if name else "$", typ)


def field_rules(fields: Sequence[Field]) -> Family:
    """Type, required, enum, pattern, length and range rules of a list of fields."""
    parents = {f.parent for f in fields if f.required and f.parent} - {f.path for f in fields}
    return Family(lambda: _those([c for f in fields for c in field_checks(f)]), (*[f.path for f in fields], *sorted(parents)))


def check_fields(documents: DataFrame, fields: Sequence[Field]) -> DataFrame:
    return violations(documents, [field_rules(fields)])


def _undeclared(path: str):
    prefix = f"{path}." if path else ""
    return lambda name: F.struct(
        F.lit("unexpected").alias("rule"),
        F.concat(F.lit(prefix), name).alias("path"),
        name.alias("observed"),
        F.lit("declared field").alias("expected"),
    )


def closed_rules(closed: dict[str, Sequence[str]]) -> Family:
    """Fields of a closed object that are not declared."""

    def found() -> Column:
        none = F.array().cast(f"array<{VIOLATION}>")
        out = []
        for path, allowed in closed.items():
            extra = F.array_except(F.map_keys(_get("_d", path, "map<string,variant>")), F.array(*[F.lit(a) for a in allowed]))
            out.append(F.coalesce(F.transform(extra, _undeclared(path)), none))
        return F.concat(*out)

    return Family(found)


def check_unexpected(documents: DataFrame, closed: dict[str, Sequence[str]]) -> DataFrame:
    return violations(documents, [closed_rules(closed)])


def map_value_rules(path: str, types: Sequence[str], minimum: float, maximum: float) -> Family:
    """Every value of an open object obeys one type and range."""

    def checks(e: Column) -> list[Column]:
        at, kind, text = F.concat(F.lit(f"{path}."), e["key"]), _schema(e["value"]), _field(e["value"], "", "string")
        right, number = _is(kind, types), text.try_cast("double")
        return [
            _violation(~right, "type", at, kind, "/".join(types)),
            _violation(right & (number < minimum), "minimum", at, text, str(minimum)),
            _violation(right & (number > maximum), "maximum", at, text, str(maximum)),
        ]

    return Family(lambda: _each(F.map_entries(_get("_d", path, "map<string,variant>")), checks))


def check_map_values(documents: DataFrame, path: str, types: Sequence[str], minimum: float, maximum: float) -> DataFrame:
    return violations(documents, [map_value_rules(path, types, minimum, maximum)])


def item_rules(path: str, types: Sequence[str]) -> Family:
    """Every item of an array has one of the types; the path carries the index."""

    def checks(item: Column, i: Column) -> list[Column]:
        at = F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))
        kind = _schema(item)
        return [_violation(~_is(F.coalesce(kind, F.lit("VOID")), types), "items", at, kind, "/".join(types))]

    return Family(lambda: F.flatten(F.transform(_get("_d", path, "array<variant>"), lambda x, i: _those(checks(x, i)))))


def check_items(documents: DataFrame, path: str, types: Sequence[str]) -> DataFrame:
    return violations(documents, [item_rules(path, types)])


def identity_rule(stem: str) -> Family:
    """The entry id equals the stem of the file (column ``stem``) the document came from."""
    entry = _get("_d", "entry_id", "string")
    name = F.regexp_replace(F.regexp_extract(F.col(stem), "([^/]+)$", 1), r"\.json$", "")
    return Family(lambda: _those([_violation(~entry.eqNullSafe(name), "identity", F.lit("entry_id"), entry, "file stem")]))


def check_identity(documents: DataFrame, stem: str) -> DataFrame:
    return violations(documents, [identity_rule(stem)], [stem])


def metrics(documents: DataFrame, results: str = "results", skip=("by_tier", "by_session")) -> DataFrame:
    """(row_id, metric, mean, std, runs, reason, declared_runs) of every metric of a document."""
    entries = F.map_entries(_get("_d", results, "map<string,variant>"))
    field = lambda name, typ: F.expr(f"try_variant_get(e.value, '$.{name}', '{typ}')")
    return (
        documents.select("row_id", F.expr("try_parse_json(doc)").alias("_d"))
        .select(
            "row_id",
            _get("_d", "protocol.runs", "bigint").alias("declared_runs"),
            F.explode(entries).alias("e"),
        )
        .where(~F.col("e.key").isin(*skip))
        .select(
            "row_id",
            F.col("e.key").alias("metric"),
            field("mean", "double").alias("mean"),
            field("std", "double").alias("std"),
            field("runs", "array<double>").alias("runs"),
            field("unavailable_reason", "string").alias("reason"),
            "declared_runs",
        )
    )


def run_mean(runs: Column) -> Column:
    known = F.filter(runs, lambda r: r.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, r: a + r), F.size(known))


def run_std(runs: Column) -> Column:
    known = F.filter(runs, lambda r: r.isNotNull())
    squares = lambda m: F.aggregate(known, F.lit(0.0), lambda a, r: a + (r - m) * (r - m))
    return F.when(F.size(known) > 1, F.sqrt(squares(run_mean(runs)) / (F.size(known) - 1)))


def metric_rules(std_too: bool = False, results: str = "results", skip: Sequence[str] = ("by_tier", "by_session")) -> Family:
    """Published mean, run count and reason of every metric against its own runs."""

    def checks(e: Column) -> list[Column]:
        v, at = e["value"], F.concat(F.lit(f"{results}."), e["key"])
        mean, runs = _field(v, "mean", "double"), _field(v, "runs", "array<double>")
        has = F.size(runs) > 0
        near = lambda c: F.greatest(F.lit(5e-4), F.lit(1e-3) * F.abs(c))
        out = [
            _violation(has & (F.abs(run_mean(runs) - mean) > near(mean)), "mean_of_runs", at, mean, "mean of runs"),
            _violation(
                has & mean.isNotNull() & (F.size(runs) != _get("_d", "protocol.runs", "bigint")),
                "run_count", at, F.size(runs), "protocol.runs",
            ),
            _violation(
                mean.isNull() & (F.coalesce(_field(v, "unavailable_reason", "string"), F.lit("")) == ""),
                "null_reason", at, F.lit(None), "unavailable_reason",
            ),
        ]
        if std_too:
            std = _field(v, "std", "double")
            out.append(_violation(F.abs(run_std(runs) - std) > near(std), "std_of_runs", at, std, "sample std of runs"))
        return out

    kept = lambda e: ~e["key"].isin(*skip)
    return Family(lambda: _each(F.filter(F.map_entries(_get("_d", results, "map<string,variant>")), kept), checks))


def check_metrics(documents: DataFrame, std_too: bool = False) -> DataFrame:
    return violations(documents, [metric_rules(std_too)])


METRIC_FIELDS = ("mean", "std", "runs", "n", "unavailable_reason")  # fixed values

# Declared fields of each section of an entry.
ENTRY_CLOSED = {
    "": ("entry_id", "system", "model", "protocol", "results", "declarations"),
    "system": ("name", "version", "organization", "url", "paper", "code", "open_source", "kind", "arm"),
    "model": (
        "name", "provider", "access", "training_cutoff", "temperature", "controlled", "config_note",
    ),
    "protocol": (
        "split", "corpus_version", "data_snapshot_id", "scorer_version", "runs", "denominator",
        "attempted", "evidence_provided", "verified_by_organizers", "evaluated_at",
    ),
    "declarations": ("canary_check", "test_data_seen", "human_in_loop", "artifacts", "notes"),
}

# Type and value rules of an entry's fields.
ENTRY_FIELDS = (
    Field("entry_id", ("string",), True, pattern="^[0-9]{4}-[0-9]{2}-[0-9]{2}-[a-z0-9][a-z0-9-]*$"),
    Field("system", ("object",), True),
    Field("system.name", ("string",), True, min_length=1),
    Field("system.version", ("string", "null")),
    Field("system.organization", ("string",), True, min_length=1),
    Field("system.url", ("string", "null")),
    Field("system.paper", ("string", "null")),
    Field("system.code", ("string", "null")),
    Field("system.open_source", ("boolean",), True),
    Field("system.kind", ("string",), enum=("agent", "single-call", "framework", "human", "reference")),
    Field("system.arm", ("string",), True, enum=("controlled", "commercial")),
    Field("model", ("object",), True),
    Field("model.name", ("string", "null"), True),
    Field("model.provider", ("string", "null")),
    Field("model.access", ("string",), True, enum=("api", "open-weights", "local", "none")),
    Field("model.training_cutoff", ("string", "null")),
    Field("model.temperature", ("number", "null")),
    Field("model.controlled", ("boolean", "null")),
    Field("model.config_note", ("string", "null")),
    Field("protocol", ("object",), True),
    Field("protocol.split", ("string",), True, enum=("sample", "dev", "test", "full")),
    Field("protocol.corpus_version", ("string",), True),
    Field("protocol.data_snapshot_id", ("string",), True),
    Field("protocol.scorer_version", ("string",), True),
    Field("protocol.runs", ("integer",), True, minimum=1),
    Field("protocol.denominator", ("integer",), True),
    Field("protocol.attempted", ("integer", "null")),
    Field("protocol.evidence_provided", ("boolean", "null")),
    Field("protocol.verified_by_organizers", ("boolean",)),
    Field("protocol.evaluated_at", ("string",), True),
    Field("results", ("object",), True),
    Field("results.execution_accuracy", ("object",), True),
    Field("declarations", ("object",), True),
    Field("declarations.canary_check", ("string", "null"), enum=("passed", "failed", "not-applicable", None)),
    Field("declarations.test_data_seen", ("boolean",), True),
    Field("declarations.human_in_loop", ("boolean",), True),
    Field("declarations.artifacts", ("string", "null")),
    Field("declarations.notes", ("string", "null")),
)

# Rules of one metric and of one session cell, relative to their object.
METRIC_RULES = (
    ("mean", ("number", "null"), True, None),
    ("std", ("number", "null"), False, None),
    ("runs", ("array",), False, None),
    ("n", ("integer", "null"), False, None),
    ("unavailable_reason", ("string", "null"), False, None),
)
SESSION_RULES = (
    ("turns_passed", ("integer",), True, 0),
    ("turns_total", ("integer",), True, 1),
    ("session_passed", ("boolean",), True, None),
)


def object_rules(path: str, rules, skip: Sequence[str] = ()) -> Family:
    """Every value of an open object is itself an object with the given closed set of fields."""
    allowed = [n for n, *_ in rules]

    def checks(e: Column) -> list[Column]:
        base, kind = F.concat(F.lit(f"{path}."), e["key"]), _schema(e["value"])
        is_object = kind.startswith("OBJECT")
        extra = F.array_except(F.map_keys(_field(e["value"], "", "map<string,variant>")), F.array(*[F.lit(n) for n in allowed]))
        out = [
            _violation(~is_object, "type", base, kind, "object"),
            _violation(F.size(extra) > 0, "unexpected", base, F.array_join(extra, ","), "declared field"),
        ]
        for name, types, required, low in rules:
            own, at, number = _schema(_field(e["value"], name, "variant")), F.concat(base, F.lit(f".{name}")), _field(e["value"], name, "double")
            out.append(_violation(own.isNotNull() & ~_is(own, types), "type", at, own, "/".join(types)))
            if required:
                out.append(_violation(is_object & own.isNull(), "required", at, own, "present"))
            if low is not None:
                out.append(_violation(number < low, "minimum", at, number, str(low)))
        return out

    kept = lambda e: ~e["key"].isin(*skip) if skip else F.lit(True)
    return Family(lambda: _each(F.filter(F.map_entries(_get("_d", path, "map<string,variant>")), kept), checks))


def check_objects(documents: DataFrame, path: str, rules, skip: Sequence[str] = ()) -> DataFrame:
    return violations(documents, [object_rules(path, rules, skip)])


def entry_rules(stem: str | None = None) -> list[Family]:
    """All rules of an entry."""
    out = [
        field_rules(ENTRY_FIELDS),
        closed_rules(ENTRY_CLOSED),
        map_value_rules("results.by_tier", ("number",), 0.0, 1.0),
        object_rules("results", METRIC_RULES, ("by_tier", "by_session")),
        object_rules("results.by_session", SESSION_RULES),
        metric_rules(),
    ]
    return [*out, identity_rule(stem)] if stem else out


def check_entries(documents: DataFrame, stem: str | None = None) -> DataFrame:
    """All rules of an entry document, in one scan; row-local, so it also runs on a stream."""
    return violations(documents, entry_rules(stem), [stem] if stem else [])
