"""Traits of files, declarations, queries and occurrences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names by which a path tells its file's role, the strongest first.
ROLE_PATTERNS = (
    ("EXAMPLE", r"_example_test\.go$|\.example\.[^/]*$|/examples?/|(^|/)example_[^/]*$"),
    ("BENCHMARK", r"_bench_test\.go$|benchmark[^/]*$|\.bench\.[^/]*$|(^|/)bench_[^/]*$|/benchmarks?/"),
    ("TEST", r"_test\.go$|\.test\.[^/]*$|/tests?/"),
)
# Languages by extension.
LANGUAGES = {"go": "go", "ts": "typescript", "tsx": "tsx"}
# Words of a query that state an intent.
SIGNATURE_WORDS = ("contract", "props", "type", "interface", "signature", "options", "schema")
VALUE_PARAMETER_WORDS = ("contract", "props")
MUTATION_WORDS = ("mutate", "set", "write", "assign")
CONDITION_WORDS = ("condition", "when")
ROLE_WORDS = {"test": "TEST", "tests": "TEST", "example": "EXAMPLE", "examples": "EXAMPLE", "benchmark": "BENCHMARK", "benchmarks": "BENCHMARK", "bench": "BENCHMARK"}
# Closure class by the role of a type reference; other roles have none.
CLOSURE_CLASSES = {
    "TYPE_VALUE_PARAMETER": "VALUE_PARAMETER",
    "TYPE_RETURN": "RETURN",
    "TYPE_PARAMETER": "GENERIC_CONSTRAINT",
    "TYPE_HERITAGE": "HERITAGE",
    "TYPE_FIELD": "SIGNATURE",
    "TYPE_ALIAS": "SIGNATURE",
    "TYPE_ARGUMENT": "SIGNATURE",
    "TYPE_OTHER": "SIGNATURE",
}


def cleaned_path(path: Column) -> Column:
    """Lower case, without empty and ``.`` steps."""
    return F.regexp_replace(F.lower(path), r"/(?:\./|/)+", "/")


def file_role(path: Column) -> Column:
    lower = cleaned_path(path)
    found = F.coalesce(*(F.when(lower.rlike(pattern), F.lit(role)) for role, pattern in ROLE_PATTERNS))
    return F.coalesce(found, F.lit("PRODUCTION"))


def language(path: Column) -> Column:
    """Language by extension, null if it has none that is known."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), extension)


def deprecated(lang: Column, body: Column) -> Column:
    """Whether the whole comment that a declaration begins with marks it as deprecated."""
    lines = F.regexp_extract(body, r"^\s*((?://[^\n]*(?:\n[^\S\n]*)?)+)", 1)
    block = F.regexp_extract(body, r"(?s)^\s*(/\*\*.*?)\*/", 1)
    return F.when(lang == "go", F.contains(lines, F.lit("Deprecated:"))).otherwise(F.contains(block, F.lit("@deprecated")))


def intents(tokens: Column) -> dict[str, Column]:
    """Features of a query's normalized tokens (an array): flags, direction and the file roles it names."""
    some = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    back = some(("caller",)) | (some(("used",)) & some(("by",)))
    roles = F.transform(F.filter(tokens, lambda t: t.isin(*ROLE_WORDS)), lambda t: F.element_at(F.create_map(*(F.lit(x) for pair in ROLE_WORDS.items() for x in pair)), t))
    return {
        "signature": some(SIGNATURE_WORDS),
        "value_parameter": some(VALUE_PARAMETER_WORDS),
        "mutation": some(MUTATION_WORDS),
        "returns": some(("return",)),
        "condition": some(CONDITION_WORDS),
        "deprecated": some(("deprecated",)),
        "direction": F.when(back, F.lit("REVERSE")).otherwise(F.lit("FORWARD")),
        "roles": F.array_join(F.array_sort(F.array_distinct(roles)), ","),
    }


# Structural tiers, the strongest first, by kind of relation and zone.
TIERS = ("DECLARATION_CONTRACT", "EXECUTABLE_DEPENDENCY", "BODY_REFERENCE", "DECLARATION_STRUCTURE")


def structural_tier(kind: Column, zone: Column) -> Column:
    """Tier of a resolved occurrence: declared types, then calls, then types in bodies, then members; null for anything else."""
    typed = kind == "TYPE_REF"
    return (
        F.when(typed & zone.isin("SIGNATURE", "TYPE_BODY"), F.lit(TIERS[0]))
        .when(kind == "CALL", F.lit(TIERS[1]))
        .when(typed & zone.isin("BODY", "INITIALIZER"), F.lit(TIERS[2]))
        .when(kind == "MEMBER", F.lit(TIERS[3]))
    )


def tier_place(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier).cast("int")


def admission_prefix(feature: dict[str, Column], fact: dict[str, Column]) -> dict[str, Column]:
    """What a fact is held against a query by, in order; less is better, overlaps count against zero.

    ``feature`` has the query's tokens and the columns of ``intents``; ``fact`` has kind,
    zone, role, flow, direction, file_role, context, anchor_tokens, endpoint_tokens,
    anchor_path, endpoint_path, anchor_deprecated and endpoint_deprecated.
    """
    bit = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0))
    shared = lambda name: -F.size(F.array_intersect(feature["tokens"], fact[name]))
    named = feature["roles"] != ""
    qualifier = (feature["deprecated"] & ~fact["anchor_deprecated"] & ~fact["endpoint_deprecated"]) | (named & ~F.array_contains(F.split(feature["roles"], ","), fact["file_role"]))
    declared = fact["zone"].isin("SIGNATURE", "TYPE_BODY")
    value = (fact["direction"] == "FORWARD") & (fact["kind"] == "TYPE_REF") & (fact["zone"] == "SIGNATURE") & (fact["role"] == "TYPE_VALUE_PARAMETER")
    intent = (
        (feature["signature"] & ~(declared & (fact["kind"] == "TYPE_REF")))
        | (feature["mutation"] & (fact["flow"] != "ASSIGNMENT"))
        | (feature["returns"] & (fact["flow"] != "RETURN"))
        | (feature["condition"] & (fact["flow"] != "CONDITION"))
        | (feature["direction"] != fact["direction"])
    )
    return {
        "qualifier_mismatch": bit(qualifier),
        "value_parameter_mismatch": bit(feature["value_parameter"] & ~value),
        "context_overlap": shared("context"),
        "endpoint_overlap": shared("endpoint_tokens"),
        "anchor_overlap": shared("anchor_tokens"),
        "intent_mismatch": bit(intent),
        "other_file": bit(fact["anchor_path"] != fact["endpoint_path"]),
        "not_production": bit(~named & (fact["file_role"] != "PRODUCTION")),
    }


def closure_class(role: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in CLOSURE_CLASSES.items() for x in pair)), role)


def enclosing(spans: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Each span (keys, span, lo, hi) with its smallest enclosing parent (keys, parent, lo, hi), the first of equals; null if none.

    Parents and spans of one file meet by an equi-join, and the smallest is an aggregate.
    """
    p = parents.select(*(F.col(k).alias(f"of_{k}") for k in keys), "parent", F.col("lo").alias("from"), F.col("hi").alias("to"))
    inside = (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
    same = [F.col(k) == F.col(f"of_{k}") for k in keys]
    rows = spans.join(p, [*same, inside], "left")
    best = F.min(F.when(F.col("parent").isNotNull(), F.struct((F.col("to") - F.col("from")).alias("width"), "parent")))
    return rows.groupBy(*keys, "span", "lo", "hi").agg(best["parent"].alias("parent"))
