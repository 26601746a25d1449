"""Plans over syntax units: files with as many statements and members as a part has by its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.operators import chunking
from tarnwell.plans.frames import frame
from tarnwell.plans.relations import Data

TARGET = 160

#: A function of p_size statements, then a return; a class of p_size % 5 + 1 methods after a field; a type of call signatures.
_LINE = "concat('n += ', cast(i * i * 7 + p_partkey as string))"


def _files(d: Data) -> DataFrame:
    lines = F.expr(f"array_join(transform(sequence(0, p_size - 1), i -> {_LINE}), '\n\t')")
    go = F.concat(F.lit("package seg\n\nfunc Long"), F.col("p_partkey").cast("string"), F.lit("(n int) int {\n\t"), lines, F.lit("\n\t// done\n\treturn n\n}\n"))
    methods = F.expr("array_join(transform(sequence(0, p_size % 5), j -> concat('  m', cast(j as string), '() { return ', cast(j * p_partkey as string), '; }\n')), '')")
    ts = F.concat(F.lit("export class Big"), F.col("p_partkey").cast("string"), F.lit(" {\n  size = 1;\n"), methods, F.lit("}\n"))
    name = F.concat(F.lit("seg/f"), F.col("p_partkey").cast("string"))
    rows = d.part.select(F.concat(name, F.lit(".go")).alias("path"), F.lit("go").alias("language"), go.alias("body"))
    return rows.unionAll(d.part.select(F.concat(name, F.lit(".ts")), F.lit("ts"), ts))


_HEAD = "strlen('func Long' || p_partkey || '(n int) int {') + 2"
_SIZES = "list_append(list_transform(range(0, p_size), lambda i: strlen('n += ' || (i * i * 7 + p_partkey))), 0)"
#: Starts and ends of the units, the last of which begins with its comment; two bytes stand between units.
_UNITS = f"""SELECT p_partkey, {_HEAD} AS header, list_append(list_transform(range(1, p_size + 1), lambda i: {{'a': CAST({_HEAD} + coalesce(list_sum(sizes[1:i - 1]), 0) + 2 * (i - 1) AS BIGINT), 'b': CAST({_HEAD} + list_sum(sizes[1:i]) + 2 * (i - 1) AS BIGINT)}}),
  {{'a': CAST({_HEAD} + list_sum(sizes) + 2 * p_size AS BIGINT), 'b': CAST({_HEAD} + list_sum(sizes) + 2 * p_size + strlen('// done') + 2 + strlen('return n') AS BIGINT)}}) AS units FROM (SELECT *, {_SIZES} AS sizes FROM {{part}})"""
_GROUPS = f"list_reduce(list_transform(units, lambda u: [{{'n': CAST(1 AS BIGINT), 'a': u.a, 'b': u.b}}]), lambda s, x: CASE WHEN header + x[1].b - s[-1].a <= {TARGET} THEN list_append(s[1:-2], {{'n': s[-1].n + 1, 'a': s[-1].a, 'b': x[1].b}}) ELSE list_concat(s, x) END)"


@frame(
    "C05_unit_segments",
    f"""SELECT 'seg.Long' || p_partkey AS qualified, CAST(k - 1 AS INT) AS number, CASE WHEN whole THEN 0 ELSE g.n END AS units, CASE WHEN whole THEN 0 ELSE header END AS header, CASE WHEN whole THEN 0 ELSE g.a END AS start, CASE WHEN whole THEN g.b + 2 ELSE g.b END AS stop
    FROM (SELECT p_partkey, header, whole, unnest(groups) AS g, generate_subscripts(groups, 1) AS k FROM (
      SELECT p_partkey, header, units[-1].b + 2 <= {TARGET} AS whole, CASE WHEN units[-1].b + 2 <= {TARGET} THEN [{{'n': CAST(0 AS BIGINT), 'a': CAST(0 AS BIGINT), 'b': units[-1].b}}] ELSE {_GROUPS} END AS groups FROM ({_UNITS})))""",
)
def _c05(d: Data) -> DataFrame:
    """Segments of whole statements, each with the function's header; a comment stays with the statement after it."""
    chunks = chunking.chunk_files(_files(d).where("language = 'go'"))
    return chunking.unit_segments(chunks, TARGET).select("qualified", "number", "units", "header", "start", "stop")


_CLASS = "'export class Big' || p_partkey || ' {' || chr(10) || '  size = 1;' || chr(10)"
_METHOD = "'  m' || j || '() { return ' || (j * p_partkey) || '; }' || chr(10)"
_OPEN = "strlen('  m' || j || '() ')"


@frame(
    "C06_class_projections",
    f"""SELECT 'Big' || p_partkey AS qualified, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS ranges FROM (
    SELECT p_partkey, coalesce(lag(place + size - 1) OVER (PARTITION BY p_partkey ORDER BY j), 0) AS lo, CASE WHEN final THEN place + 1 ELSE place + opened END AS hi FROM (
      SELECT p_partkey, j, final, opened, size, CAST(strlen({_CLASS}) + coalesce(sum(size) OVER (PARTITION BY p_partkey ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM (
        SELECT p_partkey, j, j = p_size % 5 + 1 AS final, {_OPEN} AS opened, strlen({_METHOD}) AS size FROM (SELECT p_partkey, p_size, unnest(range(0, CAST(p_size % 5 + 2 AS BIGINT))) AS j FROM {{part}})))) GROUP BY p_partkey""",
)
def _c06(d: Data) -> DataFrame:
    """A class's own text: all of it but its methods' bodies."""
    chunks = chunking.chunk_files(_files(d).where("language = 'ts'"))
    rows = chunking.own_projections(chunks).where("qualified LIKE 'Big%'")
    return rows.select("qualified", F.array_join(F.transform("projections", lambda r: F.concat_ws("-", r["start"].cast("string"), r["stop"].cast("string"))), ",").alias("ranges"))


def _aliases(d: Data) -> DataFrame:
    """A type of p_size % 4 + 1 generic call signatures and a function after it, with terminators in every second file."""
    end = F.when(F.col("p_partkey") % 2 == 0, F.lit(";")).otherwise(F.lit(""))
    members = F.expr("transform(sequence(0, p_size % 4), j -> concat('  <T', cast(j as string), '>(a: T', cast(j as string), '): T', cast(j as string)))")
    body = F.concat(F.lit("export type Call"), F.col("p_partkey").cast("string"), F.lit(" = {\n"), F.array_join(F.transform(members, lambda m: F.concat(m, end, F.lit("\n"))), ""), F.lit("}\nexport function after"), F.col("p_partkey").cast("string"), F.lit("() { return 1; }\n"))
    return d.part.select(F.concat(F.lit("sig/f"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), F.lit("ts").alias("language"), body.alias("body"))


@frame(
    "C08_missing_terminators",
    """SELECT 'Call' || p_partkey AS qualified, 'type' AS kind, 1 AS start_line, p_size % 4 + 3 AS end_line, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE p_size % 4 END AS recovered FROM {part}
    UNION ALL SELECT 'after' || p_partkey, 'function', p_size % 4 + 4, p_size % 4 + 4, 0 FROM {part}""",
)
def _c08(d: Data) -> DataFrame:
    """Types whose call signatures lack terminators give the chunks of those with them; how many were put in by the second reading."""
    from tarnwell.operators.scan_ts import recover
    from tarnwell.operators.source_text import mask

    rows = chunking.chunk_files(_aliases(d))
    places = F.udf(lambda body: len(recover(mask(body, regexes=True))[1]), "int")
    return rows.select("qualified", "kind", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), places("body").alias("recovered"))
