"""Plans over source code. The driver's tables hold none, so a small file is written out for each part."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.operators import chunking
from tarnwell.operators.graph import resolve_names
from tarnwell.operators.traits import ROLE_PATTERNS
from tarnwell.plans.frames import frame
from tarnwell.plans.relations import Data

#: Two files of each language. The second ones have generics, literals that look like code, grouped
#: types, receivers of both kinds, a closure in a variable, overloads, an accessor and a class field.
_GO = (
    "package pkg{p}\n\n// Make{k} builds.\nfunc Make{k}(n int) int {\n\treturn n + {s}\n}\n\ntype Part{k} struct {\n\tSize int\n}\n\nfunc (p *Part{k}) Grow() int {\n\treturn Make{k}(p.Size)\n}\n",
    """package pkg{p}

import "fmt"

// far comment

// Make{k} builds
// a slice.
func Make{k}[T any](v ...T) []T {
	f := func() []T { return v }
	if s := "func Fake() {"; len(s) > 3 {
		fmt.Println(s, '}', `raw } {`)
	}
	return f()
}

type (
	A{k} struct{ X int }
	B{k} interface {
		Do()
	}
)

func (a A{k}) Do() {}

func (b *Box[K, V]) Get(k K) V { return b.m[k] }

var Fn{k} = func() int { return 1 }
""",
)
_TS = (
    "/** Builds. */\nexport function make{k}(n: number): number {\n  return n + {s};\n}\n\nexport class Part{k} {\n  grow(): number { return make{k}(1); }\n}\n\nexport const twice{k} = (n: number) => n * 2;\n",
    """import { x } from "./x";

/** Overloads. */
export function pick{k}(a: string): string;
export function pick{k}(a: number): number;
export function pick{k}(a: any) {
  return `${a} }`;
}

export abstract class Box{k}<T> extends Base {
  static make(): Box{k}<any> { return new Impl(); }
  get size(): number { return 1; }
  run = async (n: number) => {
    return n;
  };
  constructor(private v: T) { super(); }
}

export default function () { return 1; }

const helper{k} = function inner() { return "}"; };
""",
)


def _filled(templates: tuple[str, str]) -> F.Column:
    text = F.when(F.col("p_partkey") % 2 == 0, F.lit(templates[0])).otherwise(F.lit(templates[1]))
    for mark, column in (("{p}", (F.col("p_partkey") % 50).cast("string")), ("{k}", F.col("p_partkey").cast("string")), ("{s}", F.col("p_size").cast("string"))):
        text = F.replace(text, F.lit(mark), column)
    return text


def code_files(d: Data) -> DataFrame:
    """One Go and one TypeScript file for each part, of two shapes."""
    name = F.concat(F.lit("pkg"), (F.col("p_partkey") % 50).cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"))
    part = chunking.spread(d.part.select("p_partkey", "p_size"), "p_partkey")
    go = part.select(F.concat(name, F.lit(".go")).alias("path"), F.lit("go").alias("language"), _filled(_GO).alias("body"))
    return go.unionAll(part.select(F.concat(name, F.lit(".ts")), F.lit("ts"), _filled(_TS)))


_PATH = "'pkg' || (p_partkey % 50) || '/f' || p_partkey"


@frame(
    "C01_go_chunks",
    f"""SELECT {_PATH} || '.go' AS path, kind, replace(replace(qualified, '@', CAST(p_partkey AS VARCHAR)), '%', CAST(p_partkey % 50 AS VARCHAR)) AS qualified, replace(signature, '@', CAST(p_partkey AS VARCHAR)) AS signature, start_line, end_line FROM {{part}} CROSS JOIN
    (VALUES (0, 'function', 'pkg%.Make@', 'func Make@(n int) int', 3, 6), (0, 'type', 'pkg%.Part@', 'type Part@ struct', 8, 10), (0, 'method', 'pkg%.Part@.Grow', 'func (p *Part@) Grow() int', 12, 14),
    (1, 'function', 'pkg%.Make@', 'func Make@[T any](v ...T) []T', 7, 15), (1, 'type', 'pkg%.A@', 'A@ struct', 18, 18), (1, 'type', 'pkg%.B@', 'B@ interface', 19, 21), (1, 'method', 'pkg%.A@.Do', 'func (a A@) Do()', 24, 24),
    (1, 'method', 'pkg%.Box.Get', 'func (b *Box[K, V]) Get(k K) V', 26, 26)) AS t(shape, kind, qualified, signature, start_line, end_line) WHERE shape = p_partkey % 2""",
)
def _c01(d: Data) -> DataFrame:
    rows = chunking.chunk_files(code_files(d).where("language = 'go'"))
    return rows.select("path", "kind", "qualified", "signature", "start_line", "end_line")


@frame(
    "C02_ts_chunks",
    f"""SELECT {_PATH} || '.ts' AS path, kind, replace(qualified, '@', CAST(p_partkey AS VARCHAR)) AS qualified, start_line, end_line FROM {{part}} CROSS JOIN
    (VALUES (0, 'function', 'make@', 1, 4), (0, 'class', 'Part@', 6, 8), (0, 'method', 'Part@.grow', 7, 7), (0, 'function', 'twice@', 10, 10),
    (1, 'function', 'pick@', 3, 8), (1, 'class', 'Box@', 10, 17), (1, 'method', 'Box@.make', 11, 11), (1, 'method', 'Box@.size', 12, 12), (1, 'method', 'Box@.run', 13, 15), (1, 'method', 'Box@.constructor', 16, 16),
    (1, 'function', 'f@.default', 19, 19), (1, 'function', 'helper@', 21, 21)) AS t(shape, kind, qualified, start_line, end_line) WHERE shape = p_partkey % 2""",
)
def _c02(d: Data) -> DataFrame:
    rows = chunking.chunk_files(code_files(d).where("language = 'ts'"))
    return rows.select("path", "kind", "qualified", "start_line", "end_line")


CALLS = "path string, package string, caller string, ordinal int, name string, line long, zone string, role string"


def occurrences(chunks: DataFrame) -> DataFrame:
    """Calls in the bodies of functions and methods: caller, name, line, zone, the file's role.

    A call on a declaration's first line stands in its signature; the callee's
    own name there is not a call.
    """

    def run(batches):
        from tarnwell.operators.scan_go import calls

        names = [c.split(" ")[0] for c in CALLS.split(", ")]
        for b in batches:
            out = []
            for path, caller, symbol, head, first, body in zip(b["path"], b["qualified"], b["symbol"], b["signature"], b["start_line"], b["body"]):
                role = next((r for r, pattern in ROLE_PATTERNS if re.search(pattern, path.lower())), "PRODUCTION")
                found = [(n, at) for n, at in calls(body) if n != symbol]
                for k, (name, at) in enumerate(found, 1):
                    line = body.count("\n", 0, at)
                    zone = "SIGNATURE" if at < len(head) and line == 0 else "BODY"
                    out.append((path, path.rsplit("/", 1)[0], caller, k, name, first + line, zone, role))
            yield pd.DataFrame(out, columns=names)

    slim = chunks.where("kind IN ('function', 'method')").select("path", "qualified", "symbol", "signature", "start_line", "body")
    return slim.mapInPandas(run, CALLS)


@frame(
    "C12_occurrences",
    f"""SELECT {_PATH} || '.go' AS path, 'pkg' || (p_partkey % 50) || replace(caller, '@', CAST(p_partkey AS VARCHAR)) AS caller, replace(name, '@', CAST(p_partkey AS VARCHAR)) AS name, line, 'BODY' AS zone, 'PRODUCTION' AS role FROM {{part}} CROSS JOIN
    (VALUES (0, '.Part@.Grow', 'Make@', 13), (1, '.Make@', 'len', 11), (1, '.Make@', 'Println', 12), (1, '.Make@', 'f', 14)) AS t(shape, caller, name, line) WHERE shape = p_partkey % 2""",
)
def _c12(d: Data) -> DataFrame:
    return occurrences(chunking.chunk_files(code_files(d).where("language = 'go'"))).select("path", "caller", "name", "line", "zone", "role")


@frame(
    "C14_resolved_calls",
    """SELECT 'pkg' || (p_partkey % 50) || replace(caller, '@', CAST(p_partkey AS VARCHAR)) AS caller, outcome, CASE WHEN outcome = 'RESOLVED_UNIQUE' THEN 'pkg' || (p_partkey % 50) || '.Make' || p_partkey END AS target FROM {part} CROSS JOIN
    (VALUES (0, '.Part@.Grow', 'RESOLVED_UNIQUE'), (1, '.Make@', 'UNRESOLVED'), (1, '.Make@', 'UNRESOLVED'), (1, '.Make@', 'UNRESOLVED')) AS t(shape, caller, outcome) WHERE shape = p_partkey % 2""",
)
def _c14(d: Data) -> DataFrame:
    chunks = chunking.chunk_files(code_files(d).where("language = 'go'"))
    refs = occurrences(chunks).select(F.concat_ws("#", "caller", F.col("ordinal").cast("string")).alias("ref_id"), "name", "package")
    defs = chunks.where("kind IN ('function', 'method')").select(F.col("qualified").alias("def_id"), F.col("symbol").alias("name"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("package"))
    return resolve_names(refs, defs).select(F.substring_index("ref_id", "#", 1).alias("caller"), "outcome", "target")


@frame("C04_doc_comments", f"SELECT {_PATH} || '.go' AS path, '// Make' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ' builds.' ELSE ' builds' END AS doc FROM {{part}}")
def _c04(d: Data) -> DataFrame:
    rows = chunking.chunk_files(code_files(d).where("language = 'go'")).where("kind = 'function'")
    return rows.select("path", F.substring_index("body", "\n", 1).alias("doc"))


# --- composite plans -----------------------------------------------------------------------------


@frame("R05_control_terms", "SELECT qid, term, rank FROM (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM {query_terms}) WHERE rank <= 16")
def _r05(d: Data) -> DataFrame:
    """The control's terms: distinct first, then the limit."""
    from pyspark.sql import Window

    return d.query_terms.select("qid", "term", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).alias("rank")).where("rank <= 16")
