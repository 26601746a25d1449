from pyspark.sql import functions as F

from tarnwell.operators import capture as C
from tarnwell.operators import chunking
from tarnwell.sources import embedding as E


def test_capture_and_materialize(spark):
    class Picky(E.HashClient):
        def embed(self, texts):
            if "down" in texts:
                raise E.Retryable("later")
            if "bad" in texts:
                return [(0, [float("nan")] * self.dimensions)]
            return super().embed(texts)

    keys = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "bb"), ("3", "down"), ("4", "bad"), ("5", "old"), ("6", "known")], "hash string, text string")
    bank = spark.createDataFrame([("6", [1.0] * 8, "x")], "hash string, vector array<float>, sha256 string")
    failures = spark.createDataFrame([(1, "5", "retryable"), (2, "5", "terminal"), (1, "2", "terminal"), (3, "2", "retryable")], "id long, hash string, classification string")
    assert tuple(C.summary(C.plan(keys, bank, failures)).first()) == (6, 1, 1, 4, 10)
    new, failed = C.capture(keys, bank, failures, lambda: Picky(8), 8, most=1, waits=())
    assert sorted(r.hash for r in new.collect()) == ["1", "2"]
    assert sorted((r.hash, r.classification) for r in failed.collect()) == [("3", "retryable"), ("4", "terminal")]
    served = C.materialize(bank.unionByName(new), 4).collect()
    assert len(served) == 3 and all(max(map(abs, r.codes)) == 127 and abs(r.norm - 1) < 0.02 for r in served)


def test_diagnostics_mark_unsafe_chunks(spark):
    rows = [("a.go", "go", "package a\n\nfunc F() {\n\tx := ([)\n}\n"), ("b.ts", "ts", "export function ok() { return /[{(]/; }\n"), ("c.ts", "ts", "function g() { return 1; }\n/* open")]
    files = spark.createDataFrame(rows, "path string, language string, body string")
    found = chunking.diagnose_files(files)
    assert {r.path for r in found.collect()} == {"a.go", "c.ts"}
    assert {r.qualified for r in chunking.unsafe_chunks(chunking.chunk_files(files), found).collect()} == {"a.F"}
    assert chunking.chunk_files(files.select("path", F.lit("zz").alias("language"), "body")).count() == 0
