"""Indexing and search over a worktree: reindex, search, read_span, status."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.functions import text as X
from tarnwell.functions import vectors as V
from tarnwell.operators import capture, chunking, fusion, lexical, packing, store
from tarnwell.operators.query import effective_shape, plan_query
from tarnwell.sources import worktree
from tarnwell.sources.config import Config, profiles
from tarnwell.sources.embedding import Client, Retryable, call, embed
from tarnwell.sources.generations import Delta, GenerationStore
from tarnwell.sources.published import staged


@dataclass(frozen=True)
class Plan:
    added: int
    changed: int
    deleted: int
    reused: int
    applied: bool
    generation: int


class Index:
    """A search index of one worktree, kept in a generation store."""

    def __init__(self, spark: SparkSession, root: str, folder: str, config: Config | None = None, client: Client | None = None):
        self.spark, self.root, self.config, self.client = spark, os.path.realpath(root), config or Config(), client
        self.store = GenerationStore(spark, folder)

    # --- indexing ---------------------------------------------------------------------

    def _live(self) -> DataFrame:
        return worktree.files_frame(self.spark, self.root, self.config.source_cap_bytes)

    def reindex(self, dry_run: bool = False) -> Plan:
        """Bring the index to the worktree's state; only new and changed files are scanned again.

        What is written is in proportion to the change: rows of new chunks, their postings,
        lengths and segments, and the keys of what goes. Vectors are kept by the hash of a
        segment's text, so they outlive it.
        """
        at = self.store.active()
        live = self._live().cache()
        old = self.store.read("files", at).select("path", F.col("indexed_sha256").alias("sha"))
        plan = store.change_plan(live, old).cache()
        try:
            counts = {r["status"]: r["n"] for r in plan.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
            n = {k: counts.get(k, 0) for k in ("added", "changed", "deleted", "reused")}
            if dry_run or not (n["added"] + n["changed"] + n["deleted"]):
                return Plan(**n, applied=False, generation=at["generation"])
            files = live.select(F.xxhash64("path").alias("id"), "path", "language", F.col("sha").alias("indexed_sha256"), F.lit(0).cast("long").alias("observed_mtime_ns"), F.col("size").cast("long").alias("observed_size"))
            fresh = live.join(plan.where("status IN ('added', 'changed')").select("path"), "path", "left_semi")
            scanned = chunking.chunk_files(fresh).withColumn("id", F.xxhash64("path", "qualified", "start_byte")).cache()
            new = scanned.select(
                "id", F.xxhash64("path").alias("file_id"), "kind", "symbol", F.col("qualified").alias("qualified_symbol"), "signature",
                *(F.col(c).cast("int").alias(c) for c in ("start_byte", "end_byte", "start_line", "end_line")), F.col("body").alias("source_body"),
            )
            # Only what changed is written: new rows, and the keys of files and chunks that go.
            left = plan.where("status IN ('changed', 'deleted')").select(F.xxhash64("path").alias("file_id")).cache()
            lost = self.store.read("chunks", at).join(left, "file_id", "left_semi").select(F.col("id").alias("chunk_id"))
            rows = self._tokens(new)
            tables = {
                "files": Delta(files.join(plan.where("status IN ('added', 'changed')").select("path"), "path", "left_semi"), left.select(F.col("file_id").alias("id")), "id"),
                "chunks": Delta(new, left, "file_id"),
                # Ordered by term, so that a query reads the row groups of its terms only.
                "postings": Delta(lexical.postings(rows).repartitionByRange("term").sortWithinPartitions("term"), lost, "chunk_id"),
                "row_lengths": Delta(lexical.row_lengths(rows), lost, "chunk_id"),
                "segments": Delta(self._segments(scanned), lost, "chunk_id"),
            }
            digest = store.manifest_tree(live.select("path", "sha")).first()["manifest"]
            state = self.store.publish(at["generation"], tables, digest)
            scanned.unpersist()
            left.unpersist()
            return Plan(**n, applied=True, generation=state["generation"])
        finally:
            plan.unpersist()
            live.unpersist()

    @staticmethod
    def _tokens(chunks: DataFrame) -> DataFrame:
        named = X.normalize_identifier(F.concat_ws(" ", "symbol", "qualified_symbol"))
        return chunks.select(F.col("id").alias("chunk_id"), X.index_tokens(F.concat_ws(" ", "symbol", "qualified_symbol", named)).alias("symbol_tokens"), X.index_tokens(F.concat_ws(" ", "signature", "source_body")).alias("body_tokens"))

    @staticmethod
    def _text(path: Column, qualified: Column, body: Column, header: Column, start: Column, stop: Column) -> Column:
        """The canonical text of a segment: labels, the chunk's header and the segment's own bytes."""
        head = F.when(header > 0, X.byte_slice(body, F.lit(0), header.cast("int"))).otherwise(F.lit(""))
        return chunking.canonical_text(path=path, symbol=qualified, body=F.concat(head, X.byte_slice(body, start.cast("int"), stop.cast("int"))))

    def _segments(self, scanned: DataFrame) -> DataFrame:
        """Segments of chunks with the hash of each one's canonical text, made once, at indexing."""
        cut = chunking.unit_segments(scanned, self.config.segment_target_bytes, "id")
        rows = cut.join(scanned.select("id", "path", "qualified", "body"), "id")
        text = self._text(F.col("path"), F.col("qualified"), F.col("body"), F.col("header"), F.col("start"), F.col("stop"))
        return rows.select(F.col("id").alias("chunk_id"), F.col("number").cast("int").alias("number"), "header", "start", "stop", F.sha2(F.encode(text, "UTF-8"), 256).alias("hash"))

    def _texts(self, at: dict, hashes: DataFrame) -> DataFrame:
        """(hash, text) of those segments only."""
        files = self.store.read("files", at).select(F.col("id").alias("file_id"), "path")
        one = self.store.read("segments", at).join(hashes, "hash", "left_semi").groupBy("hash").agg(F.min(F.struct("chunk_id", "number", "header", "start", "stop")).alias("s")).select("hash", "s.*")
        rows = one.join(self.store.read("chunks", at).select(F.col("id").alias("chunk_id"), "file_id", "qualified_symbol", "source_body"), "chunk_id").join(files, "file_id")
        return rows.select("hash", self._text(F.col("path"), F.col("qualified_symbol"), F.col("source_body"), F.col("header"), F.col("start"), F.col("stop")).alias("text"))

    def _profile(self) -> str:
        return profiles(self.config)["storage"]

    def _source(self) -> str:
        return profiles(self.config)["source"]

    def _bank(self, at: dict) -> DataFrame:
        """Vectors of this source that are long enough for the configured dimensions."""
        return self.store.read("source_bank", at).where((F.col("source_profile") == self._source()) & (F.size("vector") >= self.config.dimensions))

    def embed_documents(self, retry_terminal: bool = False) -> dict:
        """Ask the provider for the segments that the bank lacks, keep its answers, and serve what is there; the counts.

        Answers are written to the bank and the failure log before anything is made of
        them, so none is asked for twice, whatever is lost. A text that failed for good is
        not asked for again unless ``retry_terminal``.
        """
        if self.client is None:
            raise ValueError("no embedding client")
        at, client, c = self.store.active(), self.client, self.config
        keys = self.store.read("segments", at).select("hash").distinct()
        failures = self.store.read("embedding_failures", at).where(F.col("source_profile") == self._source())
        wanted = capture.plan(keys, self._bank(at), failures, retry_terminal).where("action = 'request'").select("hash")
        size = getattr(client, "dimensions", c.dimensions)
        asked = failed = 0
        if not wanted.isEmpty():
            answers = staged(embed(self._texts(at, wanted), lambda: client, size, c.request_inputs, c.request_bytes, c.retry_seconds), "answers")
            bank, bad = capture.kept(answers)
            source = F.lit(self._source()).alias("source_profile")
            before = self.store.read("embedding_failures", at).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            log = bad.select((F.lit(before) + F.row_number().over(Window.orderBy("hash"))).cast("long").alias("id"), source, "hash", "classification", "last_error")
            self.store.publish(at["generation"], {"source_bank": Delta(bank.select("hash", source, "vector", "sha256")), "embedding_failures": Delta(log)})
            counts = answers.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad")).first()
            asked, failed = counts["n"], counts["bad"]
        return {"requested": asked, "failed": failed, "generation": self.rematerialize(whole=False)}

    def rematerialize(self, whole: bool = True) -> int:
        """Make the serving vectors anew from the bank, without a provider, and publish them; the generation.

        With ``whole`` every segment must have a vector in the bank, else nothing is
        published. Rows of the new profile take the place of all others at once.
        """
        at, c = self.store.active(), self.config
        keys = self.store.read("segments", at).select("hash").distinct()
        bank = self._bank(at).groupBy("hash").agg(F.min_by("vector", "sha256").alias("vector"))
        rows = keys.join(bank, "hash", "left")
        if whole:
            n = rows.agg(F.count(F.lit(1)).alias("n"), F.count("vector").alias("have")).first()
            if n["have"] < n["n"]:
                raise ValueError(f"the bank has {n['have']} of {n['n']} texts")
        made = capture.materialize(rows.where("vector IS NOT NULL"), c.dimensions, c.vector_codec)
        state = self.store.publish(at["generation"], {"chunk_vectors": made}, profile=self._profile())
        return state["generation"]

    # --- search ----------------------------------------------------------------------

    def _relations(self, at: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
        files = self.store.read("files", at).select(F.col("id").alias("file_id"), "path", "language", F.col("indexed_sha256").alias("sha"))
        chunks = self.store.read("chunks", at).select(F.col("id").alias("chunk_id"), "file_id", "kind", "symbol", F.col("qualified_symbol").alias("qualified"), "signature", "start_byte", "end_byte", "start_line", "end_line", F.col("source_body").alias("body"))
        names = chunks.select("chunk_id", F.explode(F.array_distinct(F.array("symbol", "qualified"))).alias("original_name"))
        return files, chunks, names.withColumn("normalized_name", X.normalize_identifier(F.col("original_name")))

    def search(self, text: str, k: int | None = None, max_inline_bytes: int = 0, mode: str = "fts") -> dict:
        """Ranked chunks of a query, with bodies under a byte budget and the freshness of each file.

        A hybrid search whose gate is closed falls back to words alone and says why.
        """
        c = self.config
        k = c.return_k if k is None else k
        if not 1 <= k <= 20 or mode not in ("fts", "hybrid"):
            raise ValueError("k must be 1 to 20, mode fts or hybrid")
        q = plan_query(text, c.query_max_bytes, c.query_max_tokens, c.query_max_token_runes)
        at = self.store.active()
        files, chunks, symbols = self._relations(at)
        terms = self.spark.createDataFrame([(0, t) for t in q.terms], "qid long, term string")
        anchors = [(0, i + 1, a.raw, a.normalized, lane) for lane, found in (("symbol", q.symbols), ("path", q.paths)) for i, a in enumerate(found)]
        anchors = self.spark.createDataFrame(anchors, "qid long, ord int, raw string, normalized string, lane string")
        # At most ``query_max_tokens`` terms, which the scan of the postings gets as a filter.
        found = self.store.read("postings", at).where(F.col("term").isin(list(q.terms)))
        corpus = lexical.corpus_size(self.store.read("row_lengths", at))
        scored = lexical.bm25(found, corpus, terms, c.symbol_weight, c.body_weight)
        exact = symbols.where(F.col("normalized_name") == q.exact_symbol).join(chunks.select("chunk_id", "qualified"), "chunk_id").where("original_name = qualified").select(F.lit(0).cast("long").alias("qid"), "chunk_id")
        named = lexical.symbol_lane(anchors.where("lane = 'symbol'"), symbols, chunks, files, c.candidate_k).cache()
        paths = lexical.path_lane(anchors.where("lane = 'path'"), chunks, files, c.candidate_k).cache()
        try:
            lanes = [("text", lexical.text_lane(scored, chunks, files, exact, c.candidate_k)), ("symbol", named), ("path", paths)]
            ranked = fusion.fuse(lanes, "chunk_id", c.candidate_k, ["symbol", "path", "text"], k=c.rrf_k)
            why = None
            if mode == "hybrid":
                lane, why = self._vector_lane(text, at)
                if lane is not None:
                    ranked = fusion.fuse([("lexical", ranked), ("vector", lane)], "chunk_id", c.candidate_k, ["lexical", "vector"], k=c.rrf_k)
            top = ranked.where(F.col("rank") <= k)
            hits = top.join(chunks, "chunk_id").join(files, "file_id").withColumn("bytes", F.octet_length("body").cast("long"))
            budget = min(max_inline_bytes, c.inline_cap_bytes)
            packed = packing.pack_bodies(hits.select("qid", F.col("rank"), F.col("chunk_id").alias("id"), F.col("bytes").alias("parent_bytes"), F.lit(None).cast("long").alias("segment_bytes")), budget)
            packed = packed.select(F.col("id").alias("chunk_id"), "outcome", "used_bytes")
            out = hits.join(packed, "chunk_id").withColumn("inline", F.when(F.col("outcome") == "parent", F.col("body"))).orderBy("rank")
            result = [r.asDict() for r in out.drop("body").collect()]
            shape = effective_shape(q, named.count(), paths.count())
        finally:
            named.unpersist()
            paths.unpersist()
        for r in result:
            r["freshness"] = self._freshness(r["path"], r["sha"])
        return {"shape": shape, "hits": result, "used_bytes": sum(r["used_bytes"] for r in result), "fallback": why, "generation": at["generation"]}

    def _valid(self) -> Column:
        size = self.config.dimensions
        coded = (F.size("codes") == size) & (F.col("scale") > 0) & (F.col("norm") > 0) & (F.col("norm") < float("inf"))
        plain = (F.size("unit") == size) & (F.col("norm") > 0) & (F.col("norm") < float("inf"))
        return F.coalesce((F.col("dimensions") == size) & (plain if self.config.vector_codec == "float32" else coded), F.lit(False))

    def _stored(self, at: dict) -> DataFrame:
        """Each active text's hash with its serving vector, if there is one; no text is read."""
        hashes = self.store.read("segments", at).select("hash").distinct()
        return hashes.join(self.store.read("chunk_vectors", at), "hash", "left")

    def _vector_lane(self, text: str, at: dict) -> tuple[DataFrame | None, str | None]:
        """(qid, chunk_id, score, rank) from the stored vectors and one request for the query's, or why there is none.

        A chunk has the score of its best segment; equal ones go by path, place, chunk and
        segment.
        """
        c = self.config
        stored, valid = self._stored(at), self._valid()
        flags = [F.lit(c.allow_paid_query_embedding), F.lit(at.get("profile") == self._profile()), F.lit(self.client is not None)]
        counts = store.vector_counts(stored, F.col("dimensions").isNotNull(), valid) if c.allow_paid_query_embedding else self.spark.createDataFrame([(0, 0, 0)], "n long, good long, bad long")
        reason = counts.select(store.gate_reason(*flags).alias("reason")).first()["reason"]
        if reason:
            return None, reason
        try:
            vector = call(self.client, [text], getattr(self.client, "dimensions", c.dimensions), c.retry_seconds)[0]
        except (Retryable, ValueError, OSError):
            return None, store.EMBEDDING_FAILED
        if self.store.active().get("profile") != at.get("profile"):
            return None, store.PROFILE_CHANGED
        query = self.spark.createDataFrame([(vector,)], "vector array<float>").withColumn("qu", V.reduce_and_normalize(F.col("vector"), c.dimensions))
        query = query.withColumn("qs", V.scale_of(F.col("qu"))).withColumn("qc", V.codes_of(F.col("qu"), F.col("qs"))).withColumn("qn", V.code_norm(F.col("qc"), F.col("qs")))
        both = stored.where(valid).join(F.broadcast(query.select("qu", "qs", "qc", "qn")))  # one row
        coded = V.code_cosine(V.code_dot(F.col("qc"), F.col("codes")), F.col("qs"), F.col("qn"), F.col("scale"), F.col("norm"))
        plain = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(F.col("qu"), F.col("unit"))))
        scored = both.select("hash", (plain if c.vector_codec == "float32" else coded).alias("score"))
        segments = self.store.read("segments", at).select("chunk_id", "number", "hash").join(scored, "hash")
        best = segments.groupBy("chunk_id").agg(F.min(F.struct((-F.col("score")).alias("worse"), "number")).alias("b")).select("chunk_id", (-F.col("b.worse")).alias("score"), "b.number")
        chunks = self.store.read("chunks", at).select(F.col("id").alias("chunk_id"), "file_id", "start_byte")
        files = self.store.read("files", at).select(F.col("id").alias("file_id"), "path")
        order = [F.desc("score"), F.asc("path"), F.asc("start_byte"), F.asc("chunk_id"), F.asc("number")]
        lane = best.join(chunks, "chunk_id").join(files, "file_id").select(F.lit(0).cast("long").alias("qid"), "chunk_id", "score", "path", "start_byte", "number")
        # The top of one query: cut in every task first, then numbered.
        lane = lane.orderBy(*order).limit(c.candidate_k).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
        return lane.select("qid", "chunk_id", "score", "rank"), None

    def _freshness(self, path: str, sha: str) -> str:
        try:
            return "current" if worktree.sha256_of(worktree.read_bounded(self.root, path, self.config.source_cap_bytes)) == sha else "stale"
        except (FileNotFoundError, ValueError):
            return "deleted"

    def evaluation_session(self) -> dict:
        """A generation to evaluate against: pinned, and refused unless every chunk has a valid vector of this profile."""
        at = self.store.active()
        if at.get("profile") != self._profile():
            raise ValueError(store.RECONCILIATION_REQUIRED)
        n = store.vector_counts(self._stored(at), F.col("dimensions").isNotNull(), self._valid()).first()
        if not n["n"] or n["good"] < n["n"]:
            raise ValueError(f"{n['good']} of {n['n']} texts have a valid vector")
        return at

    # --- spans and status ---------------------------------------------------------------

    def read_span(self, path: str, start_line: int, end_line: int, expected_sha256: str | None = None) -> dict:
        """Lines start to end, inclusive, of a file inside the root, with its hash."""
        if start_line < 1 or end_line < start_line:
            raise ValueError("lines count from 1, the end is not before the start")
        data = worktree.read_bounded(self.root, path, self.config.source_cap_bytes)
        digest = worktree.sha256_of(data)
        if expected_sha256 and expected_sha256 != digest:
            raise ValueError("the file has changed")
        lines = data.decode("utf-8").splitlines(keepends=True)
        if start_line > len(lines):
            raise ValueError("past the end of the file")
        return {"path": path, "sha256": digest, "start_line": start_line, "end_line": min(end_line, len(lines)), "text": "".join(lines[start_line - 1 : end_line])}

    def status(self) -> dict:
        """Counts of files and chunks, and how the index stands to the worktree."""
        at = self.store.active()
        old = self.store.read("files", at).select("path", F.col("indexed_sha256").alias("sha"))
        counts = {r["status"]: r["n"] for r in store.change_plan(self._live(), old).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {
            "generation": at["generation"],
            "manifest": at["manifest"],
            "files": old.count(),
            "chunks": self.store.read("chunks", at).count(),
            "current": counts.get("reused", 0),
            "stale": counts.get("changed", 0),
            "unindexed": counts.get("added", 0),
            "deleted": counts.get("deleted", 0),
        }
