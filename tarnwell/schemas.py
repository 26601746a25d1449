"""Table schemas. Readers always get one of these; none is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # DDL keeps the tables readable


DDL = {
    "meta": "id int, schema_version int, active_generation long, manifest_sha256 string, index_profile string, canonical_profile string, source_profile string, vector_space_profile string, vector_storage_profile string, serving_profile string, observed_git_commit string, observed_git_dirty boolean",
    "files": "id long, path string, language string, indexed_sha256 string, observed_mtime_ns long, observed_size long",
    "chunks": "id long, file_id long, kind string, symbol string, qualified_symbol string, signature string, start_byte int, end_byte int, start_line int, end_line int, source_body string",
    "chunk_projections": "chunk_id long, projection_kind string, ordinal int, start_byte int, end_byte int",
    "symbols": "chunk_id long, original_name string, normalized_name string",
    "postings": "chunk_id long, term string, length long, tf_symbols long, tf_body long",
    "row_lengths": "chunk_id long, length long",
    "chunk_vectors": "hash string, dimensions int, codes array<int>, scale float, norm float, unit array<float>",
    "segments": "chunk_id long, number int, header long, start long, stop long, hash string",
    "segment_projections": "segment_id long, ordinal int, start_byte int, end_byte int",
    "vector_cache": "canonical_input_sha256 string, dimensions int, codec_id string, codec_version int, codes array<tinyint>, scale float, norm float, source_profile string, materialized_at string, serving_profile string",
    "source_bank": "hash string, source_profile string, vector array<float>, sha256 string",
    "embedding_failures": "id long, source_profile string, hash string, classification string, last_error string",
    "embedding_runs": "id long, status string, requested long, succeeded long, failed long, discarded long, actual_cost_usd double, started_at string, finished_at string",
    "index_run_files": "run_id long, path string, action string, outcome string",
    "occurrences": "id string, source string, target string, kind string, zone string, role string, flow string, execution string, control string, outcome string, ordinal int, start_byte int, end_byte int, context array<string>",
    "case": "id string, text string, language string, cohorts array<string>, answer_mode string, required_groups array<struct<id:string,alternatives:array<struct<spans:array<struct<path:string,content_sha256:string,qualified_symbol:string,start_byte:int,end_byte:int>>>>>>, hard_negatives array<struct<span:struct<path:string,content_sha256:string,qualified_symbol:string,start_byte:int,end_byte:int>,reason:string>>, judgments array<struct<span:struct<path:string,content_sha256:string,qualified_symbol:string,start_byte:int,end_byte:int>,grade:int,rationale:string>>",
}


def schema(name: str) -> T.StructType:
    return _s(DDL[name])
