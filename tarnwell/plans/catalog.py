"""Plans in portable SQL, by inventory id. Catalyst plans the text over the relations' DataFrames."""

from __future__ import annotations

PORTABLE: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    PORTABLE[name] = sql


# --- scans and sinks -----------------------------------------------------------------

add("S05_truth_inventory", "SELECT c.chunk_id, f.path, f.sha, c.qualified, c.start_byte, c.end_byte FROM {chunks} c JOIN {files} f ON f.file_id = c.file_id")
add("S06_parent_inventory", "SELECT c.chunk_id, f.path, f.language, c.symbol, c.qualified, c.end_byte - c.start_byte AS bytes, c.body FROM {chunks} c JOIN {files} f ON f.file_id = c.file_id")
add("S08_active_vectors", "SELECT v.vec_id, v.parent, c.scale, c.norm, c.vec_id IS NOT NULL AND c.scale > 0 AS valid FROM (SELECT DISTINCT vec_id, parent FROM {vectors}) v LEFT JOIN (SELECT * FROM {cache} WHERE profile = 1) c ON c.vec_id = v.vec_id")
add(
    "S09_vector_preflight",
    """SELECT count(*) AS n_keys, count_if(present AND valid) AS n_valid, coalesce(bool_or(present AND NOT valid), FALSE) AS any_invalid FROM (
    SELECT v.vec_id, c.vec_id IS NOT NULL AS present, coalesce(c.scale > 0 AND c.norm > 0, FALSE) AS valid FROM {vectors} v LEFT JOIN {cache} c ON c.vec_id = v.vec_id)""",
)
add("S10_planning_keys", "SELECT sha, count(*) AS uses, min(file_id) AS first_file, CAST(sum(size) AS BIGINT) AS bytes FROM {files} GROUP BY sha")
add("S11_existing_keys", "SELECT v.vec_id, v.parent FROM {vectors} v WHERE EXISTS (SELECT 1 FROM {cache} c WHERE c.vec_id = v.vec_id)")
add(
    "S16_verify_indexed",
    """SELECT 'missing' AS problem, f.path FROM {files} f WHERE NOT EXISTS (SELECT 1 FROM {live} l WHERE l.path = f.path)
    UNION ALL SELECT 'differs', f.path FROM {files} f JOIN {live} l ON l.path = f.path WHERE l.sha <> f.sha""",
)
add(
    "S17_publish_generation",
    """SELECT file_id, path, sha, 2 AS generation, 'kept' AS action FROM {files} f WHERE EXISTS (SELECT 1 FROM {live} l WHERE l.path = f.path AND l.sha = f.sha)
    UNION ALL SELECT l.file_id, l.path, l.sha, 2, CASE WHEN f.path IS NULL THEN 'added' ELSE 'updated' END FROM {live} l LEFT JOIN {files} f ON f.path = l.path WHERE f.path IS NULL OR f.sha <> l.sha""",
)
add("S18_postings_after_delete", "SELECT p.chunk_id, p.term, p.tf_body FROM {postings} p JOIN {files} f ON f.file_id = p.chunk_id WHERE EXISTS (SELECT 1 FROM {live} l WHERE l.path = f.path AND l.sha = f.sha)")
add(
    "S19_replacement_coverage",
    """SELECT coalesce(e.vec_id, c.vec_id) AS vec_id, CASE WHEN c.vec_id IS NULL THEN 'missing' ELSE 'extra' END AS problem
    FROM (SELECT vec_id FROM {vectors}) e FULL JOIN (SELECT vec_id FROM {cache}) c ON c.vec_id = e.vec_id WHERE e.vec_id IS NULL OR c.vec_id IS NULL""",
)
add("S20_upsert_latest", "SELECT key, id, status, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id DESC) AS k FROM {log}) WHERE k = 1")
add(
    "S21_insert_or_ignore",
    """SELECT v.vec_id, v.scale, CASE WHEN c.vec_id IS NULL THEN 'inserted' WHEN c.scale = v.scale THEN 'ignored' ELSE 'conflict' END AS outcome FROM {vectors} v LEFT JOIN {cache} c ON c.vec_id = v.vec_id""",
)
add("S22_append_log_state", "SELECT key, max(id) AS last_id, count(*) AS attempts, count_if(terminal) AS failures, max_by(status, id) AS state FROM {log} GROUP BY key")
add(
    "S23_run_state_machine",
    """SELECT state, count(*) AS n FROM (SELECT key, max_by(CASE status WHEN 'signup' THEN 'building' WHEN 'view' THEN 'building' WHEN 'click' THEN 'ready' WHEN 'purchase' THEN 'published' ELSE 'failed' END, id) AS state FROM {log} GROUP BY key) GROUP BY state""",
)
add("S24_collect_inactive", "SELECT profile, count(*) AS rows_dropped, CAST(sum(LISTLEN(codes)) AS BIGINT) AS bytes_dropped FROM {cache} WHERE profile <> 1 GROUP BY profile")
add("S27_migrate_rows", "SELECT vec_id, scale, norm, profile, '' AS lineage, CASE WHEN scale > 0 THEN 'ready' ELSE 'terminal' END AS state, 5 AS schema_version FROM {cache} WHERE norm > 0")
add("S28_rekey_reusable", "SELECT v.vec_id, c.profile AS old_profile, 9 AS new_profile FROM {vectors} v JOIN {cache} c ON c.vec_id = v.vec_id AND c.scale = v.scale AND c.norm = v.norm WHERE c.profile <> 1 AND c.scale > 0")

# --- predicates -------------------------------------------------------------------------

add(
    "P05_effective_shape",
    """SELECT qid, CASE WHEN n_high > 0 AND n_text > 0 AND n_all > 1 THEN 'mixed' WHEN n_high > 0 THEN 'anchor' WHEN n_lane = 0 THEN 'descriptive' WHEN n_text > 0 OR n_terms > 1 THEN 'mixed' ELSE 'anchor' END AS shape, n_high, n_lane FROM (
    SELECT f.qid, f.n_high, f.n_text, f.n_all, t.n_terms, coalesce(l.n_lane, 0) AS n_lane FROM (
      SELECT qid, count_if(confidence = 'high') AS n_high, count_if(confidence = 'text') AS n_text, count(*) AS n_all FROM {fragments} GROUP BY qid) f
    JOIN (SELECT qid, count(*) AS n_terms FROM {query_terms} GROUP BY qid) t ON t.qid = f.qid
    LEFT JOIN (SELECT qid, count(*) AS n_lane FROM {symbol_lane} GROUP BY qid) l ON l.qid = f.qid)""",
)
add("P07_like_escape", "SELECT path FROM {files} WHERE path LIKE 'src1!_%' ESCAPE '!' OR path LIKE '%/en/1%' ESCAPE '!' OR lower(path) LIKE '%/de/%9.txt'")
add("P10_profiles_match", "SELECT profile, count(*) AS n, profile = 1 AS active FROM {cache} GROUP BY profile")
add(
    "P11_vector_validity",
    """SELECT vec_id, scale > 0 AND norm > 0 AND LISTLEN(codes) = 32 AND abs(norm - n) <= 0.000001 AS valid FROM (
    SELECT vec_id, codes, scale, norm, CAST(sqrt(CAST(squares AS DOUBLE)) * CAST(scale AS DOUBLE) AS FLOAT) AS n FROM (
    SELECT c.*, u.squares FROM {cache} c JOIN (SELECT vec_id, CAST(round(CAST(norm AS DOUBLE) * CAST(norm AS DOUBLE) / (CAST(scale AS DOUBLE) * CAST(scale AS DOUBLE))) AS BIGINT) AS squares FROM {vectors}) u ON u.vec_id = c.vec_id))""",
)
add(
    "P12_row_violations",
    """SELECT 'chunk range' AS violation, count(*) AS n FROM {chunks} WHERE end_byte < start_byte OR start_byte < 0
    UNION ALL SELECT 'empty body', count(*) FROM {chunks} WHERE end_byte = start_byte
    UNION ALL SELECT 'duplicate path', count(*) FROM (SELECT path FROM {files} GROUP BY path HAVING count(*) > 1)
    UNION ALL SELECT 'occurrence ordinal', count(*) FROM {occurrences} WHERE ordinal < 1
    UNION ALL SELECT 'duplicate occurrence', count(*) FROM (SELECT occ_id FROM {occurrences} GROUP BY occ_id HAVING count(*) > 1)""",
)
add(
    "P13_embedding_state",
    """SELECT v.vec_id, CASE WHEN c.vec_id IS NOT NULL AND c.scale > 0 THEN 'ready' WHEN f.terminal THEN 'failed' ELSE 'pending' END AS state FROM {vectors} v
    LEFT JOIN {cache} c ON c.vec_id = v.vec_id LEFT JOIN (SELECT key, max_by(terminal, id) AS terminal FROM {log} GROUP BY key) f ON f.key = v.vec_id""",
)
add(
    "P22_freshness",
    """SELECT f.path, CASE WHEN l.path IS NULL THEN 'deleted' WHEN l.sha = f.sha THEN 'current' ELSE 'stale' END AS freshness FROM (SELECT DISTINCT path FROM {lexical_fused} r JOIN {files} x ON x.file_id = r.chunk_id) h JOIN {files} f ON f.path = h.path LEFT JOIN {live} l ON l.path = f.path""",
)

# --- joins ---------------------------------------------------------------------------------

add("J01_matches_chunks_files", "SELECT s.qid, s.chunk_id, c.chunk_id IS NULL OR f.file_id IS NULL AS orphaned, f.path FROM {text_scores} s LEFT JOIN {chunks} c ON c.chunk_id = s.chunk_id LEFT JOIN {live} f ON f.file_id = c.file_id")
add("J04_segments_chunks_files", "SELECT v.vec_id, v.parent, c.qualified, f.path FROM {vectors} v JOIN {chunks} c ON c.chunk_id = v.parent JOIN {files} f ON f.file_id = c.file_id")
add("J05_keys_to_cache", "SELECT v.vec_id, c.scale IS NOT NULL AS stored, c.profile FROM (SELECT DISTINCT vec_id FROM {vectors}) v LEFT JOIN {cache} c ON c.vec_id = v.vec_id AND c.profile = 1")
add(
    "J06_keys_cache_failures",
    """SELECT v.vec_id, c.scale, f.status AS last_status, f.id AS last_id FROM {vectors} v LEFT JOIN {cache} c ON c.vec_id = v.vec_id
    LEFT JOIN (SELECT key, max(id) AS id, max_by(status, id) AS status FROM {log} WHERE terminal GROUP BY key) f ON f.key = v.vec_id""",
)
add("J07_latest_failure", "SELECT key, max_by(value, id) AS value, max_by(status, id) AS status FROM {log} WHERE terminal GROUP BY key")
add("J08_exact_symbol_flag", "SELECT c.chunk_id, EXISTS (SELECT 1 FROM {symbols} s JOIN {anchors} a ON a.normalized = s.normalized_name WHERE s.chunk_id = c.chunk_id AND s.original_name = c.qualified AND a.lane = 'symbol') AS exact FROM {chunks} c")
add("J09_meta_singleton", "SELECT f.file_id, f.path, m.active_generation, m.manifest_rows FROM {files} f CROSS JOIN (SELECT 2 AS active_generation, count(*) AS manifest_rows FROM {files}) m")
add("J12_live_vs_indexed", "SELECT coalesce(l.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'deleted' WHEN l.sha = f.sha THEN 'reused' ELSE 'changed' END AS status FROM {live} l FULL JOIN {files} f ON f.path = l.path")
add("J13_key_presence", "SELECT v.vec_id, EXISTS (SELECT 1 FROM {cache} c WHERE c.vec_id = v.vec_id) AS in_bank, EXISTS (SELECT 1 FROM {log} g WHERE g.key = v.vec_id AND g.terminal) AS failed FROM {vectors} v")
add("J15_lexical_outer_join", "SELECT coalesce(t.qid, s.qid) AS qid, coalesce(t.chunk_id, s.chunk_id) AS chunk_id, t.rank AS text_rank, s.rank AS symbol_rank FROM {text_lane} t FULL JOIN {symbol_lane} s ON s.qid = t.qid AND s.chunk_id = t.chunk_id")
add("J16_lexical_vector_outer", "SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.parent, b.parent) AS parent, a.rank AS lexical_rank, b.rank AS vector_rank FROM {label_lane} a FULL JOIN {vector_lane} b ON b.qid = a.qid AND b.parent = a.parent")
add("J19_hit_to_node", "SELECT v.qid, e.source AS node, min(v.rank) AS rank FROM {vector_lane} v JOIN {edges} e ON e.source = v.parent GROUP BY v.qid, e.source")
add("J22_inversions", "SELECT a.qid, count(*) AS pairs, count_if(ea.rank > eb.rank) AS inversions, count_if(a.score = b.score) AS ties FROM {ranked} a JOIN {ranked} b ON b.qid = a.qid AND a.rank < b.rank JOIN {exact_ranked} ea ON ea.qid = a.qid AND ea.item = a.item JOIN {exact_ranked} eb ON eb.qid = b.qid AND eb.item = b.item GROUP BY a.qid")
add("J23_gold_unmapped", "SELECT j.qid, j.item FROM {judgments} j WHERE j.grade = 2 AND NOT EXISTS (SELECT 1 FROM {cache} c WHERE c.vec_id = j.item)")
add("J24_attachments_labels", "SELECT h.qid, h.item, h.rank, j.grade, j.hard, c.answerable FROM {ranked} h LEFT JOIN {judgments} j ON j.qid = h.qid AND j.item = h.item LEFT JOIN {cases} c ON c.qid = h.qid")
add("J25_hint_endpoints", "SELECT e.source, e.target, min(v.rank) AS first_rank FROM {edges} e JOIN {vector_lane} v ON v.parent = e.target GROUP BY e.source, e.target")
add("J26_neighbour_of_gold", "SELECT DISTINCT n.a AS node FROM (SELECT source AS a, target AS b FROM {edges} UNION ALL SELECT target, source FROM {edges}) n WHERE EXISTS (SELECT 1 FROM {vector_lane} v WHERE v.parent = n.b AND v.rank <= 2)")
add(
    "J28_status_full_join",
    """SELECT count_if(l.path IS NOT NULL AND f.path IS NOT NULL AND l.sha <> f.sha) AS stale, count_if(f.path IS NULL) AS unindexed, count_if(l.path IS NULL) AS deleted, count_if(l.sha = f.sha) AS current FROM {live} l FULL JOIN {files} f ON f.path = l.path""",
)

# --- aggregates -------------------------------------------------------------------------------

add("A02_matched_terms", "SELECT qid, chunk_id, matched_terms, selected_terms FROM {text_scores}")
add("A08_segment_coverage", "SELECT v.parent, count(*) AS segments, count_if(c.scale > 0) AS covered FROM {vectors} v LEFT JOIN {cache} c ON c.vec_id = v.vec_id GROUP BY v.parent")
add(
    "A09_status_counts",
    """SELECT count(*) AS n_keys, count_if(state = 0) AS ready, count_if(state = 1) AS failed, count_if(state = 2) AS pending FROM (SELECT v.vec_id, min(CASE WHEN c.scale > 0 THEN 0 WHEN g.terminal THEN 1 ELSE 2 END) AS state
    FROM {vectors} v LEFT JOIN {cache} c ON c.vec_id = v.vec_id LEFT JOIN {log} g ON g.key = v.vec_id GROUP BY v.vec_id)""",
)
add(
    "A11_embedding_plan",
    """SELECT count(*) AS distinct_keys, count_if(ready) AS ready, count_if(NOT ready AND terminal) AS skipped, count_if(NOT ready AND NOT terminal) AS payable, CAST(sum(CASE WHEN NOT ready AND NOT terminal THEN size ELSE 0 END) AS BIGINT) AS token_bound FROM (
    SELECT f.sha, max(f.size) AS size, bool_or(coalesce(c.scale > 0, FALSE)) AS ready, bool_or(f.file_id % 13 = 4) AS terminal FROM {files} f LEFT JOIN {cache} c ON c.vec_id = f.file_id GROUP BY f.sha)""",
)
add("A12_materialization_plan", "SELECT count(*) AS wanted, count_if(c.vec_id IS NOT NULL) AS bank_hits, count_if(c.vec_id IS NULL) AS missing, CAST(32 * count_if(c.vec_id IS NOT NULL) AS BIGINT) AS bytes FROM {vectors} v LEFT JOIN {cache} c ON c.vec_id = v.vec_id")
add(
    "A15_requirement_coverage",
    """SELECT qid, k, round(avg(covered), 6) AS coverage, min(covered) = 1 AS complete FROM (SELECT qid, k, group_id, max(whole) AS covered FROM (
    SELECT s.qid, k.k, s.group_id, s.alternative, min(CASE WHEN r.rank <= k.k THEN 1 ELSE 0 END) AS whole FROM {spans} s CROSS JOIN (SELECT k FROM (VALUES (1), (5), (10), (20)) AS t(k)) k
    LEFT JOIN {ranked} r ON r.qid = s.qid AND r.item = s.item GROUP BY s.qid, k.k, s.group_id, s.alternative) GROUP BY qid, k, group_id) GROUP BY qid, k""",
)
add("A16_hard_negative_hit", "SELECT j.qid, k.k, coalesce(bool_or(r.rank <= k.k), FALSE) AS hard_hit FROM {judgments} j CROSS JOIN (SELECT k FROM (VALUES (1), (5), (20)) AS t(k)) k LEFT JOIN {ranked} r ON r.qid = j.qid AND r.item = j.item WHERE j.hard GROUP BY j.qid, k.k")
add(
    "A22_interval_union",
    """SELECT source, CAST(sum(hi - lo) AS BIGINT) AS covered, count(*) AS islands FROM (SELECT source, island, min(lo) AS lo, max(hi) AS hi FROM (
    SELECT source, lo, hi, sum(CASE WHEN lo <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY lo, hi, occ_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
    SELECT source, occ_id, lo, hi, max(hi) OVER (PARTITION BY source ORDER BY lo, hi, occ_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
    SELECT source, occ_id, target * 10 AS lo, target * 10 + bytes AS hi FROM {occurrences}))) GROUP BY source, island) GROUP BY source""",
)
add(
    "A23_stage_trace",
    """SELECT qid, group_id, min(CASE WHEN present = 0 THEN stage END) AS first_loss FROM (
    SELECT s.qid, s.group_id, 1 AS stage, max(CASE WHEN e.rank IS NULL THEN 0 ELSE 1 END) AS present FROM {spans} s LEFT JOIN {exact_ranked} e ON e.qid = s.qid AND e.item = s.item GROUP BY s.qid, s.group_id
    UNION ALL SELECT s.qid, s.group_id, 2, max(CASE WHEN r.rank IS NULL THEN 0 ELSE 1 END) FROM {spans} s LEFT JOIN {ranked} r ON r.qid = s.qid AND r.item = s.item GROUP BY s.qid, s.group_id
    UNION ALL SELECT s.qid, s.group_id, 3, max(CASE WHEN r.rank <= 5 THEN 1 ELSE 0 END) FROM {spans} s LEFT JOIN {ranked} r ON r.qid = s.qid AND r.item = s.item GROUP BY s.qid, s.group_id) GROUP BY qid, group_id""",
)
add("A24_first_loss_counts", "SELECT coalesce(stage, 'none') AS first_loss, count(*) AS n FROM (SELECT s.qid, s.group_id, CASE WHEN max(CASE WHEN r.rank IS NULL THEN 0 ELSE 1 END) = 0 THEN 'candidate' WHEN max(CASE WHEN r.rank <= 5 THEN 1 ELSE 0 END) = 0 THEN 'return_limit' END AS stage FROM {spans} s LEFT JOIN {ranked} r ON r.qid = s.qid AND r.item = s.item GROUP BY s.qid, s.group_id) GROUP BY coalesce(stage, 'none')")
add("A26_outcome_counts", "SELECT outcome, count(*) AS n FROM {occurrences} GROUP BY outcome")
add("A28_role_slices", "SELECT target, count_if(role = 'PRODUCTION') AS production, count_if(role = 'TEST') AS test, count_if(role = 'BENCHMARK') AS benchmark, count_if(role = 'EXAMPLE') AS example FROM {occurrences} GROUP BY target")
add("A30_score_distribution", "SELECT qid, count(*) AS n, min(score) AS least, max(score) AS most, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS deviation, round(max(score) - min(score), 6) AS span FROM {scores} GROUP BY qid")
add("A33_one_hop_clusters", "SELECT target, tier, count(DISTINCT source) AS members, min(kind || '/' || tier) AS first_label, CAST(sum(n) AS BIGINT) AS n FROM {edges} GROUP BY target, tier")
add(
    "A34_packaging_completeness",
    """SELECT qid, min(present) = 1 AS complete, count_if(present = 0) AS missing_groups, min(best_missing) AS best_missing_rank FROM (
    SELECT s.qid, s.group_id, max(CASE WHEN r.rank <= 5 THEN 1 ELSE 0 END) AS present, min(CASE WHEN r.rank > 5 THEN r.rank END) AS best_missing FROM {spans} s LEFT JOIN {ranked} r ON r.qid = s.qid AND r.item = s.item GROUP BY s.qid, s.group_id) GROUP BY qid""",
)
add(
    "A35_packaging_totals",
    """SELECT b.most, count(*) AS queries, count_if(x.hits >= 1) AS complete, count_if(x.hits >= 1 AND y.hits = 0) AS wins, count_if(x.hits = 0 AND y.hits >= 1) AS losses FROM {budgets} b
    JOIN (SELECT c.qid, b.most, count_if(j.grade = 2 AND r.rank <= b.most) AS hits FROM {cases} c CROSS JOIN {budgets} b LEFT JOIN {ranked} r ON r.qid = c.qid LEFT JOIN {judgments} j ON j.qid = r.qid AND j.item = r.item GROUP BY c.qid, b.most) x ON x.most = b.most
    JOIN (SELECT c.qid, count_if(j.grade = 2 AND r.rank <= 1) AS hits FROM {cases} c LEFT JOIN {ranked} r ON r.qid = c.qid LEFT JOIN {judgments} j ON j.qid = r.qid AND j.item = r.item GROUP BY c.qid) y ON y.qid = x.qid GROUP BY b.most""",
)
add(
    "A37_budget_controls",
    """SELECT r.qid, b.most, b.bytes, count(*) AS candidates, count_if(r.rank <= b.most AND f.size <= b.bytes) AS emitted, count_if(r.rank > b.most OR f.size > b.bytes) AS omitted, CAST(sum(CASE WHEN r.rank <= b.most AND f.size <= b.bytes THEN f.size ELSE 0 END) AS BIGINT) AS emitted_bytes
    FROM {lexical_fused} r JOIN {files} f ON f.file_id = r.chunk_id CROSS JOIN {budgets} b GROUP BY r.qid, b.most, b.bytes""",
)
add(
    "A38_cell_outcomes",
    """SELECT r.qid, b.most, count_if(coalesce(j.grade, 0) = 2) AS direct, count_if(coalesce(j.grade, 0) = 1) AS support, count_if(coalesce(j.grade, 0) = 0) AS noise, count_if(coalesce(j.hard, FALSE)) AS hard_negative, count(DISTINCT s.group_id) AS groups
    FROM {ranked} r CROSS JOIN {budgets} b LEFT JOIN {judgments} j ON j.qid = r.qid AND j.item = r.item LEFT JOIN {spans} s ON s.qid = r.qid AND s.item = r.item WHERE r.rank <= b.most GROUP BY r.qid, b.most""",
)
_SCOPES = "SELECT c.qid, 'global' AS scope FROM {cases} c UNION ALL SELECT c.qid, 'language:' || c.language FROM {cases} c UNION ALL SELECT h.qid, 'cohort:' || h.cohort FROM {cohorts} h"
add("A41_rollup_check", f"SELECT (SELECT count(*) FROM {{ranked}}) AS by_rows, (SELECT count(*) FROM ({_SCOPES}) s JOIN {{ranked}} r ON r.qid = s.qid WHERE s.scope = 'global') AS by_scope")

# --- windows ------------------------------------------------------------------------------------

add("W04_running_bytes", "SELECT t.qid, t.chunk_id, t.total, count_if(t.total <= b.bytes) AS budgets_met FROM (SELECT r.qid, r.chunk_id, CAST(sum(f.size) OVER (PARTITION BY r.qid ORDER BY r.rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM {lexical_fused} r JOIN {files} f ON f.file_id = r.chunk_id) t CROSS JOIN {budgets} b GROUP BY t.qid, t.chunk_id, t.total")
add("W06_source_ordinals", "SELECT occ_id, source, row_number() OVER (PARTITION BY source ORDER BY ordinal, bytes, occ_id) AS source_ordinal FROM {occurrences}")
add("W12_tail_after_head", "SELECT * FROM (SELECT qid, parent, row_number() OVER (PARTITION BY qid ORDER BY part, rank, parent) AS rank FROM (SELECT qid, parent, 0 AS part, rank FROM {hybrid_fused} WHERE rank <= 5 UNION ALL SELECT v.qid, v.parent, 1, v.rank FROM {vector_lane} v WHERE NOT EXISTS (SELECT 1 FROM {hybrid_fused} h WHERE h.qid = v.qid AND h.parent = v.parent AND h.rank <= 5))) WHERE rank <= 20")
add("W13_seed_ranges", "SELECT qid, count_if(rank <= 5) AS primary_seeds, count_if(rank <= 20) AS all_seeds, max(CASE WHEN rank <= 5 THEN score END) AS best FROM {vector_lane} GROUP BY qid")

# --- sorts and limits ------------------------------------------------------------------------------

add("T12_prefix_rerank", "SELECT source, target, best_id, row_number() OVER (PARTITION BY source ORDER BY n DESC, best_id) AS rank FROM (SELECT *, rank() OVER (PARTITION BY source ORDER BY CASE tier WHEN 'DECLARATION_CONTRACT' THEN 0 WHEN 'EXECUTABLE_DEPENDENCY' THEN 1 WHEN 'BODY_REFERENCE' THEN 2 ELSE 3 END) AS prefix FROM {edges}) WHERE prefix = 1")
add("T15_bundle_selection", "SELECT v.qid, e.source, e.target, e.kind FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, best_id) AS k FROM {edges}) e JOIN {vector_lane} v ON v.parent = e.source WHERE e.k = 1 AND v.rank <= 2")
add("T16_seed_union", "SELECT qid, parent, min(place) AS place FROM (SELECT qid, parent, rank AS place FROM {vector_lane} WHERE rank <= 5 UNION ALL SELECT qid, parent, 5 + rank FROM {label_lane} WHERE rank <= 5) GROUP BY qid, parent")
add("T18_return_limit", "SELECT qid, parent, rank FROM {hybrid_fused} WHERE rank <= 5")

# --- set operations ------------------------------------------------------------------------------------

add("U01_lane_union", "SELECT qid, chunk_id FROM {text_lane} UNION SELECT qid, chunk_id FROM {symbol_lane} UNION SELECT qid, chunk_id FROM {path_lane}")
add("U04_difference", "SELECT path, 'deleted' AS side FROM (SELECT path FROM {files} EXCEPT SELECT path FROM {live}) UNION ALL SELECT path, 'added' FROM (SELECT path FROM {live} EXCEPT SELECT path FROM {files})")
add("U05_future_keys", "SELECT sha FROM {live} UNION SELECT sha FROM {files} WHERE file_id % 10 = 7")
add("U06_group_sets", "SELECT a.qid, count(DISTINCT a.group_id) AS required, count(DISTINCT CASE WHEN r.rank <= 10 THEN a.group_id END) AS reached, count(DISTINCT CASE WHEN r.rank <= 10 THEN a.group_id END) - count(DISTINCT CASE WHEN r.rank <= 3 THEN a.group_id END) AS gained FROM {spans} a LEFT JOIN {ranked} r ON r.qid = a.qid AND r.item = a.item GROUP BY a.qid")
add("U07_disjoint_gates", "SELECT count(*) AS overlapping FROM (SELECT qid, item FROM {judgments} WHERE grade = 2 INTERSECT SELECT qid, item FROM {judgments} WHERE hard)")
add("U08_plan_equality", "SELECT (SELECT count(*) FROM (SELECT path, sha FROM {files} EXCEPT SELECT path, sha FROM {live})) AS only_left, (SELECT count(*) FROM (SELECT path, sha FROM {live} EXCEPT SELECT path, sha FROM {files})) AS only_right")
add("U10_presence_or", "SELECT s.qid, s.group_id, bool_or(a.rank IS NOT NULL OR b.rank IS NOT NULL) AS present FROM {spans} s LEFT JOIN {ranked} a ON a.qid = s.qid AND a.item = s.item AND a.rank <= 5 LEFT JOIN {exact_ranked} b ON b.qid = s.qid AND b.item = s.item AND b.rank <= 5 GROUP BY s.qid, s.group_id")

# --- drivers and guards -------------------------------------------------------------------------------

add("R04_lane_sources", "SELECT qid, parent, CASE WHEN lexical_rank IS NOT NULL AND vector_rank IS NOT NULL THEN 'both' WHEN vector_rank IS NOT NULL THEN 'vector' ELSE 'fts' END AS score_source, rank FROM {hybrid_fused}")
add("R11_key_states", "SELECT v.parent, count_if(c.scale > 0) AS ready, count_if(c.vec_id IS NULL) AS pending, count_if(c.scale = 0) AS invalid FROM {vectors} v LEFT JOIN {cache} c ON c.vec_id = v.vec_id GROUP BY v.parent")
add("R12_terminal_history", "SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id) AS attempt FROM {log} WHERE terminal")
add("R14_migration", "SELECT vec_id, scale, norm, '' AS source_profile, profile AS serving_profile FROM {cache} WHERE scale > 0 AND norm > 0")
add("R18_related_body", "SELECT e.source, f.file_id, CASE WHEN f.size <= 1024 THEN 'whole' ELSE 'too_large' END AS outcome, CASE WHEN f.size <= 1024 THEN f.size END AS bytes FROM (SELECT DISTINCT source, target FROM {edges}) e JOIN {files} f ON f.file_id = e.target")
add("R19_node_traits", "SELECT p.p_partkey AS node, p.p_brand AS package, count(o.occ_id) AS n FROM {part} p LEFT JOIN {occurrences} o ON o.source = p.p_partkey AND o.zone = 'SIGNATURE' GROUP BY p.p_partkey, p.p_brand")
add("R27_source_reproof", "SELECT f.path, l.sha IS NOT DISTINCT FROM f.sha AS proven FROM {files} f LEFT JOIN {live} l ON l.path = f.path")
add("R33_usage_by_operation", "SELECT status, terminal, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM {log} GROUP BY status, terminal")
