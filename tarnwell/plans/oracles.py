"""SQL by which plans of portable SQL are checked, written from the operator's definition and not from the plan."""

from __future__ import annotations

OTHER: dict[str, str] = {
    # --- scans and sinks
    "S05_truth_inventory": "SELECT chunk_id, (SELECT path FROM {files} f WHERE f.file_id = c.file_id) AS path, (SELECT sha FROM {files} f WHERE f.file_id = c.file_id) AS sha, qualified, start_byte, end_byte FROM {chunks} c",
    "S08_active_vectors": """SELECT vec_id, parent, c.scale, c.norm, coalesce(c.scale, 0) > 0 AND c.vec_id IS NOT NULL AS valid FROM {vectors} v LEFT JOIN {cache} c USING (vec_id) WHERE c.profile = 1
    UNION ALL SELECT vec_id, parent, NULL, NULL, CASE WHEN FALSE THEN TRUE ELSE FALSE END FROM {vectors} WHERE vec_id NOT IN (SELECT vec_id FROM {cache} WHERE profile = 1)""",
    "S09_vector_preflight": """SELECT (SELECT count(*) FROM {vectors}) AS n_keys, (SELECT count(*) FROM {cache} WHERE scale > 0 AND norm > 0 AND vec_id IN (SELECT vec_id FROM {vectors})) AS n_valid,
    EXISTS (SELECT 1 FROM {cache} WHERE NOT (scale > 0 AND norm > 0)) AS any_invalid""",
    "S11_existing_keys": "SELECT vec_id, parent FROM {vectors} WHERE vec_id IN (SELECT vec_id FROM {cache} INTERSECT SELECT vec_id FROM {vectors})",
    "S16_verify_indexed": """SELECT 'missing' AS problem, path FROM (SELECT path FROM {files} EXCEPT SELECT path FROM {live})
    UNION ALL SELECT 'differs', path FROM (SELECT path, sha FROM {files} WHERE path IN (SELECT path FROM {live}) EXCEPT SELECT path, sha FROM {live})""",
    "S17_publish_generation": """SELECT coalesce(l.file_id, f.file_id) AS file_id, coalesce(l.path, f.path) AS path, coalesce(l.sha, f.sha) AS sha, 2 AS generation,
    CASE WHEN f.path IS NULL THEN 'added' WHEN f.sha = l.sha THEN 'kept' ELSE 'updated' END AS action FROM {live} l FULL JOIN {files} f ON f.path = l.path WHERE l.path IS NOT NULL""",
    "S18_postings_after_delete": """SELECT chunk_id, term, tf_body FROM {postings} WHERE chunk_id NOT IN (
    SELECT file_id FROM {files} WHERE (path, sha) NOT IN (SELECT (path, sha) FROM {live}))""",
    "S19_replacement_coverage": """SELECT vec_id, 'missing' AS problem FROM (SELECT vec_id FROM {vectors} EXCEPT SELECT vec_id FROM {cache}) UNION ALL SELECT vec_id, 'extra' FROM (SELECT vec_id FROM {cache} EXCEPT SELECT vec_id FROM {vectors})""",
    "S20_upsert_latest": "SELECT key, id, status, value FROM {log} l WHERE id = (SELECT max(id) FROM {log} m WHERE m.key = l.key)",
    "S21_insert_or_ignore": """SELECT vec_id, scale, 'inserted' AS outcome FROM {vectors} WHERE vec_id NOT IN (SELECT vec_id FROM {cache})
    UNION ALL SELECT vec_id, v.scale, CASE WHEN v.scale - c.scale = 0 THEN 'ignored' ELSE 'conflict' END FROM {vectors} v JOIN {cache} c USING (vec_id)""",
    "S22_append_log_state": "SELECT DISTINCT ON (key) key, id AS last_id, count(*) OVER (PARTITION BY key) AS attempts, CAST(sum(CASE WHEN terminal THEN 1 ELSE 0 END) OVER (PARTITION BY key) AS BIGINT) AS failures, status AS state FROM {log} ORDER BY key, id DESC",
    "S24_collect_inactive": "SELECT profile, count(*) AS rows_dropped, 32 * count(*) AS bytes_dropped FROM {cache} GROUP BY profile HAVING profile <> 1",
    # --- predicates
    "P07_like_escape": r"SELECT path FROM {files} WHERE starts_with(path, 'src1_') OR contains(path, '/en/1') OR (contains(lower(path), '/de/') AND regexp_matches(lower(path), '/de/.*9\.txt$'))",
    "P10_profiles_match": "SELECT profile, n, profile = 1 AS active FROM (SELECT vec_id % 3 AS profile, count(*) AS n FROM {vectors} WHERE vec_id % 7 <> 2 GROUP BY 1)",
    "P13_embedding_state": """SELECT vec_id, CASE WHEN vec_id IN (SELECT vec_id FROM {cache} WHERE scale > 0) THEN 'ready' WHEN (SELECT terminal FROM {log} g WHERE g.key = v.vec_id ORDER BY id DESC LIMIT 1) THEN 'failed' ELSE 'pending' END AS state FROM {vectors} v""",
    "P22_freshness": """SELECT path, CASE WHEN path NOT IN (SELECT path FROM {live}) THEN 'deleted' WHEN (path, sha) IN (SELECT (path, sha) FROM {live}) THEN 'current' ELSE 'stale' END AS freshness
    FROM {files} WHERE file_id IN (SELECT chunk_id FROM {lexical_fused})""",
    # --- joins
    "J05_keys_to_cache": "SELECT vec_id, vec_id IN (SELECT vec_id FROM {cache} WHERE profile = 1) AS stored, (SELECT profile FROM {cache} c WHERE c.vec_id = v.vec_id AND profile = 1) AS profile FROM {vectors} v",
    "J06_keys_cache_failures": """SELECT vec_id, (SELECT scale FROM {cache} c WHERE c.vec_id = v.vec_id) AS scale, (SELECT status FROM {log} g WHERE g.key = v.vec_id AND terminal ORDER BY id DESC LIMIT 1) AS last_status,
    (SELECT max(id) FROM {log} g WHERE g.key = v.vec_id AND terminal) AS last_id FROM {vectors} v""",
    "J07_latest_failure": "SELECT key, value, status FROM {log} l WHERE terminal AND NOT EXISTS (SELECT 1 FROM {log} m WHERE m.terminal AND m.key = l.key AND m.id > l.id)",
    "J08_exact_symbol_flag": "SELECT chunk_id, chunk_id IN (SELECT chunk_id FROM {exact_names}) AS exact FROM {chunks}",
    "J12_live_vs_indexed": """SELECT path, 'added' AS status FROM (SELECT path FROM {live} EXCEPT SELECT path FROM {files}) UNION ALL SELECT path, 'deleted' FROM (SELECT path FROM {files} EXCEPT SELECT path FROM {live})
    UNION ALL SELECT path, 'reused' FROM (SELECT path, sha FROM {live} INTERSECT SELECT path, sha FROM {files}) UNION ALL SELECT path, 'changed' FROM (SELECT path, sha FROM {live} WHERE path IN (SELECT path FROM {files}) EXCEPT SELECT path, sha FROM {files})""",
    "J13_key_presence": "SELECT vec_id, c.n IS NOT NULL AS in_bank, g.n IS NOT NULL AS failed FROM {vectors} v LEFT JOIN (SELECT vec_id, count(*) AS n FROM {cache} GROUP BY vec_id) c USING (vec_id) LEFT JOIN (SELECT key AS vec_id, count(*) AS n FROM {log} WHERE terminal GROUP BY key) g USING (vec_id)",
    "J22_inversions": """SELECT a.qid, count(*) AS pairs, CAST(sum(CASE WHEN (SELECT rank FROM {exact_ranked} e WHERE e.qid = a.qid AND e.item = a.item) > (SELECT rank FROM {exact_ranked} e WHERE e.qid = b.qid AND e.item = b.item) THEN 1 ELSE 0 END) AS BIGINT) AS inversions,
    CAST(sum(CASE WHEN a.score = b.score THEN 1 ELSE 0 END) AS BIGINT) AS ties FROM {ranked} a JOIN {ranked} b ON b.qid = a.qid AND b.rank > a.rank
    WHERE (a.qid, a.item) IN (SELECT (qid, item) FROM {exact_ranked}) AND (b.qid, b.item) IN (SELECT (qid, item) FROM {exact_ranked}) GROUP BY a.qid""",
    "J23_gold_unmapped": "SELECT qid, item FROM {judgments} WHERE grade = 2 AND item NOT IN (SELECT vec_id FROM {cache})",
    "J26_neighbour_of_gold": "SELECT source AS node FROM {edges} WHERE target IN (SELECT parent FROM {vector_lane} WHERE rank <= 2) UNION SELECT target FROM {edges} WHERE source IN (SELECT parent FROM {vector_lane} WHERE rank <= 2)",
    "J28_status_full_join": """SELECT (SELECT count(*) FROM {live} l JOIN {files} f ON f.path = l.path AND f.sha <> l.sha) AS stale, (SELECT count(*) FROM {live} WHERE path NOT IN (SELECT path FROM {files})) AS unindexed,
    (SELECT count(*) FROM {files} WHERE path NOT IN (SELECT path FROM {live})) AS deleted, (SELECT count(*) FROM {live} l JOIN {files} f ON f.path = l.path AND f.sha = l.sha) AS current""",
    # --- aggregates
    "A08_segment_coverage": "SELECT parent, count(*) AS segments, CAST(sum(CASE WHEN vec_id IN (SELECT vec_id FROM {cache} WHERE scale > 0) THEN 1 ELSE 0 END) AS BIGINT) AS covered FROM {vectors} GROUP BY parent",
    "A09_status_counts": """WITH ready AS (SELECT vec_id FROM {vectors} INTERSECT SELECT vec_id FROM {cache} WHERE scale > 0), failed AS (SELECT vec_id FROM {vectors} INTERSECT SELECT key FROM {log} WHERE terminal EXCEPT SELECT vec_id FROM ready)
    SELECT (SELECT count(*) FROM {vectors}) AS n_keys, (SELECT count(*) FROM ready) AS ready, (SELECT count(*) FROM failed) AS failed, (SELECT count(*) FROM {vectors}) - (SELECT count(*) FROM ready) - (SELECT count(*) FROM failed) AS pending""",
    "A12_materialization_plan": "SELECT wanted, bank_hits, wanted - bank_hits AS missing, 32 * bank_hits AS bytes FROM (SELECT (SELECT count(*) FROM {vectors}) AS wanted, (SELECT count(*) FROM {vectors} WHERE vec_id IN (SELECT vec_id FROM {cache})) AS bank_hits)",
    "A16_hard_negative_hit": "SELECT qid, k, (SELECT count(*) FROM {ranked} r JOIN {judgments} j ON j.qid = r.qid AND j.item = r.item AND j.hard WHERE r.qid = q.qid AND r.rank <= q.k) > 0 AS hard_hit FROM (SELECT DISTINCT qid, k FROM {judgments} CROSS JOIN (SELECT unnest([1, 5, 20]) AS k) WHERE hard) q",
    "A22_interval_union": """WITH s AS (SELECT source, target * 10 AS lo, target * 10 + bytes AS hi FROM {occurrences}), b AS (SELECT source, unnest(range(lo, hi)) AS pos FROM s),
    c AS (SELECT DISTINCT source, pos FROM b), i AS (SELECT source, count(*) AS covered FROM c GROUP BY source),
    starts AS (SELECT source, count(*) AS islands FROM (SELECT source, pos, lag(pos) OVER (PARTITION BY source ORDER BY pos) AS before FROM c) WHERE before IS NULL OR before < pos - 1 GROUP BY source)
    SELECT i.source, i.covered, starts.islands FROM i JOIN starts ON starts.source = i.source""",
    "A24_first_loss_counts": """WITH g AS (SELECT DISTINCT qid, group_id FROM {spans}), found AS (SELECT DISTINCT s.qid, s.group_id FROM {spans} s JOIN {ranked} r ON r.qid = s.qid AND r.item = s.item),
    near AS (SELECT DISTINCT s.qid, s.group_id FROM {spans} s JOIN {ranked} r ON r.qid = s.qid AND r.item = s.item WHERE r.rank <= 5)
    SELECT first_loss, n FROM (SELECT 'candidate' AS first_loss, (SELECT count(*) FROM (FROM g EXCEPT FROM found)) AS n UNION ALL SELECT 'return_limit', (SELECT count(*) FROM (FROM found EXCEPT FROM near)) UNION ALL SELECT 'none', (SELECT count(*) FROM near)) WHERE n > 0""",
    "A26_outcome_counts": "SELECT CASE WHEN l_quantity < 30 THEN 'RESOLVED_UNIQUE' WHEN l_quantity < 40 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS outcome, count(*) AS n FROM {lineitem} GROUP BY 1",
    "A28_role_slices": "SELECT target, coalesce(production, 0) AS production, coalesce(test, 0) AS test, coalesce(benchmark, 0) AS benchmark, coalesce(example, 0) AS example FROM (PIVOT (SELECT target, lower(role) AS role FROM {occurrences}) ON role IN ('production', 'test', 'benchmark', 'example') USING count(*) GROUP BY target)",
    "A41_rollup_check": "SELECT (SELECT sum(n) FROM (SELECT qid, count(*) AS n FROM {ranked} GROUP BY qid))::BIGINT AS by_rows, (SELECT count(*) FROM {ranked} WHERE qid IN (SELECT qid FROM {cases})) AS by_scope",
    # --- windows, orders, sets
    "W13_seed_ranges": "SELECT qid, len(list_filter(r, lambda x: x <= 5)) AS primary_seeds, len(list_filter(r, lambda x: x <= 20)) AS all_seeds, best FROM (SELECT qid, list(rank) AS r, max(score) AS best FROM {vector_lane} GROUP BY qid)",
    "T16_seed_union": "SELECT qid, parent, least(min(v), min(l)) AS place FROM (SELECT qid, parent, rank AS v, NULL AS l FROM {vector_lane} WHERE rank <= 5 UNION ALL SELECT qid, parent, NULL, rank + 5 FROM {label_lane} WHERE rank <= 5) GROUP BY qid, parent",
    "T18_return_limit": "SELECT qid, parent, rank FROM {hybrid_fused} h WHERE (SELECT count(*) FROM {hybrid_fused} o WHERE o.qid = h.qid AND o.rank < h.rank) < 5",
    "U01_lane_union": "SELECT DISTINCT qid, chunk_id FROM (SELECT qid, chunk_id FROM {text_lane} UNION ALL SELECT qid, chunk_id FROM {symbol_lane} UNION ALL SELECT qid, chunk_id FROM {path_lane})",
    "U04_difference": "SELECT path, 'deleted' AS side FROM {files} WHERE path NOT IN (SELECT path FROM {live}) UNION ALL SELECT path, 'added' FROM {live} WHERE path NOT IN (SELECT path FROM {files})",
    "U05_future_keys": "SELECT DISTINCT sha FROM (SELECT sha FROM {live} UNION ALL SELECT sha FROM {files} WHERE path NOT IN (SELECT path FROM {live}))",
    "U07_disjoint_gates": "SELECT count(*) AS overlapping FROM (SELECT DISTINCT qid, item FROM {judgments} WHERE grade = 2 AND hard)",
    "U08_plan_equality": "SELECT (SELECT count(DISTINCT (path, sha)) FROM {files} WHERE (path, sha) NOT IN (SELECT (path, sha) FROM {live})) AS only_left, (SELECT count(DISTINCT (path, sha)) FROM {live} WHERE (path, sha) NOT IN (SELECT (path, sha) FROM {files})) AS only_right",
    "A15_requirement_coverage": """WITH k AS (SELECT unnest([1, 5, 10, 20]) AS k), a AS (SELECT s.qid, k.k, s.group_id, s.alternative, bool_and(s.item IN (SELECT item FROM {ranked} r WHERE r.qid = s.qid AND r.rank <= k.k)) AS whole FROM {spans} s CROSS JOIN k GROUP BY ALL),
    g AS (SELECT qid, k, group_id, bool_or(whole) AS covered FROM a GROUP BY ALL) SELECT qid, k, round(CAST(count(*) FILTER (covered) AS DOUBLE) / count(*), 6) AS coverage, bool_and(covered) AS complete FROM g GROUP BY qid, k""",
    "A23_stage_trace": """SELECT qid, group_id, CASE WHEN NOT bool_or(e.rank IS NOT NULL) THEN 1 WHEN NOT bool_or(r.rank IS NOT NULL) THEN 2 WHEN NOT bool_or(coalesce(r.rank, 99) <= 5) THEN 3 END AS first_loss
    FROM {spans} s LEFT JOIN {exact_ranked} e USING (qid, item) LEFT JOIN {ranked} r USING (qid, item) GROUP BY qid, group_id""",
    "A30_score_distribution": "SELECT qid, len(s) AS n, list_min(s) AS least, list_max(s) AS most, round(list_avg(s), 6) AS mean, round(list_stddev_pop(s), 6) AS deviation, round(list_max(s) - list_min(s), 6) AS span FROM (SELECT qid, list(score) AS s FROM {scores} GROUP BY qid)",
    "A33_one_hop_clusters": "SELECT target, tier, len(list_distinct(list(source))) AS members, list_sort(list(concat(kind, '/', tier)))[1] AS first_label, CAST(list_sum(list(n)) AS BIGINT) AS n FROM {edges} GROUP BY target, tier",
    "A34_packaging_completeness": """WITH g AS (SELECT s.qid, s.group_id, min(r.rank) AS best FROM {spans} s LEFT JOIN {ranked} r USING (qid, item) GROUP BY s.qid, s.group_id),
    late AS (SELECT s.qid, min(r.rank) FILTER (r.rank > 5) AS rank FROM {spans} s JOIN {ranked} r USING (qid, item) GROUP BY s.qid)
    SELECT g.qid, count(*) FILTER (best IS NULL OR best > 5) = 0 AS complete, count(*) FILTER (best IS NULL OR best > 5) AS missing_groups, any_value(late.rank) AS best_missing_rank FROM g LEFT JOIN late ON late.qid = g.qid GROUP BY g.qid""",
    "A38_cell_outcomes": """WITH c AS (SELECT r.qid, b.most, r.item, j.grade, j.hard FROM {ranked} r JOIN {budgets} b ON r.rank <= b.most LEFT JOIN {judgments} j USING (qid, item))
    SELECT c.qid, c.most, count(*) FILTER (grade = 2) AS direct, count(*) FILTER (grade = 1) AS support, count(*) FILTER (grade IS NULL OR grade = 0) AS noise, count(*) FILTER (hard) AS hard_negative,
    count(DISTINCT (SELECT group_id FROM {spans} s WHERE s.qid = c.qid AND s.item = c.item)) AS groups FROM c GROUP BY c.qid, c.most""",
    "J15_lexical_outer_join": "SELECT qid, chunk_id, min(t) AS text_rank, min(s) AS symbol_rank FROM (SELECT qid, chunk_id, rank AS t, NULL AS s FROM {text_lane} UNION ALL SELECT qid, chunk_id, NULL, rank FROM {symbol_lane}) GROUP BY qid, chunk_id",
    "J16_lexical_vector_outer": "SELECT qid, parent, min(l) AS lexical_rank, min(v) AS vector_rank FROM (SELECT qid, parent, rank AS l, NULL AS v FROM {label_lane} UNION ALL SELECT qid, parent, NULL, rank FROM {vector_lane}) GROUP BY qid, parent",
    "J19_hit_to_node": "SELECT qid, parent AS node, rank FROM {vector_lane} WHERE parent IN (SELECT source FROM {edges})",
    "J25_hint_endpoints": "SELECT source, target, first_rank FROM (SELECT DISTINCT source, target FROM {edges}) JOIN (SELECT parent, min(rank) AS first_rank FROM {vector_lane} GROUP BY parent) ON parent = target",
    "S10_planning_keys": "SELECT sha, len(ids) AS uses, list_min(ids) AS first_file, CAST(len(ids) * size AS BIGINT) AS bytes FROM (SELECT sha, size, list(file_id) AS ids FROM {files} GROUP BY sha, size)",
    "S23_run_state_machine": """SELECT state, count(*) AS n FROM (SELECT DISTINCT ON (user_id) user_id, CASE WHEN event_type IN ('signup', 'view') THEN 'building' WHEN event_type = 'click' THEN 'ready' WHEN event_type = 'purchase' THEN 'published' ELSE 'failed' END AS state FROM {events} ORDER BY user_id, event_id DESC) GROUP BY state""",
    "W04_running_bytes": "SELECT qid, chunk_id, total, (SELECT count(*) FROM {budgets} b WHERE b.bytes >= total) AS budgets_met FROM (SELECT r.qid, r.chunk_id, (SELECT CAST(sum(f.size) AS BIGINT) FROM {lexical_fused} o JOIN {files} f ON f.file_id = o.chunk_id WHERE o.qid = r.qid AND o.rank <= r.rank) AS total FROM {lexical_fused} r)",
    "W12_tail_after_head": """WITH head AS (SELECT qid, parent, rank FROM {hybrid_fused} WHERE rank <= 5), tail AS (SELECT qid, parent, rank FROM {vector_lane} WHERE (qid, parent) NOT IN (SELECT (qid, parent) FROM head))
    SELECT qid, parent, rank FROM head UNION ALL SELECT qid, parent, rank FROM (SELECT t.qid, t.parent, (SELECT count(*) FROM head h WHERE h.qid = t.qid) + row_number() OVER (PARTITION BY t.qid ORDER BY t.rank, t.parent) AS rank FROM tail t) WHERE rank <= 20""",
    "T15_bundle_selection": """SELECT v.qid, v.parent AS source, first(e.target ORDER BY e.n DESC, e.best_id) AS target, first(e.kind ORDER BY e.n DESC, e.best_id) AS kind FROM {vector_lane} v JOIN {edges} e ON e.source = v.parent WHERE v.rank <= 2 GROUP BY v.qid, v.parent""",
    "U06_group_sets": """WITH all_of AS (SELECT qid, list_distinct(list(group_id)) AS g FROM {spans} GROUP BY qid), at AS (SELECT s.qid, list_distinct(list(s.group_id) FILTER (r.rank <= 10)) AS ten, list_distinct(list(s.group_id) FILTER (r.rank <= 3)) AS three FROM {spans} s LEFT JOIN {ranked} r USING (qid, item) GROUP BY s.qid)
    SELECT qid, len(g) AS required, coalesce(len(ten), 0) AS reached, coalesce(len(ten), 0) - coalesce(len(three), 0) AS gained FROM all_of JOIN at USING (qid)""".replace(" at AS", " seen AS").replace("JOIN at USING", "JOIN seen USING"),
    "U10_presence_or": "SELECT qid, group_id, count(*) FILTER ((qid, item) IN (SELECT (qid, item) FROM {ranked} WHERE rank <= 5) OR (qid, item) IN (SELECT (qid, item) FROM {exact_ranked} WHERE rank <= 5)) > 0 AS present FROM {spans} GROUP BY qid, group_id",
    "R18_related_body": "SELECT source, target AS file_id, CASE WHEN size > 1024 THEN 'too_large' ELSE 'whole' END AS outcome, CASE WHEN size > 1024 THEN NULL ELSE size END AS bytes FROM (SELECT source, target FROM {edges} GROUP BY source, target) JOIN {files} ON file_id = target",
    "R19_node_traits": "SELECT p_partkey AS node, p_brand AS package, (SELECT count(*) FROM {occurrences} o WHERE o.source = p_partkey AND o.zone = 'SIGNATURE') AS n FROM {part}",
    "R33_usage_by_operation": "SELECT event_type AS status, event_type = 'error' AS terminal, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM {events} GROUP BY event_type",
    # --- drivers and guards
    "R04_lane_sources": "SELECT qid, parent, CASE coalesce(CAST(lexical_rank > 0 AS INT), 0) + 2 * coalesce(CAST(vector_rank > 0 AS INT), 0) WHEN 3 THEN 'both' WHEN 2 THEN 'vector' ELSE 'fts' END AS score_source, rank FROM {hybrid_fused}",
    "R11_key_states": "SELECT parent, CAST(sum(ready) AS BIGINT) AS ready, CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(1 - ready - pending) AS BIGINT) AS invalid FROM (SELECT parent, CAST(vec_id IN (SELECT vec_id FROM {cache} WHERE scale > 0) AS INT) AS ready, CAST(vec_id NOT IN (SELECT vec_id FROM {cache}) AS INT) AS pending FROM {vectors}) GROUP BY parent",
    "R12_terminal_history": "SELECT key, id, (SELECT count(*) FROM {log} m WHERE m.terminal AND m.key = l.key AND m.id <= l.id) AS attempt FROM {log} l WHERE terminal",
    "R27_source_reproof": "SELECT path, (path, sha) IN (SELECT (path, sha) FROM {live}) AS proven FROM {files}",
    # --- written last
    "S06_parent_inventory": """SELECT chunk_id, (SELECT path FROM {files} f WHERE f.file_id = c.file_id) AS path, (SELECT language FROM {files} f WHERE f.file_id = c.file_id) AS language, symbol, qualified, end_byte - start_byte AS bytes, body
    FROM {chunks} c WHERE file_id IN (SELECT file_id FROM {files})""",
    "S27_migrate_rows": """SELECT vec_id, scale, norm, profile, '' AS lineage, 'ready' AS state, 5 AS schema_version FROM {cache} WHERE norm > 0 AND scale > 0
    UNION ALL SELECT vec_id, scale, norm, profile, '', 'terminal', 5 FROM {cache} WHERE norm > 0 AND NOT scale > 0""",
    "S28_rekey_reusable": "SELECT vec_id, profile AS old_profile, 9 AS new_profile FROM {cache} WHERE profile IN (0, 2) AND scale > 0 AND (vec_id, scale, norm) IN (SELECT (vec_id, scale, norm) FROM {vectors})",
    "P05_effective_shape": """SELECT qid, CASE WHEN h > 0 THEN CASE WHEN t > 0 AND a > 1 THEN 'mixed' ELSE 'anchor' END WHEN l = 0 THEN 'descriptive' WHEN t > 0 OR k > 1 THEN 'mixed' ELSE 'anchor' END AS shape, h AS n_high, l AS n_lane FROM (
    SELECT qid, (SELECT count(*) FROM {fragments} f WHERE f.qid = q.qid AND confidence = 'high') AS h, (SELECT count(*) FROM {fragments} f WHERE f.qid = q.qid AND confidence = 'text') AS t, (SELECT count(*) FROM {fragments} f WHERE f.qid = q.qid) AS a,
      (SELECT count(*) FROM {query_terms} x WHERE x.qid = q.qid) AS k, (SELECT count(*) FROM {symbol_lane} x WHERE x.qid = q.qid) AS l FROM (SELECT qid FROM {fragments} INTERSECT SELECT qid FROM {query_terms}) q)""",
    "P11_vector_validity": "SELECT vec_id, scale > 0 AND norm > 0 AND len(codes) = 32 AND abs(norm - CAST(sqrt(CAST(list_sum(list_transform(codes, lambda c: c * c)) AS DOUBLE)) * CAST(scale AS DOUBLE) AS FLOAT)) <= 0.000001 AS valid FROM {cache}",
    "P12_row_violations": """SELECT 'chunk range' AS violation, count(*) - count(*) FILTER (end_byte >= start_byte AND start_byte >= 0) AS n FROM {chunks}
    UNION ALL SELECT 'empty body', count(*) FILTER (end_byte - start_byte = 0) FROM {chunks}
    UNION ALL SELECT 'duplicate path', count(DISTINCT path) FROM (SELECT path, count(*) OVER (PARTITION BY path) AS k FROM {files}) WHERE k > 1
    UNION ALL SELECT 'occurrence ordinal', count(*) FILTER (NOT ordinal >= 1) FROM {occurrences}
    UNION ALL SELECT 'duplicate occurrence', count(DISTINCT occ_id) FROM (SELECT occ_id, count(*) OVER (PARTITION BY occ_id) AS k FROM {occurrences}) WHERE k > 1""",
    "J01_matches_chunks_files": """SELECT qid, chunk_id, chunk_id NOT IN (SELECT chunk_id FROM {chunks} WHERE file_id IN (SELECT file_id FROM {live})) AS orphaned,
    (SELECT l.path FROM {chunks} c JOIN {live} l ON l.file_id = c.file_id WHERE c.chunk_id = s.chunk_id) AS path FROM {text_scores} s""",
    "J04_segments_chunks_files": """SELECT vec_id, parent, (SELECT qualified FROM {chunks} c WHERE c.chunk_id = v.parent) AS qualified, (SELECT f.path FROM {chunks} c JOIN {files} f ON f.file_id = c.file_id WHERE c.chunk_id = v.parent) AS path
    FROM {vectors} v WHERE parent IN (SELECT chunk_id FROM {chunks} WHERE file_id IN (SELECT file_id FROM {files}))""",
    "J09_meta_singleton": "SELECT file_id, path, 2 AS active_generation, count(*) OVER () AS manifest_rows FROM {files}",
    "J14_shared_key_fanout": """SELECT b.qid, f.sha, c.chunk_id, b.score FROM (SELECT DISTINCT ON (qid, parent) qid, parent, score FROM {scores} ORDER BY qid, parent, score DESC) b, {files} f, {chunks} c
    WHERE c.file_id = f.file_id AND f.sha = (SELECT k.sha FROM {files} k WHERE k.file_id = b.parent)""",
    "J24_attachments_labels": """SELECT qid, item, rank, (SELECT grade FROM {judgments} j WHERE j.qid = h.qid AND j.item = h.item) AS grade, (SELECT hard FROM {judgments} j WHERE j.qid = h.qid AND j.item = h.item) AS hard,
    (SELECT answerable FROM {cases} c WHERE c.qid = h.qid) AS answerable FROM {ranked} h""",
    "A02_matched_terms": "SELECT t.qid, p.chunk_id, count(*) AS matched_terms, any_value(s.n) AS selected_terms FROM {query_terms} t JOIN {postings} p USING (term) JOIN (SELECT qid, count(DISTINCT term) AS n FROM {query_terms} GROUP BY qid) s ON s.qid = t.qid GROUP BY t.qid, p.chunk_id",
    "A11_embedding_plan": """WITH k AS (SELECT sha, max(size) AS size FROM {files} GROUP BY sha), ready AS (SELECT DISTINCT sha FROM {files} JOIN {cache} ON vec_id = file_id WHERE scale > 0), bad AS (SELECT DISTINCT sha FROM {files} WHERE file_id % 13 = 4),
    pay AS (SELECT * FROM k WHERE sha NOT IN (SELECT sha FROM ready) AND sha NOT IN (SELECT sha FROM bad))
    SELECT (SELECT count(*) FROM k) AS distinct_keys, (SELECT count(*) FROM ready) AS ready, (SELECT count(*) FROM bad WHERE sha NOT IN (SELECT sha FROM ready)) AS skipped, (SELECT count(*) FROM pay) AS payable, CAST((SELECT coalesce(sum(size), 0) FROM pay) AS BIGINT) AS token_bound""",
    "A35_packaging_totals": """SELECT b.most, count(*) AS queries, count(*) FILTER (best <= b.most) AS complete, count(*) FILTER (best <= b.most AND best > 1) AS wins, count(*) FILTER (best > b.most AND best <= 1) AS losses FROM {budgets} b CROSS JOIN (
    SELECT c.qid, coalesce(min(r.rank) FILTER (j.grade = 2), 1000000) AS best FROM {cases} c LEFT JOIN {ranked} r ON r.qid = c.qid LEFT JOIN {judgments} j ON j.qid = r.qid AND j.item = r.item GROUP BY c.qid) GROUP BY b.most""",
    "A37_budget_controls": """SELECT qid, most, bytes, count(*) AS candidates, count(*) FILTER (fits) AS emitted, count(*) - count(*) FILTER (fits) AS omitted, CAST(coalesce(sum(size) FILTER (fits), 0) AS BIGINT) AS emitted_bytes FROM (
    SELECT r.qid, b.most, b.bytes, f.size, NOT (r.rank > b.most OR f.size > b.bytes) AS fits FROM {lexical_fused} r, {files} f, {budgets} b WHERE f.file_id = r.chunk_id) GROUP BY qid, most, bytes""",
    "W06_source_ordinals": "SELECT a.occ_id, a.source, count(*) AS source_ordinal FROM {occurrences} a JOIN {occurrences} b ON b.source = a.source AND (b.ordinal, b.bytes, b.occ_id) <= (a.ordinal, a.bytes, a.occ_id) GROUP BY a.occ_id, a.source",
    "T12_prefix_rerank": """SELECT e.source, e.target, e.best_id, row_number() OVER (PARTITION BY e.source ORDER BY e.n DESC, e.best_id) AS rank FROM (SELECT *, list_position(['DECLARATION_CONTRACT', 'EXECUTABLE_DEPENDENCY', 'BODY_REFERENCE', 'DECLARATION_STRUCTURE'], tier) AS place FROM {edges}) e
    JOIN (SELECT source, min(list_position(['DECLARATION_CONTRACT', 'EXECUTABLE_DEPENDENCY', 'BODY_REFERENCE', 'DECLARATION_STRUCTURE'], tier)) AS least FROM {edges} GROUP BY source) m ON m.source = e.source AND m.least = e.place""",
    "R02_reference_scores": "SELECT qid, vec_id, max(score) FILTER (k = 1) AS score, max(score) FILTER (k = 2) AS reference FROM (SELECT qid, vec_id, score, 1 AS k FROM {scores} UNION ALL SELECT qid, vec_id, score, 2 FROM {exact_scores}) GROUP BY qid, vec_id HAVING count(*) = 2",
    "R14_migration": "SELECT vec_id, scale, norm, '' AS source_profile, vec_id % 3 AS serving_profile FROM {vectors} WHERE vec_id % 7 <> 2 AND vec_id % 11 <> 5 AND scale > 0 AND norm > 0",
}
