"""SQL of those training-data queries that SQL can express, for an engine with list functions."""

from __future__ import annotations

from tarnwell.llm import chat, collocations, quality, url_filter

#: Cosine of all pairs in double precision, links, and reachability by a recursive query.
EMBEDDING_NEAR_DEDUP = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS (
  SELECT vec_id, v FROM vectors WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM usable UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), components AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id, v.vec_id = coalesce(c.component_id, v.vec_id) AS kept
FROM vectors v LEFT JOIN components c ON c.a = v.vec_id LEFT JOIN counts n ON n.a = v.vec_id
"""


def _url_filter() -> str:
    u = url_filter
    two = f"regexp_matches(two, '{u.TWO_LABELS}')"
    address = f"regexp_matches(name, '{u.ADDRESS}')"
    ordered = sorted(u.RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, ordered)) + " END"
    says = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, ordered)) + " END"
    clip = lambda x: f"greatest(0.001, least(0.999, {x}))"

    def level(rows: str) -> str:
        """Rows (.., n, bad, parent) with alpha and beta."""
        return f"""SELECT *, {clip("parent")} * strength + bad AS alpha, (1 - {clip("parent")}) * strength + n - bad AS beta FROM {rows} CROSS JOIN (
        SELECT 1 / {clip("CASE WHEN sum(v * (n - 1)) > 0 THEN (sum(n * (bad / n - m) * (bad / n - m)) - sum(v)) / sum(v * (n - 1)) ELSE 0.5 END")} - 1 AS strength
        FROM (SELECT *, {clip("parent")} AS m, {clip("parent")} * (1 - {clip("parent")}) AS v FROM {rows}))"""

    return f"""
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, replace(html, '&amp;', '&') AS plain FROM pages
), judged AS (
  SELECT page_id, host, path, length(plain) - length(regexp_replace(plain, '#{{3,}}|\\*{{3,}}|\\${{3,}}|%{{3,}}|&{{3,}}', '', 'g')) > {u.JUNK_SHARE} * length(plain) AS bad FROM cut
), labelled AS (
  SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE bad) AS DOUBLE) AS bad FROM judged WHERE bad IS NOT NULL GROUP BY host
), hosts AS (
  SELECT *, CASE WHEN {address} THEN name WHEN {two} THEN array_to_string(labels[-3:], '.') ELSE two END AS domain, CASE WHEN {address} THEN '(address)' WHEN {two} THEN two ELSE labels[-1] END AS suffix
  FROM (SELECT *, array_to_string(labels[-2:], '.') AS two FROM (SELECT *, string_split(name, '.') AS labels FROM (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM labelled)))
), suffix_rows AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM labelled) AS parent FROM hosts GROUP BY suffix
), suffixes AS (SELECT suffix, alpha / (alpha + beta) AS mean FROM ({level("suffix_rows")})),
domain_rows AS (
  SELECT d.domain, d.n, d.bad, s.mean AS parent FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix) d JOIN suffixes s ON s.suffix = d.suffix
), domains AS (SELECT domain, alpha / (alpha + beta) AS mean FROM ({level("domain_rows")})),
host_rows AS (SELECT h.host, h.n, h.bad, d.mean AS parent FROM hosts h JOIN domains d ON d.domain = h.domain),
known AS (
  SELECT host, CAST(n AS BIGINT) AS n_pages, alpha / (alpha + beta) AS share,
    greatest(0.0, alpha / (alpha + beta) - {u.DEVIATIONS} * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))) AS bound FROM ({level("host_rows")})
)
SELECT j.page_id, j.host, j.path, {rule.replace("host", "j.host").replace("path", "j.path")} AS rule,
  coalesce({says.replace("host", "j.host").replace("path", "j.path")}, CASE WHEN k.bound > {u.BLOCK_SHARE} THEN 'block' ELSE 'allow' END) AS verdict, k.n_pages, round(k.share, 6) AS share, round(k.bound, 6) AS bound
FROM judged j LEFT JOIN known k ON k.host = j.host
"""


URL_FILTER = _url_filter()


def _quality_rules() -> str:
    q = quality
    words = lambda x: f"regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+')"
    symbols = lambda x: f"length(regexp_replace({x}, '[^#*$%&|<>]', '', 'g'))"
    phrases = q.BOILERPLATE.pattern.replace("'", "''")
    stop = q._STOP.pattern.replace("'", "''")
    chars = lambda x: f"length(regexp_replace({x}, '[\\x20\\x09-\\x0D]+', '', 'g'))"
    return f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS text FROM documents),
counted AS (SELECT *, {words("text")} AS w FROM texts),
windows AS (SELECT id, i, list_reduce([w[i + 1], w[i + 2], w[i + 3], w[i + 4]], lambda a, b: a || ' ' || b, w[i]) AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM counted WHERE len(w) >= 5)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY id),
split AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM texts),
lines AS (SELECT id, line, len({words("line")}) AS n, {chars("line")} AS chars FROM split),
duplicates AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM lines WHERE n > 0 GROUP BY id),
lost AS (
  SELECT id, CAST(sum(chars) AS BIGINT) AS n FROM lines WHERE n > 0 AND (
    regexp_matches(lower(line), '{phrases}')
    OR (len(regexp_split_to_array(line, '{q._MENU.pattern}')) >= {q.MENU_PARTS} AND len(list_filter(regexp_split_to_array(line, '{q._MENU.pattern}'), lambda p: len({words("p")}) > {q.MENU_WORDS})) = 0)
    OR {symbols("line")} > {q.SYMBOL_SHARE} * length(line)
    OR (length(regexp_replace(line, '[^!]', '', 'g')) > {q.SHOUTED} * n AND n >= 3)
    OR (n >= {q.LONG_LINE} AND NOT regexp_matches(line, '{stop}'))) GROUP BY id
), all_counts AS (
  SELECT c.doc_id, len(w) AS n_words, {chars("text")} AS word_chars, {symbols("text")} AS n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS lost_chars
  FROM counted c LEFT JOIN duplicates d ON d.id = c.id LEFT JOIN repeated r ON r.id = c.id LEFT JOIN lost l ON l.id = c.id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= {q.MOST_LOST} * word_chars AS kept, lost_chars FROM all_counts
"""


QUALITY_RULES = _quality_rules()

ORACLES = {
    "op1_embedding_near_dedup": EMBEDDING_NEAR_DEDUP,
    "op5_quality_rules": QUALITY_RULES,
    "op7_chat_perspectives": chat.SQL,
    "op9_url_filter": URL_FILTER,
    "op11_collocations": collocations.SQL,
}
