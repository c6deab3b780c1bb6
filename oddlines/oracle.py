"""SQL of the library's queries, for an engine that reads the same tables."""

from __future__ import annotations

from .functions.constants import AXES, CAPS, LINEAR_WEIGHTS, PHRASES
from .functions.lexical import LINE_END, NAME, TOKEN

_LEXICAL = ("nesting_depth", "length", "token_entropy", "naming_entropy", "name_flow")
_NAMES = list(AXES)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _unit(f: str) -> str:
    return f"least(greatest({f} / {CAPS[f]}::DOUBLE, 0), 1)"


def _mean(axis: str) -> str:
    members = AXES[axis][0]
    return "(" + " + ".join(_unit(m) if m in _LEXICAL else "0" for m in members) + f") / {len(members)}::DOUBLE"


_SCORE = "round(" + " + ".join(f"{LINEAR_WEIGHTS[f]}::DOUBLE * {_unit(f)}" for f in _LEXICAL) + ", 9)"
_AXES = ", ".join(f"round(least(1.0, {_mean(a)} / {AXES[a][1]}::DOUBLE), 4) AS {a}" for a in _NAMES)

SPLIT = f"""
l0 AS (SELECT doc_id AS file_id, source AS repo, source || '/' || doc_id || '.py' AS path, string_split_regex(coalesce(text, ''), {_q(LINE_END)}) AS ls, text AS code FROM documents),
l1 AS (SELECT file_id, repo, path, code, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM l0),
l2 AS (SELECT file_id, repo, path, ls, unnest(range(1, len(ls) + 1)) AS line FROM l1),
l AS (SELECT file_id, repo, path, line::INT AS line, ls[line] AS raw FROM l2 WHERE NOT regexp_matches(ls[line], '^\\s*(#|$)'))"""
FEATURES = f"""{SPLIT},
t AS (SELECT *, list_filter(regexp_extract_all(raw, {_q(TOKEN)}), lambda x: NOT starts_with(x, '#')) AS t FROM l),
n AS (SELECT *, list_filter(t, lambda x: regexp_matches(x, {_q(NAME)})) AS n FROM t),
f AS (
  SELECT file_id, repo, path, line, 0.7::DOUBLE * floor((length(raw) - length(regexp_replace(raw, '^[ \\t]+', ''))) / 2) AS nesting_depth, len(t)::DOUBLE AS length,
    CASE WHEN len(t) <= 1 THEN 0.0 ELSE list_aggregate(t, 'entropy') END::DOUBLE AS token_entropy,
    CASE WHEN length(array_to_string(n, '')) <= 1 THEN 0.0 ELSE list_aggregate(regexp_extract_all(array_to_string(n, ''), '.'), 'entropy') END::DOUBLE AS naming_entropy,
    len(list_distinct(n))::DOUBLE AS name_flow
  FROM n
)"""
SCORED = f"""{FEATURES},
s0 AS (SELECT file_id, repo, path, line, {_SCORE} AS raw_score, {_AXES} FROM f),
s AS (SELECT *, cume_dist() OVER (ORDER BY raw_score) AS score, cume_dist() OVER (ORDER BY raw_score) >= 0.9 AS flag FROM s0)"""


def _dominant(value: str) -> str:
    """The axis with the greatest value(axis), the first of equals."""
    most = "greatest(" + ", ".join(value.format(a) for a in _NAMES) + ")"
    return "CASE WHEN " + value.format(_NAMES[0]) + " IS NULL THEN NULL " + " ".join(f"WHEN {value.format(a)} = {most} THEN '{a}'" for a in _NAMES) + " END"


_SUMS = ", ".join(f"sum({a}) FILTER (flag) AS {a}" for a in _NAMES)
SUMMARY = f"""{SCORED},
p AS (SELECT file_id, count(*) AS n_lines, count(*) FILTER (flag) AS n_flagged, max(score) AS top_score, {_SUMS} FROM s GROUP BY file_id),
y AS (
  SELECT l1.repo, l1.path, l1.file_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_flagged, 0) AS n_flagged, coalesce(round(top_score, 9), 0) AS top_score, {_dominant('round({}, 9)')} AS dominant_axis
  FROM l1 LEFT JOIN p USING (file_id)
)"""
SAMPLES = f"""{FEATURES},
b AS (SELECT file_id AS doc_id, max({_SCORE}) AS score FROM f GROUP BY file_id),
sm AS (SELECT lang AS "set", d.doc_id AS sample_id, 1 - quality AS label, coalesce(score, 0)::DOUBLE AS score FROM labels JOIN documents d USING (doc_id) LEFT JOIN b USING (doc_id))"""
_MARK = " ".join(f"WHEN regexp_matches(raw, {_q(p)}) THEN '{n}'" for n, p in (("license", "(?i)licen[cs]e"), ("rights", "(?i)all rights"), ("mail", "@"), ("number", "[0-9]{4,}")))
MARKED = f"""{SPLIT}, m AS (SELECT * FROM (SELECT file_id, line, CASE {_MARK} END AS marker FROM l) WHERE marker IS NOT NULL),
sz AS (SELECT file_id, len(ls)::INT AS n FROM l1 WHERE len(ls) > 0),
sp AS (
  SELECT file_id, 0 AS span_id, 1 AS start, n AS "end" FROM sz
  UNION ALL SELECT file_id, (r + 1)::INT, (3 * r + 1)::INT, least(3 * r + 3, n)::INT FROM (SELECT file_id, n, unnest(range(0, (n - 1) // 3 + 1)) AS r FROM sz)
),
cs AS (SELECT * FROM sp WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.file_id = sp.file_id AND m.line BETWEEN sp.start AND sp."end"))"""
_CHANGED = """
li AS (SELECT *, 'src/p' || (l_partkey % 7) || CASE WHEN l_returnflag = 'R' THEN '.txt' ELSE '.py' END AS path FROM lineitem),
c AS (
  SELECT l_orderkey AS pr_id, path, l_quantity::BIGINT + 1 AS line, 'new ' || l_partkey AS text FROM li WHERE path LIKE '%.py'
  UNION ALL SELECT l_orderkey, path, l_quantity::BIGINT + 2, '++ odd ' || l_suppkey FROM li WHERE path LIKE '%.py' AND l_linenumber % 2 = 0
),
ps0 AS (SELECT l_orderkey AS pr_id, 'src/p' || (l_partkey % 7) || '.py' AS path, unnest(range(l_quantity::BIGINT, l_quantity::BIGINT + 4)) AS line, (l_suppkey % 10) / 10::DOUBLE + l_discount AS score FROM lineitem),
ps AS (SELECT pr_id, path, line, max(score) AS score FROM ps0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY score DESC, path, line)::INT AS rank FROM ps WHERE score >= 0.5 AND round(score, 4) >= 0.5 AND EXISTS (SELECT 1 FROM c WHERE c.pr_id = ps.pr_id AND c.path = ps.path AND c.line = ps.line))"""
_WORSE = """f AS (
  SELECT l_orderkey AS pr_id, 'p' || (l_partkey % 7) AS path, 'f' || l_linenumber AS function, round(max(l_discount) + max(l_tax), 4) AS function_score, round(max(l_discount), 4) AS function_score_before FROM lineitem GROUP BY ALL
), fd AS (SELECT *, round(function_score - function_score_before, 4) AS function_score_delta FROM f),
w AS (SELECT pr_id, path, function, function_score, function_score_before, function_score_delta, row_number() OVER (PARTITION BY pr_id ORDER BY function_score_delta DESC, path, function)::INT AS rank FROM fd WHERE function_score_delta >= 0.05 QUALIFY rank <= 2)"""
_PAIRS = [(a, b) for i, a in enumerate(_LEXICAL) for b in _LEXICAL[i:]]
_PHRASE = "CASE a.axis " + " ".join(f"WHEN '{a}' THEN {_q(p)}" for a, p in PHRASES.items()) + " END"
_STRENGTH = "(" + " + ".join(_NAMES) + ")"
_TEAM = "CASE length(repo) % 3 WHEN 0 THEN 2.0 * complexity + tangled_state + hidden_calls + exception_surface + 0.5 * naming + malformed WHEN 1 THEN complexity + tangled_state + hidden_calls + exception_surface + 3.0 * naming + malformed END"
_SWEEP = """,
cand AS (SELECT DISTINCT "set", round(score, 4) AS threshold FROM sm),
tot AS (SELECT "set", count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM sm GROUP BY ALL),
sw AS (
  SELECT cand."set", threshold, 0.5 * (coalesce(count(*) FILTER (label = 1 AND score >= threshold) / nullif(any_value(p), 0)::DOUBLE, 0) + 1 - coalesce(count(*) FILTER (label = 0 AND score >= threshold) / nullif(any_value(q), 0)::DOUBLE, 0)) AS ba
  FROM cand JOIN sm USING ("set") JOIN tot USING ("set") GROUP BY ALL
)"""

#: The tiny net along each user's events: potentials a and b of the hidden cells, c of the output.
_CELLS = """WITH RECURSIVE e AS (
  SELECT user_id, event_id, least(greatest(value / 100, 0), 1) AS x, (event_type = 'error')::INT::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), r AS (
  SELECT user_id, k, event_id, 0.9::DOUBLE * x + 0.3::DOUBLE * y AS a, 0.2::DOUBLE * x + 0.8::DOUBLE * y AS b, 0.7::DOUBLE * (0.9::DOUBLE * x + 0.3::DOUBLE * y > 1)::INT + 0.6::DOUBLE * (0.2::DOUBLE * x + 0.8::DOUBLE * y > 1)::INT AS c FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, k, event_id, a, b, 0.9::DOUBLE * pc - (pc > 1)::INT + 0.7::DOUBLE * (a > 1)::INT + 0.6::DOUBLE * (b > 1)::INT AS c FROM (
    SELECT e.user_id, e.k, e.event_id, 0.9::DOUBLE * r.a + 0.9::DOUBLE * x + 0.3::DOUBLE * y - (r.a > 1)::INT AS a, 0.9::DOUBLE * r.b + 0.2::DOUBLE * x + 0.8::DOUBLE * y - (r.b > 1)::INT AS b, r.c AS pc FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
)"""

SQL: dict[str, str] = {
    "split_counts": f"WITH {SPLIT} SELECT file_id, len(ls) AS n_lines, (SELECT count(*) FROM l WHERE l.file_id = l1.file_id) AS n_scored FROM l1",
    "lexical_features": f"WITH {FEATURES} SELECT file_id, line, {', '.join(f'round({x}, 6) AS {x}' for x in _LEXICAL)} FROM f",
    "axes": f"WITH {FEATURES}, a AS (SELECT repo, {_AXES} FROM f) SELECT repo, {', '.join(f'round(avg({a}), 6) AS {a}' for a in _NAMES)}, count(*) AS n FROM a GROUP BY repo",
    "linear_scores": f"WITH {FEATURES}, a AS (SELECT file_id, {_SCORE} AS s FROM f) SELECT file_id, max(s) AS top_score, round(avg(s), 6) AS mean_score FROM a GROUP BY file_id",
    "percentile_flags": f"WITH {SCORED} SELECT file_id, line, round(score, 9) AS score, flag FROM s",
    "ecdf": f"WITH {FEATURES}, a AS (SELECT {_SCORE} AS score FROM f) SELECT score, sum(count(*)) OVER (ORDER BY score)::BIGINT AS n_le, (SELECT count(*) FROM a) AS n FROM a GROUP BY score",
    "team_weights": f"WITH {SCORED}, w AS (SELECT file_id, CASE WHEN length(repo) % 3 = 2 OR {_STRENGTH} <= 1e-6 THEN raw_score ELSE least(greatest(raw_score * ({_TEAM}) / {_STRENGTH}, 0), 1) END AS v FROM s) SELECT file_id, round(max(v), 6) AS top_weighed, round(avg(v), 6) AS mean_weighed FROM w GROUP BY file_id",
    "axis_p95": f"WITH {FEATURES} SELECT repo, {', '.join(f'round(quantile_cont({_mean(a)}, 0.95), 6) AS {a}' for a in ('complexity', 'tangled_state', 'naming'))} FROM f GROUP BY repo",
    "feature_correlations": f"WITH {FEATURES} " + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", nullif(round(corr({a}, {b}), 6), 'nan'::DOUBLE) AS r FROM f" for a, b in _PAIRS if a != b),
    "moments": f"WITH {FEATURES} SELECT {', '.join(f'round(avg({x}), 6) AS mean_{x}' for x in _LEXICAL)}, {', '.join(f'round(covar_samp({a}, {b}), 5) AS cov_{a}_{b}' for a, b in _PAIRS)} FROM f",
    "file_summaries": f"WITH {SUMMARY} SELECT *, CASE WHEN n_flagged = 0 THEN 'no suspicious spikes detected' ELSE CASE WHEN n_flagged = 1 THEN '1 high-intensity spike detected' ELSE n_flagged || ' high-intensity spikes detected' END || ' — dominant axis: ' || dominant_axis END AS verdict FROM y",
    "file_analyses": f"""WITH {SUMMARY},
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, line) AS rank FROM s WHERE flag QUALIFY rank <= 10),
a0 AS ({' UNION ALL '.join(f"SELECT file_id, line, rank, '{a}' AS axis, {i} AS ord, {a} AS v FROM r" for i, a in enumerate(_NAMES))}),
a1 AS (SELECT *, row_number() OVER (PARTITION BY file_id, line ORDER BY v DESC, ord) AS k FROM a0),
a2 AS (
  SELECT file_id, line, rank, count(*) FILTER (k <= 2 AND v >= 0.35) AS d, string_agg(axis || ' (' || printf('%.2f', v) || ')', ' + ' ORDER BY k) FILTER (k <= 2 AND v >= 0.35) AS named,
    string_agg({_PHRASE}, '; ' ORDER BY k) FILTER (k <= 2 AND v >= 0.35) AS said, max(CASE WHEN k = 1 THEN axis || ' (' || printf('%.2f', v) || ')' END) AS leader
  FROM a1 a GROUP BY ALL
),
a3 AS (SELECT file_id, string_agg(line || '|' || CASE d WHEN 0 THEN 'broadly elevated across axes; leader is ' || leader WHEN 1 THEN 'high on ' || named || ': ' || said ELSE 'high on ' || named || ' — ' || said END, '; ' ORDER BY rank) AS top_flagged FROM a2 GROUP BY file_id)
SELECT y.file_id, n_flagged, coalesce(top_flagged, '') AS top_flagged FROM y LEFT JOIN a3 USING (file_id)""",
    "repo_rollup": f"""WITH {SCORED}, z AS (SELECT * REPLACE (flag AND round(score, 4) >= 0.95 AS flag) FROM s),
u AS (SELECT repo, path, grouping(repo, path)::INT AS level, count(*) AS n_lines, count(*) FILTER (flag) AS n_flagged, round(max(score), 9) AS top_score, {', '.join(f'avg({a}) FILTER (flag) AS {a}' for a in _NAMES)} FROM z GROUP BY ROLLUP (repo, path))
SELECT repo, path, level, n_lines, n_flagged, top_score, {_dominant('round({}, 9)')} AS dominant_axis FROM u""",
    "top_repo_lines": f"WITH {SCORED} SELECT repo, path, line, row_number() OVER (PARTITION BY repo ORDER BY score DESC, string_split(path, '/'), line)::INT AS rank, round(score, 9) AS score FROM s WHERE flag QUALIFY rank <= 20",
    "summary_order": f"WITH {SUMMARY} SELECT path, n_flagged, top_score FROM y ORDER BY top_score DESC, n_flagged DESC, path LIMIT 15",
    "label_statistics": f'WITH {SAMPLES} SELECT "set", label, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(quantile_disc(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95 FROM sm GROUP BY ALL',
    "deviation_threshold": f"WITH {FEATURES} SELECT round(avg({_SCORE}) + stddev_pop({_SCORE}), 6) AS threshold FROM f",
    "threshold_sweep": f'WITH {SAMPLES}{_SWEEP} SELECT "set", threshold, round(ba, 9) AS balanced_accuracy FROM sw',
    "evaluation": f"""WITH {SAMPLES}{_SWEEP},
e AS (
  SELECT "set", count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative, avg(score) FILTER (label = 1) AS mean_positive, avg(score) FILTER (label = 0) AS mean_negative,
    coalesce(avg((score >= 0.2)::INT) FILTER (label = 1), 0) AS fp, coalesce(avg((score >= 0.2)::INT) FILTER (label = 0), 0) AS fn FROM sm GROUP BY ALL
),
g AS (SELECT "set", round(ba, 12) AS ba, threshold, row_number() OVER (PARTITION BY "set" ORDER BY round(ba, 12) DESC, threshold) AS k FROM sw),
h AS (SELECT *, 0.5 * (fp + 1 - fn) AS pa FROM e)
SELECT "set", n_positive, n_negative, round(mean_positive, 6) AS mean_positive, round(mean_negative, 6) AS mean_negative, round(mean_positive - mean_negative, 6) AS gap, round(fp, 6) AS flag_rate_positive, round(fn, 6) AS flag_rate_negative,
  round(pa, 6) AS primary_accuracy, round(CASE WHEN n_positive > 0 AND n_negative > 0 AND ba > round(pa, 12) THEN threshold ELSE 0.2 END, 6) AS optimal_threshold,
  round(CASE WHEN n_positive > 0 AND n_negative > 0 AND ba > round(pa, 12) THEN ba ELSE pa END, 6) AS optimal_accuracy
FROM h JOIN (SELECT * FROM g WHERE k = 1) USING ("set")""",
    "accuracy_threshold": f"""WITH {SAMPLES},
v AS (SELECT DISTINCT "set", score FROM sm),
x AS (SELECT "set", score, lead(score) OVER (PARTITION BY "set" ORDER BY score) AS nxt, count(*) OVER (PARTITION BY "set") AS k FROM v),
c AS (SELECT "set", CASE WHEN k = 1 THEN score ELSE (score + nxt) / 2 END AS threshold FROM x WHERE nxt IS NOT NULL OR k = 1),
r AS (SELECT c."set", threshold, count(*) FILTER ((score >= threshold) = (label = 1)) AS n_right FROM c JOIN sm USING ("set") GROUP BY ALL)
SELECT "set", round(threshold, 9) AS threshold, n_right FROM r QUALIFY row_number() OVER (PARTITION BY "set" ORDER BY n_right DESC, threshold) = 1""",
    "curated_sample": """WITH r AS (
  SELECT source AS repo, lang || CASE WHEN doc_id % 5 = 0 THEN '/tests/' ELSE '/' END || doc_id || '.py' AS path, n_chars AS size FROM documents WHERE doc_id % 5 <> 0 AND n_chars BETWEEN 500 AND 300000
), k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY size, path) - 1 AS i, count(*) OVER (PARTITION BY repo) AS n FROM r)
SELECT repo, path, size FROM k WHERE n <= 12 OR list_contains(list_transform(range(0, 12), lambda j: floor(j * (n / 12::DOUBLE))::BIGINT), i)""",
    "corpus_counts": "SELECT source AS repo, grouping(source)::INT AS is_total, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source)",
    "histograms": "SELECT quality, toxic, grouping(quality)::INT AS over_toxic, count(*) AS n FROM labels GROUP BY GROUPING SETS ((quality), (toxic))",
    "first_events": "SELECT conv_id, text FROM conversations WHERE turn = 0 AND trim(text) <> '' ORDER BY conv_id LIMIT 50",
    "binary_labels": "SELECT CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS label, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'error', 'purchase') GROUP BY ALL",
    "marker_counts": f"WITH {MARKED} SELECT marker, count(*) AS n FROM m GROUP BY marker",
    "marker_spans": f'WITH {MARKED} SELECT m.file_id, m.line, marker, span_id, start, "end", m.line - start AS within FROM m JOIN sp ON m.file_id = sp.file_id AND m.line BETWEEN start AND "end" QUALIFY row_number() OVER (PARTITION BY m.file_id, m.line ORDER BY "end" - start, span_id) = 1',
    "clean_spans": f'WITH {MARKED} SELECT file_id, span_id, start, "end" FROM cs',
    "drawn_negatives": f"""WITH {MARKED}, i AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY span_id) - 1 AS idx, count(*) OVER (PARTITION BY file_id) AS n FROM cs)
SELECT i.file_id, m.line AS for_line, span_id, start, "end", floor((start + "end") / 2)::INT AS middle FROM i JOIN m ON i.file_id = m.file_id AND i.idx = ('0x' || substr(md5('42:' || m.file_id || ':' || m.line), 1, 8))::BIGINT % n""",
    "balanced_samples": """WITH a AS (SELECT doc_id AS sample_id, toxic AS label, md5('42:' || doc_id || ':' || toxic) AS turn FROM labels),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY turn, sample_id) AS r FROM a)
SELECT sample_id, label, turn FROM b WHERE r <= (SELECT least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) FROM a)""",
    "unpivoted_turns": """WITH p AS (SELECT conv_id, turn // 2 AS pair, max(text) FILTER (turn % 2 = 0) AS a, max(text) FILTER (turn % 2 = 1) AS b FROM conversations GROUP BY ALL),
u AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND trim(a) <> trim(b))
SELECT conv_id || ':' || pair AS pair_id, 1 AS label, a AS code FROM u UNION ALL SELECT conv_id || ':' || pair, 0, b FROM u""",
    "span_checks": f"""WITH {MARKED}, j AS (SELECT m.file_id, span_id, string_agg(DISTINCT marker, ',' ORDER BY marker) AS checks, min(m.line) AS first FROM m JOIN sp ON m.file_id = sp.file_id AND span_id > 0 AND m.line BETWEEN start AND "end" GROUP BY ALL)
SELECT file_id, span_id, checks, row_number() OVER (PARTITION BY file_id ORDER BY first, span_id)::INT AS rank FROM j QUALIFY rank <= 3""",
    "unflagged_files": f"WITH {MARKED} SELECT file_id, path FROM l1 WHERE file_id NOT IN (SELECT file_id FROM m) AND length(code) - length(replace(code, chr(10), '')) >= 3",
    "changed_lines": f"WITH {_CHANGED} SELECT * FROM c",
    "review_lines": f"WITH {_CHANGED} SELECT pr_id, path, line, round(score, 6) AS score, rank FROM k WHERE rank <= 2",
    "worse_functions": f"WITH {_WORSE} SELECT * FROM w",
    "pr_summaries": f"""WITH {_CHANGED}, {_WORSE}, t AS (SELECT pr_id, count(DISTINCT path) AS files_touched FROM c GROUP BY pr_id),
g AS (
  SELECT pr_id, count(*) AS total_before_cap, count(*) FILTER (rank <= 2) AS flagged_count,
    string_agg('| `' || path || '` | ' || line || ' | ' || printf('%.2f', score) || ' | high on naming |', chr(10) ORDER BY rank) FILTER (rank <= 2) AS rows FROM k GROUP BY pr_id
),
fx AS (SELECT pr_id, string_agg('| `' || function || '` | `' || path || '` | ' || printf('%.2f | %.2f | +%.2f |', function_score_before, function_score, function_score_delta), chr(10) ORDER BY rank) AS functions FROM w GROUP BY pr_id)
SELECT pr_id, files_touched, coalesce(total_before_cap, 0) AS total_before_cap, coalesce(flagged_count, 0) AS flagged_count,
  CASE WHEN coalesce(flagged_count, 0) = 0 THEN 'no suspicious spikes' ELSE flagged_count || ' high-intensity spike(s) inside the diff' END AS verdict,
  CASE WHEN coalesce(flagged_count, 0) = 0 AND functions IS NULL THEN 'Nothing to comment on in ' || files_touched || ' Python file(s): no added line reaches the review threshold.'
    ELSE concat_ws(chr(10) || chr(10),
      CASE WHEN flagged_count > 0 THEN '**Lines to look at: ' || flagged_count || '** (Python files in this change: ' || files_touched || ')' || chr(10) || chr(10) || '| where | line | score | why |' || chr(10) || '| --- | ---: | ---: | --- |' || chr(10) || rows END,
      '**Functions with a higher score than before:**' || chr(10) || chr(10) || '| function | file | was | is | change |' || chr(10) || '| --- | --- | ---: | ---: | ---: |' || chr(10) || functions) END AS summary_comment
FROM t LEFT JOIN g USING (pr_id) LEFT JOIN fx USING (pr_id)""",
    "event_sequences": f"""{_CELLS}
SELECT user_id, event_id, round(least(1, 0.25::DOUBLE * (1 / (1 + exp(-4 * (a - 1))) + 1 / (1 + exp(-4 * (b - 1)))) + 0.5::DOUBLE / (1 + exp(-4 * (c - 1)))), 6)::DOUBLE AS score FROM r""",
    "event_spikes": f"""{_CELLS}
SELECT user_id, event_id, round(0.35::DOUBLE * ((a > 1)::INT + (b > 1)::INT) + 0.3::DOUBLE * (c > 1)::INT, 6)::DOUBLE AS score FROM r""",
    "event_baselines": f"""{_CELLS},
w AS (SELECT avg((a > 1)::INT) AS a, avg((b > 1)::INT) AS b, avg((c > 1)::INT) AS c FROM r)
SELECT 'hidden' AS layer, 0 AS neuron, round(a, 9) AS rate FROM w UNION ALL SELECT 'hidden', 1, round(b, 9) FROM w UNION ALL SELECT 'output', 0, round(c, 9) FROM w""",
    "event_drift": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg((value >= 50)::INT), 6) AS flag_rate, round(avg(value), 6) AS mean_score FROM events GROUP BY ALL",
}
SQL["streamed_drift"] = SQL["event_drift"]

_CODE = """
o AS (SELECT l_orderkey, count(*)::BIGINT AS n, l_orderkey % 9 = 0 AS bad FROM lineitem GROUP BY l_orderkey)"""
# Of a file that parses, lines 1 (docstring) and 2 (import) are left out; 4, 7-11, 14 and 15 hold code, then come two lines
# for each of n items and the return. Of one that does not, lines 1 and 2 count, and nothing but indents and line 14's error.
SQL["code_line_features"] = f"""WITH {_CODE}
SELECT l_orderkey AS file_id, CASE WHEN bad THEN 11 + 2 * n ELSE 9 + 2 * n END::BIGINT AS n_lines,
  round(0.7::DOUBLE * (16 + 6 * n) + CASE WHEN bad THEN 0 ELSE 0.3::DOUBLE * (15 + 2 * (3 + 2 * n)) END, 6)::DOUBLE AS nesting_depth,
  CASE WHEN bad THEN 0 ELSE 2 + n END::DOUBLE AS cyclomatic_proxy,
  CASE WHEN bad THEN 0 ELSE n * n + 4 * n + 3 END::DOUBLE AS use_def_distance,
  CASE WHEN bad THEN 0 ELSE 2.5 * n END::DOUBLE AS call_graph_shape,
  CASE WHEN bad THEN 0 ELSE 0.75 END::DOUBLE AS exception_density,
  bad::INT::DOUBLE AS parse_error,
  CASE WHEN bad THEN 0 ELSE n * n + 9 * n + 5 END::DOUBLE AS global_reach,
  0.0::DOUBLE AS attr_reach,
  CASE WHEN bad THEN 0 ELSE 3 + 2 * n END::DOUBLE AS call_graph_depth
FROM o"""
# Names of total_of's subtree: its own, items (1 + n times), total (2 + 2n), helper and len (n each), and part-names, as
# often as their item numbers (one digit) come.
_NAME_COUNTS = "list_concat([1, 1 + n, 2 + 2 * n, n, n], parts)"
_CHAR_COUNTS = "list_concat([7 + 6 * n, 4 + 2 * n, 3 + 3 * n, 3 + 4 * n, 1, 1, 1 + n, 1 + 4 * n, 1 + n, 1 + n, n, 2 * n, 2 * n, n], parts)"


def _counted(counts: str) -> str:
    """Entropy of counts."""
    total = f"list_sum({counts})::DOUBLE"
    return f"log2({total}) - list_sum(list_transform({counts}, lambda c: c * log2(c))) / {total}"


SQL["code_function_features"] = f"""WITH {_CODE},
q AS (SELECT l_orderkey, list(k) AS parts FROM (SELECT l_orderkey, l_linenumber, count(*) AS k FROM lineitem GROUP BY ALL) GROUP BY l_orderkey)
SELECT l_orderkey AS file_id, 'helper' AS name, 7::INT AS line, 11::INT AS end_line, 3.0::DOUBLE AS nesting_depth, 20.0::DOUBLE AS length, round(log2(7) - 4 / 7::DOUBLE, 6)::DOUBLE AS token_entropy,
  round(list_aggregate(string_split('helperababRATEValueError', ''), 'entropy'), 6)::DOUBLE AS naming_entropy, 3.0::DOUBLE AS cyclomatic_proxy, 2.0::DOUBLE AS use_def_distance, 5.0::DOUBLE AS name_flow, 0.0::DOUBLE AS call_graph_shape, 0.15::DOUBLE AS exception_density FROM o WHERE NOT bad
UNION ALL
SELECT l_orderkey, 'total_of', 14::INT, (16 + 2 * n)::INT, 2.0, 10 + 19.0 * n, round({_counted(_NAME_COUNTS)}, 6), round({_counted(_CHAR_COUNTS)}, 6), 1.0 + n, round((2 * n * n + 5 * n + 1) / (2 * n + 1)::DOUBLE, 6), 5 + len(parts), 2.5 * n, 0.0 FROM o JOIN q USING (l_orderkey) WHERE NOT bad"""
SQL["code_lineage"] = f"""WITH {_CODE},
ln AS (SELECT *, unnest(range(1, 17 + 2 * n)) AS line FROM o)
SELECT l_orderkey AS file_id, line::INT AS line,
  CASE WHEN bad THEN NULL WHEN line BETWEEN 7 AND 11 THEN 'helper' WHEN line >= 14 THEN 'total_of' END AS function,
  CASE WHEN bad OR line < 7 THEN '' WHEN line = 7 THEN 'function `helper`@7' WHEN line IN (8, 9) THEN '`try` block@8 < function `helper`@7'
    WHEN line IN (10, 11) THEN '`except ValueError`@10 < `try` block@8 < function `helper`@7' WHEN line <= 15 OR line = 16 + 2 * n THEN 'function `total_of`@14'
    ELSE '`if part' || i.l_linenumber || ' > ' || i.l_partkey || '`@' || (16 + 2 * ((line - 16) // 2)) || ' < function `total_of`@14' END AS lineage
FROM ln LEFT JOIN (SELECT l_orderkey AS k, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey || ':') AS r FROM lineitem) i ON i.k = l_orderkey AND i.r = (line - 16) // 2 + 1 AND line >= 16
WHERE line NOT IN (3, 5, 6, 12, 13) AND (bad OR line NOT IN (1, 2))"""
# Indents and branches keep every line that parses below the threshold; the broken line's score is 1.
SQL["code_linear_scores"] = f"WITH {_CODE} SELECT l_orderkey AS file_id, bad::BIGINT AS n_flagged, bad AS broken, bad::INT::DOUBLE AS malformed FROM o"

# The added lines of an order's review that are flagged are the second ones of its even items; features of such a line hang
# on its number only, and so do scores of the function that holds them, whose highest line is the last item's.
_TE, _NE = "(log2(11) - 6 / 11::DOUBLE)", "(log2(24) - (5 * log2(5) + 20) / 24::DOUBLE)"


def _added(line: str) -> str:
    own = {"nesting_depth": "3.4::DOUBLE", "length": "11", "token_entropy": _TE, "naming_entropy": _NE, "use_def_distance": f"({line} - 14)", "name_flow": "4", "call_graph_shape": "2.5::DOUBLE", "global_reach": f"({line} - 7)", "call_graph_depth": "1"}
    return "round(" + " + ".join(f"{LINEAR_WEIGHTS[f]}::DOUBLE * least(greatest({v} / {CAPS[f]}::DOUBLE, 0), 1)" for f, v in own.items()) + ", 9)"


_REVIEW = f"""
it AS (
  SELECT l_orderkey AS pr_id, l_linenumber AS nr, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey || ':') AS r,
    count(*) OVER (PARTITION BY l_orderkey) AS n, (count(*) OVER (PARTITION BY l_orderkey) + 1) // 2 AS n_odd FROM lineitem
),
fl AS (
  SELECT *, 15 + 2 * r AS line, {_added("(15 + 2 * r)")} AS score, round({_added("(15 + 2 * n)")}, 4) AS after, round({_added("(15 + 2 * n_odd)")}, 4) AS before FROM it WHERE r % 2 = 0
),
ax AS (
  SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY score DESC, line)::INT AS rank, count(*) OVER (PARTITION BY pr_id) AS total,
    printf('%.2f', round((2.5 / 4 + 0.25) / 2 / 0.5::DOUBLE, 4)) AS hidden, printf('%.2f', round(({_TE} / 6 + {_NE} / 5) / 2 / 0.68::DOUBLE, 4)) AS naming, round((3.4 / 8 + 11 / 200::DOUBLE) / 3 / 0.37::DOUBLE, 4) AS complexity,
    round((least((line - 14) / 30::DOUBLE, 1) + 4 / 12::DOUBLE + least((line - 7) / 100::DOUBLE, 1)) / 4 / 0.63::DOUBLE, 4) AS tangled
  FROM fl
)"""
SQL["pr_comments"] = f"""WITH {_REVIEW}
SELECT pr_id, 'src/orders.py' AS path, line::INT AS line, rank, '        total = helper(total, len(items))' AS source,
  'Score `' || printf('%.2f', score) || '`' || chr(10) || chr(10) || 'high on hidden_calls (' || hidden || ') + naming (' || naming || ') — delegates to opaque calls; unusual identifier density. Structurally: this line sits inside `if part' || nr || ' > ' || part || '` at L' || (line - 1) || ', inside function `total_of` at L14.'
  || chr(10) || chr(10) || 'Inside `total_of` — function-level score `' || printf('%.2f', after) || '` (↑ +' || printf('%.2f', round(after - before, 4)) || ' — was `' || printf('%.2f', before) || '` before your changes)' || chr(10)
  || chr(10) || '<sub>Within: function `total_of` ⟶ `if part' || nr || ' > ' || part || '`</sub>' || chr(10)
  || chr(10) || '<sub>Axes: `hidden_calls` ' || hidden || ', `naming` ' || naming || ', ' || CASE WHEN tangled > complexity THEN '`tangled_state` ' || printf('%.2f', tangled) ELSE '`complexity` ' || printf('%.2f', complexity) END || '</sub>' AS body
FROM ax WHERE rank <= 2"""
SQL["pr_reports"] = f"""WITH {_REVIEW},
p AS (SELECT DISTINCT l_orderkey AS pr_id FROM lineitem),
g AS (
  SELECT pr_id, any_value(total) AS total, count(*) FILTER (rank <= 2) AS shown, any_value(before) AS before, any_value(after) AS after,
    string_agg('| `src/orders.py` | ' || line || ' | ' || printf('%.2f', score) || ' | high on hidden_calls (' || hidden || ') + naming (' || naming || ') |', chr(10) ORDER BY rank) FILTER (rank <= 2) AS rows FROM ax GROUP BY pr_id
)
SELECT pr_id, 1::BIGINT AS files_touched, coalesce(total, 0) AS total_before_cap, coalesce(shown, 0) AS flagged_count,
  CASE WHEN shown IS NULL THEN 'no suspicious spikes' ELSE shown || ' high-intensity spike(s) inside the diff' END AS verdict,
  CASE WHEN shown IS NULL THEN 'Nothing to comment on in 1 Python file(s): no added line reaches the review threshold.' ELSE
    '**Lines to look at: ' || shown || '** (Python files in this change: 1)' || chr(10) || chr(10) || '| where | line | score | why |' || chr(10) || '| --- | ---: | ---: | --- |' || chr(10) || rows
    || CASE WHEN round(after - before, 4) >= 0.01 THEN chr(10) || chr(10) || '**Functions with a higher score than before:**' || chr(10) || chr(10) || '| function | file | was | is | change |' || chr(10) || '| --- | --- | ---: | ---: | ---: |' || chr(10)
      || '| `total_of` | `src/orders.py` | ' || printf('%.2f | %.2f | +%.2f |', before, after, round(after - before, 4)) ELSE '' END END AS summary_comment
FROM p LEFT JOIN g USING (pr_id)"""

SQL["read_corpus"] = """WITH d AS (SELECT *, doc_id // 100 AS bucket, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS k FROM documents)
SELECT bucket, k::INT AS pos, CASE WHEN doc_id % 3 <> 0 THEN source || '/' || doc_id ELSE 'corpus_' || k || '.py' END AS path, source AS repo, n_chars AS chars, length(coalesce(text, ''))::INT AS n_code, md5(coalesce(text, '')) AS code_md5 FROM d"""
SQL["read_json_lines"] = "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 10 > 1"
SQL["read_pairs"] = """WITH p AS (SELECT conv_id, max(text) FILTER (turn = 0) AS a, max(text) FILTER (turn = 1) AS b FROM conversations GROUP BY conv_id),
u AS (SELECT * FROM p WHERE trim(a) <> trim(b))
SELECT conv_id, 1 AS label, md5(a) AS code_md5 FROM u UNION ALL SELECT conv_id, 0, md5(b) FROM u"""
SQL["reports_as_json"] = SQL["file_summaries"]
SQL["repaired_code"] = """WITH c AS (
  SELECT l_orderkey, chr(10) || string_agg('    if part' || l_linenumber || ' > ' || l_partkey || ':' || chr(10) || '        total = helper(total, len(items))', chr(10) ORDER BY l_linenumber, l_partkey || ':') || chr(10) || '    return total' || chr(10) AS body FROM lineitem GROUP BY l_orderkey
), t AS (
  SELECT l_orderkey, CASE WHEN l_orderkey % 9 <> 0 THEN replace('\"\"\"Orders.\"\"\"|import os||RATE = 2|||def helper(a, b):|    try:|        return a + b * RATE|    except ValueError:|        raise|||def total_of(items):|    total = 0', '|', chr(10)) || body END AS code FROM c
)
SELECT l_orderkey AS file_id, md5(code) AS code_md5, length(code)::INT AS chars FROM t"""
SQL["listed_files"] = """WITH p AS (
  SELECT doc_id, ['src/a', 'venv/b', 'x/node_modules/y', 'envs', 'build', 'b/.git/c', 'lib'][(doc_id % 7 + 1)::INT] || '/' || ['m', 'm_pb2', 'conftest', 'setup.x', 'm'][(doc_id % 5 + 1)::INT] || CASE WHEN doc_id % 11 = 0 THEN '.txt' ELSE '.py' END AS path FROM documents
) SELECT doc_id, path FROM p WHERE doc_id % 7 IN (0, 3, 6) AND doc_id % 5 IN (0, 3, 4) AND doc_id % 11 <> 0"""
SQL["marked_texts"] = f"""WITH {MARKED}, z AS (
  SELECT m.file_id, m.line, span_id, m.line - start AS within, l1.ls[start:"end"] AS own FROM m JOIN sp ON m.file_id = sp.file_id AND m.line BETWEEN start AND "end" JOIN l1 ON l1.file_id = m.file_id QUALIFY row_number() OVER (PARTITION BY m.file_id, m.line ORDER BY "end" - start, span_id) = 1
), y AS (SELECT *, length(own[1]) - length(regexp_replace(own[1], '^[ \\t]+', '')) AS ind FROM z),
x AS (SELECT *, array_to_string(list_transform(own, lambda t: CASE WHEN length(t) >= ind THEN substr(t, ind + 1) ELSE t END), chr(10)) || chr(10) AS code FROM y)
SELECT file_id, line, span_id, within, length(code)::INT AS chars, md5(code) AS code_md5 FROM x"""
SQL["combined_sets"] = """WITH r AS (SELECT * FROM labels JOIN documents USING (doc_id))
SELECT 'quality' AS "set", doc_id::VARCHAR AS sample_id, (1 - quality)::INT AS label, md5(text) AS code_md5, lang, NULL AS source, 1 AS n_meta FROM r
UNION ALL SELECT 'toxic', doc_id::VARCHAR, toxic::INT, md5(text), lang, source, 2 FROM r
UNION ALL SELECT 'bare', doc_id::VARCHAR, 0, md5(text), NULL, NULL, 0 FROM r"""
SQL["check_counts"] = f'WITH {MARKED} SELECT marker AS "check", count(DISTINCT (m.file_id, span_id)) AS n FROM m JOIN sp ON m.file_id = sp.file_id AND span_id > 0 AND m.line BETWEEN start AND "end" GROUP BY marker'
SQL["kept_files"] = f"""WITH {MARKED}, d AS (SELECT source AS repo, doc_id AS file_id, doc_id % 5 <> 0 AND n_chars BETWEEN 500 AND 300000 AS kept FROM documents),
fn AS (SELECT file_id, count(*) FILTER (span_id > 0) AS k FROM sp GROUP BY file_id)
SELECT repo, grouping(repo)::INT AS is_total, count(*) AS candidates, count(*) FILTER (kept) AS kept, coalesce(sum(k) FILTER (kept), 0)::BIGINT AS functions FROM d LEFT JOIN fn USING (file_id) GROUP BY ROLLUP (repo)"""
SQL["answered_submissions"] = f"""WITH {_CODE}
SELECT l_orderkey AS file_id,
  CASE WHEN l_orderkey % 4 = 2 THEN 'unsupported language' WHEN bad THEN '1 high-intensity spike detected — dominant axis: malformed' ELSE 'no suspicious spikes detected' END AS verdict,
  CASE WHEN l_orderkey % 4 <> 2 THEN CASE WHEN bad THEN 11 + 2 * n ELSE 9 + 2 * n END END::INT AS n_lines,
  CASE WHEN l_orderkey % 4 <> 2 AND bad THEN 'high on malformed (1.00) + naming (' || printf('%.2f', round((1 / 6::DOUBLE + log2(3) / 5) / 2 / 0.68::DOUBLE, 4)) || ') — doesn''t parse as valid Python — likely a typo; unusual identifier density' END AS reason
FROM o"""
SQL["stored_percentiles"] = """WITH e AS (SELECT event_id, round(value / 100, 2) AS score, floor(value / 10)::BIGINT / 10::DOUBLE AS tenth FROM events WHERE value IS NOT NULL),
steps AS (SELECT tenth, sum(count(*)) OVER (ORDER BY tenth) AS n_le FROM e GROUP BY tenth)
SELECT event_id, round(coalesce(n_le, 0) / (SELECT count(*) FROM e)::DOUBLE, 9) AS percentile FROM e ASOF LEFT JOIN steps ON e.score >= steps.tenth"""
SQL["streamed_sequences"] = SQL["event_sequences"]
SQL["appended_drift"] = """WITH w AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY])::TIMESTAMP AS start, event_type, value FROM events)
SELECT start, event_type, count(*) AS n, round(avg((value >= 50)::INT), 6) AS flag_rate, round(avg(value), 6) AS mean_score FROM w GROUP BY ALL"""
_SQUASH = "(greatest(1 / (1 + exp(-4 * ({m} - 1))) - {r}, 0) / (1 - {r} + 1e-6::DOUBLE))"
_OVER = "(greatest(({m} > 1)::INT - {r}, 0) / (1 - {r}))"
_RATED = (("a", "0.25::DOUBLE"), ("b", "0.125::DOUBLE"), ("c", "0.375::DOUBLE"))
_EXCESS = {kind: [shape.format(m=m, r=r) for m, r in _RATED] for kind, shape in (("membrane", _SQUASH), ("spike", _OVER))}
SQL["event_excess"] = f"""{_CELLS}
SELECT event_id, round(least(1, 0.25::DOUBLE * ({_EXCESS["membrane"][0]} + {_EXCESS["membrane"][1]}) + 0.5::DOUBLE * {_EXCESS["membrane"][2]}), 6)::DOUBLE AS membrane,
  round(least(1, 0.3::DOUBLE * ({_EXCESS["spike"][0]} + {_EXCESS["spike"][1]}) + 0.4::DOUBLE * {_EXCESS["spike"][2]}), 6)::DOUBLE AS spike FROM r"""
# 25 steps; bits 1 and 2 of a step come from the first 32-bit words of one md5
SQL["isolated_events"] = """WITH RECURSIVE e AS (
  SELECT event_id, least(greatest(value / 100, 0), 1) AS x, (event_type = 'error')::INT::DOUBLE AS y FROM events
), d AS (
  SELECT event_id, t, (('0x' || substr(h, 1, 8))::BIGINT / 4294967296::DOUBLE < x)::INT AS u, (('0x' || substr(h, 9, 8))::BIGINT / 4294967296::DOUBLE < y)::INT AS v
  FROM (SELECT *, md5('7:' || event_id || ':' || t || ':0') AS h FROM e, (SELECT unnest(range(25)) AS t))
), r AS (
  SELECT event_id, -1::BIGINT AS t, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c, 0::DOUBLE AS total FROM e
  UNION ALL
  SELECT event_id, t, a, b, c, total + (0.5::DOUBLE + t / 48::DOUBLE) * (0.35::DOUBLE * ((a > 1)::INT + (b > 1)::INT) + 0.3::DOUBLE * (c > 1)::INT) FROM (
    SELECT event_id, t, total, a, b, 0.9::DOUBLE * pc + 0.7::DOUBLE * (a > 1)::INT + 0.6::DOUBLE * (b > 1)::INT - (pc > 1)::INT AS c FROM (
      SELECT d.event_id, d.t, r.total, r.c AS pc, 0.9::DOUBLE * r.a + (0.9::DOUBLE * u + 0.3::DOUBLE * v) - (r.a > 1)::INT AS a, 0.9::DOUBLE * r.b + (0.2::DOUBLE * u + 0.8::DOUBLE * v) - (r.b > 1)::INT AS b
      FROM r JOIN d ON d.event_id = r.event_id AND d.t = r.t + 1))
)
SELECT event_id, round(least(1, total / 18.75::DOUBLE), 6)::DOUBLE AS score FROM r WHERE t = 24"""
SQL["whitened_covariance"] = " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {float(a == b)}::DOUBLE AS covariance" for i, a in enumerate(_LEXICAL) if i for b in _LEXICAL[i:])


def _fitted(passes: int) -> str:
    """One recursion along all users' events for each pass, with traces; each pass reads the weights of the one before."""
    w = ("w00", "w01", "w10", "w11", "v0", "v1")
    fade, parts = "exp(-1 / 20::DOUBLE)", []
    start = dict(zip(w, (0.9, 0.3, 0.2, 0.8, 0.7, 0.6)))
    parts.append("""e AS (
  SELECT user_id, least(greatest(value / 100, 0), 1) AS x, (event_type = 'error')::INT::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), n AS (SELECT count(DISTINCT user_id) + max((user_id IS NULL)::INT) AS n FROM events)""")
    parts.append("g0 AS (SELECT " + ", ".join(f"{v}::DOUBLE AS {name}" for name, v in start.items()) + ")")
    # potentiation: a spike times the trace before it; depression: a trace after times the input
    sums = {"w00": ("sa * px", "qa * x"), "w01": ("sa * py", "qa * y"), "w10": ("sb * px", "qb * x"), "w11": ("sb * py", "qb * y"), "v0": ("sc * qa", "qc * sa"), "v1": ("sc * qb", "qc * sb")}
    for p in range(passes):
        parts.append(f"""r{p} AS (
  SELECT user_id, 0::BIGINT AS k, 0::DOUBLE AS x, 0::DOUBLE AS y, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c, 0 AS sa, 0 AS sb, 0 AS sc, 0::DOUBLE AS px, 0::DOUBLE AS py, 0::DOUBLE AS qa, 0::DOUBLE AS qb, 0::DOUBLE AS qc FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, k, x, y, a, b, c, sa, sb, (c > 1)::INT, px * {fade} + x, py * {fade} + y, qa * {fade} + sa, qb * {fade} + sb, qc * {fade} + (c > 1)::INT FROM (
    SELECT user_id, k, x, y, a, b, 0.9::DOUBLE * pc + (v0 * (a > 1)::INT + v1 * (b > 1)::INT) - (pc > 1)::INT AS c, (a > 1)::INT AS sa, (b > 1)::INT AS sb, px, py, qa, qb, qc FROM (
      SELECT e.user_id, e.k, e.x, e.y, 0.9::DOUBLE * r.a + (w00 * e.x + w01 * e.y) - (r.a > 1)::INT AS a, 0.9::DOUBLE * r.b + (w10 * e.x + w11 * e.y) - (r.b > 1)::INT AS b, r.c AS pc, v0, v1, px, py, qa, qb, qc
      FROM r{p} r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.k = r.k + 1, g{p}))
), g{p + 1} AS (
  SELECT """ + ", ".join(f"least(greatest(any_value({name}) * 0.999::DOUBLE + (0.005::DOUBLE * sum({pot}) - 0.02::DOUBLE * sum({dep}) * any_value({name})) / any_value(n), 0), 1) AS {name}" for name, (pot, dep) in sums.items()) + f" FROM r{p}, g{p}, n WHERE k > 0)")
    cells = ((0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1))
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT {layer} AS layer, {i} AS i, {j} AS j, round({name}, 6) AS weight FROM g{passes}" for (layer, i, j), name in zip(cells, w))


SQL["fitted_weights"] = _fitted(6)
# The class file's features by the number n of its items: lines 1, 2, 4-6, 8, 9, 11, 12, two for each item and eight more
SQL["class_line_features"] = f"""WITH {_CODE}
SELECT l_orderkey AS file_id, (17 + 2 * n)::BIGINT AS n_lines, round(11.6::DOUBLE * n + 39.7::DOUBLE, 6) AS nesting_depth, (20 * n + 97)::DOUBLE AS length, (n + 1)::DOUBLE AS cyclomatic_proxy,
  (2 * n * n + 12 * n + 30)::DOUBLE AS use_def_distance, (7 * n + 52)::DOUBLE AS name_flow, (2 * n + 3)::DOUBLE AS call_graph_shape, 0::DOUBLE AS exception_density, (2 * n + 18)::DOUBLE AS global_reach,
  (n * n + 10 * n + 7)::DOUBLE AS attr_reach, (4 * n + 18)::DOUBLE AS call_graph_depth FROM o"""
SQL["class_function_features"] = f"""WITH {_CODE}, f AS (
  SELECT l_orderkey AS file_id, n, unnest([
    {{'name': 'fill', 'line': 4, 'end_line': 13 + 2 * n, 'nesting': 3, 'length': 47 + 23 * n, 'cyc': 2 + n, 'far': (3 * n * n + 21 * n + 34) / (3 * n + 8)::DOUBLE, 'flow': 11, 'calls': 1 + 2 * n}},
    {{'name': 'log', 'line': 15 + 2 * n, 'end_line': 16 + 2 * n, 'nesting': 1, 'length': 10, 'cyc': 1, 'far': 1::DOUBLE, 'flow': 4, 'calls': 2}},
    {{'name': 'size_of', 'line': 20 + 2 * n, 'end_line': 20 + 2 * n, 'nesting': 1, 'length': 8, 'cyc': 1, 'far': 0::DOUBLE, 'flow': 3, 'calls': 0}},
    {{'name': 'scaled', 'line': 23 + 2 * n, 'end_line': 24 + 2 * n, 'nesting': 1, 'length': 10, 'cyc': 1, 'far': 1::DOUBLE, 'flow': 3, 'calls': 0}}]) AS x FROM o)
SELECT file_id, x.name AS name, x.line::INT AS line, x.end_line::INT AS end_line, x.nesting::DOUBLE AS nesting_depth, x.length::DOUBLE AS length, x.cyc::DOUBLE AS cyclomatic_proxy, round(x.far, 6) AS use_def_distance,
  x.flow::DOUBLE AS name_flow, x.calls::DOUBLE AS call_graph_shape, 0::DOUBLE AS exception_density FROM f"""
# of fill's lines the ones below an if have the if, the loop and fill around them; outside functions stand class Basket and
# its attribute, class Empty and the constant
SQL["class_lineage"] = f"""WITH {_CODE}
SELECT l_orderkey AS file_id, x.f AS function, x.n::BIGINT AS n_lines, x.i::BIGINT AS n_inside, x.d::INT AS deepest FROM (
  SELECT l_orderkey, unnest([{{'f': 'fill', 'n': 8 + 2 * n, 'i': 8 + 2 * n, 'd': 3}}, {{'f': 'log', 'n': 2, 'i': 2, 'd': 2}}, {{'f': 'size_of', 'n': 1, 'i': 1, 'd': 2}}, {{'f': 'scaled', 'n': 2, 'i': 2, 'd': 1}}, {{'f': NULL, 'n': 4, 'i': 3, 'd': 1}}]) AS x FROM o)"""
SQL["failed_files"] = "SELECT true AS known, count(*) AS n, min(l_orderkey || '.py') AS first FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 997 = 0) HAVING count(*) > 0"
SQL["written_sets"] = SQL["combined_sets"]
SQL["first_checks"] = f"SELECT * FROM ({SQL['span_checks']}) ORDER BY file_id, rank LIMIT 10"
SQL["event_diagnostics"] = f"""{_CELLS}
SELECT 0.9::DOUBLE AS threshold, 2 AS inputs, 2 AS hidden, 1 AS outputs, (SELECT count(DISTINCT round(x, 4)) FROM (SELECT avg((a > 1)::INT) AS x FROM r UNION ALL SELECT avg((b > 1)::INT) FROM r))::INT AS distinct_hidden_rates, count(*) AS reference_size FROM r"""
