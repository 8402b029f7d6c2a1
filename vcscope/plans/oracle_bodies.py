"""Oracle SQL bodies (DuckDB dialect), one per catalogue query."""

from .oracle import BODIES, RANGE_SQL, sql

# ---------------------------------------------------------------- reports R1–R5
_REPORTS = {
    "report_churn": """
SELECT author, COUNT(commit_hash) AS num_commits, CAST(SUM(total_deletions) AS BIGINT) AS total_deletions,
       CAST(SUM(total_additions) AS BIGINT) AS total_additions
FROM {commits} GROUP BY author""",
    "report_releases": """
SELECT COUNT(*) AS no_of_releases FROM tags t
WHERE tag_name IS NOT NULL AND EXISTS (
  FROM {commits} WHERE (commit_hash, repo_name) = (t.tag_commit, t.repo_name))""",
    # The gaps between n merges add up to last - first.
    "report_merge_time": """
SELECT repo_name, round((epoch_us(MAX(date)) - epoch_us(MIN(date))) / 86400000000.0 / (COUNT(date) - 1), 9)
         AS avg_time_in_days_between_merges
FROM {commits} WHERE is_merge = 1 GROUP BY repo_name HAVING COUNT(date) > 1""",
    "report_commit_velocity": """
SELECT strftime(date, '%Y-%m-%d') AS day, repo_name, COUNT(commit_hash) AS commits_per_day
FROM {commits} GROUP BY ALL ORDER BY repo_name, day""",
    "report_test_changes": """
SELECT repo_name, total_changes, test_file_changes,
  ROUND(test_file_changes * 100.0::DOUBLE / NULLIF(total_changes, 0), 2) AS test_file_change_percentage
FROM (SELECT repo_name, CAST(SUM(total_additions + total_deletions) AS BIGINT) AS total_changes,
        CAST(SUM(total_additions_test + total_deletions_test) AS BIGINT) AS test_file_changes
      FROM {commits} GROUP BY repo_name) per_repo
ORDER BY test_file_change_percentage DESC, repo_name""",
}
for _n, _b in _REPORTS.items():
    sql(_n, _b.replace("{commits}", "commits"))
    sql(f"{_n}_ranged", _b.replace("{commits}", f"(FROM commits WHERE {RANGE_SQL})"))

# ---------------------------------------------------------------- commits S1, M01–M09
ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"
DAYS = "((epoch_us({a}) - epoch_us({b})) / 86400000000.0)"
MODULE = "CASE WHEN instr({p}, '/') = 0 THEN '(root)' ELSE split_part({p}, '/', 1) END"
BUG_RE = "bug|fix|issue|patch|error|defect|fixes|issues|defects|errors|bugfixes"
BUG = "COALESCE(regexp_matches(lower({m}), '" + BUG_RE + "'), false)"


def iso(c):
    return ISO.format(c=c)


def days(a, b):
    return DAYS.format(a=a, b=b)


def module(p="file_path"):
    return MODULE.format(p=p)


def bug(m="message"):
    return BUG.format(m=m)


sql("time_between_commits", f"""
SELECT commit_hash, {iso('date')} AS date, round({days('date', 'prev_date')}, 9) AS time_since_last_commit
FROM (SELECT commit_hash, date, LAG(date) OVER (ORDER BY date, commit_hash) AS prev_date FROM commits) x
WHERE prev_date IS NOT NULL""")
sql("total_commits", "SELECT COUNT(*) AS total_commits FROM commits")
sql("commit_frequency_daily", "SELECT strftime(date, '%Y-%m-%d') AS period, COUNT(*) AS commits FROM commits GROUP BY 1")
sql("commit_frequency_weekly",
    "SELECT strftime(date_trunc('week', date), '%Y-%m-%d') AS period, COUNT(*) AS commits FROM commits GROUP BY 1")
sql("commit_frequency_monthly", "SELECT strftime(date, '%Y-%m') AS period, COUNT(*) AS commits FROM commits GROUP BY 1")
sql("avg_time_between_commits", f"""
SELECT round(AVG({days('date', 'prev')}), 9) AS avg_days_between_commits
FROM (SELECT date, LAG(date) OVER (ORDER BY date, commit_hash) AS prev FROM commits) x""")
sql("commits_per_author", "SELECT author, COUNT(*) AS commits FROM commits GROUP BY author")
sql("commits_per_file",
    "SELECT file_path, COUNT(DISTINCT (repo_name, commit_hash)) AS commits FROM file_changes GROUP BY file_path")
sql("commits_per_module", f"""
SELECT {module()} AS module, COUNT(DISTINCT (repo_name, commit_hash)) AS commits FROM file_changes GROUP BY 1""")
sql("commit_size_distribution", """
SELECT COUNT(*) AS commits, MIN(l) AS min_lines,
  round(quantile_cont(l, 0.25), 6) AS p25_lines, round(quantile_cont(l, 0.5), 6) AS p50_lines,
  round(quantile_cont(l, 0.75), 6) AS p75_lines, round(quantile_cont(l, 0.95), 6) AS p95_lines,
  MAX(l) AS max_lines, round(AVG(l), 6) AS mean_lines
FROM (SELECT total_additions + total_deletions AS l FROM commits) x""")
sql("commit_size_buckets", """
SELECT CASE WHEN l <= 0 THEN '0' WHEN l <= 10 THEN '1-10' WHEN l <= 100 THEN '11-100' WHEN l <= 1000 THEN '101-1000'
            ELSE '>1000' END AS size_bucket, COUNT(*) AS commits
FROM (SELECT total_additions + total_deletions AS l FROM commits) x GROUP BY 1""")
sql("large_commits", f"""
WITH c AS (SELECT *, total_additions + total_deletions AS churn FROM commits),
s AS (SELECT AVG(churn) + 2 * stddev_pop(churn) AS bound FROM c)
SELECT commit_hash, repo_name, author, {iso('date')} AS date, churn FROM c, s WHERE churn > bound
ORDER BY churn DESC, commit_hash LIMIT 20""")
sql("avg_commit_size", """
SELECT round((SELECT COUNT(DISTINCT (repo_name, commit_hash, file_path)) FROM file_changes) / COUNT(*), 6)
         AS avg_files_per_commit,
       round(AVG(total_additions + total_deletions), 6) AS avg_lines_per_commit
FROM commits""")

# ---------------------------------------------------------------- authors M10–M16, S6
LOCAL = "(date + INTERVAL 1 MINUTE * (CASE WHEN timezone = 'Z' THEN 0 ELSE " \
        "(CASE WHEN substr(timezone, 1, 1) = '-' THEN -1 ELSE 1 END) * " \
        "(CAST(substr(timezone, 2, 2) AS INTEGER) * 60 + CAST(substr(timezone, 5, 2) AS INTEGER)) END))"
sql("total_contributors", "SELECT COUNT(DISTINCT author) AS total_contributors FROM commits")
_AT = ("SELECT author, COUNT(*) AS commits, CAST(SUM(total_additions + total_deletions) AS BIGINT) AS lines_changed "
       "FROM commits GROUP BY author")
sql("top_contributors_by_commits", f"SELECT * FROM ({_AT}) x ORDER BY commits DESC, author LIMIT 20")
sql("top_contributors_by_lines", f"SELECT * FROM ({_AT}) x ORDER BY lines_changed DESC, author LIMIT 20")
_OWN = """SELECT unit, author, lines, SUM(lines) OVER (PARTITION BY unit) AS unit_lines,
  round(lines / NULLIF(SUM(lines) OVER (PARTITION BY unit), 0), 6) AS share,
  ROW_NUMBER() OVER (PARTITION BY unit ORDER BY lines DESC, author) AS owner_rank
FROM (SELECT {unit} AS unit, author, CAST(SUM(additions + deletions) AS BIGINT) AS lines FROM file_changes GROUP BY 1, 2) x"""
OWN_FILE = _OWN.format(unit="file_path")
OWN_MODULE = _OWN.format(unit=module())
sql("code_ownership_files", f"""
SELECT unit AS file_path, author AS owner, lines, CAST(unit_lines AS BIGINT) AS file_lines, share AS owner_share
FROM ({OWN_FILE}) o WHERE owner_rank = 1""")
sql("code_ownership_modules", f"SELECT unit AS module, author, lines, share, owner_rank FROM ({OWN_MODULE}) o")
sql("developer_churn", """
WITH span AS (SELECT author, MIN(date) AS f, MAX(date) AS l FROM commits GROUP BY author),
j AS (SELECT strftime(f, '%Y-%m') AS month, COUNT(*) AS authors_joined FROM span GROUP BY 1),
lf AS (SELECT strftime(l, '%Y-%m') AS month, COUNT(*) AS authors_left FROM span GROUP BY 1)
SELECT COALESCE(j.month, lf.month) AS month, COALESCE(authors_joined, 0) AS authors_joined,
       COALESCE(authors_left, 0) AS authors_left
FROM j FULL OUTER JOIN lf ON j.month = lf.month""")
sql("activity_patterns", f"""
SELECT clock, weekday, hour, COUNT(*) AS commits FROM (
  SELECT 'utc' AS clock, CAST(dayofweek(date) AS INTEGER) AS weekday, CAST(hour(date) AS INTEGER) AS hour FROM commits
  UNION ALL
  SELECT 'local', CAST(dayofweek({LOCAL}) AS INTEGER), CAST(hour({LOCAL}) AS INTEGER) FROM commits) x
GROUP BY 1, 2, 3""")
sql("after_hours_share", f"""
SELECT author, COUNT(*) AS commits,
  COUNT(*) FILTER (WHERE hour({LOCAL}) < 9 OR hour({LOCAL}) >= 18 OR dayofweek({LOCAL}) IN (0, 6)) AS after_hours_commits,
  round(COUNT(*) FILTER (WHERE hour({LOCAL}) < 9 OR hour({LOCAL}) >= 18 OR dayofweek({LOCAL}) IN (0, 6))
        / COUNT(*), 6) AS after_hours_share
FROM commits GROUP BY author""")
sql("changes_per_commit_by_author", """
SELECT author, total_commits, total_changes, round(total_changes / total_commits, 2) AS bus_factor
FROM (SELECT author, CAST(SUM(n) AS BIGINT) AS total_commits, CAST(SUM(lines) AS BIGINT) AS total_changes
      FROM (SELECT author, 1 AS n, NULL AS lines FROM commits
            UNION ALL SELECT author, 0, additions + deletions FROM file_changes) events
      GROUP BY author)
WHERE total_commits > 0 ORDER BY bus_factor DESC, author""")

# ---------------------------------------------------------------- changes M17–M21, M25, M26, M51, M69
sql("line_totals", """
SELECT CAST(SUM(additions) AS BIGINT) AS lines_added, CAST(SUM(deletions) AS BIGINT) AS lines_deleted,
  CAST(SUM(least(additions, deletions)) AS BIGINT) AS lines_modified, CAST(SUM(additions + deletions) AS BIGINT) AS churn
FROM file_changes""")
sql("churn_over_time", """
SELECT month, commits, lines_added, lines_deleted, lines_added + lines_deleted AS churn,
  round(lines_added / NULLIF(lines_added + lines_deleted, 0), 6) AS added_share
FROM (SELECT strftime(date, '%Y-%m') AS month, COUNT(*) AS commits, CAST(SUM(total_additions) AS BIGINT) AS lines_added,
             CAST(SUM(total_deletions) AS BIGINT) AS lines_deleted FROM commits GROUP BY 1) x""")
_FS = ("SELECT file_path, COUNT(*) AS changes, CAST(SUM(additions + deletions) AS BIGINT) AS churn, "
       "COUNT(DISTINCT author) AS authors FROM file_changes GROUP BY file_path")
sql("file_hotspots_by_changes", f"SELECT * FROM ({_FS}) x ORDER BY changes DESC, file_path LIMIT 20")
sql("file_hotspots_by_churn", f"SELECT * FROM ({_FS}) x ORDER BY churn DESC, file_path LIMIT 20")
sql("module_hotspots", f"""
SELECT * FROM (SELECT {module()} AS module, COUNT(*) AS changes, CAST(SUM(additions + deletions) AS BIGINT) AS churn,
  COUNT(DISTINCT file_path) AS files FROM file_changes GROUP BY 1) x ORDER BY churn DESC, module LIMIT 20""")
sql("refactoring_commits", f"""
SELECT commit_hash, repo_name, author, {iso('date')} AS date, total_additions, total_deletions,
  CAST(kw AS INTEGER) AS keyword_hit, CAST(st AS INTEGER) AS structural
FROM (SELECT *, COALESCE(regexp_matches(lower(message), 'refactor|cleanup|restructure|optimize'), false) AS kw,
  (total_deletions >= 2.0 * total_additions AND total_additions + total_deletions >= 100) AS st FROM commits) x
WHERE kw OR st""")
sql("modification_complexity", """
SELECT file_path, COUNT(*) AS changes, COUNT(DISTINCT author) AS authors,
  round(AVG(additions + deletions), 6) AS mean_lines, round(stddev_pop(additions + deletions), 6) AS stddev_lines
FROM file_changes GROUP BY file_path""")
REL_DATES = ("SELECT t.tag_name, t.repo_name, c.date FROM tags t JOIN commits c "
             "ON t.tag_commit = c.commit_hash AND t.repo_name = c.repo_name")
sql("churn_vs_releases", f"""
WITH ch AS (SELECT strftime(date, '%Y-%m') AS month, CAST(SUM(total_additions + total_deletions) AS BIGINT) AS churn
            FROM commits GROUP BY 1),
rel AS (SELECT strftime(date, '%Y-%m') AS month, COUNT(*) AS releases FROM ({REL_DATES}) r GROUP BY 1)
SELECT ch.month, churn, COALESCE(releases, 0) AS releases FROM ch LEFT JOIN rel ON ch.month = rel.month""")
sql("file_stability", """
SELECT file_path, COUNT(*) AS changes, CAST(COUNT(*) <= 2 AS INTEGER) AS is_stable FROM file_changes
GROUP BY file_path ORDER BY changes, file_path""")
sql("churn_excluding_types", """
SELECT author, COUNT(DISTINCT (repo_name, commit_hash)) AS commits, CAST(SUM(additions + deletions) AS BIGINT) AS churn
FROM file_changes WHERE is_dot_file = 0 AND is_build_file = 0 GROUP BY author""")

# ---------------------------------------------------------------- bugs M28–M34b
FIXC = f"""(SELECT c.*, ({bug('c.message')} OR th.commit_hash IS NOT NULL) AS is_fix FROM commits c
LEFT JOIN (SELECT DISTINCT tag_commit AS commit_hash, repo_name FROM tags WHERE {bug('tag_message')}) th
ON c.commit_hash = th.commit_hash AND c.repo_name = th.repo_name)"""
FIXCH = f"""(SELECT f.* FROM file_changes f WHERE EXISTS (SELECT 1 FROM {FIXC} x
WHERE x.is_fix AND x.commit_hash = f.commit_hash AND x.repo_name = f.repo_name))"""
sql("bug_fix_commits", f"""
SELECT COUNT(*) AS total_commits, COUNT(*) FILTER (WHERE is_fix) AS bug_fix_commits,
  round(COUNT(*) FILTER (WHERE is_fix) / COUNT(*), 6) AS bug_fix_share FROM {FIXC} x""")
sql("bug_fix_frequency", f"""
SELECT strftime(date, '%Y-%m') AS month, COUNT(*) AS commits, COUNT(*) FILTER (WHERE is_fix) AS bug_fix_commits,
  round(COUNT(*) FILTER (WHERE is_fix) / COUNT(*), 6) AS bug_fix_share FROM {FIXC} x GROUP BY 1""")
sql("bug_fix_files", f"""
SELECT file_path, COUNT(DISTINCT (repo_name, commit_hash)) AS fix_commits FROM {FIXCH} f
GROUP BY file_path ORDER BY fix_commits DESC, file_path LIMIT 20""")
sql("bug_fix_modules", f"""
SELECT {module()} AS module, COUNT(DISTINCT (repo_name, commit_hash)) AS fix_commits FROM {FIXCH} f
GROUP BY 1 ORDER BY fix_commits DESC, module LIMIT 20""")
FILE_FIXES = f"(SELECT file_path, COUNT(DISTINCT (repo_name, commit_hash)) AS fixes FROM {FIXCH} f GROUP BY file_path)"
sql("churn_bug_correlation", f"""
SELECT COUNT(*) AS files, round(corr(churn, COALESCE(fixes, 0)), 6) AS correlation
FROM (SELECT file_path, SUM(additions + deletions) AS churn FROM file_changes GROUP BY file_path) ch
LEFT JOIN {FILE_FIXES} fx ON ch.file_path = fx.file_path""")
sql("defect_risk", f"""
WITH b AS (SELECT MIN(epoch_us(date)) AS lo, MAX(epoch_us(date)) AS hi FROM commits),
fc AS (SELECT f.*, c.date FROM file_changes f JOIN commits c ON f.commit_hash = c.commit_hash AND f.repo_name = c.repo_name),
before AS (SELECT file_path, COUNT(*) AS changes_before, CAST(SUM(additions + deletions) AS BIGINT) AS churn_before,
  COUNT(DISTINCT author) AS authors_before FROM fc, b WHERE epoch_us(date) <= lo + 0.7 * (hi - lo) GROUP BY file_path),
after AS (SELECT file_path, COUNT(DISTINCT (repo_name, commit_hash)) AS fixes_after FROM fc, b
  WHERE epoch_us(date) > lo + 0.7 * (hi - lo)
  AND EXISTS (SELECT 1 FROM {FIXC} x WHERE x.is_fix AND x.commit_hash = fc.commit_hash AND x.repo_name = fc.repo_name)
  GROUP BY file_path),
r AS (SELECT *, round((percent_rank() OVER (ORDER BY changes_before) + percent_rank() OVER (ORDER BY churn_before)
  + percent_rank() OVER (ORDER BY authors_before)) / 3, 6) AS risk_score FROM before)
SELECT r.file_path, changes_before, churn_before, authors_before, risk_score, COALESCE(fixes_after, 0) AS fixes_after
FROM r LEFT JOIN after a ON r.file_path = a.file_path ORDER BY risk_score DESC, r.file_path LIMIT 20""")
sql("bug_fix_authors", f"""
SELECT author, COUNT(*) FILTER (WHERE is_fix) AS fix_commits, COUNT(*) AS commits,
  round(COUNT(*) FILTER (WHERE is_fix) / COUNT(*), 6) AS fix_share FROM {FIXC} x GROUP BY author
ORDER BY fix_commits DESC, author LIMIT 20""")
sql("ownership_vs_bugs", f"""
SELECT COUNT(*) AS files, round(corr(share, COALESCE(fixes, 0)), 6) AS correlation
FROM (SELECT unit AS file_path, share FROM ({OWN_FILE}) o WHERE owner_rank = 1) ow
LEFT JOIN {FILE_FIXES} fx ON ow.file_path = fx.file_path""")

# ---------------------------------------------------------------- releases S2–S4, M54–M59
RELW = """(SELECT *, LAG(tag_name) OVER o AS prev_tag, LAG(repo_name) OVER o AS prev_repo, LAG(rel_date) OVER o AS prev_date
  FROM (SELECT t.repo_name, t.tag_name, c.date AS rel_date
        FROM tags t JOIN commits c ON (c.commit_hash, c.repo_name) = (t.tag_commit, t.repo_name))
  WINDOW o AS (ORDER BY rel_date, repo_name, tag_name))"""
PER_REL = f"""(SELECT w.repo_name, w.tag_name, w.rel_date, COUNT(c.commit_hash) AS commits,
  CAST(COALESCE(SUM(c.total_additions + c.total_deletions), 0) AS BIGINT) AS churn,
  COUNT(*) FILTER (WHERE c.is_fix) AS bug_fix_commits
  FROM {RELW} w LEFT JOIN {FIXC} c ON (w.prev_date IS NULL OR c.date > w.prev_date) AND c.date <= w.rel_date
  GROUP BY w.repo_name, w.tag_name, w.rel_date)"""


def _release_top(name, value):
    """The ten greatest values of commits between a release and the one before it:
    each commit looks up the first release at or after its date (an as-of join)."""
    sql(name + "_top", f"""
SELECT prev_tag AS tag_name1, prev_repo AS repo_name1, r.tag_name AS tag_name2, r.repo_name AS repo_name2,
  CAST({value[1]} AS BIGINT) AS {value[0]}
FROM commits k ASOF JOIN (SELECT rel_date, MIN((repo_name, tag_name)) AS first_key FROM {RELW} w GROUP BY rel_date) d
  ON k.date <= d.rel_date
JOIN {RELW} r ON r.rel_date = d.rel_date AND (r.repo_name, r.tag_name) = d.first_key
WHERE r.prev_date IS NOT NULL GROUP BY ALL ORDER BY {value[0]} DESC, tag_name1, repo_name1 LIMIT 10""")


_release_top("release_churn", ("churn", "SUM(total_additions + total_deletions)"))
_release_top("release_churn_nodot", ("churn", "SUM(total_additions + total_deletions - total_additions_dot - total_deletions_dot)"))
_release_top("release_commit_count", ("commit_count", "COUNT(k.commit_hash)"))
sql("release_commits", f"SELECT repo_name, tag_name, {iso('rel_date')} AS release_date, commits FROM {PER_REL} p")
sql("release_churn", f"SELECT repo_name, tag_name, {iso('rel_date')} AS release_date, churn FROM {PER_REL} p")
sql("time_between_releases", f"""
SELECT repo_name, tag_name, prev_repo, prev_tag, {iso('rel_date')} AS release_date,
  round({days('rel_date', 'prev_date')}, 9) AS days_since_previous
FROM {RELW} w""")
sql("release_bug_fixes", f"""
SELECT repo_name, tag_name, commits, bug_fix_commits, round(bug_fix_commits / NULLIF(commits, 0), 6) AS bug_fix_share
FROM {PER_REL} p""")
sql("deployment_frequency", f"SELECT strftime(rel_date, '%Y-%m') AS month, COUNT(*) AS releases FROM {RELW} w GROUP BY 1")
sql("lead_time", f"""
WITH j AS (SELECT w.rel_date, c.date FROM {RELW} w JOIN commits c
  ON (w.prev_date IS NULL OR c.date > w.prev_date) AND c.date <= w.rel_date)
SELECT COUNT(*) AS released_commits, round(AVG({days('rel_date', 'date')}), 9) AS mean_lead_days,
  round(quantile_cont(epoch(rel_date) - epoch(date), 0.5) / 86400, 9) AS median_lead_days FROM j""")
SINCE = f"(SELECT * FROM {FIXC} x WHERE date > (SELECT MAX(rel_date) FROM {RELW} w))"
sql("release_readiness", f"""
SELECT COUNT(*) AS commits, CAST(COALESCE(SUM(total_additions + total_deletions), 0) AS BIGINT) AS churn,
  round(COUNT(*) FILTER (WHERE is_fix) / NULLIF(COUNT(*), 0), 6) AS bug_fix_share,
  round(COALESCE(SUM(total_additions_test + total_deletions_test), 0)
        / NULLIF(COALESCE(SUM(total_additions + total_deletions), 0), 0), 6) AS test_share
FROM {SINCE} s""")
sql("release_risky_files", f"""
SELECT f.file_path, COUNT(*) AS changes, CAST(SUM(f.additions + f.deletions) AS BIGINT) AS churn,
  COUNT(*) FILTER (WHERE s.is_fix) AS fix_changes
FROM file_changes f JOIN {SINCE} s ON f.commit_hash = s.commit_hash AND f.repo_name = s.repo_name
GROUP BY f.file_path ORDER BY churn DESC, f.file_path LIMIT 20""")

# ---------------------------------------------------------------- productivity M35–M41
MAINT_RE = BUG_RE + "|refactor|optimize|enhance|update"
MONTHLY = f"""(SELECT strftime(date, '%Y-%m') AS month, COUNT(*) AS commits, COUNT(DISTINCT author) AS active_authors,
  COUNT(*) FILTER (WHERE COALESCE(regexp_matches(lower(message), '{MAINT_RE}'), false)) AS maintenance_commits,
  CAST(SUM(total_additions + total_deletions) AS BIGINT) AS churn FROM commits GROUP BY 1)"""
sql("commits_per_author_over_time", f"""
SELECT month, commits, active_authors, round(commits / active_authors, 6) AS commits_per_author FROM {MONTHLY} m""")
sql("most_active_months", """
SELECT strftime(date, '%Y-%m') AS month, COUNT(*) AS commits FROM commits GROUP BY 1 ORDER BY commits DESC, month LIMIT 20""")
sql("most_active_weeks", """
SELECT strftime(date_trunc('week', date), '%Y-%m-%d') AS week, COUNT(*) AS commits FROM commits GROUP BY 1
ORDER BY commits DESC, week LIMIT 20""")
sql("productivity_comparison", """
SELECT author, commits, churn, CAST(rank() OVER (ORDER BY commits DESC) AS BIGINT) AS commit_rank,
  round(percent_rank() OVER (ORDER BY churn), 6) AS churn_percent_rank
FROM (SELECT author, COUNT(*) AS commits, CAST(SUM(total_additions + total_deletions) AS BIGINT) AS churn
      FROM commits GROUP BY author) x""")
sql("feature_vs_maintenance", f"""
SELECT month, commits, maintenance_commits, commits - maintenance_commits AS feature_commits,
  round(maintenance_commits / commits, 6) AS maintenance_share FROM {MONTHLY} m""")
sql("maintenance_vs_velocity", f"""
SELECT COUNT(*) AS months, round(corr(maintenance_commits / commits, commits), 6) AS correlation FROM {MONTHLY} m""")
sql("team_size_impact", f"""
SELECT COUNT(*) AS months, round(corr(active_authors, commits / active_authors), 6) AS correlation FROM {MONTHLY} m""")
sql("trend_forecast", f"""
WITH m AS (SELECT *, CAST(CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 6, 2) AS INTEGER) - 1 AS DOUBLE) AS x
           FROM {MONTHLY} mm),
r AS (SELECT 'commits' AS metric, regr_slope(commits, x) AS slope, regr_intercept(commits, x) AS intercept,
        MAX(x) + 1 AS nx FROM m
      UNION ALL SELECT 'churn', regr_slope(churn, x), regr_intercept(churn, x), MAX(x) + 1 FROM m)
SELECT metric, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
  printf('%04d-%02d', CAST(floor(nx / 12) AS INTEGER), CAST(nx AS INTEGER) % 12 + 1) AS next_month,
  round(intercept + slope * nx, 6) AS forecast FROM r""")

# ---------------------------------------------------------------- branches M42–M42e
sql("branch_counts", """
SELECT COUNT(*) AS branches_created, COUNT(merge_date) AS branches_merged,
  COUNT(*) FILTER (WHERE is_active = 1) AS branches_active FROM branches""")
sql("branch_durations", f"""
SELECT strftime(creation_date, '%Y-%m') AS month, COUNT(*) AS branches_created, COUNT(merge_date) AS branches_merged,
  round(AVG({days('merge_date', 'creation_date')}), 9) AS avg_days_to_merge FROM branches GROUP BY 1""")
sql("long_lived_branches", f"""
SELECT branch_name, repo_name, is_active, round(d, 9) AS days_open FROM (
  SELECT *, {days('COALESCE(merge_date, (SELECT MAX(date) FROM commits))', 'creation_date')} AS d FROM branches) b
WHERE d > 30""")
sql("merge_conflicts", f"""
WITH m AS (SELECT commit_hash, repo_name, date FROM commits
           WHERE is_merge = 1 AND COALESCE(regexp_matches(lower(message), 'conflict'), false)),
p AS (SELECT cp.commit_hash, cp.repo_name, MAX(c.date) AS newest_parent, COUNT(*) AS parents
      FROM commit_parents cp JOIN commits c ON cp.parent_hash = c.commit_hash AND cp.repo_name = c.repo_name
      WHERE EXISTS (SELECT 1 FROM m WHERE m.commit_hash = cp.commit_hash AND m.repo_name = cp.repo_name)
      GROUP BY cp.commit_hash, cp.repo_name)
SELECT m.commit_hash, m.repo_name, {iso('m.date')} AS date, COALESCE(p.parents, 0) AS parents,
  round({days('m.date', 'p.newest_parent')}, 9) AS resolution_days
FROM m LEFT JOIN p ON m.commit_hash = p.commit_hash AND m.repo_name = p.repo_name""")
PR = "COALESCE(regexp_matches(lower(message), 'pull request|merge request'), false)"
sql("pull_request_usage", f"""
SELECT strftime(date, '%Y-%m') AS month, COUNT(*) AS commits, COUNT(*) FILTER (WHERE {PR}) AS pr_commits,
  round(COUNT(*) FILTER (WHERE {PR}) / COUNT(*), 6) AS pr_share FROM commits GROUP BY 1""")

# ---------------------------------------------------------------- other M60–M68, E25
EXT = ("CASE WHEN instr(split_part({p}, '/', -1), '.') > 0 THEN lower(split_part(split_part({p}, '/', -1), '.', -1)) "
       "ELSE '' END")


def ext(p="file_path"):
    return EXT.format(p=p)


sql("timezone_distribution",
    "SELECT timezone, COUNT(*) AS commits, COUNT(DISTINCT author) AS authors FROM commits GROUP BY timezone")
sql("weekend_vs_weekday", """
SELECT day_type, COUNT(*) AS commits, round(COUNT(*) / (SELECT COUNT(*) FROM commits), 6) AS share FROM (
  SELECT CASE WHEN dayofweek(date) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_type FROM commits) x
GROUP BY day_type""")
sql("low_review_areas", f"""
SELECT * FROM (SELECT {module('f.file_path')} AS module, COUNT(*) AS changes, COUNT(pr.commit_hash) AS pr_changes,
  round(COUNT(pr.commit_hash) / COUNT(*), 6) AS pr_share
FROM file_changes f LEFT JOIN (SELECT commit_hash, repo_name FROM commits WHERE {PR}) pr
  ON f.commit_hash = pr.commit_hash AND f.repo_name = pr.repo_name GROUP BY 1) x
ORDER BY pr_share, module LIMIT 20""")
sql("expertise", f"""
WITH fc AS (SELECT {module()} AS module, author, repo_name, commit_hash, file_path FROM file_changes),
per AS (SELECT module, author, COUNT(DISTINCT (repo_name, commit_hash)) AS commits, COUNT(DISTINCT file_path) AS files
        FROM fc GROUP BY 1, 2),
md AS (SELECT module, COUNT(DISTINCT (repo_name, commit_hash)) AS module_commits FROM fc GROUP BY 1)
SELECT per.module, author, commits, files, round(commits / module_commits, 6) AS share,
  ROW_NUMBER() OVER (PARTITION BY per.module ORDER BY commits DESC, files DESC, author) AS rank_in_module
FROM per JOIN md ON per.module = md.module""")
SKILL = (f"CASE WHEN {ext()} IN ('java','cs','py','rb','go','rs','cpp','c') THEN 'backend' "
         f"WHEN {ext()} IN ('sql','ddl','dml','pks','pkb') THEN 'sql' "
         f"WHEN {ext()} IN ('html','css','js','jsx','ts','tsx') THEN 'frontend' END")
sql("skill_gaps", f"""
WITH fc AS (SELECT DISTINCT author, file_path, is_test_file FROM file_changes),
tagged AS (SELECT author, file_path, {SKILL} AS skill FROM fc
           UNION ALL SELECT author, file_path, 'testing' FROM fc WHERE is_test_file = 1),
per AS (SELECT author, skill, COUNT(DISTINCT file_path) AS files FROM tagged WHERE skill IS NOT NULL GROUP BY 1, 2),
au AS (SELECT author, COUNT(DISTINCT file_path) AS author_files FROM fc GROUP BY 1),
grid AS (SELECT author, author_files, s.skill FROM au, (VALUES ('backend'), ('sql'), ('frontend'), ('testing')) s(skill))
SELECT g.author, g.skill, COALESCE(p.files, 0) AS files, round(COALESCE(p.files, 0) / g.author_files, 6) AS share,
  CAST(COALESCE(COALESCE(p.files, 0) / g.author_files, 0) < 0.05 AS INTEGER) AS is_gap
FROM grid g LEFT JOIN per p ON g.author = p.author AND g.skill = p.skill""")
LANG = ("CASE " + " ".join(
    f"WHEN {ext()} = '{e}' THEN '{lang}'" for e, lang in [
        ("java", "Java"), ("py", "Python"), ("js", "JavaScript/TypeScript"), ("jsx", "JavaScript/TypeScript"),
        ("ts", "JavaScript/TypeScript"), ("tsx", "JavaScript/TypeScript"), ("cs", "C#"), ("rb", "Ruby"),
        ("go", "Golang"), ("sql", "SQL"), ("rs", "Rust"), ("swift", "Swift"), ("kt", "Kotlin"), ("kts", "Kotlin"),
        ("sh", "Shell Scripts"), ("c", "C/C++"), ("cpp", "C/C++"), ("h", "C/C++"), ("hpp", "C/C++"),
        ("html", "HTML/CSS"), ("htm", "HTML/CSS"), ("css", "HTML/CSS"), ("md", "Markdown")])
    + " ELSE 'Other' END")
sql("language_usage", f"SELECT {LANG} AS language, COUNT(DISTINCT file_path) AS files FROM file_changes GROUP BY 1")
sql("tool_presence", """
SELECT 'github_actions' AS tool, COUNT(DISTINCT file_path) AS matching_files,
  CAST(COUNT(DISTINCT file_path) > 0 AS INTEGER) AS present
FROM file_changes WHERE file_path GLOB '.github/workflows/*.yml' OR file_path GLOB '.github/workflows/*.yaml'""")
CFG = "('conf','cfg','ini','yaml','yml','json','xml','properties','toml','env')"
sql("file_class_counts", f"""
SELECT COUNT(DISTINCT file_path) AS files,
  COUNT(DISTINCT CASE WHEN is_test_file = 1 THEN file_path END) AS test_files,
  COUNT(DISTINCT CASE WHEN is_build_file = 1 THEN file_path END) AS build_files,
  COUNT(DISTINCT CASE WHEN is_dot_file = 1 THEN file_path END) AS dot_files,
  COUNT(DISTINCT CASE WHEN is_documentation_file = 1 THEN file_path END) AS documentation_files,
  COUNT(DISTINCT CASE WHEN {ext()} IN {CFG} THEN file_path END) AS config_files
FROM file_changes""")
sql("keyword_search", """
SELECT commit_hash, repo_name FROM commits WHERE COALESCE(regexp_matches(lower(message), 'conflict|readme'), false)
UNION
SELECT commit_hash, repo_name FROM file_changes WHERE COALESCE(regexp_matches(lower(file_path), 'conflict|readme'), false)""")
sql("data_quality_keys", """
SELECT 'commits' AS table_name, COUNT(*) AS row_count, COUNT(DISTINCT (repo_name, commit_hash)) AS distinct_keys,
  COUNT(*) - COUNT(DISTINCT (repo_name, commit_hash)) AS duplicate_rows FROM commits
UNION ALL SELECT 'file_changes', COUNT(*), COUNT(DISTINCT (repo_name, commit_hash, file_path, change_type)),
  COUNT(*) - COUNT(DISTINCT (repo_name, commit_hash, file_path, change_type)) FROM file_changes
UNION ALL SELECT 'commit_parents', COUNT(*), COUNT(DISTINCT (repo_name, commit_hash, parent_hash)),
  COUNT(*) - COUNT(DISTINCT (repo_name, commit_hash, parent_hash)) FROM commit_parents
UNION ALL SELECT 'branches', COUNT(*), COUNT(DISTINCT (repo_name, branch_name)),
  COUNT(*) - COUNT(DISTINCT (repo_name, branch_name)) FROM branches
UNION ALL SELECT 'tags', COUNT(*), COUNT(DISTINCT (repo_name, tag_name)),
  COUNT(*) - COUNT(DISTINCT (repo_name, tag_name)) FROM tags""")

# ---------------------------------------------------------------- onboarding S5, M52, M53
RANKED = "(SELECT *, ROW_NUMBER() OVER (PARTITION BY author ORDER BY date, commit_hash) AS rn FROM commits)"
sql("developer_ramp_up", f"""
SELECT author, CASE WHEN total_commits >= 10 THEN round({days('in_order[10]', 'in_order[1]')}, 2) END AS ramp_up_period_days,
  CASE WHEN total_commits >= 10 THEN 'ramped up' ELSE 'still rampingup' END AS status, total_commits
FROM (SELECT author, COUNT(commit_hash) AS total_commits, list(date ORDER BY date, commit_hash) AS in_order
      FROM commits GROUP BY author) per_author
ORDER BY ramp_up_period_days NULLS LAST, author""")
sql("newcomer_first_commits", f"""
WITH fk AS (SELECT * FROM {RANKED} r WHERE rn <= 5),
files AS (SELECT commit_hash, repo_name, COUNT(DISTINCT file_path) AS files FROM file_changes GROUP BY 1, 2)
SELECT author, COUNT(*) AS commits, round(AVG(total_additions + total_deletions), 6) AS avg_lines,
  round(AVG(COALESCE(files, 0)), 6) AS avg_files,
  round(SUM(total_additions_test + total_deletions_test) / NULLIF(SUM(total_additions + total_deletions), 0), 6)
    AS test_share
FROM fk LEFT JOIN files f ON fk.commit_hash = f.commit_hash AND fk.repo_name = f.repo_name GROUP BY author""")
sql("newcomer_hard_areas", f"""
WITH nc AS (SELECT f.file_path, f.commit_hash AS c1, r.date AS t1,
              ROW_NUMBER() OVER () AS id
            FROM file_changes f JOIN {RANKED} r ON f.commit_hash = r.commit_hash AND f.repo_name = r.repo_name
            WHERE r.rn <= 10),
fx AS (SELECT DISTINCT f.file_path, f.commit_hash AS c2, x.date AS t2 FROM file_changes f JOIN {FIXC} x
       ON f.commit_hash = x.commit_hash AND f.repo_name = x.repo_name WHERE x.is_fix),
flag AS (SELECT nc.*, EXISTS (SELECT 1 FROM fx WHERE fx.file_path = nc.file_path AND fx.c2 <> nc.c1
           AND fx.t2 > nc.t1 AND epoch(fx.t2) - epoch(nc.t1) <= 30 * 86400) AS refixed FROM nc)
SELECT {module()} AS module, COUNT(*) AS newcomer_changes, COUNT(*) FILTER (WHERE refixed) AS refixed_changes,
  round(COUNT(*) FILTER (WHERE refixed) / COUNT(*), 6) AS refix_share FROM flag GROUP BY 1""")

# ---------------------------------------------------------------- debt M48–M50
sql("low_ownership_hotspots", f"""
WITH st AS (SELECT file_path, COUNT(*) AS changes, COUNT(DISTINCT author) AS authors FROM file_changes GROUP BY 1),
ow AS (SELECT unit AS file_path, author AS owner, share AS owner_share FROM ({OWN_FILE}) o WHERE owner_rank = 1)
SELECT st.file_path, changes, authors, owner, owner_share FROM st JOIN ow ON st.file_path = ow.file_path
WHERE changes >= 10 AND owner_share < 0.5 ORDER BY changes DESC, st.file_path LIMIT 20""")
EVENTS = f"""(SELECT f.file_path, f.commit_hash, f.repo_name, f.lines, x.date, x.is_fix, x.message
  FROM (SELECT file_path, commit_hash, repo_name, SUM(additions + deletions) AS lines FROM file_changes GROUP BY 1, 2, 3) f
  JOIN {FIXC} x ON f.commit_hash = x.commit_hash AND f.repo_name = x.repo_name)"""
sql("quick_fix_areas", f"""
WITH ev AS (SELECT *, LAG(date) OVER (PARTITION BY file_path ORDER BY date, commit_hash) AS prev FROM {EVENTS} e)
SELECT file_path, COUNT(*) AS quick_fixes FROM ev
WHERE is_fix AND prev IS NOT NULL AND epoch(date) - epoch(prev) <= 7 * 86400
GROUP BY file_path ORDER BY quick_fixes DESC, file_path LIMIT 20""")
sql("refactoring_impact", f"""
WITH ev AS {EVENTS},
ref AS (SELECT file_path, commit_hash AS ref_commit, date AS ref_date FROM ev
        WHERE COALESCE(regexp_matches(lower(message), 'refactor|cleanup|restructure|optimize'), false))
SELECT ref.file_path, ref.ref_commit AS commit_hash,
  CAST(COALESCE(SUM(CASE WHEN o.date < ref.ref_date THEN o.lines ELSE 0 END), 0) AS BIGINT) AS churn_before,
  CAST(COALESCE(SUM(CASE WHEN o.date > ref.ref_date THEN o.lines ELSE 0 END), 0) AS BIGINT) AS churn_after,
  CAST(COUNT(*) FILTER (WHERE o.date < ref.ref_date AND o.is_fix) AS BIGINT) AS fixes_before,
  CAST(COUNT(*) FILTER (WHERE o.date > ref.ref_date AND o.is_fix) AS BIGINT) AS fixes_after
FROM ref LEFT JOIN ev o ON o.file_path = ref.file_path AND o.commit_hash <> ref.ref_commit
  AND abs(epoch(o.date) - epoch(ref.ref_date)) <= 30 * 86400
GROUP BY ref.file_path, ref.ref_commit""")

# ---------------------------------------------------------------- collaboration M12, M22–M24, M27, M43–M47
FA = "(SELECT DISTINCT file_path, author FROM file_changes)"
NETWORK = f"""(SELECT a.author AS author_a, b.author AS author_b, COUNT(*) AS shared_files
  FROM {FA} a JOIN {FA} b ON a.file_path = b.file_path AND a.author < b.author GROUP BY 1, 2)"""
sql("collaboration_network", f"SELECT * FROM {NETWORK} n")
sql("network_degree", f"""
SELECT author, COUNT(*) AS degree, CAST(SUM(shared_files) AS BIGINT) AS weighted_degree FROM (
  SELECT author_a AS author, shared_files FROM {NETWORK} n UNION ALL SELECT author_b, shared_files FROM {NETWORK} n2) x
GROUP BY author""")
CF = "(SELECT DISTINCT repo_name, commit_hash, file_path FROM file_changes)"


def coupling(min_support):
    return f"""(SELECT s.file_a, s.file_b, s.support, round(s.support / na.n, 6) AS confidence,
  round(s.support * (SELECT COUNT(DISTINCT (repo_name, commit_hash)) FROM file_changes) / (na.n * nb.n), 6) AS lift
  FROM (SELECT a.file_path AS file_a, b.file_path AS file_b, COUNT(*) AS support FROM {CF} a JOIN {CF} b
        ON a.repo_name = b.repo_name AND a.commit_hash = b.commit_hash AND a.file_path < b.file_path
        GROUP BY 1, 2 HAVING COUNT(*) >= {min_support}) s
  JOIN (SELECT file_path, COUNT(*) AS n FROM {CF} c GROUP BY 1) na ON s.file_a = na.file_path
  JOIN (SELECT file_path, COUNT(*) AS n FROM {CF} c GROUP BY 1) nb ON s.file_b = nb.file_path)"""


sql("change_coupling", f"SELECT * FROM {coupling(2)} cc")
sql("temporal_coupling", """
WITH ev AS (SELECT DISTINCT f.repo_name, f.commit_hash, f.author, f.file_path, c.date FROM file_changes f
            JOIN commits c ON f.commit_hash = c.commit_hash AND f.repo_name = c.repo_name)
SELECT a.file_path AS file_a, b.file_path AS file_b, COUNT(*) AS co_changes
FROM ev a JOIN ev b ON a.author = b.author AND (a.commit_hash <> b.commit_hash OR a.repo_name <> b.repo_name)
  AND a.file_path < b.file_path AND abs(epoch(a.date) - epoch(b.date)) <= 24 * 3600
GROUP BY 1, 2 HAVING COUNT(*) >= 2""")
sql("coupling_clusters", f"""
WITH RECURSIVE e AS (SELECT file_a AS a, file_b AS b FROM {coupling(5)} cc),
edges AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, label) AS (SELECT DISTINCT a, a FROM edges
  UNION SELECT edges.b, reach.label FROM reach JOIN edges ON reach.node = edges.a),
lab AS (SELECT node, MIN(label) AS label FROM reach GROUP BY node)
SELECT node AS file_path, label AS cluster_id, COUNT(*) OVER (PARTITION BY label) AS cluster_size FROM lab""")
sql("module_coupling", f"""
WITH p AS (SELECT {module('file_a')} AS ma, {module('file_b')} AS mb FROM {coupling(5)} cc),
u AS (SELECT ma AS module, 1 AS i, 0 AS x FROM p WHERE ma = mb
      UNION ALL SELECT ma, 0, 1 FROM p WHERE ma <> mb UNION ALL SELECT mb, 0, 1 FROM p WHERE ma <> mb)
SELECT module, CAST(SUM(i) AS BIGINT) AS internal_pairs, CAST(SUM(x) AS BIGINT) AS external_pairs,
  round(SUM(i) / (SUM(i) + SUM(x)), 6) AS cohesion FROM u GROUP BY module""")
_BUS = """
WITH per AS (SELECT {unit} AS {by}, author, SUM(additions + deletions) AS lines FROM file_changes GROUP BY 1, 2),
run AS (SELECT *, SUM(lines) OVER (PARTITION BY {by} ORDER BY lines DESC, author ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
  ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY lines DESC, author) AS rk, SUM(lines) OVER (PARTITION BY {by}) AS total FROM per)
SELECT {by}, COUNT(*) AS authors, CAST(MIN(total) AS BIGINT) AS total_lines, MIN(CASE WHEN cum > 0.5 * total THEN rk END) AS bus_factor
FROM run GROUP BY {by}"""
sql("bus_factor_modules", _BUS.format(unit=module(), by="module"))
sql("bus_factor_repos", _BUS.format(unit="repo_name", by="repo_name"))
CO = "COALESCE(regexp_matches(lower(message), 'co-author|co-authors|co-authored-by|pair programming'), false)"
sql("coauthored_commits", f"""
SELECT COUNT(*) AS total_commits, COUNT(*) FILTER (WHERE {CO}) AS coauthored_commits,
  round(COUNT(*) FILTER (WHERE {CO}) / COUNT(*), 6) AS coauthored_share FROM commits""")
sql("knowledge_distribution", f"""
SELECT {module()} AS module, COUNT(*) AS files, COUNT(*) FILTER (WHERE authors = 1) AS single_author_files,
  round(AVG(authors), 6) AS avg_authors_per_file, round(COUNT(*) FILTER (WHERE authors = 1) / COUNT(*), 6) AS single_author_share
FROM (SELECT file_path, COUNT(DISTINCT author) AS authors FROM file_changes GROUP BY 1) x GROUP BY 1""")
sql("socio_technical_congruence", f"""
WITH req AS (SELECT DISTINCT least(x.author, y.author) AS author_a, greatest(x.author, y.author) AS author_b
  FROM {coupling(5)} cc JOIN {FA} x ON x.file_path = cc.file_a JOIN {FA} y ON y.file_path = cc.file_b
  WHERE x.author <> y.author)
SELECT COUNT(*) AS required_pairs, COUNT(n.author_a) AS congruent_pairs,
  round(COUNT(n.author_a) / NULLIF(COUNT(*), 0), 6) AS congruence
FROM req LEFT JOIN {NETWORK} n ON req.author_a = n.author_a AND req.author_b = n.author_b""")

# ---------------------------------------------------------------- ingestion E01–E27 (dumps rendered and parsed back)
PAD = "'c' || lpad(substr({h}, 2), 12, '0')"
NUMBER = "CAST(substr(commit_hash, 2) AS BIGINT)"


def pad(h):
    return PAD.format(h=h)


# Repeated paths of a commit take the counts of the first in the order of listing.
BACK = f"""(SELECT * REPLACE (first_value(n_add) OVER o AS additions, first_value(n_del) OVER o AS deletions)
  FROM (SELECT *, CASE WHEN change_type = 'A' AND file_path LIKE '%.md' THEN 0 ELSE additions END AS n_add,
               CASE WHEN change_type = 'A' AND file_path LIKE '%.md' THEN 0 ELSE deletions END AS n_del FROM file_changes)
  WINDOW o AS (PARTITION BY repo_name, commit_hash, file_path ORDER BY change_type, file_changes_add, file_changes_del
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""".replace(
    "file_changes_add", "x_add").replace("file_changes_del", "x_del").replace(
    "SELECT *, CASE", "SELECT *, additions AS x_add, deletions AS x_del, CASE", 1)
_TOTALS = ", ".join(
    f"CAST(COALESCE(SUM(b.{m}) FILTER (WHERE b.change_type IN ('A', 'M'){f}), 0) AS BIGINT) AS total_{m}{s}"
    for s, f in (("", ""), ("_test", " AND b.is_test_file = 1"), ("_dot", " AND b.is_dot_file = 1"),
                 ("_build", " AND b.is_build_file = 1"))
    for m in ("additions", "deletions"))
sql("ingest_commits", f"""
SELECT {pad('c.commit_hash')} AS commit_hash, c.repo_name, c.author, CASE WHEN bad THEN NULL ELSE {iso('c.date')} END AS date,
  CASE WHEN bad THEN NULL ELSE c.timezone END AS timezone, CASE WHEN parents > 1 THEN 1 ELSE 0 END AS is_merge,
  c.message || CASE WHEN body THEN chr(10) || 'commit: see the earlier one' || chr(10) || 'date: unknown' ELSE '' END AS message,
  t.* EXCLUDE (repo_name, commit_hash)
FROM (SELECT *, {NUMBER} % 77 = 0 AS bad, {NUMBER} % 5 = 0 AS body FROM commits) c
JOIN (SELECT k.repo_name, k.commit_hash, {_TOTALS}
      FROM commits k LEFT JOIN {BACK} b ON (b.repo_name, b.commit_hash) = (k.repo_name, k.commit_hash)
      GROUP BY k.repo_name, k.commit_hash) t ON (t.repo_name, t.commit_hash) = (c.repo_name, c.commit_hash)
LEFT JOIN (SELECT repo_name, commit_hash, COUNT(*) AS parents FROM commit_parents GROUP BY ALL) p
  ON (p.repo_name, p.commit_hash) = (c.repo_name, c.commit_hash)""")
sql("ingest_file_changes", f"""
SELECT {pad('commit_hash')} AS commit_hash, repo_name, author, change_type, file_path, CAST(additions AS BIGINT) AS additions,
  CAST(deletions AS BIGINT) AS deletions, is_test_file, is_build_file, is_dot_file, is_documentation_file,
  CASE WHEN change_type = 'R' THEN 90 END AS similarity, CASE WHEN change_type = 'R' THEN file_path || '.new' END AS new_path
FROM {BACK} b""")
sql("ingest_change_ids", "SELECT COUNT(*) AS changes, COUNT(*) AS ids FROM file_changes")
sql("ingest_parents", f"""
SELECT DISTINCT {pad('commit_hash')} AS commit_hash, repo_name, {pad('parent_hash')} AS parent_hash FROM commit_parents""")
sql("ingest_branches", f"""
SELECT b.branch_name, b.repo_name, b.is_active, {iso('b.creation_date')} AS creation_date,
  CASE WHEN b.is_active = 0 THEN (
    SELECT CASE WHEN {NUMBER} % 77 = 0 THEN NULL ELSE {iso('c.date')} END FROM commits c
    WHERE c.repo_name = b.repo_name AND contains(c.message, b.branch_name)
    ORDER BY c.date DESC, c.commit_hash LIMIT 1) END AS merge_date
FROM branches b""")
sql("ingest_tags", f"""
SELECT tag_name, repo_name, {pad('tag_commit')} AS tag_commit, tag_message || ', and more' AS tag_message FROM tags""")
sql("ingest_repositories", "SELECT repo_name, COUNT(*) AS commits FROM commits GROUP BY repo_name")
sql("ingest_rejects", f"""
SELECT repo_name, 'no record header' AS reason, 1 AS rejects FROM commits GROUP BY repo_name
UNION ALL SELECT repo_name, 'unreadable date', COUNT(*) FROM commits WHERE {NUMBER} % 77 = 0 GROUP BY repo_name""")
sql("adhoc_sql", """
SELECT c.repo_name, COUNT(DISTINCT f.file_path) AS files, MAX(f.additions) AS most_added
FROM commits c JOIN file_changes f ON (f.commit_hash, f.repo_name) = (c.commit_hash, c.repo_name)
WHERE c.is_merge = 0 GROUP BY c.repo_name""")
sql("delimited_rows", f"""
SELECT 'repo_name, branch_name, is_active, merge_date' AS line
UNION ALL SELECT concat(repo_name, ', ', branch_name, ', ', is_active, ', ', {iso('merge_date')}) FROM branches""")

# ---------------------------------------------------------------- teams, vocabularies, open SQL
sql("productivity_by_team", """
WITH home AS (SELECT author, max({'n': n, 'tz': timezone}).tz AS team
  FROM (SELECT author, timezone, COUNT(*) AS n FROM commits GROUP BY ALL) GROUP BY author),
g AS (SELECT team, COUNT(*) AS commits, CAST(SUM(total_additions + total_deletions) AS BIGINT) AS churn
  FROM commits JOIN home USING (author) GROUP BY team)
SELECT team, commits, churn, CAST(rank() OVER (ORDER BY commits DESC) AS BIGINT) AS commit_rank,
  round(percent_rank() OVER (ORDER BY churn), 6) AS churn_percent_rank FROM g""")
_BUILD_FILE = r"""regexp_matches(split_part(file_path, '/', -1),
  '(^(pom[.]xml|build[.]gradle|package[.]json|requirements[.]txt|yarn[.]lock|Gemfile|Gemfile[.]lock|Cargo[.]toml|Podfile|Podfile[.]lock)$)|([.](csproj|sln|xcodeproj|gradle)$)|(lock[.](json|yaml|yml)$)')"""
sql("build_file_activity", f"""
SELECT split_part(file_path, '/', -1) AS build_file, COUNT(*) AS changes, COUNT(DISTINCT file_path) AS files,
  CAST(SUM(additions + deletions) AS BIGINT) AS churn, COUNT(DISTINCT author) AS authors
FROM file_changes WHERE {_BUILD_FILE} GROUP BY 1""")
sql("configuration_commits", f"""
WITH hit AS (SELECT c.date, COALESCE(regexp_matches(lower(c.message), 'config files|settings|setup files'), false) AS said,
    EXISTS (SELECT 1 FROM file_changes f WHERE f.commit_hash = c.commit_hash AND f.repo_name = c.repo_name
      AND {ext('f.file_path')} IN ('conf', 'cfg', 'ini', 'yaml', 'yml', 'json', 'xml', 'properties', 'toml', 'env')) AS file
  FROM commits c)
SELECT strftime(date, '%Y-%m') AS month, COUNT(*) AS commits, COUNT(*) FILTER (WHERE said) AS mentioned,
  COUNT(*) FILTER (WHERE file) AS changed, COUNT(*) FILTER (WHERE said AND file) AS both
FROM hit WHERE said OR file GROUP BY 1""")
sql("adhoc_sql_gaps", """
SELECT repo_name, year, COUNT(*) AS gaps, round(avg(s) / 86400, 4) AS avg_days, round(max(s) / 86400, 4) AS most_days
FROM (SELECT repo_name, strftime(date, '%Y') AS year,
        epoch(date) - epoch(lag(date) OVER (PARTITION BY repo_name ORDER BY date, commit_hash)) AS s FROM commits)
WHERE s IS NOT NULL GROUP BY repo_name, year""")
sql("adhoc_sql_releases", f"""
WITH r AS (SELECT *, lag(tag_name) OVER w AS from_tag, lag(date) OVER w AS from_date FROM ({REL_DATES}) x
  WINDOW w AS (PARTITION BY repo_name ORDER BY date, tag_name))
SELECT r.repo_name, r.from_tag, r.tag_name AS to_tag, {iso('r.date')} AS released,
  CAST(COALESCE(SUM(c.total_additions + c.total_deletions), 0) AS BIGINT) AS churn, COUNT(c.commit_hash) AS commits
FROM r LEFT JOIN commits c ON c.repo_name = r.repo_name AND c.date > r.from_date AND c.date <= r.date
WHERE r.from_tag IS NOT NULL GROUP BY ALL""")
sql("adhoc_sql_patterns", """
SELECT CASE WHEN file_path GLOB '*/[A-Za-m]*.xml' THEN 'early xml' WHEN starts_with(file_path, 'docs/') THEN 'docs'
    WHEN lower(file_path) LIKE '%.py' THEN 'python' WHEN instr(file_path, '/') = 0 THEN 'top'
    ELSE split_part(file_path, '/', 1) END AS kind,
  COUNT(DISTINCT file_path) AS files, CAST(SUM(additions) AS BIGINT) AS added
FROM file_changes GROUP BY 1""")

sql("keyword_search_indexed", BODIES["keyword_search"])
