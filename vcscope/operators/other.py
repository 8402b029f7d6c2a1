"""Remaining metrics (M60–M68) and the key check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import vocab
from ..plans.catalog import register
from ..tables import Tables
from .common import DEFAULT_TOP_N, beside, extension, has_keyword, module, r6, ratio, top
from .stats import running
from ..functions.timeops import month, weekday


@register("timezone_distribution")
def timezone_distribution(t: Tables) -> DataFrame:
    """Commits and authors per UTC offset."""
    return t.commits.groupBy(*t.scope, "timezone").agg(F.count(F.lit(1)).alias("commits"),
                                             F.countDistinct("author").alias("authors"))


@register("weekend_vs_weekday")
def weekend_vs_weekday(t: Tables) -> DataFrame:
    """Commits on weekend and weekdays (UTC) and their share."""
    kind = F.when(weekday("date").isin(0, 6), F.lit("weekend")).otherwise(F.lit("weekday"))
    g = t.commits.groupBy(*t.scope, kind.alias("day_type")).agg(F.count(F.lit(1)).alias("commits"))
    total = t.commits.groupBy(*t.scope).agg(F.count(F.lit(1)).alias("all_commits"))
    return beside(g, total, t.scope).withColumn("share", r6(ratio("commits", "all_commits"))).drop("all_commits")


@register("low_review_areas")
def low_review_areas(t: Tables, n: int = DEFAULT_TOP_N, depth: int = 1) -> DataFrame:
    """Modules with the smallest share of changes that came through
    pull or merge requests (a proxy; there is no review data)."""
    pr = (t.commits.where(has_keyword("message", vocab.PULL_REQUEST_KEYWORDS))
          .select("commit_hash", "repo_name").withColumn("_pr", F.lit(1)))
    fc = t.file_changes.join(pr, ["commit_hash", "repo_name"], "left")
    g = fc.groupBy(*t.scope, module("file_path", depth).alias("module")).agg(
        F.count(F.lit(1)).alias("changes"), F.count("_pr").alias("pr_changes"))
    g = g.withColumn("pr_share", r6(ratio("pr_changes", "changes")))
    return top(g, n, F.asc("pr_share"), F.asc("module"), scope=t.scope)


@register("expertise")
def expertise(t: Tables, depth: int = 1) -> DataFrame:
    """Author × module — commits, scope (distinct files), share of the
    module's commits and rank within the module."""
    fc = t.file_changes.select(*t.keys("repo_name", "commit_hash"), module("file_path", depth).alias("module"), "author",
                               "file_path")
    unit, own = t.keys("module"), t.keys("module", "author")
    # Commits and files are told apart one after the other, with map-side sums each.
    touched = fc.select("repo_name", "commit_hash", "module", "author").distinct()
    commits = touched.groupBy(*own).agg(F.count(F.lit(1)).alias("commits"))
    files = fc.select(*own, "file_path").distinct().groupBy(*own).agg(F.count(F.lit(1)).alias("files"))
    mod = touched.select("repo_name", "commit_hash", "module").distinct().groupBy(*unit).agg(
        F.count(F.lit(1)).alias("module_commits"))
    ranked = running(commits.join(files, own).withColumn("_one", F.lit(1)), unit,
                     [F.desc("commits"), F.desc("files"), F.asc("author")], {"nth": "_one"})
    return ranked.join(mod, unit).select(*own, "commits", "files", r6(ratio("commits", "module_commits")).alias("share"),
                                         F.col("nth").cast("int").alias("rank_in_module"))


def _skill(path="file_path") -> F.Column:
    ext = extension(path)
    out = F.lit(None).cast("string")
    for skill, exts in reversed(vocab.SKILL_EXTENSIONS):
        out = F.when(ext.isin(*exts), F.lit(skill)).otherwise(out)
    return out


@register("skill_gaps")
def skill_gaps(t: Tables, threshold: float = 0.05) -> DataFrame:
    """Author × skill — distinct files of that skill the author changed
    and their share of the author's distinct files; a gap is a share below
    ``threshold`` (zero included). Every author gets all four skills."""
    fc = t.file_changes.select(*t.keys("author", "file_path"), "is_test_file").distinct()
    tagged = fc.select(*t.keys("author"), "file_path", F.explode(F.array_compact(F.array(
        _skill("file_path"), F.when(F.col("is_test_file") == 1, F.lit("testing"))))).alias("skill"))
    per = tagged.groupBy(*t.scope, "author", "skill").agg(F.countDistinct("file_path").alias("files"))
    authors = fc.groupBy(*t.scope, "author").agg(F.countDistinct("file_path").alias("author_files"))
    grid = authors.select(*t.keys("author"), "author_files", F.explode(F.array(*[F.lit(s) for s in vocab.SKILLS])).alias("skill"))
    j = grid.join(per, t.keys("author", "skill"), "left").withColumn("files", F.coalesce("files", F.lit(0)))
    share = ratio("files", "author_files")
    return j.select(*t.keys("author"), "skill", "files", r6(share).alias("share"),
                    (F.coalesce(share, F.lit(0.0)) < threshold).cast("int").alias("is_gap"))


def language(path="file_path") -> F.Column:
    m = F.create_map(*[x for ext, lang in vocab.LANGUAGE_EXTENSIONS for x in (F.lit(ext), F.lit(lang))])
    return F.coalesce(F.element_at(m, extension(path)), F.lit("Other"))


@register("language_usage")
def language_usage(t: Tables) -> DataFrame:
    """Distinct files per language (by extension)."""
    return t.file_changes.groupBy(*t.scope, language("file_path").alias("language")).agg(
        F.countDistinct("file_path").alias("files"))


def tool_presence(t: Tables, globs: Sequence[str] = tuple(vocab.GITHUB_ACTIONS_GLOBS),
                  tool: str = "github_actions") -> DataFrame:
    """Does any changed path match the tool's file patterns (GLOB,
    case-sensitive, translated to an anchored regex)."""
    rx = "|".join(f"(?:{vocab.glob_to_regex(g)})" for g in globs)
    hit = F.when(F.col("file_path").rlike(rx), F.col("file_path"))
    return t.file_changes.groupBy(*t.scope).agg(F.lit(tool).alias("tool"), F.countDistinct(hit).alias("matching_files")).withColumn(
        "present", (F.col("matching_files") > 0).cast("int"))


register("tool_presence")(lambda t: tool_presence(t))


@register("file_class_counts")
def file_class_counts(t: Tables) -> DataFrame:
    """Distinct test, build, dot, documentation and configuration files."""
    flags = {"test_files": F.col("is_test_file") == 1, "build_files": F.col("is_build_file") == 1,
             "dot_files": F.col("is_dot_file") == 1, "documentation_files": F.col("is_documentation_file") == 1,
             "config_files": extension("file_path").isin(*vocab.CONFIG_EXTENSIONS)}
    files = t.file_changes.groupBy(*t.scope, "file_path").agg(*[F.max(c).alias(n) for n, c in flags.items()])
    return files.groupBy(*t.scope).agg(F.count("file_path").alias("files"), *[F.count_if(n).alias(n) for n in flags])


def named_build(path="file_path") -> F.Column:
    """A build file by its name, or by the ending of it."""
    name, ends = F.substring_index(path, "/", -1), F.lit(False)
    for e in vocab.BUILD_ENDINGS:
        ends = ends | F.endswith(name, F.lit(e))
    return name.isin(*vocab.BUILD_NAMES) | ends


@register("build_file_activity")
def build_file_activity(t: Tables) -> DataFrame:
    """P_BUILD: per build file of the named vocabulary, changes, churn and authors."""
    fc = t.file_changes.where(named_build())
    return fc.groupBy(*t.scope, F.substring_index("file_path", "/", -1).alias("build_file")).agg(
        F.count(F.lit(1)).alias("changes"), F.countDistinct("file_path").alias("files"),
        F.sum(F.col("additions") + F.col("deletions")).alias("churn"), F.countDistinct("author").alias("authors"))


@register("configuration_commits")
def configuration_commits(t: Tables) -> DataFrame:
    """K_CONFIG, P_CONFIG: per month, commits that mention configuration or settings
    or change a configuration file, and those that do both."""
    own = ["repo_name", "commit_hash"]
    files = t.file_changes.where(extension("file_path").isin(*vocab.CONFIG_EXTENSIONS)).select(*own).distinct().withColumn(
        "_file", F.lit(True))
    c = t.commits.select(*own, "date", has_keyword("message", vocab.CONFIG_KEYWORDS).alias("said")).join(files, own, "left")
    file = F.coalesce("_file", F.lit(False))
    return c.where(F.col("said") | file).groupBy(*t.scope, month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("commits"), F.count_if("said").alias("mentioned"), F.count_if(file).alias("changed"),
        F.count_if(F.col("said") & file).alias("both"))


def keyword_search(t: Tables, terms: Sequence[str] = ("conflict", "readme")) -> DataFrame:
    """Commits whose message or any changed path contains a term
    (case-insensitive); set union of the two hit lists."""
    by_msg = t.commits.where(has_keyword("message", terms)).select("commit_hash", "repo_name")
    by_path = t.file_changes.where(has_keyword("file_path", terms)).select("commit_hash", "repo_name")
    return by_msg.unionByName(by_path).distinct()


register("keyword_search")(lambda t: keyword_search(t))


@register("data_quality_keys")
def data_quality_keys(t: Tables) -> DataFrame:
    """Rows and distinct primary keys per table (file changes checked on
    (repo, commit, path, change type), the natural key)."""
    keys = dict(schema.KEYS)
    keys["file_changes"] = ["repo_name", "commit_hash", "file_path", "change_type"]
    parts = []
    for name in ("commits", "file_changes", "commit_parents", "branches", "tags"):
        df = getattr(t, name)
        parts.append(df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
                            F.countDistinct(*keys[name]).alias("distinct_keys")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("duplicate_rows", F.col("row_count") - F.col("distinct_keys"))
