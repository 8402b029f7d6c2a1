"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by its content (SHA-256). The ledger lists
the (blob, rule, rule version) pairs already scanned; a scan reads only pairs
that it lacks, each blob once however many paths hold it, and findings are
joined back to all paths.

A match's place follows from the gaps between matches: split() gives the gaps,
regexp_extract_all() the matches, both leftmost and non-overlapping.

Defined results: a null text counts as empty and has no findings; null paths
(doc_id) are kept; repeated rows each give their row; equal matches of several
rules stay, by start and then rule; an empty table gives no rows; other columns
of the input are not read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, null_text, stage


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; a version is raised
    whenever the pattern changes, so that old blobs are scanned again."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


# A private key: from BEGIN to the END of the same kind, or without one (cut off,
# of another kind, or after another BEGIN) over the base64 that follows, its last
# line being short. Possessive, so that long texts take no stack.
_BREAK = r"(?:[\x20\t\r\n]|\\[rn])"
_BASE64 = (rf"(?:{_BREAK}*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+"
           rf"(?:(?:{_BREAK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++"
           rf"(?:{_BREAK}++[A-Za-z0-9+/]++(?:={{1,2}}+|(?=[\x20\t]*+(?:[\r\n]|\\[rn]|\z))))?+)?+")
PEM = (r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----"
       r"(?:[^-]*+(?:-(?!----(?:BEGIN|END)\x20)[^-]*+)*+-----END \1PRIVATE KEY-----|" + _BASE64 + ")")

# A match shorter than asked for can be left out of the pattern itself where
# runs are maximal (access, hex); assign consumes what it matched either way.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}+"),
    Rule("hex", 1, r"[0-9a-f]{24,}+"),
    Rule("pem", 2, PEM),
)
BASE = ("assign", "access", "hex")

LEDGER = "blob binary, rule string, version int"
FINDINGS = "blob binary, rule string, version int, start int, `end` int"


def with_blob(versions: DataFrame, path: str = "doc_id") -> DataFrame:
    """path, text, blob of every version."""
    t = null_text()
    return versions.select(F.col(path).alias("path"), t.alias("text")).withColumn(
        "blob", F.unhex(F.sha2(F.col("text"), 256)))


def _spans(rule: Rule) -> str:
    """SQL: spans of the matches m (their checked part p) between the gaps g."""
    k = rule.kind
    start = f"a.at + length({k}_g[i])"
    end = f"{start} + length({k}_m[i])"
    fits = f"length({k}_p[i]) >= {rule.least}" if rule.least else "true"
    return f"""aggregate(sequence(0, size({k}_m) - 1),
        named_struct('at', 0, 'out', cast(array() AS array<struct<start:int,end:int>>)),
        (a, i) -> named_struct('at', {end}, 'out', CASE WHEN {fits}
            THEN concat(a.out, array(named_struct('start', {start}, 'end', {end}))) ELSE a.out END),
        a -> a.out)"""


def scan(versions: DataFrame, rules=RULES, ledger: DataFrame | None = None):
    """Scan what ``ledger`` lacks. Returns (findings, scanned): the new findings
    by blob and the pairs to add to the ledger."""
    spark = versions.sparkSession
    blobs = with_blob(versions)
    # One carrier for each blob; texts are read through it alone.
    carriers = blobs.groupBy("blob").agg(F.min("path").alias("carrier"))
    known = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"))
                      for r in rules])
    if ledger is None:
        pending = carriers.withColumn("todo", known)
    else:
        pairs = carriers.select("blob", "carrier", F.explode(known).alias("k")).select(
            "blob", "carrier", "k.rule", "k.version")
        pending = pairs.join(ledger, ["blob", "rule", "version"], "left_anti").groupBy(
            "blob", "carrier").agg(F.collect_set(F.struct("rule", "version")).alias("todo"))
    scanned = pending.select("blob", F.explode("todo").alias("k")).select("blob", "k.rule", "k.version")

    todo = pending.select(F.col("blob").alias("todo_blob"), "carrier", "todo")
    texts = todo.join(blobs, F.col("carrier").eqNullSafe(F.col("path"))
                      & (F.col("todo_blob") == F.col("blob"))).select("blob", "todo", "text")
    for r in rules:
        due = F.array_contains("todo", F.struct(F.lit(r.kind).alias("rule"),
                                                F.lit(r.version).alias("version")))
        texts = texts.withColumn(f"{r.kind}_m", F.when(due, F.regexp_extract_all(
            "text", F.lit(r.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    texts = texts.where(" + ".join(f"size({r.kind}_m)" for r in rules) + " > 0")
    for r in rules:
        some = F.size(f"{r.kind}_m") > 0
        texts = texts.withColumn(f"{r.kind}_g", F.when(some, F.split("text", r.pattern, -1)))
        if r.least:
            texts = texts.withColumn(f"{r.kind}_p", F.when(some, F.regexp_extract_all(
                "text", F.lit(r.pattern), F.lit(r.group))))
    def named(r: Rule):
        return lambda s: F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
                                  s["start"].alias("start"), s["end"].alias("end"))

    found = [F.when(F.size(f"{r.kind}_m") > 0, F.transform(F.expr(_spans(r)), named(r)))
             for r in rules]
    each = texts.select("blob", F.explode(F.concat(*[
        F.coalesce(x, F.array().cast("array<struct<rule:string,version:int,start:int,end:int>>"))
        for x in found])).alias("f"))
    # A repeated row can carry its blob twice.
    findings = each.select("blob", "f.rule", "f.version", "f.start", "f.end").dropDuplicates()
    return findings, scanned


def by_path(versions: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """path, spans (start, nth rule, end, kind) of every version, none left out."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    spans = findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(
        "start", order[F.col("rule")].alias("nth"), "end", F.col("rule").alias("kind")))).alias("spans"))
    return with_blob(versions).select("path", "blob").join(spans, "blob", "left").select(
        "path", F.coalesce("spans", F.array().cast(
            "array<struct<start:int,nth:int,end:int,kind:string>>")).alias("spans"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    findings, _ = scan(docs)
    rows = by_path(docs, findings)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    n = {k: F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long") for k in BASE}
    return rows.select(
        F.col("path").alias("doc_id"), *[n[k].alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


REDACTED = "[REDACTED]"


def redacted(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """``docs`` with every found span replaced; rows without findings unchanged.
    n_chars follows where the column exists."""
    if findings is None:
        findings, _ = scan(docs)
    order = F.sort_array(F.collect_list(F.struct("start", "end")))
    # Written, so that the list's size is known: texts stay where they are if it can
    # be broadcast, and else the rows of a blob with many copies can be split.
    spans = stage(findings.groupBy(F.col("blob").alias("_blob")).agg(order.alias("_spans")), "secret-spans")
    clean = F.expr(f"""aggregate(_spans, named_struct('at', 0, 'out', ''),
        (a, s) -> named_struct('at', greatest(a.at, s.end), 'out', CASE WHEN s.start >= a.at
            THEN concat(a.out, substring(text, a.at + 1, s.start - a.at), '{REDACTED}') ELSE a.out END),
        a -> concat(a.out, substring(text, a.at + 1)))""")
    out = docs.withColumn("_key", F.unhex(F.sha2(null_text(), 256))).join(
        spans, F.col("_key") == F.col("_blob"), "left")
    out = out.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast("long")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


# Base patterns as they are defined; failing matches are dropped afterwards.
_SQL_RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)

# The rule pem in DuckDB's patterns, which have no references back and no looking
# ahead: whether the next mark is the END of the same kind follows from positions; else
# the longer of two ways to read base64, up to a short last line closed by = or by the
# end of its line.
_SQL_BREAK = r"(?:[\x20\t\r\n]|\\[rn])"
_SQL_LINES = (rf"(?:{_SQL_BREAK}*(?:Proc-Type|DEK-Info):[^\r\n\\]*)*"
              rf"(?:{_SQL_BREAK}*[A-Za-z0-9+/]{{16,}}={{0,2}})+")
_SQL_INFO = rf"(?:{_SQL_BREAK}*(?:Proc-Type|DEK-Info):[^\r\n\\]*)*"
_SQL_PEM = rf"""SELECT doc_id, 3 AS nth, 'pem' AS kind, length(head) + CASE
      WHEN e > 0 AND (b = 0 OR e < b) AND starts_with(substr(rest, e), '-----END ' || key_kind || 'PRIVATE KEY-----')
        THEN e - 1 + length('-----END ' || key_kind || 'PRIVATE KEY-----')
      ELSE greatest(length(regexp_extract(rest, '^({_SQL_INFO})', 1)),
        length(regexp_extract(rest, '^({_SQL_LINES}(?:{_SQL_BREAK}+[A-Za-z0-9+/]+=={{0,1}})?)', 1)),
        length(regexp_extract(rest, '^({_SQL_LINES}{_SQL_BREAK}+[A-Za-z0-9+/]+)[\x20\t]*(?:[\r\n]|\\[rn]|$)', 1))) END AS n, pos
    FROM (SELECT *, strpos(rest, '-----BEGIN ') AS b, strpos(rest, '-----END ') AS e,
            regexp_extract(head, '-----BEGIN ([A-Z ]{{0,40}})PRIVATE KEY-----', 1) AS key_kind
          FROM (SELECT *, w[i] AS head, substr(t, CAST(pos AS BIGINT) + length(w[i]) + 1) AS rest FROM (
            SELECT *, list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in w[1:i - 1]]), 0) AS pos
            FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i
                  FROM (SELECT doc_id, t, regexp_extract_all(t, '-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----') AS w,
                          string_split_regex(t, '-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----') AS g FROM d)))))"""


def _sql() -> str:
    parts = []
    for nth, (kind, pattern, group, least) in enumerate(_SQL_RULES):
        q = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {nth} AS nth, '{kind}' AS kind, w, g, p, {least} AS least
            FROM (SELECT doc_id, regexp_extract_all(t, '{q}', 0) AS w, string_split_regex(t, '{q}') AS g,
                         regexp_extract_all(t, '{q}', {group}) AS p FROM d)""")
    n = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({' UNION ALL '.join(parts)}),
    each_match AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m),
    found AS (SELECT doc_id, nth, kind, length(w[i]) AS n,
        list_sum([length(x) for x in g[1:i]])
          + coalesce(list_sum([length(x) for x in w[1:i - 1]]), 0) AS pos
        FROM each_match WHERE length(p[i]) >= least UNION ALL {_SQL_PEM}),
    per AS (SELECT doc_id, {n}, string_agg(span, ',' ORDER BY pos, nth) AS spans,
        string_agg(span, ',' ORDER BY pos, nth) FILTER (WHERE kind <> 'pem') AS base
        FROM (SELECT *, kind || ':' || CAST(pos AS BIGINT) || ':' || CAST(pos + n AS BIGINT) AS span FROM found) GROUP BY doc_id)
    SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)},
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN per ON d.doc_id = per.doc_id"""


ORACLE_SQL = _sql()
