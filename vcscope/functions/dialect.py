"""Functions of the SQL dialect that questions about a history are written in, as
Spark SQL functions (expressions, which Catalyst inlines; no Python).

* ``julianday(t)``: days since noon of 24 November 4714 BC, with fractions.
* ``strftime(format, t)``: %Y %m %d %H %M %S %s %j %w %W %J %f %% of a time.
* ``glob(pattern, text)``: case-sensitive, with * ? [..] and [^..].

Times are timestamps or ISO 8601 text, in UTC; text that is none gives null."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Julian day of 1970-01-01 00:00 UTC.
EPOCH_DAY = 2440587.5

_TS = "try_cast(t AS TIMESTAMP)"
# Each mark and what stands for it; %% is set aside first and put back last.
_MARKS = [
    ("%Y", f"date_format({_TS}, 'yyyy')"), ("%m", f"date_format({_TS}, 'MM')"), ("%d", f"date_format({_TS}, 'dd')"),
    ("%H", f"date_format({_TS}, 'HH')"), ("%M", f"date_format({_TS}, 'mm')"), ("%S", f"date_format({_TS}, 'ss')"),
    ("%f", f"date_format({_TS}, 'ss.SSS')"), ("%s", f"CAST(unix_seconds({_TS}) AS STRING)"),
    ("%j", f"date_format({_TS}, 'DDD')"), ("%w", f"CAST(dayofweek({_TS}) - 1 AS STRING)"),
    # Weeks start on Monday; days before the first Monday are week 00.
    ("%W", f"lpad(CAST((dayofyear({_TS}) + 6 - weekday({_TS})) DIV 7 AS STRING), 2, '0')"),
    ("%J", f"CAST(unix_micros({_TS}) / 86400000000D + {EPOCH_DAY}D AS STRING)"),
]


def _strftime() -> str:
    out = "replace(format, '%%', chr(1))"
    for mark, value in _MARKS:
        out = f"replace({out}, '{mark}', {value})"
    return f"replace({out}, chr(1), '%')"


# A pattern as a regular expression: what has a meaning there but none here is
# quoted, then * and ? are put in place.
_GLOB = r"""text RLIKE concat('^(?s:', replace(replace(
    regexp_replace(regexp_replace(pattern, r'([\\.+(){}|$])', r'\\$1'), r'(?<!\[)\^', r'\\^'),
    '*', '.*'), '?', '.'), ')$')"""

FUNCTIONS = {
    "julianday(t STRING)": ("DOUBLE", f"unix_micros({_TS}) / 86400000000D + {EPOCH_DAY}D"),
    "strftime(format STRING, t STRING)": ("STRING", _strftime()),
    "glob(pattern STRING, text STRING)": ("BOOLEAN", _GLOB),
}


def register_functions(spark: SparkSession) -> None:
    """Make the functions known to the session, if they are not."""
    known = {f.name for f in spark.catalog.listFunctions(pattern="julianday")}
    if "julianday" not in known:
        for signature, (type_, body) in FUNCTIONS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {type_} RETURN {body}")
