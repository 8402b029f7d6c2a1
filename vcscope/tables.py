"""The five history tables as one handle, with parquet load and save."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .session import partitions, shuffles_removed, staged

NAMES = ("commits", "file_changes", "commit_parents", "branches", "tags")


# Order of the rows within a repository's files.
SORTED_BY = {"commits": "date", "file_changes": "file_path", "commit_parents": "commit_hash",
             "branches": "branch_name", "tags": "tag_name"}


def clustered(df: DataFrame, name: str) -> DataFrame:
    order = ["repo_name", SORTED_BY[name]]
    return df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)


def write_table(df: DataFrame, path: str) -> None:
    """A table by repository; ``df`` is clustered."""
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy("repo_name").parquet(path)


_making = threading.RLock()


@dataclass(frozen=True)
class Tables:
    """A table may be given as a function that makes it: it is made when first asked
    for, once, so that a query pays for the tables that it reads."""

    commits: DataFrame
    file_changes: DataFrame
    commit_parents: DataFrame
    branches: DataFrame
    tags: DataFrame
    # Columns that every key of an operator starts with (see ``by_repo``).
    scope: tuple[str, ...] = ()
    # Folder of the keyword index that was written with these tables, if one was.
    search: str | None = None
    # What operators have derived from these tables and written, to be read again.
    derived: dict = field(default_factory=dict, compare=False, repr=False)

    def __getattribute__(self, name: str):
        value = object.__getattribute__(self, name)
        if name in NAMES and callable(value):
            with _making:
                value = object.__getattribute__(self, name)
                if callable(value):
                    value = value()
                    object.__setattr__(self, name, value)
        return value

    def _each(self, f: Callable[[str], DataFrame]) -> dict[str, Callable[[], DataFrame]]:
        """Every table by a function of its name, when it is asked for."""
        return {n: lambda n=n: f(n) for n in NAMES}

    @property
    def spark(self) -> SparkSession:
        return self.commits.sparkSession

    def as_dict(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in NAMES}

    def between(self, from_: str | None = None, to: str | None = None) -> "Tables":
        """The history of an inclusive date range (either side optional): its
        commits, and what belongs to them. Every operator takes it like the whole
        tables. Branches stay; tags are those of the commits."""
        from .operators.common import in_range
        if from_ is None and to is None:
            return self
        own = {"file_changes": "commit_hash", "commit_parents": "commit_hash", "tags": "tag_commit"}

        def kept(name: str) -> DataFrame:
            df = getattr(self, name)
            if name == "commits":
                return in_range(df, from_, to)
            if name not in own:
                return df
            keys = in_range(self.commits, from_, to).select("repo_name", F.col("commit_hash").alias(own[name]))
            return df.join(keys, ["repo_name", own[name]], "left_semi").select(*df.columns)

        return Tables(**self._each(kept), scope=self.scope)

    def of_repos(self, *repos: str) -> "Tables":
        """The history of some repositories; the filter prunes their folders."""
        return replace(self, search=None, derived={}, **self._each(
            lambda n: getattr(self, n).where(F.col("repo_name").isin(*repos))))

    def by_repo(self) -> "Tables":
        """The same tables, each repository for itself: operators put ``repo_name``
        before all their keys (paths, modules, authors, months, pairs, ranks, the
        first n), so one query gives what each repository alone would give, with its
        name, and equal paths or authors of two repositories never meet."""
        return replace(self, scope=("repo_name",), derived={}, **self._each(lambda n: getattr(self, n)))

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, written to the shared folder when first asked for."""
        if name not in self.derived:
            self.derived[name] = staged(make(), name)
        return self.derived[name]

    def keys(self, *columns: str) -> list[str]:
        """The scope's columns and ``columns``, each once."""
        return list(dict.fromkeys([*self.scope, *columns]))

    def sql(self, query: str) -> DataFrame:
        """Ad-hoc SQL over these tables (E26), under their own names.

        The names are common table expressions before the query, over views of this
        handle alone: handles side by side (another range, another store) answer
        each from their own data, and nothing of the session is overwritten. Date and
        pattern functions of the dialect are there (see ``functions.dialect``)."""
        from .functions.dialect import register_functions
        named = [n for n in NAMES if re.search(rf"\b{n}\b", query, re.I)]
        made = self.derived.setdefault("views", {})
        for name in named:
            if name not in made:
                made[name] = f"vcscope_{uuid.uuid4().hex}_{name}"
                getattr(self, name).createOrReplaceTempView(made[name])
        spark = getattr(self, named[0]).sparkSession if named else self.spark
        register_functions(spark)
        if not named:
            return spark.sql(query)
        views, own = ",\n".join(f"{n} AS (SELECT * FROM {made[n]})" for n in named), _WITH.match(query)
        if own is None:
            return spark.sql(f"WITH {views}\n{query}")
        return spark.sql(f"WITH {own.group(1) or ''} {views},\n{query[own.end():]}")

    def write(self, path: str, also: dict[str, DataFrame] | None = None, keep: int = 1, search: bool = False) -> str:
        """Table sink: full rebuild, one parquet dataset per table, partitioned
        by repository so per-repo questions prune whole directories. Rows are
        put into ranges of (repository, SORTED_BY) before, so that a repository
        has few files, however many tasks wrote them, and filters on dates or
        paths skip row groups.

        Every rebuild is a version in a folder of its own, and readers find the
        newest by a file that is made when all its tables are whole: a rebuild that fails
        halfway leaves the store as it was, and readers never see tables of two
        versions. The last ``keep`` versions before stay for jobs that still read them,
        older ones are removed. ``also``: further datasets of the version; ``search``:
        its keyword index too. Returns the version's name."""
        base, store = path.rstrip("/"), Store(self.spark, path)
        number, name = store.next_number(), uuid.uuid4().hex
        for table, df in self.as_dict().items():
            write_table(clustered(df, table), f"{base}/{name}/{table}")
        for table, df in (also or {}).items():
            with shuffles_removed(self.spark):
                df.write.parquet(f"{base}/{name}/{table}")
        if search:
            from .operators.search import write_index
            write_index(self, f"{base}/{name}/search")
        version = f"{number:012d}-{name}"
        store.publish(version)
        store.remove_before(number - keep)
        return version

    @classmethod
    def read(cls, spark: SparkSession, path: str, version: str | None = None) -> "Tables":
        """The newest version of a store, or a given one that is still there."""
        base = data_folder(spark, path, version)
        dfs = {name: read_table(spark, f"{base}/{name}", name) for name in NAMES}
        index = Store(spark, path).path(f"{base}/search")
        return cls(**dfs, search=index.toString() if Store(spark, path).fs.exists(index) else None)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A written table, in the declared column order."""
    sch = schema.ALL[name]
    return spark.read.schema(sch).parquet(path).select(*sch.fieldNames())


# A query's own WITH (and RECURSIVE), after blanks and comments.
_WITH = re.compile(r"(?:\s|--[^\n]*\n|/\*.*?\*/)*WITH\s+(RECURSIVE\s)?", re.I | re.S)


def data_folder(spark: SparkSession, path: str, version: str | None = None) -> str:
    """Folder of a version's datasets (the newest one's by default)."""
    names = Store(spark, path).versions()
    if version is None and not names:
        raise FileNotFoundError(f"no finished version of a store in {path}")
    if version is not None and version not in names:
        raise FileNotFoundError(f"no version {version} in {path}")
    return f"{path.rstrip('/')}/{(version or names[-1]).split('-')[1]}"


class Store:
    """The versions of a table store: empty files ``_versions/<number>-<folder>``."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.base, self.log = path.rstrip("/"), f"{path.rstrip('/')}/_versions"
        self.fs = self.path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Names of the finished versions, oldest first."""
        if not self.fs.exists(self.path(self.log)):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path(self.log))]
        return sorted(n for n in names if re.fullmatch(r"\d{12}-[0-9a-f]{32}", n))

    def next_number(self) -> int:
        names = self.versions()
        return int(names[-1].split("-")[0]) + 1 if names else 1

    def publish(self, version: str) -> None:
        """One file made at once: the version is there, or it is not."""
        if not self.fs.createNewFile(self.path(f"{self.log}/{version}")):
            raise FileExistsError(f"{self.log}/{version}")

    def remove_before(self, number: int) -> None:
        for v in self.versions():
            n, folder = v.split("-")
            if int(n) < number:
                self.fs.delete(self.path(f"{self.log}/{v}"), False)
                self.fs.delete(self.path(f"{self.base}/{folder}"), True)
