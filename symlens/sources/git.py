"""Version-control text as tables: logs, name-status lists and hunks.

A captured log is read in splits by byte offset; its lines are numbered by what
the splits before hold. Git itself runs in tasks: logs through the data source
``git_log``, whose partitions are slices of a root's commits, and files of a base
commit beside the rows that ask for them.
"""

from __future__ import annotations

import contextlib
import json
import subprocess
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from symlens.functions import exprs as E
from symlens.operators.scan import carried_forward
from symlens.sources.tables import settle

#: Lines of a log that times are carried through together.
BLOCK_LINES = 1 << 16
LINE = "root string, line_no long, line string"
STATUS_NAMES = {"A": "added", "D": "deleted", "M": "modified", "R": "renamed", "C": "added"}


def read_log(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(root, line_no, line) of one captured log a root, lines counted from 0.

    Logs are read in as many splits as Spark makes of their files. Lines are
    written with the split they come from and their order in it; a row a split
    then says how many lines come before.
    """
    out = None
    for root, path in paths.items():
        text = spark.read.option("lineSep", "\n").text(path).select(F.lit(root).alias("root"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
        out = text if out is None else out.unionByName(text)
    if out is None:
        return spark.createDataFrame([], LINE)
    lines = settle(out)
    splits = lines.groupBy("root", "file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("root").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = lines.join(splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), ["root", "file", "start"])
    return numbered.select("root", (F.col("before") + F.col("id") - F.col("first")).alias("line_no"), "line")


def count_of(text: Column) -> Column:
    """A count of a numstat row; a dash, anything else that isn't a number, and negatives are 0."""
    return F.greatest(F.coalesce(text.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def parse_numstat(lines: DataFrame) -> DataFrame:
    """(root, line_no, commit_time, path, additions, deletions): a line of digits sets the time of the rows below it.

    The time is carried over blocks of lines, so that a root's log is no one task's.
    """
    row = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    trimmed = F.regexp_replace("line", r"\r$", "")
    time = F.when(trimmed.rlike("^[0-9]+$"), trimmed.cast("long"))
    marked = lines.withColumns({"__line": trimmed, "__time": time})
    dated = carried_forward(marked, ["root"], ["line_no"], F.floor(F.col("line_no") / BLOCK_LINES), "__time", "commit_time")
    part = lambda i: F.regexp_extract("__line", row, i)
    return dated.filter(F.col("__line").rlike(row)).select("root", "line_no", "commit_time", part(3).alias("path"), count_of(part(1)).alias("additions"), count_of(part(2)).alias("deletions"))


def parse_names(lines: DataFrame) -> DataFrame:
    """(root, path) of a name-only log."""
    return lines.select("root", F.regexp_replace("line", r"\r$", "").alias("path")).filter("path <> ''")


def parse_name_status(lines: DataFrame) -> DataFrame:
    """(root, uri, path, repo_path, change_type, old_path): copies count as added, other letters are dropped."""
    status, rest = F.substring("line", 1, 1), F.substring(F.col("line"), F.lit(3), F.length("line"))
    two = r"^[^\t]+\t([^\t]+)\t(.+)$"
    moved = status.isin("R", "C")
    kinds = F.create_map(*[F.lit(x) for kv in STATUS_NAMES.items() for x in kv])
    rows = lines.filter(status.isin(*STATUS_NAMES) & (~moved | rest.rlike(two)))
    rows = rows.select("root", kinds[status].alias("change_type"), F.when(moved, F.regexp_extract(rest, two, 2)).otherwise(rest).alias("repo_path"), F.when(status == "R", F.regexp_extract(rest, two, 1)).alias("old_repo_path"))
    path = F.concat("root", F.lit("/"), "repo_path")
    return rows.select("root", E.file_uri(path).alias("uri"), path.alias("path"), "repo_path", "change_type", F.concat("root", F.lit("/"), "old_repo_path").alias("old_path"), "old_repo_path")


def parse_hunks(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``lines`` that begin with a hunk header, with the new side's ``first`` and ``last`` line from 0; pure deletions are dropped."""
    header = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    n = lambda i: F.coalesce(F.regexp_extract(line_col, header, i).try_cast("long"), F.lit(1))
    found = lines.filter(F.col(line_col).rlike(header)).withColumns({"first": n(1) - 1, "__count": n(2)})
    return found.filter("__count > 0").withColumn("last", F.col("first") + F.col("__count") - 1).drop("__count")


def parse_diff(lines: DataFrame) -> DataFrame:
    """(root, uri, repo_path, first, last) of a diff of many files: a line ``+++ b/path`` names the file of the hunks below it."""
    header = r"^\+\+\+ (?:b/)?([^\t]+)"
    marked = lines.withColumn("__path", F.when(F.col("line").rlike(r"^\+\+\+ (b/|/dev/null)"), F.regexp_extract("line", header, 1)))
    within = carried_forward(marked, ["root"], ["line_no"], F.floor(F.col("line_no") / BLOCK_LINES), "__path", "repo_path")
    rows = parse_hunks(within.filter("repo_path <> '/dev/null'"))
    return rows.select("root", E.file_uri(F.concat("root", F.lit("/"), "repo_path")).alias("uri"), "repo_path", "first", "last")


def run_git(root: str, arguments: Sequence[str]) -> str:
    """A git command's output, for commands whose answer is short."""
    return subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, check=True).stdout


class LogSlice(InputPartition):
    """Commits of a root's log; ``at`` is null where the log can't be had, and ``error`` says why."""

    def __init__(self, root: str, no: int, at: int | None, size: int, error: str | None = None):
        self.root, self.no, self.at, self.size, self.error = root, no, at, size, error


class GitLog(DataSource):
    """Logs of repositories in a folder that all executors see: (root, line_no, line, error).

    Options: ``roots``, a JSON array of paths; ``command``, ``log`` unless it is
    another one whose output is a root's one slice; ``arguments``, a JSON array of
    what follows it; ``commits`` of a slice. The driver asks each root for the
    number of its commits only. A root that fails gives one row, with its
    ``error`` and no line. Line numbers rise within a root and have gaps between
    slices.
    """

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return f"{LINE}, error string"

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options)


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots, self.arguments = json.loads(options["roots"]), json.loads(options.get("arguments", "[]"))
        self.commits, self.command = int(options.get("commits", 10_000)), options.get("command", "log")

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        limits = [a for a in self.arguments if a.startswith(("--since", "--until", "--after", "--before"))]
        for root in self.roots:
            try:
                n = int(run_git(root, ["rev-list", "--count", *limits, "HEAD"]))
            except (OSError, subprocess.CalledProcessError) as e:
                out.append(LogSlice(root, 0, None, 0, (getattr(e, "stderr", None) or str(e)).strip()))
                continue
            starts = range(0, n, self.commits) if self.command == "log" else [0]
            out += [LogSlice(root, no, at, self.commits) for no, at in enumerate(starts)]
        return out or [LogSlice("", 0, 0, 0)]

    def read(self, part: LogSlice) -> Iterator[tuple]:
        if part.at is None:
            yield part.root, None, None, part.error
            return
        if not part.size:
            return
        slice_ = [f"--skip={part.at}", f"--max-count={part.size}"] if self.command == "log" else []
        command = ["git", "-C", part.root, self.command, *self.arguments, *slice_]
        with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace") as run:
            for i, line in enumerate(run.stdout):
                yield part.root, part.no << 40 | i, line.rstrip("\n"), None
        if run.returncode:
            raise RuntimeError(f"git {self.command} of {part.root} failed after it had begun")  # the task is tried again


def log_lines(spark: SparkSession, roots: Sequence[str], arguments: Sequence[str], commits: int = 10_000, command: str = "log") -> DataFrame:
    """(root, line_no, line, error) of ``git log``, or another command, with ``arguments``, read by tasks; see :class:`GitLog`."""
    spark.dataSource.register(GitLog)
    return spark.read.format("git_log").option("command", command).option("roots", json.dumps(list(roots))).option("arguments", json.dumps(list(arguments))).option("commits", commits).load()


def numstat_log(spark: SparkSession, roots: Sequence[str], since: str = "3 months ago") -> DataFrame:
    """The logs of ``roots`` with counts, as :func:`log_lines`."""
    return log_lines(spark, roots, ["--numstat", "--format=%ct", f"--since={since}"])


def diff_of(spark: SparkSession, roots: Sequence[str], arguments: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Changed files, as :func:`parse_name_status`, and their changed ranges, as :func:`parse_diff`, of the diff that ``arguments`` select."""
    text = lambda *flags: log_lines(spark, roots, [*flags, *arguments], command="diff").filter("line IS NOT NULL")
    return parse_name_status(text("--name-status", "--find-renames")), parse_diff(text("--unified=0", "--no-color", "--no-ext-diff"))


def _objects(root: str, names: Sequence[str]) -> Iterator[bytes | None]:
    """What git holds under each name, null where it holds no file; one process, a name at a time."""
    with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        for name in names:
            head = b""
            if "\n" not in name and run.poll() is None:
                try:
                    run.stdin.write(name.encode() + b"\n")
                    run.stdin.flush()
                    head = run.stdout.readline()
                except BrokenPipeError:  # not a repository
                    pass
            found = head.split()[-2:] if head.rstrip().split()[-1:] != [b"missing"] else []
            if len(found) < 2 or not found[1].isdigit():
                yield None
                continue
            body = run.stdout.read(int(found[1]) + 1)[:-1]
            yield body if found[0] == b"blob" else None
        with contextlib.suppress(BrokenPipeError):
            run.stdin.close()


def base_files(files: DataFrame, base: str = "HEAD") -> DataFrame:
    """(root, uri, path, value): what ``files`` (root, path) of a diff, deleted ones above all, held at ``base``.

    Tasks read the files beside the rows that name them, so neither names nor
    texts pass the driver. Files that ``base`` lacks, and roots that aren't
    repositories, have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = sorted((r, p) for r, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if r and p)
            for root in dict.fromkeys(r for r, _ in rows):
                paths = [p for r, p in rows if r == root]
                held = [(root, p, text.decode("utf-8", "replace")) for p, text in zip(paths, _objects(root, [f"{base}:{p}" for p in paths])) if text is not None]
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], pa.string()) for i in range(3)], ["root", "path", "value"])

    found = files.select("root", "path").distinct().mapInArrow(run, "root string, path string, value string")
    return found.select("root", E.file_uri(F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"), F.col("path"))).alias("uri"), "path", "value")
