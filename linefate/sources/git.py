"""A git repository's first-parent history as DataFrames, read with the plain git command and never written."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COMMITS = "ord long, sha string, authored_at long, committed_at long, parents array<string>, is_merge boolean, message string, truncated boolean"
TREE = "ord long, path string, content_id string"


def run(repo: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, "--no-optional-locks", *args], input=data, capture_output=True, check=True).stdout


def repository_root(path: str) -> str | None:
    """The nearest folder at or above ``path`` that holds .git."""
    at = Path(path).resolve()
    return next((str(p) for p in (at, *at.parents) if (p / ".git").exists()), None)


def history(repo: str) -> list[tuple[str, bool]]:
    """(sha, truncated) of first parents, oldest first; truncated if a shallow clone ends before the root. Unborn: empty."""
    try:
        run(repo, "rev-parse", "--verify", "-q", "HEAD")
    except subprocess.CalledProcessError:
        return []
    shas = run(repo, "rev-list", "--first-parent", "--reverse", "HEAD").decode().split()
    shallow = run(repo, "rev-parse", "--is-shallow-repository").decode().strip() == "true"
    return [(sha, shallow and k == 0) for k, sha in enumerate(shas)]


class GitSource(DataSource):
    """``spark.read.format("linefate_git").option("path", …).option("table", "commits" | "tree")``."""

    @classmethod
    def name(cls) -> str:
        return "linefate_git"

    def schema(self) -> str:
        return TREE if self.options.get("table", "commits") == "tree" else COMMITS

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options["path"], self.options.get("table", "commits"))


class Range(InputPartition):
    def __init__(self, start: int, shas: list[tuple[str, bool]]) -> None:
        self.start, self.shas = start, shas


class GitReader(DataSourceReader):
    """One partition for each thousand commits; the chain itself is walked once."""

    def __init__(self, repo: str, table: str, size: int = 1000) -> None:
        self.repo, self.table, self.size = repo, table, size

    def partitions(self) -> list[Range]:
        chain = history(self.repo)
        return [Range(k, chain[k : k + self.size]) for k in range(0, len(chain), self.size)] or [Range(0, [])]

    def read(self, part: Range):
        for k, (sha, truncated) in enumerate(part.shas):
            if self.table == "tree":
                for row in run(self.repo, "ls-tree", "-r", "-z", "--full-tree", sha).split(b"\0"):
                    head, _, name = row.partition(b"\t")
                    mode = head[:6]
                    if mode in (b"100644", b"100755"):
                        try:
                            yield part.start + k, name.decode(), head.split()[2].decode()
                        except UnicodeDecodeError:
                            continue
            else:
                fields = run(self.repo, "show", "-s", "--format=%at%x00%ct%x00%P%x00%B", sha).decode("utf-8", "replace").split("\0", 3)
                parents = fields[2].split()
                yield part.start + k, sha, int(fields[0]), int(fields[1]), parents, len(parents) > 1, fields[3].rstrip("\n"), truncated


def blobs(spark: SparkSession, repo: str, tree: DataFrame) -> DataFrame:
    """(content_id, content) of the distinct contents of ``tree``, read in batches of one git process."""

    def read(batches):
        import pandas as pd

        for pdf in batches:
            ids = pdf["content_id"].tolist()
            out, at, rows = run(repo, "cat-file", "--batch", data="\n".join(ids).encode() + b"\n"), 0, []
            for content_id in ids:
                end = out.index(b"\n", at)
                size = int(out[at:end].split()[2])
                rows.append((content_id, out[end + 1 : end + 1 + size]))
                at = end + size + 2
            yield pd.DataFrame(rows, columns=["content_id", "content"])

    return tree.select("content_id").distinct().mapInPandas(read, "content_id string, content binary")


def load(spark: SparkSession, repo: str, table: str) -> DataFrame:
    spark.dataSource.register(GitSource)
    return spark.read.format("linefate_git").option("path", repo).option("table", table).load()
