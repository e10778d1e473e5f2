"""A data source over git repositories: commits with changed files, trees and blobs.

``spark.dataSource.register(GitSource)``, then ``spark.read.format("plumb_git")`` with ``repos`` (name=path
pairs, comma-separated), ``table`` (commits, tree, blobs or diffs) and, for commits, ``limit``, ``since``
and ``rev`` (or ``revs``, name=rev pairs).  Each repository is a partition; output is streamed from the git process.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from itertools import takewhile

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD, FIELD = "\x1e", "\x1f"
FORMAT = f"{RECORD}%H{FIELD}%P{FIELD}%ct{FIELD}%s"
SCHEMAS = {
    "commits": "repo string, sha string, parents array<string>, committed_at long, subject string, files array<struct<status:string,path:string,old_path:string,blob_before:string,blob_after:string>>",
    "tree": "repo string, sha string, committed_at long, path string",
    "blobs": "repo string, sha string, path string, text string",
    "diffs": "repo string, sha string, path string, diff string",
}


def safe_name(slug: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "__", slug)


#: Paths come as they are, whatever letters they hold.
GIT = ("git", "-c", "core.quotePath=false")


def git(path: str, *args: str) -> str:
    done = subprocess.run([*GIT, "-C", path, *args], capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace")


def blobs(path: str, sha: str, names: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(name, text) of files over one pipe, a question and its answer at a time; what is no file of that tree is left out."""
    with subprocess.Popen([*GIT, "-C", path, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:
        for name in names:
            if "\n" in name:  # the pipe asks by lines
                yield name, git(path, "show", f"{sha}:{name}")
                continue
            run.stdin.write(f"{sha}:{name}\n".encode())
            run.stdin.flush()
            head = run.stdout.readline().split()
            if not head:
                raise RuntimeError(f"git cat-file ended in {path}")
            if len(head) == 3 and head[2].isdigit():
                text = run.stdout.read(int(head[2]) + 1)[:-1]
                if head[1] == b"blob":
                    yield name, text.decode("utf-8", "replace")
        run.stdin.close()


def diffs(path: str, limit: int | None, since: str | None, rev: str) -> Iterator[tuple[str, str, str]]:
    """(sha, path, diff) of every file of commits with one parent, from one log with patches."""
    args = [*GIT, "-C", path, "log", "--no-merges", "-p", "-U0", "--no-color", "--no-ext-diff", "-M", f"--format={RECORD}%H{FIELD}%P"]
    args += [f"-n{limit}"] * bool(limit) + [f"--since={since}"] * bool(since) + [rev]
    with subprocess.Popen(args, stdout=subprocess.PIPE) as run:
        sha, parents, held = "", [], []

        def done() -> Iterator[tuple[str, str, str]]:
            if held and len(parents) == 1:
                head = list(takewhile(lambda x: not x.startswith("@@"), held))  # changed lines may look like headers
                names = [x[6:].rstrip("\n").rstrip("\t") for x in head if x.startswith(("--- a/", "+++ b/"))][-1:]
                names = names or [x.split(" to ", 1)[1].rstrip("\n") for x in head if x.startswith("rename to ")] or [held[0].rstrip("\n").rpartition(" b/")[2]]
                yield sha, names[0], "".join(held)

        for raw in run.stdout:
            line = raw.decode("utf-8", "replace")
            if line.startswith(RECORD):
                yield from done()
                sha, _, rest = line[1:].rstrip("\n").partition(FIELD)
                parents, held = rest.split(), []
            elif line.startswith("diff --git "):
                yield from done()
                held = [line]
            elif held:
                held.append(line)
        yield from done()
    if run.returncode:
        raise RuntimeError(f"git log failed in {path}")


def raw_line(line: str) -> dict | None:
    """One line of raw diff output; renames and copies have two paths."""
    head, _, tail = line.partition("\t")
    if not head.startswith(":"):
        return None
    _, _, before, after, status = head[1:].split(" ")
    names = tail.split("\t")
    return {"status": status[:1], "path": names[-1], "old_path": names[0] if len(names) > 1 else None, "blob_before": before, "blob_after": after}


def record(text: str) -> tuple | None:
    """(sha, parents, committed_at, subject, files) of a log record."""
    head, _, body = text.partition("\n")
    fields = head.split(FIELD)
    if len(fields) != 4:
        return None
    files = [f for x in body.split("\n") if (f := raw_line(x))]
    return fields[0], fields[1].split(), int(fields[2]), fields[3], files


def log(path: str, limit: int | None, since: str | None, rev: str) -> Iterator[tuple]:
    """Records newest first, merges left out, renames detected; lines are read as git writes them."""
    args = [*GIT, "-C", path, "log", "--no-merges", "--raw", "--no-abbrev", "-M", f"--format={FORMAT}"]
    args += [f"-n{limit}"] * bool(limit) + [f"--since={since}"] * bool(since) + [rev]
    with subprocess.Popen(args, stdout=subprocess.PIPE) as run:
        held: list[str] = []
        for raw in run.stdout:
            line = raw.decode("utf-8", "replace")
            if line.startswith(RECORD) and held:
                if found := record("".join(held)[1:]):
                    yield found
                held = []
            held.append(line)
        if held and (found := record("".join(held)[1:])):
            yield found
    if run.returncode:
        raise RuntimeError(f"git log failed in {path}")


class Repo(InputPartition):
    def __init__(self, name: str, path: str):
        super().__init__(name)
        self.name, self.path = name, path


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Repo]:
        return [Repo(*pair.split("=", 1)) for pair in self.options["repos"].split(",")]

    def read(self, part: Repo) -> Iterator[tuple]:
        kind, rev = self.options.get("table", "commits"), self.options.get("rev", "HEAD")
        rev = dict(p.split("=", 1) for p in self.options.get("revs", "").split(",") if p).get(part.name, rev)
        limit = int(self.options["limit"]) if "limit" in self.options else None
        if kind == "commits":
            for sha, parents, at, subject, files in log(part.path, limit, self.options.get("since"), rev):
                yield part.name, sha, parents, at, subject, [tuple(f.values()) for f in files]
            return
        if kind == "diffs":
            for found in diffs(part.path, limit, self.options.get("since"), rev):
                yield part.name, *found
            return
        sha, at = git(part.path, "log", "-1", "--format=%H %ct", rev).split()
        names = (p for p in git(part.path, "ls-tree", "-r", "-z", "--name-only", sha).split("\0") if p)
        if kind == "tree":
            yield from ((part.name, sha, int(at), name) for name in names)
        else:
            yield from ((part.name, sha, name, text) for name, text in blobs(part.path, sha, names))


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plumb_git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)
