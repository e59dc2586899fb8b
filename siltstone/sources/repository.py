"""Working trees and their history. The tree is listed on the driver, its files are read by the executors."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.config import HOME
from siltstone.sources.ignore import Matcher

#: Larger files aren't indexed; a zero byte among the first ones says that a file isn't text.
MOST_BYTES, PROBE = 500 * 1024, 8192
IGNORE_FILE = ".siltstoneignore"


class NotARepository(RuntimeError):
    pass


def _git(root: str | Path, *args: str) -> str:
    try:
        return subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, check=True).stdout
    except subprocess.CalledProcessError as e:
        raise NotARepository(e.stderr.strip()) from e


def repo_root(folder: str | Path) -> str:
    for p in [Path(folder).resolve(), *Path(folder).resolve().parents]:
        if (p / ".git").exists():
            return str(p)
    raise NotARepository(f"{folder} is in no repository")


def head_commit(root: str | Path) -> str:
    return _git(root, "rev-parse", "HEAD").strip()


def current_branch(root: str | Path) -> str:
    """Its short name, or 12 digits of the commit where no branch is checked out."""
    name = _git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()
    return head_commit(root)[:12] if name == "HEAD" else name


def list_branches(root: str | Path) -> list[str]:
    return sorted(_git(root, "for-each-ref", "--format=%(refname:short)", "refs/heads").split())


def ignore_matcher(root: str | Path, extra: list[str] = ()) -> Matcher:
    """Global rules, then .gitignore files from the root down, then the index's own file, then the caller's; later ones win."""
    m = Matcher()
    try:
        path = _git(root, "config", "--path", "core.excludesFile").strip()
    except NotARepository:
        path = str(Path(os.environ.get("XDG_CONFIG_HOME", Path.home() / ".config")) / "git/ignore")
    if path and Path(path).is_file():
        m.add(Path(path).read_text(errors="replace").splitlines())
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n not in (".git", HOME))
        if ".gitignore" in files:
            at = Path(folder).relative_to(root).as_posix()
            m.add((Path(folder) / ".gitignore").read_text(errors="replace").splitlines(), "" if at == "." else at)
    if (Path(root) / IGNORE_FILE).is_file():
        m.add((Path(root) / IGNORE_FILE).read_text(errors="replace").splitlines())
    m.add(list(extra))
    return m


def walk_files(root: str | Path, extra: list[str] = ()) -> list[str]:
    """Sorted paths of what can be indexed: regular text files of up to MOST_BYTES that no rule ignores."""
    m = ignore_matcher(root, extra)
    out = []
    for folder, names, files in os.walk(root):
        at = Path(folder).relative_to(root).as_posix()
        inside = lambda n: n if at == "." else f"{at}/{n}"  # noqa: B023, E731
        names[:] = [n for n in names if n not in (".git", HOME) and not os.path.islink(os.path.join(folder, n)) and not m.ignored(inside(n), True)]
        for n in files:
            p = os.path.join(folder, n)
            if os.path.islink(p) or not os.path.isfile(p) or os.path.getsize(p) > MOST_BYTES or m.ignored(inside(n)):
                continue
            with open(p, "rb") as f:
                if b"\0" not in f.read(PROBE):
                    out.append(inside(n))
    return sorted(out)


def _binary(root: str | Path, shas: list[str]) -> set[str]:
    """Those of the objects that have a zero byte among the first ones; each has MOST_BYTES at most, and one is in memory at a time."""
    out: set[str] = set()
    if not shas:
        return out
    with subprocess.Popen(["git", "-C", str(root), "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
        for sha in shas:
            p.stdin.write(sha.encode() + b"\n")
            p.stdin.flush()
            size = int(p.stdout.readline().split()[2])
            if b"\0" in p.stdout.read(size + 1)[: min(PROBE, size)]:
                out.add(sha)
        p.stdin.close()
    return out


def diff_files(root: str | Path, old: str, new: str) -> tuple[list[str], list[str], list[str]]:
    """Added, modified and deleted files between two commits. A rename is both; from no commit all files are added that a walk would take."""
    if not old.strip("0"):
        m = ignore_matcher(root)
        listed = _git(root, "ls-tree", "-r", "-l", "-z", new).split("\0")
        rows = [(x.split("\t", 1)[1], *x.split("\t", 1)[0].split()) for x in listed if x]
        blobs = {p: sha for p, mode, _, sha, size in rows if mode.startswith("100") and int(size) <= MOST_BYTES and not m.ignored(p)}
        binary = _binary(root, sorted(set(blobs.values())))
        return sorted(p for p, sha in blobs.items() if sha not in binary), [], []
    parts = _git(root, "diff-tree", "-r", "-z", "--no-renames", "--name-status", old, new).split("\0")
    by: dict[str, list[str]] = {"A": [], "M": [], "D": []}
    for status, path in zip(parts[::2], parts[1::2], strict=False):
        by["M" if status == "T" else status].append(path)
    return sorted(by["A"]), sorted(by["M"]), sorted(by["D"])


def read_listed(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """file_path, content, file_hash (of the raw bytes) of listed files, read by the executors, who must see the folder.

    Spark's own file readers pass over names that begin with a dot or an underscore, so these aren't used here.
    """
    base = str(Path(root).resolve())
    schema = pa.schema([("file_path", pa.string()), ("content", pa.binary())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):  # 64 files of MOST_BYTES at once
                names = b.column(0).slice(i, 64).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([(Path(base) / n).read_bytes() for n in names], pa.binary())], schema=schema)

    if not paths:
        return spark.createDataFrame([], "file_path string, content binary, file_hash string")
    listed = spark.createDataFrame([(p,) for p in paths], "file_path string")
    return listed.mapInArrow(read, "file_path string, content binary").withColumn("file_hash", F.sha2("content", 256))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """The same of a whole tree on any file system that Spark reads, without git's rules: size and text filters are pushed to the reader."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MOST_BYTES)
    text = read.where(F.instr(F.decode(F.substring("content", 1, PROBE), "ISO-8859-1"), "\0") == 0)
    return text.select(F.col("path").alias("file_path"), "content", F.sha2("content", 256).alias("file_hash"))
