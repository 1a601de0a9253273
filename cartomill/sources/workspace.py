"""Source trees: files on disk, git, submodules, and neighbouring repositories."""

from __future__ import annotations

import configparser
import json
import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import language_of
from ..functions.lineage import Rounds
from ..operators.predicates import dir_excluded, included

# Folders that are never read; the last is our own.
IGNORED = "node_modules vendor .git dist __pycache__ .next .nuxt coverage .cache .turbo target build .gradle .idea .vscode .vs".split() + [".cartomill"]


@dataclass
class Repo:
    name: str
    path: str


@dataclass
class Config:
    """What is scanned. User patterns come first, then the defaults they lack."""

    repos: list[Repo] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=lambda: list(IGNORED))
    languages: dict[str, list[str]] = field(default_factory=dict)
    version: int = 1

    @classmethod
    def load(cls, path: str) -> "Config":
        with open(path) as f:
            raw = json.load(f)
        settings = raw.get("settings", {})
        return cls([Repo(r["name"], r["path"]) for r in raw.get("repos", [])], settings.get("include", []), list(dict.fromkeys([*settings.get("exclude", []), *IGNORED])), {k: v["extensions"] for k, v in raw.get("languages", {}).items()}, raw.get("version", 1))

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"version": self.version, "repos": [vars(r) for r in self.repos], "languages": {k: {"extensions": v} for k, v in self.languages.items()}, "settings": {"include": self.include, "exclude": self.exclude}}, f, indent=2)


def listed(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """path, size_bytes, modified of all files of a tree, without hidden and ignored names, excluded folders, and nested
    repositories that the configuration does not name.

    Tasks list folders, one level of the tree a round, and see all names; a folder that is left out is not listed.
    """
    own = {os.path.normpath(r.path) for r in config.repos}
    skipped = frozenset(IGNORED)
    parallel = spark.sparkContext.defaultParallelism

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch["path"].to_pylist():
                place = f"{base.rstrip('/')}/{folder}".rstrip("/") or "/"
                try:
                    entries = store.get_file_info(pyarrow.fs.FileSelector(place))
                except OSError:
                    continue  # unreadable, or gone meanwhile
                if folder and folder not in own and any(e.base_name == ".git" for e in entries):
                    continue
                rows = []
                for e in sorted(entries, key=lambda e: e.base_name):
                    if e.base_name.startswith(".") or e.base_name in skipped or isinstance(store, pyarrow.fs.LocalFileSystem) and os.path.islink(e.path):
                        continue
                    rows.append((f"{folder}/{e.base_name}".lstrip("/"), e.type == pyarrow.fs.FileType.Directory, e.size or 0, e.mtime))
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")))], names=["path", "folder", "size_bytes", "modified"])

    found = Rounds(spark, "path string, folder boolean, size_bytes long, modified timestamp")
    found.add(spark.createDataFrame([("", True, 0, None)], found.schema))
    while not (folders := found.last().where(F.col("folder") & ((F.col("path") == "") | ~dir_excluded("path", config.exclude))).select("path")).isEmpty():
        found.add(folders.repartition(parallel).mapInArrow(f, found.schema))
    return found.all().where("NOT folder").select("path", "size_bytes", "modified")


def texts_of(files: DataFrame, root: str) -> DataFrame:
    """files (path, size_bytes) with content, read in tasks of about 64 MB; files that cannot be read are left out."""
    spark = files.sparkSession

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            for i, path in enumerate(batch["path"].to_pylist()):
                try:
                    with store.open_input_file(f"{base.rstrip('/')}/{path}") as g:
                        content = g.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary())], names=[*batch.schema.names, "content"])

    total = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    spread = files.repartition(max(spark.sparkContext.defaultParallelism, total >> 26))
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in files.schema)
    return spread.mapInArrow(f, f"{fields}, content binary")


def walk_files(spark: SparkSession, root: str, repo: str, config: Config | None = None) -> DataFrame:
    """path, repo, language, size_bytes, lines, content_hash, text of a tree's source files.

    What listed() leaves out, paths that the configuration excludes, and files of unknown language are never opened.
    """
    config = config or Config()
    kept = listed(spark, root, config).where(included("path", config.include, config.exclude)).withColumn("language", language_of("path", config.languages)).where("language IS NOT NULL")
    rows = texts_of(kept, root).withColumn("text", F.decode("content", "UTF-8"))
    return rows.select("path", F.lit(repo).alias("repo"), "language", "size_bytes", F.size(F.split("text", "\n", -1)).cast("long").alias("lines"), F.md5("content").alias("content_hash"), "modified", "text")


MANIFESTS = "package.json composer.json Gemfile requirements.txt pyproject.toml Pipfile setup.py".split()


def project_files(spark: SparkSession, root: str, repo: str, config: Config | None = None) -> DataFrame:
    """repo, path, text of all files of a tree, whatever their language; the text only of manifests, and null for others,
    which are listed and not read."""
    config = config or Config()
    every = listed(spark, root, config).where(included("path", config.include, config.exclude))
    texts = texts_of(every.where(F.element_at(F.split("path", "/"), -1).isin(MANIFESTS)), root).select("path", F.decode("content", "UTF-8").alias("text"))
    return every.select("path").join(texts, "path", "left").select(F.lit(repo).alias("repo"), "path", "text")


def stale_files(files: DataFrame, on_disk: DataFrame) -> DataFrame:
    """path of files (path, last_scanned) that are gone, or newer on disk (path, modified)."""
    joined = files.join(on_disk.select("path", "modified"), "path", "left")
    return joined.where("modified IS NULL OR modified > last_scanned").select("path", F.when(F.col("modified").isNull(), "missing").otherwise("modified").alias("reason"))


def git(root: str, *args: str) -> str | None:
    """What git says, or None where it fails."""
    found = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    return found.stdout if found.returncode == 0 else None


def is_git(root: str) -> bool:
    return git(root, "rev-parse", "--is-inside-work-tree") is not None


def git_head(root: str) -> str | None:
    return (git(root, "rev-parse", "HEAD") or "").strip() or None


def git_prev(root: str) -> str | None:
    return (git(root, "rev-parse", "HEAD~1") or "").strip() or None


def repo_name(root: str) -> str:
    """The remote's last part, or the folder's name."""
    url = (git(root, "config", "--get", "remote.origin.url") or "").strip()
    return os.path.basename(url or os.path.abspath(root)).removesuffix(".git")


def parsed_tree(listing: str) -> list[tuple[str, str]]:
    """path, hash of `git ls-tree -r`."""
    rows = [line.split("\t", 1) for line in listing.splitlines() if "\t" in line]
    return [(path, meta.split()[2]) for meta, path in rows if meta.split()[1] == "blob"]


STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied"}


def parsed_changes(listing: str) -> list[tuple[str, str]]:
    """path, status of `git diff --name-status`; of a renamed file the new path."""
    rows = [line.split("\t") for line in listing.splitlines() if "\t" in line]
    return [(parts[-1], STATUS.get(parts[0][:1], "modified")) for parts in rows]


def git_blob_hashes(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(parsed_tree(git(root, "ls-tree", "-r", "HEAD") or ""), "path string, hash string")


def git_changes(spark: SparkSession, root: str, since: str = "HEAD") -> DataFrame:
    """path, status of what changed since a commit, or is staged; of both, the first counts."""
    found: dict[str, str] = {}
    for args in (("diff", "--name-status", since), ("diff", "--name-status", "--cached")):
        for path, status in parsed_changes(git(root, *args) or ""):
            found.setdefault(path, status)
    return spark.createDataFrame(list(found.items()), "path string, status string")


def parsed_submodules(text: str) -> list[tuple[str, str, str]]:
    """name, path, url of a .gitmodules text; sections without a path are left out."""
    ini = configparser.ConfigParser(interpolation=None, strict=False)
    ini.read_string("\n".join(line.strip() for line in text.splitlines()))
    return [(s.split('"')[1], ini[s]["path"], ini[s].get("url", "")) for s in ini.sections() if s.startswith("submodule ") and "path" in ini[s]]


def submodules(spark: SparkSession, root: str) -> DataFrame:
    path = os.path.join(root, ".gitmodules")
    text = open(path).read() if os.path.exists(path) else ""
    return spark.createDataFrame(parsed_submodules(text), "name string, path string, url string")


def peer_repos(root: str) -> list[str]:
    """Folders beside this one that are repositories."""
    top = os.path.dirname(os.path.abspath(root))
    return sorted(p for n in os.listdir(top) if os.path.isdir(os.path.join(p := os.path.join(top, n), ".git")) and p != os.path.abspath(root))


def vscode_folders(spark: SparkSession, path: str) -> DataFrame:
    """path of the folders of a workspace file."""
    return spark.read.schema("folders array<struct<path:string>>").option("multiLine", "true").json(path).select(F.explode("folders.path").alias("path"))
