"""Sources and sinks: manifests, admission, golden sets and chains, chunk transfer, snapshots."""

from __future__ import annotations

import json
import re
import subprocess
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import blob_sha, extension, matches_any

# What is never indexed, what is, and limits of size and of mean line length.
DENY = (
    "**/.env", "**/.env.*", "**/*.pem", "**/*.key", "**/*.p12", "**/*.pfx", "**/id_rsa*", "**/credentials*", "**/secrets/**",
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/out/**", "**/.next/**", "**/.turbo/**", "**/coverage/**", "**/vendor/**", "**/__generated__/**",
    "**/*.min.js", "**/*.map", "**/*.lock", "**/package-lock.json", "**/pnpm-lock.yaml", "**/yarn.lock", "**/*.d.ts", "**/CHANGELOG.md",
)
EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "md", "mdx", "markdown")
MOST_BYTES, LINE_CODE, LINE_PROSE = 1024 * 1024, 200, 2000


def admitted(path: Column, extra: tuple[str, ...] = ()) -> Column:
    return extension(path).isin(*EXTENSIONS) & ~matches_any(path, (*DENY, *extra))


def refusal(text: Column, size: Column, path: Column) -> Column:
    """Why a file's content is not indexed, or null: large, binary or minified."""
    limit = F.when(path.rlike(r"(?i)\.(md|mdx|markdown)$"), LINE_PROSE).otherwise(LINE_CODE)
    mean = F.length(text) / F.size(F.split(text, "\n"))
    return F.when(size > MOST_BYTES, "large").when(F.instr(text, "\0") > 0, "binary").when(mean > limit, "minified")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha) of tracked files by git's index, without reading them, and of untracked ones not ignored."""
    listed = subprocess.run(["git", "-C", root, "ls-files", "-s", "-z"], capture_output=True, check=True).stdout.decode()
    rows = [(x.split("\t", 1)[1], x.split()[1]) for x in listed.split("\0") if x]
    new = subprocess.run(["git", "-C", root, "ls-files", "-o", "--exclude-standard", "-z"], capture_output=True, check=True).stdout.decode()
    names = [x for x in new.split("\0") if x]
    if names:
        hashed = subprocess.run(["git", "-C", root, "hash-object", "--stdin-paths"], input="\n".join(f"{root}/{n}" for n in names), capture_output=True, text=True, check=True).stdout.split()
        rows += list(zip(names, hashed, strict=True))
    return spark.createDataFrame(rows, "path string, sha string")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha, size, text) of a folder's files up to the size limit, with git's object id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MOST_BYTES)
    path = F.regexp_replace("path", rf"^(?:[a-z]+:/*)?{re.escape(root.rstrip('/').lstrip('/'))}/", "")
    return files.select(F.regexp_replace(path, "^/+", "").alias("path"), blob_sha(F.col("content")).alias("sha"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def head_commit(root: str) -> str | None:
    got = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True)
    return got.stdout.strip() if got.returncode == 0 else None


def deletions(spark: SparkSession, root: str, depth: int = 500) -> DataFrame:
    """(path, ordinal, ref): files deleted in the last commits; ref is the deleting commit's parent."""
    log = subprocess.run(["git", "-C", root, "log", f"-n{depth}", "--diff-filter=D", "--name-only", "--format=%x01%H", "--no-renames"], capture_output=True, text=True, check=True).stdout
    rows = [(p, n, f"{block.splitlines()[0]}^") for n, block in enumerate(log.split("\x01")[1:]) for p in block.splitlines()[1:] if p]
    return spark.createDataFrame(rows, "path string, ordinal int, ref string")


def show_file(root: str, ref: str, path: str) -> str | None:
    got = subprocess.run(["git", "-C", root, "show", f"{ref}:{path}"], capture_output=True)
    return got.stdout.decode("utf-8", "replace") if got.returncode == 0 else None


class Sealed(RuntimeError):
    """A holdout set was opened without saying so."""


def golden(spark: SparkSession, path: str, unseal: bool = False) -> DataFrame:
    """(q, expect) from JSON lines; lines that start with // are notes. Holdout sets are sealed."""
    if re.search("(?i)holdout", path) and not unseal:
        raise Sealed(path)
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("//"))
    return lines.select(F.from_json("value", "q string, expect array<string>").alias("r")).select("r.*")


def chains(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("//"))
    return lines.select(F.from_json("value", "intent string, calls int, queries array<string>, answer string, symbol string, transcript string").alias("r")).select("r.*")


def write_exchange(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def read_exchange(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("h string, e string, r string, t int, m string, v string").json(path)


class Conflict(RuntimeError):
    """Another commit changed a table that this one was made from."""


class Snapshots:
    """Tables as immutable snapshot folders, and numbered pointer files over all of them; the highest is current.

    A commit writes its tables and then creates the next pointer, which must not be there yet: readers see
    the old state or the new one, a crash leaves the old one, and of two commits at once the second is put
    on top of the first, or is a ``Conflict`` if both change one table. Files go through Hadoop's file
    system, so any store that Spark reaches and that creates a file only if it is absent will do.
    ``vacuum`` deletes what the current pointer does not name.
    """

    VERSION = 1

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted((int(n.removeprefix("CURRENT-")) for n in names if re.fullmatch(r"CURRENT-[0-9]{12}", n)), reverse=True)

    def _current(self) -> tuple[int, dict[str, str]]:
        """Number and tables of the highest pointer that is written out; an unfinished one ends without its brace."""
        for n in self._pointers():
            held = "".join(r[0] for r in self.spark.read.text(f"{self.root}/CURRENT-{n:012d}").collect())
            if held.endswith("}"):
                found = json.loads(held)
                if found["version"] > self.VERSION:
                    raise RuntimeError(f"the store has version {found['version']}, newer than {self.VERSION}")
                return n, found["tables"]
        return 0, {}

    def tables(self) -> dict[str, str]:
        """Table -> snapshot folder."""
        return self._current()[1]

    def read(self, name: str, schema: str) -> DataFrame:
        now = self.tables().get(name)
        return self.spark.createDataFrame([], schema) if now is None else self.spark.read.schema(schema).parquet(f"{self.root}/{now}")

    def commit(self, new: dict[str, DataFrame]) -> None:
        """All given tables in one step; the others stay as they are."""
        base = self.tables()
        made = {}
        for name, df in new.items():
            made[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{made[name]}")
        while True:
            n, now = self._current()
            if any(now.get(name) != base.get(name) for name in made):
                raise Conflict(", ".join(made))
            if self._point(max([n, *self._pointers()]) + 1, {**now, **made}):
                return

    def _point(self, n: int, tables: dict[str, str]) -> bool:
        """Create pointer n; False if another commit has."""
        at = self._path(f"{self.root}/CURRENT-{n:012d}")
        try:
            out = self._fs.create(at, False)
        except Py4JJavaError:
            if self._fs.exists(at):
                return False
            raise
        out.write(bytearray(json.dumps({"version": self.VERSION, "tables": tables}).encode()))
        out.close()
        return True

    def vacuum(self) -> int:
        """Delete what the current pointer does not name; only when nobody reads or writes it."""
        n, tables = self._current()
        kept, gone = {*tables.values(), f"CURRENT-{n:012d}"}, 0
        for f in self._fs.listStatus(self._path(self.root)):
            if f.getPath().getName() not in kept:
                self._fs.delete(f.getPath(), True)
                gone += 1
        return gone
