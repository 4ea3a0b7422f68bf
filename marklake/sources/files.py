"""Files as records and records as files (IO1-IO11, IO18, IO20, W9).

Listings run where the session's file system is reached by the driver; contents are read by the executors with
`binaryFile`. Names that Spark hides (leading underscore) come back through a listing of their own.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.functions import frontmatter as fm
from marklake.functions import predicates, values


def list_files(root: str, recursive: bool = True, extensions: tuple[str, ...] | None = ("md", "markdown"), exclude: list[str] = (), include_non_md: bool = False, hidden: bool = False) -> list[str]:
    """Paths below a local root, sorted by bytes; hidden names and excluded paths are left out (IO1, IO2, IO7, IO8, W1, W9)."""
    import re

    rules = [re.compile(predicates.exclude_glob(p if p.startswith("/") else f"{root.rstrip('/')}/{p}").replace(r"\z", r"\Z")) for p in exclude]
    wrapped = {e for _, _, es in fm.SYNTAXES.values() for e in es}
    wanted = None if extensions is None else {e.lower() for e in extensions} | ({"txt"} | wrapped if include_non_md else set())
    out = []
    for top, folders, names in os.walk(root):
        if not hidden:
            folders[:] = [f for f in folders if not f.startswith(".")]
        if not recursive:
            folders.clear()
        for name in names:
            path = os.path.join(top, name)
            ext = name.rpartition(".")[2].lower() if "." in name else ""
            if (hidden or not name.startswith(".")) and (wanted is None or ext in wanted) and not any(r.search(path) for r in rules):
                out.append(path)
    return sorted(out)


def expand(paths: list[str], **options) -> list[str]:
    """Files and folders to files; a single source file that is named outright is taken, an unmapped one is an error (IO3)."""
    out: list[str] = []
    wrapped = {e for _, _, es in fm.SYNTAXES.values() for e in es}
    for p in paths:
        if os.path.isdir(p):
            out += list_files(p, **options)
        elif os.path.exists(p):
            ext = p.rpartition(".")[2].lower()
            if ext not in {*fm.MARKDOWN, "txt", *wrapped}:
                raise ValueError(f"no frontmatter syntax for .{ext}")
            out.append(p)
        else:
            raise FileNotFoundError(p)
    return sorted(dict.fromkeys(out))


def read(spark: SparkSession, root: str, pattern: str = "*.{md,markdown}") -> DataFrame:
    """Records below a root: path (relative), content, modification_ts, length, revision (IO4, IO9). A distributed scan."""
    base = root.rstrip("/") + "/"
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), "^" + _quote(base), "")
    return d.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modification_ts"), "length", F.sha2("content", 256).alias("revision")).filter(~F.col("path").rlike(r"(^|/)\."))


def _quote(text: str) -> str:
    import re

    return re.escape(text)


def read_listed(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The same for a listing, with names that Spark's own scan hides; executors open the files themselves."""
    base = root.rstrip("/") + "/"

    def load(frames):
        import hashlib

        import pandas as pd

        for f in frames:
            rows = []
            for p in f["file"]:
                with open(p, "rb") as h:
                    raw = h.read()
                rows.append((p.removeprefix(base), raw.decode("utf-8", "replace"), pd.Timestamp(int(os.path.getmtime(p) * 1e6), unit="us"), len(raw), hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "content", "modification_ts", "length", "revision"])

    listed = spark.createDataFrame([(p,) for p in paths], "file string")
    return listed.mapInPandas(load, "path string, content string, modification_ts timestamp, length bigint, revision string")


def from_text(spark: SparkSession, text: str, path: str | None = None) -> DataFrame:
    """One record of a text, as from standard input (IO20)."""
    return spark.createDataFrame([(path, text)], "path string, content string")


def write(records: DataFrame, root: str, expected: str | None = None) -> DataFrame:
    """Writes content under root, each file whole or not at all (IO5); path, status.

    expected names a column with the sha-256 that a file must still have: another content is a revisionMismatch (IO6).
    A task that runs again writes the same bytes again.
    """
    base = root.rstrip("/")
    columns = ["path", "content"] + ([expected] if expected else [])

    def put(frames):
        import hashlib
        import tempfile

        import pandas as pd

        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                target = f"{base}/{row[0]}"
                if not valid_path(row[0]):
                    out.append((row[0], "invalidPath"))
                    continue
                if expected:
                    found = None
                    if os.path.exists(target):
                        with open(target, "rb") as h:
                            found = hashlib.sha256(h.read()).hexdigest()
                    if found != row[2] and found != hashlib.sha256(row[1].encode()).hexdigest():
                        out.append((row[0], "revisionMismatch"))
                        continue
                os.makedirs(os.path.dirname(target), exist_ok=True)
                handle, temporary = tempfile.mkstemp(dir=os.path.dirname(target), prefix=".write-")
                with os.fdopen(handle, "wb") as h:
                    h.write(row[1].encode())
                os.replace(temporary, target)
                out.append((row[0], "written"))
            yield pd.DataFrame(out, columns=["path", "status"])

    return records.select(*columns).mapInPandas(put, "path string, status string")


def valid_path(path: str) -> bool:
    """Logical paths: relative, with forward slashes, without empty, . and .. segments; a leading ./ is dropped."""
    path = path.removeprefix("./")
    return bool(path) and not path.startswith("/") and "\\" not in path and all(p not in ("", ".", "..") for p in path.split("/"))


def path_error(path):
    """Error code of a logical path as a Column, or null."""
    p = F.regexp_replace(path, r"^\./", "")
    parts = F.split(p, "/", -1)
    return F.when(p == "", "empty").when(p.startswith("/"), "absolute").when(p.contains("\\"), "backslash").when(p.endswith("/"), "trailing-slash").when(F.exists(parts, lambda x: x == ""), "empty-segment").when(F.exists(parts, lambda x: x.isin(".", "..")), "dot-segment")


def confined(root: str, relative: str) -> str:
    """Real path of a resource that must lie below root, also after links are followed (IO9, IO11)."""
    if not valid_path(relative.removeprefix("./")):
        raise ValueError(f"path leaves the project: {relative}")
    top, full = os.path.realpath(root), os.path.realpath(os.path.join(root, relative))
    if full != top and not full.startswith(top + os.sep):
        raise ValueError(f"path leaves the project: {relative}")
    return full


def resource_loader(root: str) -> Callable[[str, str | None], dict]:
    """Loads schema resources (JSON or YAML) relative to what refers to them, confined to root (IO11)."""

    def load(ref: str, base: str | None) -> dict:
        relative = str(PurePosixPath(base).parent / ref) if base else ref
        parts: list[str] = []
        for p in PurePosixPath(relative).parts:
            parts = parts[:-1] if p == ".." else [*parts, p]
        with open(confined(root, "/".join(parts)), encoding="utf-8") as f:
            text = f.read()
        return json.loads(text) if ref.endswith(".json") else values.read_yaml(text)

    return load


#: The folder of type definitions below a project; deployments with another one give it to `type_files`.
TYPE_FOLDER = ".engine/types"


def type_files(root: str, folder: str = TYPE_FOLDER) -> list[str]:
    """Type definitions below the project's folder for them, by their compound suffixes (IO10)."""
    top = os.path.join(root, *folder.split("/"))
    suffixes = (".mdtype.yaml", ".mdtype.yml", ".mdtype.json", ".mdtype.toml")
    return sorted(os.path.join(d, n) for d, _, names in os.walk(top) for n in names if n.lower().endswith(suffixes))


METADATA = "path string, size bigint, created timestamp, modified timestamp, accessed timestamp, mode int, owner string, group string, is_symlink boolean, is_directory boolean"


def metadata(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """Size, dates, mode, owner and group of files, read by the executors (IO18)."""
    base = root.rstrip("/") + "/"

    def stat(frames):
        import grp
        import pwd
        import stat as st

        import pandas as pd

        def name(of, number):
            try:
                return of(number)[0]
            except KeyError:
                return str(number)

        for f in frames:
            rows = []
            for p in f["file"]:
                s = os.lstat(p)
                at = lambda x: pd.Timestamp(int(x * 1e6), unit="us")
                rows.append((p.removeprefix(base), s.st_size, at(s.st_ctime), at(s.st_mtime), at(s.st_atime), st.S_IMODE(s.st_mode), name(pwd.getpwuid, s.st_uid), name(grp.getgrgid, s.st_gid), st.S_ISLNK(s.st_mode), st.S_ISDIR(s.st_mode)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in METADATA.split(", ")])

    return spark.createDataFrame([(p,) for p in paths], "file string").mapInPandas(stat, METADATA)
