"""Source files of a project: discovery on the driver, reading on the executors.

Discovery needs only names, so it walks directories and applies ignore rules on the driver; contents are read
by Spark's binary source. A table of (file_path, content) is the source to use at scale.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscan.options import EXCLUDES, EXTENSIONS

MOST_LEVELS = 128


@dataclass
class Found:
    files: list[str] = field(default_factory=list)  # absolute paths, sorted
    skipped: list[str] = field(default_factory=list)
    warnings: list[tuple[str, str]] = field(default_factory=list)  # path, message


@lru_cache(maxsize=10_000)
def glob_regex(pattern: str) -> re.Pattern:
    """One line of an ignore file as a regular expression over paths relative to its directory."""
    anchored = "/" in pattern.rstrip("/")
    only_dirs = pattern.endswith("/")
    body = pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + ("/.*" if only_dirs else "(?:/.*)?") + r"\Z")


class Rules:
    """Ignore patterns of one directory; the last that matches decides, ``!`` takes back."""

    def __init__(self, base: Path, patterns: list[str]):
        self.base = base
        kept = [p.rstrip() for p in patterns if p.strip() and not p.startswith("#")]
        self.rules = [(p.startswith("!"), glob_regex(p.removeprefix("!"))) for p in kept]

    def verdict(self, path: Path) -> bool | None:
        try:
            rel = path.relative_to(self.base).as_posix()
        except ValueError:
            return None
        out = None
        for keep, rule in self.rules:
            if rule.match(rel):
                out = not keep
        return out


def _lines(path: Path) -> list[str]:
    try:
        return path.read_text("utf-8", errors="replace").splitlines()
    except OSError:
        return []


class Ignore:
    """All rules that hold for a path: the project's root rules and the ignore file of every directory above it."""

    def __init__(self, cwd: Path, exclude: tuple[str, ...]):
        self.cwd = cwd
        self.root = Rules(cwd, [*_lines(cwd / ".gitignore"), *EXCLUDES, *exclude])
        self.exclude = (*EXCLUDES, *exclude)
        self.dirs: dict[Path, Rules] = {}

    def base(self, target: Path) -> Path:
        """Where rules begin: the project, or for a target outside it the enclosing repository, else the target's directory."""
        if target == self.cwd or self.cwd in target.parents:
            return self.cwd
        start = target if target.is_dir() else target.parent
        for i, d in enumerate([start, *start.parents]):
            if i > MOST_LEVELS:
                break
            if (d / ".git").exists():
                return d
        return start

    def ignored(self, path: Path, base: Path) -> bool:
        if base == self.cwd:
            out = bool(self.root.verdict(path))
        else:
            out = bool(Rules(base, list(self.exclude)).verdict(path))
        between = [d for d in reversed(path.parents) if d == base or base in d.parents]
        for d in between:
            if d == self.cwd:
                continue
            if d not in self.dirs:
                self.dirs[d] = Rules(d, _lines(d / ".gitignore"))
            verdict = self.dirs[d].verdict(path)
            out = out if verdict is None else verdict
        return out


def discover(paths: list[str], cwd: str | os.PathLike = ".", extensions: tuple[str, ...] = EXTENSIONS, exclude: tuple[str, ...] = ()) -> Found:
    """Files below ``paths`` with one of the extensions that no rule ignores.

    Dot files and links are passed over in directories. A file named itself must still have an extension
    (else it is skipped) and not be ignored. A path that does not exist is a warning.
    """
    root = Path(cwd).resolve()
    ignore, out = Ignore(root, exclude), Found()
    suffixes = {"." + e for e in extensions}
    seen: set[str] = set()
    for name in dict.fromkeys(paths or ["."]):
        target = Path(os.path.normpath(root / name))
        if not target.exists():
            out.warnings.append((str(target), "path does not exist"))
        elif target.is_file():
            base = ignore.base(target)
            if target.suffix.lower() not in suffixes:
                out.skipped.append(str(target))
            elif not ignore.ignored(target, base):
                seen.add(str(target))
        elif target.is_dir():
            base = ignore.base(target)
            for at, dirs, names in os.walk(target):
                here = Path(at)
                dirs[:] = sorted(d for d in dirs if not d.startswith(".") and not (here / d).is_symlink() and not ignore.ignored(here / d, base))
                for f in names:
                    p = here / f
                    if not f.startswith(".") and p.suffix.lower() in suffixes and not p.is_symlink() and not ignore.ignored(p, base):
                        seen.add(str(p))
        else:
            out.warnings.append((str(target), "unsupported type of path"))
    out.files = sorted(seen)
    return out


def shown_path(path: str, cwd: str | os.PathLike = ".") -> str:
    """Relative with slashes inside the project, otherwise in full."""
    try:
        return Path(path).resolve().relative_to(Path(cwd).resolve()).as_posix()
    except ValueError:
        return path.replace("\\", "/")


def read_files(spark: SparkSession, found: Found, cwd: str | os.PathLike = ".") -> DataFrame:
    """Contents of discovered files: file_path (as shown), content (UTF-8, a byte order mark removed).

    A file that cannot be opened leaves ``found.files`` for a warning; one that vanishes later has no row.
    """
    for f in list(found.files):
        try:
            open(f, "rb").close()
        except OSError as e:
            found.files.remove(f)
            found.warnings.append((f, f"failed to read: {e.strerror}"))
    if not found.files:
        return spark.createDataFrame([], "file_path string, content string")
    prefix = Path(cwd).resolve().as_posix().rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(found.files)
    path = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    path = F.when(F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
    text = F.regexp_replace(F.expr("decode(content, 'UTF-8')"), "^\\uFEFF", "")
    rows = raw.select(path.alias("file_path"), text.alias("content"))
    empty = [(shown_path(f, cwd), "") for f in found.files if os.path.exists(f) and os.path.getsize(f) == 0]  # Spark's file sources pass these over
    return rows.unionByName(spark.createDataFrame(empty, rows.schema)) if empty else rows


def memory_files(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Files given in memory."""
    return spark.createDataFrame(list(files.items()), "file_path string, content string")
