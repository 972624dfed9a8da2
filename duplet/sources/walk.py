"""Finding the files of a tree on the driver, and reading them as a DataFrame."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duplet.sources.registry import extension, is_supported, registry

#: Files in which folders list what to leave out.
IGNORE_FILES = (".gitignore", ".ignore")


class WalkError(OSError):
    """A root is missing, a folder can't be read, or links go round."""


@dataclass(frozen=True)
class WalkOptions:
    """excludes: substrings of paths relative to the root. max_bytes: inclusive; None is no limit."""

    roots: tuple[str, ...]
    excludes: tuple[str, ...] = ()
    max_bytes: int | None = None
    follow_links: bool = False
    honor_ignore: bool = True
    hidden: bool = False


#: In a translated pattern: what is escaped, a class, and what stands for any characters.
_TRANSLATED = re.compile(r"\\.|\[\^?\]?[^\]]*\]|\.\*|\.")


def _within(m: re.Match) -> str:
    """The same for one component of a path: nothing matches the separator."""
    if m[0].startswith("["):
        return f"(?!/){m[0]}"
    return m[0].replace(".", "[^/]") if m[0] in (".", ".*") else m[0]


def _pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern over the relative path, takes back, folders only) of a line of an ignore file."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
    folders, line = line.endswith("/"), line.rstrip("/")
    fixed = "/" in line
    parts = []
    for piece in line.lstrip("/").split("/"):
        parts.append("(?:.*)" if piece == "**" else _TRANSLATED.sub(_within, fnmatch.translate(piece).removesuffix("\\Z").removesuffix("\\z")))
    text = "/".join(parts).replace("(?:.*)/", "(?:.*/)?")
    return re.compile(("" if fixed else "(?:.*/)?") + text + r"\Z"), back, folders


def discover(options: WalkOptions, accept: Callable[[str], bool] = is_supported) -> list[tuple[str, str]]:
    """(absolute path, path relative to its root, with /) of the accepted files, each once, in order by path components."""
    found: dict[str, str] = {}
    for root in options.roots:
        top = Path(root)
        if not top.exists():
            raise WalkError(f"no such file or folder: {root}")
        if top.is_file():
            if accept(top.name) and _fits(top, options):
                found.setdefault(os.path.abspath(top), top.name)
            continue
        above = [r for folder in reversed(Path(os.path.abspath(top)).parents) for r in _rules(folder)] if options.honor_ignore else []
        _walk(top, top, above, options, accept, found, ())
    return sorted(found.items(), key=lambda x: PurePosixPath(x[1]).parts)


def _rules(folder: Path) -> list[tuple]:
    """(folder, pattern, takes back, folders only) for each line of the ignore files of a folder."""
    out = []
    for name in IGNORE_FILES:
        if (folder / name).is_file():
            lines = (folder / name).read_text(encoding="utf-8", errors="replace").splitlines()
            out += [(folder, *p) for p in map(_pattern, lines) if p]
    return out


def _fits(path: Path, options: WalkOptions) -> bool:
    return options.max_bytes is None or path.stat().st_size <= options.max_bytes


def _walk(top: Path, folder: Path, rules: list, options: WalkOptions, accept, found: dict[str, str], seen: tuple) -> None:
    here = os.path.realpath(folder)
    if here in seen:
        raise WalkError(f"links go round at {folder}")
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError as e:
        raise WalkError(f"{folder}: {e.strerror}") from e
    if options.honor_ignore:
        rules = rules + _rules(Path(os.path.abspath(folder)))
    for e in entries:
        path = folder / e.name
        relative = path.relative_to(top).as_posix()
        if (e.name.startswith(".") and not options.hidden) or any(x in relative for x in options.excludes) or (e.is_symlink() and not options.follow_links):
            continue
        directory = e.is_dir()
        dropped = False
        for base, pattern, back, folders in rules:
            if (directory or not folders) and pattern.match(Path(os.path.abspath(path)).relative_to(base).as_posix()):
                dropped = not back
        if dropped:
            continue
        if directory:
            _walk(top, path, rules, options, accept, found, (*seen, here))
        elif e.is_file() and accept(e.name) and _fits(path, options):
            found.setdefault(os.path.abspath(path), relative)


def read_tree(spark: SparkSession, listed: Iterable[tuple[str, str]], snapshot: str = "head") -> DataFrame:
    """(snapshot, path, path_parts, language, text) of listed files. A file that isn't UTF-8 fails the job: it is never left out."""
    listed = list(listed)
    schema = "path string, content binary"
    if not listed:
        raw = spark.createDataFrame([], schema).withColumn("snapshot", F.lit(snapshot))
    else:
        names = spark.createDataFrame([(f"file:{a}", r) for a, r in listed], "full string, relative string")
        read = spark.read.format("binaryFile").load([a for a, _ in listed])
        raw = read.withColumn("full", F.regexp_replace("path", "^file:/+", "file:/")).join(names, "full").select(F.col("relative").alias("path"), "content", F.lit(snapshot).alias("snapshot"))
    return decoded(raw, spark)


def decoded(raw: DataFrame, spark: SparkSession) -> DataFrame:
    """Files (snapshot, path, content) as text with their language; unsupported ones go, invalid UTF-8 raises."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))))
    routed = raw.withColumn("extension", extension(F.col("path"))).join(F.broadcast(registry(spark)), "extension")
    return routed.select("snapshot", "path", F.split("path", "/").alias("path_parts"), "language", text.alias("text"))


def excluded(path, patterns: Iterable[str]):
    """Column: whether a path contains any of the patterns."""
    return reduce(lambda a, b: a | b, (F.contains(path, F.lit(p)) for p in patterns), F.lit(False))
