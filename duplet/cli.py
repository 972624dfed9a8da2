"""Commands: scan, diff, ci, languages. Findings never fail a run; missing or unreadable input does."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from duplet import render, report
from duplet.config import Config
from duplet.operators import delta
from duplet.plans.scan import scan
from duplet.sources.git import Repo
from duplet.sources.registry import listing
from duplet.sources.walk import WalkOptions, discover, read_tree


def session() -> SparkSession:
    return SparkSession.builder.appName("duplet").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def scan_paths(spark: SparkSession, root: Path, paths: list[str], config: Config, excludes: list[str]) -> dict:
    """A report on paths under root; names in it are relative to root."""
    roots = [str(root / p) for p in paths] or [str(root)]
    listed = discover(WalkOptions(tuple(roots), tuple(config.excludes) + tuple(excludes)))
    named = sorted({(a, Path(a).resolve().relative_to(root.resolve()).as_posix()) for a, _ in listed}, key=lambda x: x[1].split("/"))
    return report.build(scan(spark, read_tree(spark, named), config))


def compare(spark: SparkSession, head: dict, base: dict, config: Config, args: argparse.Namespace) -> None:
    found = delta.compute(report.frames(spark, head), report.frames(spark, base), config.function.min_similarity, config.vocab.worsened_delta, config.report.max_findings)
    rows = render.rows_of(found)
    page = render.summary(rows, found.withheld)
    if args.github_annotations:
        for a in render.annotations(rows):
            print(a.command())
    else:
        print(page.render(), end="")
    if args.summary:
        page.append_to(args.summary)
    if args.findings_out:
        Path(args.findings_out).write_text(f"{sum(map(len, rows.values()))}\n", encoding="utf-8")


def within(root: Path, path: str) -> str:
    """A path as one relative to root; relative ones join it, absolute ones must lie inside."""
    full = Path(path) if Path(path).is_absolute() else root / path
    try:
        return full.resolve().relative_to(root.resolve()).as_posix()
    except ValueError as e:
        raise ValueError(f"{path} is outside {root}") from e


def ci(spark: SparkSession, args: argparse.Namespace) -> None:
    repo = Repo.discover(args.path[0] if args.path else ".")
    config = Config.load(args.config) if args.config else Config.discover(repo.root)
    head = repo.resolve("HEAD")
    base, note = repo.base_commit(args.base)
    if note:
        print(note, file=sys.stderr)
    fork = repo.merge_base(head, base)
    paths = [within(repo.root, p) for p in args.path]
    now = scan_paths(spark, repo.root, paths, config, args.exclude)
    if args.report:
        report.write(now, args.report)
    with repo.worktree(fork) as tree:
        before = scan_paths(spark, tree, [p for p in paths if (tree / p).exists()] if paths else [], config, args.exclude) if not paths or any((tree / p).exists() for p in paths) else report.build_empty()
    compare(spark, now, before, config, args)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="duplet", description="Finds near-duplicate code and what a change adds of it.")
    verbs = top.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("scan", help="report on a tree")
    one.add_argument("paths", nargs="*")
    one.add_argument("--root", default=".")
    one.add_argument("--out")
    two = verbs.add_parser("diff", help="what one report has that another has not")
    two.add_argument("--head", required=True)
    two.add_argument("--base", required=True)
    three = verbs.add_parser("ci", help="what the working tree adds to its merge base")
    three.add_argument("--base", default="main")
    three.add_argument("--path", action="append", default=[])
    three.add_argument("--report")
    for p in (one, three):
        p.add_argument("--exclude", action="append", default=[])
    for p in (two, three):
        p.add_argument("--github-annotations", action="store_true")
        p.add_argument("--summary")
        p.add_argument("--findings-out")
    for p in (one, two, three):
        p.add_argument("--config")
    verbs.add_parser("languages", help="what can be scanned")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.verb == "languages":
            print("\n".join(listing()))
        elif args.verb == "scan":
            root = Path(args.root)
            config = Config.load(args.config) if args.config else Config.discover(root)
            found = scan_paths(session(), root, args.paths, config, args.exclude)
            if args.out:
                report.write(found, args.out)
            else:
                print(report.dumps(found))
        elif args.verb == "diff":
            config = Config.load(args.config) if args.config else Config.discover(".")
            compare(session(), report.read(args.head), report.read(args.base), config, args)
        else:
            ci(session(), args)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
