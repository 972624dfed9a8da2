"""Snapshots from a git repository, by way of the git command."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path


class GitError(RuntimeError):
    """git is missing or refused."""


class Repo:
    def __init__(self, root: Path):
        self.root = root

    @staticmethod
    def _run(where: str | Path, *args: str) -> str:
        try:
            done = subprocess.run(["git", "-C", str(where), *args], capture_output=True, text=True, check=False)
        except FileNotFoundError as e:
            raise GitError("git is not installed") from e
        if done.returncode:
            raise GitError(f"git {args[0]}: {done.stderr.strip()}")
        return done.stdout

    @staticmethod
    def discover(path: str | Path) -> Repo:
        path = Path(path)
        return Repo(Path(Repo._run(path.parent if path.is_file() else path, "rev-parse", "--show-toplevel").strip()))

    def resolve(self, revision: str) -> str:
        return self._run(self.root, "rev-parse", "--verify", "--quiet", f"{revision}^{{commit}}").strip()

    def merge_base(self, a: str, b: str) -> str:
        return self._run(self.root, "merge-base", a, b).strip()

    def base_commit(self, name: str) -> tuple[str, str | None]:
        """The commit of a base as given, else of origin/<base>, with a note of that."""
        try:
            return self.resolve(name), None
        except GitError:
            try:
                return self.resolve(f"origin/{name}"), f"base {name} not found, using origin/{name}"
            except GitError as e:
                raise GitError(f"no commit {name} or origin/{name}") from e

    def changed_files(self, base: str, head: str = "HEAD") -> list[str]:
        """Paths that were added, copied, modified or renamed, in order; deletions are left out."""
        out = self._run(self.root, "diff", "--name-only", "-z", "--diff-filter=ACMR", f"{base}...{head}")
        return sorted(p for p in out.split("\0") if p)

    @contextmanager
    def worktree(self, commit: str) -> Iterator[Path]:
        """A detached checkout of a commit, removed afterwards."""
        with tempfile.TemporaryDirectory() as folder:
            path = Path(folder) / "checkout"
            self._run(self.root, "worktree", "add", "--detach", "--quiet", str(path), commit)
            try:
                yield path
            finally:
                self._run(self.root, "worktree", "remove", "--force", str(path))
