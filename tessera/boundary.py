"""What stays outside Spark: git, the language model, and where a repository's tables lie. Thin, and replaceable in tests."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass
from typing import Protocol


class GitError(RuntimeError):
    """A failed git command; `kind` is auth, not_found, network, conflict or other."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def classify(message: str) -> str:
    low = message.lower()
    for kind, signs in (
        ("auth", ("authentication", "permission denied", "could not read username")),
        ("not_found", ("not found", "does not exist", "does not appear to be a git repository")),
        ("network", ("could not resolve", "timed out", "connection refused", "unable to access")),
        ("conflict", ("conflict", "would be overwritten", "diverge", "not possible to fast-forward")),
    ):
        if any(s in low for s in signs):
            return kind
    return "other"


def git(*args: str, cwd: str | None = None, timeout: int = 120) -> str:
    try:
        done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired as e:
        raise GitError("network", f"git {args[0]} took over {timeout} s") from e
    if done.returncode:
        raise GitError(classify(done.stderr), done.stderr.strip())
    return done.stdout.strip()


def clone(url: str, to: str, timeout: int = 300) -> None:
    git("clone", "--", url, to, timeout=timeout)


def default_branch(path: str) -> str:
    try:
        return git("symbolic-ref", "--short", "refs/remotes/origin/HEAD", cwd=path).removeprefix("origin/")
    except GitError:
        names = git("branch", "--format=%(refname:short)", cwd=path).split("\n")
        return next((n for n in ("main", "master") if n in names), names[0])


def sync(path: str) -> str:
    """Bring a clean clone to the head of its default branch; returns the commit."""
    if git("status", "--porcelain", cwd=path):
        raise GitError("conflict", "the working tree has changes")
    git("checkout", default_branch(path), cwd=path)
    git("pull", "--ff-only", cwd=path)
    return head(path)


def head(path: str) -> str:
    return git("rev-parse", "HEAD", cwd=path)


def tracked_files(path: str) -> list[str]:
    return [x for x in git("ls-files", cwd=path).split("\n") if x]


def file_at(path: str, commit: str, name: str) -> str:
    return git("show", f"{commit}:{name}", cwd=path)


class Model(Protocol):
    """A provider-neutral language model."""

    def generate(self, prompt: str, *, system: str | None = None, temperature: float = 0.7, max_tokens: int = 8192) -> str: ...


@dataclass
class Canned:
    """A model that gives prepared answers in turn: for tests, and for running on stored answers."""

    answers: list[str]
    asked: int = 0

    def generate(self, prompt: str, **_: object) -> str:
        answer = self.answers[min(self.asked, len(self.answers) - 1)]
        self.asked += 1
        return answer


def provider(env: dict[str, str], known: list[tuple[str, str, str]]) -> tuple[str, str] | None:
    """(provider, model) of the first of known (variable, provider, model) whose key is set."""
    return next(((name, model) for variable, name, model in known if env.get(variable)), None)
