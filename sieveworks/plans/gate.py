"""What has to be shown before a plan may run, and how one file leaves its place."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable, Mapping
from dataclasses import dataclass

#: Fixed value: names that are tried before giving up.
MOST_NAMES = 1000


@dataclass
class DryRunGate:
    """A plan may run only as it was last shown; every edit asks for another dry run."""

    step: str = "scanned"
    has_decisions: bool = False
    shown: str | None = None

    def allows(self, action: str) -> bool:
        if action in ("show decisions", "dry run"):
            return self.has_decisions
        if action == "apply":
            return self.step == "dry run done" and self.shown is not None
        if action == "back":
            return self.step == "decisions shown"
        return action in ("review", "rescan", "show report", "exit")

    def advance(self, action: str, fingerprint: str | None = None) -> str | None:
        """The step after an action; None, and nothing changed, where it is not allowed."""
        if not self.allows(action):
            return None
        steps = {"review": "reviewed", "show decisions": "decisions shown", "back": "reviewed", "dry run": "dry run done", "apply": "scanned", "rescan": "scanned"}
        self.step = steps.get(action, self.step)
        if action == "dry run":
            self.shown = fingerprint
        elif action in ("review", "apply", "rescan"):
            self.shown = None
        if action == "rescan":
            self.has_decisions = False
        return self.step

    def edited(self, has_decisions: bool) -> None:
        self.has_decisions, self.shown = has_decisions, None

    def authorise(self, fingerprint: str) -> None:
        """Raise unless the dry run that was shown has this fingerprint."""
        if not self.allows("apply"):
            raise PermissionError("no dry run was shown")
        if fingerprint != self.shown:
            raise PermissionError("the plan changed since the dry run")


class DisposalError(Exception):
    """kind: missing, content changed, no free name or failed."""

    def __init__(self, kind: str, path: str):
        super().__init__(f"{kind}: {path}")
        self.kind, self.path = kind, path


#: (original path, resulting path, mechanism, bytes) of a file that left its place.
Disposal = tuple[str, str, str, int]
Disposer = Callable[[str], Disposal]


def free_name(path: str, exists: Callable[[str], bool] = os.path.lexists) -> str | None:
    """path, or its first free sibling x-2.e, x-3.e and so on."""
    if not exists(path):
        return path
    head, end = os.path.splitext(path)
    return next((p for p in (f"{head}-{k}{end}" for k in range(2, MOST_NAMES + 1)) if not exists(p)), None)


def quarantine(root: str, session: str) -> Disposer:
    """Moves a file to root/session under a free name."""

    def dispose(path: str) -> Disposal:
        try:
            size = os.lstat(path).st_size
        except OSError as e:
            raise DisposalError("missing", path) from e
        try:
            os.makedirs(f"{root}/{session}", exist_ok=True)
            to = free_name(f"{root}/{session}/{os.path.basename(path)}")
            if to is None:
                raise DisposalError("no free name", path)
            shutil.move(path, to)
        except OSError as e:
            raise DisposalError("failed", path) from e
        return path, to, "quarantine", size

    return dispose


def fallback(first: Disposer, second: Disposer) -> Disposer:
    """The second where the first fails; a file that is gone is not tried again."""

    def dispose(path: str) -> Disposal:
        try:
            return first(path)
        except DisposalError as e:
            if e.kind == "missing":
                raise
            return second(path)

    return dispose


def verifying(inner: Disposer, expected: Mapping[str, str]) -> Disposer:
    """Only files whose SHA-256 is still the expected one; a path without one is refused."""

    def dispose(path: str) -> Disposal:
        if path not in expected:
            raise DisposalError("content changed", path)
        try:
            with open(path, "rb") as f:
                found = hashlib.file_digest(f, "sha256").hexdigest()
        except OSError as e:
            raise DisposalError("missing", path) from e
        if found != expected[path]:
            raise DisposalError("content changed", path)
        return inner(path)

    return dispose
