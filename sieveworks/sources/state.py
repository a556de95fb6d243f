"""The state folder: slots of documents, journals that are appended to, snapshots of presence.

These are small files of one user, written on the driver.  Whole documents are replaced atomically;
journals only grow, one JSON object a line, so that a crash costs the last line at most.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Mapping
from typing import Any

from .documents import delete_document, dump_document, parse_strict, save_document

#: The folders under the state root.
SLOTS = ("scans", "decisions", "folder-scans", "folder-decisions", "similar-scans", "similar-decisions", "similar-renames", "journal")
#: What a scan of each kind keeps beside it.
BESIDE = {"scans": ("decisions",), "folder-scans": ("folder-decisions",), "similar-scans": ("similar-decisions", "similar-renames")}
_ID = re.compile(r"[0-9]{8}-[0-9]{6}-[0-9]{6}")


def checked_id(scan_id: str) -> str:
    """The identifier itself; anything else never becomes part of a path."""
    if not _ID.fullmatch(scan_id):
        raise ValueError(f"{scan_id!r} is no identifier")
    return scan_id


class StateFolder:
    """Slots under <state home>/<app>; an empty or missing XDG_STATE_HOME means ~/.local/state."""

    def __init__(self, environment: Mapping[str, str], home: str, app: str = "sieveworks"):
        home, base = home.rstrip("/") or "/", environment.get("XDG_STATE_HOME", "")
        if base == "~" or base.startswith("~/"):
            base = home + base[1:]
        self.root = os.path.join(base or os.path.join(home, ".local", "state"), app).rstrip("/")

    @property
    def is_absolute(self) -> bool:
        return self.root.startswith("/")

    def folder(self, slot: str) -> str:
        if slot not in SLOTS:
            raise ValueError(f"no slot {slot!r}")
        return f"{self.root}/{slot}"

    def file(self, slot: str, scan_id: str) -> str:
        return f"{self.folder(slot)}/{checked_id(scan_id)}.{'jsonl' if slot == 'journal' else 'json'}"

    def save(self, slot: str, scan_id: str, document: Any) -> str:
        """Replace a slot's document of one scan."""
        path = self.file(slot, scan_id)
        return save_document(os.path.dirname(path), os.path.basename(path), document)

    def save_renames(self, scan_id: str, name_from: list[str]) -> str | None:
        """The files whose names are kept; none left deletes the document."""
        if name_from:
            return self.save("similar-renames", scan_id, {"format_version": 1, "name_from": name_from})
        self.delete("similar-renames", scan_id)
        return None

    def load(self, slot: str, scan_id: str) -> Any:
        """The document, None where there is none."""
        try:
            with open(self.file(slot, scan_id), encoding="utf-8") as f:
                return parse_strict(f.read())
        except FileNotFoundError:
            return None

    def delete(self, slot: str, scan_id: str) -> bool:
        return delete_document(self.folder(slot), os.path.basename(self.file(slot, scan_id)))

    def delete_scan(self, slot: str, scan_id: str) -> bool:
        """A scan with all that only it explains; whether anything was there."""
        return any([self.delete(s, scan_id) for s in (slot, *BESIDE[slot])])

    def ids(self, slot: str) -> list[str]:
        """Identifiers in a slot, the newest first."""
        try:
            names = os.listdir(self.folder(slot))
        except FileNotFoundError:
            return []
        end = os.path.splitext(self.file(slot, "00000000-000000-000000"))[1]
        return sorted((n.removesuffix(end) for n in names if n.endswith(end) and _ID.fullmatch(n.removesuffix(end))), reverse=True)

    def check_journal(self, session: str) -> None:
        """Raise unless the journal can be written; called before anything moves, and makes no file."""
        path = self.file("journal", session)
        os.makedirs(self.folder("journal"), exist_ok=True)
        if not os.access(path if os.path.exists(path) else self.folder("journal"), os.W_OK):
            raise PermissionError(f"cannot write {path}")

    def append_journal(self, session: str, entries: Iterable[Mapping[str, Any]]) -> int:
        """One line an entry, in one append; how many."""
        lines = [json.dumps({"format_version": 1, **e}, allow_nan=False) + "\n" for e in entries]
        if not lines:
            return 0
        os.makedirs(self.folder("journal"), exist_ok=True)
        fd = os.open(self.file("journal", session), os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o644)
        try:
            rest = "".join(lines).encode()
            while rest:
                rest = rest[os.write(fd, rest) :]
        finally:
            os.close(fd)
        return len(lines)

    def append_restored(self, session: str, original_path: str, at: str) -> int:
        """Say that a move was taken back; the line of the move stays."""
        return self.append_journal(session, [{"original_path": original_path, "undone_at": at}])


class PresenceSnapshots:
    """Which groups were still there when the disk was last looked at; a file that cannot be read counts as none."""

    def __init__(self, folder: str):
        self.folder = folder

    def save(self, scan_id: str, checked_at: str, present: Mapping[str, bool]) -> str:
        document = {"format_version": 1, "checked_at": checked_at, "groups": {k: present[k] for k in sorted(present, key=str.encode)}}
        return save_document(self.folder, f"{checked_id(scan_id)}.json", document)

    def load(self, scan_id: str) -> tuple[str, dict[str, bool]] | None:
        if not _ID.fullmatch(scan_id):
            return None
        try:
            with open(f"{self.folder}/{scan_id}.json", encoding="utf-8") as f:
                found = parse_strict(f.read())
            groups = {k: v for k, v in found["groups"].items() if isinstance(v, bool)}
            return (found["checked_at"], groups) if groups and isinstance(found["checked_at"], str) else None
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            return None

    def forget(self, scan_id: str) -> bool:
        return bool(_ID.fullmatch(scan_id)) and delete_document(self.folder, f"{scan_id}.json")
