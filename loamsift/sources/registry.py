"""The registry of repositories: a small JSON file, and paths of local trees. Network transports are left to git itself."""

from __future__ import annotations

import json
import re
import shutil
import subprocess
from datetime import datetime
from pathlib import Path


def repository_name(where: str) -> str:
    """The last part of a URL or path, without .git."""
    tail = re.split(r"[/:\\]", where.strip().rstrip("/\\"))[-1]
    return re.sub(r"\.git$", "", tail) or "repository"


class Registry:
    def __init__(self, folder: str | Path) -> None:
        self.folder = Path(folder)
        self.file = self.folder / "repositories.json"
        self.entries: dict[str, dict] = json.loads(self.file.read_text("utf-8")) if self.file.exists() else {}

    def _save(self) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        self.file.write_text(json.dumps(self.entries, ensure_ascii=False, indent=2), "utf-8")

    def _git(self, path: Path, *args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", str(path), *args], capture_output=True, text=True, check=True, timeout=600).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    def add(self, url: str, name: str | None = None, branch: str = "main", copy: bool = False) -> dict:
        """A local folder is referred to, or copied; anything else is cloned."""
        name = name or repository_name(url)
        if name in self.entries:
            raise ValueError(f"{name} is registered already")
        local = Path(url).expanduser()
        target = self.folder / "repos" / name
        if local.is_dir() and copy:
            shutil.copytree(local, target)
            kind, path = "local", target
        elif local.is_dir():
            kind, path = "local_reference", local.resolve()
        else:
            subprocess.run(["git", "clone", "--branch", branch, url, str(target)], check=True, capture_output=True, timeout=3600)
            kind, path = "remote", target
        self.entries[name] = {"type": kind, "path": str(path), "url": url, "branch": branch, "commit_hash": self._git(path, "rev-parse", "HEAD"), "last_updated": datetime.now().isoformat()}
        self._save()
        return self.entries[name]

    def update(self, name: str) -> dict:
        entry = self.get(name)
        if entry["type"] == "remote":
            self._git(Path(entry["path"]), "pull")
        entry |= {"last_updated": datetime.now().isoformat(), "commit_hash": self._git(Path(entry["path"]), "rev-parse", "HEAD")}
        self._save()
        return entry

    def remove(self, name: str, files: bool = False) -> None:
        """Files are deleted only where the registry made them."""
        entry = self.get(name)
        if files and entry["type"] != "local_reference":
            shutil.rmtree(entry["path"], ignore_errors=True)
        del self.entries[name]
        self._save()

    def get(self, name: str) -> dict:
        if name not in self.entries:
            raise KeyError(f"no repository {name}")
        return self.entries[name]

    def path(self, name: str) -> str:
        return self.get(name)["path"]

    def valid(self, name: str) -> bool:
        return name in self.entries and Path(self.entries[name]["path"]).is_dir()

    def list(self, kind: str | None = None) -> dict[str, dict]:
        return {k: v for k, v in self.entries.items() if kind is None or v["type"] == kind}

    def cleanup(self) -> list[str]:
        """Forget the repositories whose folder is gone."""
        gone = [k for k in self.entries if not self.valid(k)]
        for k in gone:
            del self.entries[k]
        if gone:
            self._save()
        return gone
