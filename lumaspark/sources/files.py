"""Files behind Spark's paths, for sources whose tasks read or write bytes themselves."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterable
from urllib.parse import quote, unquote

from pyarrow import fs

MANIFEST = "_manifest.json"
PENDING = "_pending"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a folder or file as Spark names it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[fs.FileInfo]:
    """The files under a path, hidden ones left out, by name."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    root = inner.rstrip("/")
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(part.startswith(("_", ".")) for part in p.removeprefix(root).split("/"))
    return sorted((f for f in found if f.type == fs.FileType.File and not hidden(f.path)), key=lambda f: f.path)


def safe(name: str) -> str:
    """A file name for any text."""
    return quote(name, safe=" ()[],'!+")


def plain(name: str) -> str:
    return unquote(name)


class Pending:
    """Files that a task has written under names of its own. They take their names when the job commits, so a lost or repeated task leaves nothing behind."""

    def __init__(self, root: str):
        self.system, self.root = opened(root)
        self.folder = posixpath.join(self.root, PENDING)
        self.system.create_dir(self.folder, recursive=True)

    def create(self) -> tuple[str, fs.NativeFile]:
        at = posixpath.join(self.folder, uuid.uuid4().hex)
        return at, self.system.open_output_stream(at)


def commit(root: str, parts: Iterable[dict], facts: dict) -> None:
    """Gives the parts ({at, name, …}) their names and writes the manifest last: a folder with a manifest is whole."""
    system, inner = opened(root)
    told, made = [], set()
    for part in sorted(parts, key=lambda p: p["name"]):
        target = posixpath.join(inner, part["name"])
        if posixpath.dirname(target) not in made:
            system.create_dir(posixpath.dirname(target), recursive=True)
            made.add(posixpath.dirname(target))
        system.move(part["at"], target)
        told.append({k: v for k, v in part.items() if k != "at"})
    if system.get_file_info(posixpath.join(inner, PENDING)).type != fs.FileType.NotFound:
        system.delete_dir(posixpath.join(inner, PENDING))
    with system.open_output_stream(posixpath.join(inner, MANIFEST)) as out:
        out.write(json.dumps(facts | {"parts": told}, indent=1).encode())


def manifest(root: str) -> dict:
    system, inner = opened(root)
    with system.open_input_stream(posixpath.join(inner, MANIFEST)) as given:
        return json.loads(given.read())


def abort(root: str, parts: Iterable[dict]) -> None:
    system, _ = opened(root)
    for part in parts:
        system.delete_file(part["at"])


def cleared(root: str, overwrite: bool) -> None:
    """Makes way for a write: what an earlier one left goes if it may be overwritten."""
    system, inner = opened(root)
    system.create_dir(inner, recursive=True)
    if overwrite:
        system.delete_dir_contents(inner)
    elif system.get_file_info(posixpath.join(inner, MANIFEST)).type != fs.FileType.NotFound:
        raise FileExistsError(f"{root} has been written before")
