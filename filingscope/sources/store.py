"""Files of a shared store, as the tasks of a Python data source reach it: any store that pyarrow knows, by its URI."""

from __future__ import annotations

import gzip
import json
import time
import uuid

from pyarrow import fs


class Store:
    """A folder. Writes appear whole: a file gets its name once all of it is there."""

    def __init__(self, uri: str):
        self.fs, self.root = fs.FileSystem.from_uri(uri)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> bytes | None:
        """The file's bytes, None if it isn't there."""
        try:
            with self.fs.open_input_stream(self.path(name), compression=None) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def read_json(self, name: str, tries: int = 3, pace: float = 0.2) -> dict | None:
        """An object in JSON, gzip or plain; None if it isn't there, or if no try gave a whole one."""
        for attempt in range(1, tries + 1):
            try:
                raw = self.read(name)
                value = raw and json.loads(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                if isinstance(value, dict):
                    return value
            except (OSError, ValueError, EOFError):
                pass
            if attempt < tries:
                time.sleep(pace * attempt)
        return None

    def exists(self, name: str) -> bool:
        return self.fs.get_file_info(self.path(name)).type == fs.FileType.File

    def names(self, folder: str = "") -> list[str]:
        """Files right in a folder, in order; none if it isn't there."""
        found = self.fs.get_file_info(fs.FileSelector(self.path(folder) if folder else self.root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File)

    def folders(self) -> list[str]:
        """Folders right in this one, but for those of staged files, in order."""
        found = self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith("_"))

    def stage(self, data: bytes) -> str:
        """Write a file under a name that no reader looks for; the name."""
        name = f"_staged/{uuid.uuid4().hex}"
        self.fs.create_dir(self.path("_staged"), recursive=True)
        with self.fs.open_output_stream(self.path(name), compression=None) as f:
            f.write(data)
        return name

    def publish(self, staged: str, name: str) -> None:
        """Give a staged file its name; one of that name is replaced."""
        if "/" in name:
            self.fs.create_dir(self.path(name.rsplit("/", 1)[0]), recursive=True)
        self.fs.move(self.path(staged), self.path(name))

    def write(self, name: str, data: bytes) -> None:
        self.publish(self.stage(data), name)

    def delete(self, name: str) -> None:
        if self.exists(name):
            self.fs.delete_file(self.path(name))
