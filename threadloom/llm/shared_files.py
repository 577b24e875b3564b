"""Files in shared folders, read and written by tasks."""

from __future__ import annotations


def open_folder(folder: str):
    """(file system, path) of a folder URI or path; the folder is made if need be."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    system.create_dir(path, recursive=True)
    return system, path


class Reader:
    """Ranges of the files of a folder; a few files stay open."""

    def __init__(self, folder: str, most: int = 8):
        self.system, self.path = open_folder(folder)
        self.most, self.files = most, {}

    def file(self, name: str):
        if name not in self.files:
            if len(self.files) >= self.most:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.system.open_input_file(f"{self.path}/{name}")
        return self.files[name]

    def read(self, name: str, offset: int, length: int) -> bytes:
        return self.file(name).read_at(length, offset)


class Writer:
    """Numbered files with new names, a next one after ``most`` bytes.

    A task that runs again writes other files; only the names in the rows that Spark keeps of it count."""

    def __init__(self, folder: str, ending: str, most: int):
        self.system, self.path = open_folder(folder)
        self.ending, self.most, self.stream = ending, most, None

    def add(self, data: bytes) -> tuple[str, int]:
        """Where the data went: file name and offset."""
        import uuid

        if self.stream is not None and self.at and self.at + len(data) > self.most:
            self.close()
        if self.stream is None:
            self.name, self.at = f"{uuid.uuid4().hex}{self.ending}", 0
            self.stream = self.system.open_output_stream(f"{self.path}/{self.name}", compression=None)
        at = self.at
        self.stream.write(data)
        self.at += len(data)
        return self.name, at

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
