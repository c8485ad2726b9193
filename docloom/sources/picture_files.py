"""A data source that writes a file for each row (folder, name, content), with Spark's commit protocol.

A task attempt writes under `_attempts/<its own name>` and tells the driver only its folders. When the job commits, those of
the attempts that Spark accepted are moved to their places, one rename for each folder of one task; files of a folder that
several tasks have written are renamed each, so many files are best dealt by folder. Two files of one name in a folder
are an error, never one of the two. When the job aborts, everything it wrote goes. Attempts that failed or lost a race are
never moved, and go with `_attempts`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Attempt(WriterCommitMessage):
    at: str
    folders: list[str]


def _store(path: str):
    """The file system of a URI or mounted path, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    store, at = fs.FileSystem.from_uri(path)
    return store, at.rstrip("/")


class PictureFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom_files"

    def schema(self) -> str:
        return "folder string, name string, content binary"

    def writer(self, schema, overwrite: bool) -> PictureWriter:
        return PictureWriter(self.options["path"])


class PictureWriter(DataSourceWriter):
    def __init__(self, path: str):
        import uuid

        from pyarrow import fs

        store, at = _store(path)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            raise FileExistsError(f"{path} is there already")
        self.path, self.job = path, uuid.uuid4().hex
        # tasks make folders in this one only and never make it: those that still run when the job aborts can leave nothing
        store.create_dir(f"{at}/_attempts/{self.job}", recursive=True)

    def write(self, iterator: Iterator) -> Attempt:
        import uuid

        store, root = _store(self.path)
        at, folders, seen = f"{root}/_attempts/{self.job}/{uuid.uuid4().hex}", set(), set()
        for folder, name, content in iterator:
            if content is None:
                raise ValueError(f"no content for {name}")
            if (folder, name) in seen:
                raise FileExistsError(f"two files {folder}/{name}")
            seen.add((folder, name))
            if folder not in folders:
                parts = folder.split("/")
                for k in range(len(parts) + 1):
                    store.create_dir("/".join([at, *parts[:k]]), recursive=False)
                folders.add(folder)
            with store.open_output_stream(f"{at}/{folder}/{name}", compression=None) as f:
                f.write(content)
        return Attempt(at, sorted(folders))

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        there = lambda at: store.get_file_info(at).type != fs.FileType.NotFound
        for done in messages:
            for folder in done.folders if done else ():
                source, target = f"{done.at}/{folder}", f"{root}/{folder}"
                if not there(source):  # moved with the folder that it is in
                    continue
                if not there(target):
                    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    store.move(source, target)
                    continue
                for file in store.get_file_info(fs.FileSelector(source)):
                    if file.type == fs.FileType.File:
                        if there(f"{target}/{file.base_name}"):
                            raise FileExistsError(f"two files {folder}/{file.base_name}")
                        store.move(file.path, f"{target}/{file.base_name}")
        self._clear(store, f"{root}/_attempts")

    def abort(self, messages: list[Attempt | None]) -> None:
        store, root = _store(self.path)
        self._clear(store, root)  # the folder was new

    @staticmethod
    def _clear(store, at: str) -> None:
        import uuid

        from pyarrow import fs

        if store.get_file_info(at).type != fs.FileType.NotFound:
            gone = f"{at}.{uuid.uuid4().hex}"
            try:  # attempts that still write find their folder gone, and nothing comes while it is deleted
                store.move(at, gone)
            except (OSError, NotImplementedError):  # a store that moves no folders
                gone = at
            store.delete_dir(gone)
