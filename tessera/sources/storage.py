"""Files in storage that driver and executors share, opened from Python: any scheme that Arrow knows."""

from __future__ import annotations

from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType


def opened(path: str) -> tuple[FileSystem, str]:
    """The file system of a path, and the path in it."""
    if "://" not in path:
        path = "file://" + (path.removeprefix("file:") if path.startswith("file:/") else path)
    return FileSystem.from_uri(path)


def write_text(path: str, text: str) -> None:
    fs, at = opened(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(text.encode())


def read_text(path: str) -> str:
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        return f.read().decode("utf-8", "replace")


def listed(path: str) -> list[FileInfo]:
    """Files and folders directly in a folder, by name; none if it isn't there."""
    fs, at = opened(path)
    return sorted(fs.get_file_info(FileSelector(at, allow_not_found=True)), key=lambda x: x.path)


def files_in(path: str) -> list[str]:
    """Names of the visible files of a folder."""
    return [x.base_name for x in listed(path) if x.type == FileType.File and not x.base_name.startswith(("_", "."))]


def delete_folder(path: str) -> None:
    fs, at = opened(path)
    if fs.get_file_info(at).type == FileType.Directory:
        fs.delete_dir(at)
