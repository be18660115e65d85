"""Conditional downloads, on the driver before a build: into a folder that executors see too,
a path or a URI of any store that Arrow knows."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs

from tokoro.sources.catalog import FEED_URL


@dataclass(frozen=True)
class Download:
    url: str
    path: str
    last_modified: str | None
    cached: bool


def _open(url: str, headers: dict, timeout: float):
    return urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout)  # noqa: S310


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The store that a path or URI is of, and its path there."""
    if "://" in folder or folder.startswith("file:"):
        scheme, _, rest = folder.partition(":")
        uri = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + (f"//{rest}" if not rest.startswith("//") else rest)
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(folder)


def download(url: str, folder: str, timeout: float = 120.0, opener=_open) -> Download:
    """Fetch unless unchanged since the last time; the file is replaced at once when whole.
    Beside it a small JSON file keeps its Last-Modified."""
    store, top = opened(folder)
    name = url.rpartition("/")[2]
    target, side, known = f"{top}/{name}", f"{top}/{name}.json", None
    have = [i.type == fs.FileType.File for i in store.get_file_info([target, side])]
    if all(have):
        try:
            with store.open_input_file(side) as held:
                known = json.loads(held.read()).get("last_modified")
        except ValueError:
            known = None
    shown = f"{folder.rstrip('/')}/{name}"
    try:
        with opener(url, {"If-Modified-Since": known} if known else {}, timeout) as answer:
            store.create_dir(top, recursive=True)
            part = f"{top}/.{name}.{os.getpid()}"
            with store.open_output_stream(part) as out:
                while block := answer.read(1 << 20):
                    out.write(block)
            store.move(part, target)
            modified = answer.headers.get("Last-Modified")
    except urllib.error.HTTPError as error:
        if error.code != 304:
            raise
        return Download(url, shown, known, True)
    with store.open_output_stream(side) as out:
        out.write(json.dumps({"url": url, "last_modified": modified}).encode())
    return Download(url, shown, modified, False)


def download_all(urls: list[str], folder: str, concurrency: int = 4, opener=_open, progress: Callable[[int, int, str], None] = lambda *_: None) -> list[Download]:
    """In the order of the urls; ``progress`` is told done, total and url of each."""
    out = []
    with ThreadPoolExecutor(concurrency) as pool:
        for k, one in enumerate(pool.map(lambda u: download(u, folder, opener=opener), urls), 1):
            out.append(one)
            progress(k, len(urls), one.url)
    return out


def fetch_feed(opener=_open, url: str = FEED_URL, timeout: float = 120.0) -> str:
    """The catalogue's JSON text; an error status is an error."""
    with opener(url, {}, timeout) as answer:
        return answer.read().decode("utf-8")
