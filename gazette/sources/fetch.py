"""Getting a page: from the web, or from a file in any store that Arrow reaches."""

from __future__ import annotations

import urllib.request

import pyarrow.fs


def fetch(url: str, timeout: float = 10.0) -> bytes:
    """The bytes behind an address or path; whatever goes wrong is raised."""
    if url.startswith(("http://", "https://")):
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "gazette"}), timeout=timeout) as r:
            return r.read()
    store, path = pyarrow.fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else "file://" + url)
    with store.open_input_stream(path, compression=None) as r:
        return r.read()
