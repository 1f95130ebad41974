"""Page names that cannot be guessed: letters and digits drawn from a salted digest."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = string.ascii_letters + string.digits
LENGTH = 10


def page_token(salt: str, *parts: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(salt), *parts), 256)
    letter = lambda i: F.substring(F.lit(ALPHABET), (F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int") % len(ALPHABET)) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), letter), "")


def obfuscated(filename: Column, salt: str, *parts: Column) -> Column:
    """world.html becomes world-<token>.html; a name without a dot gets .html."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    ext = F.when(filename.contains("."), F.element_at(F.split(filename, r"\."), -1)).otherwise("html")
    return F.concat(stem, F.lit("-"), page_token(salt, *parts, filename), F.lit("."), ext)


def ensure_salt(folder: str) -> str:
    """The salt kept in folder (a URI); created once, so that names of older pages stay."""
    import secrets

    import pyarrow.fs

    store, base = pyarrow.fs.FileSystem.from_uri(folder)
    path = f"{base}/.salt"
    if store.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        store.create_dir(base)
        with store.open_output_stream(path) as out:
            out.write(secrets.token_hex(16).encode())
    with store.open_input_stream(path) as source:
        return source.read().decode()
