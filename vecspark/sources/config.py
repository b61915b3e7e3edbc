"""Configuration files: ``key=value`` lines with ``#`` comments."""

from __future__ import annotations

import os
import stat

MAX_BYTES = 64 << 10


def read_config(path: str) -> dict[str, str]:
    """The file's settings; none where it is missing.

    A file that others than its owner may open, or that belongs to another user, is refused.
    """
    try:
        found = os.stat(path)
    except FileNotFoundError:
        return {}
    if found.st_mode & (stat.S_IRWXG | stat.S_IRWXO) or found.st_uid != os.getuid():
        raise PermissionError(f"{path} must belong to this user and be closed to others")
    with open(path, encoding="utf-8") as f:
        lines = f.read(MAX_BYTES).splitlines()
    pairs = (line.split("#", 1)[0].partition("=") for line in lines)
    return {k.strip(): v.strip() for k, eq, v in pairs if eq and k.strip()}
