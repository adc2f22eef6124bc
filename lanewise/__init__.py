"""Exact, null-aware columnar analytics on Spark."""

VERSION = (0, 1, 0)


def version_string() -> str:
    return ".".join(map(str, VERSION))
