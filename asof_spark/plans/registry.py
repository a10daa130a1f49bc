"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import audited, batch, checks, files, outlook, scoring  # noqa: F401  these add to the same tables


def queries() -> dict:
    return dict(batch.Q)


def oracle_sql() -> dict[str, str]:
    return dict(batch.SQL)
