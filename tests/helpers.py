"""What several test modules share."""

from __future__ import annotations

import datetime as dt


def rows(df, *columns):
    """Rows as sorted tuples."""
    got = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in got.collect()), key=repr)


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)
