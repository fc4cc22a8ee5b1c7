"""Order-free comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, int):
        return float(value)
    return value


def differences(frame, con, sql: str, show: int = 3) -> str | None:
    """None when both hold the same rows, else a short account of what differs."""
    names = sorted(frame.columns)
    ours = Counter(tuple(_plain(row[c]) for c in names) for row in frame.collect())
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != names:
        return f"columns {names} != {sorted(columns)}"
    index = [columns.index(c) for c in names]
    theirs = Counter(tuple(_plain(row[i]) for i in index) for row in found.fetchall())
    if ours == theirs:
        return None
    return (
        f"rows {sum(ours.values())} vs {sum(theirs.values())}; {names}; "
        f"only ours {list((ours - theirs).items())[:show]}; only oracle {list((theirs - ours).items())[:show]}"
    )
