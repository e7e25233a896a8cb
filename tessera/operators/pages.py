"""Lookups, pages, cursors and budgets of results."""

from __future__ import annotations

import base64
import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class StaleCursor(ValueError):
    """The cursor belongs to another query or to another state of the data."""


def lookup(rows: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    """Rows by id, with the position of each id in the request. The request is bounded by its sender."""
    wanted = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"pos int, {key} string")
    return rows.join(wanted, key)


def encode_cursor(offset: int, scope: str, fingerprint: str) -> str:
    body = {"o": offset, "s": hashlib.sha256(scope.encode()).hexdigest()[:16], "f": fingerprint}
    return base64.urlsafe_b64encode(json.dumps(body).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None, scope: str, fingerprint: str) -> int:
    if not cursor:
        return 0
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        same = body["s"] == hashlib.sha256(scope.encode()).hexdigest()[:16] and body["f"] == fingerprint
        offset = int(body["o"])
    except (ValueError, KeyError, TypeError) as e:
        raise StaleCursor("unreadable cursor") from e
    if not same or offset < 0:
        raise StaleCursor("the cursor belongs to another query or state")
    return offset


def page(rows: DataFrame, order: list[Column], limit: int, cursor: str | None, scope: str, fingerprint: str) -> tuple[DataFrame, str | None]:
    """One page and the cursor of the next, or None; one row more than the page is read to know."""
    offset = decode_cursor(cursor, scope, fingerprint)
    probe = rows.orderBy(*order).offset(offset).limit(limit + 1)
    more = probe.count() > limit
    return rows.orderBy(*order).offset(offset).limit(limit), encode_cursor(offset + limit, scope, fingerprint) if more else None


def byte_page(table: DataFrame, order: list[Column], size: str, rows: int = 200, limit: int = 1_000_000) -> DataFrame:
    """The first rows whose sizes together stay within the limit. Only the first ``rows`` enter the running sum, so the window
    without partitions sees a page, not the table."""
    top = table.orderBy(*order).limit(rows)
    w = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= limit)


def diversified(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """Top k where the best of each group come first. No group can fill more than k places, so k of each are enough."""
    inner = Window.partitionBy(group).orderBy(*order)
    first = rows.withColumn("_in_group", F.row_number().over(inner)).where(F.col("_in_group") <= k)
    tier = F.when(F.col("_in_group") == 1, 0).otherwise(1)
    top = first.orderBy(tier, *order).limit(k)
    return top.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(tier, *order))).drop("_in_group")


def fit_to_budget(items: list[dict], budget: int, envelope: dict | None = None) -> dict:
    """Greedy packing of a response: items in order of priority, each with the evidence it refers to (shared pieces once), taken back if
    the serialised response outgrows the budget. Works on a collected top-k; the envelope must fit by itself."""
    out: dict[str, Any] = {**(envelope or {}), "items": [], "evidence": {}}
    size = lambda: len(json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode())
    if size() > budget:
        raise ValueError("the empty response does not fit its budget")
    for item in sorted(items, key=lambda i: (i["priority"], i["id"])):
        added = {k: v for k, v in item.get("evidence", {}).items() if k not in out["evidence"]}
        out["items"].append({k: v for k, v in item.items() if k not in ("evidence", "priority")} | {"evidence_ids": sorted(item.get("evidence", {}))})
        out["evidence"].update(added)
        if size() > budget:
            out["items"].pop()
            for k in added:
                del out["evidence"][k]
    out["omitted"] = len(items) - len(out["items"])
    return out


def compact(records: list[dict]) -> dict:
    """Records as columns with a shared table of strings; ``expand`` is the inverse."""
    keys = sorted({k for r in records for k in r})
    strings: dict[str, int] = {}
    code = lambda v: {"s": strings.setdefault(v, len(strings))} if isinstance(v, str) else {"v": v}
    rows = [[code(r[k]) if k in r else None for k in keys] for r in records]
    return {"keys": keys, "strings": list(strings), "rows": rows}


def expand(packed: dict) -> list[dict]:
    """Fails on anything that ``compact`` cannot have made."""
    keys, strings, out = packed["keys"], packed["strings"], []
    for row in packed["rows"]:
        if len(row) != len(keys):
            raise ValueError("a row of the wrong length")
        record = {}
        for k, cell in zip(keys, row, strict=True):
            if cell is None:
                continue
            if set(cell) == {"s"} and isinstance(cell["s"], int) and 0 <= cell["s"] < len(strings):
                record[k] = strings[cell["s"]]
            elif set(cell) == {"v"}:
                record[k] = cell["v"]
            else:
                raise ValueError("an unknown cell")
        out.append(record)
    return out
