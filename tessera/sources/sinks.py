"""Exports: sharded JSON with a manifest of checksums, Markdown and Mermaid renderings, configuration files."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_bundle(sections: dict[str, DataFrame], path: str, rows_a_file: int = 1000) -> DataFrame:
    """Writes each section as JSON lines in shards, and returns the manifest: section, file, rows, sha256 (of the sorted lines), also
    written as ``manifest``."""
    out = None
    for name, df in sections.items():
        df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).json(f"{path}/{name}")
        lines = df.sparkSession.read.text(f"{path}/{name}").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
        # a shard has rows_a_file rows at most, so its lines are a bounded group
        rows = lines.groupBy("file").agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list("value")), "\n"), 256).alias("sha256")).select(F.lit(name).alias("section"), "file", "rows", "sha256")
        out = rows if out is None else out.unionByName(rows)
    out.write.mode("overwrite").json(f"{path}/manifest")
    return out


def markdown(title: str, tables: dict[str, list[dict]]) -> str:
    """A report from small collected tables."""
    out = [f"# {title}", ""]
    for name, rows in tables.items():
        out += [f"## {name}", ""]
        if rows:
            keys = list(rows[0])
            cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
            out += ["| " + " | ".join(keys) + " |", "|" + " --- |" * len(keys), *["| " + " | ".join(cell(r[k]) for k in keys) + " |" for r in rows], ""]
        else:
            out += ["None.", ""]
    return "\n".join(out)


def mermaid(edges: list[tuple[str, str, str]], limit: int = 100) -> str:
    """A flow chart of at most ``limit`` edges (source, target, label), and how many are left out."""
    ids: dict[str, str] = {}
    name = lambda x: ids.setdefault(x, f"n{len(ids)}")
    quote = lambda x: x.replace('"', "'")
    rows = [f'  {name(a)}["{quote(a)}"] -->|{quote(t)}| {name(b)}["{quote(b)}"]' for a, b, t in edges[:limit]]
    more = [f"  %% {len(edges) - limit} more"] if len(edges) > limit else []
    return "\n".join(["flowchart LR", *rows, *more])


@dataclass
class Limits:
    """Bounds of traversals and findings; a file and then the environment override them."""

    max_depth: int = 8
    max_results: int = 200
    fan: int = 10
    file_lines: int = 500
    symbol_lines: int = 80
    ignore: list[str] = field(default_factory=list)


def load_config(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "TESSERA_") -> Limits:
    """Reads JSON, or YAML restricted to ``key: value`` and lists of scalars. Unknown keys and wrong types are refused."""
    raw: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        raw = json.loads(text) if path.endswith(".json") else _plain_yaml(text)
    kinds = {f.name: f.type for f in fields(Limits)}
    for k, v in (env if env is not None else os.environ).items():
        if k.startswith(prefix) and k[len(prefix) :].lower() in kinds:
            raw[k[len(prefix) :].lower()] = v
    out = Limits()
    for k, v in raw.items():
        if k not in kinds:
            raise ValueError(f"unknown setting {k}")
        if kinds[k] == "int":
            v = int(v)
            if v < 0:
                raise ValueError(f"{k} must not be negative")
        elif isinstance(v, str):
            v = [x.strip() for x in v.split(",") if x.strip()]
        setattr(out, k, v)
    return out


def _plain_yaml(text: str) -> dict:
    out: dict = {}
    key = None
    for line in text.split("\n"):
        line = line.split(" #")[0].rstrip()
        if not line or line.startswith("#"):
            continue
        if line.startswith(("  - ", "- ")) and key:
            out.setdefault(key, []).append(line.split("- ", 1)[1].strip("'\""))
        elif ":" in line and not line.startswith(" "):
            key, _, value = line.partition(":")
            key = key.strip()
            if value.strip():
                out[key] = value.strip().strip("'\"")
        else:
            raise ValueError(f"this YAML is not supported: {line}")
    return out
