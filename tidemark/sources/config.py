"""Small hand-written inputs: TOML files and route manifests, read on the driver.

A missing file gives its default; a broken one is reported with the others, all at once.
"""

from __future__ import annotations

import json
import os
import tempfile
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def load_toml(path: str | Path, default: dict[str, Any] | None = None) -> dict[str, Any]:
    try:
        return tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return dict(default or {})


def check_files(paths: list[str]) -> dict[str, str]:
    """path → 'valid', 'missing' or 'invalid: why', for all of them."""
    found = {}
    for path in paths:
        try:
            tomllib.loads(Path(path).read_text(encoding="utf-8"))
            found[path] = "valid"
        except FileNotFoundError:
            found[path] = "missing"
        except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
            found[path] = f"invalid: {e}"
    return found


def flatten(tree: dict[str, Any], prefix: str = "") -> list[tuple[str, str]]:
    """(dotted path, value as JSON) of every leaf; tables are walked, lists are values."""
    out = []
    for key, value in tree.items():
        path = f"{prefix}.{key}" if prefix else key
        out += flatten(value, path) if isinstance(value, dict) else [(path, json.dumps(value, default=str, sort_keys=True))]
    return out


def config_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, path, value_json of all leaves of some TOML files."""
    rows = [(Path(p).stem, k, v) for p in paths for k, v in flatten(load_toml(p))]
    return spark.createDataFrame(rows, "file string, path string, value_json string")


def routes(spark: SparkSession, manifest: str) -> DataFrame:
    """url, status, path, body, etag of a manifest of recorded responses."""
    folder = Path(manifest).parent
    rows = [(r["url"], int(r.get("status", 200)), str(folder / r["file"]) if "file" in r else None, r.get("body"), r.get("etag")) for r in load_toml(manifest).get("route", [])]
    return spark.createDataFrame(rows, "url string, status int, path string, body string, etag string")


def replace_file(path: str | Path, text: str) -> None:
    """Write a file beside its place and move it there, so that readers see the old or the new one."""
    path = Path(path)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as new:
        new.write(text)
    os.replace(new.name, path)
