"""File sources: recursive scan, parse and validate, changed-file restriction, provenance, configuration."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseam.functions import trees
from sparkseam.session import spread

# Supported files and folders that are never entered.
EXTENSIONS = {"tf": "terraform", "yml": "yaml", "yaml": "yaml", "json": "json"}
IGNORED = [".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox"]
MAX_MB = 10.0


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_type(path: Column) -> Column:
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def selectable(path: Column, length: Column, max_mb: float = MAX_MB) -> Column:
    """Supported extension, outside ignored folders, not too large."""
    folders = F.split(path, "/")
    return F.lower(extension(path)).isin(list(EXTENSIONS)) & ~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED))) & (length <= max_mb * 1024 * 1024)


def scan(spark: SparkSession, root: str, max_mb: float = MAX_MB) -> DataFrame:
    """file_path, length, content (binary) of the files under root. A missing folder raises. Folders are judged below root."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/").replace("file://", ""), "")
    return rows.withColumn("file_path", F.regexp_replace(below, "^/", "")).filter(selectable(F.col("file_path"), F.col("length"), max_mb)).select(
        "file_path", "length", "content")


def parse(files: DataFrame, repo: str = "", branch: str = "", commit: str = "") -> DataFrame:
    """file_path, file_type, content, repo, branch, commit of files that aren't blank and whose YAML or JSON is valid."""
    text = F.decode(F.col("content"), "UTF-8") if dict(files.dtypes)["content"] == "binary" else F.col("content")
    rows = files.select("file_path", file_type(F.col("file_path")).alias("file_type"), text.alias("content")).filter(
        "file_type is not null and content rlike '\\\\S'")

    def valid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        def ok(text: str) -> bool:
            try:
                trees.documents(text)
            except yaml.YAMLError:
                return False
            return True

        for b in batches:
            yield b[[ok(t) for t in b["content"]]] if len(b) else b

    others = rows.filter("file_type = 'terraform' or (file_type = 'json' and try_parse_json(content) is not null)")
    checked = spread(rows.filter("file_type = 'yaml'")).mapInPandas(valid, rows.schema)
    return others.unionByName(checked).select("*", F.lit(repo).alias("repo"), F.lit(branch).alias("branch"), F.lit(commit[:8]).alias("commit"))


def restricted(files: DataFrame, changed: DataFrame, root: str = "") -> DataFrame:
    """The files on a list of changed paths (column path, absolute below root or relative), once each."""
    prefix = "^" + root.rstrip("/") + "/" if root else "^/"
    return files.join(changed.select(F.regexp_replace("path", prefix, "").alias("file_path")).distinct(), "file_path", "left_semi")


def clean_url(url: Column) -> Column:
    """A repository address without user or token."""
    return F.regexp_replace(url, r"(?<=://)[^/@]*@", "")


def provenance(folder: str) -> dict[str, str]:
    """repo (address without user or token), branch and commit (8 digits) of a working copy, read from its .git folder; empty where unknown."""
    git = Path(folder) / ".git"
    head = _text(git / "HEAD").strip()
    ref = head.removeprefix("ref: ") if head.startswith("ref: ") else ""
    packed = {r: c for c, _, r in (line.partition(" ") for line in _text(git / "packed-refs").splitlines())}
    commit = (_text(git / ref).strip() or packed.get(ref, "")) if ref else head
    url = re.search(r'\[remote "origin"\][^\[]*?url\s*=\s*(\S+)', _text(git / "config"))
    return {"repo": re.sub(r"(?<=://)[^/@]*@", "", url.group(1)) if url else "", "branch": ref.removeprefix("refs/heads/"), "commit": commit[:8]}


def _text(path: Path) -> str:
    return path.read_text(encoding="utf-8") if path.is_file() else ""


def fetch(url: str, folder: str) -> dict[str, str]:
    """A shallow copy of a repository in folder, brought up to date if it is there already; its provenance. A failing git raises."""
    there = (Path(folder) / ".git").is_dir()
    command = ["git", "-C", folder, "pull", "--ff-only"] if there else ["git", "clone", "--depth", "1", url, folder]
    subprocess.run(command, check=True, capture_output=True, timeout=600)
    return provenance(folder)


def config_path(root: str, name: str = "config.yaml", given: str = "") -> str:
    """The file that settings come from: one that was named, else root/name, else root/config/name."""
    if given and given != name:
        return given
    own = Path(root) / name
    return str(own if own.exists() else Path(root) / "config" / name)


def read_config(path: str) -> dict:
    """The mapping in a file; empty if it is missing or invalid."""
    return load_config(_text(Path(path)))


def load_config(text: str | None) -> dict:
    """A YAML or JSON mapping; anything else counts as empty."""
    import yaml

    try:
        data = trees.document(text or "")
    except yaml.YAMLError:
        return {}
    return data if isinstance(data, dict) else {}


def deep_merge(base: dict, over: dict) -> dict:
    """over on base, mapping by mapping."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def to_json(value) -> str:
    return json.dumps(value, indent=2, default=str)
