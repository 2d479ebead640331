"""Chunking and the dependency graph of chunks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseam.functions import trees
from sparkseam.functions.text import chunk_id, windows, words
from sparkseam.operators.ranges import row_numbers
from sparkseam.session import materialise, spread

CHUNK = "chunk_id string, text string, file_path string, file_type string, chunk_index int, tokens int, dependencies array<string>, block_type string, resource_type string, block_name string"
# Terraform blocks and names that are never resource references.
TF_HEADER = re.compile(r'^(resource|module|variable|output|data|provider|locals|terraform)\b(?:\s+"([^"]*)")?(?:\s+"([^"]*)")?\s*\{', re.MULTILINE)
TF_NOT_RESOURCES = ["var", "local", "module", "data", "path", "terraform", "self", "each", "count", "toset", "tolist", "tomap", "merge", "concat",
    "lookup", "length", "format", "join", "split", "trimspace"]


def fixed_windows(rows: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """rows with chunk_index and chunk, one row for each window; blank texts give none."""
    return rows.select("*", F.posexplode(windows(F.col(text), size, overlap)).alias("chunk_index", "chunk"))


def split_tokens(text: Column, size: int, overlap: int) -> Column:
    """The text itself if it has at most `size` words, else its windows; nothing for the empty string."""
    step = max(1, size - overlap)
    length = F.coalesce(F.length(text), F.lit(0))
    few = (length <= size) | (F.size(words(text)) <= size)  # a text has no more words than characters
    return F.when(length == 0, F.array().cast("array<string>")).when(few, F.array(text)).otherwise(windows(text, size, size - step))


def split_by(text: Column, size: int, overlap: int, strategy: str) -> Column:
    """fixed and hybrid split what is too long, semantic never splits."""
    if strategy == "semantic":
        return F.array(text)
    return split_tokens(text, size, overlap)


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(words(text)))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def fallback_chunks(files: DataFrame, size: int, overlap: int) -> DataFrame:
    """file_path, file_type, content -> fixed windows with their ids."""
    rows = files.select("*", F.posexplode(split_tokens(F.col("content"), size, overlap)).alias("chunk_index", "text"))
    base = F.concat_ws("_", stem(F.col("file_path")), F.col("file_type"), F.lit("fixed"), F.col("chunk_index").cast("string"))
    return rows.select(
        chunk_id(base).alias("chunk_id"), "text", "file_path", "file_type", F.col("chunk_index").cast("int"),
            token_count(F.col("text")).cast("int").alias("tokens"),
        F.array().cast("array<string>").alias("dependencies"), F.lit("fixed_window").alias("block_type"), F.lit("").alias("resource_type"),
            F.lit("").alias("block_name"),
    )


def tf_dependencies(text: Column) -> Column:
    """Sorted distinct references of a Terraform block."""

    def each(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    plain = [each(rf"\b{k}\.[a-zA-Z_]\w*\b") for k in ("var", "local", "module")]
    data = each(r"\bdata\.[a-zA-Z_]\w+\.[a-zA-Z_]\w+\b")
    resources = F.filter(each(r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\.[a-zA-Z_]\w*\b"), lambda x: ~F.substring_index(x, ".", 1).isin(TF_NOT_RESOURCES))
    return F.sort_array(F.array_distinct(F.concat(*plain, data, resources)))


# ---- structured files: brace matching and YAML trees aren't regular, so these run over Arrow batches


def block_end(text: str, at: int) -> int:
    """Index of the brace that closes the one at `at`; braces inside strings don't count. The last index if none does."""
    depth, quoted, i = 0, False, at
    for m in re.compile(r'\\.|["{}]', re.DOTALL).finditer(text, at):
        c = m.group()
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return m.start()
        i = m.end()
    return max(i, len(text)) - 1


def tf_blocks(content: str) -> list[dict]:
    """block_type, resource_type, block_name, text of every top-level block."""
    out = []
    for m in TF_HEADER.finditer(content):
        kind, one, two = m.group(1), m.group(2) or "", m.group(3) or ""
        typed = kind in ("resource", "data")
        out.append({"block_type": kind, "resource_type": one if typed else "", "block_name": two if typed else one,
            "text": content[m.start() : block_end(content, m.end() - 1) + 1]})
    return out


_YAML_REF = re.compile(r"\$\{([^}]+)\}|\bvar\.(\w+)\b|\bRef:\s*(\S+)")
_JSON_REF = re.compile(r"\$\{([^}]+)\}|\"Ref\"\s*:\s*\"([^\"]+)\"|arn:[^\s\"]+")


def leaf_refs(node, pattern: re.Pattern) -> set[str]:
    """References in the string leaves of a tree; for JSON also values of Ref keys."""
    if isinstance(node, dict):
        own = {node["Ref"]} if pattern is _JSON_REF and isinstance(node.get("Ref"), str) else set()
        return own.union(*[leaf_refs(v, pattern) for v in node.values()])
    if isinstance(node, list):
        return set().union(*[leaf_refs(v, pattern) for v in node])
    if not isinstance(node, str):
        return set()
    found = (next((g for g in m.groups() if g), m.group(0)) for m in pattern.finditer(node))
    return {f.strip() for f in found if f}


def tree_blocks(content: str, file_type: str) -> list[dict] | None:
    """Blocks of a YAML or JSON file; None if it doesn't parse. `whole` blocks are never split."""
    import yaml

    pattern = _YAML_REF if file_type == "yaml" else _JSON_REF
    dump = trees.written if file_type == "yaml" else (lambda x: json.dumps(x, indent=2))
    try:
        documents = trees.documents(content) if file_type == "yaml" else [json.loads(content)]
    except (yaml.YAMLError, ValueError):
        return None

    def block(kind: str, name: str, node, whole: bool = False, resource: str = "") -> dict:
        return {"block_type": kind, "resource_type": resource, "block_name": name, "text": dump(node), "refs": sorted(leaf_refs(node, pattern)), "whole": whole}

    out = []
    for k, doc in enumerate(d for d in documents if d is not None):
        if isinstance(doc, dict) and file_type == "yaml" and doc.get("kind"):
            name = str((doc.get("metadata") or {}).get("name", f"doc_{k}")) if isinstance(doc.get("metadata"), dict) else f"doc_{k}"
            out.append(block("kind", name, doc, resource=str(doc["kind"])))
        elif isinstance(doc, dict) and file_type == "json" and isinstance(doc.get("Statement"), list):
            rest = {a: b for a, b in doc.items() if a != "Statement"}
            if rest:
                out.append(block("policy_header", "header", rest, True))
            out += [block("statement", str(s.get("Sid", i)) if isinstance(s, dict) else str(i), s, True) for i, s in enumerate(doc["Statement"])]
        elif isinstance(doc, dict):
            out += [block("key", str(a), {a: b}) for a, b in doc.items()]
        elif isinstance(doc, list):
            out += [block("item", str(i), x, file_type == "yaml") for i, x in enumerate(doc)]
        else:
            out.append(block("scalar", str(k), doc))
    return out


def structured_chunks(files: DataFrame, size: int = 400, overlap: int = 40, strategy: str = "hybrid") -> DataFrame:
    """file_path, file_type, content -> chunks by block, key or statement; files without any get fixed windows, those of other types without Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content in batch[["file_path", "file_type", "content"]].itertuples(index=False):
                found = tf_blocks(content) if kind == "terraform" else tree_blocks(content, kind) if kind in ("yaml", "json") else None
                for i, b in enumerate(found or []):
                    rows.append((path, kind, i, b["text"], b["block_type"], b["resource_type"], b["block_name"], b.get("refs"), bool(b.get("whole"))))
                if not found:
                    rows.append((path, kind, -1, content, None, None, None, None, False))
            yield pd.DataFrame(rows, columns=["file_path", "file_type", "at", "body", "block_type", "resource_type", "block_name", "refs", "whole"])

    files = files.select("file_path", "file_type", "content")
    structured = F.coalesce(F.col("file_type").isin("terraform", "yaml", "json"), F.lit(False))
    blocks = spread(files.filter(structured)).mapInPandas(run,
        "file_path string, file_type string, at int, body string, block_type string, resource_type string, block_name string, refs array<string>, "
        "whole boolean")
    blocks = materialise(blocks, "blocks")  # read by two sides; a file is parsed once
    plain = blocks.filter("at < 0").select("file_path", "file_type", F.col("body").alias("content")).unionByName(files.filter(~structured))
    alone = fallback_chunks(plain, size, overlap)
    own = blocks.filter("at >= 0")
    parts = F.when(F.col("whole"), F.array("body")).otherwise(split_by(F.col("body"), size, overlap, strategy))
    own = own.select("*", F.size(parts).alias("n"), F.posexplode(parts).alias("part", "text"))
    name = F.concat_ws("_", stem(F.col("file_path")), F.when(F.col("file_type") == "terraform", F.col("block_type")).otherwise(F.col("file_type")),
        F.nullif("resource_type", F.lit("")), F.nullif("block_name", F.lit("")))
    base = F.concat(chunk_id(name), F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("part").cast("string"))).otherwise(""))
    order = Window.partitionBy("file_path").orderBy("at", "part")
    refs = F.when(F.col("file_type") == "terraform", tf_dependencies(F.col("body"))).otherwise(F.coalesce("refs", F.array().cast("array<string>")))
    own = own.select(base.alias("chunk_id"), "text", "file_path", "file_type", (F.row_number().over(order) - 1).cast("int").alias("chunk_index"),
        token_count(F.col("text")).cast("int").alias("tokens"), refs.alias("dependencies"), "block_type", "resource_type", "block_name")
    return own.unionByName(alone)


def yaml_documents(content: Column) -> Column:
    """The non-blank documents of a YAML stream."""
    return F.filter(F.split(content, r"(?m)^---[ \t]*$"), lambda x: x.rlike(r"\S"))


# ---- dependency graph


def reference(block_type: Column, resource_type: Column, name: Column) -> Column:
    """The symbol a block defines, or null."""
    named = name != ""
    return (
        F.when((block_type == "variable") & named, F.concat(F.lit("var."), name))
        .when(block_type.isin("output", "module") & named, F.concat(block_type, F.lit("."), name))
        .when(block_type == "locals", "locals")
        .when((block_type == "resource") & named & (resource_type != ""), F.concat(resource_type, F.lit("."), name))
        .when((block_type == "data") & named & (resource_type != ""), F.concat(F.lit("data."), resource_type, F.lit("."), name))
    )


def symbols(chunks: DataFrame, order: str) -> DataFrame:
    """ref -> chunk_id; the last definition wins."""
    rows = chunks.withColumn("ref", reference(F.col("block_type"), F.col("resource_type"), F.col("block_name"))).filter("ref is not null")
    return rows.groupBy("ref").agg(F.max_by("chunk_id", order).alias("target"))


def resolve(chunks: DataFrame, order: str) -> DataFrame:
    """chunks with dependencies replaced by the chunks that define them, in their order."""
    refs = chunks.select("chunk_id", F.posexplode("dependencies").alias("pos", "ref"))
    found = refs.join(symbols(chunks, order), "ref", "left").groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("target",
        "ref").alias("d")))).alias("_d"))
    return chunks.drop("dependencies").join(found, "chunk_id", "left").withColumn("dependencies", F.coalesce(F.transform("_d", lambda x: x["d"]),
        F.array().cast("array<string>"))).drop("_d")


def expand(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, depth: int = 2) -> DataFrame:
    """id, level of the known nodes met within `depth` levels (depth 1: the seeds). edges: src, dst; seeds: id; nodes: id."""
    edges, nodes = edges.select("src", "dst"), nodes.select("id")
    seen = front = materialise(seeds.select("id").distinct().join(nodes, "id", "left_semi").withColumn("level", F.lit(0)), "level0")
    for level in range(1, depth):
        # each level is written, so the plan doesn't grow with the depth
        reached = front.select(F.col("id").alias("src")).join(edges, "src").select(F.col("dst").alias("id")).distinct()
        front = materialise(reached.join(nodes, "id", "left_semi").join(seen, "id", "left_anti").withColumn("level", F.lit(level)), f"level{level}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def append_dependencies(ranked: DataFrame, found: DataFrame) -> DataFrame:
    """Ranked rows (id, score, rank), then what expansion added, with score 0 and later ranks."""
    last = ranked.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("_last"))
    extra = row_numbers(found.join(ranked, "id", "left_anti"), [F.col("level"), F.col("id")], "_number").crossJoin(F.broadcast(last))
    extra = extra.select("id", F.lit(0.0).alias("score"), (F.col("_last") + F.col("_number")).cast("int").alias("rank"))
    return ranked.select("id", "score", "rank").unionByName(extra)
