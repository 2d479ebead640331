"""YAML by libyaml against PyYAML's own parser and writer, and the tasks that parse."""

import random

import pytest
import yaml
from pyspark import TaskContext

from sparkseam.functions import trees
from sparkseam.plans import chunk_queries, detector_queries
from sparkseam.sources import parsers

TEXTS = [chunk_queries.CUSTOMER_YAML % (1, 2, 3), *[t for _, t in chunk_queries.YAML_ROWS], *[t for _, t in detector_queries.CI_FILES], detector_queries.FED_YAML,
    "a: 1\t\nb:\t2\n", "a: !\n", "a: !!set {x, y}\nb: &x [1, 2.5, ~, yes, 2024-01-01]\nc: *x\n", "﻿a: 1\n", "a: 1\n﻿b: 2\n", "<<: {m: 1? c}\n", "run: |#\n  x\n",
    "a: \U0001f600☺\n", "%YAL 1.1\n---\na\n", "", "- x\n...\n---\n# none\n", "[" * 900 + "]" * 900, "[" * 20_000, "- " * 2000 + "x",
    "".join("  " * i + f"a{i}:\n" for i in range(1000))]


def outcome(read, text):
    try:
        return repr(read(text))
    except (yaml.YAMLError, RecursionError) as e:
        return "RecursionError" if isinstance(e, RecursionError) else "YAMLError"


def test_trees_are_those_of_pyyaml():
    rnd, texts = random.Random(7), list(TEXTS)
    for text in TEXTS[:-4]:
        for _ in range(20):
            i = rnd.randrange(len(text) + 1)
            texts.append(text[:i] + rnd.choice("\t :-#?&*!|>'\"%[]{},é") + text[i + rnd.randrange(2) :])
    for text in texts:
        assert outcome(trees.documents, text) == outcome(lambda t: list(yaml.safe_load_all(t)), text), text[:300]
        assert outcome(trees.document, text) == outcome(yaml.safe_load, text), text[:300]
        if outcome(trees.documents, text) not in ("RecursionError", "YAMLError") and len(text) < 900:
            for node in trees.documents(text):
                assert trees.written(node) == yaml.dump(node, default_flow_style=False, allow_unicode=True)


@pytest.mark.skipif(not yaml.__with_libyaml__, reason="PyYAML without libyaml")
def test_plain_texts_are_read_by_libyaml(monkeypatch):
    monkeypatch.setattr(yaml, "safe_load_all", None)
    assert len(trees.documents(TEXTS[0])) == 2


def test_files_of_one_partition_are_parsed_by_several_tasks(spark):
    files = spark.range(200).coalesce(1).selectExpr("string(id) as file_path", "'yaml' as file_type", "'a: 1' as content")
    at = parsers.per_file(files, lambda path, kind, content: [(path, TaskContext.get().partitionId())], "file_path string, task int")
    assert at.select("task").distinct().count() > 1 and at.count() == 200
