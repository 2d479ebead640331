"""The corpus pipeline end to end, each stage against a brute-force version of its own."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sparkseam.llm import packing, pii, toxicity

P = pytest.importorskip("public_tokenizers")
WORDS = re.compile("[^\x20\x09-\x0d]+")
SPACES = re.compile("[\x20\x09-\x0d]+")
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(rows):
    """Rows that stay with their texts, by host counts over distinct texts."""
    norm = lambda line: SPACES.sub(" ", line).strip(" ").lower()
    lines = lambda t: [x for x in (t or "").split("\n") if WORDS.search(x)]
    held, texts = {}, {}
    for host, text in {(r["source"], r["text"]) for r in rows}:
        texts[host] = texts.get(host, 0) + 1
        for key in {norm(x) for x in lines(text)}:
            held[host, key] = held.get((host, key), 0) + 1
    frequent = {(h, k) for (h, k), n in held.items() if n > 20 and (n > 0.05 * texts[h] or n > 1000)}
    out = []
    for r in rows:
        text, words = r["text"] or "", WORDS.findall(r["text"] or "")
        at = {}
        for i in range(len(words) - 2):
            at.setdefault(tuple(words[i : i + 3]), []).append(i)
        repeated = len({i + k for s in at.values() if len(s) > 1 for i in s for k in range(3)})
        if len(words) < 50 or 100 * repeated > 50 * len(words):
            continue
        kept = [x for x in text.split("\n") if not WORDS.search(x) or (r["source"], norm(x)) not in frequent]
        if sum(len(w) for x in kept for w in WORDS.findall(x)) >= 0.5 * sum(map(len, words)):
            new = "\n".join(kept)
            out.append({**r, "text": new, "n_chars": r["n_chars"] if new == text else len(new)})
    return out


def clean(rows, labels):
    known = [(i, int(y != 0)) for i, y in sorted(set(labels)) if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5]
    text = {}
    for r in rows:
        text[r["doc_id"]] = min(text.get(r["doc_id"], r["text"]), r["text"])
    model = toxicity.fit([(text[i], y) for i, y in known if i in text])
    return [r for r in rows if model.score(r["text"]) < 0.5]


def distinct(rows):
    sets = []
    for r in rows:
        w = WORDS.findall(r["text"].translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    best = {}
    for i, r in enumerate(rows):
        best.setdefault(find(i), []).append((r["doc_id"] is None, r["doc_id"] or 0, r["text"], i))
    return [rows[i] for i in sorted(min(v)[3] for v in best.values())]


def masked(rows):
    model, out = pii.trained(), []
    for r, (base, spans) in zip(rows, pii.find([r["text"] for r in rows], pii.trained())):
        assert set(base) <= set(spans) and sorted(base) == sorted(pii.base_spans(r["text"]))
        new = pii.mask(r["text"], spans)
        out.append({**r, "text": new, "n_chars": r["n_chars"] if new == r["text"] else len(new)})
    assert model is pii.trained()
    return out


def rows_of(frame):
    return sorted((tuple(r[n] for n in NAMES) for r in frame.select(*NAMES).collect()), key=repr)


def plain(rows):
    return sorted((tuple(r[n] for n in NAMES) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """sf0.001 and rows with nulls, repeats, empty texts and toxic copies."""
    where, sf = tmp_path_factory.mktemp("pipeline"), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = [r.asDict() for r in docs.orderBy("doc_id").limit(12).collect()]
    insult = "you stupid worthless idiot, what a pathetic moron. "
    extra = [(None, " ".join(f"alone{k}" for k in range(80)), None, None, None), (5000, None, "en", "s", None), (5001, "", "en", "s", 0),
        (5002, insult + first[5]["text"] + "\n" + insult, "en", "s", 1)]
    extra += [(first[7]["doc_id"], first[8]["text"], "en", "s", 7), (first[9]["doc_id"], first[9]["text"], *[first[9][n] for n in NAMES[2:]]),
        (5003, first[10]["text"] + " tail", "en", "s", 9)]
    extra += [(5004, first[11]["text"] + " write to someone.else77@corp3.example.org now", "en", "s", 11)]
    docs.select(*NAMES).unionByName(spark.createDataFrame(extra, docs.select(*NAMES).schema)).coalesce(3).write.parquet(f"{where}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages_equal_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{tables}/labels.parquet").collect()]
    rows = [r.asDict() for r in docs.collect()]
    sizes = [len(rows)]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (quality, lambda r: clean(r, labels), distinct, masked)):
        docs = stage(spark, docs, tables).cache()
        rows = brute(rows)
        assert docs.columns == NAMES and rows_of(docs) == plain(rows), name
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > 20
    assert any("[EMAIL]" in r["text"] for r in rows) and None in [r["doc_id"] for r in rows]
    check_pieces(rows, corpus_pipeline.STAGES[4][1](spark, docs, tables).collect())


def check_pieces(rows, pieces):
    """Every id of every text is in exactly one piece, and sequences are full or powers of two."""
    own, at, got = packing.Tokens(P.path(corpus_pipeline.TOKENIZER)), {}, {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert all(n == 1024 or n & (n - 1) == 0 for n in at.values())
    want = {}
    for r in rows:
        ids = np.append(own.ids(r["text"]), 0).astype("<u4")
        want.setdefault((r["doc_id"], len(ids)), []).append(ids)
    assert set(got) == set(want)
    for key, texts in want.items():
        assert sum(m for _, m, _ in got[key]) == key[1] * len(texts)
        for s, m, crc in got[key]:
            assert any(zlib.crc32(ids[s : s + m].tobytes()) == crc for ids in texts)


def test_run_is_the_chain_of_its_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables).cache()
    check_pieces([r.asDict() for r in docs.collect()], corpus_pipeline.run(spark, tables).collect())


def test_empty_documents(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
