"""The corpus operators against brute force, libraries and the cases their docstrings define."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkseam.llm import batches, bpe, chat, jaccard_join, line_quality, packing, pii, shard_table, toxicity, url_filter, winnow

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)


def written(df, tmp_path, name="documents"):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def made_texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices(["th", "er", "an", "é", "ou", "日", "🙂"], k=rng.randint(1, 4))) for _ in range(200)]
    out = [None, "", " \n\t", "one", "two words", "a b c d", "A B C D", "x " * 300]
    for _ in range(n):
        out.append(" ".join(rng.choices(words, k=rng.randint(1, 120))).replace(" th ", "\n"))
    return out


# ---- 1


def repeat_words(words):
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for s in at.values() if len(s) > 1 for i in s for k in range(3)})


def test_line_quality_base_figures(spark):
    texts = [*made_texts(), "a b c a b c a b c\nx\nx\n \n \n#*$%&|<>!", "same line here\n" * 40]
    got = {r["doc_id"]: r for r in line_quality.assess(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORDS.findall(t)
        own = [x for x in t.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), repeat_words(w))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_line_quality_removes_frequent_lines_and_rejects_depleted(spark):
    rng = random.Random(3)
    own = lambda k: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(k))
    boiler = own(60)
    texts = [f"{own(80)}\n{boiler.upper() if i % 2 else boiler}  " for i in range(30)] + [f"{own(20)}\n{boiler}" for _ in range(5)] + ["copy " + own(80)] * 1
    texts += [own(90)] * 40  # copies of one text count once
    rows = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in line_quality.assess(rows).collect()}
    assert all(got[i]["kept"] and boiler not in got[i]["cleaned"].lower() for i in range(30))
    assert not any(got[i]["kept"] for i in range(30, 35))
    assert all(got[i]["kept"] for i in range(35, len(texts)))
    kept = {r["doc_id"]: r for r in line_quality.keep_good(rows).collect()}
    assert set(kept) == {i for i in got if got[i]["kept"]} and kept[0]["n_chars"] == len(kept[0]["text"])


def test_line_quality_limits_and_both_joins(spark):
    """A line above the absolute limit goes whatever its share; a count at a limit stays; broadcast and shuffle give one result."""
    rng = random.Random(6)
    own = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    texts = [f"{own()}\nin thirty of them\n{'x' * 50_000}" if i < 30 else f"{own()}\nin twenty of them" if i < 50 else own() for i in range(700)]
    rows = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("s")))
    for limits, gone in (({}, 0), ({"min_docs": 5, "max_docs": 14}, 30), ({"min_docs": 5, "max_docs": 15}, 0), ({"min_docs": 5, "max_share": 0.02}, 50)):
        both = []
        for most in (10**6, -1):
            got = {r["doc_id"]: r["cleaned"] for r in line_quality.assess(rows, broadcast_lines=most, **limits).collect()}
            assert sum(got[i] != t for i, t in enumerate(texts)) == gone
            both.append((got, {r["doc_id"]: r["text"] for r in line_quality.keep_good(rows.drop("n_chars"), broadcast_lines=most, **limits).collect()}))
        assert both[0] == both[1]


def test_line_quality_extra_columns_and_empty(spark):
    rows = docs_of(spark, made_texts()).selectExpr("*", "1 as kept", "2 as cleaned", "3 as n_words")
    out = line_quality.keep_good(rows)
    assert out.columns == rows.columns
    assert line_quality.assess(rows).count() == rows.count()
    assert line_quality.assess(rows.filter("false")).count() == 0 and line_quality.keep_good(rows.filter("false")).count() == 0


# ---- 2


def test_base_spans_match_plain_patterns():
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]"]

    def plain(t):
        out = []
        for k, p in enumerate(kinds):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m.group())
                if [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else 0, 13 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]:
                    out.append((k, *m.span()))
        return sorted(out)

    rng = random.Random(5)
    bits = ["1", "2", "25", ".", "@", "a", "b", "-", "+", "(", ")", " ", "_", "%", "0", "4111111111111111", "192.168.0.1", "x.y", "é"]
    for _ in range(5000):
        t = "".join(rng.choices(bits, k=rng.randint(1, 40)))
        assert sorted(pii.base_spans(t)) == plain(t), t


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = pii.Tagger(rng)
    model.p = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in model.p.items()}
    x, y = rng.integers(0, pii.VOCAB, (3, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [7, 8, 8, 0, 0, 1, 1]])
    _, grad = model.step(x, y)
    for name in ("hf", "xb", "out", "trans", "first", "embed", "cb"):
        at = tuple(rng.integers(0, s) for s in model.p[name].shape) if name != "trans" else (0, 1)
        if name == "embed":
            at = (x[0, 0], 2)
        was, loss = model.p[name][at], []
        for step in (1e-3, -1e-3):
            model.p[name][at] = was + step
            loss.append(model.step(x, y)[0])
        model.p[name][at] = was
        assert abs((loss[0] - loss[1]) / 2e-3 - grad[name][at]) < 5e-3, name


def test_tagger_held_out_accuracy():
    rng, hit, wrong, missed = np.random.default_rng(99), 0, 0, 0
    made = [pii._made(rng) for _ in range(200)]
    for (_, want), (_, got) in zip(made, pii.find([t for t, _ in made], pii.trained())):
        hit, wrong, missed = hit + len(set(want) & set(got)), wrong + len(set(got) - set(want)), missed + len(set(want) - set(got))
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.85


def test_tagger_adds_and_leaves_clean_texts(spark):
    texts = ["call (269) 555-3296 now please", "+1 (269) 555-3296 4524132264652876 x",
        "token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" plain words", None, "", "x" * 5000 + " mail a.b@c.de end"]
    got = {r["doc_id"]: r for r in pii.spans_of(docs_of(spark, texts)).collect()}
    assert "phone:" in got[0]["spans"] and got[0]["n_phone"] == 0
    assert got[2]["spans"] == "secret:9:49" and got[2]["n_added"] == 1 and got[3]["spans"] == got[4]["spans"] == ""
    assert got[5]["spans"] == "email:5006:5014" and got[5]["base_sha256"] == hashlib.sha256(b"email:5006:5014").hexdigest()
    out = {r["doc_id"]: r for r in pii.masked(docs_of(spark, texts).selectExpr("*", "1 as spans")).collect()}
    assert out[5]["text"].endswith("mail [EMAIL] end") and out[5]["n_chars"] == len(out[5]["text"]) and out[3]["text"] is None
    assert out[2]["text"] == 'token = "[SECRET]" plain words' and pii.spans_of(docs_of(spark, ["x", "x"], [1, 1])).count() == 2 and pii.masked(
        docs_of(spark, [])).count() == 0


def test_tagger_scores_kinds_apart_only_where_a_span_may_be(monkeypatch):
    for seed in range(5):
        own = pii.Tagger(np.random.default_rng(seed)).compiled()
        e = own.emissions(np.random.default_rng(seed).integers(0, pii.VOCAB, (200, 20)).astype(np.uint8))
        e[:, 1:] -= seed  # from every window to few
        assert set(own.candidates(e)) <= set(own.hopeful(e))
    model, seen = pii.trained(), []
    texts = ["plain words of a text " * 60, "", 'token = "0123456789abcdef0123456789abcdef01234567" words ' + "and more " * 200] * 20
    alone = [pii.tagged([t], model)[0] for t in texts[:3]]
    whole = pii.Compiled.candidates
    monkeypatch.setattr(pii.Compiled, "candidates", lambda self, e: seen.append(e.shape[2]) or whole(self, e))
    monkeypatch.setattr(pii, "BLOCK", 64)
    assert pii.tagged(texts, model) == alone * 20 and alone[2] and not alone[1]
    windows = sum(1 + max(0, -(-(len(t) - pii.WINDOW) // pii.STRIDE)) for t in texts if t)
    assert sum(seen) < windows / 5 and len(seen) < windows / 64  # before: every window, block by block


def test_compiled_tagger_equals_the_trained_layout():
    """Emissions of both layouts agree, and the forward pass drops only windows whose Viterbi path is O alone."""
    rng = np.random.default_rng(1)
    model = pii.Tagger(rng)
    model.p = {k: (v + 0.4 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in model.p.items()}
    own, x = model.compiled(), rng.integers(0, pii.VOCAB, (300, 12)).astype(np.uint8)
    e, _ = model.emissions(x.astype(np.int64))
    assert np.allclose(e, own.emissions(x).transpose(0, 2, 1), atol=1e-4)
    e[:, :, 0] += 2.0  # makes O likelier, so that both outcomes occur
    own.bias = own.bias.copy()
    own.bias[0] += 2.0
    rows, tags, _ = own.decode(x)
    found, moves = dict(zip(rows.tolist(), tags)), model.moves()
    for w in range(len(x)):
        best = {k: (model.p["first"][k] + e[0, w, k], [k]) for k in range(pii.K)}
        for t in range(1, 12):
            best = {k: max(((s + moves[p[-1], k] + e[t, w, k], [*p, k]) for s, p in best.values()), key=lambda v: v[0]) for k in range(pii.K)}
        score, path = max(((s + model.p["last"][k], p) for k, (s, p) in best.items()), key=lambda v: v[0])
        none = model.p["first"][0] + e[:, w, 0].sum() + 11 * moves[0, 0] + model.p["last"][0]
        assert path == found[w].tolist() if w in found else score - none < 2 * pii.LEAST_GAIN
    assert 0 < len(rows) < len(x)


def test_tagger_alone_on_texts_of_the_corpus(spark):
    """The patterns stand in for labels: texts and labels are none of the training generator's."""
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    model = pii.trained()
    alone, found = pii.tagged(texts, model), pii.find(texts, model)
    want = {(i, *s) for i, t in enumerate(texts) for s in pii.base_spans(t)}
    want |= {(i, 4, *m.span(1)) for i, t in enumerate(texts) for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    tagger = {(i, k, s, e) for i, own in enumerate(alone) for k, s, e in own if pii.plausible(k, texts[i][s:e])}
    assert len(tagger & want) / len(want) > 0.9 and len(tagger - want) / len(tagger) < 0.05
    added = {(i, *s) for i, (b, a) in enumerate(found) for s in a if s not in b}
    assert len(added) > 8 and len(added & want) / len(added) > 0.9


def test_spans_cut_by_windows_are_joined():
    model = pii.trained()
    mail = "maria.lopez@post7.example.com"
    for at in range(pii.WINDOW - 45, pii.WINDOW + 10, 3):
        for made in (mail.replace("@", " [at] "), "4132-4132-6465-2874", "(269) 555-3296", "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"):
            text = ("word " * 80)[: at - 1] + " " + made + " word" * 40
            spans = pii.tagged([text], model)[0]
            assert all(e - s > 5 for _, s, e in spans)
    long = ("kelani sor " * 30) + "token = \"" + "1a2b3c4d5e6f7a8b" * 20 + "\" end"
    assert any(k == 4 and e - s > 300 for k, s, e in pii.tagged([long], model)[0])
    parts = [((0, 100, 160), 5.0, False, True), ((0, 128, 200), 7.0, True, False), ((0, 210, 220), 1.0, False, False), ((1, 150, 160), 1.0, False,
        False), ((0, 220, 225), 1.0, False, False)]
    assert [x[0] for x in pii.joined(parts)] == [(0, 100, 200), (0, 210, 220), (0, 220, 225), (1, 150, 160)]


def test_windows_are_reconciled_globally():
    assert pii.reconcile([((0, 0, 10), 1.0), ((0, 5, 12), 3.0), ((1, 12, 20), 1.0), ((0, 0, 10), 2.5)]) == [(0, 5, 12), (1, 12, 20)]
    assert pii.mask("ab cd ef", [(0, 0, 2), (1, 1, 5)]) == "[EMAIL] ef"


# ---- 3


def test_reply_tree_paths(spark):
    nodes = [("t", 1, None, 1.0), ("t", 2, 1, 2.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 3, None), ("u", 1, None, 0.0), ("u", 2, 99, 1.0),
        ("c", 1, 2, 1.0), ("c", 2, 1, 1.0)]
    frame = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    paths = {}
    for r in chat.root_paths(frame, 2).collect():
        paths.setdefault((r["tree"], r["rank"]), []).append((r["depth"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {("t", 1): [1, 2, 4], ("t", 2): [1, 3, 5], ("u", 1): [2], ("u", 2): [1]}
    deep = spark.range(300).selectExpr("'d' as tree", "id as node", "case when id > 0 then id - 1 end as parent", "1.0D as score")
    assert sorted((r["depth"], r["node"]) for r in chat.root_paths(deep).collect()) == [(i, i) for i in range(300)]
    assert chat.root_paths(frame.filter("false")).count() == 0


def test_reply_trees_with_null_trees_repeats_and_other_columns(spark):
    nodes = [(None, 1, None, 1.0), (None, 2, 1, 1.0), (5, 1, None, 1.0), (5, 2, 1, 1.0), (5, 2, 1, 3.0), (5, 3, 1, 2.0), (5, None, 1, 9.0)]
    frame = spark.createDataFrame(nodes, "tree long, node long, parent long, score double").selectExpr("*", "1 as up", "2 as rank")
    paths = chat.root_paths(frame)
    assert sorted((str(r["tree"]), r["depth"], r["node"]) for r in paths.collect()) == [("5", 0, 1), ("5", 1, 2), ("None", 0, 1), ("None", 1, 2)]
    long = "word " * 50_000
    turns = [(None, 1, "user", "hi"), (None, 2, "assistant", long), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 2, None, None)]
    got = {r["tree"]: r for r in chat.format_paths(paths, spark.createDataFrame(turns, "tree long, node long, role string, text string").selectExpr(
        "*", "1 as leaf")).collect()}
    assert got[None]["formatted"] == f"<|im_start|>user<|im_sep|>hi<|im_end|><|im_start|>assistant<|im_sep|>{long}<|im_end|>"
    assert got[5]["formatted"] == "<|im_start|>user<|im_sep|>a<|im_end|><|im_start|><|im_sep|><|im_end|>" and got[5]["loss_spans"] == []


def test_chat_keeps_conversations_without_an_id(spark, tmp_path):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, 0, "user", "c")]
    written(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tmp_path, "conversations")
    got = {r["conv_id"]: r["n_turns"] for r in chat.op3_reply_trees(spark, str(tmp_path)).collect()}
    assert got == {None: 2, 5: 1, -1: 2}


def test_chat_round_trip(spark, tmp_path):
    rng, bits = random.Random(2), [*chat.CONTROLS, "\\", "\n", "a", "é", "<", "[", ">", "|", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole", None]), None if rng.random() < 0.1 else "".join(rng.choices(bits,
        k=rng.randint(0, 12)))) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [rows[0]]  # a repeated row
    written(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tmp_path, "conversations")
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in chat.op3_reply_trees(spark, str(tmp_path)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda v: v[0])
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest())


# ---- 4


def test_token_ids_are_the_librarys():
    from tokenizers import Tokenizer

    full, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.Tokens(P.path("byte_bpe_50k.json"))
    rng, bits = random.Random(1), ["a", "the ", " ", "\n", "é", "日本", "'s", "don't", "12", " 3", ".", "!?", "\t", "\x1c", "<|endoftext|>", "🙂", "\0"]
    for _ in range(1500):
        t = "".join(rng.choices(bits, k=rng.randint(0, 30)))
        assert own.ids(t).tolist() == full.encode(t, add_special_tokens=False).ids


def test_texts_are_split_alike_without_looking_ahead_and_special_strings_are_packed(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    full, own = Tokenizer.from_file(path), packing.Tokens(path)
    assert "full" not in own.__dict__  # the slower library is loaded for special strings only
    rng, bits = random.Random(2), [" ", " ", "\n", "\t", "\x85", "\xa0", "\x1c", "a", "é", "1", "²", "'s", "'", "_", "٣", "漢"]
    for _ in range(3000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        assert own.ids(t).tolist() == full.encode(t, add_special_tokens=False).ids
    assert "full" not in own.__dict__
    texts = ["a <|endoftext|> b", "plain", "two\n\n\nthree  "]
    out = packing.pack(docs_of(spark, texts), path).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in out} == {i: len(full.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_texts_go_to_python_in_batches_of_bounded_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    packing.pack(docs_of(spark, ["x"]), P.path("byte_bpe_50k.json"))
    rows = spark.range(0, 9000, 1, 1).selectExpr("repeat('x', 2000) as t").mapInArrow(sizes, "n long").collect()
    assert max(r[0] for r in rows) < 2 * batches.BYTES
    spark.conf.set(batches.BOUND, "16m")  # a session's own bound stays
    batches.small_batches(spark)
    assert spark.conf.get(batches.BOUND) == "16m"
    spark.conf.unset(batches.BOUND)


def test_layout_is_gapless_and_whole():
    rng = random.Random(4)
    for _ in range(150):
        sizes = [rng.choice([1, 1, 5, 300, 1024, 2048, rng.randint(1, 3000)]) for _ in range(rng.randint(1, 25))]
        at, cover = {}, {}
        for d, s, m, q, o in packing.layout(sizes, lambda i: np.random.rand(len(sizes)), 1024):
            assert m > 0 and at.get(q, 0) == o
            at[q] = o + m
            cover.setdefault(d, []).append((s, s + m))
        assert all(v == 1024 or v & (v - 1) == 0 for v in at.values())
        for d, n in enumerate(sizes):
            c = sorted(cover[d])
            assert c[0][0] == 0 and c[-1][1] == n and all(a[1] == b[0] for a, b in zip(c, c[1:]))


def test_packing_checksums_and_neighbours(spark):
    path = P.path("byte_bpe_50k.json")
    own = packing.Tokens(path)
    texts = [None, "", "x", *["lemon orange fruit juice " * 20, "engine wheel brake motor " * 20] * 3]
    out = packing.pack(docs_of(spark, texts), path, window=256).collect()
    for r in out:
        ids = np.append(own.ids(texts[r["doc_id"]] or ""), 0).astype("<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in out) == sum(len(own.ids(t or "")) + 1 for t in texts)
    index = packing.Index([own.ids(t or "") for t in texts], np.ones(own.size, np.int64), len(texts), 50.0)
    assert index.scores(3)[5] > index.scores(3)[4] and packing.pack(docs_of(spark, []), path).count() == 0


def test_packing_fills_windows_with_the_best_unused_neighbours(spark):
    """One chain in one shard gives the windows of brute force."""
    path, rng = P.path("byte_bpe_50k.json"), random.Random(7)
    own = packing.Tokens(path)
    words = [f"{a}{b}" for a in ("stone", "river", "cloud", "wheel", "grape") for b in ("mark", "line", "fall", "work", "yard", "house")]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(90)]
    out = packing.pack(docs_of(spark, texts), path, window=512).collect()
    ids = [own.ids(t) for t in texts]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=own.size)
    index = packing.Index(ids, df, len(ids), sum(len(x) + 1 for x in ids) / len(ids))
    laid = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        laid.setdefault(r["sequence_id"], []).append((r["doc_id"], r["start"]))
    used = set()
    for seq in sorted(laid)[:4]:
        first = laid[seq][0][0]
        used.add(first)
        scores = index.scores(first)
        for doc, start in laid[seq][1:]:
            assert start == 0 and scores[doc] == max(s for j, s in enumerate(scores) if j not in used)
            used.add(doc)


def test_packing_in_many_shards_is_whole_and_keeps_alike_documents_together(spark):
    path, rng = P.path("byte_bpe_50k.json"), random.Random(3)
    own = packing.Tokens(path)
    topics = [[f"{a}{b}" for b in ("mark", "line", "fall", "work", "yard")] for a in ("stone", "river", "cloud", "wheel", "grape")]
    texts = [" ".join(rng.choices(topics[i % 5], k=rng.randint(5, 40))) for i in range(200)] + ["same text"] * 60 + [None] * 40
    rows = docs_of(spark, texts + [texts[0]] * 5, [*range(len(texts)), *[0] * 5])  # repeated rows
    out = packing.pack(rows.selectExpr("*", "1 as _key", "2 as _ids", "3 as start"), path, window=128, shard_tokens=500).collect()
    sizes = {i: len(own.ids(t or "")) + 1 for i, t in enumerate(texts)}
    assert sum(r["length"] for r in out) == sum(sizes.values()) + 5 * sizes[0] and {r["doc_id"] for r in out} == set(sizes)
    at, inside = {}, {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
        inside.setdefault(r["sequence_id"], []).append(r["doc_id"])
    assert all(v == 128 or (v < 128 and v & (v - 1) == 0) for v in at.values())
    pairs = [(a % 5, b % 5) for own_ in inside.values() for a, b in zip(own_, own_[1:]) if a < 200 and b < 200]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.8


def test_distinct_ids_and_content_keys():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50, k).astype("<u2") for k in (0, 1, 30, 0, 7, 200, 0)]
    terms, tf, counts = packing.distinct(docs)
    ends = np.cumsum(counts)
    for x, a, b in zip(docs, ends - counts, ends):
        want = np.unique(x, return_counts=True)
        assert terms[a:b].tolist() == want[0].tolist() and tf[a:b].tolist() == want[1].tolist()
    df = np.bincount(np.concatenate([np.unique(x) for x in docs]), minlength=50)
    content = packing.Content(df, 7, 30.0, rng.standard_normal((5, packing.DIMENSIONS)))
    keys, heavy = content.keys(terms, tf, counts, np.array([len(x) for x in docs]))
    for i, x in enumerate(docs):
        t, c = np.unique(x, return_counts=True)
        w = np.log1p((7 - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / 30.0))
        assert heavy[i] == (t[w.argmax()] if len(t) else 0)
        v = np.zeros(packing.DIMENSIONS)
        np.add.at(v, content.cell[t], w * content.sign[t])
        assert keys[i] == (content.centres @ v).argmax()
    assert all(len(x) == 0 for x in packing.distinct([])) and packing.distinct([docs[0]])[2].tolist() == [0]


def test_packing_offers_are_exact_and_whole():
    """The query is all of a document's ids; offers are the best by a full sort, equal scores in turn after the seed."""
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 400, rng.integers(0, 120)) ** 2 // 400 for _ in range(150)] * 2
    df = np.bincount(np.concatenate([np.unique(x) for x in docs]), minlength=400)
    index, sizes = packing.Index(docs, df, len(docs), 60.0), np.array([len(x) + 1 for x in docs])
    assert all(set(index.query(i)) == set(docs[i]) for i in range(300))
    weight = [dict(zip(t.tolist(), packing.weights(t, c, np.full(len(t), len(x)), df, 300, 60.0))) for x in docs for t, c in [np.unique(x, return_counts=True)]]
    seeds = [3, 77, 299, 150]
    chains = packing.Chains(sizes, np.array([0, 75, 150, 225, 300]), 1024)
    for spent in (0.0, 0.3, 0.6):
        chains.used |= rng.random(300) < spent
        chains.first, chains.room = list(seeds), [50, 400, 1024, 1]
        factor = {2: 300}
        got = {}
        for c, doc in packing.offers(index, chains, [0, 1, 2, 3], factor):
            got.setdefault(c, []).append(doc)
        for c, seed in enumerate(seeds):
            score = lambda j: round(sum(weight[j].get(t, 0.0) for t in index.query(seed).tolist()), 4)  # noqa: E731, B023
            want = [j for *_, j in sorted((-score(j), (j - seed - 1) % 300, j) for j in range(300) if not chains.used[j])]
            need = chains.room[c] * factor.get(c, 2)
            assert got[c] == [j for j, before in zip(want, np.cumsum([0, *sizes[want]])) if before < need]


# ---- 5


def test_grammar_marks_contexts():
    model = toxicity.Model({"idiot": 1.0})
    plain, target, negated, reported = (model.evidence(t) for t in ("an idiot came", "you are an idiot", "not an idiot here", "she said idiot"))
    assert 0 < negated < reported < plain < target and model.evidence("we will kill you") == 1.0
    assert model.evidence("kill the weeds. you go") == 0 and model.score(None) == model.score("") < 0.5
    assert len(model.clauses("idiot, idiot. fine! IDIOT###")) == 3


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()}
    got = [r for r in toxicity.op5_toxicity(spark, sf).collect() if r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    test = [r for r in got if r["held_out"]]
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    toxic, clean = ([r for r in test if labels[r["doc_id"]] == y] for y in (1, 0))
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.85 and sum(r["predicted"] for r in clean) / len(clean) < 0.015
    for k, least in (("en", 0.85), ("fr", 0.8), ("de", 0.8), ("es", 0.5)):
        own = [r["predicted"] for r in toxic if lang[r["doc_id"]] == k]
        assert sum(own) / len(own) >= least, (k, sum(own), len(own))


def test_toxicity_scores_against_plain_rules():
    """A second reading of the grammar, without transducers: every clause's best word by the rules of the docstring."""
    model = toxicity.Model({"idiot": 1.0, "ox": 0.4}, {"trott": 0.7, "trottelig": 0.9}, -4.0, 3.0)
    words = ["idiot", "ox", "oxen", "trottel", "trotteliger", "trot", "you", "them", "kill", "hurt", "not", "never", "said", "the", "a", "cat",
        "don't", "you're"]
    kind = {**dict.fromkeys(["you", "them"], "G"), **dict.fromkeys(["kill", "hurt"], "T"), **dict.fromkeys(["not", "never", "don't"], "N"), "said": "R"}
    lexical = {"idiot": 1.0, "ox": 0.4, "trottel": 0.7, "trotteliger": 0.9}

    def clause(own):
        best = 0.0
        for i, w in enumerate(own):
            near = lambda k, n: any(kind.get(x) == k for x in own[max(0, i - n) : i])  # noqa: E731, B023
            weight = 1.0
            if w in lexical:
                weight = lexical[w] * (1.3 if near("G", 5) else 1.0)
            elif not (kind.get(w) == "G" and near("T", 3)):
                continue
            weight *= (0.4 if near("N", 4) else 1.0) * (0.6 if near("R", i) else 1.0)
            best = max(best, weight)
        return best

    rng = random.Random(8)
    for _ in range(2000):
        clauses = [[rng.choice(words) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 4))]
        text = "".join(" ".join(c) + rng.choice([". ", "\n", ", ", "! "]) for c in clauses)
        own = [[w.split("'")[0] if "'" in w and w not in kind else w for w in c] for c in clauses]
        want = [x for x in map(clause, own) if x]
        assert model.clauses(text) == pytest.approx(want), text
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(4 - 3 * min(sum(want), toxicity.MOST))))


def test_toxicity_training_on_executors_equals_the_local_fit(spark):
    rng = random.Random(4)
    bad, words = ["zornig", "zornige", "zorniger", "blodel"], [f"wort{k}" for k in range(80)]
    texts, labels = [], []
    for i in range(200):
        y = int(i % 4 == 0)
        texts.append(" ".join(rng.choices(words, k=20) + ([rng.choice(bad)] if y else [])))
        labels.append((i, 0, y))
    texts[7], texts[9] = None, texts[13]
    docs, known = docs_of(spark, texts), spark.createDataFrame([*labels, (None, 0, 1), (5, 0, None), labels[3]], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs.unionByName(docs.limit(3)), known)
    want = toxicity.fit([(texts[i], y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5])
    assert model.stems == want.stems and "zorni" in model.stems and model.insults == want.insults
    assert (model.offset, model.slope) == pytest.approx((want.offset, want.slope), abs=1e-6)
    assert model.score("ein zornigster tag") > model.score("ein guter tag")


def test_toxicity_edges(spark):
    docs = docs_of(spark, [None, "", "you idiot", "fine " * 30]).selectExpr("*", "1 as score")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    assert got[0] == got[1] == got[3] < 0.5 < got[2]
    assert {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()} == {0, 1, 3} and toxicity.scores(docs.filter("false"), model).count() == 0


# ---- 6


def brute_links(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_is_exact(spark, seed):
    rng = random.Random(seed)
    texts = made_texts(seed, 40)
    passage = " ".join(f"p{k}" for k in range(40))
    for t in [x for x in texts if x][5:30]:
        for _ in range(rng.randint(1, 6)):
            w = t.split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["new", "word", "here"])
            texts.append(" ".join(w[rng.randint(0, 2) :]))
    texts += [f"{passage} {' '.join(rng.choices('abcdefghijk', k=rng.randint(3, 30)))}" for _ in range(40)]
    texts += ["one", "ONE", "two words", "x y z w v u"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked(docs_of(spark, texts).selectExpr("*", "1 as node",
        "2 as n")).collect()}
    assert got == brute_links(texts)


def test_jaccard_chain_and_edges(spark):
    words = [f"w{k}" for k in range(130)]
    chain = [" ".join(words[k : k + 100]) for k in range(0, 30, 3)]  # neighbours link, the ends don't
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.linked(docs_of(spark, chain)).collect()}
    assert set(got.values()) == {0} and brute_links(chain)[9][1] == 0
    assert jaccard_join.linked(docs_of(spark, [])).count() == 0
    assert [r["component_id"] for r in jaccard_join.linked(docs_of(spark, [None, ""])).orderBy("doc_id").collect()] == [0, 1]


def test_jaccard_ids_of_any_type(spark):
    texts = ["a b c d e f", "A b c d e f", "x y", None]
    for ids, kind in ((["d", "b", "c", None], "string"), ([2.5, 1.5, 3.0, None], "double")):
        rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string").selectExpr("*", "1 as _hash", "2 as key")
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.linked(rows).collect()}
        assert got == {ids[0]: ids[1], ids[1]: ids[1], ids[2]: ids[2], None: None}


def test_keep_one_of_each_component(spark):
    a, b = "one two three four five six", "other words stand here in this text"
    rows = [(1, a), (5, b), (5, a), (6, b + " "), (7, "solo text"), (7, "solo text"), (7, "SOLO text"), (8, None), (8, ""), (None, a), (None, "null owns this")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _node", "doc_id * 2 as n")
    docs = docs.drop("_node")
    out = jaccard_join.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, [(1, a), (5, b), (7, "SOLO text"), (8, None),
        (8, ""), (None, "null owns this")]))
    assert jaccard_join.keep_one(docs.filter("doc_id in (1, 6)")).count() == 2 and jaccard_join.keep_one(docs.filter("false")).count() == 0


def test_pairs_of_a_large_signature_meet_once_in_blocks(spark):
    n = 60
    members = spark.range(n).selectExpr("1L as sig", f"{n}L as many", "id as node", "id % 50 as comp")
    sets = spark.range(n).selectExpr("id as node", "10L as n", "array(0L, 0L) as odd")
    want = {(p, q) for q in range(n) for p in range(q) if p % 50 != q % 50}
    for block in (1000, 7):
        got = [(r["_p"], r["_q"]) for r in jaccard_join.across(members, sets, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_most_apart_bounds_every_linked_pair():
    for a in range(1, 120):
        for b in range(a, 120):
            least = -(-4 * (a + b) // 9)
            if least <= a:
                assert a + b - 2 * least <= int(jaccard_join.most_apart(a + b))


# ---- 7


def test_lookup_table_is_filled_by_turns(spark):
    names, slots = ["a", "b", "c", "d", "e"], 101
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    order = [[(h(n + "/offset") % slots + k * (h(n + "/skip") % (slots - 1) + 1)) % slots for k in range(slots)] for n in names]
    want, at, turn = {}, [0] * len(names), 0
    while len(want) < slots:
        while order[turn][at[turn]] in want:
            at[turn] += 1
        want[order[turn][at[turn]]] = names[turn]
        turn = (turn + 1) % len(names)
    assert {r["slot"]: r["shard"] for r in shard_table.lookup_table(spark, names, slots).collect()} == want
    rows = spark.createDataFrame([("k1", 1), (None, 2), ("k1", 3)], "key string, shard int").selectExpr("*", "9 as _slot_of_row", "8 as slot")
    placed = shard_table.place(rows, "key", names, slots)
    assert placed.columns == ["key", "shard", "_slot_of_row", "slot", "_slot", "_shard"] and placed.filter("slot = 8 and _slot_of_row = 9").count() == 3
    assert shard_table.place(rows.filter("false"), "key", names, slots).count() == 0
    assert shard_table.place(spark.range(1).selectExpr("repeat('x', 1000000) as key", "1 as _shard", "2 as _slot"), "key", names,
        slots).first()["shard"] in names
    got = {r["shard"]: r["_shard"] for r in placed.collect()}
    assert got[1] == got[3] == want[h("k1") % slots] and got[2] == want[h("") % slots]
    with pytest.raises(ValueError):
        shard_table.lookup_table(spark, names, 100)


# ---- 8


def plain_print(units, k, w):
    """Kept (place, hash) of winnowing, from the definition: seeded hashes of units, cyclic polynomial, rightmost minima."""
    import xxhash

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    h = [xxhash.xxh64(u.encode(), seed=42).intdigest() for u in units]
    turn = lambda x, b: ((x << b) | (x >> (64 - b))) & (2**64 - 1)
    grams = []
    for i in range(len(h)):
        x = h[i]
        for j in range(1, k):
            x ^= turn(h[i - j], 21 * j % 63 + 1) if i >= j else 0
        grams.append(signed(xxhash.xxh64(x.to_bytes(8, "little"), seed=42).intdigest()))
    starts = range(max(1, len(grams) - w + 1)) if grams else []
    places = sorted({max(range(s, min(s + w, len(grams))), key=lambda p: (-(grams[p] >> winnow.PLACE_BITS), p)) for s in starts})
    return [(p, grams[p]) for p in places]


def test_winnowing_against_plain_windows(spark, tmp_path):
    texts = made_texts(7, 30)
    got = {r["doc_id"]: r for r in winnow.op8_winnowing(spark, written(docs_of(spark, texts, [3 * i for i in range(len(texts))]), tmp_path)).collect()}
    prints = [plain_print(WORDS.findall(t or ""), winnow.K, winnow.WINDOW) for t in texts]

    def alike(a, b):
        x, y = {h for _, h in a}, {h for _, h in b}
        return len(x & y) / len(x | y) if x | y else 1.0

    for i, t in enumerate(texts):
        t, r = t or "", got[3 * i]
        nxt = texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        other = plain_print(WORDS.findall(edited), winnow.K, winnow.WINDOW)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        assert r["fingerprint"] == ",".join(f"{h % 2**64:X}:{p}" for p, h in prints[i]) and r["edited_fingerprint"] == ",".join(f"{h % 2**64:X}:{p}"
            for p, h in other)
        assert r["near_edited"] == pytest.approx(alike(prints[i], other)) and r["near_next"] == pytest.approx(alike(prints[i], prints[(i + 1) % len(texts)]))


def test_winnowing_of_characters_and_long_texts(spark):
    texts = ["abracadabra", "", None, "é🙂" * 50, "abc" * 4000]
    for window in (4, 7, 1):
        print_ = winnow.fingerprint(F.col("text"), 5, window, winnow.characters)
        for r in docs_of(spark, texts).select("doc_id", print_.alias("f")).collect():
            want = plain_print(texts[r["doc_id"]] or "", 5, window)
            assert list(zip(r["f"]["places"], r["f"]["hashes"])) == want


def test_winnowing_edges(spark, tmp_path):
    rows = docs_of(spark, ["b b b b", "a", "same text here", "same text here", None], [5, 5, 7, 8, None])
    out = winnow.op8_winnowing(spark, written(rows, tmp_path)).collect()
    assert len(out) == 5
    same = {r["doc_id"]: r for r in out if r["doc_id"] in (7, 8)}
    assert same[7]["fingerprint"] == same[8]["fingerprint"] and same[7]["near_next"] == 1.0
    assert next(r for r in out if r["doc_id"] is None)["fingerprint"] == ""


# ---- 9


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(r), len(r.split("/")[0]), a == "block", r) for a, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
        and path.startswith(r[r.index("/") :])]
    best = max((f[:3] for f in fits), default=None)
    rule = min((f[3] for f in fits if f[:3] == best), default=None)
    return host, path, rule, next((a for a, r in rules if r == rule), "allow")


def test_url_rules(spark):
    rng = random.Random(1)
    rules = [*url_filter.RULES, ("block", "a.org/x"), ("allow", "b.a.org/"), ("block", "net/")]
    urls = [None, "", "http:/x", "http://org", "http://ORG/", "https://ex.EXAMPLE.org/en/12?q=/es/", "x://example.org/es/",
        "http://notexample.org/es/", "http://a.org?x/", "é://Éa.org/x", "://com/de/#a", "http://a..org/x"]
    urls += ["http://" + ".".join(rng.choices(["a", "b", "org", "com", "example", "net"], k=rng.randint(1, 4))) + rng.choice(["/", "/x", "/fr/1",
        "/de/", "", "?a"]) for _ in range(200)]
    urls += urls[5:8]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as rule", "2 as _id")
    for limit in (url_filter.BROADCAST_RULES, 0):
        got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(frame, url_filter.rules_frame(spark, rules), broadcast_rules=limit).collect()}
        assert got == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}
    assert {r["verdict"] for r in url_filter.judge(frame, url_filter.rules_frame(spark, [])).collect()} == {"allow"}
    assert url_filter.judge(frame.filter("false"), url_filter.rules_frame(spark, rules)).count() == 0


# ---- 10


def test_sentencepiece_equals_the_library():
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), bpe.Encoder(P.path("piece_bpe_32k.model"))
    rng, bits = random.Random(1), ["a", "b", "th", "the", " ", "  ", "\n", "e", "é", "日", "▁", ".", "aa", "ing", "\t", "🙂", "1", "-", "\r", "    ", "\0"]
    texts = ["", " ", "   ", "\n\n", "a" * 3000, " " * 40, "ab" * 700, "naïve café"] + ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(4000)]
    for t, (ids, n, said) in zip(texts, own.encode(texts)):
        want = lib.encode(t)
        assert (ids, n, said) == (",".join(map(str, want)), len(want), lib.decode(want)), repr(t)
        assert own.decode(want) == lib.decode(want)
    assert own.decode([own.byte[0xE9], own.byte[0x41], 20]) == lib.decode([own.byte[0xE9], own.byte[0x41], 20])


def test_sentencepiece_rows(spark):
    rows = docs_of(spark, [None, "", "hello world", "hello world"]).selectExpr("*", "1 as n_tokens")
    got = {r["doc_id"]: r for r in bpe.digest(rows, P.path("piece_bpe_32k.model")).collect()}
    assert got[0]["n_tokens"] == got[1]["n_tokens"] == 0 and got[2]["ids_sha256"] == got[3]["ids_sha256"] and got[0]["ids_sha256"] == hashlib.sha256(
        b"").hexdigest()
    assert [r["decoded"] for r in bpe.encode_column(rows, P.path("piece_bpe_32k.model")).orderBy("doc_id").collect()] == ["", "", "hello world", "hello world"]


def test_components_agree_on_both_paths(spark):
    rng = random.Random(5)
    links = [(rng.randint(1, 120), rng.randint(1, 120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)]
    frame = spark.createDataFrame([x for x in links if x[0] != x[1]], "a long, b long")
    one, many = ({r["node"]: r["comp"] for r in jaccard_join.components(frame, small).collect()} for small in (10**6, 0))
    assert one == {**{n: c for n, c in one.items() if n == c}, **many}
