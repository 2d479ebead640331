"""Periodic runs, language identification and importance resampling against brute force and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseam.llm import language_id, resampling, word_runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile("[^\x20\x09-\x0d]+")
FEATURES = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def docs_of(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, x, "s", None if t is None else len(t)) for i, t, x in zip(ids, texts, langs)], DOCS)


def written(df, tmp_path, name="documents"):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# ---- 11


def runs_by_hand(words):
    out, n = {}, len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((a, n, p) for (a, n), p in out.items()), key=lambda r: (r[0], r[2]))


def periodic_texts(seed, count):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        words, letters = [], rng.randint(1, 4)
        for _ in range(rng.randint(0, 12)):
            block = [f"w{rng.randrange(letters)}" for _ in range(rng.randint(1, 5))]
            words += block * rng.choice([1, 1, 2, 4, 7])
        out.append(words)
    return out


@pytest.mark.parametrize("block", [7, word_runs.BLOCK])
def test_runs_equal_those_found_by_hand(monkeypatch, block):
    monkeypatch.setattr(word_runs, "BLOCK", block)
    texts = periodic_texts(5, 400)
    got = word_runs.runs_of([[w.encode() for w in t] for t in texts])
    want = [runs_by_hand(t) for t in texts]
    assert got == want and sum(map(len, want)) > 200


def test_runs_survive_hashes_that_lie(monkeypatch):
    """A modulus of 7 calls many different words equal; the runs found are the same."""
    monkeypatch.setattr(word_runs, "PRIME", np.uint64(7))
    monkeypatch.setattr(word_runs, "BASE", np.uint64(3))
    texts = periodic_texts(6, 150)
    assert word_runs.runs_of([[w.encode() for w in t] for t in texts]) == [runs_by_hand(t) for t in texts]


def test_one_very_long_text_of_one_word():
    assert word_runs.runs_of([[b"a"] * 60_000]) == [[(0, 60_000, 1)]]


def test_grid_has_few_points():
    points = sum(len(x[0]) for x in word_runs.grid(np.array([0, 20_000]), 6, 4))
    assert points < 20_000 * math.log(20_000) / 3


def row_by_hand(doc_id, text):
    words = WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_hand(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    dropped = {i for a, m, p in runs for i in range(a + p, a + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *four, sha("".join(f"{a},{m},{p}\n" for a, m, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_11_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "a", "x " * 5, "x " * 6, "a b " * 4, "a b " * 7, "é日 🙂 " * 9, *(" ".join(t) for t in periodic_texts(7, 150))]
    texts += [" ".join(rng.choices(["the", "of", "a", "law"], k=rng.randint(1, 90))) for _ in range(60)]
    sf = written(docs_of(spark, texts), tmp_path)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
        for r in word_runs.op11_periodic_runs(spark, sf).collect()}
    assert got == {i: row_by_hand(i, t) for i, t in enumerate(texts)}


def test_scan_with_nulls_repeats_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a " * 8, 1), (3, None, 2), (3, None, 2), (4, "a b " * 4, 3)], "id string, body string, runs int")
    got = sorted((r["id"] or "", r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in word_runs.scan(df, "id", "body").collect())
    assert got == [("", 8, [(0, 8, 1)], "a"), ("3", 0, [], ""), ("3", 0, [], ""), ("4", 8, [(0, 8, 2)], "a b")]
    assert word_runs.scan(df.limit(0), "id", "body").count() == 0


# ---- 12


def test_kneser_ney_is_a_distribution_and_follows_its_formula():
    counts = Counter(g for w in ["banana", "bandana", "cab", "abba", "a"] for g in language_id.grams(w, 3))
    model = language_id.fitted({"x": counts}, 3)
    letters = [*"abcdn", language_id._END]
    for history in ("", "b", "an", "ban", "zz", "ca"):
        # the cost of a word's letters: a word's cost less that of its beginning, with every possible next symbol
        logs = []
        for c in letters:
            marked = f"{language_id._START}{history}{c}"
            p = 1 / model.letters
            for k in range(1, 4):
                gram = marked[-k:] if k < len(marked) else marked
                if k > len(marked):
                    break
                terms, rest = model.tables[0][k - 1]
                p = terms.get(language_id.hashes([gram]), 0.0)[0] + rest.get(language_id.hashes([gram[:-1]]), 1.0)[0] * p
            logs.append(p)
        assert sum(logs) == pytest.approx(1 - logs_of_unseen(model, history), abs=1e-5)
    assert model.letters == len(letters) + 1


def logs_of_unseen(model, history):
    """Probability of the one symbol that stands for all unseen letters."""
    marked, p = f"{language_id._START}{history}?", 1 / model.letters
    for k in range(1, min(3, len(marked)) + 1):
        p *= model.tables[0][k - 1][1].get(language_id.hashes([marked[-k:-1] if k > 1 else ""]), 1.0)[0]
    return p


def test_continuation_counts_ignore_how_often_a_gram_stands():
    """`q` stands often but after one letter only, so alone it is less likely than a letter seen after many."""
    counts = Counter({g: n for w, n in (("aq", 50), ("xe", 1), ("ye", 1), ("ze", 1)) for g in language_id.grams(w, 2)})
    counts.update({g: 50 for g in language_id.grams("aq", 2)})
    terms = dict(zip(["q", "e"], language_id.kneser_ney(counts, 2)[0][0].get(language_id.hashes(["q", "e"]), 0.0)))
    assert terms["e"] > terms["q"]


def test_cost_of_words_equals_a_plain_walk():
    counts = {x: Counter(g for w in ws for g in language_id.grams(w, 4)) for x, ws in {"a": ["haus", "maus", "baum"], "b": ["maison", "souris", "été"]}.items()}
    model = language_id.fitted(counts, 4)
    new = ["haus", "xyz", "été", "m", "souris" * 9]
    got = model.cost(new)
    for w, row in zip(new, got):
        for lang in range(2):
            total, marked = 0.0, f"{language_id._START}{w}{language_id._END}"
            for i in range(1, len(marked)):
                p = 1 / model.letters
                for k in range(1, min(4, i + 1) + 1):
                    gram = marked[i - k + 1 : i + 1]
                    terms, rest = model.tables[lang][k - 1]
                    p = terms.get(language_id.hashes([gram]), 0.0)[0] + rest.get(language_id.hashes([gram[:-1]]), 1.0)[0] * p
                total -= math.log(p)
            assert row[lang] == pytest.approx(total)


@pytest.mark.parametrize("memo", [5, language_id.MEMO])
def test_costs_don_t_depend_on_what_is_remembered(monkeypatch, memo):
    monkeypatch.setattr(language_id, "MEMO", memo)
    model = language_id.fitted({x: Counter(g for w in ws for g in language_id.grams(w)) for x, ws in {"a": ["the", "cat"], "b": ["le", "chat"]}.items()})
    texts = [language_id.words(t) for t in ("the cat sat", "", "le chat " * 30, "q" * 300, "the cat sat on le mat with a cap and hat")]
    for _ in range(2):
        cost, symbols = model.costs(texts)
    assert symbols.tolist() == [12, 0, 240, 301, sum(n * (len(w) + 1) for w, n in texts[4].items())]
    for i, t in enumerate(texts):
        assert cost[i] == pytest.approx(sum((n * model.cost([w])[0] for w, n in t.items()), np.zeros(2)))


def test_query_12_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = language_id.op12_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    own = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    for lang in ("en", "fr", "de", "es"):
        of = [r for r in own if r["lang"] == lang]
        assert sum(r["lang_pred"] == lang for r in of) >= 0.98 * len(of)
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["accepted"] for r in own) > 0.9 * len(own)


def test_language_cases(spark):
    rng = random.Random(2)
    made = {"en": "the of and with house river walk", "fr": "le des avec maison été où garçon", "de": "der und mit haus über straße"}
    texts, langs = [], []
    for _ in range(60):
        for x, ws in made.items():
            texts.append(" ".join(rng.choices(ws.split(), k=rng.randint(5, 40))))
            langs.append(x)
    docs = docs_of(spark, texts, langs=langs)
    model = language_id.train(docs)
    assert model.langs == ["de", "en", "fr"]
    odd = [None, "", "12 ² ³ --", "THE HOUSE", "x", "жук и кот идут " * 20, "été " * 50_000]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(odd)], "id int, body string, score string")
    plain = [tuple(r) for r in language_id.identify(df, model, "id", "body", reject=False).orderBy("id").collect()]
    assert [r[1] for r in plain[:4]] == ["und", "und", "und", "en"] and plain[6][1] == "fr"
    assert [r[2] for r in plain[:3]] == [0.0] * 3 and all(r[1] != "und" for r in plain[3:])
    strict = [tuple(r) for r in language_id.identify(df, model, "id", "body").orderBy("id").collect()]
    assert strict[5][1] == "und" and strict[3][1] == "en"  # letters of no language are rejected
    assert language_id.identify(df.limit(0), model, "id", "body").count() == 0
    # no language to learn
    none = language_id.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.train(docs.limit(0)).langs == []
    one = language_id.train(docs.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in language_id.identify(docs, one, reject=False).collect()} == {"en"}


def test_training_takes_no_held_out_row_and_equally_many(spark):
    ids = list(range(3000))
    texts = [f"text {chr(97 + i % 26)} {i}" for i in ids]
    docs = docs_of(spark, texts, ids, ["en" if i % 10 else "fr" for i in ids])
    rows, langs = language_id.training_texts(docs, "doc_id", "text", "lang", 200)
    got = rows.collect()
    assert langs == ["en", "fr"] and Counter(r["_lang"] for r in got) == {"en": 100, "fr": 100}
    assert all(zlib.crc32(r["_text"].split()[-1].encode()) % 5 for r in got)
    changed = docs.withColumn("lang", F.when(language_id.held_out("doc_id"), "xx").otherwise(F.col("lang")))
    assert sorted(language_id.training_texts(changed, "doc_id", "text", "lang", 200)[0].collect()) == sorted(got)


# ---- 13


def features(text, longest=1):
    words = FEATURES.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def resampled_by_hand(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t_ = Counter(bucket(f) for t in target for f in features(t, longest)[1])
    total, aim = sum(s.values()), sum(t_.values())
    gain = lambda b: math.floor(1000 * math.log((t_[b] + 1) * (total + buckets) / ((s[b] + 1) * (aim + buckets))))
    rows = []
    for i, text in docs:
        n, own = features(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    ranks = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


def sampling_texts(seed, count):
    rng = random.Random(seed)
    pool = ["law", "Court", "THE", "été", "日本", "x1", "a-b", "don't", "É", "River", "ſ", "K"]
    out = [None, "", "--", "word " * 19, "word " * 20, "law court " * 400]
    return out + [" ".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(count)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_against_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(resampling, "PIECE", 7)
    docs = list(enumerate(sampling_texts(3, 300))) + [(5, "the same " * 30)] * 3 + [(None, "a null id " * 9)]
    target = ["the court of law", None, "LAW law river"]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, score int, rank int")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, aim, longest=longest, percent=30, per_range=10)
    assert sorted(map(tuple, got.collect()), key=str) == resampled_by_hand(docs, target, longest, percent=30)


def test_ties_of_score_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(resampling, "gumbel", lambda *_: F.lit(0).cast("long"))
    ids = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(i, "same words " * 10 if i % 3 else "other words " * 10) for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["rank"] for r in resampling.resample(df, spark.createDataFrame([("same " * 500,)], "text string"), percent=50).collect()}
    want = sorted(ids, key=lambda i: (i % 3 == 0, i))[:250]
    assert {i: r for i, r in got.items() if r} == {i: k for k, i in enumerate(want, 1)}


def test_counts_above_over_many_ranges(spark):
    scores = [random.Random(4).randint(-50, 50) for _ in range(2000)]
    got = {r["score"]: (r["n"], r["above"]) for r in resampling.counts_above(spark.createDataFrame([(s,) for s in scores], "score long"), 3).collect()}
    assert got == {s: (scores.count(s), sum(x > s for x in scores)) for s in set(scores)}


def test_query_13_on_few_or_no_rows(spark, tmp_path):
    docs = docs_of(spark, ["too short", None, "word " * 30], [1, 2, 3])
    sf = written(docs, tmp_path)
    spark.createDataFrame([(1, "word")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = resampling.op13_importance_resampling(spark, sf).collect()
    assert sorted(map(tuple, rows), key=str) == resampled_by_hand([(1, "too short"), (2, None), (3, "word " * 30)], ["word"])
    none = resampling.resample(docs.limit(0), spark.createDataFrame([], "text string"))
    assert none.columns == ["doc_id", "n_features", "weight", "score", "rank"] and none.count() == 0


# ---- names that operators use inside, as columns of the documents


def test_pipeline_stages_bear_their_inner_names(spark):
    from sparkseam.llm import jaccard_join, line_quality, pii

    inner = ["_node", "_stay", "_stay_node", "_again", "_id", "_key", "_best", "_comp", "_rows", "_row", "_host", "spans"]
    words = [" ".join(f"w{k}x{i}" for i in range(70)) for k in range(3)]
    texts = [words[0], words[0] + " more", words[1], words[1], words[2] + " mail a.b@example.org now"]
    rows = [(i, t, "s", *["x"] * len(inner)) for i, t in zip([1, 2, 3, 3, 5], texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in inner))
    once = jaccard_join.keep_one(docs)
    assert once.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in once.collect()) == [(1, texts[0]), (3, texts[2]), (5, texts[4])]
    assert all(r["_node"] == "x" for r in once.collect())
    # no n_chars here
    masked = pii.masked(docs)
    assert masked.columns == docs.columns and {r["doc_id"]: r["text"] for r in masked.collect()}[5].endswith(" mail [EMAIL] now")
    assert line_quality.keep_good(docs).columns == docs.columns and line_quality.keep_good(docs).count() == 5


def test_many_languages_are_looked_up_in_groups(monkeypatch):
    counts = {f"l{i}": Counter(g for w in [f"{chr(97 + i)}ab", "same", "é" * (i + 1)] for g in language_id.grams(w)) for i in range(5)}
    new = ["same", "bab", "éé", "zzz"]
    want = language_id.fitted(counts).cost(new)
    monkeypatch.setattr(language_id, "TOGETHER", 2)
    assert language_id.fitted(counts).cost(new) == pytest.approx(want) and want.shape == (4, 5)
