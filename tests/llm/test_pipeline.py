"""The queries of the classifiers, and the pipeline from end to end against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import source_mix
from tallyspark.llm.language_id import UNKNOWN, Labeller, WordField, fit_language_field, identify, op9_language_id
from tallyspark.llm.sampling import balanced
from tallyspark.llm.surrogates import TEST_KEY
from tallyspark.llm.toxicity import ScaledLinear, fit_toxicity, op10_toxicity, score_toxicity, words

from test_corpus_operators import entropy, plain_mapping, plain_sets, plainly_replaced, roots, weights

SMALL = "/root/testdata/sf0.001"


def crc(i):
    return zlib.crc32(str(i).encode())


def changed(spark, folder, name, change):
    """One of the small tables, changed, in a folder of its own beside the others that a query reads."""
    df = spark.read.parquet(f"{SMALL}/{name}.parquet")
    change(df).write.parquet(f"{folder}/{name}.parquet")


def test_language_query_learns_from_its_fold_alone(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    changed(spark, tmp_path, "documents", lambda df: df.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("x")))
    first, second = ({r.doc_id: r for r in op9_language_id(spark, f).collect()} for f in (SMALL, str(tmp_path)))
    assert first == second and all(r.held_out == (crc(i) % 4 == 2) for i, r in first.items())
    texts = {r.doc_id: r for r in docs.collect()}
    for i, r in first.items():
        assert (r.lang_pred == UNKNOWN) == (not re.search(r"[^\W\d_]", texts[i].text or "")) and 0 <= r.score <= 1
    judged = [(texts[i].lang, r.lang_pred) for i, r in first.items() if r.held_out and texts[i].lang]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged) and len(judged) > 10


def test_toxicity_query_learns_from_its_fold_alone(spark, tmp_path):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed(spark, tmp_path, "labels", lambda df: df.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    changed(spark, tmp_path, "documents", lambda df: df.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")))
    first, second = ({r.doc_id: r for r in op10_toxicity(spark, f).collect()} for f in (SMALL, str(tmp_path)))
    assert first == second and all(r.held_out == (crc(i) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in first.items())
    # The smaller tables have too few toxic rows to judge by.
    larger = SMALL.replace("0.001", "0.1")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    judged = [(toxic[r.doc_id], r.score) for r in op10_toxicity(spark, larger).collect() if r.held_out and toxic.get(r.doc_id) is not None]
    pairs = [a > b for x, a in judged for y, b in judged if x == 1 and y == 0]
    assert sum(pairs) >= 0.95 * len(pairs) > 1_000


def test_every_language_can_be_predicted(spark):
    word = lambda k, j: "".join(chr(97 + (k // 26**p + 7 * j) % 26) for p in range(2)) * 3 + chr(97 + j)
    rows = [(2 * k + j, " ".join(word(k, x) for x in range(j, j + 6)), f"l{k:03d}") for k in range(300) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    field = fit_language_field(df)
    assert len(field.labels) == 300
    got = {r.doc_id: r.lang_pred for r in identify(df, field).collect()}
    assert sum(got[i] == label for i, _, label in rows) > 570
    # With room for fewer rows than labels each label still has one.
    assert balanced(df, "label", 5, 100).select("label").distinct().count() == 300


def test_labels_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    field = WordField.fit([(["der", "und", "das"], "de"), (["the", "and", "that"], "en")] * 8)
    field.moves = rng.normal(size=(2, 2))
    text = "the und that das of nothing"
    (_, found, post), = Labeller(field).posteriors([text])
    emit = np.array([np.exp(field.weights[field.features(w)].sum(0)) for w in found])
    want = np.zeros_like(post)
    for path in np.ndindex(*[2] * len(found)):
        p = np.prod([emit[k, y] for k, y in enumerate(path)]) * np.prod([np.exp(field.moves[a, b]) for a, b in zip(path, path[1:])])
        for k, y in enumerate(path):
            want[k, y] += p
    assert np.allclose(post, want / want.sum(1, keepdims=True))


def plain_grams(text):
    return {f"<{w}>"[k : k + n] for w in words(text) for n in range(3, 7) for k in range(len(w) + 3 - n)}


def test_toxicity_by_hand(spark):
    rng = np.random.default_rng(3)
    pick = lambda ws, n: " ".join(rng.choice(ws.split(), n))
    rows = [(k, pick("tree house river stone cloud", 15) + (" " + pick("vexator vexing vexed", 2) if k % 3 == 0 else " fine"), int(k % 3 == 0)) for k in range(150)]
    grams, ones = [plain_grams(t) for _, t, _ in rows], [y for *_, y in rows]
    model = ScaledLinear.fit([words(t) for _, t, _ in rows], ones, sum(ones) / len(ones))
    n1, n0 = sum(ones), len(ones) - sum(ones)
    kept = set()
    for g in set().union(*grams):
        a, b = (sum(g in x for x, y in zip(grams, ones) if y == which) for which in (1, 0))
        both, total = a + b, n1 + n0
        spread = n1 * n0 * both * (total - both)
        if spread and total * (a * (n0 - b) - b * (n1 - a)) ** 2 / spread >= 30:
            kept.add(g)
    assert {*model.rows} == kept and kept
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, ""), (901, None)], "doc_id long, text string")
    for r in score_toxicity(docs, model).collect():
        z = model.intercept + sum(model.weights[model.rows[g]] for g in plain_grams(dict((i, t) for i, t, _ in rows).get(r.doc_id)) if g in model.rows)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z))) and r.predicted == (r.score >= 0.5)
        assert r.doc_id >= 900 or r.predicted == (r.doc_id % 3 == 0)
    assert fit_toxicity(spark.createDataFrame([], "doc_id long, label int"), docs) is None


def keyed(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def plain_mix(rows, block_tokens):
    """How often each row of (id, text, source) comes, by the rules of the schedule."""
    size = lambda t: len(re.findall("[^\x09-\x0d\x20]+", t or ""))
    named = lambda s: "n" if s is None else f"s{s}"
    totals = Counter()
    for _, t, s in rows:
        totals[named(s)] += size(t)
    totals = {s: n for s, n in totals.items() if n}
    counts, budget = [*totals.values()], sum(totals.values())
    low, high = 0.0, 1.0
    natural = entropy(weights(counts, 1.0)) if counts else 0
    for _ in range(50):
        a = (low + high) / 2
        w = weights(counts, a) if counts else []
        good = bool(w) and entropy(w) <= natural + 0.5 * (math.log(len(w)) - natural) and max(p * budget / n for p, n in zip(w, counts)) <= 4
        low, high = (low, a) if good else (a, high)
    share = dict(zip(totals, weights(counts, high if len(counts) > 1 else 1.0) if counts else []))
    out = Counter()
    for s, n in totals.items():
        quota, blocks = round(share[s] * budget), {}
        for row in (r for r in rows if named(r[2]) == s):
            blocks.setdefault(keyed("block", "" if row[0] is None else row[0]) % -(-n // block_tokens), []).append(row)
        rest = quota % n
        for b in sorted(blocks, key=lambda b: (keyed("order", s, b, quota // n), b)):
            own = sorted(blocks[b], key=lambda r: (keyed("document", "" if r[0] is None else r[0]), r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
            whole, so_far = quota // n + (rest > 0 and rest >= sum(size(t) for _, t, _ in own)), 0
            for row in own:
                out[row] += whole
                so_far += size(row[1])
                out[row] += whole == quota // n and 0 < rest < sum(size(t) for _, t, _ in own) and so_far <= rest
            rest -= sum(size(t) for _, t, _ in own)
    return +out


def test_pipeline_from_end_to_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_mix.mix_sources, "__defaults__", (1.0, 0.5, 4.0, 3_000, *source_mix.mix_sources.__defaults__[4:]))
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").limit(150)
    line = "the of and to in that is write to bob.07@mail1.example.com or Bob.07@Mail1.example.com for the and of"
    extra = [(9000, "12 34 -- 56", "en", "src1", 11), (9001, None, None, None, None), (9002, line, "en", None, 72), (9002, line, "en", None, 72), (9003, line + " now", "en", "one", 5), (9004, "", "en", "one", 0), (None, "the of and without any number at all", None, None, 5)]
    rows = rows.union(spark.createDataFrame(extra, rows.schema)).select("*", F.lit(1).alias("component_id"), F.lit("x").alias("mix_pass"), F.lit("x").alias("lang_pred"), F.lit(2).alias("rest"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    docs = [tuple(r)[:5] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))

    kept = corpus_pipeline.language(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    texts = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    assert Counter((i, t, s) for i, t, s in texts) == Counter((i, t, s) for i, t, _, s, _ in docs if i not in (9000, 9001, 9004))
    sets = plain_sets([(i, t) for i, t, _ in texts])
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if None not in (a, b) and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    group = roots({i for i, *_ in texts if i is not None}, links)
    single = [r for r in texts if r[0] is None or group[r[0]] == r[0]]
    mapping = plain_mapping([t for _, t, _ in single], TEST_KEY)
    private = [(i, plainly_replaced(t, mapping), s) for i, t, s in single]
    assert not [t for i, t, _ in private if "bob.07" in t.lower()]
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    times = Counter(private)
    for row, n in plain_mix(private, 3_000).items():
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        want[row[0], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))] += n
    assert got == want and max(times.values()) == 2


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
