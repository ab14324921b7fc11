"""Operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from careframe.llm import bpe, classifier, language_model, lines, mixing, near_duplicates, secrets, substrings, vectors
from careframe.llm.queries import tokenizer_path
from careframe.session import work_folder

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [(1, LONG), (2, "x " + LONG + " y"), (3, None), (4, ""), (5, "a b a b " * 40), (None, LONG), (6, LONG), (6, LONG),
         (7, " ".join(f"v{i}" for i in range(50)))]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "s", "extra") for i, t in TEXTS], "doc_id long, text string, source string, size string")


def test_substrings_equal_brute_force(docs):
    found = [WORD.findall(t or "") for _, t in TEXTS]
    windows = [tuple(w[i:i + 35]) for w in found for i in range(len(w) - 34)]
    want = []
    for (id_, _), w in zip(TEXTS, found):
        gone = {i + k for i in range(len(w) - 34) if windows.count(tuple(w[i:i + 35])) > 1 for k in range(35)}
        want.append((id_, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in substrings.remove(docs).collect())


def test_near_duplicates(docs):
    classes = {}
    for r in near_duplicates.classes(docs).collect():
        classes.setdefault(r["id"], set()).add(r["class_id"])
    assert classes[1] == classes[2] == classes[6] == classes[None] == {1}
    assert classes[3] == classes[4] == {3} and classes[7] == {7}
    assert near_duplicates.keep_one(docs).columns == docs.columns
    assert near_duplicates.keep_one(docs).count() == 4


def brute_force_classes(texts):
    """Smallest position of every text's class: components of all pairs with a Jaccard similarity of 0.8 or more."""
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[i] & sets[j])
        if root[i] != root[j] and 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return root


def family(pairs, seed=1):
    """Texts of one template, two and two with more in common: similar about 0.82 to each other, 0.74 to the rest."""
    rng = random.Random(seed)
    texts = []
    for p in range(pairs):
        spots = rng.sample(range(80), 10)
        for twin in range(2):
            words = [f"t{i}" for i in range(400)]
            for spot in spots[:2]:
                words[5 * spot] = f"p{p}-{spot}"
            for spot in spots[2 + 4 * twin:6 + 4 * twin]:
                words[5 * spot] = f"x{p}-{twin}-{spot}"
            texts.append(" ".join(words))
    return texts


def test_near_duplicates_of_a_large_family_equal_brute_force(spark):
    texts = family(150)
    found = near_duplicates.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = brute_force_classes(texts)
    assert len(set(want)) > 100
    assert {r["id"]: r["class_id"] for r in found} == dict(enumerate(want))


def test_near_duplicates_of_long_texts_and_of_none(spark):
    long = " ".join(f"w{i * i % 99991}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 1_000_000), (4, "x" * 1_000_000 + "y"), (None, long), (5, None), (6, ""), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r["id"], r["class_id"]) for r in near_duplicates.classes(docs).collect())
    assert found == Counter([(1, 1), (2, 1), (3, 3), (4, 4), (None, 1), (5, 5), (6, 5), (6, 5)])
    assert not near_duplicates.classes(docs.limit(0)).collect()


def test_marks_keep_every_wanted_text_and_few_others(spark):
    texts = spark.range(20_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), "id")
    kept = [r["id"] for r in near_duplicates.marked(texts, texts.filter("id < 300").select("key")).collect()]
    assert set(range(300)) <= set(kept) and len(kept) < 320


def brute_force_votes(texts, labels):
    """Score of every text: the vote of the labelled ones nearest to it in the space they span."""
    def counts(text):
        data, row = text.encode(), np.zeros(classifier.FEATURES)
        for x, y in zip(data, data[1:]):
            row[((x * 256 + y) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 53] += 1
        return np.log1p(row)

    known = [i for i in sorted(labels) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(known) <= classifier.LATENT
    sample = np.array([counts(texts[i]) for i in known])
    rarity = np.log((len(known) + 1) / ((sample > 0).sum(0) + 1)) + 0.1
    weighted = [x / np.linalg.norm(x) for x in sample * rarity]
    _, values, axes = np.linalg.svd(weighted, full_matrices=False)
    axes = axes[values > 1e-9]

    def point(x):
        return axes @ x / np.linalg.norm(axes @ x)

    scores = {}
    for i, text in texts.items():
        x = point(counts(text) * rarity)
        near = sorted(((max(0, x @ point(y)), labels[k]) for y, k in zip(weighted, known)), reverse=True)[:classifier.NEIGHBOURS]
        scores[i] = sum(c ** classifier.POWER * label for c, label in near) / sum(c ** classifier.POWER for c, _ in near)
    return scores


@pytest.fixture(scope="module")
def corpus(spark):
    """A folder of a template family and noise, some of it labelled; its texts and labels."""
    rng = random.Random(3)
    texts = dict(enumerate(family(150)))
    for i in range(300, 340):
        texts[i] = " ".join("".join(rng.choice("#$%&*@!") for _ in range(6)) for _ in range(30))
    labels = {i: int(i < 300) for i in (*range(20), *range(300, 320))}
    root = work_folder(spark, "corpus")
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts.items()],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality long, toxic long").write.parquet(f"{root}/labels.parquet")
    return root, texts, labels


def test_classifier_equals_brute_force(spark, corpus):
    root, texts, labels = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    rows = classifier.score(docs, classifier.fit(docs, spark.read.parquet(f"{root}/labels.parquet"))).collect()
    want = brute_force_votes(texts, labels)
    assert len(rows) == len(want) and min(want.values()) < 0.3 < 0.9 < max(want.values())
    assert all(abs(r["score"] - want[r["doc_id"]]) < 1e-3 for r in rows)


def test_pipeline_equals_brute_force(spark, corpus):
    from tokenizers import Tokenizer

    root, texts, labels = corpus
    good = sorted(i for i, x in brute_force_votes(texts, labels).items() if x >= classifier.THRESHOLD)
    first = {good[k] for k in brute_force_classes([texts[i] for i in good])}  # the family has one line a text: none repeats three
    kept = spark.createDataFrame([(i, texts[i], "en", "web", len(texts[i])) for i in first],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    copies = Counter(r["doc_id"] for r in mixing.mix(kept).collect())
    assert len(good) == 300 and 100 < len(first) < 300
    rows = corpus_pipeline.run(spark, root).collect()
    assert Counter(r["doc_id"] for r in rows) == copies
    known = Tokenizer.from_file(tokenizer_path())
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["ids"] == known.encode(text, add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_round_trip(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    known = Tokenizer.from_file(path)
    rows = bpe.decode(bpe.encode(docs, path).withColumn("doc_id", F.col("doc_id")), path).collect()
    assert sorted(r["text"] for r in rows) == sorted(t or "" for _, t in TEXTS)
    assert all(r["ids"] == known.encode(r["text"], add_special_tokens=False).ids for r in rows)


def test_mix_takes_the_budget(docs):
    plan = mixing.schedule(mixing.entries(docs)).collect()
    size = sum(r["size"] * r["times"] for r in plan)
    taken = sum(r["size"] * r["times"] * r["copies"] for r in plan)
    assert abs(size - taken) <= max(r["size"] * r["times"] for r in plan) and all(0 <= r["copies"] <= 3 for r in plan)
    assert mixing.mix(docs).columns == docs.columns


def test_ledger_scans_a_pair_once(spark):
    docs = spark.createDataFrame([(1, "token = abcdef12"), (2, None), (3, "token = abcdef12")], "doc_id long, text string")
    ledger = work_folder(spark, "ledger")
    first = secrets.per_path(docs, secrets.scan(docs, ledger)).collect()
    rows = spark.read.parquet(ledger).count()
    assert rows == 2 * len(secrets.RULES)
    assert {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in first} == {1: [(0, 16)], 2: [], 3: [(0, 16)]}
    secrets.scan(docs, ledger)
    assert spark.read.parquet(ledger).count() == rows


def test_lines_keep_the_first(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, None), (4, "a\nb")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedupe(docs).collect()} == {1: "a\nb\nc\nd", 2: "x\ny", 3: None, 4: "a\nb"}


def test_vectors_ties_and_bad_rows(spark):
    table = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0])],
        "vec_id long, embedding array<float>")
    rows = vectors.search(table, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], round(r["score"], 6)) for r in rows] == [(1, 1, 0.0), (2, 2, 1.414214)]


def test_language_model_totals(docs):
    rows = language_model.score(docs, F.lit(True)).collect()
    assert {r["train_tokens"] for r in rows} == {sum(len(WORD.findall(t or "")) + 1 for _, t in TEXTS)}
    assert all(r["n_known"] == r["n_tokens"] for r in rows)


def test_language_model_equals_brute_force(docs):
    from collections import Counter
    from math import log10

    learn = [t is None or "b" not in t for _, t in TEXTS]
    found = [[w.lower() for w in WORD.findall(t or "")] + ["</s>"] for _, t in TEXTS]
    pairs = [list(zip(["<s>"] + w, w)) for w in found]
    words = Counter(x for w, yes in zip(found, learn) if yes for x in w)
    both = Counter(x for p, yes in zip(pairs, learn) if yes for x in p)
    total, size = sum(words.values()), len(words)
    words["<s>"] = words["</s>"]

    def one(context, word):
        shorter = (words[word] + 0.5) / (total + 0.5 * (size + 1))
        return (both[context, word] + language_model.PRIOR * shorter) / (words[context] + language_model.PRIOR)

    want = sorted((len(w), round(sum(log10(one(*x)) for x in p), 9)) for w, p in zip(found, pairs))
    rows = language_model.score(docs, F.col("text").isNull() | ~F.col("text").contains("b")).collect()
    assert sorted((r["n_tokens"], round(r["score"], 9)) for r in rows) == want
