"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from careframe.llm import resampling
from careframe.llm.interning import Table, WordRuns, xxhash64

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, order):
    found = WORD.findall(re.sub("[A-Z]+", lambda x: x[0].lower(), text or ""))
    return len(found), [" ".join(found[i:i + n]) for n in range(1, order + 1) for i in range(len(found) - n + 1)]


def expected(docs, target, order, buckets, percent, least):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    s, t = (Counter(bucket(f) for text in texts for f in features(text, order)[1]) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        n, found = features(text, order)
        total = sum(math.floor(1000 * math.log((t[bucket(f)] + 1) * (s_all + buckets) / ((s[bucket(f)] + 1) * (t_all + buckets)))) for f in found)
        weight = total // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[2], r[3]))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[:percent * len(fit) // 100])}
    return sorted(((*r, ranks.get(id(r))) for r in rows), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    pool = [rng.choice(["Ab", "é", "x", "日本", "Z9", "_"]) * rng.randrange(1, 30) for _ in range(40)]
    return ["".join(rng.choice(pool) + rng.choice([" ", "\n", ", ", "A"]) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("order,buckets", [(1, 10_000), (1, 7), (3, 500)])
def test_scores_and_ranks_equal_brute_force(spark, order, buckets):
    some = texts(1, 60)
    docs = list(enumerate(some)) + [(5, some[5])] * 9 + [(None, some[7]), (None, some[8]), (None, None), (80, ""), (81, "long word " * 200_000), (81, "q" * 100_000)]
    target = texts(2, 9) + [None, ""]
    found = resampling.score_and_draw(
        spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, rank int, score string"),
        spark.createDataFrame([(t, 0) for t in target], "text string, doc_id int"), order=order, buckets=buckets, percent=30, least_words=5)
    got = sorted(((r["id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect()), key=str)
    assert got == expected(docs, target, order, buckets, 30, 5)


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(texts(3, 50))], "doc_id string, text string, rank int")
    drawn = resampling.resample(docs, docs.limit(3), least_words=1)
    assert drawn.columns == docs.columns and 0 < drawn.count() <= 5


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.score_and_draw(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.score_and_draw(some, none, least_words=1, percent=100).first()["rank"] == 1


@pytest.mark.parametrize("bits", [64, 3])
def test_interning_is_exact_even_if_keys_collide(bits):
    rng = random.Random(bits)
    some = [bytes(rng.choice(b"abz09") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 16, 31, 32, 33, 70]))) for _ in range(2000)] * 2
    raw = np.frombuffer(b" ".join(some), np.uint8)
    words = WordRuns(raw, np.array([0, len(raw)]))
    whole = words.data.tobytes()
    keys = xxhash64(words.data, words.starts, words.ends)
    assert [xxhash.xxh64_intdigest(whole[a:b]) for a, b in zip(words.starts, words.ends)] == keys.tolist()
    table = Table(words.data, words.starts, words.ends, keys & np.uint64(2 ** bits - 1))
    assert {whole[words.starts[o]:words.ends[o]]: n for o, n in zip(table.owner, table.counts)} == Counter(some)
