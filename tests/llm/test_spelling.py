"""Near words, forms and roots against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from careframe.llm import spelling
from careframe.llm.automata import Acceptor, OneEdit


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(u) + 1 == len(v) and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


@pytest.mark.parametrize("seed", range(20))
def test_composition_accepts_pairs_one_edit_apart(seed):
    rng = random.Random(seed)
    m, letters = rng.choice([1, 2, 4, 5]), rng.choice(["ab", "abc", "abcdeé\U0001F600"])
    rows = sorted({(rng.randrange(3), "".join(rng.choice(letters) for _ in range(m + rng.randrange(2)))) for _ in range(60)})
    words = [w for _, w in rows]
    left, right = OneEdit(Acceptor(np.array([g for g, _ in rows]), words, np.array([len(w) - m + 1 for w in words]))).pairs()
    assert sorted((rows[a], rows[b]) for a, b in zip(left, right)) == sorted(
        (a, b) for a in rows for b in rows if a[0] == b[0] and len(a[1]) == m and near(a[1], b[1]) and (len(b[1]) > m or a[1] < b[1]))


def test_equal_endings_share_states():
    acceptor = Acceptor(np.zeros(4, int), ["bathed", "bathing", "washed", "washing"], np.ones(4, int))
    assert len(acceptor.final) == 11  # start, b, ba, w, wa; then shared: what follows t and s, h, e, i, in, and the end


def words(rng, n, letters="abc", longest=9):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(5, longest))) for _ in range(n)})


@pytest.mark.parametrize("limit", [3, 40, 10_000])
def test_links_do_not_depend_on_how_states_are_split(spark, limit):
    rng = random.Random(7)
    some = words(rng, 150) + ["a" * n for n in range(9, 14)] + ["b" * 40, "b" * 41, "b" * 39 + "c"]
    got = spelling.links(spark.createDataFrame([(w, 1) for w in some], "word string, n long"), limit=limit).collect()
    assert sorted(tuple(sorted(r)) for r in got) == sorted((a, b) for a in some for b in some if a < b and near(a, b))


def expected(docs, every):
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                seen[run] += 1
    seen = {w: n for w, n in seen.items() if n >= 3}
    form, count = {}, {}
    for w, n in seen.items():
        others = [v for v in seen if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-seen[v], v), default=None)
        form[w] = best if best and seen[best] >= 2 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, count[w], seen[form[w]] if form[w] else 0) for w, n in seen.items())


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    pool = words(rng, 60, "abé", 8) + ["Ärger", "ärger", "STRASSE", "strase"]
    docs = [(i, " ".join(rng.choice(pool[:1 + rng.randrange(len(pool))]) for _ in range(rng.randrange(80)))) for i in range(60)]
    docs += [(3, docs[3][1])] * 3 + [(None, " ".join(pool)), (None, None), (70, ""), (71, "x" * 300_000 + "1" + "y" * 5), (71, "x" * 300_000), (72, "x" * 300_000)]
    table = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, n int, word string")
    got = sorted(tuple(v or ("" if isinstance(v, str) or v is None and k < 2 else 0) for k, v in enumerate(r))
                 for r in spelling.variants(table, alter_every=7).collect())
    assert got == expected(docs, 7)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chains_of_forms_end_in_one_root(spark):
    """Each word is twice as frequent as the one before: eleven jumps."""
    chain = [("a" * 5 + "b" * i, 2 ** i) for i in range(12)]
    found = spelling.forms(spark.createDataFrame(chain, "word string, n long"))
    assert {(r["word"], r["root"]) for r in spelling.with_roots(found).collect()} == {(w, chain[-1][0]) for w, _ in chain}
