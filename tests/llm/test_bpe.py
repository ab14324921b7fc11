"""The byte-level transducer against the tokenizers library, over blocks far smaller than a text."""

import random

import pyarrow as pa
import pytest

from careframe.llm import bpe
from careframe.llm.queries import tokenizer_path

ODD = [
    "a" * 5000 + " b", "'r" * 900, "we're we'll " * 80, "  \n\t " * 300 + "x", "x" * 400 + "\n\n  y", "<|endoftext|>hi<|endoftext|>",
    "é" * 700, "", None, "　  'll 've" * 50, "= " * 500, "'", " ", "a<|endoftext|", "\U0001f600́ " * 40,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer_path(), encoding="utf-8") as file:
        return bpe.Encoder(bpe.MergeTable(file.read()))


@pytest.mark.parametrize("slab", [3, 7, 64, bpe.SLAB])
def test_ids_equal_the_library_whatever_the_block(monkeypatch, encoder, library, slab):
    monkeypatch.setattr(bpe, "SLAB", slab)
    counts, ids = encoder.encode(ODD)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("seed", range(5))
def test_random_texts_equal_the_library(monkeypatch, encoder, library, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("aaabe  \n't'rell1é　=") for _ in range(rng.randrange(400))) for _ in range(60)]
    monkeypatch.setattr(bpe, "SLAB", 50)
    counts, ids = encoder.encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_merging_together_equals_merging_alone(encoder):
    rng = random.Random(9)
    pieces = [bytes(rng.choice(b"abnthe ") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    offsets, numbers = encoder.table.merge_all(pieces)
    assert [numbers[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [encoder.table.merge(p) for p in pieces]


@pytest.mark.parametrize("seed", range(4))
def test_pieces_by_runs_equal_the_pattern(monkeypatch, encoder, seed):
    rng = random.Random(seed)
    texts = [t for t in ODD if t] + ["".join(rng.choice("'' srtvelmdx1Ⅷ\u00b2é　\u00a0\n\t\x1f!\U0001f600") for _ in range(rng.randrange(300)))
                                     for _ in range(400)] + ["".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))]
    monkeypatch.setattr(bpe, "SHORT", 1)
    for text in texts:
        assert encoder.find(text) == encoder.pattern.findall(text)


def test_the_store_is_bounded_and_merges_known_pieces_once(monkeypatch, encoder, library):
    encoder._forget()
    merged, whole = [], encoder.table.merge_all
    monkeypatch.setattr(encoder.table, "merge_all", lambda pieces: merged.append(len(pieces)) or whole(pieces))
    monkeypatch.setattr(bpe, "SLAB", 13)  # a block per text
    encoder.encode(["one two three", "one two three", "two"])
    assert merged == [3, 1]  # the last text's piece has no blank before it
    monkeypatch.setattr(bpe, "KEPT_PIECES", 2)
    texts = ["a b c d", "a b", "x" * 9000, "<|endoftext|>", "a b c d"]
    counts, ids = encoder.encode(texts)
    assert len(encoder.known) <= 2 and encoder.known_chars < 100
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_lists_of_ids_decode_as_the_library_does(encoder, library):
    snow = library.encode("\u2603", add_special_tokens=False).ids
    lists = [snow, snow[:1], [], None, [*snow[1:], 10**9, -1, None, *snow], list(range(400)), [50256, 1]]
    want = [library.decode([i for i in x or () if i is not None and 0 <= i < 10**8], skip_special_tokens=False) for x in lists]
    assert bpe.decode_lists(encoder.table, pa.array(lists, pa.list_(pa.int32())).slice(0)) == want
    assert bpe.decode_lists(encoder.table, pa.array([[5], *lists], pa.list_(pa.int32())).slice(1)) == want


def test_a_long_run_is_merged_a_window_at_a_time(monkeypatch, encoder):
    sizes, whole = [], encoder.table.merge
    data = b"banana" * 20_000
    monkeypatch.setattr(encoder.table, "merge", lambda part: sizes.append(len(part)) or whole(part))
    found = [t for block in encoder.table.stream(data) for t in block]
    assert max(sizes) <= encoder.table.window and found == whole(data)


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "token text", "kept"), (2, None, "kept"), (1, "token text", "kept")], "doc_id long, text string, ids string")
    coded = bpe.encode(docs, tokenizer_path())
    assert coded.columns == ["doc_id", "ids"]
    rows = sorted(tuple(r) for r in bpe.decode(coded, tokenizer_path()).select("doc_id", "text").collect())
    assert rows == [(1, "token text"), (1, "token text"), (2, "")]
    assert bpe.decode(bpe.encode(docs.limit(0), tokenizer_path()), tokenizer_path()).count() == 0
