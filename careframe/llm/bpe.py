"""Byte-level BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

Whether a merge happens at a place depends on the bytes to its right only as far as a chain of earlier
merges can reach.  ``MergeTable.lookahead`` follows those chains through the whole merge list once and
gives the most bytes any token needs to see behind its end before it is certain.  No merge crosses the end of a piece of the
splitting pattern, so there a token is certain at once: texts go in as one stream of pieces, a block of bounded size is merged
together in arrays (equal pieces once, and pieces that a bounded store still holds from earlier blocks not again), and is emitted
whole.  The pieces are found by runs of character kinds, a slab of text at a time.  A piece longer than the window is encoded through it: tokens are
emitted as soon as ``lookahead`` bytes stand behind them, and the window moves on, so what is merged at a time is bounded by the
window and not by the piece.
Decoding feeds token bytes through an incremental UTF-8 state machine, a block at a time.

The tokenizer file (JSON of byte-level BPE) is read on the driver, its size checked, and broadcast.

Edge cases: a null text is the empty text and encodes to no ids; null ids decode to the empty text;
ids outside the vocabulary decode to nothing; strings of special tokens become their ids; repeated rows are
encoded alike; empty tables stay empty; other columns are carried along, those named like an output are replaced.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T

from careframe.llm.common import text_batches
from careframe.llm.words import stretches

# Fixed value: the splitting pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_FILE_BYTES = 64 << 20
SLAB = 1 << 20
CHUNK_BYTES = 2 << 20
DECODE_BLOCK = 1 << 14
# Texts shorter than this go through the pattern itself, which costs them less than arrays do.
SHORT = 256
# Bounds of the store of merged pieces: how many, and their characters.
KEPT_PIECES, KEPT_CHARS = 1 << 15, 1 << 20
# Character kinds; each run of one kind is a piece but for blanks and contractions.
OTHER, LETTER, NUMBER, SPACE = range(4)
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of every byte: itself if printable in Latin-1, else the next free character from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


def character_kinds() -> np.ndarray:
    """The kind of every code point, as the pattern's engine sees it."""
    every, kinds = "".join(map(chr, range(0x110000))), np.zeros(0x110000, np.uint8)
    for kind, found in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for match in regex.finditer(found, every):
            kinds[match.start():match.end()] = kind
    return kinds


class MergeTable:
    """Vocabulary and merges; a token's number here is 0-255 for a byte, then 256 + rank of the merge that makes it."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_alphabet()
        vocab = model["vocab"]
        number = {c: b for c, b in letters.items()}
        self.length = [1] * 256
        self.join: dict[int, int] = {}
        parts = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if left not in number or right not in number or left + right in number:
                raise ValueError(f"merge {rank} uses a token before it is made, or makes one twice")
            x, y = number[left], number[right]
            number[left + right] = 256 + rank
            self.join[x << 32 | y] = 256 + rank
            self.length.append(self.length[x] + self.length[y])
            parts.append((x, y))
        self.parts = parts
        self.ids = [0] * len(self.length)
        for token, n in number.items():
            self.ids[n] = vocab[token]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.special = {}
        for added in spec.get("added_tokens") or ():
            if added["lstrip"] or added["rstrip"] or added["single_word"]:
                raise ValueError("added tokens that take in their surroundings are not supported")
            self.special[added["content"]] = added["id"]
            self.bytes_of[added["id"]] = added["content"].encode()
        self.lookahead = self._lookahead()
        self.window = 2 * self.lookahead + 4 * max(self.length)
        pairs = sorted(self.join.items()) or [(-1, NEVER)]
        self.keys, self.made = (np.array(x, np.int64) for x in zip(*pairs))
        every = np.arange(1 << 16)
        self.byte_pairs = self._made_of(every >> 8, every & 255)
        self.numbered_ids = np.array(self.ids, np.int32)
        # Bytes of token id i; the last entry, empty, stands for all ids that are none.
        self.id_lengths = np.zeros(max(self.bytes_of, default=-1) + 2, np.int64)
        for i, data in self.bytes_of.items():
            self.id_lengths[i] = len(data)
        self.id_starts = np.cumsum(self.id_lengths) - self.id_lengths
        self.id_bytes = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), np.uint8)

    def _lookahead(self) -> int:
        """Most bytes behind a token's end that decide whether it is final."""
        reach = [0] * 256  # per token: bytes behind it that decide whether it is made
        widest = [0] * len(self.length)  # per token: bytes behind it that decide whether it merges to the right
        for x, y in self.parts:
            need = max(reach[y], reach[x] - self.length[y], widest[y])
            reach.append(need)
            widest[x] = max(widest[x], self.length[y] + need)
        return max(map(max, zip(reach, widest)))

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, token numbers): piece ``k`` becomes ``numbers[offsets[k]:offsets[k + 1]]``.

        All pieces lie behind each other in one array.  A round merges in every piece all places of its lowest-ranked pair: a merge only
        makes pairs of higher rank, so these places come before anything else in that piece.  Pieces without a pair left are emitted.
        """
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        owner, done = np.arange(len(pieces)), []
        ranks = np.full(len(tokens), NEVER, np.int64)
        ranks[:-1] = self.byte_pairs[tokens[:-1] << 8 | tokens[1:]]
        ranks[np.cumsum(length) - 1] = NEVER
        while len(owner):
            best = np.minimum.reduceat(ranks, np.cumsum(length) - length)
            over = best == NEVER
            if over.any():
                out = np.repeat(over, length)
                done.append((owner[over], length[over], tokens[out]))
                tokens, ranks = tokens[~out], ranks[~out]
                owner, length, best = owner[~over], length[~over], best[~over]
                if not len(owner):
                    break
            piece = np.repeat(np.arange(len(owner)), length)
            at = np.flatnonzero(ranks == best[piece])
            # Places that overlap (one token several times in a row) are taken from the left, every other one.
            first = np.diff(at, prepend=-2) != 1
            at = at[(at - at[first][np.cumsum(first) - 1]) % 2 == 0]
            tokens[at] = ranks[at]
            length = length - np.bincount(piece[at], minlength=len(owner))
            stay = np.ones(len(tokens), bool)
            stay[at + 1] = False
            tokens, ranks = tokens[stay], ranks[stay]
            made = at - np.arange(len(at))
            ranks[made] = NEVER
            last = np.zeros(len(tokens), bool)
            last[np.cumsum(length) - 1] = True
            changed = np.concatenate([made, made[made > 0] - 1])
            changed = changed[~last[changed]]
            ranks[changed] = self._made_of(tokens[changed], tokens[changed + 1])
        if not done:
            return np.zeros(1, np.int64), np.zeros(0, np.int64)
        owners, lengths, numbers = (np.concatenate(x) for x in zip(*done))
        starts, order = np.cumsum(lengths) - lengths, np.argsort(owners)
        return np.concatenate([[0], np.cumsum(lengths[order])]), numbers[spread(starts[order], lengths[order])]

    def _made_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token each pair merges to, or ``NEVER``."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.made[at], NEVER)

    def merge(self, data: bytes) -> list[int]:
        """Token numbers of one long run, lowest rank first and leftmost among equals."""
        get, tokens, n = self.join.get, list(data), len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(made, i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if (made := get(a << 32 | b)) is not None]
        heapq.heapify(queue)
        while queue:
            made, i = heapq.heappop(queue)
            j = after[i]
            if tokens[i] < 0 or j >= n or get(tokens[i] << 32 | tokens[j]) != made:
                continue
            tokens[i], tokens[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := get(made << 32 | tokens[k])) is not None:
                    heapq.heappush(queue, (new, i))
            if (h := before[i]) >= 0 and (new := get(tokens[h] << 32 | made)) is not None:
                heapq.heappush(queue, (new, h))
        return [t for t in tokens if t >= 0]

    def stream(self, data: bytes, window: int | None = None) -> Iterator[list[int]]:
        """Blocks of token numbers of one piece; at any time only a window of it is being merged."""
        window, at = max(window or 0, self.window), 0
        while len(data) - at > window:
            seen, out = 0, []
            for token in self.merge(data[at:at + window]):
                seen += self.length[token]
                if seen > window - self.lookahead:
                    break
                out.append(token)
                at += self.length[token]
            yield out
        yield self.merge(data[at:])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``start``, ``start + 1``, ... of every run, one run behind the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


class Store(dict):
    """Numbers of pieces in order of first sight; ``new`` holds those not merged yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Encoder:
    """The transducer over whole texts: pieces go in as the pattern finds them, and come out as ids a block of pieces at a time."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.pattern = regex.compile(PATTERN)
        self.kinds = character_kinds()
        self._forget()
        order = sorted(table.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, order)) + ")") if order else None

    def _forget(self) -> None:
        self.known, self.known_chars = Store(), 0
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, text: str) -> list[str]:
        """What ``pattern.findall`` finds, from the runs of character kinds."""
        if len(text) < SHORT:
            return self.pattern.findall(text)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds, n = self.kinds[codes], len(codes)
        edge = np.ones(n, bool)
        np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
        runs = np.flatnonzero(edge)
        # Spaces before something else: the last one is apart, and a blank is the first character of what follows.
        after = runs[1:][kinds[runs[:-1]] == SPACE]
        edge[after - 1] = True
        edge[after[codes[after - 1] == 32]] = False
        quote = runs[codes[runs] == 39]
        quote = quote[edge[quote] & (quote < n - 1)]
        if len(quote):
            one, two = codes[quote + 1], codes[np.minimum(quote + 2, n - 1)]
            two = np.where(quote + 2 < n, two, 0)
            size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
            for ending in ("re", "ve", "ll"):
                size[(one == ord(ending[0])) & (two == ord(ending[1]))] = 3
            quote, size = quote[size > 0], size[size > 0]
            edge[quote + 1] = False
            edge[(quote + size)[quote + size < n]] = True
        cuts = np.flatnonzero(edge).tolist()
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], n])]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text in blocks of bounded size (or of one piece, if that is longer)."""
        for part in self.special.split(text) if self.special else (text,):
            if part in self.table.special:
                yield [part]
                continue
            at, slab = 0, SLAB
            while len(part) - at > slab:
                # The pattern looks at most two characters past a piece's end: pieces that end earlier are the same in the whole part.
                found, end = self.find(part[at:at + slab]), at + slab
                while found and end > at + slab - 2:
                    end -= len(found.pop())
                slab = SLAB if found else 2 * slab
                if found:
                    yield found
                    at = end
            yield self.find(part[at:])

    def block(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per piece, ids) of the pieces in order; pieces that the store does not hold are merged, equal ones once."""
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        if self.known.new:
            self._learn(self.known.new)
        lengths = self.lengths[at]
        found = lengths, self.ids[spread(self.starts[at], lengths)]
        if len(self.known) > KEPT_PIECES or self.known_chars > KEPT_CHARS:
            self._forget()
        return found

    def _learn(self, different: list[str]) -> None:
        """Put the ids of new pieces, in order, behind those of the store."""
        table, coded = self.table, [p.encode() for p in different]
        streamed = {i: None for i, (p, data) in enumerate(zip(different, coded)) if p in table.special or len(data) > table.window}
        offsets, numbers = table.merge_all([data for i, data in enumerate(coded) if i not in streamed] if streamed else coded)
        ids = table.numbered_ids[numbers]
        starts, lengths = offsets[:-1], np.diff(offsets)
        if streamed:
            longer, begin, rest = [], len(ids), np.ones(len(coded), bool)
            all_starts, all_lengths = np.zeros(len(coded), np.int64), np.zeros(len(coded), np.int64)
            for i in streamed:
                rest[i], all_starts[i] = False, begin
                if different[i] in table.special:
                    mine = [np.array([table.special[different[i]]], np.int32)]
                else:
                    mine = [table.numbered_ids[tokens] for tokens in table.stream(coded[i])]
                all_lengths[i] = sum(map(len, mine))
                begin += all_lengths[i]
                longer += mine
            all_starts[rest], all_lengths[rest] = starts, lengths
            starts, lengths, ids = all_starts, all_lengths, np.concatenate([ids, *longer])
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])
        self.known_chars += sum(map(len, different))
        different.clear()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids per text, all ids).  A block holds ``SLAB`` characters, whatever the texts' sizes."""
        counts, ids = np.zeros(len(texts), np.int64), []
        held: list[str] = []
        owners: list[tuple[int, int]] = []  # (text, pieces of it that wait)
        size = 0

        def emit() -> None:
            per_piece, found = self.block(held)
            before = np.concatenate([[0], np.cumsum(per_piece)])
            cuts = np.concatenate([[0], np.cumsum([n for _, n in owners])])
            np.add.at(counts, [t for t, _ in owners], np.diff(before[cuts]))
            ids.append(found)
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for found in self.pieces(text) if text else ():
                if found:
                    held += found
                    owners.append((i, len(found)))
                    size += sum(map(len, found)) if len(text) > SLAB else len(text)
                    if size >= SLAB:
                        emit()
                        size = 0
        if held:
            emit()
        return counts, np.concatenate(ids) if ids else np.zeros(0, np.int32)


def decode_bytes(data: memoryview) -> str:
    """Text of a token sequence's bytes; an unfinished character waits in the decoder's state for the next block."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    text = [machine.decode(data[at:at + DECODE_BLOCK]) for at in range(0, len(data), DECODE_BLOCK)]
    return "".join(text) + machine.decode(b"", True)


def decode_lists(table: MergeTable, lists: pa.Array) -> list[str]:
    """Text of every list of ids; a null list is empty, ids that are none have no bytes."""
    ids = np.asarray(lists.flatten().cast(pa.int64()).fill_null(-1))
    none = len(table.id_lengths) - 1
    ids = np.where((ids < 0) | (ids > none), none, ids)
    lengths = table.id_lengths[ids]
    data = memoryview(table.id_bytes[spread(table.id_starts[ids], lengths)])
    tokens = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))
    ends = np.concatenate([[0], np.cumsum(lengths)])[tokens].tolist()
    return [decode_bytes(data[a:b]) for a, b in zip([0, *ends], ends)]


_LOADED: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    text = shared.value
    if hash(text) not in _LOADED:
        _LOADED[hash(text)] = Encoder(MergeTable(text))
    return _LOADED[hash(text)]


def _shared(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        text = file.read(MAX_FILE_BYTES + 1)
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than a tokenizer may be")
    MergeTable(text)
    return df.sparkSession.sparkContext.broadcast(text)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of the whole text in ``ids_col`` (array<int>), and without the text."""
    keep = [c for c in docs.columns if c not in (text_col, ids_col)]
    source = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias("_text"))
    shared, at = _shared(docs, path), len(keep)

    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            texts = batch.column(at)
            lengths = np.asarray(pc.binary_length(texts).fill_null(0))
            for start, end in stretches(lengths, CHUNK_BYTES):
                counts, values = encoder.encode(texts.slice(start, end - start).to_pylist())
                cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(at)], pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))],
                    names=[*keep, ids_col])

    fields = [docs.schema[c] for c in keep]
    return text_batches(source).mapInArrow(run, T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with the text of its ids in ``text_col``, ids kept."""
    keep = [c for c in df.columns if c != text_col]
    shared, at = _shared(df, path), keep.index(ids_col)

    def run(batches):
        table = _encoder(shared).table
        for batch in batches:
            ids = batch.column(at)
            lengths = np.asarray(ids.value_lengths().fill_null(0))
            for start, end in stretches(lengths, CHUNK_BYTES // 4):
                part = batch.slice(start, end - start)
                texts = decode_lists(table, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*keep, text_col])

    fields = [df.schema[c] for c in keep]
    return text_batches(df.select(*[df[f"`{c}`"] for c in keep])).mapInArrow(run, T.StructType([*fields, T.StructField(text_col, T.StringType())]))
