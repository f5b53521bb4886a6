"""Byte-level BPE as a bounded-lookahead streaming transducer, with an incremental decoder.

``sufficient_lookahead`` is computed from the merge list: bytes further right than
that from a token's end cannot change the token. The transducer therefore holds a
window of a few lookaheads, emits the tokens that are stable, and goes on behind
them, in constant memory for inputs of any length. A ``Stream`` takes a text in
pieces, knows after two further code points where a word ends, and passes every
word through the transducer; a word that does not end is handed over as it comes.
What the transducer gave for short words is remembered in a bounded table.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of byte-level BPE, with {L}, {N} and {S} for the classes letter, number and white space.
PATTERN = r" ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Fixed value: Unicode white space.
SPACE = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
MEMO_WORDS = 1 << 19
MEMO_CHARS = 48
#: Code points of a text that are taken up at once.
PIECE = 1 << 16
#: Code points after a word's last one that decide that it ends there: "'re" is found two after its quote.
WORD_LOOKAHEAD = 2
#: A word longer than this is handed to the transducer before its end is known.
OPEN_CHARS = 1 << 12
BLOCK_IDS = 1 << 14


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return [letters[b] for b in range(256)]


def category_ranges(initial: str, end: int) -> str:
    """Body of a character class with all code points below ``end`` whose general category starts with ``initial``."""
    out, first = [], None
    for c in range(end + 1):
        inside = c < end and unicodedata.category(chr(c))[0] == initial
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


def word_pattern(end: int = 0x110000) -> re.Pattern:
    """The split pattern for texts whose code points all lie below ``end``."""
    return re.compile(PATTERN.replace("{L}", category_ranges("L", end)).replace("{N}", category_ranges("N", end)).replace("{S}", SPACE))


class Vocabulary:
    """Merge ranks, token bytes and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [ids[c] for c in letters]
        size = max(max(ids.values()), *(x["id"] for x in spec["added_tokens"])) + 1 if spec["added_tokens"] else max(ids.values()) + 1
        self.token_bytes = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for text, i in self.added.items():
            self.token_bytes[i] = text.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.lookahead = sufficient_lookahead(self.merges, self.token_bytes)


def sufficient_lookahead(merges: dict[tuple[int, int], tuple[int, int]], token_bytes: list[bytes]) -> int:
    """Bytes to the right of a token after which nothing can change it.

    What lies to the right of a merge can prevent it only by merging earlier with
    its last part, or with a last part of that: a merge of lower rank whose left
    symbol ends the token. That merge in turn depends on what follows it. Ranks
    fall along such a chain, so one pass in rank order gives the furthest reach:
    ``reach[y]`` is the most bytes that merges of lower rank starting with symbol
    y look at, and a merge looks as far as the worst symbol that ends its token.
    """
    reach: dict[int, int] = {}
    ends: dict[int, tuple[int, ...]] = {}
    most = 0
    for (left, right), (_, made) in sorted(merges.items(), key=lambda x: x[1][0]):
        spine = (right, *ends.get(right, ()))
        need = max((reach.get(y, 0) for y in spine), default=0)
        ends.setdefault(made, spine)
        reach[left] = max(reach.get(left, 0), len(token_bytes[right]) + need)
    for token in range(len(token_bytes)):
        most = max(most, *(reach.get(y, 0) for y in (token, *ends.get(token, ()))))
    return most


def merge_all(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges, lowest rank first and leftmost first, until none fits."""
    n = len(symbols)
    if n <= 64:
        get = merges.get
        blank = (1 << 60, -1)
        pairs = [get(p, blank) for p in zip(symbols, symbols[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best is blank:
                break
            i, made = pairs.index(best), best[1]
            symbols[i : i + 2] = [made]
            del pairs[i]
            if i:
                pairs[i - 1] = get((symbols[i - 1], made), blank)
            if i < len(pairs):
                pairs[i] = get((made, symbols[i + 1]), blank)
        return symbols
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i, m[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, made, left, right = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue
        symbols[i], alive[j], after[i] = made, False, after[j]
        if after[j] < n:
            before[after[j]] = i
            if m := merges.get((made, symbols[after[j]])):
                heapq.heappush(heap, (m[0], i, m[1], made, symbols[after[j]]))
        if (h := before[i]) >= 0 and (m := merges.get((symbols[h], made))):
            heapq.heappush(heap, (m[0], h, m[1], symbols[h], made))
    return [s for s, a in zip(symbols, alive, strict=True) if a]


class Transducer:
    """Bytes of one word in, stable token ids out; holds a window of bounded size."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, bytearray()
        self.window = 4 * vocabulary.lookahead + 256

    def _tokens(self) -> list[int]:
        return merge_all([self.v.byte_ids[b] for b in self.held], self.v.merges)

    def feed(self, data: bytes) -> Iterator[int]:
        for a in range(0, len(data), self.window):
            self.held += data[a : a + self.window]
            if len(self.held) >= self.window:
                end, limit = 0, len(self.held) - self.v.lookahead
                for token in self._tokens():
                    if end + len(self.v.token_bytes[token]) > limit:
                        break
                    end += len(self.v.token_bytes[token])
                    yield token
                del self.held[:end]

    def finish(self) -> Iterator[int]:
        yield from self._tokens()
        self.held.clear()

    def word(self, data: bytes) -> list[int]:
        return [*self.feed(data), *self.finish()]


class _Memo(dict):
    """Word to the bytes of its int32 ids; full, it forgets the newer half, so common words, which come early, stay."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.transducer = Transducer(vocabulary)

    def __missing__(self, word: str) -> bytes:
        out = np.array(self.transducer.word(word.encode()), np.int32).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                for old in list(islice(reversed(self), MEMO_WORDS // 2)):
                    del self[old]
            self[word] = out
        return out


class Encoder:
    """Whole texts to ids, special tokens of the vocabulary file included."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.memo = _Memo(self.vocabulary)
        # Long lists of astral ranges slow the classes down, and few texts need them.
        self.words, self.astral_words = word_pattern(0x10000), word_pattern()
        self.astral = re.compile("[\U00010000-\U0010ffff]")
        self.added = re.compile("|".join(map(re.escape, self.vocabulary.added))) if self.vocabulary.added else None
        letter, number = (category_ranges(c, 0x110000) for c in "LN")
        #: What goes on a word, by its class; a run of white space leaves its last one to a word that follows.
        self.rest = [re.compile(x) for x in (f"[{letter}]*", f"[{number}]*", f"[{SPACE}]+(?![^{SPACE}])|", f"[^{SPACE}{letter}{number}]*")]

    def blocks(self, text: str) -> Iterator[bytes]:
        """Blocks of int32 ids, in order."""
        stream = Stream(self)
        whole = max(0, len(text) - 1) // PIECE * PIECE
        for a in range(0, whole, PIECE):
            yield from stream.feed(text[a : a + PIECE])
        yield from stream.finish(text[whole:] if whole else text)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.blocks(text or "")), np.int32)

    def length(self, text: str | None) -> int:
        return sum(map(len, self.blocks(text or ""))) // 4


class Stream:
    """A text in pieces of any size in, blocks of int32 ids out; holds part of a word and of a special token."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.transducer = encoder, Transducer(encoder.vocabulary)
        self.special = self.held = ""
        self.open: re.Pattern | None = None

    def feed(self, piece: str) -> Iterator[bytes]:
        return self._segments(self.special + piece, False)

    def finish(self, piece: str = "") -> Iterator[bytes]:
        return self._segments(self.special + piece, True)

    def _segments(self, text: str, last: bool) -> Iterator[bytes]:
        """Between special tokens; the beginning of one at the end of a piece waits for the next piece."""
        added, end = self.encoder.vocabulary.added, 0
        for m in self.encoder.added.finditer(text) if added else ():
            yield from self._words(text[end : m.start()], True)
            yield np.int32(added[m[0]]).tobytes()
            end = m.end()
        wait = 0 if last else max((k for x in added for k in range(1, len(x)) if text.endswith(x[:k], end)), default=0)
        self.special = text[len(text) - wait :]
        yield from self._words(text[end : len(text) - wait], last)

    def _words(self, text: str, last: bool) -> Iterator[bytes]:
        text, start = self.held + text, 0
        sure = len(text) if last else max(0, len(text) - WORD_LOOKAHEAD)
        if self.open is not None:
            stop = self.open.match(text).end()
            if stop > sure:
                yield self._ids(self.transducer.feed(text[:sure].encode()))
                self.held = text[sure:]
                return
            yield self._ids([*self.transducer.feed(text[:stop].encode()), *self.transducer.finish()])
            self.open, start = None, stop
        words = self.encoder.astral_words if self.encoder.astral.search(text) else self.encoder.words
        lookup = self.encoder.memo.__getitem__
        if last:
            self.held = ""
            yield b"".join(map(lookup, words.findall(text, start)))
            return
        ready = []
        for m in words.finditer(text, start):
            if m.end() > sure:
                break
            ready.append(m[0])
            start = m.end()
        yield b"".join(map(lookup, ready))
        self.held = text[start:]
        if len(self.held) > OPEN_CHARS:
            # One word reaches to the end. Its third code point tells its class: a space may lead it.
            kind = self.held[2]
            group = {"L": 0, "N": 1}.get(unicodedata.category(kind)[0], 2 if re.match(f"[{SPACE}]", kind) else 3)
            self.open = self.encoder.rest[group]
            yield self._ids(self.transducer.feed(self.held[:-WORD_LOOKAHEAD].encode()))
            self.held = self.held[-WORD_LOOKAHEAD:]

    @staticmethod
    def _ids(tokens: Iterable[int]) -> bytes:
        return np.fromiter(tokens, np.int32).tobytes()


class Decoder:
    """Ids in, text out as soon as its bytes are complete; undecodable bytes become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = vocabulary.token_bytes
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join([self.table[i] for i in ids if 0 <= i < len(self.table)]))

    def finish(self) -> str:
        out = self.state.decode(b"", final=True)
        self.state.reset()
        return out

    def decode(self, ids: np.ndarray) -> str:
        parts = [self.feed(ids[a : a + BLOCK_IDS].tolist()) for a in range(0, len(ids), BLOCK_IDS)]
        return "".join([*parts, self.finish()])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    return Encoder(path)


def _encode(path: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for whole in batches:
            for batch in (whole.slice(a, 512) for a in range(0, whole.num_rows, 512)):
                ids = [coder.encode(x) for x in batch.column(text_col).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(encoder(path).vocabulary)
        for whole in batches:
            for batch in (whole.slice(a, 512) for a in range(0, whole.num_rows, 512)):
                texts = [None if x is None else decoder.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def _round_trip(path: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        decoder = Decoder(coder.vocabulary)
        for whole in batches:
            for batch in (whole.slice(a, 512) for a in range(0, whole.num_rows, 512)):
                ids = [coder.encode(x) for x in batch.column(text_col).to_pylist()]
                texts = pa.array([decoder.decode(x) for x in ids], pa.string())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != text_col]
                yield pa.RecordBatch.from_arrays([*[c for _, c in kept], lists, texts], names=[*[n for n, _ in kept], "ids", "decoded"])

    return run


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """Adds ids array<int>: the text's tokens (null or empty text: none). An input column ids is replaced."""
    df = docs.drop("ids").withColumn(text_col, F.col(text_col).cast("string"))
    return df.mapInArrow(_encode(path, text_col), f"{_ddl(df)}, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Adds decoded: the text of ids (null stays null, ids outside the vocabulary are left out)."""
    df = tokens.drop("decoded").withColumn("ids", F.col("ids").cast("array<int>"))
    return df.mapInArrow(_decode(path), f"{_ddl(df)}, decoded string")


def round_trip(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass over the texts; the text column is left out."""
    df = docs.drop("ids", "decoded").withColumn(text_col, F.col(text_col).cast("string"))
    return df.mapInArrow(_round_trip(path, text_col), f"{_ddl(df.drop(text_col))}, ids array<int>, decoded string".removeprefix(", "))


def _lengths(path: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            n = [coder.length(x) for x in batch.column(text_col).to_pylist()]
            kept = [(c, x) for c, x in zip(batch.schema.names, batch.columns, strict=True) if c != text_col]
            yield pa.RecordBatch.from_arrays([*[x for _, x in kept], pa.array(n, pa.int64())], names=[*[c for c, _ in kept], "n_tokens"])

    return run


def token_lengths(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """The input's columns without the text, plus n_tokens; null or empty text has none."""
    df = docs.drop("n_tokens").withColumn(text_col, F.col(text_col).cast("string"))
    return df.mapInArrow(_lengths(path, text_col), f"{_ddl(df.drop(text_col))}, n_tokens long".removeprefix(", "))
