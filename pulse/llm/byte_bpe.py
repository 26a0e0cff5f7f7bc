"""Byte-level BPE encoding with tree concatenation for long unsplit text, and decoding.

A text is cut where a blank follows something else, which the vocabulary's own pattern always does too, and the
words so found are cut into pieces by that pattern. Every piece is encoded by the tokenizers library's model once;
pieces and words are remembered by the worker. ``encode_all`` cuts a column of texts as bytes, also around a sign that
ends a word, and looks up each distinct word of some megabytes once. A piece longer than ``LEAF`` characters (a run of
letters, signs or blanks without a cut) is halved down to leaves, the leaves are encoded in parallel, and neighbours
are joined bottom-up: a window of tokens on both sides of the join is encoded again and grown until its
first and last token are those of the two sides. Each pair of neighbouring tokens is then one that the
encoder itself leaves alone, so the joined ids are the ids of the whole.

Null and empty texts have no ids. Repeated rows are encoded alike; other columns are not read. An empty table gives
no rows.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL = "<|endoftext|>"
LEAF, WINDOW = 2_048, 16
#: Pieces and words a worker remembers in each of two generations, and the longest of them.
REMEMBERED, SHORT = 200_000, 32
#: The vocabulary's published cutting pattern, with blanks spelled out by property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: The characters with the property White_Space.
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+").findall
#: Bytes of texts cut at once; a longer text is cut alone.
PART = 4 << 20
#: Bytes that are a blank, a letter or digit, or a sign that often ends a word; and the rest.
BLANK, ALNUM, SIGN = 1, 2, 4
KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in ((BLANK, b"\t\n\v\f\r "), (SIGN, b".,;:!?"), (ALNUM, bytes(b for b in range(128) if chr(b).isalnum()))):
    KINDS[list(_bytes)] = _kind


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary, by the published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBpe:
    """Encode to and decode from ids held as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = regex.compile(PATTERN).findall
        # Ids of pieces and words; a word that is one piece is the same entry.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.model, letters = self.tokenizer.model, byte_letters()
        self.letter_of = {b: c for c, b in letters.items()}
        vocab = json.loads(self.tokenizer.to_str())["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.special = self.tokenizer.token_to_id(SPECIAL)
        self.bytes_of[self.special] = SPECIAL.encode()
        self.packed_id = {i: packed([i]) for i in vocab.values()}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> bytes:
        if len(piece) > SHORT:
            return packed(self.tree(piece) if len(piece) > LEAF else self.ids(piece))
        found = self.before.get(piece)
        if not found:
            found = self._new(piece)
        self.known[piece] = found
        return found

    def _new(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # all but the blank stand for themselves
            letters = piece.replace(" ", self.letter_of[32])
        else:
            letters = piece.encode().decode("latin-1").translate(self.letter_of)
        table = self.packed_id
        return b"".join([table[t.id] for t in self.model.tokenize(letters)])

    def _word(self, word: str) -> bytes:
        found = self.before.get(word)
        if not found:
            letters = word[1:] if word[0] == " " else word
            if letters.isalpha():
                if len(word) > SHORT:
                    return self._piece(word)
                found = self._new(word)
            else:
                get = self.known.get
                if letters[-1:] in ".,;:!?" and letters[:-1].isalpha():  # letters and one sign are always cut apart
                    found = (get(word[:-1]) or self._piece(word[:-1])) + (get(word[-1]) or self._piece(word[-1]))
                else:
                    found = b"".join([get(p) or self._piece(p) for p in self.find(word)])
        if len(word) <= SHORT:
            self.known[word] = found
        return found

    def tree(self, piece: str) -> list[int]:
        """Ids of a piece that the pattern does not cut, by halves."""
        cuts = list(range(0, len(piece), LEAF))
        leaves = [piece[a : a + LEAF] for a in cuts]
        parts = [e.ids for e in self.tokenizer.encode_batch(leaves, add_special_tokens=False)]
        while len(parts) > 1:
            joined = [self._join(a, b) for a, b in zip(parts[::2], parts[1::2])]
            parts = joined + (parts[-1:] if len(parts) % 2 else [])
        return parts[0] if parts else []

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        size = WINDOW
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            raw = b"".join(self.bytes_of[i] for i in left[a:] + right[:b])
            try:
                middle = self.ids(raw.decode())
            except UnicodeDecodeError:  # the window starts or ends inside a character
                middle = None
            # A window edge at the end of a side needs no agreement there.
            if middle and (a == 0 or middle[0] == left[a]) and (b == len(right) or middle[-1] == right[b - 1]):
                return left[:a] + middle + right[b:]
            if a == 0 and b == len(right):
                raise ValueError("ids of a whole piece must decode")
            size += WINDOW if middle is None else size

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        get, word = self.known.get, self._word
        out = [b"".join([get(w) or word(w) for w in WORDS(part)]) for part in text.split(SPECIAL)]
        return out[0] if len(out) == 1 else packed([self.special]).join(out)

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of every text of a column."""
        sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
        starts = np.flatnonzero(np.diff(sizes // PART, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(texts)]):
            part = texts.slice(a, b - a)
            if pa.types.is_string(part.type) and not pc.match_substring(part, SPECIAL).true_count:
                yield from self._column(part.fill_null(""))
            else:
                yield from map(self.encode, part.to_pylist())

    def _column(self, texts: pa.StringArray) -> list[bytes]:
        ends = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(ends[0]), int(ends[-1])
        if first == last:
            return [b""] * len(texts)
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        data = texts.buffers()[2]
        cut = _cuts(np.frombuffer(data, np.uint8)[first:last])
        cut[ends - first] = True
        cuts = (np.flatnonzero(cut) + first).astype("<i4")
        words = pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(cuts), data]).dictionary_encode()
        get, word = self.known.get, self._word
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array([get(w) or word(w) for w in distinct], pa.large_binary()).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], "<i8")[np.searchsorted(cuts, ends)].tolist()
        raw = memoryview(ids.buffers()[2])
        return [bytes(raw[a:b]) for a, b in zip(at, at[1:])]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _cuts(data: np.ndarray) -> np.ndarray:
    """Whether UTF-8 is cut before each byte and the end: before a blank after something else, between a letter or digit
    and a sign with a blank behind, and after a single blank that is no space. Cuts left out near other characters are made later."""
    kinds, cut = KINDS[data], np.zeros(len(data) + 1, bool)
    blank = kinds == BLANK
    at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    # Not after the other blanks: C2 85, C2 A0, or three bytes from E1 9A, E2 80, E2 81 or E3 80 on.
    wide = np.flatnonzero(data[at - 1] > 127)
    two, three = data[at[wide] - 2], data[at[wide] - 3]
    at = np.delete(at, wide[(two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A)))])
    cut[at] = True
    signs = at[kinds[at - 1] == SIGN] - 1
    cut[signs[kinds[signs - 1] == ALNUM]] = True
    after = at[(data[at] != 32) & (at + 1 < len(data))] + 1
    cut[after[~blank[after] & (data[after] < 128)]] = True
    return cut


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encoded(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, decode: bool = True
) -> DataFrame:
    """``doc_id``, ``ids`` (bytes) and ``decoded`` (null when not asked for) of every text."""
    name, kind = path or default_path(), docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) if decode else None for x in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    columns = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return columns.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text, per document."""
    return encoded(docs, text, doc_id, path).select(
        "doc_id",
        F.expr("length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
