"""Removal of repeated 200-byte strings by column-wise construction of collection suffix structures.

1. *Segments.* Every 200-byte window of a text is owned by its anchor, the leftmost of the 40-byte strings
   inside it that has the smallest hash. Equal windows have equal anchors at the same offset, so windows
   whose anchor occurs once in the corpus repeat nowhere. The windows that one anchor owns start side by
   side; the bytes they span are a segment of at most 360 bytes. Only hashes are shuffled here.
2. *Collections.* Segments are counted by anchor and content. A segment that occurs twice or more has all its
   windows repeated. The distinct segments of anchors with several contents form collections; a collection
   holds all segments of its anchors, so windows of different collections never agree.
3. *Columns.* Per collection the Burrows-Wheeler transform and the common prefixes of neighbouring
   suffixes are built by rounds: round j inserts the suffix of length j of every segment, whose place is
   the rank of its first symbol in the transform, and whose common prefixes are one more than the minimum between
   occurrences of that symbol. A window is repeated if one of its two neighbours in the
   finished order shares 200 bytes with it.
4. *Texts.* Repeated windows go back to the texts that hold the segment, and the bytes they cover are removed.

A collection is bounded (``BLOCK`` segments and its last anchor), so transform and prefixes are arrays of one task, read
and rewritten front to back each round in place of external files: machine-local files are lost
with their executor. An anchor with more than ``HOT`` distinct segments cannot be held by one task;
its windows are counted by content instead, each a row of its own, which gives the same answer.

A null text is empty; texts below 200 bytes lose nothing. Repeated rows repeat each other's windows. Rows
without an id are handled like the others. Segments are told apart by 128 bits (two independent 64-bit hashes), texts as well.
An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.session import settle

LENGTH, ANCHOR = 200, 40
SPAN = LENGTH - ANCHOR + 1  # anchors in a window, and windows an anchor can own
#: Bytes hashed at once, distinct segments in a collection, and distinct segments of one anchor in a collection.
CHUNK, BLOCK, HOT = 1 << 17, 1_024, 16_384
#: Bits for positions in a chunk.
PLACE = 18
#: Bands of windows that are looked up by a longer string around their anchor.
BANDS = 2
END = 255  # never a byte of UTF-8


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes from every position on, by doubling the length hashed."""
    n = len(data) - ANCHOR + 1
    step, have, power = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    done, length = None, 0
    while True:
        if ANCHOR & have:
            # Append ``have`` bytes to the ``length`` hashed so far.
            done = step if done is None else done[: len(step) - length] * np.uint64(power) + step[length : length + len(done)][: len(step) - length]
            length += have
        if length == ANCHOR:
            break
        step = step[:-have] * np.uint64(power) + step[have:]
        power = power * power % 2**64
        have *= 2
    mixed = done[:n] ^ (done[:n] >> np.uint64(29))
    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def owners(hashes: np.ndarray) -> np.ndarray:
    """For every window start, the position of the leftmost smallest hash among its ``SPAN`` anchors.

    Hashes are compared without their last ``PLACE`` bits, which hold the position meanwhile.
    """
    low = np.uint64((1 << PLACE) - 1)
    value, have = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1
    while have * 2 <= SPAN:
        value = np.minimum(value[have:], value[:-have])
        have *= 2
    if SPAN > have:
        value = np.minimum(value[SPAN - have :], value[: have - SPAN])
    return (value & low).astype(np.int64)


def segments_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Text number, first window and number of windows of every segment, and its anchor's hash.

    ``data`` holds texts one after the other, text i from ``starts[i]`` to ``ends[i]``.
    """
    if len(data) < LENGTH:
        return *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64)
    hashes = anchor_hashes(data)
    own = owners(hashes)
    first = np.union1d(np.flatnonzero(own[1:] != own[:-1]) + 1, starts[starts < len(own)])
    text = np.searchsorted(starts, first, "right") - 1
    # Of texts that begin at the same byte all but the last are empty.
    until = np.minimum(np.r_[first[1:], len(own)], ends[text] - LENGTH + 1)
    real = until > first
    first, text, until = first[real], text[real], until[real]
    return text, first, until - first, hashes[own[first]]


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of some texts, their places in them, row numbers and offsets; longer texts in overlapping pieces."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        until = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK, "right")) - 1)
        low, high = bounds[row], bounds[until]
        if until == row + 1 and high - low > CHUNK:
            for a in range(low, high - LENGTH + 1, CHUNK):
                b = min(high, a + CHUNK + LENGTH - 1)
                yield whole[a:b], np.zeros(1, np.int64), np.array([b - a]), np.array([row]), np.array([a - low])
        else:
            yield whole[low:high], bounds[row:until] - low, bounds[row + 1 : until + 1] - low, np.arange(row, until), np.zeros(until - row, np.int64)
        row = until


def dealt(small: DataFrame) -> DataFrame:
    """The same rows, dealt anew: a join with them then shuffles both sides and can split the other side's hot keys."""
    return small.hint("rebalance")


def text_key(text: Column) -> list[Column]:
    """Two independent hashes of a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


PLACES = "t1 long, t2 long, h long, d long, at int, n int"


def anchors(texts: DataFrame) -> DataFrame:
    """The anchor's hash of every segment of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, ends, _, _ in _pieces(batch.column(0)):
                h = segments_of(data, starts, ends)[3]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return texts.select("text").mapInArrow(run, "h long")


def segments(texts: DataFrame) -> DataFrame:
    """One row per segment of every text: text key, hashes of anchor and content, first window, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(i).to_numpy() for i in (0, 1))
            for data, starts, ends, rows, offsets in _pieces(batch.column(2)):
                text, window, n, h = segments_of(data, starts, ends)
                view = memoryview(data)
                digest = xxhash.xxh3_64_intdigest
                d = np.fromiter((digest(view[a : a + m + LENGTH - 1]) for a, m in zip(window.tolist(), n.tolist())), np.uint64, len(n))
                at, who = window - starts[text] + offsets[text], rows[text]
                columns = [t1[who], t2[who], h.view(np.int64), d.view(np.int64), at.astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t1", "t2", "h", "d", "at", "n"])

    return texts.select("t1", "t2", "text").mapInArrow(run, PLACES)


class Columns:
    """Transform and common prefixes of a collection, one symbol per text each round."""

    def __init__(self, texts: list[bytes]):
        m = len(texts)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        width = int(self.sizes.max(initial=0))
        # Column j holds the j-th symbol from the end, END where the text is over.
        symbols = np.full((width + 1, m), END, np.uint8)
        for i, t in enumerate(texts):
            symbols[: len(t), i] = np.frombuffer(t, np.uint8)[::-1]
        # Round 0: the empty suffixes in order of the texts, each preceded by its text's last symbol.
        self.bwt, self.lcp, self.m = symbols[0].copy(), np.zeros(m + 1, np.uint16), m
        self.count = np.bincount(self.bwt, minlength=256)
        place, active = np.arange(m), np.arange(m)
        for j in range(1, width + 1):
            going = self.sizes[active] >= j
            active, place = active[going], place[going]
            place = self._insert(place, symbols[j, active])
        self.lcp = self.lcp[:-1]

    def _insert(self, place: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Insert the suffixes one symbol longer than those at ``place``; return their new places."""
        bwt, n = self.bwt, len(self.bwt)
        symbol = bwt[place]
        # The old places in order of their symbols; a place's rank there is its new place after the empty suffixes.
        order = np.argsort(bwt, kind="stable")
        opens = np.cumsum(self.count) - self.count
        by = np.argsort(symbol.astype(np.int64) << 40 | place)
        cuts = np.flatnonzero(np.diff(symbol[by].astype(np.int16), prepend=-1))
        rank = np.empty(len(place), np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)]):
            mine, c = by[a:b], symbol[by[a]]
            rank[mine] = opens[c] + np.searchsorted(order[opens[c] : opens[c] + self.count[c]], place[mine])
        # Occurrences of the same symbol next to this one in the old order, if any.
        has_left, has_right = rank > opens[symbol], rank < opens[symbol] + self.count[symbol] - 1
        left, right = order[rank - 1], order[np.minimum(rank + 1, n - 1)]
        own, after = self._least(left, place, has_left), self._least(place, right, has_right)
        to = self.m + rank
        old = np.ones(n + len(place), bool)
        old[to] = False
        wider, longer = np.empty(len(old), np.uint8), np.zeros(len(old) + 1, np.uint16)
        wider[old], wider[to] = bwt, before
        longer[:-1][old], longer[to] = self.lcp[:-1], own
        longer[to[has_right] + 1] = after[has_right]
        self.bwt, self.lcp = wider, longer
        self.count += np.bincount(before, minlength=256)
        return to

    def _least(self, low: np.ndarray, high: np.ndarray, real: np.ndarray) -> np.ndarray:
        """One more than the smallest common prefix behind ``low`` up to ``high``, 0 where there is none."""
        out = np.zeros(len(low), np.uint16)
        by = np.flatnonzero(real)
        by = by[np.argsort(low[by])]
        if len(by):
            ends = np.empty(2 * len(by), np.int64)
            ends[::2], ends[1::2] = low[by] + 1, high[by] + 1
            out[by] = np.minimum.reduceat(self.lcp, ends)[::2] + 1
        return out

    def repeated(self) -> Iterator[tuple[int, np.ndarray]]:
        """(start, texts) of the suffixes of ``LENGTH`` symbols or more that share so many with a neighbour."""
        shared = np.r_[self.lcp >= LENGTH, False]
        shared = shared[:-1] | shared[1:]
        order = np.argsort(self.bwt, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place, texts = np.arange(self.m), np.arange(self.m)
        for j in range(1, int(self.sizes.max(initial=0)) + 1):
            going = self.sizes[texts] >= j
            texts = texts[going]
            place = self.m + rank[place[going]]
            if j >= LENGTH:
                hit = shared[place]
                yield from zip((self.sizes[texts[hit]] - j).tolist(), texts[hit].tolist())


def runs_of(flags: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of true values as first and last index."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]


def narrowed(keys: list[int], texts: list[bytes]) -> list[tuple[int, int]]:
    """Of every segment the first and last window whose longer string around the anchor occurs twice or more.

    The windows of an anchor are cut into ``BANDS`` by the anchor's offset in them. All windows of a band hold
    a string around the anchor that is longer than it; where no other segment of the anchor has that string,
    the band's windows repeat nowhere and need no place in the collection. (1, 0) if none is left.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    mine = np.repeat(np.array(keys, np.int64), sizes)[: len(data) - ANCHOR + 1]
    hits = np.flatnonzero(anchor_hashes(data).view(np.int64) == mine)
    # The anchor is the leftmost occurrence of its hash.
    offsets = hits[np.searchsorted(hits, ends - sizes)] - (ends - sizes)
    edges = [SPAN * i // BANDS for i in range(BANDS + 1)]
    found: dict[tuple[int, int, bytes], int] = {}
    held = []
    for key, text, o in zip(keys, texts, offsets.tolist()):
        last = len(text) - LENGTH
        for band, (a, b) in enumerate(zip(edges, edges[1:])):
            # Windows whose anchor is a to b - 1 bytes behind their start.
            first, final = max(0, o - b + 1), min(last, o - a)
            if first <= final:
                core = (key, band, text[o - a : o + LENGTH - b + 1])
                found[core] = found.get(core, 0) + 1
                held.append((core, first, final))
            else:
                held.append(None)
    out = []
    for i in range(len(texts)):
        kept = [x for x in held[i * BANDS : (i + 1) * BANDS] if x and found[x[0]] > 1]
        out.append((min(x[1] for x in kept), max(x[2] for x in kept)) if kept else (1, 0))
    return out


def repeated_windows(keys: list[int], texts: list[bytes]) -> list[list[dict[str, int]]]:
    """Runs of window starts that repeat among distinct segments with the hashes of their anchors."""
    if not texts:
        return []
    flags = [np.zeros(len(t) - LENGTH + 1, bool) for t in texts]
    parts = [(i, a, texts[i][a : b + LENGTH]) for i, (a, b) in enumerate(narrowed(keys, texts)) if a <= b]
    for start, part in Columns([t for _, _, t in parts]).repeated():
        i, a, _ = parts[part]
        flags[i][a + start] = True
    return [runs_of(f) for f in flags]


RUNS = "h long, d long, runs array<struct<a:int,b:int>>"


def collections(contents: DataFrame) -> DataFrame:
    """Repeated windows of distinct segments, all segments of an anchor being in one partition, side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, d, texts = [], [], []

        def done():
            columns = [pa.array(h, pa.int64()), pa.array(d, pa.int64())]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            return pa.RecordBatch.from_arrays([*columns, pa.array(repeated_windows(h, texts), kind)], names=["h", "d", "runs"])

        for batch in batches:
            for key, digest, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if len(texts) >= BLOCK and key != h[-1]:
                    yield done()
                    h, d, texts = [], [], []
                if not h or (key, digest) != (h[-1], d[-1]):
                    h.append(key), d.append(digest), texts.append(text)
        if texts:
            yield done()

    return contents.repartition("h").sortWithinPartitions("h", "d").select("h", "d", "segment").mapInArrow(run, RUNS)


def window_counts(contents: DataFrame) -> DataFrame:
    """The same for anchors with very many segments: every window a row, counted by content."""
    place = F.explode(F.sequence(F.lit(0), F.length("segment") - LENGTH))
    rows = contents.dropDuplicates(["h", "d"]).select("h", "d", "segment", place.alias("a"))
    rows = rows.select("h", "d", "a", F.unhex(F.md5(F.substring("segment", F.col("a") + 1, F.lit(LENGTH)))).alias("w"))
    twice = rows.groupBy("h", "w").agg(F.count("*").alias("_n")).where("_n > 1").select("h", "w")
    run = F.array(F.struct(F.col("a").alias("a"), F.col("a").alias("b")))
    return rows.join(dealt(twice), ["h", "w"]).select("h", "d", run.alias("runs"))


def contents_of(kinds: DataFrame, rows: DataFrame) -> DataFrame:
    """Bytes of every segment in ``kinds``, cut from one text that holds it.

    The documents are joined as in ``dedup``, with all their columns, so that Spark shuffles them once for both.
    Copies of a text arrive side by side and are cut once; where Spark splits a large group of copies, a segment can
    come twice.
    """
    place = F.struct("h", "d", "kinds", "at", "n")
    wanted = kinds.groupBy("t1", "t2").agg(F.collect_list(place).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for i, key in enumerate(keys):
                if key == last:
                    continue
                last = key
                text, places = batch.column(2)[i].as_buffer(), batch.column(3)[i].values
                h, d, many, at, n = (places.field(x) for x in ("h", "d", "kinds", "at", "n"))
                segment = [text[a : a + m + LENGTH - 1].to_pybytes() for a, m in zip(at.to_pylist(), n.to_pylist())]
                yield pa.RecordBatch.from_arrays([h, d, many, pa.array(segment, pa.binary())], names=["h", "d", "kinds", "segment"])

    joined = rows.join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "wanted", "doc_id")
    return joined.mapInArrow(run, "h long, d long, kinds long, segment binary")


def repeats(rows: DataFrame) -> DataFrame:
    """``places`` (first and last window of every run of repeated ones) per text key, for documents with key and ``text``."""
    texts = rows.where(F.octet_length("text") >= LENGTH)
    shared = anchors(texts).groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h")
    # Segments of anchors that occur twice or more; texts that are copies of each other count once, with their number.
    held = settle(segments(texts).join(dealt(shared), "h").groupBy("h", "d", "t1", "t2", "at", "n").agg(F.count("*").alias("copies")))
    kinds = settle(
        held.groupBy("h", "d", "n").agg(
            F.sum("copies").alias("copies"), F.first("t1").alias("t1"), F.first("t2").alias("t2"), F.first("at").alias("at")
        )
    )
    several = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    contents = contents_of(kinds.join(dealt(several), "h"), rows)
    if kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).isEmpty():
        inside = collections(contents)
    else:
        contents = settle(contents)
        inside = collections(contents.where(F.col("kinds") <= HOT)).unionByName(window_counts(contents.where(F.col("kinds") > HOT)))
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).cast("int").alias("b")))
    runs = kinds.where("copies > 1").select("h", "d", whole.alias("runs")).unionByName(inside.where(F.size("runs") > 0))
    rows = held.select("h", "d", "t1", "t2", "at").join(runs, ["h", "d"])
    places = rows.groupBy("t1", "t2").agg(F.collect_list(F.struct("at", "runs")).alias("places"))
    ends = F.flatten(F.transform("places", lambda p: F.flatten(F.transform(p["runs"], lambda r: F.array(p["at"] + r["a"], p["at"] + r["b"])))))
    return places.select("t1", "t2", ends.alias("places"))


def cut(data: bytes, places: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the number of maximal runs of them.

    ``places`` has the first and the last window of every run of repeated windows.
    """
    if not len(places):
        return data, 0, 0
    first, last = places[::2], places[1::2]
    by = np.argsort(first)
    first, until = first[by], np.maximum.accumulate(last[by] + LENGTH)
    opens = np.r_[True, first[1:] > until[:-1]]
    a, b = first[opens].tolist(), until[np.r_[opens[1:], True]].tolist()
    kept = [data[x:y] for x, y in zip([0, *b], [*a, len(data)])]
    return b"".join(kept), sum(b) - sum(a), len(a)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``kept`` (bytes left), ``n_bytes``, ``n_removed`` and ``n_spans`` of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *text_key(F.col("text")))
    places = repeats(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(1).to_pylist()
                done = [cut(t, p.values.to_numpy().astype(np.int64) if p.is_valid else none) for t, p in zip(texts, part.column(2))]
                kept, removed, spans = zip(*done)
                columns = [part.column(0), pa.array(kept, pa.binary()), pa.array([len(t) for t in texts]), pa.array(removed), pa.array(spans)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = rows.join(dealt(places), ["t1", "t2"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "places")
    return joined.mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Numbers of bytes and runs removed, and a digest of the bytes left, per document."""
    return dedup(docs, text, doc_id).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
