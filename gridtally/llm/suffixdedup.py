"""Removal of repeated byte strings by grouping equal windows.

A byte goes if a string of MIN_BYTES bytes over it also starts earlier. That is the same
as a longest previous factor of that length, but no factor lengths are computed. Sorting
all suffixes of a corpus in one place is out of the question, so strings are dealt first:
each window of MIN_BYTES bytes belongs to the smallest hash among its GRAM-byte pieces
(its anchor), and windows in a row with one anchor are one segment. Equal windows have
equal anchors, so each group of segments with one anchor is complete in itself, and
segments whose anchor occurs once need not move. Segments of an anchor that all have the
same content are settled by their places: no text is sent. In other groups the windows are ranked by
their MIN_BYTES bytes (ranks of prefixes, doubled) and ties by place: all but the first
place of a rank are repeated. Anchors of more than MOST_SEGMENTS segments never
meet in one task: their windows are dealt by hashes of all of their bytes instead.

Texts travel as chunks of about CHUNK_BYTES bytes, compressed; what repeats within a
chunk is settled there, and a chunk sends each different segment once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridtally.llm.wordbytes import mixed, powers, utf8
from gridtally.session import materialize

MIN_BYTES = 100
GRAM = 24
CHUNK_BYTES = 1024 * 1024
# Anchors of more segments than this, counted once a chunk and content, are dealt by window.
MOST_SEGMENTS = 20_000
# Segments whose windows are cut at a time.
_SLICE = 500
# Bytes that are hashed at a time, and segments that are ranked at a time where groups allow:
# each takes up to a hundred bytes of arrays for a byte.
_STRETCH = 1 << 18
_RANKED = 2_000
_PLACE_BITS = 24
_LAST = np.iinfo(np.int64).max

CHUNKS = "blob binary, ids array<long>, known array<boolean>, ends array<long>"
SEGMENTS = "chunk long, anchor long, content long, doc_id long, at long, text binary"
VERDICTS = "chunk long, content long, anchor long, mask binary"
WINDOWS = "w1 long, w2 long, doc_id long, place long, chunk long, content long, anchor long, number int"
# A second value for each byte, so that two hashes of a window are independent.
_VALUES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


def _chunks(docs: DataFrame) -> DataFrame:
    """``chunk`` and CHUNKS, stored: compressed texts, ids (null: last) and ends of texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def packed() -> pa.RecordBatch:
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            ends = np.cumsum([len(t) for t in texts]).tolist()
            known = [i is not None for i in ids]
            values = [_LAST if i is None else i for i in ids]
            arrays = [
                pa.array([blob], pa.binary()), pa.array([values], pa.list_(pa.int64())),
                pa.array([known], pa.list_(pa.bool_())), pa.array([ends], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["blob", "ids", "known", "ends"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if texts and size + len(text) > CHUNK_BYTES:
                    yield packed()
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield packed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, CHUNKS)
    return materialize(rows.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


class Segments:
    """The segments of some texts: start and end in ``data``, anchor and content hashes."""

    def __init__(self, data: bytes, ends: list[int], min_bytes: int):
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.ends = np.asarray(ends, dtype=np.int64)
        parts = [
            self._stretch(low, min(low + _STRETCH + min_bytes - 1, len(self.data)), min_bytes)
            for low in range(0, max(len(self.data) - min_bytes + 1, 0), _STRETCH)
        ]
        empty = np.zeros(0, dtype=np.int64)
        self.start, self.end = (np.concatenate([p[i] for p in parts] or [empty]) for i in (0, 1))
        none = np.zeros(0, dtype=np.uint64)
        self.anchor, self.content = (np.concatenate([p[i] for p in parts] or [none]) for i in (2, 3))
        self.doc = np.searchsorted(self.ends, self.start, side="right")

    def _stretch(self, low: int, high: int, min_bytes: int) -> tuple[np.ndarray, ...]:
        data, n = self.data[low:high], high - low
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n)[:n], out=sums[1:])
        back = powers(n, inverse=True)
        grams = n - GRAM + 1
        hashes = mixed((sums[GRAM:] - sums[:grams]) * back[:grams])
        place = np.arange(grams, dtype=np.uint64)
        mask = np.uint64((1 << _PLACE_BITS) - 1)
        # The place in the low bits: the leftmost of equal hashes is the smallest.
        least = (hashes & ~mask) | place
        span, width = 1, min_bytes - GRAM + 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            rest = width - span
            least = np.minimum(least[:-rest], least[rest:])
        windows = n - min_bytes + 1
        starts = np.arange(windows, dtype=np.int64)
        owner = np.searchsorted(self.ends, starts + low, side="right")
        inside = self.ends[np.minimum(owner, len(self.ends) - 1)] - (starts + low) >= min_bytes
        starts = starts[inside]
        anchor = (least[:windows] & mask).astype(np.int64)[inside]
        if not len(starts):
            return starts, starts, hashes[:0], hashes[:0]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        begin, end = starts[first], starts[last] + min_bytes
        content = mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
        return begin + low, end + low, hashes[anchor[first]], content

    def first_of_content(self) -> np.ndarray:
        """True for the first segment of each content in order of ``data``."""
        _, first = np.unique(self.content, return_index=True)
        out = np.zeros(len(self.content), dtype=bool)
        out[first] = True
        return out

    def leads(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each segment is the one of its content to be sent, and whether it repeats that.

        The earliest by id and place is sent. Of texts that share an id in one chunk any
        may have it; segments at the same id and place repeat nothing.
        """
        first = self.first_of_content()
        if not (ids[1:] == ids[:-1]).any():
            return first, ~first
        begins = np.concatenate([[0], self.ends[:-1]])
        owner, place = ids[self.doc], self.start - begins[self.doc]
        order = np.lexsort((place, owner, self.content))
        new = np.flatnonzero(np.diff(self.content[order], prepend=~self.content[order[:1]]) != 0)
        lead = np.empty(len(order), dtype=np.int64)
        lead[order] = order[np.repeat(new, np.diff(np.append(new, len(order))))]
        repeats = (owner != owner[lead]) | (place != place[lead])
        return lead == np.arange(len(lead)), repeats


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, one at a time: a chunk's lists take many times its bytes."""
    for i in range(batch.num_rows):
        yield tuple(column[i].as_py() for column in batch.columns)


def _unpacked(row: tuple) -> tuple[bytes, list[int], list[int]]:
    blob, ids, ends = row
    return zstandard.ZstdDecompressor().decompress(blob), ids, ends


def _ordered(ids: list[int], data: bytes, ends: list[int]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Texts by doc_id, so that the first of equal segments is the earliest."""
    order = np.argsort(np.asarray(ids), kind="stable")
    begins = np.concatenate([[0], np.asarray(ends[:-1], dtype=np.int64)]) if ends else np.zeros(0, np.int64)
    texts = [data[begins[i] : ends[i]] for i in order]
    return order, b"".join(texts), np.cumsum([len(t) for t in texts])


def _anchors(chunks: DataFrame, min_bytes: int) -> DataFrame:
    """``chunk, anchor, twice, contents, content``: the different anchors of each chunk, whether it
    has more than one segment of it, how many different ones, and the content if there is one only."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *row in _rows(batch):
                data, _, ends = _unpacked(row)
                found = Segments(data, ends, min_bytes)
                anchors, counts = np.unique(found.anchor, return_counts=True)
                # Equal contents have equal anchors, so every anchor is among the first ones.
                first = found.first_of_content()
                _, one, contents = np.unique(found.anchor[first], return_index=True, return_counts=True)
                content = found.content[first][one].view(np.int64)
                if len(anchors):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(anchors), chunk)), pa.array(anchors.view(np.int64)),
                            pa.array(counts > 1), pa.array(contents.astype(np.int64)),
                            pa.array(content, mask=contents > 1),
                        ],
                        ["chunk", "anchor", "twice", "contents", "content"],
                    )

    schema = "chunk long, anchor long, twice boolean, contents long, content long"
    return chunks.select("chunk", "blob", "ids", "ends").mapInArrow(find, schema)


def _repeated(anchors: DataFrame) -> DataFrame:
    """``chunk, repeated, alike, hot``: the anchors of each chunk that occur again, of segments that
    differ, of segments that are all the same, and of too many to meet in one task."""
    # A row per anchor and chunk at most, however often it occurs.
    same = Window.partitionBy("anchor")
    content = F.col("content")
    one = (F.count(content).over(same) == F.count("*").over(same)) & (F.min(content).over(same) == F.max(content).over(same))
    seen = anchors.select(
        "chunk", "anchor", F.min("chunk").over(same).alias("lo"), F.max("chunk").over(same).alias("hi"), "twice",
        (F.sum("contents").over(same) > MOST_SEGMENTS).alias("hot"), one.alias("alike"),
    )
    hot, alike, anchor = F.col("hot"), F.col("alike"), F.col("anchor")
    return seen.where("lo < hi OR twice").groupBy("chunk").agg(
        F.collect_list(F.when(~hot & ~alike, anchor)).alias("repeated"),
        F.collect_list(F.when(~hot & alike, anchor)).alias("alike"),
        F.collect_list(F.when(hot, anchor)).alias("hot"),
    )


def _segments(listed: DataFrame, min_bytes: int) -> DataFrame:
    """SEGMENTS: the first segment of each content in a chunk whose anchor is repeated; those
    of anchors in ``alike`` have no text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, ids, _, ends, repeated, alike in _rows(batch):
                if not repeated and not alike:
                    continue
                data, _, _ = _unpacked((blob, ids, ends))
                order, data, ends = _ordered(ids, data, ends)
                found = Segments(data, ends, min_bytes)
                differ = np.isin(found.anchor, np.asarray(repeated, dtype=np.int64).view(np.uint64))
                wanted = differ | np.isin(found.anchor, np.asarray(alike, dtype=np.int64).view(np.uint64))
                first, _ = found.leads(np.asarray(ids, dtype=np.int64)[order])
                at = np.flatnonzero(wanted & first)
                begins = np.concatenate([[0], found.ends[:-1]])
                places = zip(found.start[at].tolist(), found.end[at].tolist(), differ[at].tolist())
                texts = [data[s:e] if text else None for s, e, text in places]
                ids_of = np.asarray(ids, dtype=np.int64)[order][found.doc[at]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), chunk)), pa.array(found.anchor[at].view(np.int64)),
                        pa.array(found.content[at].view(np.int64)), pa.array(ids_of),
                        pa.array(found.start[at] - begins[found.doc[at]]), pa.array(texts, pa.binary()),
                    ],
                    ["chunk", "anchor", "content", "doc_id", "at", "text"],
                )

    columns = listed.select("chunk", "blob", "ids", "known", "ends", "repeated", "alike")
    return columns.mapInArrow(cut, SEGMENTS)


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """For each place its rank among all by the next ``length`` bytes, at least 8; equal
    strings have equal ranks. Places that close to the end are ranked as if zeros followed."""
    padded = np.concatenate([data, np.zeros(length + 8, dtype=np.uint8)])
    value = np.zeros(len(data) + length, dtype=np.uint64)
    for i in range(8):
        value = (value << np.uint64(8)) | padded[i : i + len(value)]
    rank = np.unique(value, return_inverse=True)[1].astype(np.uint64)
    reach = 8
    while reach < length:
        step = min(reach, length - reach)
        further = np.concatenate([rank[step:], np.zeros(step, dtype=np.uint64)])
        rank = np.unique((rank << np.uint64(32)) | further, return_inverse=True)[1].astype(np.uint64)
        reach += step
    return rank[: len(data)]


def repeated_windows(texts: list[bytes], doc: np.ndarray, at: np.ndarray, min_bytes: int) -> list[np.ndarray]:
    """For each segment a mask of its windows whose bytes also start at an earlier place.

    ``doc`` and ``at`` are the places of the segments in the corpus.
    """
    sizes = np.array([len(t) for t in texts])
    rank = suffix_ranks(np.frombuffer(b"".join(texts), dtype=np.uint8), min_bytes)
    windows = sizes - min_bytes + 1
    owner = np.repeat(np.arange(len(texts)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    own = rank[np.repeat(np.cumsum(sizes) - sizes, windows) + inside]
    # By rank, ties by place in the corpus.
    order = np.lexsort((at[owner] + inside, doc[owner], own))
    same_rank = np.zeros(len(order), dtype=bool)
    same_rank[1:] = own[order][1:] == own[order][:-1]
    place = np.stack([doc[owner][order], (at[owner] + inside)[order]])
    # Rows that share an id and place are not earlier than each other.
    tied = np.zeros(len(order), dtype=bool)
    tied[1:] = same_rank[1:] & (place[:, 1:] == place[:, :-1]).all(axis=0)
    begins = np.flatnonzero(~same_rank)
    run = np.cumsum(~same_rank) - 1
    first_place = place[:, begins][:, run]
    repeated = np.empty(len(order), dtype=bool)
    repeated[order] = same_rank & ~((place == first_place).all(axis=0))
    return np.split(repeated, np.cumsum(windows)[:-1]) if len(texts) else []


def _verdicts(segments: DataFrame, min_bytes: int) -> DataFrame:
    """VERDICTS: of each sent segment with removed windows, which; no mask: all of them."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settled(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            """Whole groups, sorted by anchor, place."""
            first: dict[tuple[int, int], tuple[int, int]] = {}
            contents: dict[int, int] = {}
            out, open_ = [], []
            for row in rows:
                chunk, anchor, content, doc_id, at, _ = row
                if (anchor, content) not in first:
                    first[anchor, content] = (doc_id, at)
                    contents[anchor] = contents.get(anchor, 0) + 1
                if first[anchor, content] == (doc_id, at):
                    open_.append(row)
                else:
                    out.append((chunk, content, anchor, None))
            open_ = [row for row in open_ if contents[row[1]] > 1]
            if open_:
                doc, at = (np.array([row[i] for row in open_], dtype=np.int64) for i in (3, 4))
                masks = repeated_windows([row[5] for row in open_], doc, at, min_bytes)
                out += [
                    (row[0], row[2], row[1], np.packbits(mask).tobytes())
                    for row, mask in zip(open_, masks) if mask.any()
                ]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                arrays = [pa.array(values, kind) for values, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "content", "anchor", "mask"])

        for batch in batches:
            for low in range(0, batch.num_rows, _RANKED):
                held += zip(*[column.to_pylist() for column in batch.slice(low, _RANKED).columns])
                last = held[-1][1]
                if held[0][1] != last:
                    ready = next(i for i in range(len(held) - 1, -1, -1) if held[i][1] != last) + 1
                    yield from settled(held[:ready])
                    held = held[ready:]
        yield from settled(held)

    dealt = segments.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "at")
    return dealt.mapInArrow(judge, VERDICTS)


def _window_verdicts(segments: DataFrame, min_bytes: int) -> DataFrame:
    """The same without groups: each window is compared with the first place of its bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _SLICE):
                part = batch.slice(low, _SLICE)
                texts = part.column(5).to_pylist()
                data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                sizes = np.array([len(t) for t in texts])
                windows = sizes - min_bytes + 1
                owner = np.repeat(np.arange(len(texts)), windows)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
                begin = np.repeat(np.cumsum(sizes) - sizes, windows) + number
                back = powers(len(data), inverse=True)
                hashes = []
                for values in (data.astype(np.uint64) + np.uint64(1), _VALUES[data]):
                    sums = np.zeros(len(data) + 1, dtype=np.uint64)
                    np.cumsum(values * powers(len(data))[: len(data)], out=sums[1:])
                    hashes.append(mixed((sums[begin + min_bytes] - sums[begin]) * back[begin]).view(np.int64))
                chunk, anchor, content, doc_id, at = (part.column(i).to_numpy()[owner] for i in range(5))
                arrays = [*hashes, doc_id, at + number, chunk, content, anchor, number.astype(np.int32)]
                names = ["w1", "w2", "doc_id", "place", "chunk", "content", "anchor", "number"]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for numbers in batch.column(3).to_pylist():
                mask = np.zeros(max(numbers) + 1, dtype=bool)
                mask[numbers] = True
                masks.append(np.packbits(mask).tobytes())
            arrays = [*[batch.column(i) for i in range(3)], pa.array(masks, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["chunk", "content", "anchor", "mask"])

    windows = materialize(segments.mapInArrow(cut, WINDOWS), "windows")
    # A window sends one row per task here, however often it occurs.
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n"))
    later = windows.join(first.where("n > 1"), ["w1", "w2"]).where(F.struct("doc_id", "place") != F.col("first"))
    # A segment has as many windows as there are places for its anchor in one.
    masks = later.groupBy("chunk", "content", "anchor").agg(F.collect_list("number").alias("numbers"))
    return masks.mapInArrow(pack, VERDICTS)


def _kept(judged: DataFrame, min_bytes: int, texts: bool) -> DataFrame:
    """A row per document from chunks with their verdicts."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary" if texts else ""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, ids, known, ends, verdicts in _rows(batch):
                data, _, _ = _unpacked((blob, ids, ends))
                order, data, ends = _ordered(ids, data, ends)
                found = Segments(data, ends, min_bytes)
                # Later segments of a content in one chunk repeat the first; rows with one id and place do not.
                values = np.asarray(ids, dtype=np.int64)[order]
                _, repeats = found.leads(values)
                begins = np.concatenate([[0], found.ends[:-1]])
                begin, stop = [found.start[repeats]], [found.end[repeats]]
                decided = {v["content"]: v["mask"] for v in verdicts or ()}
                if decided:
                    of = np.fromiter(decided, dtype=np.int64, count=len(decided)).view(np.uint64)
                    led = np.flatnonzero(~repeats)
                    for i in led[np.isin(found.content[led], of)].tolist():
                        mask = decided[int(found.content[i].view(np.int64))]
                        low, high = int(found.start[i]), int(found.end[i])
                        if mask is None:
                            begin.append(np.array([low]))
                            stop.append(np.array([high]))
                            continue
                        windows = np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=high - low - min_bytes + 1)
                        hit = low + np.flatnonzero(windows)
                        begin.append(hit)
                        stop.append(hit + min_bytes)
                change = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(change, np.concatenate(begin).astype(np.int64), 1)
                np.add.at(change, np.concatenate(stop).astype(np.int64), -1)
                gone = np.cumsum(change, dtype=np.int32)[:-1] > 0
                raw = np.frombuffer(data, dtype=np.uint8)
                rows = []
                valid = np.asarray(known)[order]
                for doc, (low, high) in enumerate(zip(begins.tolist(), np.asarray(ends).tolist())):
                    own = gone[low:high]
                    left = raw[low:high][~own].tobytes()
                    spans = int(np.count_nonzero(np.diff(own.astype(np.int8), prepend=np.int8(0)) == 1))
                    doc_id = int(values[doc]) if valid[doc] else None
                    row = (doc_id, high - low, int(own.sum()), spans, hashlib.sha256(left).hexdigest())
                    rows.append((*row, left) if texts else row)
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts
                arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return judged.select("blob", "ids", "known", "ends", "verdicts").mapInArrow(keep, schema)


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, texts: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row, and the ``kept`` bytes.

    Every byte covered by a string of ``min_bytes`` bytes (more than GRAM) that starts
    earlier, in a smaller doc_id or earlier in the same document, goes; strings are
    judged on the input. A null id comes last, a null text is empty. Rows that share an
    id share their places. What is left may end within a character, so it is binary.
    """
    chunks = _chunks(docs)
    anchors = _anchors(chunks, min_bytes)
    repeated = materialize(_repeated(anchors), "repeated_anchors")
    # The same columns and the same kind of join as at the end, so chunks are shuffled once. Lists
    # of anchors and verdicts grow with the input: they are merged at any size, never broadcast.
    listed = chunks.join(repeated.select("chunk", "repeated", "alike").hint("merge"), "chunk", "left")
    verdicts = _verdicts(_segments(listed, min_bytes), min_bytes)
    hot = repeated.where(F.size("hot") > 0).select("chunk", "hot")
    if not hot.isEmpty():
        # Only chunks with such an anchor are cut a second time, where they are read. An anchor
        # stands for MOST_SEGMENTS segments and a number for a chunk, so both lists are short.
        anchors = hot.select(F.explode("hot").alias("anchor")).agg(F.collect_set("anchor").alias("repeated"))
        cut = chunks.join(F.broadcast(hot.select("chunk")), "chunk", "left_semi").join(F.broadcast(anchors))
        cut = cut.withColumn("alike", F.array().cast("array<long>"))
        verdicts = verdicts.unionByName(_window_verdicts(_segments(cut, min_bytes), min_bytes))
    verdict = F.struct("content", "mask")
    verdicts = verdicts.groupBy("chunk").agg(F.collect_list(verdict).alias("verdicts"))
    return _kept(chunks.join(verdicts.hint("merge"), "chunk", "left"), min_bytes, texts)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, texts=False)
