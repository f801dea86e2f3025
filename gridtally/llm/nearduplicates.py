"""MinHash near-duplicates with tensored banding.

Two collections of ``PARTS`` sub-signatures of ``HASHES`` minhashes each are computed;
every pair of one from each makes a table key, so PARTS² tables need only 2·PARTS·HASHES
minhashes. Texts that share a key are candidates, and every link is confirmed on the
full sets. A pair of similarity s shares a key with probability (1 - (1 - s^HASHES)^PARTS)²,
which is 0.9998 at 0.8 and above 0.99999 at 0.87.

Equal sets are one node from the start. Within a key the smallest node is compared with
all others first; only keys whose members are still in different components go on, with
more members to compare per round, until no pair of one key that could join two
components is left unchecked. Parity bits of the sets bound their difference from
below, so most pairs that are too far apart are never formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridtally.llm.wordbytes import Words, blocks, mixed, utf8
from gridtally.session import materialize

SHINGLE = 5
PERCENT = 80
PARTS = 9
HASHES = 2
SEED = 3
# Numbers of 64 parity bits each that sketch a set.
SKETCH = 16
# Members of a key that its others are compared with in the first round after the smallest one,
# and the growth of their number: a round costs more than that many pairs a member.
FIRST_RANKS = 64
# Rows of edges or labels for a task that stores them; each costs far less than a task.
ROWS_PER_FILE = 100_000

_STEP = np.uint64(0xD6E8FEB86659FD93)
SIGNATURE = "doc_id long, n long, f1 long, f2 long, subs array<long>"


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, counts)``: the distinct shingles of each text in turn, sorted, and how many."""
    words = Words(texts, "spaced")
    hashes = words.hashes()
    per_text = np.where(words.counts > 0, np.maximum(words.counts - size + 1, 1), 0)
    first = np.cumsum(words.counts) - words.counts
    text = np.repeat(np.arange(len(texts)), per_text)
    start = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    length = np.minimum(words.counts[text], size)
    values = np.zeros(len(text), dtype=np.uint64)
    for place in range(size):
        inside = place < length
        at = np.where(inside, start + place, 0)
        values = np.where(inside, values * _STEP + hashes[at], values) if len(hashes) else values
    values = mixed(values + length.astype(np.uint64))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.bincount(text[new], minlength=len(texts))


def _signatures(texts: list[bytes], size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    values, counts = shingle_sets(texts, size)
    n = len(texts)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    prints = np.zeros((2, n), dtype=np.uint64)
    subs = np.zeros((n, 2 * PARTS), dtype=np.uint64)
    if len(full):
        prints[0, full] = np.add.reduceat(mixed(values), starts)
        prints[1, full] = np.add.reduceat(mixed(values ^ _STEP), starts)
        rng = np.random.default_rng(seed)
        for part in range(2 * PARTS):
            sub = np.zeros(len(full), dtype=np.uint64)
            for _ in range(HASHES):
                factor, shift = rng.integers(0, 2**63, 2, dtype=np.uint64)
                low = np.minimum.reduceat(values * (factor * np.uint64(2) + np.uint64(1)) + shift, starts)
                sub = mixed(sub * _STEP + low)
            subs[full, part] = sub
    return counts, prints[0], prints[1], subs


def signatures(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (SIGNATURE): size and fingerprint of its set, sub-signatures."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for low, high in blocks(texts):
                counts, f1, f2, subs = _signatures(texts[low:high], shingle, seed)
                ends = np.arange(0, subs.size + 1, 2 * PARTS, dtype=np.int32)
                arrays = [
                    batch.column(0)[low:high], pa.array(counts.astype(np.int64)),
                    pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(subs.reshape(-1).view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "f1", "f2", "subs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(sign, SIGNATURE)


def _parity(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each set SKETCH numbers whose bits are the parities of its parts."""
    spread = mixed(values ^ np.uint64(SEED))
    part = (spread >> np.uint64(6)) % np.uint64(SKETCH)
    bit = np.uint64(1) << (spread & np.uint64(63))
    out = np.zeros((len(counts), SKETCH), dtype=np.uint64)
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(counts)), counts), part.astype(np.int64)), bit)
    return out


def full_sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``root, n, shingles, p0 ...`` of rows ``root, text``: the sets and their sketches."""
    names = [f"p{i}" for i in range(SKETCH)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = utf8(batch.column(1))
            for low, high in blocks(own):
                values, counts = shingle_sets(own[low:high], shingle)
                ends = np.zeros(len(counts) + 1, dtype=np.int32)
                np.cumsum(counts, out=ends[1:])
                sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))
                bits = _parity(values, counts).view(np.int64)
                arrays = [batch.column(0)[low:high], pa.array(counts.astype(np.int64)), sets]
                arrays += [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(SKETCH)]
                yield pa.RecordBatch.from_arrays(arrays, ["root", "n", "shingles", *names])

    schema = "root long, n long, shingles array<long>, " + ", ".join(f"{name} long" for name in names)
    return texts.select("root", "text").mapInArrow(make, schema)


def _sketch(sets: DataFrame, side: str) -> DataFrame:
    """``root, n`` and sketch under names that begin with ``side``."""
    columns = ["n", *[f"p{i}" for i in range(SKETCH)]]
    return sets.select(F.col("root").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])


def _possible(percent: int) -> Column:
    """Whether sets a and b may be similar, by their sizes and by the parities that differ."""
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    differ = F.lit(0)
    for i in range(SKETCH):
        differ = differ + F.bit_count(F.col(f"a_p{i}").bitwiseXOR(F.col(f"b_p{i}")))
    near = differ * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)
    return (small * 100 >= large * percent) & near


def table_keys(reps: DataFrame) -> DataFrame:
    """``key, root, n``: the tensored keys of ``root, n, subs``."""
    first = reps.select("root", "n", "subs", F.posexplode(F.slice("subs", 1, PARTS)).alias("i", "a"))
    both = first.select(
        "root", "n", "i", "a", F.posexplode(F.slice("subs", PARTS + 1, PARTS)).alias("j", "b")
    )
    return both.select(F.xxhash64("i", "j", "a", "b").alias("key"), "root", "n")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` whose full sets have the similarity."""
    left = sets.select(F.col("root").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("root").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    alike = both.select("a", "b", "na", "nb", common.alias("common")).where(
        F.col("common") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("common"))
    )
    return alike.select("a", "b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, label``: the smallest node reachable by edges ``a, b``, stored.

    Each round takes the smallest label of the neighbours and then that label's label,
    so long chains shrink quickly. Few edges are stored by few tasks: their files are
    small enough to be joined without a shuffle.
    """
    files = 2 * edges.count() // ROWS_PER_FILE + 1
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    both = materialize(both.distinct().coalesce(files), f"{name}_edges")
    lowest = both.groupBy("node").agg(F.least("node", F.min("other")).alias("label"))
    labels = materialize(lowest.coalesce(files), f"{name}_labels")
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        nearest = both.join(theirs, "other").groupBy("node").agg(F.min("near").alias("near"))
        lowered = labels.join(nearest, "node").select(
            "node", "label", F.least("label", "near").alias("lower")
        )
        jumps = labels.select(F.col("node").alias("lower"), F.col("label").alias("jump"))
        moved = lowered.join(jumps, "lower").select("node", F.col("label").alias("old"), F.least("lower", "jump").alias("label"))
        moved = materialize(moved.coalesce(files), f"{name}_labels")
        labels = moved.select("node", "label")
        if moved.where("label < old").isEmpty():
            return labels


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("node").alias("root"), F.col("label").alias("known"))
    joined = members.drop("label").join(named, "root", "left")
    return joined.withColumn("label", F.coalesce("known", "root")).drop("known")


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of keys that hold more than one component."""
    labelled = _labelled(members, labels)
    split = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return labelled.join(split.select("key"), "key", "left_semi")


def _ranked(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """The open members with their ranks in their keys, from 1, and sketches, stored for all rounds."""
    key = Window.partitionBy("key")
    ranked = _labelled(members, labels).select(
        "key", "root", "label", F.row_number().over(key.orderBy("root")).alias("rank"),
        F.min("label").over(key).alias("lo"), F.max("label").over(key).alias("hi"),
    )
    sketches = sets.select("root", "n", *[f"p{i}" for i in range(SKETCH)])
    return materialize(ranked.where("lo < hi").drop("lo", "hi").join(sketches, "root"), "open_members")


def _side(members: DataFrame, side: str) -> DataFrame:
    columns = ["label", "rank", "n", *[f"p{i}" for i in range(SKETCH)]]
    return members.select("key", F.col("root").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Sets of ``shingle``-word shingles with ``100 * common >= percent * union`` are
    linked; a component is what links reach, and its smallest ``doc_id`` is kept. Rows
    that share an id are one document, linked if any of its texts is. Null and empty
    texts and rows without an id are linked with nothing. Shorter texts than a shingle
    are one shingle. Extra columns are ignored; no rows give none.
    """
    signed = materialize(signatures(docs, shingle, seed), "signatures")
    able = signed.where("n > 0 AND doc_id IS NOT NULL")
    roots = able.groupBy("f1", "f2").agg(F.min("doc_id").alias("root"))
    tagged = signed.join(roots, ["f1", "f2"], "left").select(
        "doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("root")).alias("root"), "subs"
    )
    tagged = materialize(tagged, "tagged")
    reps = tagged.where("doc_id = root").select("root", "n", "subs").distinct()
    keys = table_keys(reps)
    shared = keys.groupBy("key").agg(F.min("root").alias("pivot"), F.max("root").alias("last"))
    shared = shared.where("pivot < last").select("key", "pivot")
    members = materialize(keys.join(shared, "key"), "members")
    needed = members.select("root").distinct().hint("shuffle_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("root"), "text").join(needed, "root", "left_semi")
    sets = materialize(full_sets(texts, shingle), "sets")
    # Copies of a document that has several texts link their classes.
    several = tagged.where("root IS NOT NULL AND doc_id > root").select(
        F.col("root").alias("a"), F.col("doc_id").alias("b")
    )
    pairs = members.where("root > pivot").select(F.col("pivot").alias("a"), F.col("root").alias("b"))
    paired = pairs.distinct().join(_sketch(sets, "a"), "a").join(_sketch(sets, "b"), "b").where(_possible(percent))
    done = materialize(paired.select("a", "b").distinct(), "pairs")
    several = several.join(members.select(F.col("root").alias("b")).distinct(), "b", "left_semi").select("a", "b")
    edges = materialize(confirmed(done, sets, percent).unionByName(several).distinct(), "links")
    labels = components(edges, "components")
    low, high = 0, FIRST_RANKS
    # Ranks and sketches do not change, and closed keys stay closed.
    open_ = _ranked(members.select("key", "root"), labels, sets)
    while True:
        largest = open_.agg(F.max("rank")).first()[0] or 0
        if largest - 1 <= low:
            break
        left = _side(open_.where((F.col("rank") > low) & (F.col("rank") <= high)), "a")
        apart = (F.col("a_label") != F.col("b_label")) & (F.col("b_rank") > F.col("a_rank")) & (F.col("a") != F.col("b"))
        # The sketches are part of the join, so pairs that cannot be similar are not made.
        met = left.withColumnRenamed("key", "k").join(
            _side(open_, "b"), (F.col("k") == F.col("key")) & apart & _possible(percent)
        )
        new = materialize(met.select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        links = materialize(confirmed(new, sets, percent), "links")
        done = done.unionByName(new)
        linked = not links.isEmpty()
        if linked:
            edges = edges.unionByName(links)
            labels = components(edges, "components")
        if largest - 1 <= high:
            break
        if linked:
            open_ = materialize(_open_members(open_, labels), "open_members")
        low, high = high, high * FIRST_RANKS
    return _result(tagged, labels)


def _result(tagged: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("node").alias("root"), "label")
    joined = tagged.join(named, "root", "left")
    # A document with several texts belongs to the component of any of them.
    component = F.coalesce("label", "root", "doc_id")
    rows = joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, but those of documents that are not kept."""
    found = near_duplicates(docs.select("doc_id", "text"), shingle, percent)
    gone = materialize(found.where("NOT kept").select("doc_id").distinct(), "not_kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    names = gone.select(F.col("doc_id").alias("gone")).hint("shuffle_hash")
    kept = rows.join(names, F.col("row.doc_id") == F.col("gone"), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=2)


OP8_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
        FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
    ) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * common >= 80 * (p.n + q.n - common)
), reach AS (
    SELECT doc_id AS node, doc_id AS label FROM words
    UNION SELECT b, label FROM reach JOIN links ON a = node
), components AS (
    SELECT node, min(label) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM words JOIN components ON node = doc_id LEFT JOIN sizes USING (doc_id)
"""
