"""The prefix trie of conversations, built as double arrays in shards.

A turn is the SHA-256 of its role and text with the length of the text, 40 bytes; a
conversation is its turns joined. Sorted by these bytes, the conversations below any
node of the trie are neighbours, so ranges of the sorted sequences are shards of equal
size whatever prefix, turn or conversation is common, and only nodes on the border of
two shards are shared. Conversations that are the same are one sequence before that.

A shard numbers its turns densely, spells the numbers in a few digits and packs the trie
into two arrays: the child of state s by digit c is t = BASE[s] + c if CHECK[t] = s. Few
digits keep sisters close, so the arrays stay within a bound whatever turns recur.
Sequences walk it to add up what a node holds. Shared nodes are merged over all shards and
get the sums of their subtrees by doubling jumps to their ancestors; what hangs below them
is final in its shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridtally.session import materialize

TURN = 40  # bytes of a turn: digest and length
# Turns of a shard, about; a single longer sequence is a shard's own.
SHARD_TURNS = 200_000
# Digits that spell the number of a turn; places before the end of a trie that are tried for sisters.
RADIX, WINDOW = 64, 256
# Ids that are joined to one piece before they are hashed.
PIECE = 4_096
# Long sequences may follow many short ones: pages are measured each 100 rows, not up to 10,000 later.
PAGES = {"parquet.page.size.row.check.max": "100"}
STEP, PREFIX = 5, 9
NOBODY = hashlib.sha256(b"").hexdigest()

NODES = (
    "shard long, node string, parent string, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends string, bytes long"
)


# --- sequences ---------------------------------------------------------------


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation as an array of 40-byte values.

    Turns stand by ``turn``, null first; turns of one number by their bytes. Rows without
    a ``conv_id`` belong to no conversation. Null roles and texts are empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    size = F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")
    value = F.unhex(F.concat(F.sha2(told, 256), size))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), value.alias("value")).alias("t")
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: x["value"]).alias("turns"))


def rebuilt(found: DataFrame, step: int = STEP, prefix: int = PREFIX) -> DataFrame:
    """Each conversation c begins with the first h turns of c - c % ``step``.

    h is the CRC-32 of the decimal id modulo ``prefix``. The conversation's own first h
    turns go; where c - c % step does not exist nothing takes their place.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(prefix)).cast("int")
    own = found.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % step).alias("base"))
    bases = found.where(F.col("conv_id") % step == 0).select(F.col("conv_id").alias("base"), F.col("turns").alias("first"))
    none = F.array().cast("array<binary>")
    lead = F.slice(F.coalesce("first", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(bases, "base", "left").select("conv_id", F.concat(lead, rest).alias("turns"))


def packed(turns: Column) -> Column:
    """The turns as one binary value, empty for none."""
    return F.coalesce(F.aggregate(turns, F.unhex(F.lit("")), lambda a, t: F.concat(a, t)), F.unhex(F.lit("")))


def ends_digests(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """``key, ends``: the SHA-256 of the decimal ids of each key, ascending, comma-joined.

    Rows are sorted by ranges of key and id, so a key of very many ids lies in many
    partitions; each joins its ids to pieces, and only pieces of one key meet.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = 0
        for batch in batches:
            changed = (batch.key != batch.key.shift()).to_numpy()
            places = np.arange(len(batch))
            starts = np.flatnonzero(changed | (places % piece == 0))
            ids = batch.conv_id.astype(str).to_numpy()
            ends = [*starts[1:], len(batch)]
            yield pd.DataFrame({
                "key": batch.key.to_numpy()[starts], "part": batch.part.to_numpy()[starts],
                "number": number + np.arange(len(starts)),
                "ids": [",".join(ids[a:b]) for a, b in zip(starts, ends)],
            })
            number += len(starts)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            for own, ids in zip(batch.key, batch.ids):
                if own == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = own, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["key", "ends"])
        if key is not None:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends"])

    ordered = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    numbered = ordered.select("key", "conv_id", F.spark_partition_id().alias("part"))
    joined = numbered.mapInPandas(pieces, "key string, part int, number long, ids string")
    met = joined.repartition("key").sortWithinPartitions("key", "part", "number")
    return met.mapInPandas(hashed, "key string, ends string")


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """``turns`` (packed), ``n, conv_id, ends`` per distinct sequence, stored."""
    keyed = materialize(
        conversations.select("conv_id", packed(F.col("turns")).alias("turns")).withColumn("key", F.sha2("turns", 256)),
        "keyed_conversations", **PAGES,
    )
    own = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")
    )
    return materialize(own.join(ends_digests(keyed.select("key", "conv_id")), "key").drop("key"), "distinct_sequences", **PAGES)


# --- a shard -----------------------------------------------------------------


class DoubleArray:
    """BASE and CHECK of a trie; state 0 is the root, symbols count from 1.

    Sisters take no more new places than from the first to the last of their symbols, and
    all other states fill free ones.
    """

    def __init__(self, size: int):
        self.base = np.zeros(max(2, size), dtype=np.int64)
        self.check = np.full(max(2, size), -1, dtype=np.int64)
        self.check[0] = 0
        self._free, self._end = 1, 1  # no free place before the first, none taken from the second on

    def _reach(self, place: int) -> None:
        if place >= len(self.base):
            grown = max(place + 1, len(self.base) * 3 // 2)
            self.base = np.concatenate([self.base, np.zeros(grown - len(self.base), dtype=np.int64)])
            self.check = np.concatenate([self.check, np.full(grown - len(self.check), -1, dtype=np.int64)])

    def add_only(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """States of children that have no sister: they fill free places, in one go."""
        far = self._free + 2 * len(parents)
        while True:
            self._reach(far)
            places = np.flatnonzero(self.check[self._free : far] < 0)[: len(parents)] + self._free
            if len(places) == len(parents):
                break
            far += far - self._free
        self.base[parents] = places - symbols
        self.check[places] = parents
        if len(places):
            self._free = int(places[-1]) + 1
            self._end = max(self._end, self._free)
        return places

    def add_sisters(self, parent: int, symbols: np.ndarray) -> np.ndarray:
        """States of the children of one state, near the end, at the first base where all places are free."""
        span, low = symbols - symbols[0], max(self._free, self._end - WINDOW)
        self._reach(self._end + int(span[-1]))
        tries = np.flatnonzero(self.check[low : self._end] < 0) + low
        fits = np.flatnonzero((self.check[tries[:, None] + span] < 0).all(axis=1))
        start = int(tries[fits[0]]) if len(fits) else self._end
        self.base[parent] = start - symbols[0]
        self.check[start + span] = parent
        self._end = max(self._end, start + int(span[-1]) + 1)
        return start + span

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of states by symbols; -1 where there is none."""
        to = self.base[states] + symbols
        inside = (to > 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == states) & (to > 0), to, -1)


def build(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """The double array of sequences that are sorted and distinct.

    Sequence i is ``symbols[starts[i] : starts[i] + lengths[i]]``. It grows level by level.
    """
    trie = DoubleArray(len(symbols) + 2)
    rows, states = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
    depth = 0
    while True:
        longer = lengths[rows] > depth
        rows, states = rows[longer], states[longer]
        if not len(rows):
            return trie
        own = symbols[starts[rows] + depth]
        # Rows of one state stand together, and in them the rows of one symbol.
        child = np.flatnonzero((np.diff(states, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))
        parents, letters = states[child], own[child]
        first = np.flatnonzero(np.diff(parents, prepend=-1) != 0)
        sisters = np.diff(np.append(first, len(parents)))
        to = np.empty(len(parents), dtype=np.int64)
        for low, count in zip(first[sisters > 1], sisters[sisters > 1]):
            # Places are taken in the order of symbols, whatever that of the bytes.
            order = np.argsort(letters[low : low + count])
            to[low + order] = trie.add_sisters(int(parents[low]), letters[low : low + count][order])
        single = first[sisters == 1]
        to[single] = trie.add_only(parents[single], letters[single])
        states = np.repeat(to, np.diff(np.append(child, len(rows))))
        depth += 1


def _common(a: bytes, b: bytes) -> int:
    """How many turns two sequences share from the start."""
    most = min(len(a), len(b)) // TURN
    x, y = (np.frombuffer(s[: most * TURN], dtype=np.uint8).reshape(most, TURN) for s in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else most


def shard_nodes(rows: pd.DataFrame, before: bytes | None, after: bytes | None) -> pd.DataFrame:
    """The nodes of one shard (NODES): ``rows`` sorted by ``turns``, with its neighbours.

    Nodes shared with a neighbour, and the root, have their key in ``node`` and that of
    their parent in ``parent``, and hold what hangs below them in this shard outside of
    other shared nodes. Of the others ``node`` is null, and ``parent`` is the key of a
    shared parent, else null.
    """
    packs = rows.turns.tolist()
    lengths = np.array([len(p) // TURN for p in packs], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    values = np.frombuffer(b"".join(packs), dtype=np.dtype((np.void, TURN)))
    letters, symbols = np.unique(values, return_inverse=True) if len(values) else (values, np.zeros(0, np.int64))
    raw = np.frombuffer(letters.tobytes(), dtype=np.uint8).reshape(-1, TURN)
    sizes = np.ascontiguousarray(raw[:, 32:]).view(">i8").reshape(-1).astype(np.int64)
    symbols, digits = symbols.reshape(-1), 1
    while RADIX**digits < len(letters):
        digits += 1
    # Numbers stand in the order of the bytes, so rows that share digits stand together.
    spelled = np.stack([symbols // RADIX**d % RADIX + 1 for d in reversed(range(digits))], axis=-1).reshape(-1)
    trie = build(spelled, starts * digits, lengths * digits)

    # Nodes are numbered level by level, and in a level in the order of the rows.
    count, ids, last = rows.n.to_numpy(), rows.conv_id.to_numpy(), rows.ends.to_numpy()
    at, states, own, depth, total = np.arange(len(rows)), *np.zeros((2, len(rows)), dtype=np.int64), 0, 0
    levels, parts = [], []
    while len(at):
        first = np.flatnonzero(np.diff(states, prepend=-1) != 0)
        above = own[first]
        own = total + np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
        ends = np.full(len(first), NOBODY, dtype=object)
        over = lengths[at] == depth
        ends[own[over] - total] = last[at[over]]
        told = sizes[symbols[starts[at[first]] + depth - 1]] if depth else np.zeros(1, np.int64)
        parts.append((
            above, np.full(len(first), depth), np.add.reduceat(count[at], first), np.minimum.reduceat(ids[at], first),
            told, ends,
        ))
        levels.append(slice(total, total + len(first)))
        total += len(first)
        at, states, own = at[~over], states[~over], own[~over]
        for digit in range(digits):
            states = trie.step(states, spelled[(starts[at] + depth) * digits + digit])
        depth += 1
    above, depths, convs, least, own_bytes, ends = (np.concatenate(x) for x in zip(*parts))

    # Keys of the nodes on the border: prefixes of the first and of the last sequence,
    # which are the first and the last node of each level that they reach.
    keys = np.full(total, None, dtype=object)
    for row, other in ((0, before), (len(rows) - 1, after)):
        shared = _common(packs[row], other) if other is not None else 0
        digest = hashlib.sha256()
        keys[0] = digest.hexdigest()
        for d in range(shared):
            digest.update(packs[row][d * TURN : (d + 1) * TURN])
            keys[levels[d + 1].stop - 1 if row else levels[d + 1].start] = digest.hexdigest()

    shared = np.array([k is not None for k in keys])
    children, leaves, saved = (np.zeros(total, np.int64) for _ in range(3))
    for level in reversed(levels):
        closed = ~shared[level]
        # A shared node may have children elsewhere, so it is no leaf here.
        leaves[level] += closed & (children[level] == 0)
        saved[level] += closed * (convs[level] - 1) * own_bytes[level]
        up = above[level][closed]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[level][closed])
        np.add.at(saved, up, saved[level][closed])
    root = np.arange(total) == 0
    return pd.DataFrame({
        "shard": rows.shard.iloc[0], "node": keys, "parent": np.where(root, None, keys[above]),
        "depth": depths, "conv_id": least, "parent_conv_id": least[above],
        "n_convs": convs, "n_children": children, "n_leaves": leaves,
        "saved_tokens": saved, "ends": ends, "bytes": own_bytes,
    })


# --- all shards --------------------------------------------------------------


def _merged(border: DataFrame) -> DataFrame:
    """The shared nodes, one row each, with the sums of their subtrees, stored.

    ``border`` has the rows of shared nodes of all shards. Sums travel up by jumps that
    double, so their number grows with the logarithm of the depth.
    """
    own = border.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inside"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.first("bytes").alias("bytes"),
        F.coalesce(F.min(F.when(F.col("ends") != NOBODY, F.col("ends"))), F.lit(NOBODY)).alias("ends"),
    )
    own = materialize(own, "shared_nodes")
    outside = own.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("outside"))
    children = F.col("inside") + F.coalesce("outside", F.lit(0))
    full = own.join(outside, "node", "left").withColumn("n_children", children)
    saved = F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")
    full = full.withColumn("saved", saved).withColumn("leaves", F.col("leaves") + F.when(children == 0, 1).otherwise(0))
    full = materialize(full.withColumn("up", F.col("parent")), "shared_sums")
    deepest, jump = full.agg(F.max("depth").alias("d")).first()["d"] or 0, 1
    while jump <= deepest:
        sums = full.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("node")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        jumps = full.where(F.col("up").isNotNull()).select(F.col("node").alias("up"), F.col("up").alias("next"))
        full = full.join(sums, "node", "left").join(jumps, "up", "left").select(
            *[c for c in full.columns if c not in ("leaves", "saved", "up")], F.col("next").alias("up"),
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        full, jump = materialize(full, "shared_sums"), jump * 2
    return full


def sharded(found: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``found`` with ``shard``, stored: ranges of ``turns`` that ascend with it.

    Ranges hold even numbers of sequences, and are cut where these have more turns than a
    shard takes; a shard passes that number by less than the turns of its first sequence.
    """
    most = TURN * shard_turns
    size = found.agg(F.sum(F.octet_length("turns")).alias("bytes")).first()["bytes"] or 0
    # A third more, so that few ranges are cut.
    ranges = max(-(-size * 4 // (most * 3)), found.sparkSession.sparkContext.defaultParallelism)
    ordered = found.repartitionByRange(ranges, "turns").withColumn("range", F.spark_partition_id().cast("long"))
    line = Window.partitionBy("range").orderBy("turns").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = F.greatest(F.sum(F.octet_length("turns")).over(line), F.lit(1))
    part = F.floor((so_far - 1) / most)
    return materialize(ordered.withColumn("shard", F.shiftleft("range", 32) + part).drop("range"), "shards", **PAGES)


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per node of the trie of ``conv_id, turns`` (see ``sequences``).

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``; ``conv_id`` and ``depth`` name a node. Conversations without
    turns end at the root. No conversations give no nodes, not even a root. The turns
    of one conversation, 40 bytes each, are one value and meet in one task.
    """
    ordered = sharded(distinct_sequences(conversations), shard_turns)
    # A row per shard.
    span = ordered.groupBy("shard").agg(F.min("turns").alias("first"), F.max("turns").alias("last"))
    line = Window.orderBy("shard")
    borders = span.select("shard", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"))

    def nodes(rows: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in NODES.split(", ")])
        order = sorted(range(len(rows)), key=rows.turns.tolist().__getitem__)
        return shard_nodes(rows.iloc[order], border.before.iloc[0], border.after.iloc[0])

    every = ordered.groupBy("shard").cogroup(borders.groupBy("shard")).applyInPandas(nodes, NODES)
    every = materialize(every, "shard_nodes")
    border = every.where(F.col("node").isNotNull())
    shared = _merged(border)
    # Per shard, so that a node with very many children is no hot key.
    mins = border.select("shard", "node").join(shared.select("node", "conv_id"), "node")
    mins = mins.select("shard", F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    inner = every.where(F.col("node").isNull()).drop("node").join(mins, ["shard", "parent"], "left").select(
        "conv_id", "depth", F.coalesce("above", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"),
    )
    ups = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    outer = shared.join(ups, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    return inner.unionByName(outer)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prefix_trie`` of the whole of ``conversations``, rebuilt."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(rebuilt(materialize(sequences(turns), "conversation_turns", **PAGES)))


OP13_SQL = r"""
WITH own AS (
    SELECT conv_id, list({r: coalesce(role, ''), t: coalesce(text, '')} ORDER BY turn NULLS FIRST,
        sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
               lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h
    FROM own
), rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
    FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
), places AS (
    SELECT conv_id, turns[1:d] AS path, d AS depth, len(turns) = d AS ends
    FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
           CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(path[depth].t) END AS saved
    FROM places GROUP BY path, depth
), children AS (
    SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path
), sums AS (
    SELECT path[1:d] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""
