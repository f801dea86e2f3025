"""Chat formatting of reply trees.

Messages name their parent. Root-to-leaf paths are enumerated by self-joins that double
their reach, branches are ranked by score, and every chosen path becomes one
conversation in a template whose marks cannot occur inside a text: a control string in
a text gets one backslash after its first character, which reading takes away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridtally.session import materialize

# Control strings: turns of users, of systems, of other roles, and the end of a turn.
USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
SYSTEM_OPEN, SYSTEM_CLOSE = "<<SYS>>", "<</SYS>>"
ROLE_OPEN, ROLE_CLOSE, ROLE_END = "<|role|>", "<|text|>", "<|end|>"
START, END = "<s>", "</s>"
_CONTROL = r"([\[<])(\\*)(/?INST\]|/?s>|<SYS>>|</SYS>>|\|(?:role|text|end)\|>)"
_ESCAPED = re.compile(r"([\[<]\\*)\\(/?INST\]|/?s>|<SYS>>|</SYS>>|\|(?:role|text|end)\|>)")
_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>"
    r"|<\|role\|>(?P<role>.*?)<\|text\|>(?P<text>.*?)<\|end\|>|(?P<assistant>.*?)</s>",
    re.DOTALL,
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def paths(messages: DataFrame, tree: str = "tree_id", node: str = "node", parent: str = "parent") -> DataFrame:
    """``(tree_id, leaf, node, up)`` for every node on the way from a leaf to its root.

    ``up`` is the distance to the leaf. Round k joins what is known with the ancestors
    at distance 2^k, so paths of length n take log2(n) rounds; each round is stored. A
    message whose parent is absent counts as a root. Messages that answer each other in
    a circle, and all that answer these, lead to no root and are left out: a walk longer
    than its tree has messages is one of them, so rounds end there.
    """
    nodes = messages.select(F.col(tree).alias("tree_id"), F.col(node).alias("node"), F.col(parent).alias("parent"))
    links = nodes.where("parent IS NOT NULL")
    known = nodes.select("tree_id", F.col("node").alias("parent"))
    up = links.join(known, _same("tree_id", "parent", links, known), "left_semi")
    ancestors = materialize(up.select("tree_id", "node", F.col("parent").alias("anc")), "ancestors_0")
    parents = ancestors.select("tree_id", F.col("anc").alias("node")).distinct()
    leaves = nodes.join(parents, _same("tree_id", "node", nodes, parents), "left_anti")
    found = materialize(
        leaves.select("tree_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths_0"
    )
    step, total = 1, found.count()
    # A row per tree, of which the driver gets the largest number.
    most = nodes.groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    while True:
        a = ancestors.select(F.col("tree_id").alias("t"), F.col("node").alias("n"), "anc")
        higher = found.join(a, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        higher = higher.select("tree_id", "leaf", F.col("anc").alias("node"), (F.col("up") + step).alias("up"))
        found = materialize(found.unionByName(higher), f"paths_{step}")
        step, before, total = step * 2, total, found.count()
        if total == before:
            return found
        if step > most:
            endless = found.where(F.col("up") >= most).select("tree_id", "leaf").distinct()
            return found.join(endless, _same("tree_id", "leaf", found, endless), "left_anti")
        b = ancestors.select(F.col("tree_id").alias("t"), F.col("node").alias("n"), F.col("anc").alias("higher"))
        twice = ancestors.join(b, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("anc") == F.col("n")))
        ancestors = materialize(twice.select("tree_id", "node", F.col("higher").alias("anc")), f"ancestors_{step}")


def _same(tree: str, node: str, left: DataFrame, right: DataFrame) -> Column:
    return left[tree].eqNullSafe(right[tree]) & (left[node] == right[node])


def ranked_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Turns of the chosen paths: ``tree_id, path, turn, role, text``.

    ``messages`` has ``tree_id, node, parent, role, text, score``. Branches of a tree
    are ranked by the sum of the scores on the path (null: 0), the longer and then the
    smaller leaf first; ``best`` paths of each tree are kept, None for all. ``path``
    counts from 0, ``turn`` from 0 at the root. Cyclic messages belong to no path.
    """
    rows = materialize(
        messages.select(
            "tree_id", "node", "parent", F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"),
        ),
        "messages",
    )
    walked = paths(rows)
    t = rows.select(F.col("tree_id").alias("t"), F.col("node").alias("n"), "role", "text", "score")
    full = walked.join(t, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    # One row per leaf; a tree's leaves are ranked together.
    branches = full.groupBy("tree_id", "leaf").agg(
        F.sum("score").alias("total"), F.max("up").alias("depth")
    )
    order = Window.partitionBy("tree_id").orderBy(F.desc("total"), F.desc("depth"), "leaf")
    chosen = branches.withColumn("path", F.row_number().over(order) - 1)
    if best is not None:
        chosen = chosen.where(F.col("path") < best)
    chosen = chosen.select(F.col("tree_id").alias("c"), F.col("leaf").alias("l"), "depth", "path")
    kept = full.join(chosen, F.col("tree_id").eqNullSafe(F.col("c")) & (F.col("leaf") == F.col("l")))
    return kept.select("tree_id", "path", (F.col("depth") - F.col("up")).alias("turn"), "role", "text")


def format_paths(turns: DataFrame) -> DataFrame:
    """``tree_id, path, n_turns, formatted, loss``: one conversation per path.

    ``loss`` lists ``(start, end)`` in code points of ``formatted``, one span for each
    assistant text as escaped. A path is one row, so its texts meet in one task.
    """
    safe = escape(F.col("text"))
    head = (
        F.when(F.col("role") == "user", USER_OPEN).when(F.col("role") == "system", SYSTEM_OPEN)
        .when(F.col("role") == "assistant", "")
        .otherwise(F.concat(F.lit(ROLE_OPEN), escape(F.col("role")), F.lit(ROLE_CLOSE)))
    )
    tail = (
        F.when(F.col("role") == "user", USER_CLOSE).when(F.col("role") == "system", SYSTEM_CLOSE)
        .when(F.col("role") == "assistant", END).otherwise(ROLE_END)
    )
    parts = turns.select(
        "tree_id", "path", "turn", head.alias("head"), safe.alias("safe"), tail.alias("tail"),
        (F.col("role") == "assistant").alias("trained"),
    )
    # Where a turn begins is a running sum, so that long conversations take linear time.
    before = Window.partitionBy("tree_id", "path").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("head") + F.length("safe") + F.length("tail")
    begin = (F.coalesce(F.sum(length).over(before), F.lit(0)) + len(START) + F.length("head")).cast("int")
    marked = parts.withColumn("start", begin).select(
        "tree_id", "path",
        F.struct(
            "turn", F.concat("head", "safe", "tail").alias("piece"), "trained",
            F.struct("start", (F.col("start") + F.length("safe")).cast("int").alias("end")).alias("span"),
        ).alias("t"),
    )
    grouped = marked.groupBy("tree_id", "path").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    learnt = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: t["span"])
    return grouped.select(
        "tree_id", "path", F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.lit(START), F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("formatted"),
        learnt.alias("loss"),
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` turns of a formatted conversation."""
    turns, at = [], len(START)
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None or found.end() == at:
            raise ValueError(f"no turn at {at}")
        for role in ("user", "system", "assistant"):
            if found[role] is not None:
                turns.append((role, unescape(found[role])))
        if found["role"] is not None:
            turns.append((unescape(found["role"]), unescape(found["text"])))
        at = found.end()
    return turns


def read_back(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations say: turns and the text under the loss mask."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tree, path, text, spans in zip(batch.tree_id, batch.path, batch.formatted, batch.loss):
                turns = parse(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((
                    tree, path, len(turns), hashlib.sha256(whole.encode()).hexdigest(),
                    len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text),
                ))
            out = pd.DataFrame(rows, columns=[name for name, _ in fields])
            yield out.astype({"tree_id": "Int64"} if kind == "long" else {})

    kind = "long" if dict(conversations.dtypes)["tree_id"] == "bigint" else dict(conversations.dtypes)["tree_id"]
    fields = [
        ("tree_id", kind), ("path", "long"), ("n_turns", "long"), ("turns_sha256", "string"),
        ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long"),
    ]
    schema = ", ".join(f"{name} {type_}" for name, type_ in fields)
    path = F.col("path").cast("long").alias("path")
    return conversations.select("tree_id", path, "formatted", "loss").mapInPandas(read, schema)


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees: each row answers the one before it by ``turn``.

    Rows of one conversation and turn follow in order of role and text. Null roles and
    texts are empty; a null ``conv_id`` is a conversation of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order)
    return conversations.select(
        F.col("conv_id").alias("tree_id"), place.cast("long").alias("node"),
        F.when(place > 1, place - 1).cast("long").alias("parent"), "role", "text",
        F.lit(0.0).alias("score"),
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = END + "[INST] ok [/INST]"
    extra = spark.sql(
        "SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(id AS BIGINT) AS turn, "
        f"IF(id = 0, 'user', 'assistant') AS role, '{said}' AS text FROM range(2)"
    )
    conversations = table.unionByName(extra)
    formatted = format_paths(ranked_paths(chains(conversations)))
    return read_back(formatted).drop("path").withColumnRenamed("tree_id", "conv_id")


OP4_SQL = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS safe,
           CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4
                ELSE 23 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END AS marks
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(safe + marks) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
