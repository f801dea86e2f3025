"""Benchmark decontamination by a positional inverted index.

The postings of all benchmark terms in all documents are stored once. For each
window of a benchmark item the lists of its rarest terms, shifted by their offsets,
are intersected; what is left is compared word by word with the documents. Only
DataFrame functions are used. Documents are told apart by id and a hash of the text,
so rows that repeat both are one document and get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridtally.llm.common import PLAIN_WORD, PUNCTUATION, ascii_lower, word_count
from gridtally.session import materialize

WINDOW = 10
PROBES = 2


def _raw_words(text: Column) -> Column:
    return F.array_remove(F.split(text, PUNCTUATION), "")


def words(text: Column) -> Column:
    """The words of a text with A to Z lower-cased; null for null."""
    return F.transform(_raw_words(text), ascii_lower)


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(wid, words)`` for the distinct windows and ``(wid, item_id)`` for their use.

    An item with fewer words than ``window``, but not none, is one window.
    """
    listed = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    cut = listed.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("start")).select(
        "item_id", F.slice("words", F.col("start") + 1, window).alias("words")
    )
    cut = materialize(cut.distinct(), "item_windows")
    distinct = cut.select("words").distinct().withColumn("wid", F.monotonically_increasing_id())
    windows = materialize(distinct, "windows")
    return windows, cut.join(windows, "words").select("wid", "item_id")


def window_terms(windows: DataFrame) -> DataFrame:
    return windows.select("wid", F.posexplode("words").alias("offset", "word"))


def build_index(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored vocabulary ``(word, term)`` and postings ``(doc_id, h, pos, term)``.

    Positions count the words of a document from 0.
    """
    vocabulary = terms.select("word").distinct().withColumn("term", F.monotonically_increasing_id())
    vocabulary = materialize(vocabulary, "vocabulary")
    placed = docs.select(
        "doc_id", F.xxhash64("text").alias("h"), F.posexplode(_raw_words(F.col("text"))).alias("pos", "word")
    )
    lowered = placed.select("doc_id", "h", "pos", ascii_lower(F.col("word")).alias("word"))
    postings = lowered.join(vocabulary, "word").select("doc_id", "h", "pos", "term")
    return vocabulary, materialize(postings, "postings")


def rarest_probes(windows: DataFrame, vocabulary: DataFrame, postings: DataFrame, most: int = PROBES) -> DataFrame:
    """``(wid, probes, rank, term, offset)``, stored: up to ``most`` places of each window, rarest first.

    Windows with a word that no document has cannot occur and are left out.
    """
    counts = postings.groupBy("term").agg(F.count("*").alias("n"))
    known = window_terms(windows).join(vocabulary, "word").join(counts, "term", "left")
    place = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")
    # A window has as many rows as words.
    ranked = known.groupBy("wid").agg(F.sort_array(F.collect_list(place)).alias("places"))
    possible = ranked.where(F.col("places")[0]["n"] > 0)
    chosen = possible.select("wid", F.slice("places", 1, most).alias("places"))
    listed = chosen.select(
        "wid", F.size("places").alias("probes"), F.posexplode("places").alias("rank", "place")
    )
    return materialize(listed.select("wid", "probes", "rank", "place.term", "place.offset"), "probes")


def short_lists(postings: DataFrame, probes: DataFrame) -> DataFrame:
    """The postings of the terms that are probes, stored."""
    return materialize(postings.join(probes.select("term").distinct(), "term", "left_semi"), "short_lists")


def phrase_candidates(lists: DataFrame, probes: DataFrame) -> DataFrame:
    """Starts at which all probes of a window stand at their offsets.

    The list of the rarest term, shifted by its offset, is intersected with that of
    the next one, and so on.
    """
    led = lists.join(probes.where("rank = 0"), "term").select(
        "doc_id", "h", "wid", "probes", (F.col("pos") - F.col("offset")).alias("start")
    ).where("start >= 0")
    most = probes.agg(F.max("rank")).first()[0] or 0
    for rank in range(1, most + 1):
        step = probes.where(F.col("rank") == rank).select(F.col("wid").alias("w"), "term", "offset")
        expected = led.join(step, F.col("wid") == F.col("w")).withColumn("pos", F.col("start") + F.col("offset"))
        of_rank = lists.join(step.select("term").distinct(), "term", "left_semi").select(
            F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("term").alias("t"), F.col("pos").alias("p")
        )
        there = expected.join(
            of_rank,
            F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
            & (F.col("pos") == F.col("p")) & (F.col("term") == F.col("t")),
            "left_semi",
        )
        led = there.select("doc_id", "h", "wid", "probes", "start").unionByName(
            led.where(F.col("probes") <= rank)
        )
    return led.select("doc_id", "h", "wid", "start").distinct()


def proximity_candidates(lists: DataFrame, probes: DataFrame, span: int) -> DataFrame:
    """``(doc_id, h, wid, pos)``: places of a window's rarest term that have each of its
    next rarest ones at most some ``span`` words away.

    Places fall into blocks of ``span`` words; what is near lies in the same block or in
    one beside it, so lists are intersected by block instead of by place.
    """
    block = F.floor(F.col("pos") / span)
    led = lists.join(probes.where("rank = 0"), "term").select("doc_id", "h", "wid", "probes", "pos").distinct()
    most = probes.agg(F.max("rank")).first()[0] or 0
    for rank in range(1, most + 1):
        step = probes.where(F.col("rank") == rank).select(F.col("wid").alias("w"), "term")
        expected = led.join(step, F.col("wid") == F.col("w")).withColumn(
            "block", F.explode(F.array(block - 1, block, block + 1))
        )
        of_rank = lists.join(step.select("term").distinct(), "term", "left_semi").select(
            F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("term").alias("t"), block.alias("b")
        )
        there = expected.join(
            of_rank.distinct(),
            F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
            & (F.col("block") == F.col("b")) & (F.col("term") == F.col("t")),
            "left_semi",
        )
        # A place may be near in two blocks.
        led = there.select("doc_id", "h", "wid", "probes", "pos").distinct().unionByName(
            led.where(F.col("probes") <= rank)
        )
    return led.select("doc_id", "h", "wid", "pos")


def proximity_matches(docs: DataFrame, windows: DataFrame, span: int = 2 * WINDOW) -> DataFrame:
    """``(doc_id, h, wid, pos)``: places of a window's rarest term that lie in ``span``
    consecutive words which hold every word of the window.

    Order and further words between them do not matter, and a word that a window repeats
    needs to stand there once. Candidates come from the index, rarest terms first; what is
    left is compared with the words around it. Every exact occurrence is one of these
    matches, if ``span`` is not below the window.
    """
    vocabulary, postings = build_index(docs, window_terms(windows))
    probes = rarest_probes(windows, vocabulary, postings)
    lists = short_lists(postings, probes)
    candidates = materialize(proximity_candidates(lists, probes, span), "proximity_candidates")
    named = candidates.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "wid", "pos")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    # The list of texts with a candidate grows with the input, so it is never broadcast.
    wanted = named.select("d", "g").distinct().hint("shuffle_hash")
    texts = keyed.join(wanted, same, "left_semi").dropDuplicates(["doc_id", "h"])
    listed = materialize(texts.select("doc_id", "h", words(F.col("text")).alias("doc_words")), "candidate_texts")
    first = F.greatest(F.col("pos") - (span - 1), F.lit(0))
    # Words from ``span - 1`` before the place to as many after it; the text ends here.
    around = F.slice("doc_words", first + 1, F.col("pos") - first + span).alias("around")
    cut = listed.join(named, same).select("doc_id", "h", "wid", "pos", around)
    whole = cut.join(windows, "wid").where(F.size(F.array_except("words", "around")) == 0)

    def holds_all(start: Column) -> Column:
        return F.size(F.array_except(F.col("words"), F.slice(F.col("around"), start, span))) == 0

    starts = F.sequence(F.lit(1), F.greatest(F.size("around") - (span - 1), F.lit(1)))
    return whole.where(F.exists(starts, holds_all)).select("doc_id", "h", "wid", "pos")


def phrase_matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``(doc_id, h, wid, start, length)``: every occurrence of a window, exactly."""
    vocabulary, postings = build_index(docs, window_terms(windows))
    probes = rarest_probes(windows, vocabulary, postings)
    lists = short_lists(postings, probes)
    candidates = materialize(phrase_candidates(lists, probes), "phrase_candidates")
    named = candidates.select(
        F.col("doc_id").alias("d"), F.col("h").alias("g"), "wid", "start"
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    # Only texts with a candidate are cut into words again.
    # The list of such texts grows with the input, so it is never broadcast.
    wanted = named.select("d", "g").distinct().hint("shuffle_hash")
    texts = keyed.join(wanted, same, "left_semi").dropDuplicates(["doc_id", "h"])
    listed = materialize(texts.select("doc_id", "h", words(F.col("text")).alias("doc_words")), "candidate_texts")
    checked = listed.join(named, same).join(windows, "wid")
    size = F.size("words")
    exact = checked.where(F.slice("doc_words", F.col("start") + 1, size) == F.col("words"))
    return exact.select("doc_id", "h", "wid", "start", size.alias("length"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, h, n_words, n_hit, n_items, items_sha256,
    contaminated``.

    A word inside any occurrence of a window is hit. Null and empty texts have no
    words. Items without an id make hits but are not counted; items that share an id
    count once. No items or no documents give no hits.
    """
    windows, uses = item_windows(items, window)
    found = materialize(phrase_matches(docs, windows), "phrase_matches")
    end = F.col("start") + F.col("length") - 1
    hit = found.select("doc_id", "h", F.explode(F.sequence("start", end)).alias("pos")).distinct()
    hits = hit.groupBy("doc_id", "h").agg(F.count("*").alias("n_hit"))
    used = found.join(uses, "wid").select("doc_id", "h", F.col("item_id").cast("string").alias("item")).distinct()
    # At most as many entries as there are items.
    listed = used.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("item")).alias("items"))
    def renamed(df: DataFrame, d: str, g: str) -> DataFrame:
        return df.withColumnsRenamed({"doc_id": d, "h": g})
    base = docs.select(
        "doc_id", F.xxhash64("text").alias("h"), word_count(F.col("text"), PLAIN_WORD).alias("n_words")
    )
    def same(d: str, g: str) -> Column:
        return F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("h") == F.col(g))
    joined = base.join(renamed(hits, "d1", "g1"), same("d1", "g1"), "left")
    joined = joined.join(renamed(listed, "d2", "g2"), same("d2", "g2"), "left")
    no_items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        "doc_id", "h", "n_words", n_hit.alias("n_hit"),
        F.size(no_items).cast("long").alias("n_items"),
        F.sha2(F.array_join(no_items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def near_passages(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, span: int = 2 * WINDOW
) -> DataFrame:
    """``(doc_id, h, item_id)``, distinct: items of which ``span`` consecutive words of a
    document hold all words of a window, in any order and with others between them.

    Rows of ``docs`` that repeat id and text are one document, ``h`` is the hash of its
    text. Null and empty texts have no words and match nothing; items without an id are
    left out.
    """
    windows, uses = item_windows(items, window)
    found = materialize(proximity_matches(docs, windows, span), "proximity_matches")
    matched = found.select("doc_id", "h", "wid").distinct().join(uses.where("item_id IS NOT NULL"), "wid")
    return matched.select("doc_id", "h", "item_id").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of an item occurs."""
    columns = docs.columns
    windows, _ = item_windows(items, window)
    found = phrase_matches(docs.select("doc_id", "text"), windows)
    bad = materialize(found.select("doc_id", "h").distinct(), "contaminated")
    rows = docs.select(F.struct(*columns).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("h"))
    kept = rows.join(bad, same, "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in columns])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items).drop("h")


_DUCK_WORDS = r"""regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP9_SQL = rf"""
WITH docs AS (SELECT doc_id, {_DUCK_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_DUCK_WORDS} AS w FROM benchmark),
item_windows AS (
    SELECT item_id, array_to_string(w[i:i + 9], ' ') AS phrase, least(len(w), 10) AS n
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
),
found AS (
    SELECT d.doc_id, d.i, d.n, b.item_id FROM doc_windows d JOIN item_windows b USING (phrase, n)
),
hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found))
    GROUP BY doc_id
),
listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
