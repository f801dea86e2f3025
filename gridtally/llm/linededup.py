"""Line de-duplication as an exact set-similarity join.

A line is the set of its lower-cased words. Words are ordered by rarity, counted over
all lines; two lines of Jaccard similarity PERCENT share a word among the first few of
both, which makes an inverted index of these prefixes complete. Length and positional
filters drop pairs that cannot reach the similarity, the rest is verified on the words.
A line goes if an earlier line (by doc_id, null last, then place, then a hash of the
text) is similar, whether that one stays or not. Only DataFrame functions are used.

Parity bits of the words bound the difference of two lines from below, four times as many
in long lines, so that the words of few pairs only are fetched: the numbers of the wanted lines meet the texts once a
round, and only these lines are cut out.

Equal sets are one class from the start. Each class is compared with the earliest one
of each prefix word first; only classes without a match so far are compared with all
earlier ones, so a large group of similar lines costs a pair per line and word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridtally.llm.common import forget, written
from gridtally.session import materialize

PERCENT = 80
# Words are counted in this many buckets; words of a frequent bucket count as frequent.
BUCKETS = 1 << 18
# Levels of rarity for each doubling of a bucket's words; the key has 6 bits for them.
STEPS = 2
MOST = 63
_LEVEL_BITS = 57
# Parity bits are chosen by the bits of a word's hash that its bucket does not use.
_PARITY_SHIFT = 24
# Lines of more words set most of 64 parity bits whatever the words; they carry 256.
LONG = 80
_WIDE = ("s0", "s1", "s2")
_ENTRY = ("c", "n", "bits", *_WIDE, "i")
_LAST = 9223372036854775807
_PLACE = ("doc_id", "h", "line_no", "at")


def _parts(line: Column) -> Column:
    """The lower-cased words of a line, and empty ones where white space stands together."""
    low = F.lower(line)
    odd = low.rlike(r"[\x09-\x0D]")
    return F.when(odd, F.split(low, r"[\x20\x09-\x0D]+")).otherwise(F.split(low, " "))


def word_numbers(line: Column) -> Column:
    """64 bits for each lower-cased word of a line, without repeats; words are what white space parts."""
    # Numbers are told apart faster than words, and are shorter.
    numbers = F.array_distinct(F.transform(_parts(line), lambda word: F.xxhash64(word)))
    return F.array_except(numbers, F.array(F.xxhash64(F.lit(""))))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, h, line_no, at, line``: the lines of all texts, from 0, with their order.

    ``h`` tells texts of one id apart; ``at`` orders lines by doc_id (null last) and
    place. Only both together are one line: rows without an id share their ``at``.
    """
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    )
    first = F.coalesce("doc_id", F.lit(_LAST)).cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)")
    at = (first + F.col("line_no")).cast("decimal(31,0)")
    return lines.select("doc_id", "h", "line_no", at.alias("at"), "line")


def _bucket(number: Column) -> Column:
    return number.bitwiseAND(BUCKETS - 1).cast("int")


def rarity_levels(docs: DataFrame) -> bytes:
    """The level of each bucket, a byte for each: the driver gets BUCKETS small rows at most."""
    # Split at one character: a pattern of two takes a third more time.
    word = F.explode(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " ")).alias("word")
    counts = docs.select(word).groupBy(_bucket(F.xxhash64("word")).alias("bucket")).agg(F.count("*").alias("n"))
    level = F.least(F.floor(F.log2("n") * STEPS), F.lit(MOST)).cast("int")
    levels = bytearray(BUCKETS)
    for bucket, found in counts.select("bucket", level).collect():
        levels[bucket] = found
    return bytes(levels)


def rarity_keys(line: Column, levels: bytes) -> Column:
    """The words of a line as numbers that sort from rare to frequent, equal for equal words."""
    table = F.lit(levels)

    def key(number: Column) -> Column:
        # All levels are ASCII, so each is a character.
        level = F.ascii(F.substring(table, _bucket(number) + 1, F.lit(1)).cast("string"))
        low = number.bitwiseAND((1 << _LEVEL_BITS) - 1)
        return F.shiftleft(level.cast("long"), _LEVEL_BITS) + low

    return F.sort_array(F.transform(word_numbers(line), key))


def parity_bits(keys: Column) -> Column:
    """64 bits, each the parity of how many keys fall to it."""

    def bit(key: Column) -> Column:
        place = F.shiftright(key, _PARITY_SHIFT).bitwiseAND(63).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return F.aggregate(keys, F.lit(0).cast("long"), lambda found, key: found.bitwiseXOR(bit(key)))


def _apart(x: str, y: str) -> Column:
    """At most the number of words that only one of two lines has: the odd bits."""
    return F.bit_count(F.col(f"{x}bits").bitwiseXOR(F.col(f"{y}bits")))


def _wide_apart(x: str, y: str) -> Column:
    """The same by 256 bits, of which ``bits`` is the sum; null unless both lines are long."""
    last, found = F.col(f"{x}bits").bitwiseXOR(F.col(f"{y}bits")), F.lit(0)
    for name in _WIDE:
        odd = F.col(f"{x}{name}").bitwiseXOR(F.col(f"{y}{name}"))
        last, found = last.bitwiseXOR(odd), found + F.bit_count(odd)
    return found + F.bit_count(last)


def _prefix(percent: int) -> Column:
    """How many of ``n`` keys must be indexed: two similar lines share one of theirs."""
    return F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1


def indexed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All lines with words: place, fingerprint ``h1, h2``, size ``n``, bits and prefix."""
    levels = rarity_levels(docs)
    # By its characters: asking for the number of words would cut the line once more.
    lines = numbered_lines(docs).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    ranked = lines.select(*_PLACE, rarity_keys(F.col("line"), levels).alias("keys"))
    marked = ranked.select(
        *_PLACE, F.size("keys").alias("n"), F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(1), "keys").alias("h2"),
        parity_bits(F.col("keys")).alias("bits"),
        *[F.when(F.size("keys") > LONG, bits).alias(name) for name, bits in zip(_WIDE, _sketch_bits(F.col("keys")))],
        "keys",
    )
    prefix = F.slice("keys", F.lit(1), _prefix(percent)).alias("prefix")
    return marked.select(*[c for c in marked.columns if c != "keys"], prefix)


def _fits(percent: int, any_word: bool = False) -> Column:
    """Order, length, positional and parity filter of x and y, which share the words at ``xi`` and ``yi``.

    Similar lines pass at the first word they share; with ``any_word`` they pass at any.
    """
    long_enough = F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * percent
    # Shared words: this one and at most the shorter rest; before this one none, or the smaller prefix.
    most = (F.least("xi", "yi") if any_word else F.lit(1)) + F.least(F.col("xn") - F.col("xi"), F.col("yn") - F.col("yi"))
    enough = most * (100 + percent) >= (F.col("xn") + F.col("yn")) * percent
    most_apart = (F.col("xn") + F.col("yn")) * (100 - percent)
    near = _apart("x", "y") * (100 + percent) <= most_apart
    wide = F.coalesce(_wide_apart("x", "y") * (100 + percent) <= most_apart, F.lit(True))
    return (F.col("yc") < F.col("xc")) & long_enough & enough & near & wide


def lines_and_classes(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The places and fingerprints of all lines, and the first line of each class, both stored.

    The second has ``c, h1, h2``, place, ``n``, bits, ``prefix``; ``c`` numbers the classes in
    the order of their first lines. Prefixes of other lines are not kept.
    """
    lines, folder = written(indexed_lines(docs, percent), "lines")
    first = F.min(F.struct("at", "h", "doc_id", "line_no", "n", "bits", *_WIDE, "prefix")).alias("first")
    leading, leaders = written(lines.groupBy("h1", "h2").agg(first).select("h1", "h2", "first.*"), "class_leaders")
    places = materialize(lines.select(*_PLACE, "h1", "h2"), "line_places")
    forget(lines, folder)
    ordered = leading.orderBy("at", "h", "h1", "h2").withColumn("c", F.monotonically_increasing_id())
    rows = materialize(ordered, "class_lines")
    forget(leading, leaders)
    return places, rows


def prefix_index(rows: DataFrame, *more: str) -> DataFrame:
    """``key, c, n``, bits and ``i``: a row for each prefix word of the classes."""
    entries = rows.select("c", "n", "bits", *_WIDE, *more, F.posexplode("prefix").alias("i", "key"))
    return entries.withColumn("i", F.col("i") + 1)


def _side(index: DataFrame, name: str, *more: str) -> DataFrame:
    return index.select("key", *[F.col(c).alias(name + c) for c in (*_ENTRY, *more)])


def first_pairs(index: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``x, y``: classes and the earliest one of each of their prefix words, where these pass the filters.

    The index is shuffled and sorted once; each row has the first of its word carried along.
    """
    so_far = Window.partitionBy("key").orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Column by column and named afterwards: a struct or another name would be shuffled beside them.
    met = index.select("*", *[F.first(c).over(so_far).alias(f"y{c}") for c in _ENTRY])
    pairs = met.withColumnsRenamed({c: f"x{c}" for c in _ENTRY}).where(_fits(percent, any_word=True))
    return pairs.select(F.col("xc").alias("x"), F.col("yc").alias("y")).distinct()


def _similar(x: DataFrame, y: DataFrame, percent: int, order: Column | None = None) -> DataFrame:
    """``x, y``: classes that share a prefix word and pass the filters, and the ``order`` if given."""
    fits = _fits(percent)
    pairs = x.join(y, "key").where(fits if order is None else fits & order)
    return pairs.select(F.col("xc").alias("x"), F.col("yc").alias("y")).distinct()


def fetched_words(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``c, words``: the numbers of the words of the first lines of ``classes``."""
    marks = classes.groupBy("doc_id", "h").agg(F.collect_list(F.struct("line_no", "c")).alias("marks"))
    marks = marks.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "marks").hint("shuffle_hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    met = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    line = F.split("text", "\n")
    cut = met.select(F.explode(F.transform("marks", lambda m: F.struct(m["c"], F.get(line, m["line_no"]).alias("line")))).alias("m"))
    # Rows repeated with id and text have the same line.
    once = cut.groupBy("m.c").agg(F.first("m.line").alias("line"))
    return once.select("c", word_numbers(F.col("line")).alias("words"))


def _sketch(words: Column) -> list[Column]:
    """``s0`` to ``s3``: 256 parity bits of the word numbers of a line."""
    return [bits.alias(f"s{i}") for i, bits in enumerate(_sketch_bits(words))]


def _sketch_bits(words: Column) -> list[Column]:
    def bits(number: int) -> Column:
        def bit(word: Column) -> Column:
            place = F.shiftright(word, _PARITY_SHIFT)
            mark = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
            return F.when(place.bitwiseAND(192) == 64 * number, mark).otherwise(F.lit(0).cast("long"))

        return F.aggregate(words, F.lit(0).cast("long"), lambda found, word: found.bitwiseXOR(bit(word)))

    return [bits(i) for i in range(4)]


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``x, y, odd``: pairs whose sketches differ in few enough bits; most others go here."""

    def side(name: str) -> DataFrame:
        return sets.select(
            F.col("c").alias(name), F.size("words").alias(f"{name}n"), *[F.col(f"s{i}").alias(f"{name}{i}") for i in range(4)]
        )

    both = pairs.join(side("x"), "x").join(side("y"), "y")
    odd = F.lit(0)
    for i in range(4):
        odd = odd + F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}")))
    near = both.select("x", "y", "xn", "yn", odd.alias("odd"))
    return near.where(F.col("odd") * (100 + percent) <= (F.col("xn") + F.col("yn")) * (100 - percent)).select("x", "y", "odd")


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``x`` of pairs whose words are similar."""
    of_x = sets.select(F.col("c").alias("x"), F.col("words").alias("xw"))
    of_y = sets.select(F.col("c").alias("y"), F.col("words").alias("yw"))
    both = pairs.select("x", "y").join(of_x, "x").join(of_y, "y")
    common = F.size(F.array_intersect("xw", "yw"))
    sizes = both.select("x", F.size("xw").alias("xn"), F.size("yw").alias("yn"), common.alias("common"))
    return sizes.where(F.col("common") * 100 >= (F.col("xn") + F.col("yn") - F.col("common")) * percent).select("x").distinct()


def confirmed(pairs: DataFrame, rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The ``x`` of pairs ``x, y`` whose words are similar, stored; only words of these are fetched.

    Pairs carry sketches first. Words travel with the nearest pair of each ``x``, and
    with all of its pairs only if that one is not similar.
    """
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("c")).distinct()
    classes = rows.select("c", "doc_id", "h", "line_no").join(wanted.hint("shuffle_hash"), "c", "left_semi")
    sets, folder = written(fetched_words(classes, docs).select("*", *_sketch(F.col("words"))), "line_words")
    near, pairs_folder = written(_near(pairs, sets, percent), "near_pairs")
    nearest = near.groupBy("x").agg(F.min(F.struct("odd", "y")).alias("best")).select("x", "best.y")
    found = materialize(_alike(nearest, sets, percent), "matches")
    more = materialize(_alike(near.join(found, "x", "left_anti"), sets, percent), "matches")
    forget(near, pairs_folder)
    forget(sets, folder)
    return found.unionByName(more)


def matched_lines(docs: DataFrame, rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``x``: the classes that an earlier line of another class matches."""
    pairs = materialize(first_pairs(prefix_index(rows), percent), "first_pairs")
    found = confirmed(pairs, rows, docs, percent)
    # One shuffled index is both sides. A matched class has more than any number of words as ``o``
    # and is no x: a filter would part the two. The order of y always holds.
    over = F.when(F.col("x").isNull(), 0).otherwise(2**31 - 1)
    marked = rows.join(found, F.col("c") == F.col("x"), "left").withColumn("o", over).drop("x")
    dealt = prefix_index(marked, "o").repartition("key")
    open_x = (F.col("xo") < F.col("yn")) & (F.col("yo") >= -F.col("xn"))
    rest = _similar(_side(dealt, "x", "o"), _side(dealt, "y", "o"), percent, open_x)
    rest = materialize(rest.join(pairs, ["x", "y"], "left_anti"), "other_pairs")
    return found.unionByName(confirmed(rest, rows, docs, percent))


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, h, line_no`` of every line that goes, stored.

    Lines without words always stay. Null texts have no lines. Lines of different texts
    under one id, or none, are ordered by place, then by the hash of the text; rows that
    repeat id and text are one document.
    """
    lines, rows = lines_and_classes(docs, percent)
    matched = matched_lines(docs, rows, percent)
    first = rows.select("c", "h1", "h2", F.col("at").alias("first"), F.col("h").alias("first_h"))
    first = first.join(matched, F.col("c") == F.col("x"), "left").drop("c")
    copies = lines.select("doc_id", "h", "line_no", "at", "h1", "h2").join(first, ["h1", "h2"])
    later = (F.col("at") > F.col("first")) | ((F.col("at") == F.col("first")) & (F.col("h") > F.col("first_h")))
    gone = copies.where(later | F.col("x").isNotNull())
    return materialize(gone.select("doc_id", "h", "line_no").distinct(), "removed_lines")


def line_report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, h, n_lines, n_removed, removed`` for each row of ``docs``.

    ``removed`` lists the line numbers that go, from 0.
    """
    gone = removed_lines(docs, percent).groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_list("line_no")).alias("removed")
    )
    gone = gone.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "removed")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"),
    )
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select(
        "doc_id", "h", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"),
    )


def drop_repeated_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, without the lines that go; a document that loses all of its
    lines with words goes too."""
    gone = removed_lines(docs.select("doc_id", "text"), percent).groupBy("doc_id", "h").agg(
        F.collect_list("line_no").alias("removed")
    )
    gone = gone.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "removed")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("d")) & (F.xxhash64("row.text") == F.col("g"))
    joined = rows.join(gone.hint("shuffle_hash"), same, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(F.split("row.text", "\n")) - 1), F.col("removed"))
    lines = F.split("row.text", "\n")
    text = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    rewritten = joined.select("row", "removed", F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(text).alias("text"))
    kept = rewritten.where(F.col("removed").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(
        *[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    )


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    report = line_report(docs)
    return report.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed_lines"))


OP10_SQL = r"""
WITH lines AS (
    SELECT doc_id, i - 1 AS line_no,
           list_distinct(list_filter(regexp_split_to_array(lower(l[i]), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
), classes AS (
    SELECT list_sort(words) AS words, min((doc_id, line_no)) AS first FROM lines WHERE len(words) > 0 GROUP BY 1
), numbered AS (
    SELECT words, first, len(words) AS n, row_number() OVER (ORDER BY first) AS c FROM classes
), tokens AS (
    SELECT c, n, unnest(words) AS w FROM numbered
), matched AS (
    SELECT DISTINCT c FROM (
        SELECT x.c, x.n AS xn, y.n AS yn, count(*) AS common
        FROM tokens x JOIN tokens y ON x.w = y.w AND y.c < x.c
          AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80
        GROUP BY x.c, y.c, x.n, y.n
    ) WHERE common * 100 >= (xn + yn - common) * 80
), gone AS (
    SELECT l.doc_id, l.line_no FROM lines l JOIN numbered k ON list_sort(l.words) = k.words
    WHERE (l.doc_id, l.line_no) > k.first OR k.c IN (SELECT c FROM matched)
), per_doc AS (
    SELECT doc_id, count(*) AS n_removed, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed_lines
    FROM gone GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines,
       coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN per_doc USING (doc_id)
"""
