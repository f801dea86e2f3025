"""Toxicity from subword-bag embeddings, averaged into a linear softmax.

A word is the mean of the vectors of itself and of its character n-grams (hashed into
buckets), so misspellings share most of their vectors; a window is the mean of its
words. A text has the sum of three terms, each with its own softmax over the shared
vectors: its worst word, so one insult in a long text counts, its worst window of tens
of words, which overlap, and the mean of all its words. Vectors and softmaxes are
trained together in numpy on a bounded sample of labelled texts. The softmaxes being
linear, scoring needs one number per bucket and term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridtally.llm.wordbytes import Words, blocks, mixed, powers, prefix_sums, utf8

# The bound of the training sample: rows per label, and bytes of a text in it.
SAMPLE_ROWS = {0: 1800, 1: 600}
SAMPLE_BYTES = 20_000
FOLDS = 5

BUCKETS = 1 << 17
DIMENSIONS = 8
NGRAMS = (3, 4, 5)
# Each term's step in words, and whether its windows span two steps, so that they overlap.
TERMS = ((1, False), (16, True), (1 << 40, False))
# Units in fewer toxic texts of the sample keep a zero vector.
LEAST_TEXTS = 3
# Units in n texts move by n / (n + SHRINK) of what others do.
SHRINK = 30
# The first epochs learn from the mean of a text's windows, the others from its worst one.
MEAN_EPOCHS = 10
WORST_EPOCHS = 50
# The share of wrong labels 1 to reckon with: texts that look clean are not forced up.
NOISE = 0.002
RATE = 0.3
DECAY = 1e-3
SEED = 11
# Words, texts and bytes that training handles at a time; a byte needs about 100 times as much.
_WORDS = 1 << 17
_TEXTS = 64
_TRAINED_BYTES = 1 << 17
# Bytes that are scored at a time; a task needs about 100 times as much.
_SCORED_BYTES = 1 << 17


@dataclass(frozen=True)
class Model:
    """The log-odds of each bucket, a column for each of TERMS, and the bias."""

    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are kept from training; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def _text_words(texts: list[bytes]) -> Words:
    return Words([b" " + text for text in texts], "plain")


def _units(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word and bucket of every n-gram that lies within a word and its two borders."""
    data = words.data.copy()
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    inside = np.cumsum(inside, dtype=np.int8)[:-1]
    data[inside == 0] = 0x20
    number = np.zeros(len(data), dtype=np.int32)
    number[words.start] = 1
    number = np.cumsum(number, dtype=np.int32) - 1
    covered = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(inside, out=covered[1:])
    sums = prefix_sums(data)
    back = powers(len(data), inverse=True)
    of, buckets = [], []
    for n in NGRAMS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        at = np.flatnonzero(covered[n - 1 : n - 1 + count] - covered[1 : 1 + count] == n - 2)
        hashes = mixed((sums[at + n] - sums[at]) * back[at] + np.uint64(n))
        of.append(number[at + 1])
        buckets.append((hashes & np.uint64(BUCKETS - 1)).astype(np.int32))
    if len(words.start):
        whole = mixed((sums[words.end] - sums[words.start]) * back[words.start])
        of.append(np.arange(len(words.start), dtype=np.int32))
        buckets.append((whole & np.uint64(BUCKETS - 1)).astype(np.int32))
    if not of:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(of), np.concatenate(buckets)


class _Windows:
    """The windows of one of TERMS; they do not cross texts."""

    def __init__(self, words: Words, step: int, double: bool):
        first = np.zeros(len(words.counts) + 1, dtype=np.int64)
        np.cumsum(words.counts, out=first[1:])
        inside = np.arange(len(words.start)) - first[words.text]
        steps = -(-words.counts.astype(np.int64) // step)
        begin = np.cumsum(steps) - steps
        self.step = begin[words.text] + inside // step
        self.steps = int(steps.sum())
        windows = np.maximum(steps - 1, np.minimum(steps, 1)) if double else steps
        self.text = np.repeat(np.arange(len(steps)), windows)
        own = np.arange(len(self.text)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.low = begin[self.text] + own
        self.high = np.minimum(self.low + double, (begin + steps - 1)[self.text])
        self.two = self.high > self.low
        self.starts = np.searchsorted(self.text, np.flatnonzero(windows > 0))
        self.size = np.maximum(self._sums(np.ones(len(words.start))), 1)

    def _sums(self, by_word: np.ndarray) -> np.ndarray:
        sums = np.bincount(self.step, weights=by_word, minlength=self.steps)
        return sums[self.low] + np.where(self.two, sums[self.high], 0)

    def means(self, by_word: np.ndarray) -> np.ndarray:
        return self._sums(by_word) / self.size

    def worst(self, by_window: np.ndarray) -> np.ndarray:
        """The largest value of each text that has words."""
        return np.maximum.reduceat(by_window, self.starts) if len(self.starts) else np.zeros(0)

    def to_words(self, by_window: np.ndarray) -> np.ndarray:
        """What a slope by the mean of each window is by each word."""
        part = by_window / self.size
        of_step = np.bincount(self.low, weights=part, minlength=self.steps)
        of_step += np.bincount(self.high, weights=part * self.two, minlength=self.steps)
        return of_step[self.step]


class _Vocabulary:
    """The distinct words of texts, and which words each text has, from blocks of bounded size.

    ``words`` numbers every word in order of the texts; ``text``, ``word`` and ``times``
    list the distinct words of each text and how often it has them.
    """

    def __init__(self, texts: list[bytes]):
        hashes, lengths, pieces, counts = [], [], [], []
        for low, high in blocks(texts, _TRAINED_BYTES):
            found = _text_words(texts[low:high])
            counts.append(found.counts)
            own = found.hashes()
            distinct, first, same = np.unique(own, return_index=True, return_inverse=True)
            size = found.end[first] - found.start[first]
            at = np.repeat(found.start[first] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            hashes.append((distinct, same.astype(np.int32)))
            lengths.append(size)
            pieces.append(found.data[at])
        self.counts = np.concatenate(counts)
        known, first = np.unique(np.concatenate([h[0] for h in hashes]), return_index=True)
        self.words = np.concatenate([np.searchsorted(known, h[0]).astype(np.int32)[h[1]] for h in hashes])
        size = np.concatenate(lengths)
        begin = np.cumsum(size) - size
        self.size, self._begin, self._bytes = len(known), begin[first], np.concatenate(pieces)
        self._length = size[first]
        text, word, times = [], [], []
        ends = np.cumsum(self.counts)
        for low in range(0, len(texts), _TEXTS):
            high = min(low + _TEXTS, len(texts))
            begin_word = ends[low] - self.counts[low]
            own = np.repeat(np.arange(low, high), self.counts[low:high]) * self.size + self.words[begin_word : ends[high - 1]]
            pairs, often = np.unique(own, return_counts=True)
            text.append((pairs // max(self.size, 1)).astype(np.int32))
            word.append((pairs % max(self.size, 1)).astype(np.int32))
            times.append(often.astype(np.int32))
        self.text, self.word, self.times = (np.concatenate(x) for x in (text, word, times))

    def units(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """A block of distinct words at a time: which, word (from 0 in the block) and bucket of their units, and each word's share."""
        for low in range(0, self.size, _WORDS):
            pieces = [
                self._bytes[b : b + n].tobytes()
                for b, n in zip(self._begin[low : low + _WORDS].tolist(), self._length[low : low + _WORDS].tolist())
            ]
            for first, last in blocks(pieces, _TRAINED_BYTES):
                of, bucket = _units(Words([b" " + b" ".join(pieces[first:last])], "plain"))
                share = 1.0 / np.bincount(of, minlength=last - first)
                yield slice(low + first, low + last), of, bucket, share


class _OwnWords:
    """Each word of a text is a window; a repeated one is kept once and counted."""

    def __init__(self, found: _Vocabulary):
        self.text, self.word, self.times = found.text, found.word, found.times
        self.vocabulary = found.size
        self.starts = np.searchsorted(self.text, np.flatnonzero(found.counts > 0))
        self.even = self.times / found.counts[self.text]

    def means(self, by_word: np.ndarray) -> np.ndarray:
        return by_word[self.word]

    def to_words(self, by_window: np.ndarray) -> np.ndarray:
        out = np.zeros(self.vocabulary)
        for low in range(0, len(self.word), _WORDS):
            part = slice(low, low + _WORDS)
            out += np.bincount(self.word[part], weights=by_window[part], minlength=self.vocabulary)
        return out


class _WholeTexts:
    """A text is one window."""

    def __init__(self, found: _Vocabulary):
        self.found = found
        self.text = np.flatnonzero(found.counts > 0)
        self.starts = np.arange(len(self.text))
        self.times = self.even = np.ones(len(self.text))

    def means(self, by_word: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(self.found.counts))
        for low in range(0, len(self.found.word), _WORDS):
            part = slice(low, low + _WORDS)
            own = by_word[self.found.word[part]] * self.found.times[part]
            sums += np.bincount(self.found.text[part], weights=own, minlength=len(sums))
        return sums[self.text] / self.found.counts[self.text]

    def to_words(self, by_window: np.ndarray) -> np.ndarray:
        by_text = np.zeros(len(self.found.counts))
        by_text[self.text] = by_window / self.found.counts[self.text]
        out = np.zeros(self.found.size)
        for low in range(0, len(self.found.word), _WORDS):
            part = slice(low, low + _WORDS)
            own = by_text[self.found.text[part]] * self.found.times[part]
            out += np.bincount(self.found.word[part], weights=own, minlength=self.found.size)
        return out


class _Stretches:
    """Overlapping windows of two steps of words, summed over parts of the words at a time."""

    def __init__(self, found: _Vocabulary, step: int):
        self.words, self.vocabulary, counts = found.words, found.size, found.counts.astype(np.int64)
        steps = -(-counts // step)
        begin, first = np.cumsum(steps) - steps, np.cumsum(counts) - counts
        self.steps = int(steps.sum())
        self._step = np.empty(len(self.words), dtype=np.int32)
        for low in range(0, len(self.words), _WORDS):
            place = np.arange(low, min(low + _WORDS, len(self.words)))
            text = np.searchsorted(first, place, side="right") - 1
            self._step[low : low + _WORDS] = begin[text] + (place - first[text]) // step
        windows = np.maximum(steps - 1, np.minimum(steps, 1))
        self.text = np.repeat(np.arange(len(steps)), windows)
        own = np.arange(len(self.text)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.low = begin[self.text] + own
        self.high = np.minimum(self.low + 1, (begin + steps - 1)[self.text])
        self.two = self.high > self.low
        self.starts = np.searchsorted(self.text, np.flatnonzero(windows > 0))
        self.even = 1 / np.maximum(windows, 1)[self.text]
        self.times = np.ones(len(self.text))
        self.size = np.maximum(self._sums(np.ones(max(found.size, 1))), 1)

    def _sums(self, by_word: np.ndarray) -> np.ndarray:
        sums = np.zeros(self.steps)
        for low in range(0, len(self.words), _WORDS):
            step = self._step[low : low + _WORDS]
            part = np.bincount(step - step[0], weights=by_word[self.words[low : low + _WORDS]])
            sums[step[0] : step[0] + len(part)] += part
        return sums[self.low] + np.where(self.two, sums[self.high], 0)

    def means(self, by_word: np.ndarray) -> np.ndarray:
        return self._sums(by_word) / self.size

    def to_words(self, by_window: np.ndarray) -> np.ndarray:
        part = by_window / self.size
        of_step = np.bincount(self.low, weights=part, minlength=self.steps)
        of_step += np.bincount(self.high, weights=part * self.two, minlength=self.steps)
        out = np.zeros(self.vocabulary)
        for low in range(0, len(self.words), _WORDS):
            own = of_step[self._step[low : low + _WORDS]]
            out += np.bincount(self.words[low : low + _WORDS], weights=own, minlength=self.vocabulary)
        return out


def _worst(term: _OwnWords | _WholeTexts | _Stretches, by_window: np.ndarray) -> np.ndarray:
    """The largest value of each text that has words."""
    return np.maximum.reduceat(by_window, term.starts) if len(term.starts) else np.zeros(0)


def _mean(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    counts = np.bincount(group, minlength=groups)
    return np.bincount(group, weights=values, minlength=groups) / np.maximum(counts, 1)


def train(texts: list[bytes], labels: np.ndarray, importance: np.ndarray, seed: int = SEED) -> Model:
    """Fit on whole texts; ``importance`` weighs them. No texts give even odds for all."""
    if not texts:
        return Model(np.zeros((BUCKETS, len(TERMS)), dtype=np.float32), 0.0)
    found = _Vocabulary(texts)
    terms = [_OwnWords(found), _Stretches(found, TERMS[1][0]), _WholeTexts(found)]
    weight = importance / importance.sum()
    odds = (weight * labels).sum()
    # In how many texts a word occurs, and a bucket, of all texts and of toxic ones.
    toxic = labels[found.text] > 0
    of_words = np.bincount(found.word, minlength=found.size), np.bincount(found.word[toxic], minlength=found.size)
    in_texts, in_toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for block, own, bucket, _ in found.units():
        in_texts += np.bincount(bucket, weights=of_words[0][block][own], minlength=BUCKETS)
        in_toxic += np.bincount(bucket, weights=of_words[1][block][own], minlength=BUCKETS)
    known = (in_toxic >= LEAST_TEXTS).astype(float)
    # Units of other buckets keep a zero vector; they only count among those of their word.
    kept = [
        (block, own[known[bucket] > 0], bucket[known[bucket] > 0], share) for block, own, bucket, share in found.units()
    ]
    # Rarer units move further for the same gradient, as in adaptive methods, but for the rarest.
    stride = known * np.sqrt(in_texts) / (in_texts + SHRINK)
    rng = np.random.default_rng(seed)
    params = [
        rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)) * known[:, None],
        np.repeat(rng.normal(0, 0.5, (1, 2, DIMENSIONS)), len(TERMS), axis=0),
        np.array([np.log(max(odds, 1e-6) / max(1 - odds, 1e-6))]),
    ]
    moments = [np.zeros_like(p) for p in params]
    largest = [0.0] * len(params)
    has_words = found.counts > 0

    def to_words(by_bucket: np.ndarray) -> np.ndarray:
        out = np.zeros(found.size)
        for block, own, bucket, share in kept:
            out[block] = np.bincount(own, weights=by_bucket[bucket], minlength=len(share)) * share
        return out

    def to_buckets(by_word: np.ndarray) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for block, own, bucket, share in kept:
            out += np.bincount(bucket, weights=(by_word[block] * share)[own], minlength=BUCKETS)
        return out

    def window_scores(params: list[np.ndarray]) -> list[np.ndarray]:
        by_bucket = params[0] @ (params[1][:, 1] - params[1][:, 0]).T
        return [term.means(to_words(own)) for term, own in zip(terms, by_bucket.T)]

    def calibrated(params: list[np.ndarray]) -> tuple[np.ndarray, float]:
        worst = [_worst(term, own) for term, own in zip(terms, window_scores(params))]
        return _calibrated(np.stack(worst, axis=1), labels[has_words], weight[has_words], odds)

    for epoch in range(MEAN_EPOCHS + WORST_EPOCHS):
        if epoch == MEAN_EPOCHS:
            scale, bias = calibrated(params)
            params[1], params[2] = params[1] * scale[:, None, None], np.array([bias])
            moments, largest = [np.zeros_like(p) for p in params], [0.0] * len(params)
        direction = params[1][:, 1] - params[1][:, 0]
        pooled, parts = np.zeros(len(texts)), []
        for term, by_window in zip(terms, window_scores(params)):
            if epoch < MEAN_EPOCHS:
                part = term.even
                pooled += np.bincount(term.text, weights=by_window * part, minlength=len(texts))
            else:
                worst = np.zeros(len(texts))
                worst[has_words] = _worst(term, by_window)
                pooled += worst
                part = (by_window == worst[term.text]) * term.times
            parts.append(part)
        probability = 1 / (1 + np.exp(-np.clip(pooled + params[2][0], -30, 30)))
        wanted = labels if epoch < MEAN_EPOCHS else labels * probability / (probability + NOISE)
        gradient = weight * (probability - wanted)
        of_bucket = []
        for term, part in zip(terms, parts):
            by_word = term.to_words(gradient[term.text] * part)
            of_bucket.append(to_buckets(by_word))
        slopes = np.stack(of_bucket)
        toward = slopes @ params[0]
        steps = [
            (slopes * stride).T @ direction,
            np.stack([-toward, toward], axis=1),
            np.array([gradient.sum()]),
        ]
        for i, step in enumerate(steps):
            # One scale for all of a matrix, so that rare units move less than frequent ones.
            moments[i] *= 0.8
            moments[i] += 0.2 * step
            largest[i] = max(0.9 * largest[i], moments[i].max(), -moments[i].min())
            params[i] *= 1 - DECAY
            params[i] -= RATE * moments[i] / (largest[i] + 1e-12)
    scale, bias = calibrated(params)
    weights = params[0] @ (params[1][:, 1] - params[1][:, 0]).T * scale
    return Model(weights.astype(np.float32), bias)


def _calibrated(worst: np.ndarray, labels: np.ndarray, weight: np.ndarray, odds: float) -> tuple[np.ndarray, float]:
    """Scales and bias that turn the terms of a text into log-odds, by Newton steps."""
    start = float(np.log(max(odds, 1e-6) / max(1 - odds, 1e-6)))
    spread = worst.std(axis=0) if len(worst) else np.zeros(worst.shape[1])
    used = np.flatnonzero(spread > 0)
    scale = np.zeros(worst.shape[1])
    while len(used):
        middle = worst[:, used].mean(axis=0)
        x = np.concatenate([(worst[:, used] - middle) / spread[used], np.ones((len(worst), 1))], axis=1)
        theta = np.append(np.zeros(len(used)), start)
        ridge = np.append(np.full(len(used), 1e-4), 0.0)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            slope = x.T @ (weight * (p - labels)) + ridge * theta
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge) + np.eye(len(theta)) * 1e-6
            theta = theta - np.clip(np.linalg.solve(curve, slope), -2, 2)
        if (theta[:-1] >= 0).all():
            scale[used] = theta[:-1] / spread[used]
            return scale, float(theta[-1] - scale[used] @ middle)
        # A term may not count against itself: it is left out.
        used = np.delete(used, int(np.argmin(theta[:-1])))
    return scale, start


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1 for each text; texts without words have that of the bias."""
    out = np.full(len(texts), 1 / (1 + np.exp(-model.bias)))
    for low, high in blocks(texts, _SCORED_BYTES):
        words = _text_words(texts[low:high])
        if not len(words.start):
            continue
        of, bucket = _units(words)
        pooled = np.full(int((words.counts > 0).sum()), model.bias)
        for term, weights in zip(TERMS, model.weights.T):
            windows = _Windows(words, *term)
            pooled += windows.worst(windows.means(_mean(weights[bucket], of, len(words.start))))
        out[low:high][words.counts > 0] = 1 / (1 + np.exp(-np.clip(pooled, -700, 700)))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: dict[int, int] = SAMPLE_ROWS) -> Model:
    """Train on up to ``sample_rows`` texts per label, chosen by a hash of their id.

    Only rows of ``labels`` that are not held out and have ``toxic`` 0 or 1 are used.
    Texts over SAMPLE_BYTES bytes are not drawn. The sample is all the driver receives;
    its rows are weighed by how many labels they stand for.
    """
    usable = labels.select("doc_id", "toxic").where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    counts = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts, wanted, importance = [], [], []
    order = F.xxhash64(F.col("doc_id").cast("string"))
    for label, most in sorted(sample_rows.items()):
        ids = usable.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(most).select("doc_id").distinct()
        rows = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES)
        # At most ``most`` ids, and as many texts.
        found = rows.join(F.broadcast(ids), "doc_id").orderBy(order, "doc_id", "text").limit(most)
        own = [(r.text or "").encode() for r in found.collect()]
        texts += own
        wanted += [label] * len(own)
        importance += [counts.get(label, 0) / max(len(own), 1)] * len(own)
    return train(texts, np.array(wanted, dtype=float), np.array(importance, dtype=float))


def with_scores(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and ``toxicity``. A null text scores as an empty one."""
    kept = [c for c in columns if c != "text"]
    given = docs.select(*kept, F.col("text").alias("__text"))
    schema = given.select(*kept).schema.add("toxicity", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            result = scores(model, utf8(batch.column(len(kept))))
            arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(result)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "toxicity"])

    return given.mapInArrow(score, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    model = fit(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = scores(model, utf8(batch.column(batch.schema.get_field_index("text")))) < threshold
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_scores(docs, model, ["doc_id"])
    score = F.col("toxicity")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )
