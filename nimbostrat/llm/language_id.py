"""Language identification with Kneser-Ney character models.

One interpolated Kneser-Ney model per language over the characters of words
(lower case, letters only, padded by spaces).  All models share sorted arrays
of 64-bit n-gram hashes, one array per order, with a row of log-probabilities
for the languages; back-off weights are kept alike by context.  A text gets the
language of the lowest cross-entropy in bits per character, and is rejected
where that is far above what the language's own texts have.

Fitting uses a bounded sample of labelled texts; calibration uses all labelled
texts of a fold that fitting leaves out, and everything else covers all rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbostrat.llm.common import bound_batches, fresh, lean, mix64, saved, strings
from nimbostrat.llm.tokens import by_size

ORDER = 5
#: Most characters of one language, and of all languages, in the fitting sample.
TRAIN_CHARS = 6_000_000
TRAIN_CHARS_ALL = 24_000_000
#: Word scores remembered by one worker; the memory starts afresh beyond it.
REMEMBERED = 150_000
#: Bytes of text whose words are held at once.
CHUNK_BYTES = 1 << 20
#: A text's excess over its language's median entropy counts in units of
#: sqrt(1 / characters + 1 / BETWEEN): the second part is the spread of long texts.
#: A rejected text is SPREADS times as far out as QUANTILE of the calibration fold,
#: and as one unit at least, for folds of a few texts.
BETWEEN, QUANTILE, SPREADS = 200.0, 0.95, 6.0
UNSEEN = -20.0  # log2 of a character that no language has
PAD = " "
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The lower-case letter runs of ``text``; none if it has no letter."""
    words = _WORD.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each with ORDER-1 pads before and one after; lengths with the end."""
    left = PAD * (ORDER - 1)
    joined = "".join([f"{left}{w}{PAD}" for w in words])
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64), np.array([len(w) + 1 for w in words])


def _gram_hashes(codes: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` codes that end at each of ``ends``."""
    h = np.full(len(ends), size, np.uint64)
    for back in range(size - 1, -1, -1):
        h = h * _FACTOR + codes[ends - back]
    return mix64(h)


def _hash_strings(grams: list[str]) -> np.ndarray:
    """The same hashes of n-grams of one length."""
    if not grams:
        return np.zeros(0, np.uint64)
    size = len(grams[0])
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return _gram_hashes(codes, np.arange(size - 1, len(codes), size), size)


@dataclass
class LanguageModels:
    """Sorted hash arrays; row i of a table belongs to key i."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order 1..ORDER: keys, log2 probabilities (nan: not seen)
    backoff: list[tuple[np.ndarray, np.ndarray]]  # by context length 0..ORDER-1: keys, log2 weights (0: not seen)
    typical: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score_words(self, words: list[str]) -> np.ndarray:
        """log2 probability of each word, its end included, in each language."""
        codes, sizes = _codes(words)
        starts = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)[:-1]]) + ORDER - 1
        first = np.cumsum(sizes) - sizes
        at = np.repeat(starts - first, sizes) + np.arange(sizes.sum())
        out = np.full((len(at), len(self.languages)), np.nan)
        weight = np.zeros_like(out)
        for k in range(ORDER, 0, -1):
            found = _lookup(self.grams[k - 1], _gram_hashes(codes, at, k), np.nan)
            fits = np.isnan(out) & ~np.isnan(found)
            out[fits] = (weight + found)[fits]
            weight += _lookup(self.backoff[k - 1], _gram_hashes(codes, at - 1, k - 1), 0.0)
        out = np.where(np.isnan(out), weight + UNSEEN, out)
        return np.add.reduceat(out, first, axis=0)


def _lookup(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, default: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full((len(hashes), values.shape[1]), default)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where((keys[at] == hashes)[:, None], values[at], default)


def _merged(by_language: list[dict[str, float]], default: float) -> tuple[np.ndarray, np.ndarray]:
    """One sorted hash array with a row for each n-gram that any language has."""
    grams = sorted(set().union(*by_language))
    keys = _hash_strings(grams) if not grams or grams[0] else np.array([mix64(np.zeros(1, np.uint64))[0]] * len(grams), np.uint64)
    values = np.array([[d.get(g, default) for d in by_language] for g in grams]).reshape(len(grams), len(by_language))
    order = np.argsort(keys)
    return keys[order], values[order]


def kneser_ney(counts: dict[str, int]) -> tuple[list[dict[str, float]], list[dict[str, float]]]:
    """log2 probabilities by order and log2 back-off weights by context length.

    counts: ORDER-grams of padded words. Below the top order an n-gram counts
    its distinct left neighbours, or its occurrences if it starts with a pad.
    """
    levels = [counts]
    for _ in range(ORDER - 1):
        lower: dict[str, int] = defaultdict(int)
        for gram, n in levels[0].items():
            lower[gram[1:]] += n if gram[1] == PAD and len(gram) > 2 else 1
        levels.insert(0, dict(lower))
    probabilities, weights, below = [], [], {}
    for level in levels:
        spread = Counter(min(n, 3) for n in level.values())
        discount = spread[1] / (spread[1] + 2 * spread[2]) if spread[1] and spread[2] else 0.5
        total: dict[str, int] = defaultdict(int)
        kinds: dict[str, int] = defaultdict(int)
        for gram, n in level.items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        left = {h: discount * kinds[h] / total[h] for h in total}
        now = {}
        for gram, n in level.items():
            h = gram[:-1]
            now[gram] = (n - discount) / total[h] + left[h] * below.get(gram[1:], 2.0**UNSEEN)
        probabilities.append({g: float(np.log2(p)) for g, p in now.items()})
        weights.append({h: float(np.log2(w)) for h, w in left.items()})
        below = now
    return probabilities, weights


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", train_chars: int = TRAIN_CHARS, train_chars_all: int = TRAIN_CHARS_ALL) -> LanguageModels:
    """Models from labelled rows of folds 2 to 4, calibrated on all those of fold 1.

    The sample takes whole texts by a hash of doc_id, at a rate that gives about
    ``train_chars`` characters a language and ``train_chars_all`` in all; that
    bounds the n-gram counts, which are collected. Without labelled rows the
    model has no languages.
    """
    bound_batches(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col("doc_id").isNotNull())
    labelled = known.where(fold() > 1)
    sizes = {r["l"]: r["n"] for r in labelled.groupBy(F.col(lang).alias("l")).agg(F.sum(F.length(text)).alias("n")).collect()}
    languages = sorted(k for k, n in sizes.items() if n)
    if not languages:
        return LanguageModels([], [], [])
    share = min(train_chars, train_chars_all // len(languages))
    rates = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, share / sizes[k]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = labelled.where(draw < F.coalesce(rates[F.col(lang)], F.lit(0.0))).select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for label, body in zip(batch.column(0).to_pylist(), strings(batch.column(1)).to_pylist(), strict=True):
                counts[label].update(words_of(body))
            rows = [(label, w, n) for label, c in counts.items() for w, n in c.items()]
            a, b, c = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], names=["lang", "word", "n"])

    words = sample.select("lang", "text").mapInArrow(count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    padded = F.concat(F.lit(PAD * (ORDER - 1)), F.col("word"), F.lit(PAD))
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: padded.substr(i, F.lit(ORDER))))
    grams = words.select("lang", "n", gram.alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted: dict[str, dict[str, int]] = {k: {} for k in languages}
    for part in grams.toArrow().to_batches():
        for label, g, n in zip(*[part.column(c).to_pylist() for c in ("lang", "gram", "n")], strict=True):
            counted[label][g] = n
    languages = [k for k in languages if counted[k]]
    if not languages:
        return LanguageModels([], [], [])
    fitted = [kneser_ney(counted[k]) for k in languages]
    models = LanguageModels(
        languages,
        [_merged([p[k] for p, _ in fitted], np.nan) for k in range(ORDER)],
        [_merged([w[k] for _, w in fitted], 0.0) for k in range(ORDER)],
    )
    return _calibrated(models, known.where(fold() == 1).select(F.col(lang).alias("lang"), F.col(text).alias("text")))


def _calibrated(models: LanguageModels, sample: DataFrame) -> LanguageModels:
    """The models with each language's median entropy and its limit of excess."""
    models.typical, models.limit = np.zeros(len(models.languages)), np.full(len(models.languages), np.inf)
    scored = saved(predict(sample, models).where(F.col("lang_pred") == F.col("lang")).select("lang", "cross_entropy", "n_letters"))
    typical = {r["lang"]: r["x"] for r in scored.groupBy("lang").agg(F.percentile_approx("cross_entropy", 0.5, 10_000).alias("x")).collect()}
    if not typical:
        return models
    of_lang = F.create_map(*[F.lit(x) for pair in typical.items() for x in pair])[F.col("lang")]
    excess = (F.col("cross_entropy") - of_lang) / F.sqrt(1 / F.col("n_letters") + 1 / BETWEEN)
    for r in scored.groupBy("lang").agg(F.percentile_approx(excess, QUANTILE, 10_000).alias("far")).collect():
        k = models.languages.index(r["lang"])
        models.typical[k], models.limit[k] = typical[r["lang"]], SPREADS * max(r["far"], 1.0)
    return models


class _Scorer:
    """A worker's word scores under one set of models."""

    def __init__(self, models: LanguageModels):
        self.models, self.index, self.sizes, self.scores = models, {}, np.zeros(0, np.int64), np.zeros((0, len(models.languages)))

    def _learn(self, words: list[str]) -> None:
        if len(self.index) > REMEMBERED:
            self.index, self.sizes, self.scores = {}, self.sizes[:0], self.scores[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        parts = [self.models.score_words(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
        self.scores = np.concatenate([self.scores, *parts])
        self.sizes = np.concatenate([self.sizes, np.array([len(w) + 1 for w in new], np.int64)])

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits in each language and scored characters of each text; 0 characters: no letter."""
        every = [words_of(t) for t in texts]
        if any(w not in self.index for words in every for w in words):
            self._learn([w for words in every for w in words])
        bits, sizes = np.zeros((len(texts), len(self.models.languages))), np.zeros(len(texts), np.int64)
        for i, words in enumerate(every):
            if words:
                at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
                bits[i], sizes[i] = -self.scores[at].sum(axis=0), self.sizes[at].sum()
        return bits, sizes


def predict(docs: DataFrame, models: LanguageModels, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy, rejected, n_letters.

    Only the text decides. Columns of ``docs`` with these names are replaced, all
    others pass through. lang_pred is ``und``, score 0 and rejected true where
    the text is null, empty or without letters, or where no language was
    learned. score is the share of the chosen language in the likelihoods of a
    character, the geometric mean over the text: 1 / languages where they don't
    differ, towards 1 where the others fit badly. Of equal entropies the first language by name is chosen.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    results = {"lang_pred": "string", "score": "double", "cross_entropy": "double", "rejected": "boolean", "n_letters": "bigint"}
    body = fresh("text")
    kept = [c for c in docs.columns if c not in results]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(body))
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        scorer, languages = _Scorer(models), np.array([*models.languages, UNKNOWN], object)
        for batch in batches:
            texts = strings(batch.column(body)).to_pylist()
            ranges = by_size([len(t) for t in texts], CHUNK_BYTES) if models.languages else []
            parts = [scorer.texts(texts[a:b]) for a, b in ranges]
            bits, sizes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros((len(texts), 0)), np.zeros(len(texts), np.int64))
            known = sizes > 0
            best = np.where(known, bits.argmin(axis=1) if models.languages else -1, -1)
            rows = np.arange(len(texts))
            least = bits[rows, best] if models.languages else np.zeros(len(texts))
            entropy = np.where(known, least / np.maximum(sizes, 1), 0.0)
            apart = (least[:, None] - bits) / np.maximum(sizes, 1)[:, None]
            score = np.where(known, 1 / np.exp2(apart).sum(axis=1) if models.languages else 0.0, 0.0)
            rejected = ~known
            if models.languages:
                rejected |= known & ((entropy - models.typical[best]) / np.sqrt(1 / np.maximum(sizes, 1) + 1 / BETWEEN) > models.limit[best])
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(languages[best], pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *results])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != body] + [f"{k} {v}" for k, v in results.items()]
    return given.mapInArrow(lean(run), ", ".join(fields))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``predict`` with models fitted on the labelled rows of ``docs`` itself.

    docs: doc_id, a text and a label column; either may hold nulls.
    """
    return predict(docs, fit(docs, text, lang), text)


def languages(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    held_out is null where doc_id is.
    """
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
