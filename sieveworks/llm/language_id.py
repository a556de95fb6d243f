"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters with one space for every run of anything else.  Each language has a
model of order four; all are held in one sorted array of n-gram hashes per order, with a column of
log probabilities per language, and one per order of contexts with the back-off weights.  The
language with the lowest cross-entropy per character wins.  A part of the sample that no model was
trained on calibrates the confidence (a temperature) and the rejection: a text is rejected when it
has no letter, or its cross-entropy is far above what the calibration texts of its language show
for a text of that length.

Models are fitted on a sample of labelled rows: about sample_chars characters per language, taken by
a hash of the row, from texts of up to an eighth of that, each distinct text once.  Predictions read
whole texts and nothing but texts.

A null text or one without letters gives 'und', score 0.0 and is rejected.  With no labelled row at
all every text gives 'und'.  Ties go to the language that sorts first.  Repeated rows get a row
each; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import codepoints, map_batches, slices, starts_of, texts_of

ORDER = 4
SAMPLE_CHARS = 800_000
#: Rejection: cross-entropy above SLACK times the language's mean plus WIDTH deviations of a text that long.
SLACK, WIDTH = 1.5, 6.0
_BASE, _SALT = 0x9E3779B97F4A7C15, (0, 11, 23, 37, 53)


@cache
def letters() -> np.ndarray:
    """For each code point its lower case, or 32 if it is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(x := chr(c))[0] == "L":
            out[c] = ord(x.lower()[0])
    return out


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with ORDER-1 spaces before each text and one after it; where texts start; letters of each."""
    lengths = np.array([len(t) for t in texts], np.int64)
    c = letters()[codepoints("".join(texts))]
    starts = starts_of(lengths)
    isletter = c != 32
    first = np.zeros(len(c) + 1, bool)
    first[starts[:-1]] = True
    keep = isletter | np.append(False, isletter[:-1]) & ~first[:-1]  # a space only after a letter of the same text
    sums = starts_of(keep)
    lens = sums[starts[1:]] - sums[starts[:-1]]
    n_letters = starts_of(isletter)
    out_starts = starts_of(lens + ORDER)
    out = np.full(out_starts[-1], 32, np.uint64)
    owner = np.repeat(np.arange(len(texts)), lens)
    out[np.arange(len(owner)) + ORDER * owner + ORDER - 1] = c[keep]
    return out, out_starts, n_letters[starts[1:]] - n_letters[starts[:-1]]


def hashes(c: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters that end at each place; the first k-1 places are not whole."""
    h = c.copy()
    for j in range(1, k):
        h[j:] += c[:-j] * np.uint64(pow(_BASE, j, 2**64))
    h = (h + np.uint64(_SALT[k])) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class HashArray:
    """Sorted hashes with an index of their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, len(keys).bit_length() + 2)
        lead = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(lead, np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        lead = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[lead].astype(np.int64), self.start[lead + 1]
        out = np.where((at < end) & (self.keys[np.minimum(at, len(self.keys) - 1)] == h), at, -1)
        rest = np.flatnonzero((out < 0) & (at + 1 < end))
        while len(rest):
            at[rest] += 1
            hit = self.keys[at[rest]] == h[rest]
            out[rest[hit]] = at[rest[hit]]
            rest = rest[~hit & (at[rest] + 1 < end[rest])]
        return out


def _counts(c: np.ndarray, ok: np.ndarray) -> list[tuple]:
    """For orders 1 to ORDER: distinct hashes, their (continuation) counts, hashes of context and suffix."""
    per = []
    for k in range(1, ORDER + 1):
        h = hashes(c, k)[ok]
        keys, at, n = np.unique(h, return_index=True, return_counts=True)
        context = (hashes(c, k - 1) if k > 1 else np.zeros_like(c))[ok - 1][at]
        suffix = hashes(c, k - 1)[ok][at] if k > 1 else np.zeros_like(keys)
        per.append([keys, n, context, suffix])
    for k in range(ORDER - 1):  # lower orders count the distinct n-grams that end in them
        above = np.unique(per[k + 1][3], return_counts=True)
        n = np.zeros(len(per[k][0]), np.int64)
        n[np.searchsorted(per[k][0], above[0])] = above[1]
        per[k][1] = n
    return per


class KneserNey:
    """Models of all languages side by side."""

    def __init__(self, sample: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in sample})
        held = [(lang, t) for lang, t in sample if zlib.crc32(t.encode()) % 4 == 0]
        fit = [(lang, t) for lang, t in sample if zlib.crc32(t.encode()) % 4] or sample
        n_langs, counts = len(self.langs), []
        for lang in self.langs:
            texts = [t for x, t in fit if x == lang] or [t for x, t in sample if x == lang]
            c, starts, _ = normalised(sorted(texts))
            counts.append(_counts(c, self._scored(starts)))
        self.grams, self.logp, self.contexts, self.weights = [], [], [], []
        below = None
        for k in range(ORDER):
            keys, at = np.unique(np.concatenate([x[k][0] for x in counts]), return_index=True)
            context, suffix = (np.concatenate([x[k][i] for x in counts])[at] for i in (2, 3))
            contexts = np.unique(context)
            p, weight = np.zeros((len(keys), n_langs)), np.ones((len(contexts), n_langs))
            for j, x in enumerate(counts):
                own, n, ctx, _ = x[k]
                n1, n2 = (n == 1).sum(), (n == 2).sum()
                discount = float(np.clip(n1 / max(1, n1 + 2 * n2), 0.1, 0.95))
                i = np.searchsorted(contexts, ctx)
                total, kinds = np.bincount(i, n, len(contexts)), np.bincount(i, minlength=len(contexts))
                p[np.searchsorted(keys, own), j] = np.maximum(n - discount, 0) / total[i]
                seen = total > 0
                weight[seen, j] = discount * kinds[seen] / total[seen]
            of = np.searchsorted(contexts, context)
            if k == 0:
                self.unseen = np.log(weight[0] / (len(keys) + 1))
                p += weight[0] / (len(keys) + 1)
            else:
                p += weight[of] * below[np.searchsorted(self.grams[-1].keys, suffix)]
            below = p
            self.grams.append(HashArray(keys))
            self.logp.append(np.log(p).astype(np.float32))
            self.contexts.append(HashArray(contexts))
            self.weights.append(np.log(weight).astype(np.float32))
        self.temperature, self.mean, self.deviation = 1.0, np.zeros(n_langs), np.ones(n_langs)
        self._calibrate(held or sample)

    @staticmethod
    def _scored(starts: np.ndarray) -> np.ndarray:
        """Places of all characters but the padding before each text."""
        ok = np.ones(starts[-1], bool)
        for j in range(ORDER - 1):
            ok[starts[:-1] + j] = False
        return np.flatnonzero(ok)

    def _log(self, c: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        i = self.grams[k - 1].find(hashes(c, k)[at] if k == ORDER else self._few(c, at, k))
        out = self.logp[k - 1][i]
        if len(miss := np.flatnonzero(i < 0)):
            if k == 1:
                out[miss] = self.unseen
            else:
                out[miss] = self._log(c, at[miss], k - 1)
                j = self.contexts[k - 1].find(self._few(c, at[miss] - 1, k - 1))
                out[miss[j >= 0]] += self.weights[k - 1][j[j >= 0]]
        return out

    @staticmethod
    def _few(c: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """hashes() at few places."""
        window = c[at[:, None] + np.arange(1 - k, 1)].ravel()
        return hashes(window, k)[k - 1 :: k]

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character by text and language, characters scored, letters."""
        c, starts, n_letters = normalised(texts)
        at = self._scored(starts)
        n = np.diff(starts) - ORDER + 1
        total = np.add.reduceat(self._log(c, at, ORDER), starts_of(n)[:-1], axis=0, dtype=np.float64)
        return -total / n[:, None], n, n_letters

    def _confidence(self, bits: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
        x = -(bits - bits.min(axis=1, keepdims=True)) * np.sqrt(n)[:, None] / temperature
        p = np.exp(x)
        return p / p.sum(axis=1, keepdims=True)

    def _calibrate(self, held: list[tuple[str, str]]) -> None:
        bits, n, n_letters = self.entropy([t for _, t in held])
        truth = np.array([self.langs.index(x) for x, _ in held])
        ok = n_letters > 0
        if not ok.any():
            return
        bits, n, truth = bits[ok], n[ok], truth[ok]
        own = bits[np.arange(len(truth)), truth]
        loss = lambda t: -np.log(np.maximum(self._confidence(bits, n, t)[np.arange(len(truth)), truth], 1e-9)).mean()
        self.temperature = float(min((2.0**e for e in range(-4, 8)), key=loss))
        for j in range(len(self.langs)):
            mine = truth == j if (truth == j).any() else np.ones(len(truth), bool)
            self.mean[j] = own[mine].mean()
            self.deviation[j] = np.sqrt((n[mine] * (own[mine] - self.mean[j]) ** 2).mean())

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, confidence, cross-entropy in nats per character, accepted."""
        bits, n, n_letters = self.entropy(texts)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(best)), best]
        accepted = (n_letters > 0) & (least <= SLACK * self.mean[best] + WIDTH * self.deviation[best] / np.sqrt(n))
        sure = np.where(n_letters > 0, self._confidence(bits, n, self.temperature)[np.arange(len(best)), best], 0.0)
        return [self.langs[j] if x else "und" for j, x in zip(best, n_letters > 0, strict=True)], sure, least, accepted


def fit(docs: DataFrame, labelled: Column | None = None, text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS) -> KneserNey | None:
    """Models from the rows with a language (and labelled, if given); None if there is none."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= sample_chars // 8))
    rows = (rows.where(labelled) if labelled is not None else rows).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    there = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).where("n > 0").collect()
    if not there:
        return None
    share = F.element_at(F.create_map(*[x for r in there for x in (F.lit(r["lang"]), F.lit(sample_chars / r["n"]))]), F.col("lang"))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["lang", "text"]).collect()
    if not sample:  # few and long texts: the hash took none of them
        sample = rows.dropDuplicates(["lang"]).collect()
    return KneserNey([(r["lang"], r["text"]) for r in sample])


def identify(docs: DataFrame, model: KneserNey | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score, cross_entropy and accepted, their names after prefix, in place of columns of these names."""
    added = [f"{prefix}{c}" for c in ("lang_pred", "score", "cross_entropy", "accepted")]
    docs = docs.drop(*added)
    if model is None:
        return docs.withColumns(dict(zip(added, (F.lit("und"), F.lit(0.0), F.lit(None).cast("double"), F.lit(False)), strict=True)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by sample_chars n-grams per language
    types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, text_col)
            for a, b in slices(texts):
                found = [pa.array(x, t) for x, t in zip(shared.value.predict(texts[a:b]), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in batch.columns), *found], [*batch.schema.names, *added])

    schema = docs.limit(0).withColumns(dict(zip(added, (F.lit(""), F.lit(0.0), F.lit(0.0), F.lit(True)), strict=True))).schema
    return map_batches(docs, run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    model = fit(docs, ~F.col("held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted")
