"""Language-model scores by prediction by partial matching over bytes.

A text is its words, A-Z lower-cased, one space between two of them, and one end.  Each byte is predicted in
the context of the ORDER bytes before it, whatever words they belong to; the end of a text stands before
its first byte.  A symbol that a context has not seen escapes to the context without its oldest byte, and
so on to all symbols alike; on each escape the symbols that the longer context has seen are excluded, so the
probabilities of a context sum to one.  The longest contexts count occurrences, the shorter ones the
distinct longer contexts (update exclusion), as they predict what is new.  Escape probabilities are
estimated from the corpus: by order, count and number of symbols of a context, the share of occurrences
that are new to their context when met after all its others.

The trie covers every training text and grows with the corpus; no machine holds it.  A gram is a context and its symbol,
ORDER + 1 bytes in one number with the last byte of the context foremost, so a node's subtrie is a range of sorted numbers.
Each block of documents asks for its distinct grams and words, in one row for each part of the trie; a part holds every gram
whose context ends in the same three bytes, and sums, estimates and codes them.  Contexts of two
bytes and fewer are summed over the parts: 256**3 counts at most, whatever the corpus.  Code lengths go back to the
blocks that asked, where documents are scored.  Words are known by 63 bits of a hash.

A null or empty text is the end alone.  With nothing to train on, train_tokens is 0 and symbols are
alike.  Repeated rows count as often as they occur, and get a row each.  A null identifier trains
as crc32 of null, that is, not at all.  An empty table gives no rows.  Only the identifier, the text
and the named flag and block are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import map_batches, mixed, slices, starts_of, strings, texts_of, word_hashes
from .common import stored

#: Bytes of the longest context; of those that a part has in common.
ORDER, SHARED = 5, 3
#: 0xFF is no byte of UTF-8 and stands for the end of a text.
END, SYMBOLS = 255, 256
#: Keys held before they are merged; text of a block; parts of the trie at least, and text for each part beyond.
MERGE_KEYS, BLOCK_BYTES, LEAST_PARTS, PART_BYTES = 4_000_000, 64_000_000, 64, 50_000_000
_U = np.uint64
_WORD = _U(1 << 63)
#: The end of a text as a word.
TEXT_END = int(mixed(np.array([1], np.uint64))[0] | _WORD)
_SYMBOL = _U(255)


def bytes_of(text: str) -> bytes:
    """bytes.split cuts at \\x20 and \\x09-\\x0D, bytes.lower changes A-Z alone."""
    return b" ".join(text.encode("utf-8", "replace").lower().split())


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the texts, each with its end, one after the other; where each text's begin."""
    pad = bytes([END]) * ORDER
    x = np.frombuffer(b"".join(pad + t + b"\xff" for t in texts), np.uint8).astype(np.uint64)
    out = x.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= x[:-k] << _U(8 * (ORDER + 1 - k))
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = starts_of(lengths)
    return out[np.arange(starts[-1]) + np.repeat(np.arange(1, len(texts) + 1) * ORDER, lengths)], starts


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the texts' words, each text with its end; where each text's begin."""
    h, starts = word_hashes(texts)
    n = np.diff(starts)
    ends = starts_of(n + 1)
    out = np.full(ends[-1], TEXT_END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(texts)), n)] = h | _WORD
    return out, ends


def shorter(grams: np.ndarray, order: int) -> np.ndarray:
    """Grams of the longest context cut to one of that order."""
    return (grams >> _U(8 * (ORDER + 1 - order))) << _U(8) | (grams & _SYMBOL)


def cut(grams: np.ndarray) -> np.ndarray:
    """Grams without the oldest byte of their context."""
    return (grams >> _U(16)) << _U(8) | (grams & _SYMBOL)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    return own, np.bincount(at, np.concatenate(counts), len(own)).astype(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: of grams by the last bytes of the context, of words by themselves."""
    of = np.where(keys >= _WORD, keys, keys >> _U(8 * (ORDER + 1 - SHARED)))
    return (mixed(of, 9) % _U(parts)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Numbers of 64 bits, byte by byte of equal weight, which compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(x: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(kind).ravel()


class Order:
    """The contexts of one order: sorted grams, counts, and of each gram's context count and symbols."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.grams, self.n = grams, n.astype(np.float64)
        self.contexts, self.at = np.unique(grams >> _U(8), return_inverse=True)
        self.total = np.bincount(self.at, self.n, len(self.contexts))
        self.kinds = np.bincount(self.at, minlength=len(self.contexts))

    def below(self, order: int) -> Order:
        """The next shorter contexts; they count distinct longer ones."""
        return Order(*np.unique(cut(self.grams), return_counts=True))

    def events(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """By class, new and known symbols, when each occurrence is met after all others of its context."""
        ok = self.total > 1
        once = np.bincount(self.at, self.n == 1, len(self.contexts))[ok]
        n, q = self.total[ok], self.kinds[ok]
        return np.bincount(escape_class(order, n - 1, q - 1), once, ESCAPE_CLASSES), np.bincount(escape_class(order, n - 1, q), n - once, ESCAPE_CLASSES)

    def blended(self, order: int, below: np.ndarray, escape: np.ndarray) -> None:
        """Probabilities of the grams, and what of the order below is left to a symbol that a context has not seen."""
        e = np.where(self.kinds >= SYMBOLS, 0.0, escape[escape_class(order, self.total, self.kinds)])
        shut = np.bincount(self.at, below, len(self.contexts))
        self.p = (1 - e)[self.at] * self.n / self.total[self.at]
        self.left = e / np.maximum(1 - shut, 1e-12)

    def predict(self, grams: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probabilities of grams of this order, given those of the order below."""
        if not len(self.grams):
            return below
        i = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        j = np.minimum(np.searchsorted(self.contexts, grams >> _U(8)), len(self.contexts) - 1)
        known = self.contexts[j] == grams >> _U(8)
        return np.where(self.grams[i] == grams, self.p[i], np.where(known, self.left[j] * below, below))


ESCAPE_CLASSES = (ORDER + 1) * 32 * 32


def escape_class(order: int, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Order, count and number of symbols of a context, coarser as they grow."""
    return (order * 32 + np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), 31)) * 32 + np.minimum(q, 31).astype(np.int64)


def orders_of(grams: np.ndarray, n: np.ndarray, top: int, low: int) -> list[Order]:
    """Orders low to top, from the grams of order top."""
    out = [Order(grams, n)]
    for k in range(top - 1, low - 1, -1):
        out.insert(0, out[0].below(k))
    return out


def low_predict(low: list[Order], grams: np.ndarray) -> np.ndarray:
    """Probabilities of grams of order SHARED - 1."""
    p = np.full(len(grams), 1 / SYMBOLS)
    for k, order in enumerate(low):
        own = (grams >> _U(8 * (SHARED - k))) << _U(8) | (grams & _SYMBOL)
        p = order.predict(own, p)
    return p


def fit_low(grams: np.ndarray, n: np.ndarray, events: np.ndarray) -> tuple[list[Order], np.ndarray]:
    """The short contexts, and escape probabilities from the events of all orders; events has those of the longer ones."""
    low, events = orders_of(grams, n, SHARED - 1, 0), events.copy()
    for k, order in enumerate(low):
        events += np.stack(order.events(k))
    escape = (events[0] + 0.5) / (events.sum(axis=0) + 1.0)
    p = np.full(len(low[0].grams), 1 / SYMBOLS)
    for k, order in enumerate(low):
        order.blended(k, p, escape)
        if k + 1 < len(low):
            p = order.predict(cut(low[k + 1].grams), np.zeros(len(low[k + 1].grams)))
    return low, escape


def log10_of(asked: np.ndarray, grams: np.ndarray, n: np.ndarray, low: list[Order], escape: np.ndarray) -> np.ndarray:
    """log10 probabilities of the asked grams of a part, whose training grams are given."""
    p = low_predict(low, shorter(asked, SHARED - 1))
    orders = orders_of(grams, n, ORDER, SHARED)
    below = low_predict(low, cut(orders[0].grams))
    for k, order in enumerate(orders, SHARED):
        order.blended(k, below, escape)
        p = order.predict(shorter(asked, k), p)
        if k < ORDER:
            above = orders[k + 1 - SHARED].grams
            below = order.predict(cut(above), np.zeros(len(above)))
    return np.log10(p)


def _asked(docs: DataFrame, parts: int) -> DataFrame:
    """(block, part, keys, counts): the sorted distinct keys of every block, with their counts in its training texts."""
    names = ["block", "part", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        sizes: dict[int, int] = {}

        def flush(block: int) -> pa.RecordBatch:
            keys, counts = merged(*held.pop(block))
            part = part_of(keys, parts)
            order = np.argsort(part, kind="stable")
            keys, counts = keys[order], counts[order]
            own, at = np.unique(part[order], return_index=True)
            ends = np.append(at[1:], len(keys))
            rows = [[packed(x[a:b]) for a, b in zip(at, ends, strict=True)] for x in (keys, counts)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block, np.int64)), pa.array(own.astype(np.int32)), *(pa.array(r, pa.binary()) for r in rows)], names)

        for batch in batches:
            texts = texts_of(batch, "text")
            blocks, train = batch.column("block").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            for block in np.unique(blocks).tolist():
                for flag in (True, False):
                    own = [bytes_of(texts[i]) for i in np.flatnonzero((blocks == block) & (train == flag)).tolist()]
                    for a, b in slices(own):
                        for keys in (grams_of(own[a:b])[0], words_of(own[a:b])[0]):
                            kinds, n = np.unique(keys, return_counts=True)
                            into = held.setdefault(block, ([], []))
                            into[0].append(kinds)
                            into[1].append(n if flag else np.zeros(len(n), np.int64))
                            sizes[block] = sizes.get(block, 0) + len(kinds)
                        if sizes[block] > MERGE_KEYS:
                            keys, counts = merged(*held[block])
                            held[block], sizes[block] = ([keys], [counts]), 0
        for block in list(held):
            yield flush(block)

    return map_batches(docs.select("block", "train", "text"), run, "block bigint, part int, keys binary, counts binary")


def ppm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train", block_col: str = "block") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    block_col is any bigint that rows which are read together share, best one of the input split; blocks of more than
    BLOCK_BYTES of text on average are cut by a hash of the text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(train_col), F.lit(False)).alias("train"), F.coalesce(F.col(block_col), F.lit(0)).cast("bigint").alias("block"))
    volume = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)).alias("bytes"), F.approx_count_distinct("block").alias("blocks")).first()
    pieces = int(volume["bytes"] // (BLOCK_BYTES * max(1, volume["blocks"])) + 1)
    parts = int(max(LEAST_PARTS, volume["bytes"] // PART_BYTES))
    if pieces > 1:
        docs = docs.withColumn("block", F.xxhash64("block", F.pmod(F.xxhash64("text"), F.lit(pieces))))
    asked, _ = stored(_asked(docs, parts), "asked")

    def gather(table: pa.Table) -> pa.Table:
        """The part's counts in one row; counts of shorter contexts and events of longer ones, a row each; totals of words."""
        keys, counts = merged(*([unpacked(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("keys", np.uint64), ("counts", np.int64))))
        seen = counts > 0
        word = keys >= _WORD
        orders = orders_of(keys[seen & ~word], counts[seen & ~word], ORDER, SHARED)
        low = orders[0].below(SHARED - 1)
        events = np.sum([order.events(k) for k, order in enumerate(orders, SHARED)], axis=0).astype(np.int64)
        some = np.flatnonzero(events.sum(axis=0))
        kind = np.repeat([0, 1, 2, 3], [1, len(low.grams), len(some), 1]).astype(np.int32)
        totals = int(counts[word].sum()), int((seen & word).sum())
        a = np.concatenate([[0], low.grams.astype(np.int64), some, [0]])
        b = np.concatenate([[0], low.n.astype(np.int64), events[0][some], [totals[0]]]).astype(np.int64)
        c = np.concatenate([[0], np.zeros(len(low.grams), np.int64), events[1][some], [totals[1]]]).astype(np.int64)
        none = [None] * (len(kind) - 1)
        blobs = [pa.array([packed(x[seen])] + none, pa.binary()) for x in (keys, counts)]
        part = pa.array(np.full(len(kind), table.column("part")[0].as_py(), np.int32))
        return pa.table([part, pa.array(kind), *map(pa.array, (a, b, c)), *blobs], ["part", "kind", "a", "b", "c", "keys", "counts"])

    kind = "part int, kind int, a bigint, b bigint, c bigint, keys binary, counts binary"
    trie, _ = stored(asked.groupBy("part").applyInArrow(gather, kind), "trie")
    # 256**3 contexts and symbols and ESCAPE_CLASSES classes at most
    sums = trie.where("kind > 0").groupBy("kind", "a").agg(F.sum("b").alias("b"), F.sum("c").alias("c")).collect()
    short = np.array(sorted((r["a"], r["b"]) for r in sums if r["kind"] == 1), np.int64).reshape(-1, 2)
    events = np.zeros((2, ESCAPE_CLASSES))
    for r in sums:
        if r["kind"] == 2:
            events[:, r["a"]] += r["b"], r["c"]
    n_train, v_train = next(((r["b"], r["c"]) for r in sums if r["kind"] == 3), (0, 0))
    model = spark.sparkContext.broadcast(fit_low(short[:, 0].astype(np.uint64), short[:, 1], events))

    def answer(rows: pa.Table, own: pa.Table) -> pa.Table:
        """For each block's row, its keys and a value for each: log10 probabilities of grams, counts of words."""
        keys, counts = (unpacked(own.column(c)[0].as_py(), kind) for c, kind in (("keys", np.uint64), ("counts", np.int64))) if own.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        cutoff = np.searchsorted(keys, _WORD)
        every = [unpacked(x) for x in rows.column("keys").to_pylist()]
        distinct = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        ends = np.searchsorted(distinct, _WORD)
        value = np.zeros(len(distinct))
        value[:ends] = log10_of(distinct[:ends], keys[:cutoff], counts[:cutoff], *model.value)
        known = np.searchsorted(distinct, keys[cutoff:])
        value[known] = counts[cutoff:]
        values = [packed(value[np.searchsorted(distinct, x)]) for x in every]
        return pa.table({"block": rows.column("block"), "keys": rows.column("keys"), "found": pa.array(values, pa.binary())})

    own = trie.where("kind = 0").select("part", "keys", "counts")
    answers = asked.select("part", "block", "keys").groupBy("part").cogroup(own.groupBy("part")).applyInArrow(answer, "block bigint, keys binary, found binary")
    scale = float(n_train) + 0.5 * (v_train + 1)

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.uint64), *(unpacked(x) for x in known.column("keys").to_pylist())])
        value = np.concatenate([np.zeros(0), *(unpacked(x, np.float64) for x in known.column("found").to_pylist())])
        order = np.argsort(keys)
        keys, value = keys[order], value[order]
        out: list[list] = [[] for _ in range(4)]
        texts = [bytes_of(x or "") for x in strings(rows.column("text").combine_chunks())]
        for a, b in slices(texts):
            (grams, at), (words, ends) = grams_of(texts[a:b]), words_of(texts[a:b])
            kinds, place = np.unique(grams, return_inverse=True)
            c = value[np.searchsorted(keys, words)]
            found = np.diff(ends), np.add.reduceat(c > 0, ends[:-1], dtype=np.int64), np.add.reduceat(np.log10((c + 0.5) / scale), ends[:-1]), np.add.reduceat(value[np.searchsorted(keys, kinds)][place], at[:-1])
            for column, x in zip(out, found, strict=True):
                column.append(x)
        columns = [pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t)) for x, t in zip(out, (np.int64, np.int64, np.float64, np.float64), strict=True)]
        return pa.table([rows.column("doc_id"), rows.column("train"), *columns], ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {id_type}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(n_train)).cast("bigint").alias("train_tokens"), "base_score", "score")


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    return ppm_scores(docs.select("doc_id", "text", train.alias("train"), split.alias("block")))
