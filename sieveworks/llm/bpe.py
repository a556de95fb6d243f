"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last sixteen characters cuts every text where its low bits are zero, so
passages that documents share are cut alike wherever they stand.  A worker encodes each chunk once
and keeps it in a dictionary of bounded size; the bound costs repeated work, never results.

Chunks encoded apart are wrong near their ends.  Between a character that is no white space and
one that is, the pre-tokenizer always breaks: no pre-token has white space after its first
character, and none is longer to the left of such a place for what stands to the right of it.
Each join is therefore re-encoded from the last such place of the left chunk to the first one of
the right chunk, if both chunks' own tokens end there; if a chunk has none the window takes the
whole chunk and the next one, until both sides agree.  Every document is decoded and held against its text.

The literal text of a special token is that token, as in the tokenizers library; it separates
segments that are encoded by themselves.

A null or empty text has no tokens: both digests are those of no bytes.  Repeated rows get a row
each.  An empty table gives no rows.  Columns other than the two named ones are not read.
"""

from __future__ import annotations

import base64
import re
from collections import OrderedDict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .batches import codepoints, held, map_batches, slices, starts_of, texts_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = {"<|endoftext|>": 50256}
WINDOW, CUT_BITS, REUSE_CHARS = 16, 10, 4_000_000

_break = re.compile(r"(?<=\S)(?=[ \t\r\n])")
_last_break = re.compile(r".*\S(?=[ \t\r\n])", re.DOTALL)


def cut_points(lengths: list[int], text: str) -> list[np.ndarray]:
    """For each of the texts that were joined into one: where its chunks end, the end of the text included."""
    table = np.random.default_rng(16).integers(0, 2**63, 4096, dtype=np.uint64)
    h = table[codepoints(text) & 4095] if text else np.zeros(0, np.uint64)
    for width in (1, 2, 4, 8):  # after width w, h is the hash of the last 2w characters
        h[width:] = h[width:] + (h[:-width] << np.uint64(width))
    cuts = np.flatnonzero((h >> np.uint64(20)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1
    starts = starts_of(np.array(lengths, np.int64))
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        own = cuts[np.searchsorted(cuts, a + WINDOW, "left") : np.searchsorted(cuts, b, "left")] - a
        out.append(np.append(own, b - a) if b > a else own[:0])
    return out


class Encoder:
    """Encodes and decodes with one vocabulary; keeps chunks for reuse."""

    def __init__(self, ranks: str, special: dict[str, int], reuse_chars: int = REUSE_CHARS):
        with open(ranks, "rb") as f:
            vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self._special = special
        self._split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self._bytes = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for token, i in [*vocabulary.items(), *((s.encode(), i) for s, i in special.items())]:
            self._bytes[i] = token
        self._size = np.array([len(x) for x in self._bytes], np.int64)
        self._kept: OrderedDict[str, tuple] = OrderedDict()
        self._kept_chars, self._most = 0, reuse_chars
        self.encoded_chars = 0

    def _encode(self, text: str) -> np.ndarray:
        self.encoded_chars += len(text)
        return np.array(self._coder.encode_ordinary(text), np.uint32)

    def _chunk(self, text: str) -> tuple:
        """ids; then of the first and the last break, at which its own tokens end: token index and text beyond."""
        if found := self._kept.get(text):
            self._kept.move_to_end(text)
            return found
        ids = self._encode(text)
        first = _break.search(text)
        made = (ids, None, "", 0, "")
        if first:
            head, at = text[: first.start()], _last_break.match(text).end()
            ends, total = np.cumsum(self._size[ids]), len(text.encode())
            to = (len(head.encode()), total - len(text[at:].encode()))
            i, j = (int(np.searchsorted(ends, x)) for x in to)
            if ends[i] == to[0] and ends[j] == to[1]:
                made = (ids, i + 1, head, j + 1, text[at:])
        self._kept[text] = made
        self._kept_chars += len(text)
        while self._kept_chars > self._most:
            self._kept_chars -= len(self._kept.popitem(last=False)[0])
        return made

    def _segment(self, text: str, ends: np.ndarray) -> list[np.ndarray]:
        parts: list[np.ndarray] = []
        seam, begin, last = None, 0, len(ends) - 1  # seam: text since the last break, not yet encoded
        for k, end in enumerate(ends.tolist()):
            piece = text[begin:end]
            begin = end
            if k == 0 == last:
                return [self._chunk(piece)[0]]
            ids, i, head, j, tail = self._chunk(piece)
            if i is None:
                seam = (seam or "") + piece
                continue
            if seam is None:
                i = 0
            elif seam + head:
                parts.append(self._encode(seam + head))
            if k == last:
                parts.append(ids[i:])
                return parts
            parts.append(ids[i:j])
            seam = tail
        parts.append(self._encode(seam))
        return parts

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        segments = [self._split.split(t) if self._split else [t] for t in texts]
        plain = [s for x in segments for s in x[::2]]
        cuts = iter(cut_points([len(s) for s in plain], "".join(plain)))
        out = []
        for x in segments:
            parts = []
            for k, s in enumerate(x):
                parts += [np.array([self._special[s]], np.uint32)] if k % 2 else self._segment(s, ends) if len(ends := next(cuts)) else []
            out.append(np.concatenate(parts) if parts else np.zeros(0, np.uint32))
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def encoder(ranks: str = RANKS, special: dict[str, int] = SPECIAL) -> Encoder:
    """This worker's encoder; it stays for later tasks of the operator."""
    key, kept = (ranks, *special.items()), held("bpe")
    if key not in kept:
        kept[key] = Encoder(ranks, special)
    return kept[key]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, special: dict[str, int] = SPECIAL, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids the token ids too."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks, special)
        for batch in batches:
            names, texts = batch.column(0), texts_of(batch, "text")
            for a, b in slices(texts):
                n, ids_sha, text_sha, kept = [], [], [], []
                for text, ids in zip(texts[a:b], coder.encode_all(texts[a:b]), strict=True):
                    decoded = coder.decode(ids)
                    if decoded != text:
                        raise ValueError("a document's tokens do not decode to its text")
                    n.append(len(ids))
                    ids_sha.append(sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        kept.append(ids.astype(np.int32))
                columns = [names.slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)] + [pa.array(kept, pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text"), run, schema, "bpe")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
