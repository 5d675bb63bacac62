"""Hashes of words and word windows in numpy, and their exchange between batches of documents as compact blocks.

A batch is a few megabytes of documents, chosen by a hash of the row, so it has the same rows whenever it is computed
again. Each batch sends, to each of many hash ranges (buckets), its distinct hashes there as sorted differences; a bucket
sees the hashes of all batches, once per batch, and answers each batch. A hash that very many documents share therefore
costs a bucket one entry for each batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a batch and hashes in a bucket, about.
BATCH_BYTES, BUCKET_HASHES = 3 << 20, 1_500_000

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _inverse(odd: np.uint64) -> np.uint64:
    x = pow(int(odd), -1, 1 << 64)
    return np.uint64(x)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[str | None], lower: bool = False, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of anything but blank and bytes 9 to 13) of all texts, one after another, and the
    place where each text's begin, with the total at the end. lower: A-Z count as a-z."""
    hashes, counts, part, size = [], [], [], 0

    def flush():
        nonlocal part, size
        if not part:
            return
        data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        if lower:
            data = _LOWER[data]
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        change = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            change = np.concatenate(([0], change))
        start, end = change[::2], change[1::2]
        start = start[: len(end)]
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, n)[:n], out=sums[1:], dtype=np.uint64)
        back = powers(_inverse(_P), n)
        hashes.append(mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)))
        edges = np.cumsum([len(x) + 1 for x in part])
        counts.append(np.diff(np.searchsorted(start, np.concatenate(([0], edges)))))
        part, size = [], 0

    for text in texts:
        part.append((text or "").encode())
        size += len(part[-1]) + 1
        if size >= at_once:
            flush()
    flush()
    all_hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    all_counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return all_hashes, np.concatenate(([0], np.cumsum(all_counts))).astype(np.int64)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, from every place that has so many after it."""
    size = len(words)
    if size < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(words * powers(_Q, size)[:size], out=sums[1:], dtype=np.uint64)
    return mix((sums[n:] - sums[:-n]) * powers(_inverse(_Q), size)[: size - n + 1] + np.uint64(n))


def inside(starts: np.ndarray, n: int) -> np.ndarray:
    """Places, in order, from which n words lie in one document."""
    size = np.diff(starts) - (n - 1)
    size = np.maximum(size, 0)
    total = int(size.sum())
    first = np.repeat(starts[:-1] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    return np.arange(total, dtype=np.int64) + first


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed_sorted(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "u8"), dtype=np.uint64)


def packed_bits(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def unpacked_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), count=n).astype(bool)


def bucket_edges(values: np.ndarray, bits: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that the sorted values (below 2**bits) fall in, and where each one's begin, with the total at the end."""
    own = ((values >> np.uint64(max(0, bits - 32))) * np.uint64(buckets)) >> np.uint64(min(32, bits))
    found, at = np.unique(own, return_index=True)
    return found.astype(np.int64), np.concatenate((at, [len(values)]))


def plan(df: DataFrame, text: str) -> dict:
    """Batches, buckets and hash bits for the table's whole size, which Spark counts."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    words = max(1, size // 4)
    return {"batches": -(-size // BATCH_BYTES) or 1, "buckets": -(-words // BUCKET_HASHES), "bits": min(64, max(40, words.bit_length() + 13))}


def batched(df: DataFrame, batches: int, text: str, doc_id: str) -> DataFrame:
    """df with __batch, dealt by it; the same rows always go together."""
    batch = F.pmod(F.xxhash64(doc_id, text), F.lit(batches)).cast("long")
    return df.withColumn("__batch", batch).repartition("__batch")


def ordered(table: pa.Table, text: str, doc_id: str) -> tuple[pa.Table, list, np.ndarray]:
    """A batch's rows in the order of (doc_id, nulls first, text); its texts; its doc_ids as int64 (null: the least)."""
    table = table.sort_by([(doc_id, "ascending"), (text, "ascending")])
    ids = table.column(doc_id).cast(pa.int64()).combine_chunks()
    if ids.null_count:  # pyarrow puts nulls last
        n = len(ids) - ids.null_count
        table = pa.concat_tables([table.slice(n), table.slice(0, n)])
        ids = table.column(doc_id).cast(pa.int64()).combine_chunks()
    numbers = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    return table, table.column(text).to_pylist(), numbers
