"""Substring deduplication by fixed-block anchors.

Words are runs of anything but blank and bytes 9 to 13. A passage of WINDOW words is removed where it also starts
earlier (a smaller doc_id, or the same document before). Blocks of half a window, at every multiple of that length in
every document, are the index; each rolling window of block length of every document probes it. A repeated passage of
WINDOW words always holds a whole block, so its places are among those where a block that occurs twice lies in the first
half: hits are extended there to the full windows, whose hashes, compared over all documents, give the exact repeats,
and the windows that follow each other make the maximal ones.

All exchange runs on hashes by batches and buckets (see fingerprints): the documents themselves are dealt once.
Block probes use hashes of 40 bits or more, by the size of the corpus, and only select; windows are equal if their
64-bit hashes are.

Cases: null texts have no words and give an empty kept text, as do empty ones; rows with equal doc_id and text are one
document and get the same result; equal doc_ids with different texts are ordered by text hash; a null doc_id comes
first; ids of other types than whole numbers are an error; documents of any length are read whole; documents shorter than
a window stay, words joined by one blank.
"""

from __future__ import annotations

import re
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.llm import fingerprints as fp
from rankflow.llm.common import WORD, same_name

WINDOW = 20

_WORDS = re.compile(WORD)


def _distinct(table: pa.Table, text: str, doc_id: str):
    """Texts, doc_ids and text hashes of a batch's documents, each once, in order."""
    table, texts, ids = fp.ordered(table, text, doc_id)
    keys = table.column("__key").to_numpy()
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    order = np.lexsort((keys[first], ids[first]))
    at = np.flatnonzero(first)[order]
    return [texts[i] for i in at], ids[at], keys[at]


def _blocks(texts: list, block: int, bits: int):
    """Words; documents' starts; places of rolling blocks; their hashes; whether each stands at a multiple."""
    words, starts = fp.word_hashes(texts)
    places = fp.inside(starts, block)
    hashes = fp.window_hashes(words, block)[places] >> np.uint64(64 - bits)
    own = starts[np.searchsorted(starts, places, side="right") - 1]
    return words, starts, places, hashes, (places - own) % block == 0


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """df with kept_text (string), n_words and n_removed (long)."""
    if not isinstance(df.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} is {df.schema[doc_id].dataType.simpleString()}: documents need whole numbers, in whose order a window is earlier")
    block, size = max(1, window // 2), fp.plan(df, text)
    bits, buckets = size["bits"], size["buckets"]
    added = ["kept_text", "n_words", "n_removed"]
    clean = df.drop(*(c for a in [*added, "__key", "__batch"] for c in same_name(df, a)))
    docs = fp.batched(clean.withColumn("__key", F.xxhash64(text)), size["batches"], text, doc_id)

    def probe(table: pa.Table) -> pa.Table:
        texts, _, _ = _distinct(table, text, doc_id)
        _, _, _, hashes, anchor = _blocks(texts, block, bits)
        found, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        indexed = np.zeros(len(found), bool)
        indexed[inverse[anchor]] = True
        own, edges = fp.bucket_edges(found, bits, buckets)
        parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
        return pa.table(
            {
                "bucket": pa.array(own, pa.int64()),
                "batch": pa.array([table.column("__batch")[0].as_py()] * len(own), pa.int64()),
                "hashes": pa.array([fp.packed_sorted(found[p]) for p in parts], pa.binary()),
                "indexed": pa.array([fp.packed_bits(indexed[p]) for p in parts], pa.binary()),
                "many": pa.array([fp.packed_bits(counts[p] > 1) for p in parts], pa.binary()),
            }
        )

    def look_up(table: pa.Table) -> pa.Table:
        parts = [fp.unpacked_sorted(x) for x in table.column("hashes").to_pylist()]
        sizes = list(map(len, parts))
        every = np.concatenate(parts)
        indexed = np.concatenate([fp.unpacked_bits(x, n) for x, n in zip(table.column("indexed").to_pylist(), sizes)])
        many = np.concatenate([fp.unpacked_bits(x, n) for x, n in zip(table.column("many").to_pylist(), sizes)])
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.diff(every[order], prepend=every[order[:1]] + np.uint64(1)))
        uses = np.add.reduceat(1 + many[order].astype(np.int64), first)
        known = np.add.reduceat(indexed[order].astype(np.int64), first)
        hit = np.empty(len(every), bool)
        hit[order] = np.repeat((uses > 1) & (known > 0), np.diff(np.concatenate((first, [len(every)]))))
        edges = np.concatenate(([0], np.cumsum(sizes)))
        return pa.table(
            {
                "batch": table.column("batch"),
                "bucket": table.column("bucket"),
                "hit": pa.array([fp.packed_bits(hit[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
            }
        )

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, ids, keys = _distinct(table, text, doc_id)
        words, starts, places, hashes, _ = _blocks(texts, block, bits)
        found, inverse = np.unique(hashes, return_inverse=True)
        own, edges = fp.bucket_edges(found, bits, buckets)
        hit = np.zeros(len(found), bool)
        for bucket, data in zip(answers.column("bucket").to_pylist(), answers.column("hit").to_pylist()):
            k = int(np.searchsorted(own, bucket))
            hit[edges[k] : edges[k + 1]] = fp.unpacked_bits(data, edges[k + 1] - edges[k])
        at = np.zeros(len(words) + 1, np.int64)
        at[places[hit[inverse]] + 1] = 1
        before = np.cumsum(at)
        windows = fp.inside(starts, window)
        windows = windows[before[windows + window - block] > before[windows]]
        whole = fp.window_hashes(words, window)[windows] if len(windows) else np.zeros(0, np.uint64)
        values, first = np.unique(whole, return_index=True)
        places = windows[first]
        own, edges = fp.bucket_edges(values, 64, buckets)
        out = {"bucket": own.tolist(), "batch": [], "hashes": [], "places": [], "starts": [], "ids": [], "keys": []}
        for a, b in zip(edges[:-1], edges[1:]):
            docs_in = np.unique(np.searchsorted(starts, places[a:b], side="right") - 1)
            out["batch"].append(table.column("__batch")[0].as_py())
            out["hashes"].append(fp.packed_sorted(values[a:b]))
            out["places"].append(fp.packed(places[a:b].astype("u4")))
            out["starts"].append(fp.packed(starts[docs_in].astype("u4")))
            out["ids"].append(fp.packed(ids[docs_in].view("u8")))
            out["keys"].append(fp.packed(keys[docs_in].view("u8")))
        return pa.table(out, schema=_EXTENDED)

    def settle(table: pa.Table) -> pa.Table:
        columns = table.to_pydict()
        parts = [fp.unpacked_sorted(x) for x in columns["hashes"]]
        places = [fp.unpacked(x, "u4") for x in columns["places"]]
        ids, keys, offsets = [], [], []
        for own, first, i, k in zip(places, columns["starts"], columns["ids"], columns["keys"]):
            first = fp.unpacked(first, "u4")
            doc = np.searchsorted(first, own, side="right") - 1
            ids.append(fp.unpacked(i, "u8").view("i8")[doc])
            keys.append(fp.unpacked(k, "u8").view("i8")[doc])
            offsets.append(own - first[doc])
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        repeated = np.zeros(len(every), bool)
        repeated[order[1:]] |= same
        repeated[order[:-1]] |= same
        some = np.flatnonzero(repeated)
        by_place = some[np.lexsort((np.concatenate(offsets)[some], np.concatenate(keys)[some], np.concatenate(ids)[some], every[some]))]
        later = np.zeros(len(every), bool)
        later[by_place[1:]] = every[by_place[1:]] == every[by_place[:-1]]
        edges = np.concatenate(([0], np.cumsum(list(map(len, parts)))))
        return pa.table({"batch": columns["batch"], "places": [fp.packed(p[later[a:b]]) for p, a, b in zip(places, edges[:-1], edges[1:])]}, schema=_SETTLED)

    def remove(table: pa.Table, later: pa.Table) -> pa.Table:
        texts, ids, keys = _distinct(table, text, doc_id)
        words, starts = fp.word_hashes(texts)
        covered = np.zeros(len(words) + 1, np.int64)
        windows = fp.inside(starts, window)
        if len(windows):
            whole = fp.window_hashes(words, window)
            values, first, inverse = np.unique(whole[windows], return_index=True, return_inverse=True)
            gone = np.ones(len(windows), bool)
            gone[first] = False  # in this batch, all places but the first of a window are later ones
            bad = [fp.unpacked(x, "u4") for x in later.column("places").to_pylist()]
            if bad:
                known = np.zeros(len(values), bool)
                known[np.searchsorted(values, whole[np.concatenate(bad).astype(np.int64)])] = True
                gone |= known[inverse]
            np.add.at(covered, windows[gone], 1)
            np.add.at(covered, windows[gone] + window, -1)
        removed = np.cumsum(covered)[:-1] > 0
        results = {}
        for k, value in enumerate(texts):
            own, found = removed[starts[k] : starts[k + 1]], _WORDS.findall(value or "")
            kept = compress(found, (~own).tolist()) if own.any() else found
            results[int(ids[k]), int(keys[k])] = (" ".join(kept), len(found), int(own.sum()))
        table, _, numbers = fp.ordered(table, text, doc_id)
        rows = [results[i, k] for i, k in zip(numbers.tolist(), table.column("__key").to_pylist())]
        out = table.drop_columns(["__key", "__batch"])
        for k, (name, kind) in enumerate(zip(added, (pa.string(), pa.int64(), pa.int64()))):
            out = out.append_column(name, pa.array([r[k] for r in rows], kind))
        return out

    probes = docs.groupBy("__batch").applyInArrow(probe, "bucket long, batch long, hashes binary, indexed binary, many binary")
    answers = probes.groupBy("bucket").applyInArrow(look_up, "batch long, bucket long, hit binary")
    extended = docs.groupBy("__batch").cogroup(answers.groupBy("batch")).applyInArrow(extend, "bucket long, batch long, hashes binary, places binary, starts binary, ids binary, keys binary")
    later = extended.groupBy("bucket").applyInArrow(settle, "batch long, places binary")
    schema = T.StructType([*clean.schema.fields, T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return docs.groupBy("__batch").cogroup(later.groupBy("batch")).applyInArrow(remove, schema)


_EXTENDED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), *((n, pa.binary()) for n in ("hashes", "places", "starts", "ids", "keys"))])
_SETTLED = pa.schema([("batch", pa.int64()), ("places", pa.binary())])

ORACLE_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
