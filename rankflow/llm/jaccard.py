"""N-gram Jaccard join by signature trees: which documents are linked, directly or by others, by the overlap of their
word shingles.

Words are lower-cased (A-Z) runs of anything but blank and bytes 9 to 13. A document's set is that of its distinct
n-word shingles; shorter documents have one shingle, the whole sequence. Two documents link if
100 * intersection >= percent * union. Every link between different sets is either found or lies inside a component.

1. Equal sets are one node, known by a 64-bit hash of size and shingles (two of N different sets share it with a
   probability of N * N / 2**65). Copies cost one row each and are never paired.
2. Keys: sets of a and b shingles that link differ in at most d = (a + b) (100 - percent) / (100 + percent) of them. Cut
   the hash range into more parts than that, and order a set's parts with shingles by how many they have: of the first
   d + 1 of each set one is the same in both, and its hash is a key. (With at most d differing parts, each set's first
   d + 1 hold a common one; the earlier of the two is in both.) Parts with many shingles are seldom equal by chance. A
   set with too few parts also takes the parts of other hash functions, and last its empty parts as keys, so no pair is
   lost. A task sends each key once for each BATCH_BYTES of text, so a key that a third of all documents have is a few
   rows a task. Nodes that share keys, directly or by others, form regions: the tops of the signature trees. (One tree
   over all documents has tops whose OR-ed bitmaps are full and prune nothing.)
3. Trees: a region (many small ones together, large ones cut by hash into chunks of TASK_WEIGHT) is searched in one
   task by dual traversal (see sigtree), with exact intersections at the end. Of each chunk of a large region, one
   document of the largest component goes on to a next pass, until one chunk is left.
4. In large regions keys are chosen again, now the parts that came least often there, as far as the COMMON_PARTS most
   frequent ones are known, so that a passage that many documents share makes none. (Any order of parts that all sets
   agree on loses no pair.) Keys whose nodes are still in several components are searched again: the nodes of a key
   with few in one tree; of keys with many, all nodes outside the largest component there, in chunks, against this
   component and each other, once for all keys with the same largest component.

Cases: null texts and texts without words have an empty set, link with nothing and are a component of their own; rows
that repeat are documents of one component; the least doc_id ignores nulls (null if there is no other); texts of any
length are read whole; other columns pass through.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rankflow.llm import fingerprints as fp
from rankflow.llm import sigtree
from rankflow.llm.common import same_name, small_batches, written
from rankflow.llm.graphs import components

WORDS, PERCENT = 3, 90
#: Weight (shingles and DOC_WEIGHT for each document) of a chunk of a region, about.
TASK_WEIGHT, DOC_WEIGHT = 500_000, 1000
#: Hash functions tried for sets with empty parts.
SALTS = 4
#: Parts of a set for each shingle that may differ: the more, the more of the parts with few shingles are passed over.
SPARE = 1.5
#: Bytes of text whose keys are put together.
BATCH_BYTES = 8 << 20
#: Part hashes whose number of nodes is known when keys of large regions are chosen. Any number gives the same links.
COMMON_PARTS = 100_000
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 50_000

_MASK = (1 << 64) - 1
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingle_sets(texts: list, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    hashes, starts = fp.word_hashes(texts, lower=True)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        own = hashes[a:b]
        out.append(np.unique(fp.window_hashes(own, min(words, len(own)))) if len(own) else own)
    return out


def set_hash(tokens: np.ndarray) -> np.uint64:
    return fp.mix(np.add.reduce(fp.mix(tokens ^ _K[0]), dtype=np.uint64)[None] + np.uint64(len(tokens) * int(_K[1]) & _MASK))[0]


class Parts:
    """The numbers of parts by size, for a least similarity of percent."""

    def __init__(self, percent: int):
        self.percent = percent

    def largest_partner(self, n: int) -> int:
        return 100 * n // self.percent

    def differing(self, a: int, b: int) -> int:
        """Most shingles that only one of two linked sets of these sizes has."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    @lru_cache(None)
    def edge(self, k: int) -> int:
        """Least size of class k. Classes begin at 1, each at twice the one before, or beyond its largest partner."""
        return 1 if k == 0 else max(2 * self.edge(k - 1), self.largest_partner(self.edge(k - 1)) + 1)

    def size_class(self, n: int) -> int:
        k = 0
        while self.edge(k + 1) <= n:
            k += 1
        return k

    def slots(self, tokens: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Lists of part hashes, those of the fullest parts first, and how many of each list are enough as keys. A
        pair's class is that of its larger set, so a set has lists for its own class and for its largest partner's."""
        n, out = len(tokens), []
        partner = self.largest_partner(n)
        if n == 0 or self.differing(n, partner) == 0:
            return out
        for k in sorted({self.size_class(n), self.size_class(partner)}):
            top = self.edge(k + 1) - 1
            parts = int(SPARE * (self.differing(top, top) + 1)) + 1
            most = self.differing(n, min(partner, top))
            for salt in range(SALTS):
                values = tokens if salt == 0 else np.sort(fp.mix(tokens ^ _K[salt]))
                part = ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                first = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
                sums = np.add.reduceat(fp.mix(values), first)
                tag = np.uint64((k * 16 + salt + 1) * int(_K[2]) & _MASK)
                own = fp.mix(sums + part[first] * _K[1] + tag)[np.lexsort((part[first], -np.diff(first, append=n)))]
                out.append((own, min(len(own), most + 1)))
                if len(own) > most:  # more parts with shingles than parts that can differ
                    break
            else:
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first])
                out.append((fp.mix(empty * _K[1] + np.uint64((k * 16 + 15) * int(_K[3]) & _MASK)), len(empty)))
        return out

    def keys(self, tokens: np.ndarray, common: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Keys of a set: every other set that links with it, but for equal ones, has one of them. common: part hashes
        (sorted) and how often they came; parts that came often are keys only where the others are not enough."""
        out = [np.zeros(0, np.uint64)]
        for own, enough in self.slots(tokens):
            if common is not None and len(common[0]):
                at = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
                own = own[np.argsort(np.where(common[0][at] == own, common[1][at], 0), kind="stable")]
            out.append(own[:enough])
        return np.concatenate(out)


def _byte_batches(batches, column: int, size: int):
    """Arrow batches put together, or cut, to about `size` bytes of a text column."""
    held, held_bytes = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + size - held_bytes)))
            held.append(batch.slice(start, end - start))
            held_bytes += int(ends[held[-1].num_rows + start - 1]) - before
            start += held[-1].num_rows
            if held_bytes >= size:
                yield pa.Table.from_batches(held)
                held, held_bytes = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _shared_within(nodes: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of some documents, with the least node of each; and distinct pairs (other node, that node)."""
    nodes, at = np.unique(nodes, return_index=True)
    owner = np.repeat(np.arange(len(at), dtype=np.uint32), [len(keys[i]) for i in at])
    values = np.concatenate([keys[i] for i in at]) if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")  # owners stay in order within a key
    values, owner = values[order], owner[order]
    new = np.diff(values, prepend=values[:1] ^ np.uint64(1)) != 0
    first = np.flatnonzero(new)
    least = np.repeat(owner[first], np.diff(first, append=len(values)))
    pair = np.unique((owner[~new].astype(np.uint64) << np.uint64(32)) | least[~new])
    pair = pair[(pair >> np.uint64(32)) != (pair & np.uint64(0xFFFFFFFF))]
    return values[first], nodes[owner[first]], nodes[(pair >> np.uint64(32)).astype(np.int64)], nodes[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def _profile(words: int, percent: int):
    """Function of batches (doc, key, text): kind 0, a row (doc, key, node, n) for each document; kind 1, (node, other)
    with a key of the node; kind 2, (node, other) of nodes that share a key."""
    parts = Parts(percent)

    def profile(batches):
        for table in _byte_batches(batches, 2, BATCH_BYTES):
            sizes, nodes, keys = [], [], []
            texts = table.column(2)
            for start in range(0, len(texts), 256):
                for tokens in shingle_sets(texts.slice(start, 256).to_pylist(), words):
                    sizes.append(len(tokens))
                    nodes.append(set_hash(tokens).view(np.int64))
                    keys.append(parts.keys(tokens))
            nodes = np.array(nodes, np.int64)
            docs = [table.column(0).combine_chunks(), table.column(1).combine_chunks(), pa.array(nodes), pa.array(sizes, pa.int64())]
            yield from _kind(0, *docs, pa.nulls(len(nodes), pa.int64()))
            shared, least, a, b = _shared_within(nodes, keys)
            for kind, node, other in ((1, least, shared.view(np.int64)), (2, a, b)):
                yield from _kind(kind, pa.nulls(len(node), table.column(0).type), pa.nulls(len(node), pa.int64()), pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(other))

    return profile


def _kind(kind: int, *columns: pa.Array):
    for start in range(0, len(columns[0]), OUT_ROWS):
        part = [c.slice(start, OUT_ROWS) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *part], names=["kind", "doc", "key", "node", "n", "other"])


def _parts_of(words: int, chosen):
    """Column function: chosen(set) of a text, an array of hashes."""

    @arrow_udf("array<long>")
    def parts_of(column: pa.Array) -> pa.Array:
        out = []
        for start in range(0, len(column), 256):
            out += [chosen(tokens).view(np.int64) for tokens in shingle_sets(column.slice(start, 256).to_pylist(), words)]
        return pa.array(out, pa.list_(pa.int64()))

    return parts_of


def _common_parts(texts: DataFrame, words: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The COMMON_PARTS part hashes that come most often in the texts, sorted, and how often."""
    slots = Parts(percent).slots
    every = _parts_of(words, lambda tokens: np.concatenate([np.zeros(0, np.uint64), *(own for own, _ in slots(tokens))]))
    counts = texts.select(F.explode(every("text")).alias("shared")).groupBy("shared").count().where("count > 1")
    top = counts.orderBy(F.desc("count"), "shared").limit(COMMON_PARTS).toPandas()
    shared, count = top["shared"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    order = np.argsort(shared)
    return shared[order], count[order]


_PAIRS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _search(words: int, percent: int):
    """Function of the rows of a task (region, part, node, label, large, text): kind 0, nodes a and b that link; kind 1,
    for each large region a node (a) of its largest component and the region (b). Rows of part 0 are searched among
    themselves, or, where part 1 has rows, against those."""

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("region", "ascending"), ("part", "ascending"), ("node", "ascending")])
        region, part, node, label = (table.column(c).to_numpy() for c in ("region", "part", "node", "label"))
        keep = np.ones(len(node), bool)
        keep[1:] = (region[1:] != region[:-1]) | (part[1:] != part[:-1]) | (node[1:] != node[:-1])
        table, region, part, node, label = table.filter(pa.array(keep)), region[keep], part[keep], node[keep], label[keep]
        large, texts = table.column("large").to_pylist(), table.column("text")
        edges = np.concatenate((np.flatnonzero(np.diff(region, prepend=region[:1] - 1)), [len(region)]))
        out = []
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            half = int((part[start:end] == 0).sum())
            if half == 0:  # no document of the other side fell in this chunk
                continue
            sets = shingle_sets(texts.slice(start, end - start).to_pylist(), words)
            bits = sigtree.bits_for(min(map(len, sets)))
            sizes, bitmaps = np.array([len(x) for x in sets]), np.vstack([sigtree.bitmap(x, bits) for x in sets])
            order = np.lexsort((sizes, np.array([x[0] if len(x) else 0 for x in sets], np.uint64), part[start:end]))
            sizes, bitmaps, nodes, labels = sizes[order], bitmaps[order], node[start:end][order], label[start:end][order].copy()
            sets = [sets[i] for i in order]
            crossing = half < end - start
            x = sigtree.Tree(bitmaps[:half], sizes[:half]) if crossing else sigtree.Tree(bitmaps, sizes)
            y = sigtree.Tree(bitmaps[half:], sizes[half:]) if crossing else x
            shift = half if crossing else 0

            def visit(i: int, j: int, sets=sets, nodes=nodes, labels=labels, sizes=sizes, shift=shift):
                j += shift
                if sigtree.similar(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), int(sizes[i]), int(sizes[j]), percent):
                    out.append((0, int(nodes[i]), int(nodes[j])))
                    labels[labels == labels[j]] = labels[i]

            sigtree.traverse(x, y, labels[: len(x.sizes)], labels[shift:], percent, visit)
            if large[start]:
                values, counts = np.unique(labels, return_counts=True)
                out.append((1, int(nodes[labels == values[counts.argmax()]].min()), int(region[start])))
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, t.type) for c, t in zip(columns, _PAIRS)], schema=_PAIRS)

    return search


def _chunks(weight) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(weight / TASK_WEIGHT)).cast("long")


def _links_of_regions(nodes: DataFrame, texts: DataFrame, weight: int, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and nodes of large regions, from nodes (node, region, n, chunks) and texts (those and text)."""
    tasks = max(1, -(-weight // TASK_WEIGHT))
    large, found = nodes.where("chunks > 1"), []
    rows, large_texts = texts.withColumn("k", F.col("chunks")), texts.where("chunks > 1").select("node", "region", "n", "text")
    while True:
        chunk = F.when(F.col("k") > 1, F.xxhash64("region", F.pmod(F.xxhash64("node"), "k"))).otherwise(F.col("region"))
        rows = rows.select("node", chunk.alias("region"), (F.col("k") > 1).alias("large"), "text").select(
            F.when(F.col("large"), F.col("region")).otherwise(F.pmod(F.xxhash64("region"), F.lit(tasks))).alias("task"),
            "region", F.lit(0).alias("part"), "node", F.col("node").alias("label"), "large", "text",
        )
        result = written(rows.groupBy("task").applyInArrow(_search(words, percent), "kind int, a long, b long"))
        found.append(result.where("kind = 0").select("a", "b"))
        onward = result.where("kind = 1").select(F.col("a").alias("node")).distinct()
        if onward.isEmpty():
            break
        count = large.join(onward, "node").groupBy("region").agg(_chunks(F.sum(F.col("n") + DOC_WEIGHT)).alias("k"))
        rows = large_texts.join(onward, "node").join(count, "region")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links, large


def _links_of_keys(texts: DataFrame, links: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Links between nodes of large regions that share a key and are not connected by links; None if there are none."""
    texts = texts.where("chunks > 1").select("node", "n", "text")
    common = texts.sparkSession.sparkContext.broadcast(_common_parts(texts, words, percent))  # COMMON_PARTS pairs at most
    parts = Parts(percent)
    keys = _parts_of(words, lambda tokens: parts.keys(tokens, common.value))
    keyed = texts.select("node", (F.col("n") + DOC_WEIGHT).alias("weight"), keys("text").alias("keys"))
    keyed = keyed.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    keyed = written(keyed.dropDuplicates(["node"]))  # rows that repeat
    rows = keyed.select("node", "label", "weight", F.explode("keys").alias("shared"))
    groups = rows.groupBy("shared").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("weight").alias("weight"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("count"))
    groups = groups.where("lo < hi").groupBy("sum", "count").agg(F.min(F.struct("shared", "weight")).alias("one")).select("one.*")  # the same nodes once
    groups = written(groups.withColumn("chunks", _chunks(F.col("weight"))))
    total = groups.where("chunks = 1").agg(F.sum("weight")).first()[0]
    if groups.isEmpty():
        return None
    tasks = -(-(total or 0) // TASK_WEIGHT) or 1
    small = rows.join(groups.where("chunks = 1").select("shared"), "shared")
    small = small.select(F.pmod(F.xxhash64("shared"), F.lit(tasks)).alias("task"), F.col("shared").alias("region"), F.lit(0).alias("part"), "node", "label")
    # Keys with many nodes: counted by label first, so that only nodes outside the largest component are listed by key.
    by_label = rows.groupBy("shared", "label").agg(F.count("*").alias("size")).join(groups.where("chunks > 1").select("shared"), "shared")
    main = by_label.groupBy("shared").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    outside = rows.join(main, (rows["shared"] == main["shared"]) & (rows["label"] != main["main"])).select("main", "node", "label", "weight").distinct()
    outside = written(outside)
    inside = keyed.join(outside.select(F.col("main").alias("label")).distinct(), "label").select(F.col("label").alias("main"), "node", "label", "weight")
    every = inside.unionByName(outside)
    count = every.groupBy("main").agg(_chunks(F.sum("weight")).alias("k")).join(outside.groupBy("main").agg(_chunks(F.sum("weight")).alias("r")), "main")
    x = outside.join(count, "main").select("*", F.pmod(F.xxhash64("node"), "r").alias("i"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"), F.lit(0).alias("part"))
    y = every.join(count, "main").select("*", F.pmod(F.xxhash64("node"), "k").alias("j"), F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("i"), F.lit(1).alias("part"))
    pair = F.xxhash64("main", "i", "j")
    crossing = x.unionByName(y).select(pair.alias("task"), pair.alias("region"), "part", "node", "label")
    tried = small.unionByName(crossing).join(texts.dropDuplicates(["node"]).select("node", "text"), "node").withColumn("large", F.lit(False))
    found = tried.groupBy("task").applyInArrow(_search(words, percent), "kind int, a long, b long")
    return written(found.select("a", "b").where("a <> b").distinct())


def _row_keys(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """df with __doc and __key (long, never null), by which rows and results meet."""
    return df.withColumn("__doc", F.xxhash64(doc_id)).withColumn("__key", F.xxhash64(text))


def _results(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """__doc, __key, doc, n, least, component of each distinct row of texts (doc, key, text); component is null for an
    empty set."""
    small_batches(texts.sparkSession)
    kind = texts.schema["doc"].dataType.simpleString()
    profiles = written(texts.mapInArrow(_profile(words, percent), f"kind int, doc {kind}, key long, node long, n long, other long"))
    members = profiles.where("kind = 0").select("doc", "key", "node", "n")
    same_key = Window.partitionBy("other").orderBy("node")  # a row for each BATCH_BYTES of text at most
    chains = profiles.where("kind = 1").select(F.col("node").alias("a"), F.lag("node").over(same_key).alias("b"))
    touching = chains.where("a <> b").unionByName(profiles.where("kind = 2").select(F.col("node").alias("a"), F.col("other").alias("b")))
    regions = components(touching.distinct())
    one = members.where("n > 0").groupBy("node").agg(F.min(F.struct("doc", "key", "n")).alias("one"))
    nodes = written(regions.join(one, "node").select("node", F.col("label").alias("region"), "one.n", "one.doc", "one.key"))
    size = nodes.groupBy("region").agg(_chunks(F.sum(F.col("n") + DOC_WEIGHT)).alias("chunks"))
    nodes = written(nodes.join(size, "region"))
    weight = nodes.agg(F.sum(F.col("n") + DOC_WEIGHT)).first()[0] or 0
    # One plan at every size: the texts are dealt by document once (a row that repeats comes twice, which harms nothing).
    dealt = texts.select(F.xxhash64("doc").alias("__doc"), F.col("key").alias("__key"), "text")
    chosen = nodes.withColumn("__doc", F.xxhash64("doc")).withColumnRenamed("key", "__key").hint("merge")
    own_texts = written(dealt.join(chosen, ["__doc", "__key"]).select("node", "region", "n", "chunks", "text"))
    links, large = _links_of_regions(nodes.select("node", "region", "n", "chunks"), own_texts, weight, words, percent)
    if not large.isEmpty() and (more := _links_of_keys(own_texts, links, words, percent)) is not None:
        links = written(links.unionByName(more))
    sets = members.distinct().join(components(links), "node", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("label", "node")))
    least = written(sets.where("n > 0").groupBy("component").agg(F.min("doc").alias("least")))
    return sets.join(least, "component", "left").select(F.xxhash64("doc").alias("__doc"), F.col("key").alias("__key"), "doc", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")).alias("least"), "component")


def _texts(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    return df.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))


def link_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """df with n_shingles (long), component_id (least doc_id reachable by links) and component (long: the same number in
    all documents of a component; documents with an empty set have no component: null)."""
    clean = df.drop(*(c for a in ("n_shingles", "component_id", "component", "__doc", "__key") for c in same_name(df, a)))
    found = _results(_texts(clean, text, doc_id), words, percent)
    found = found.select("__doc", "__key", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), "component")
    return _row_keys(clean, text, doc_id).join(found, ["__doc", "__key"], "left").drop("__doc", "__key")


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df without near duplicates: of each component one row of the least doc_id stays (of several texts
    with that doc_id, the one of the least hash); rows with an empty set all stay."""
    found = written(_results(_texts(df, text, doc_id), words, percent))
    least = found.where(F.col("component").isNotNull() & F.col("doc").eqNullSafe(F.col("least")))
    least = least.groupBy("component").agg(F.min(F.struct("__doc", "__key")).alias("one")).select("one.*")
    stay = least.withColumn("__once", F.lit(True)).unionByName(found.where("component is null").select("__doc", "__key", F.lit(False).alias("__once")))
    rows = _row_keys(df, text, doc_id).join(stay, ["__doc", "__key"])
    copy = F.row_number().over(Window.partitionBy("__doc", "__key").orderBy("__once"))  # rows that repeat meet in the join
    return rows.withColumn("__copy", copy).where("__copy = 1 or not __once").select(*df.columns)


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (g) GROUP BY 1, 2),
e AS (SELECT b.a, b.b FROM b JOIN n x ON x.doc_id = b.a JOIN n y ON y.doc_id = b.b WHERE 100 * common >= 90 * (x.n + y.n - common)),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(t.b), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN t ON t.a = w.doc_id GROUP BY w.doc_id
"""
