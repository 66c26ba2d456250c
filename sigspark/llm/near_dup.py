"""Near-duplicates by MinHash with tensored banding, verified on full shingle sets.

A document has two small collections of ``TABLES`` minhash bands.  Each pair of a band of the one and a band of
the other is the key of a table, so 2 x 8 x 2 = 32 minhashes make 64 tables of four minhashes each.  At the least
similarity to link, 0.85, a pair shares a band of a collection with a chance of 1 - (1 - 0.85^2)^8 = 0.99997.
A caller with a lesser threshold passes ``percent``, and more ``tables`` to keep that chance: 10 give it at 0.8.

1. Documents of equal sets are one class; only its least document goes on.
2. Bands of the first collection that no other document has end in an aggregate; for the rest the pairs with the second
   collection are formed.  Documents of a key hang on its least one, and the components of these stars are the
   candidate groups.  No window orders a band's, a key's or a group's documents, so none of them need fit a task.
3. Each group's full sets are compared exactly, in three rounds whose tasks hold a bounded number of shingles:
   inside slices of the group, dealt by a hash; where a group has several slices, the few documents with most links
   against all of its slices; and where it has several components left, blocks of those outside of its largest component
   against each other and against that one, if their set sizes can reach the threshold.  The second round makes a large
   group of true copies one component in time linear in its documents, so that little or nothing is left to the third.
   A task finds its pairs through its rarest shingles, skips pairs that are already connected, and emits a spanning
   forest of the true links, never all pairs.
4. Components of the true links, by their least document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm import rolling, storage
from sigspark.llm.components import connected_components

WIDTH = 5
PERCENT = 85
TABLES = 8
BAND = 2
SLICE_COST = 150_000  # shingles of a slice of a group, each document counting DOC_COST more
BLOCK_COST = 150_000  # those of a block of the last round
DOC_COST = 500
PIVOTS = 8  # documents of a group that are held against all of its slices
MAX_TABLES = 32
_MULTIPLIERS = np.random.default_rng(0xD0C5).integers(0, 1 << 63, 2 * MAX_TABLES * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
_SIG = "doc_id long, n_shingles long, h1 long, h2 long, a array<long>, b array<long>"


def signature(shingles: np.ndarray, tables: int = TABLES) -> tuple[list[int], list[int]]:
    """The bands of the first and second collection."""
    least = np.array([rolling.mix(shingles * m).min() for m in _MULTIPLIERS[: 2 * tables * BAND]], np.uint64).reshape(2 * tables, BAND)
    band = rolling.mix(least[:, 0] + rolling.mix(least[:, 1])).astype(np.int64).tolist()
    return band[:tables], band[tables:]


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    h = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _signatures(tables: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                s = rolling.shingles(text.as_py(), WIDTH)
                rows.append((len(s), *_fingerprint(s), *signature(s, tables)) if len(s) else (0, 0, 0, None, None))
            n, h1, h2, a, b = zip(*rows, strict=True)
            longs, lists = pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, longs), pa.array(h1, longs), pa.array(h2, longs), pa.array(a, lists), pa.array(b, lists)], names=["doc_id", "n_shingles", "h1", "h2", "a", "b"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of candidate documents; a row of the same id but another set (a repeated id) falls out."""
    for batch in batches:
        kept, sets = [], []
        for i, (text, h1, h2) in enumerate(zip(batch.column("text"), batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)):
            s = rolling.shingles(text.as_py(), WIDTH)
            if _fingerprint(s) == (h1, h2):
                kept.append(i)
                sets.append(s.tobytes())
        rest = batch.select(["doc_id", "grp", "slices", "slice", "n_shingles"]).take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sets, pa.binary())], names=[*rest.schema.names, "shingles"])


def similar(shared: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | bool:
    """Whether 100 * intersection is at least ``percent`` * union."""
    return 100 * shared >= percent * (n + m - shared)


def spanning_links(ids: list[int], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int = PERCENT, known: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between documents of ``left`` and of ``right`` (masks; both all for one block).

    Exact: two sets that link share a shingle among the rarest n - ceil(n * percent / 100) + 1 of each (the prefix rule), so
    candidates come from those alone; each is counted in full unless the two are already connected, here or by equal
    components in ``known``.
    """
    order = sorted(range(len(ids)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], np.int64)
    left, right = left[order], right[order]
    flat = np.concatenate([sets[i] for i in order])
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rank[token]
    at = np.r_[0, np.cumsum(size)]
    parent = np.arange(len(order))
    if known is not None:
        _, first, which = np.unique(np.array(known, np.int64)[order], return_index=True, return_inverse=True)
        parent = first[which]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    seen = np.zeros(len(count), bool)
    postings: dict[int, list[int]] = {}
    label = parent.copy()
    links = []
    for i in range(len(order)):
        own = np.sort(token[at[i] : at[i + 1]])
        n = int(size[i])
        rare = own[: n - (percent * n + 99) // 100 + 1].tolist()
        near: set[int] = set()
        for t in rare:
            near.update(postings.get(t, ()))
        if near:
            j = np.fromiter(near, np.int64, len(near))
            j = j[(100 * size[j] >= percent * n) & ((left[j] & right[i]) | (right[j] & left[i]))]
            seen[own] = True
            while len(j):
                part, j = j[:512], j[512:]
                part = part[label[part] != label[i]]
                if not len(part):
                    continue
                where = np.concatenate([token[at[k] : at[k + 1]] for k in part])
                shared = np.add.reduceat(seen[where].astype(np.int64), np.r_[0, np.cumsum(size[part])[:-1]])
                for k in part[similar(shared, n, size[part], percent)].tolist():
                    a, b = root(k), root(i)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        label[label == max(a, b)] = min(a, b)
                        links.append((ids[order[i]], ids[order[k]]))
            seen[own] = False
        for t in rare:
            postings.setdefault(t, []).append(i)
    return links


def _links(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of each comparison: rows of one grp, one and two; ``side`` is 1 for the left, 2 for the right, 3 for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        rows: list[tuple[int, int, int, np.ndarray]] = []

        def done() -> Iterator[pa.RecordBatch]:
            ids, known, side, sets = (list(x) for x in zip(*rows, strict=True))
            mask = np.array(side)
            found = spanning_links(ids, sets, mask & 1 > 0, mask & 2 > 0, percent, known)
            if found:
                src, dst = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("grp", "one", "two", "doc_id", "known", "side")]
            for grp, one, two, doc_id, known, side, raw in zip(*columns, batch.column("shingles"), strict=True):
                if (grp, one, two) != key:
                    if len(rows) > 1:
                        yield from done()
                    key, rows = (grp, one, two), []
                rows.append((doc_id, known, side, np.frombuffer(raw.as_py(), np.uint64)))
        if len(rows) > 1:
            yield from done()

    return run


def _compared(rows: DataFrame, percent: int, name: str) -> DataFrame:
    """The links (src, dst) of comparisons given as rows (grp, one, two, doc_id, known, side, shingles)."""
    dealt = rows.select("grp", "one", "two", "doc_id", "known", "side", "shingles").repartition("grp", "one", "two").sortWithinPartitions("grp", "one", "two", "doc_id")
    return storage.materialize(storage.map_batches(dealt, _links(percent), "src long, dst long"), name)


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(id, component) of the documents that share a table key with another, over ``classes`` (doc_id, a, b)."""
    bands = classes.select("doc_id", "b", F.posexplode("a").alias("i", "band"))
    shared = bands.groupBy("i", "band").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = bands.join(shared, ["i", "band"]).select("doc_id", "i", "band", F.posexplode("b").alias("j", "other"))
    keys = storage.materialize(pairs.select("doc_id", F.xxhash64("i", "band", "j", "other").alias("key")), "table-keys")
    heads = keys.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = keys.join(heads, "key").where("doc_id <> head").select(F.col("doc_id").alias("src"), F.col("head").alias("dst"))
    return connected_components(edges.distinct(), "candidates")


def _parts(rows: DataFrame, by: list[str], cost: int, count: str, part: str) -> DataFrame:
    """``rows`` with the number of parts of their group ``by``, of about ``cost`` each, and their own part by a hash."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.sum(F.col("n_shingles") + DOC_COST) / cost).cast("int").alias(count))
    return rows.join(sizes, by).withColumn(part, F.pmod(F.xxhash64("doc_id"), F.col(count)).cast("int"))


def _pivot_rows(sets: DataFrame, links: DataFrame) -> DataFrame:
    """The second round: in groups of several slices, the documents with most links and each other slice."""
    degree = links.select(F.col("src").alias("doc_id")).unionByName(links.select(F.col("dst").alias("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("links"))
    best = sets.drop("shingles").join(degree, "doc_id").groupBy("grp", "slice").agg(F.max(F.struct("links", F.negative("doc_id").alias("least"))).alias("x"))
    # A row for each slice, of which the most linked ones are taken.
    top = best.groupBy("grp").agg(F.slice(F.sort_array(F.collect_list("x"), asc=False), 1, PIVOTS).alias("x"))
    pivots = top.select(F.explode("x").alias("x")).select(F.negative("x.least").alias("doc_id"))
    from_pivots = sets.join(pivots, "doc_id", "left_semi").withColumn("two", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).where("two <> slice").withColumn("side", F.lit(1))
    to_slices = sets.withColumn("two", F.col("slice")).withColumn("side", F.lit(2))
    return from_pivots.unionByName(to_slices).withColumn("one", F.lit(0)).withColumn("known", F.col("doc_id"))


def _rest_rows(sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """The third round: in groups of several components, blocks of all but the largest one with all blocks they can link to."""
    joined = connected_components(links, "links")
    rows = sets.select("doc_id", "grp", "n_shingles").join(joined.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("known", F.coalesce("component", "doc_id")).drop("component")
    sizes = rows.groupBy("grp", "known").agg(F.count("*").alias("n"))
    main = sizes.groupBy("grp").agg(F.max(F.struct("n", "known")).alias("x"), F.count("*").alias("components")).where("components > 1").select("grp", F.col("x.known").alias("main"))
    # Sets that can link are at most one level apart.
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / (math.log(100 / percent) * (1 + 1e-6))).cast("int")
    rows = rows.join(main, "grp").select("grp", "doc_id", "n_shingles", "known", (F.col("known") == F.col("main")).alias("inside"), level.alias("level"))
    rows = storage.materialize(_parts(rows, ["grp", "inside", "level"], BLOCK_COST, "blocks", "block"), "candidate-blocks")
    name: Column = F.concat_ws("-", F.col("inside").cast("int"), "level", "block")
    blocks = rows.select("grp", "inside", "level", "block", name.alias("name")).distinct()
    other = blocks.select("grp", *(F.col(c).alias(f"other_{c}") for c in ("inside", "level", "block", "name")))
    once = "level < other_level or (level = other_level and (block < other_block or (block = other_block and not inside)))"
    pairs = blocks.where("not inside").join(other, "grp").where(f"abs(level - other_level) <= 1 and (other_inside or {once})")
    sides = pairs.select("grp", F.col("name").alias("one"), F.col("other_name").alias("two"))
    same = F.col("one") == F.col("two")
    sides = sides.select("grp", "one", "two", F.col("one").alias("name"), F.when(same, 3).otherwise(1).alias("side")).unionByName(sides.where(~same).select("grp", "one", "two", F.col("two").alias("name"), F.lit(2).alias("side")))
    dealt = rows.select("doc_id", "grp", "known", name.alias("name")).join(sides, ["grp", "name"])
    return dealt.join(sets.select("doc_id", "shingles"), "doc_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, tables: int = TABLES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    A null or empty text, or one without words, has an empty set and links with nothing.  Equal sets link.  A repeated
    id is one document whose rows' links are joined; a null id stays alone (component null, kept).  An empty table
    gives no row; other columns are not read.  Sets link at a similarity of ``percent`` hundredths or more.
    """
    texts = docs.select(storage.col(id_col).cast("long").alias("doc_id"), storage.col(text_col).alias("text"))
    sigs = storage.materialize(storage.map_batches(texts, _signatures(tables), _SIG), "signatures")
    worded = sigs.where("n_shingles > 0 and doc_id is not null")
    reps = storage.materialize(worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles")), "classes")
    classes = worded.join(reps.select(F.col("rep").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi")
    groups = candidate_groups(classes.select("doc_id", "a", "b"))
    placed = reps.join(groups.select(F.col("id").alias("rep"), F.col("component").alias("grp")), "rep").select(F.col("rep").alias("doc_id"), "h1", "h2", "n_shingles", "grp")
    placed = _parts(placed, ["grp"], SLICE_COST, "slices", "slice")
    # Candidates grow with the corpus, so they are never broadcast, however few they are here.
    sets = storage.map_batches(texts.join(placed.hint("merge"), "doc_id"), _sets, "doc_id long, grp long, slices int, slice int, n_shingles long, shingles binary")
    sets = storage.materialize(sets, "candidate-sets")
    inside = sets.withColumns({"one": F.lit(0), "two": F.col("slice"), "known": F.col("doc_id"), "side": F.lit(3)})
    links = _compared(inside, percent, "slice-links")
    large = sets.where("slices > 1")
    if not large.isEmpty():
        links = links.unionByName(_compared(_pivot_rows(large, links), percent, "pivot-links"))
        links = links.unionByName(_compared(_rest_rows(large, links, percent), percent, "rest-links"))
    equal_ids = worded.join(reps, ["h1", "h2"]).where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")).join(_repeated(worded), F.col("src") == F.col("again"), "left_semi")
    joined = connected_components(links.unionByName(equal_ids), "links")
    with_rep = sigs.join(reps.select("h1", "h2", "rep"), ["h1", "h2"], "left")
    out = with_rep.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _repeated(worded: DataFrame) -> DataFrame:
    """Ids with more than one set, which tie those sets' classes."""
    return worded.groupBy("doc_id").agg(F.count_distinct("h1").alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
