"""MinHash near-dedup by min-max hashing, with exact links.

One pass of numpy turns each text to its shingle set's size, a fingerprint and the band hashes of a min-max signature.
From there on only numbers are shuffled. Equal sets are one class, whatever their number. Classes that share a band
hash are a bucket; each is compared with the bucket's first class (one candidate a member, never all pairs), and a
candidate counts only if the full sets pass the limit. Buckets whose classes are then still in several components are
finished exactly: they are cut into blocks of bounded size, and each two blocks meet in a task that counts
intersections by an inverted list and returns the links that join components, at most one less than it has classes.
Components come from repeated contraction of the link graph; the driver sees counts only.

The limit is a parameter, and sets the bands. A pair at the limit is in no common bucket with a chance of
(1 - limit**rows)**bands: about 1 in 120,000 at 0.85 with 20 bands of 5, 1 in 530,000 at 0.80 with 25 of 4; more
alike pairs are missed less. Classes and shingles are known by 64-bit hashes.

Defined cases: a null or empty text, or one of spaces, has the empty set and is linked with nothing: its component is
its own id; documents without an id are linked as others are, and a component of such alone has a null id and is kept;
repeated rows have equal results (`keep_one` returns one of them); an empty table gives an empty result; extra columns
are ignored by `near_duplicates`, and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearfield.llm.common import aside, released, stored
from nearfield.llm.minhash import ROWS, Words, bands, fingerprint, shingles, signature

#: Linked from this share of the union upwards, in hundredths, if the caller names no other.
LIMIT = 85
#: Rows of a band below a limit of 85: more and shorter bands of the same signature.
SHORT_ROWS = 4
#: Classes of a block; two blocks meet in a task.
BLOCK = 256
#: Sets that a worker holds before it passes them on.
SLICE = 500
#: Rows of two or three numbers that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 300_000


def small(df: DataFrame) -> DataFrame:
    """A stored DataFrame, marked for broadcast if its rows are counted as few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def signatures(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, row (a hash of the row's id and text), n_shingles, node (of the class; null for empty sets), bands."""
    width = ROWS if limit >= LIMIT else SHORT_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            sizes, nodes, marks = [], [], []
            for k in range(b.num_rows):
                own = shingles(texts[k].as_py() or b"", known)
                sizes.append(len(own))
                nodes.append(int.from_bytes(fingerprint(own)[:8], "little", signed=True) if len(own) else None)
                marks.append(bands(signature(own), width) if len(own) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "row", "n_shingles", "node", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    return rows.mapInArrow(released(run), "doc_id long, row long, n_shingles long, node long, bands array<long>")


def buckets(signed: DataFrame) -> DataFrame:
    """band, node, first: the classes of each band hash that has several, and the smallest of them."""
    members = stored(signed.where("node is not null").select("node", F.explode("bands").alias("band")).distinct(), "members")
    several = members.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return stored(members.join(several, "band"), "buckets")


def shingle_sets(docs: DataFrame, signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set: the sorted shingle hashes of the classes, from a text of each."""
    rows = stored(signed.join(small(stored(nodes, "nodes")), "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in (x.slice(k, SLICE) for x in batches for k in range(0, x.num_rows, SLICE)):
            texts = b.column("text").cast(pa.binary())
            sets = [shingles(t.as_py() or b"", known).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    texts = docs.select(F.xxhash64(F.col("doc_id"), "text").alias("row"), "text").join(small(rows), "row")
    return stored(texts.select("node", "text").mapInArrow(released(run), "node long, set array<long>").dropDuplicates(["node"]), "sets")


def linked(pairs: DataFrame, sets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The pairs (a, b) whose full sets pass the limit."""
    a, b = (sets.select(F.col("node").alias(c), F.col("set").alias(f"{c}_set")) for c in "ab")
    met = pairs.join(a, "a").join(b, "b")
    size, other, common = F.size("a_set"), F.size("b_set"), F.size(F.array_intersect("a_set", "b_set"))
    able = 100 * F.least(size, other) >= limit * F.greatest(size, other)
    enough = F.when(able, 100 * common >= limit * (size + other - common)).otherwise(False)
    return met.where(enough).select("a", "b")


def roots(edges: DataFrame) -> DataFrame:
    """node, root: of every node of the edges (a, b), the smallest node of its component. In each round a node points to its smallest neighbour, pointers are followed, and what they join is one node in the next, smaller graph."""
    left = stored(edges.where("a <> b").distinct(), "edges")
    total = stored(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("root")), "roots")
    while left.limit(1).count():
        both = left.union(left.select("b", "a"))
        point = stored(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("p")), "pointers")
        for _ in range(2):
            far = point.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            point = stored(point.join(far, "p").select("a", F.col("pp").alias("p")), "pointers")
        total = stored(total.join(point.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        to_b = point.select(F.col("a").alias("b"), F.col("p").alias("q"))
        left = stored(left.join(point, "a").join(to_b, "b").select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).where("a <> b").distinct(), "edges")
    return total


def unresolved(held: DataFrame, root_of: DataFrame) -> DataFrame:
    """band, node, root, of buckets of three classes or more in several components. Of buckets with the same members one is enough."""
    rooted = held.join(root_of, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted")
    of = rooted.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.xxhash64("node") % (1 << 40)).alias("s"), F.bit_xor(F.xxhash64("node")).alias("x"))
    kept = of.where("n > 2 and low <> high").groupBy("n", "s", "x").agg(F.min("band").alias("band")).select("band", "n")
    return rooted.join(kept, "band")


def block_links(held: DataFrame, sets: DataFrame, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """a, b: links that join components within the buckets, each pair of blocks on its own. held: band, node, root, n."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node", "band"), blocks).cast("int")
    # a block meets itself and every other once: as the lower one of the pairs or as the higher one
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"))))
    units = held.withColumn("blocks", blocks).withColumn("own", own).select("node", "root", "band", "own", meets.alias("m"))
    units = units.select(F.xxhash64("band", "m.i", "m.j").alias("unit"), "node", "root", "own", (F.col("m.i") == F.col("m.j")).alias("same")).join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        unit = None
        for b in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(b.column(c).to_pylist() for c in ("unit", "node", "root", "own", "same")), b.column("set"), strict=True):
                if row[0] != unit:
                    out += _unit_links(held, limit)
                    held, unit = [], row[0]
                held.append((*row[1:5], row[5].values.to_numpy()))
            yield _pairs(out)
        yield _pairs(_unit_links(held, limit))

    dealt = units.repartition("unit").sortWithinPartitions("unit")
    return dealt.select("unit", "node", "root", "own", "same", "set").mapInArrow(released(run), "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _unit_links(held: list[tuple], limit: int = LIMIT) -> list[tuple[int, int]]:
    """Links between classes of different roots, as long as they join what is apart. held: (node, root, block, same, set)."""
    if len({r for _, r, *_ in held}) < 2:
        return []
    nodes, top = [h[0] for h in held], {r: r for _, r, *_ in held}
    block = np.array([h[2] for h in held])
    sizes = np.array([len(h[4]) for h in held])
    owner = np.repeat(np.arange(len(held)), sizes)
    _, token = np.unique(np.concatenate([h[4] for h in held]), return_inverse=True)
    order = np.argsort(token, kind="stable")
    lists, begin = owner[order], np.concatenate(([0], np.cumsum(np.bincount(token))))
    first = np.concatenate(([0], np.cumsum(sizes)))
    tally: dict[int, int] = {}
    for _, r, *_ in held:
        tally[r] = tally.get(r, 0) + 1
    largest = max(tally, key=tally.get)

    def find(r: int) -> int:
        while top[r] != r:
            top[r] = top[top[r]]
            r = top[r]
        return r

    out = []
    for u, (node, root, own, same, _) in enumerate(held):
        if root == largest:  # its classes are met from the others' side
            continue
        mine = token[first[u] : first[u + 1]]
        common = np.bincount(np.concatenate([lists[begin[t] : begin[t + 1]] for t in mine]), minlength=len(held))
        near = 100 * common >= limit * (sizes[u] + sizes - common)
        if not same:
            near &= block != own
        for v in np.flatnonzero(near):
            a, b = find(root), find(held[v][1])
            if a != b:
                top[max(a, b)] = min(a, b)
                out.append((node, nodes[v]))
    return out


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, row, n_shingles, node, component_id of every row of docs (doc_id, text). limit: from 80 hundredths upwards."""
    signed = stored(signatures(docs, limit), "signed")
    held = buckets(signed)
    pairs = stored(held.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), "pairs")
    sets = shingle_sets(docs, signed, held.select("node").distinct())
    links = stored(linked(pairs, sets, limit), "links")
    root_of = roots(links)
    rest = stored(unresolved(held, root_of), "unresolved")
    if rest.limit(1).count():
        more = stored(block_links(rest, sets, limit=limit), "more")
        if more.limit(1).count():
            root_of = roots(links.union(more))
    classes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"))
    rooted = stored(classes.join(root_of, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")), "classes")
    ids = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    of = stored(rooted.join(ids, "root").select("node", "component_id"), "components")
    return signed.select("doc_id", "row", "n_shingles", "node").join(of, "node", "left").select("doc_id", "row", "n_shingles", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs with one document of each component: that with the smallest id; of repeated rows one. Documents without words are each a component of their own."""
    found = stored(near_duplicates(docs, limit), "found")
    # one row of each component, told by its hash; documents without words go by their row
    key = F.coalesce(F.col("node"), F.col("row"))
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("component_id"), F.when(F.col("node").isNull(), key).alias("z")).agg(F.min("row").alias("__row"), F.count("*").alias("n"))
    chosen = stored(chosen.select("__row", "n"), "chosen")
    repeated = chosen.where("n > 1").limit(1).count() > 0
    renamed, own = aside(docs, ("__row",))
    kept = renamed.withColumn("__row", F.xxhash64(F.col("doc_id"), "text")).join(small(chosen.select("__row").distinct()), "__row", "left_semi")
    return (kept.dropDuplicates(["__row"]) if repeated else kept).select(*own)
