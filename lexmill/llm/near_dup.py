"""Near-duplicate documents by b-bit MinHash.

Each document's word shingles give PERMS minima. Bands of full minima propose candidates; of each minimum only the low
BITS bits stay, packed into a short signature, and the share of equal bit groups, corrected for chance collisions
(Li and Koenig, b-bit minwise hashing), estimates the Jaccard similarity of candidates.

Documents of equal signature stand as one. Within a bucket a breadth-first search over the still unassigned members finds
the connected components of the graph "estimate >= threshold", in time linear in the members for each component, so that
thousands of copies cost no pairwise comparison. Where SEEDS components have been found and many members are left, these are
mutually unlike, and are compared only where they share the low bits of some SUB_ROWS minima, SUB_BANDS times over: a pair
at the threshold shares none with a probability of 2e-7.

A bucket of more than PIECE members is dealt over pieces by hash. Copies meet in one piece or another of their many common
buckets. What is left, the members of a large bucket that aren't in its largest component by then, is compared with all its
other members in blocks of pieces. So nothing is left out, and no task holds more than two pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._frame import stored, tidy
from ._words import Words, mix, pieces, signed

SHINGLE, BANDS, ROWS, BITS, THRESHOLD = 3, 32, 4, 4, 0.5
SEEDS, SUB_ROWS, SUB_BANDS, SMALL, PIECE = 64, 4, 192, 32, 20_000


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, n + 1, dtype=np.uint64)
    return mix(i * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mix(i + np.uint64(0xABCDEF0123456789))


def minima(words: Words, shingle: int, perms: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with any word, and their minima (texts by permutations, 32 bits each).

    A text of fewer words than a shingle has one: all its words.
    """
    n = words.counts()
    own = np.flatnonzero(n > 0)
    if not len(own):
        return own, np.zeros((0, perms), np.uint32)
    size = np.minimum(n[own], shingle)
    count = n[own] - size + 1
    offsets = np.zeros(len(own), np.int64)
    np.cumsum(count[:-1], out=offsets[1:])
    at = np.repeat(words.first[own] - offsets, count) + np.arange(count.sum())
    h = words.spans(at, at + np.repeat(size, count))
    a, b = _seeds(perms)
    out = np.empty((len(own), perms), np.uint32)
    for p in range(perms):
        out[:, p] = np.minimum.reduceat((h * a[p] + b[p]) >> np.uint64(32), offsets)
    return own, out


def pack(low: np.ndarray, bits: int) -> np.ndarray:
    """Rows of small numbers as rows of bytes; perms * bits is a multiple of 64."""
    planes = (low[:, :, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.reshape(len(low), low.shape[1] * bits).astype(np.uint8), axis=1)


def estimate(one: np.ndarray, many: np.ndarray, perms: int, bits: int) -> np.ndarray:
    """Collision-corrected similarity of a packed signature with many, by bit counts."""
    x = np.ascontiguousarray(np.bitwise_xor(many, one)).view(np.uint64)
    step = np.uint64(sum(1 << i for i in range(0, 64, bits)))
    y = x.copy()
    for s in range(1, bits):
        y |= x >> np.uint64(s)
    unequal = np.bitwise_count(y & step).sum(axis=1, dtype=np.int64)
    c = 2.0**-bits
    return ((perms - unequal) / perms - c) / (1 - c)


def _search(sigs: np.ndarray, rest: np.ndarray, threshold: float, perms: int, bits: int, seeds: float) -> tuple[list[int], list[int], np.ndarray]:
    """Edges (places in sigs) that span the components of rest, by breadth-first searches that compare with unassigned members
    only; after so many components also the members that none of them has."""
    left, right = [], []
    while len(rest) > 1 and seeds > 0:
        seeds -= 1
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = estimate(sigs[at], sigs[rest], perms, bits) >= threshold
            found = rest[near]
            left += [int(at)] * len(found)
            right += found.tolist()
            queue += found.tolist()
            rest = rest[~near]
    return left, right, rest


def links(sigs: np.ndarray, threshold: float, perms: int, bits: int) -> tuple[list[int], list[int]]:
    """Edges (places in sigs) that span the components of a bucket's members, which are in the order of their ids."""
    left, right, rest = _search(sigs, np.arange(len(sigs)), threshold, perms, bits, SEEDS)
    if len(rest) <= 4 * SEEDS:
        more = _search(sigs, rest, threshold, perms, bits, np.inf)
        return left + more[0], right + more[1]
    low = np.unpackbits(sigs[rest], axis=1).reshape(len(rest), perms, bits)
    low = (low << np.arange(bits, dtype=np.uint8)).sum(axis=2).astype(np.uint64)
    rng = np.random.default_rng(len(rest))
    for _ in range(SUB_BANDS):
        key = np.zeros(len(rest), np.uint64)
        for p in rng.choice(perms, SUB_ROWS, replace=False):
            key = (key << np.uint64(bits)) | low[:, p]
        order = np.argsort(key, kind="stable")
        k = key[order]
        edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        size = np.diff(edge)
        # small cells all at once, by the distance of two members in the order
        small = np.repeat(size, size) <= SMALL
        cell = np.repeat(np.arange(len(size)), size)
        for d in range(1, min(SMALL, int(size.max()))):
            i = np.flatnonzero((cell[:-d] == cell[d:]) & small[:-d])
            if not len(i):
                break
            one, two = rest[order[i]], rest[order[i + d]]
            near = estimate(sigs[one], sigs[two], perms, bits) >= threshold
            left += one[near].tolist()
            right += two[near].tolist()
        for c, n in zip(edge[:-1][size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            more = _search(sigs, rest[order[c : c + n]], threshold, perms, bits, np.inf)
            left += more[0]
            right += more[1]
    return left, right


def across(mine: np.ndarray, roots: np.ndarray, theirs: np.ndarray, other_roots: np.ndarray, threshold: float, perms: int, bits: int) -> tuple[list[int], list[int]]:
    """Places (mine, theirs) of one link for each component of theirs that a member of mine, of another one, is near to."""
    left, right = [], []
    for i in range(len(mine)):
        near = np.flatnonzero((estimate(mine[i], theirs, perms, bits) >= threshold) & (other_roots != roots[i]))
        if len(near):
            near = near[np.unique(other_roots[near], return_index=True)[1]]
            left += [i] * len(near)
            right += near.tolist()
    return left, right


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int, bits: int) -> DataFrame:
    """doc_id, sig (packed low bits), bands (hash of each band's full minima). Texts without words have no row."""
    perms = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                own, m = minima(Words(texts), shingle, perms)
                sig = pack(m & np.uint32((1 << bits) - 1), bits)
                h = np.zeros((len(own), bands), np.uint64)
                for r in range(rows):
                    h = mix(h * np.uint64(0x100000001B3) + m[:, r::rows].astype(np.uint64))
                h = mix(h + np.arange(bands, dtype=np.uint64))
                width = sig.shape[1]
                flat = pa.array(signed(h.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("doc_id")).take(pa.array(own)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(own), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat),
                    ],
                    names=["doc_id", "sig", "bands"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sig binary, bands array<long>")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) with the smallest id of each component, for every id of an edge: alternating large and small stars
    (Kiveris et al., connected components in MapReduce and beyond). Each round is written to the shared folder."""
    now = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    previous = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: link each larger neighbour to the least of the neighbourhood
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: link smaller neighbours and the node to the least
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("u"), "m").union(least).filter("u <> m").select("u", F.col("m").alias("v")).distinct()
        now = stored(small, "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == previous:
            break
        previous = state
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())


def _rows(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint8).reshape(len(sigs), -1)


def groups(docs: DataFrame, shingle: int, bands: int, rows: int, bits: int, threshold: float, piece: int) -> DataFrame:
    """(id, root) of the members of groups. docs: doc_id, of any type that has an order, and text."""
    perms = bands * rows
    if perms * bits % 64:
        raise ValueError("bands * rows * bits must be a multiple of 64")
    sigs = stored(signatures(docs.filter("doc_id is not null"), shingle, bands, rows, bits), "signatures")
    kind = dict(sigs.dtypes)["doc_id"]
    same = stored(sigs.groupBy("sig", "bands").agg(F.min("doc_id").alias("rep")).select("*", F.xxhash64("rep", "sig").alias("node")), "distinct")
    # equal signatures meet by two independent hashes, 16 bytes instead of some 300
    keys = [F.xxhash64("sig", "bands").alias("k1"), F.xxhash64(F.lit(1), "sig", "bands").alias("k2")]
    copies = sigs.select("doc_id", *keys).join(same.select("rep", *keys).hint("merge"), ["k1", "k2"]).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    banded = same.select("node", F.explode("bands").alias("band"))
    # buckets of the same members are one
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")).filter("n > 1")
    buckets = stored(buckets.groupBy("n", "x", "y").agg(F.min("band").alias("band")), "buckets")
    pieces = F.ceil(F.col("n") / piece).cast("int")
    # these sides grow with the table: shuffled at every size
    members = banded.join(buckets.select("band", "n").hint("merge"), "band").join(same.select("node", "rep", "sig").hint("merge"), "node")
    members = stored(members.select("band", "n", "rep", "sig", F.pmod(F.xxhash64("node", "band"), pieces).cast("int").alias("piece")), "members")

    def edges_of(a: list, b: list, ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], names=["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in batch.column(0):
                v = bucket.values
                yield edges_of(*links(_rows(v.field("sig")), threshold, perms, bits), v.field("rep"))

    pair = f"a {kind}, b {kind}"
    near = members.groupBy("band", "piece").agg(F.array_sort(F.collect_list(F.struct("rep", "sig"))).alias("m")).filter(F.size("m") > 1).select("m").mapInArrow(search, pair)
    edges = stored(copies.unionByName(near), "links")
    out = components(edges)
    large = members.filter(F.col("n") > piece)
    if buckets.filter(F.col("n") > piece).isEmpty():
        return out
    rooted = large.join(out.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    sizes = rooted.groupBy("band", "root").agg(F.count("*").alias("c")).groupBy("band").agg(F.max(F.struct("c", "root")).alias("most"))
    rooted = stored(rooted.join(sizes.select("band", F.col("most.root").alias("most")), "band").select("band", "n", "piece", "rep", "sig", "root", (F.col("root") != F.col("most")).alias("apart")), "large")
    apart = rooted.filter("apart")
    if apart.isEmpty():
        return out
    counts = apart.groupBy("band").agg(F.count("*").alias("k"))
    parts = F.ceil(F.col("k") / piece).cast("int")
    to_all = apart.join(counts, "band").withColumns({"row": F.pmod(F.xxhash64("rep", F.lit(3)), parts).cast("int"), "side": F.lit(0)}).withColumn("column", F.explode(F.sequence(F.lit(0), pieces - 1)))
    all_ = rooted.join(counts, "band").withColumns({"column": F.col("piece"), "side": F.lit(1)}).withColumn("row", F.explode(F.sequence(F.lit(0), parts - 1)))
    names = ["band", "row", "column", "side", "rep", "sig", "root"]
    blocks = to_all.select(*names).unionByName(all_.select(*names)).groupBy("band", "row", "column").agg(F.collect_list(F.struct("side", "rep", "sig", "root")).alias("m")).select("m")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                v = block.values
                side = v.field("side").to_numpy(zero_copy_only=False)
                sig = _rows(v.field("sig"))
                names = {}
                root = np.array([names.setdefault(str(r), len(names)) for r in v.field("root").to_pylist()])
                i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                a, b = across(sig[i], root[i], sig[j], root[j], threshold, perms, bits)
                yield edges_of(i[a].tolist() if a else [], j[b].tolist() if b else [], v.field("rep"))

    return components(edges.unionByName(blocks.mapInArrow(between, pair)))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bits: int = BITS, threshold: float = THRESHOLD, piece: int = PIECE
) -> DataFrame:
    """(doc_id, group_id) of all members of groups of two documents or more; group_id is the group's least doc_id.

    Null ids, null texts and texts without words belong to no group. Rows that repeat a doc_id are one document: its
    texts' groups join. Ties don't matter: groups are components. An empty table gives an empty result. Texts of any
    length are read whole. Extra columns are ignored, whatever their names.
    """
    docs, _ = tidy(docs, {"doc_id": "long", "text": "string"})
    found = groups(docs, shingle, bands, rows, bits, threshold, piece)
    return found.select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that are near copies of one with a smaller doc_id. All columns stay as they are.

    Rows without an id, a text or words all stay. Rows that repeat a doc_id with different texts are different documents,
    the one with the smaller digest of its text first; of rows that repeat both, the one with the smallest digest of all
    its columns stays. Empty tables stay empty; texts of any length are read whole; extra columns may have any names.
    """
    inner, back = tidy(docs, {"doc_id": "long", "text": "string"})
    settings = {"shingle": SHINGLE, "bands": BANDS, "rows": ROWS, "bits": BITS, "threshold": THRESHOLD, "piece": PIECE} | options
    again = inner.filter("doc_id is not null and text is not null").groupBy("doc_id").count().filter("count > 1")
    if again.isEmpty():
        losers = groups(inner.select("doc_id", "text"), **settings).filter("id <> root").select(F.col("id").alias("__gone"))
        return back(inner.join(losers, inner["doc_id"] == F.col("__gone"), "left_anti"))
    own = F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), F.struct(F.col("doc_id").alias("d"), F.md5(F.col("text").cast("binary")).alias("t")))
    keyed = inner.withColumn("__own", own)
    losers = groups(keyed.select(F.col("__own").alias("doc_id"), "text"), **settings).filter("id <> root").select(F.col("id").alias("__gone"))
    kept = keyed.join(losers, F.col("__own") == F.col("__gone"), "left_anti")
    repeated = keyed.filter("__own is not null").groupBy("__own").count().filter("count > 1").select(F.col("__own").alias("__many"))
    others = kept.join(repeated, F.col("__own") == F.col("__many"), "left_anti")
    few = kept.join(repeated, F.col("__own") == F.col("__many"), "left_semi")
    first = W.partitionBy("__own").orderBy(F.md5(F.to_json(F.struct(*inner.columns)).cast("binary")))
    few = few.withColumn("__no", F.row_number().over(first)).filter("__no = 1").drop("__no")
    return back(others.unionByName(few))
