"""Near-duplicate detection by b-bit MinHash.

A document is the set of its word shingles. Of each of 200 hash functions the
least value over the set is taken: groups of 5 whole minima are band keys, the
low 8 bits of all are packed as the signature. Documents with equal sets form a
class, and one of its documents represents it.

1. Representatives that share a band key are in one bucket. Each is compared
   with its buckets' pivots: bits that differ between two signatures are
   counted, and the share of equal 8-bit values, corrected for chance
   collisions, estimates the similarity. Pairs that may reach the threshold
   make regions.
2. Members of a bucket that aren't like its pivot are compared with all others.
3. Inside a region pairs are confirmed on the full sets, unless they are known
   to be connected already. Links and classes give the components.

Buckets and regions are compared in blocks of few members. Of a large group
only what isn't in its main part yet is compared with everything, so a group of
m near copies costs about m comparisons' blocks and not their square.

A pair at similarity 0.8 shares a band but for a chance of 1.3e-7; an estimate
falls below ``SCREEN`` for it with a chance of about 1e-6.

Nulls and edge cases: a null or blank text has an empty set and is linked with
nothing, so its component is its own id; a null id can't be a link's end, so
such a document is kept and has no component; rows with one id are one node,
which has the links of all of them; repeated rows each get a row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, frugal, in_pieces, join_by_key, materialize
from .components import components
from .shingles import U, batch_shingles, mixed

ROWS, BANDS = 5, 40
HASHES = ROWS * BANDS
THRESHOLD_PERCENT, SCREEN = 80, 0.67
#: Members of one side of a block.
BLOCK_MEMBERS = 512

_random = np.random.default_rng(20)
FACTORS, SHIFTS = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) | U(1), _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """32-bit minima, a row a set; rows of empty sets mean nothing."""
    full = [s if len(s) else np.zeros(1, U) for s in sets]
    flat = np.concatenate(full)
    starts = np.cumsum([0, *map(len, full[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((flat * FACTORS[k] + SHIFTS[k]) >> U(32)).astype(np.uint32), starts)
    return out


def totals(sets: list[np.ndarray], f) -> np.ndarray:
    return np.array([f(s).sum(dtype=U) for s in sets], U).view(np.int64)


def profile(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), s1, s2 (a 128-bit sum that tells sets apart), signature, bands."""

    def run(batches: Batches) -> Batches:
        for batch in in_pieces(batches, 1):
            sets = batch_shingles(batch.column(1).cast(pa.binary()).to_pylist(), words)
            low = minima(sets)
            keys = np.zeros((len(sets), BANDS), U)
            for r in range(ROWS):
                keys = mixed(keys * U(0x9E3779B97F4A7C15) + low[:, r::ROWS].astype(U) + U(1))
            n = np.array([len(s) for s in sets])
            bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(totals(sets, mixed)), pa.array(totals(sets, lambda s: mixed(s ^ U(0x5851F42D4C957F2D)))),
                 pa.array([r.tobytes() for r in low.astype(np.uint8)], pa.binary()), bands],
                ["doc_id", "n", "s1", "s2", "signature", "bands"],
            )

    return documents.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {dict(documents.dtypes)['doc_id']}, n long, s1 long, s2 long, signature binary, bands array<long>")


def shingle_sets(documents: DataFrame, words: int) -> DataFrame:
    """(doc_id, s1, members): the sets themselves."""

    def run(batches: Batches) -> Batches:
        for batch in in_pieces(batches, 1):
            sets = batch_shingles(batch.column(1).cast(pa.binary()).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals(sets, mixed)), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "s1", "members"])

    return documents.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {dict(documents.dtypes)['doc_id']}, s1 long, members binary")


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates from signatures as rows of 64-bit words: the bits that differ are folded to one a value and counted."""
    x = a ^ b
    x |= x >> U(4)
    x |= x >> U(2)
    x |= x >> U(1)
    x &= U(0x0101010101010101)
    same = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int32) / HASHES
    chance = 1 / 256
    return (same - chance) / (1 - chance)


def signature_words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U).reshape(-1, HASHES // 8)


def near_enough(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * np.minimum(n, m) >= THRESHOLD_PERCENT * np.maximum(n, m)


def screened(pairs: DataFrame) -> DataFrame:
    """(u, v) of the pairs (u, v, n, m, a, b) whose signatures a and b may belong to linked sets of sizes n and m."""

    def run(batches: Batches) -> Batches:
        for batch in in_pieces(batches, 4):
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            good = near_enough(n, m) & (similarity(signature_words(batch.column(4)), signature_words(batch.column(5))) >= SCREEN)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good))

    kind = dict(pairs.dtypes)["u"]
    return pairs.select("u", "v", "n", "m", "a", "b").mapInArrow(frugal(run), f"u {kind}, v {kind}")


class Forest:
    def __init__(self, labels: list):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.top(i)] = self.top(j)


def links_within(ids: list, labels: list, n: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray] | None, left: np.ndarray) -> list[tuple]:
    """Links that connect what is linked between the left and the other members, or among all if none is left; equal labels are connected already.

    Without sets the estimate alone decides.
    """
    forest, out = Forest(labels), []
    own = np.array([forest.top(i) for i in range(len(ids))])
    a, b = (np.flatnonzero(left), np.flatnonzero(~left)) if left.any() else (np.arange(len(ids)),) * 2
    found = []
    for i in a.tolist():
        other = b[(own[b] != own[i]) & near_enough(n[b], n[i])]
        if not left.any():
            other = other[other > i]
        if len(other):
            est = similarity(signatures[other], signatures[i])
            good = est >= SCREEN
            found += zip(est[good].tolist(), [i] * int(good.sum()), other[good].tolist(), strict=True)
    for _, i, j in sorted(found, key=lambda f: -f[0]):
        if forest.top(i) == forest.top(j):
            continue
        if sets is not None:
            both = len(sets[i]) + len(sets[j]) - len(np.unique(np.concatenate([sets[i], sets[j]])))
            if 100 * both < THRESHOLD_PERCENT * (len(sets[i]) + len(sets[j]) - both):
                continue
        forest.join(i, j)
        out.append((ids[i], ids[j]))
    return out


def compared(blocks: DataFrame) -> DataFrame:
    """(u, v): links from rows of g, i, j, left, node, label, n, signature and perhaps members; a block is what has equal g, i, j."""
    kind = dict(blocks.dtypes)["node"]
    names = ["g", "i", "j", "left", "node", "label", "n", "signature"]
    exact = "members" in blocks.columns

    def run(batches: Batches) -> Batches:
        own, now = [], None

        def close(type_: pa.DataType) -> Batches:
            if len(own) > 1:
                _, _, _, left, ids, labels, n, signatures, *sets = zip(*own, strict=True)
                members = [np.frombuffer(x, U) for x in sets[0]] if exact else None
                found = links_within(ids, labels, np.array(n), np.frombuffer(b"".join(signatures), U).reshape(len(own), -1), members, np.array(left))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], type_), pa.array([b for _, b in found], type_)], ["u", "v"])
            own.clear()

        for batch in in_pieces(batches, 8 if exact else 7):
            type_ = batch.schema.field(4).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != now:
                    yield from close(type_)
                    now = row[:3]
                own.append(row)
        if own:
            yield from close(type_)

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.select(*names, *(["members"] if exact else [])).repartition(parts, "g", "i", "j").sortWithinPartitions("g", "i", "j")
    return dealt.mapInArrow(frugal(run), f"u {kind}, v {kind}")


def across_labels(members: DataFrame) -> DataFrame:
    """(g, i, j, left, node, label): blocks that compare all members (g, node, label) of unlike labels, for groups of several labels.

    What isn't of the group's main label stands on the left of a block for
    every part of the group; a group of one block is compared among itself.
    """
    per = members.groupBy("g", "label").agg(F.count("*").alias("c"))
    groups = per.groupBy("g").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    size = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK_MEMBERS)).cast("int")
    groups = materialize(groups.select("g", F.col("main.label").alias("main"), size(F.col("m")).alias("parts"), size(F.col("m") - F.col("main.c")).alias("others")), "near-groups")
    met = materialize(join_by_key(members, groups, ["g"]), "near-grouped")
    part = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = met.select("g", every("others").alias("i"), part("right", "parts").alias("j"), F.lit(False).alias("left"), "node", "label")
    left = met.where("parts > 1 AND label <> main").select("g", part("left", "others").alias("i"), every("parts").alias("j"), F.lit(True).alias("left"), "node", "label")
    return right.unionByName(left)


def regions(reps: DataFrame) -> DataFrame:
    """(node, component): representatives that hang together through shared bands and near signatures."""
    keyed = reps.select(F.col("doc_id").alias("node"), F.posexplode("bands").alias("band", "key"))
    pivots = keyed.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    buckets = materialize(keyed.join(pivots, ["band", "key"]).select(F.xxhash64("band", "key").alias("g"), "node", "pivot", "members"), "near-buckets")
    side = lambda node, n, sig: reps.select(F.col("doc_id").alias(node), F.col("n").alias(n), F.col("signature").alias(sig))
    star = materialize(buckets.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct().join(side("u", "n", "a"), "u"), "near-stars")
    near = materialize(screened(join_by_key(star, side("v", "m", "b"), ["v"])), "near-pairs")
    # buckets of more than a pair where not all are like the pivot, each set of members once
    large = materialize(buckets.where("members > 2").select("g", F.col("node").alias("u"), F.col("pivot").alias("v")).join(near.withColumn("like", F.lit(True)), ["u", "v"], "left"), "near-large-buckets")
    alone = F.col("like").isNull() & (F.col("u") != F.col("v"))
    open_ = large.groupBy("g").agg(F.count("*").alias("m"), F.max(alone.cast("int")).alias("alone"), F.sum(F.xxhash64("u", alone).cast("decimal(38,0)")).alias("who")).where("alone = 1")
    once = materialize(open_.groupBy("m", "who").agg(F.min("g").alias("g")).select("g"), "near-open-buckets")
    if once.limit(1).count():
        members = join_by_key(large, once, ["g"]).select("g", F.col("u").alias("node"), F.when(alone, F.col("u")).otherwise(F.col("v")).alias("label"))
        more = compared(across_labels(materialize(members, "near-open-members")).join(side("node", "n", "signature"), "node"))
        near = near.unionByName(materialize(more, "near-pairs"))
    return components(near)


def links(documents: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """(u, v): links between representatives that connect all linked ones."""
    region = materialize(regions(reps), "near-regions")
    nodes = region.select(F.col("node").alias("doc_id"))
    texts = documents.select("doc_id", "text").join(nodes, "doc_id", "left_semi")
    sets = shingle_sets(texts, words).withColumnRenamed("doc_id", "node")
    one = reps.select(F.col("doc_id").alias("node"), "s1", "n", "signature")
    whole = materialize(one.join(sets, ["node", "s1"]).dropDuplicates(["node", "s1", "n"]).drop("s1"), "near-sets")
    # parts of a region overlap, so that its bulk hangs together at once
    sizes = region.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("parts"))
    placed = materialize(join_by_key(region, sizes, ["component"]), "near-placed")
    q = F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int")
    both = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array(q, F.pmod(q + 1, F.col("parts"))))
    first = placed.select(F.col("component").alias("g"), F.explode(both).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("left"), "node", F.col("node").alias("label"))
    found = materialize(compared(first.join(whole, "node")), "near-links")
    large = placed.where("parts > 3")  # up to three parts, the overlaps hold every pair
    if not large.limit(1).count():
        return found
    # what hangs together so far is handed on as stars, so that its components aren't searched for again
    stars = materialize(components(found), "near-stars-of-links")
    label = large.select(F.col("component").alias("g"), "node").join(stars, "node", "left").select("g", "node", F.coalesce("component", "node").alias("label"))
    rest = across_labels(materialize(label, "near-region-members"))
    more = materialize(compared(rest.join(whole, "node")), "near-links")
    return stars.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)


def near_duplicates(documents: DataFrame, words: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = materialize(profile(documents, words), "near-profiles")
    same = ["n", "s1", "s2"]
    classes = materialize(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("rep")), "near-classes")
    reps = rows.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *same]).dropDuplicates(["doc_id", *same])
    reps = materialize(reps, "near-representatives")
    # an id with several texts joins their classes
    small = materialize(rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", *same), "near-keys")
    of = materialize(join_by_key(small, classes, same).select("doc_id", "rep").distinct(), "near-ids")
    several = of.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("z")).where("v <> z").select("doc_id", "v")
    bound = of.join(several, "doc_id").select(F.col("rep").alias("u"), "v").where("u <> v")
    found = components(links(documents, reps, words).unionByName(bound))
    label = of.join(found.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("label"))
    out = rows.select("doc_id", "n").join(label, "doc_id", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
