"""Near copies by word shingles: documents whose sets of five-word shingles are alike to 0.8 or more, or whose
fingerprints link.

SimHash alone can't index this: at a similarity of 0.8 some ten of 64 bits differ, and no key survives that. So
candidates meet under minimum hashes of their shingles (24 keys of four; a pair at 0.8 shares none with probability 3e-6, a
more similar one with less), and the pivot distance table of their fingerprints discards pairs before the exact comparison:
a bit of two such fingerprints differs with probability 0.2 at most, so more than ``RADIUS`` = 34 of 64 do with less than
1e-8, and their distances to a pivot differ by no more than they do. Survivors are verified on their whole shingle sets. Links at
two bits by :mod:`perigee.llm.simhash` are added; components of both keep one row.

A key with over ``dense`` documents first compares its members with four of them only, the least of each residue, so
that nothing is paired within a group of copies. Where that leaves several components in a key, the members outside the
largest meet all others in blocks, and each pair of different components is compared; pairs within a component change nothing.

Defined results: null texts count as empty; fewer words than a shingle are one shingle; texts without words are
alike; a very long text is shingled whole; of a component the row with the least identifier stays (null is larger than every other), of equal ones the first in
place; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import located, released, restored, settle, small_batches, small_enough, spread_join, work_dir
from .simhash import _SCATTERED, _near, _resolve, _signed, fingerprint

SHINGLE, SIMILARITY = 5, 0.8
KEYS, ROWS = 24, 4
RADIUS = 34
#: Members of a crowded key that its others are compared with first.
LEAST = 4
#: Members in a block of a crowded key, and bytes of their shingle sets; two blocks meet in one task.
BLOCK, BLOCK_BYTES = 256, 8 << 20
_A = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) | 1) % 2**64 for i in range(KEYS * ROWS)], np.uint64)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = max(len(words) - shingle + 1, 1 if words else 0)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)] if words else [])
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64, n))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set under many multiplicative orders, four to a key."""
    if not len(hashes):
        return np.zeros(KEYS, np.uint64)
    mixed = hashes ^ (hashes >> np.uint64(31))
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(mixed), 1024):
        x = mixed[at : at + 1024, None] * _A[None]
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    key = np.zeros(KEYS, np.uint64)
    for r in range(ROWS):
        key = (key ^ least[r::ROWS]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return (key << np.uint64(5)) | np.arange(KEYS, dtype=np.uint64)  # keys of different places differ


def set_fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        sets = [shingle_hashes(x) for x in texts]
        columns = [
            batch.column("id"),
            batch.column("_at"),
            pa.array(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)),
            pa.array(np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64)),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([band_keys(s).view(np.int64).tolist() for s in sets], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "_at", "fp", "fp5", "n", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_hashes(x or b"").tobytes() for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(sets, pa.binary())], names=["uid", "s"])


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - both
                keep.append(both >= similarity * union)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _across(similarity: float):
    """Links between components of one key: left members against right ones, as many links as join components."""

    def run(table: pa.Table) -> pa.Table:
        uid, n, fp5 = (table.column(c).to_numpy() for c in ("uid", "n", "fp5"))
        stray, right = (table.column(c).to_numpy() for c in ("stray", "right"))
        fp5 = fp5.view(np.uint64)  # numpy counts the bits of absolute values
        _, root = np.unique(table.column("root").to_numpy(), return_inverse=True)
        part = np.arange(root.max() + 1)  # of each root
        sets = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.r_[0, np.cumsum(n)]
        others, marked, links = np.flatnonzero(right), np.zeros(len(ids) + 1, bool), []
        for a in np.flatnonzero(~right):
            sizes = np.minimum(n[a], n[others]) >= similarity * np.maximum(n[a], n[others])
            once = ~stray[others] | (uid[others] > uid[a])
            c = others[sizes & once & (part[root[others]] != part[root[a]]) & (np.bitwise_count(fp5[others] ^ fp5[a]) <= RADIUS)]
            if not len(c):
                continue
            own = ids[starts[a] : starts[a + 1]]
            marked[own] = True
            ends = np.r_[0, np.cumsum(n[c])]
            at = np.arange(ends[-1]) + np.repeat(starts[c] - ends[:-1], n[c])
            both = np.diff(np.r_[0, np.cumsum(marked[ids[at]])][ends])
            marked[own] = False
            c = c[both >= similarity * (n[a] + n[c] - both)]
            joined, first = np.unique(part[root[c]], return_index=True)
            part[np.isin(part, joined)] = part[root[a]]
            links += [(uid[a], uid[b]) for b in c[first]]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


def _texts(rows: DataFrame, sketch: DataFrame, uids: DataFrame, text_col: str) -> DataFrame:
    """uid, text of the documents asked for."""
    asked = settle(uids.distinct().join(sketch.select("uid", "_at"), "uid"))
    return rows.join(small_enough(asked), "_at").select("uid", F.col(text_col).alias("text"))


def crowded_links(rows: DataFrame, sketch: DataFrame, text_col: str, heavy: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that join what the links ``found`` leave apart within a key of ``heavy`` (key, uid, n, fp5)."""
    roots = components(found).select(F.col("a").alias("uid"), F.col("b").alias("root"))
    members = settle(heavy.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")))
    parts = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    largest = F.struct("c", "root", "w")
    keys = parts.groupBy("key").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("parts"), F.max(largest).alias("main")).where("parts > 1")
    blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(w * 8 / BLOCK_BYTES), F.lit(1)).cast("int")
    keys = settle(keys.select("key", F.col("main.root").alias("main"), blocks(F.col("c") - F.col("main.c"), F.col("w") - F.col("main.w")).alias("lefts"), blocks(F.col("c"), F.col("w")).alias("rights")))
    met = settle(spread_join(members, keys, "key", ["uid"], "inner").withColumn("stray", F.col("root") != F.col("main")))
    own = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "uid", "n", "fp5", "root", "stray"]
    left = met.where("stray").select(*columns, F.lit(False).alias("right"), own("lefts").alias("i"), every("rights").alias("j"))
    dealt = left.unionByName(met.select(*columns, F.lit(True).alias("right"), every("lefts").alias("i"), own("rights").alias("j")))
    with small_batches(rows.sparkSession, 500):
        sets = settle(_texts(rows, sketch, met.select("uid"), text_col).mapInArrow(_sets, "uid long, s binary"))
        return settle(dealt.join(sets, "uid").groupBy("key", "i", "j").applyInArrow(_across(similarity), "a long, b long").distinct())


def similar_links(rows: DataFrame, sketch: DataFrame, text_col: str, similarity: float = SIMILARITY, dense: int = 48) -> DataFrame:
    """Edges (a, b) on ``uid`` of documents whose shingle sets are alike."""
    far = F.lit(0).cast("long")
    for j, pivot in enumerate(_SCATTERED):
        far = far + F.shiftleft(F.bit_count(F.col("fp5").bitwiseXOR(F.lit(_signed(pivot)))).cast("long"), 8 * j)
    met = sketch.select("uid", "n", "fp5", far.alias("far"), F.explode("keys").alias("key"))
    shared = settle(met.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *(F.min(F.when(F.pmod("uid", F.lit(LEAST)) == i, F.struct("uid", "n", "fp5", "far"))).alias(f"least{i}") for i in range(LEAST))).where("size > 1"))
    sizes = shared.select("key", F.col("size").alias("n"))
    light = settle(spread_join(met, settle(shared.where(F.col("size") <= dense).select("key")), "key", ["uid"], "inner", sizes))
    left = light.select("key", *(F.col(c).alias(f"{c}_a") for c in ("uid", "n", "fp5", "far")))
    right = light.select(F.col("key").alias("other"), *(F.col(c).alias(f"{c}_b") for c in ("uid", "n", "fp5", "far")))
    sizes = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")
    apart = F.bit_count(F.col("fp5_a").bitwiseXOR(F.col("fp5_b"))) <= RADIUS
    discard = sizes & _near("far_a", "far_b", RADIUS) & apart
    pairs = left.join(right, (F.col("key") == F.col("other")) & (F.col("uid_a") < F.col("uid_b")) & discard).select(F.col("uid_a").alias("a"), F.col("uid_b").alias("b"))
    heavy = settle(spread_join(met, settle(shared.where(F.col("size") > dense)), "key", ["uid"], "inner", sizes))
    for i in range(LEAST):
        star = heavy.select(*(F.col(f"least{i}.{c}").alias(f"{c}_a") for c in ("uid", "n", "fp5", "far")), *(F.col(c).alias(f"{c}_b") for c in ("uid", "n", "fp5", "far")))
        pairs = pairs.unionByName(star.where((F.col("uid_a") != F.col("uid_b")) & discard).select(F.least("uid_a", "uid_b").alias("a"), F.greatest("uid_a", "uid_b").alias("b")))
    candidates = settle(pairs.distinct())
    texts = _texts(rows, sketch, candidates.select(F.explode(F.array("a", "b")).alias("uid")), text_col)
    with small_batches(rows.sparkSession, 500):
        sets = settle(texts.mapInArrow(_sets, "uid long, s binary"))
        both = spread_join(candidates, sets.select(F.col("uid").alias("a"), F.col("s").alias("sa")), "a", ["b"], "inner")
        both = spread_join(both, sets.select(F.col("uid").alias("b"), F.col("s").alias("sb")), "b", ["a"], "inner", candidates.groupBy("b").agg(F.count(F.lit(1)).alias("n")))
        found = settle(both.select("a", "b", "sa", "sb").mapInArrow(_alike(similarity), "a long, b long"))
    if heavy.isEmpty():
        return found
    return found.unionByName(crowded_links(rows, sketch, text_col, heavy.select("key", "uid", "n", "fp5"), found, similarity))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, dense: int = 48) -> DataFrame:
    """``docs`` with one row of each component of near copies; all columns as they came."""
    spark = docs.sparkSession
    work = work_dir(spark, "near")
    rows, names = located(docs, work)
    id_col, text_col = names[id_col], names[text_col]
    place = rows.schema["_at"].dataType.simpleString()
    kind = rows.schema[id_col].dataType.simpleString()
    with small_batches(spark, 500):
        sketch = settle(rows.select(F.col(id_col).alias("id"), "_at", F.col(text_col).alias("text")).mapInArrow(_sketch, f"id {kind}, _at {place}, fp long, fp5 long, n long, keys array<long>").withColumn("uid", F.monotonically_increasing_id()))
    alike = similar_links(rows, sketch, text_col, similarity, dense)
    # Rows with linked fingerprints are tied to the least of them.
    resolved = _resolve(sketch.select("id", "_at", "uid", "fp"), 64)
    linked = resolved.where("least IS NOT NULL AND uid != least.uid").select(F.col("uid").alias("a"), F.col("least.uid").alias("b"))
    tied = components(alike.unionByName(linked))
    member = tied.select(F.col("a").alias("uid"), F.col("b").alias("root")).unionByName(tied.select(F.col("b").alias("uid"), F.col("b").alias("root")).distinct())
    placed = settle(sketch.select("uid", "id", "_at").join(member, "uid"))
    least = settle(placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_at")).alias("least"), F.count(F.lit(1)).alias("n")))
    met = spread_join(placed, least.drop("n"), "root", ["uid"], "inner", least.select("root", "n"))
    dropped = settle(met.where(F.col("_at") != F.col("least._at")).select("_at"))
    return released(restored(rows.join(small_enough(dropped), "_at", "left_anti"), names), work)
