"""SimHash fingerprints, and links between them found through pivot distance tables.

Hamming distance to a reference fingerprint differs by at most d between fingerprints d bits apart.
The table holds, for every distinct fingerprint, its distances to 33 block pivots (zero, and one
for each two-bit block) and to eight scattered pivots. From zero's and a block's distance follows the
number of bits set in the block. Two flipped bits change at most two blocks; of five groups of
blocks three therefore keep all coordinates, so linked fingerprints meet under one of ten keys. Pairs under
a key are discarded by the largest difference of their scattered coordinates, survivors are
verified by true distance. A key with over ``dense`` fingerprints isn't paired: its members are linked
through the 65 fingerprints within one bit of each (two within two bits share such a neighbour), which is
exact as well and linear in the members.

Defined results: null and blank texts have fingerprint zero, which links like any other; a null
identifier is ignored in a component's least unless all are null; repeated rows give repeated rows; very long texts
are shingled whole, in blocks; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import located, released, restored, settle, small_batches, small_enough, spread_join, work_dir

SHINGLE = 3
SEED = 42
RADIUS = 2
_GROUPS = [range(0, 7), range(7, 14), range(14, 20), range(20, 26), range(26, 32)]
#: Eight scattered reference fingerprints, from a multiplicative rule.
_SCATTERED = [(0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64 for j in range(1, 9)]


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text: A-Z lower-cased, words between blanks, word shingles with repeats."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return int(xxh64_intdigest(b" ".join(words), seed))
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), dtype="<u8", count=n)
    for at in range(0, n, 32768):
        part = hashes[at : at + 32768].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _to_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        values = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), np.uint64, len(texts)).view(np.int64)
        columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        names = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(values)], names=[*names, "fp"])


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot))))


def distance_table(fps: DataFrame) -> DataFrame:
    """fp, its ten keys of block coordinates (exploded) and its distances to the scattered pivots, a byte each."""
    fp = F.col("fp")
    zero = F.bit_count(fp)
    groups = []
    for blocks in _GROUPS:
        code = F.lit(0).cast("long")
        for b in blocks:
            code = code * 3 + (zero + 2 - _distance(fp, 3 << (2 * b))) / 2
        groups.append(code.cast("long"))
    far = F.lit(0).cast("long")
    for j, pivot in enumerate(_SCATTERED):
        far = far + F.shiftleft(_distance(fp, pivot).cast("long"), 8 * j)
    table = fps.select("fp", far.alias("far"), *(g.alias(f"g{i}") for i, g in enumerate(groups)))
    keys = [sum(((F.col(f"g{g}") * 2187**i) for i, g in enumerate(three)), F.lit(k).cast("long") * 2**40) for k, three in enumerate(combinations(range(5), 3))]
    return table.select("fp", "far", F.explode(F.array(*keys)).alias("key"))


def _near(a: str, b: str, radius: int) -> Column:
    apart = [F.abs(F.shiftrightunsigned(a, 8 * j).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(b, 8 * j).bitwiseAND(F.lit(255))) for j in range(len(_SCATTERED))]
    return F.greatest(*apart) <= radius


def links(fps: DataFrame, dense: int = 64) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``fps`` (fp: distinct) at most two bits apart."""
    table = distance_table(fps)
    shared = settle(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = settle(spread_join(table, shared, "key", ["fp"], "inner", shared))
    light, heavy = met.filter(F.col("n") <= dense).drop("n"), met.filter(F.col("n") > dense)
    a, b = light.select("key", F.col("fp").alias("a"), F.col("far").alias("fa")), light.select(F.col("key").alias("other"), F.col("fp").alias("b"), F.col("far").alias("fb"))
    true = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = a.join(b, (F.col("key") == F.col("other")) & (F.col("a") < F.col("b")) & _near("fa", "fb", RADIUS) & true).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(64)))
    around = heavy.select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    # A neighbour z has at most 65 members, so these groups are bounded.
    least = around.groupBy("z").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = around.join(least, "z").filter("fp != b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def simhash_rows(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """id, the columns in ``keep``, fp: one row per document; settled, as the texts are read just once."""
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession, 500):
        return settle(rows.mapInArrow(_to_fingerprints, _schema(docs, id_col, keep)))


def _schema(docs: DataFrame, id_col: str, keep: tuple[str, ...]) -> str:
    kinds = {x.name: x.dataType.simpleString() for x in docs.schema}
    return ", ".join(["id " + kinds[id_col], *(f"{k} {kinds[k]}" for k in keep), "fp long"])


def _resolve(rows: DataFrame, dense: int) -> DataFrame:
    """``rows`` with ``least``: the least identifier, with its place if there is one, of each row's component."""
    least = F.min(F.struct(F.col("id").isNull().alias("none"), *(c for c in rows.columns if c != "fp"))).alias("least")
    fps = settle(rows.groupBy("fp").agg(least, F.count(F.lit(1)).alias("n")))
    tied = components(links(fps.select("fp"), dense))
    in_component = tied.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(tied.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    linked = fps.join(in_component, "fp", "left").filter((F.col("n") > 1) | F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "fp"))
    by_root = settle(linked.groupBy("root").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n")))
    lookup = spread_join(linked.select("fp", "root"), by_root.drop("n"), "root", ["fp"], "inner", by_root.select("root", "n")).select("fp", "least")
    return spread_join(rows, settle(lookup), "fp", rows.columns, sizes=fps.select("fp", "n"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least identifier reachable over links)."""
    out = _resolve(simhash_rows(docs, id_col, text_col), dense)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = 64) -> DataFrame:
    """``docs`` with one row of each component, the one with the least identifier; all columns as they came."""
    work = work_dir(docs.sparkSession, "near")
    rows, names = located(docs, work)
    found = _resolve(simhash_rows(rows, names[id_col], names[text_col], "_at"), dense)
    dropped = settle(found.filter(F.col("_at") != F.col("least._at")).select("_at"))
    return released(restored(rows.join(small_enough(dropped), "_at", "left_anti"), names), work)
