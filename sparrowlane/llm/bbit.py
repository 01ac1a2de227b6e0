"""Near-duplicate detection by b-bit MinHash with exact confirmation.

Sets are the distinct five-word shingles of a text.  Equal sets are one class, found by their fingerprint; everything
below works on classes.  A class has minima under 256 hash functions: the first 128 form 32 bands of four, and the low four
bits of each minimum are kept as a packed signature of 128 bytes.  Two sets of similarity 0.75 share no band in one of
200,000 cases.

Buckets are classes with an equal band.  Their pairs are never all emitted:

1. Stars: each class is paired with the smallest and the largest class of each of its buckets.  These pairs, linear in
   the bucket, are estimated from their signatures and confirmed on the full sets.
2. Rests: classes in one component of the stars' links need no more comparison.  Only in buckets that still hold several
   components, classes of different ones are compared: in memory, by signature bits, each pair in its first common band
   alone.  What passes leaves the task as one row of partners per class; the full sets of these classes are brought to
   the task again and confirm enough links to join all that belong together.  Buckets larger than a block are compared
   block against block in tasks of their own; the blocks of a bucket's largest component meet only those of the others, so
   a large group with a few outsiders costs its size, not its square.  No class and no pair is dropped.

The estimate from equal low bits is corrected for chance, J = (E - 2^-b) / (1 - 2^-b).  Pairs under 0.60 are dropped: over
five standard deviations below 0.75, which at exactly 0.75 one pair in ten million falls under.  Confirmation counts the intersection of the sets (100 * common >= 75 * all).
Components of the confirmed links follow from alternating stars.

Texts that are null or have no words have an empty set and are linked with nothing, each a component of its own.  With
fewer than five words the whole sequence is the one shingle.  Very long texts are read whole.  Rows that repeat an id are
classified by their own texts; null ids never name a component unless all its ids are null.  An empty table gives no rows.
:func:`without_near_duplicates` keeps one row of each group: of the smallest id, and where that is repeated, of the text
with the smallest hash; a row that repeats id and text stays once, also without words.  Other columns pass through it in a
struct and are ignored elsewhere, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SHINGLE = 5
HASHES = 256
BANDS, ROWS = 32, 4
BITS = 4
LEAST_ESTIMATE = 0.60
BLOCK = 2048
MOST_BROADCAST_IDS = 1_000_000  # of 8 bytes

_random = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)


# ---------------------------------------------------------------- signatures

def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over the set."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 128):
        part = shingles[None, at : at + 128] * _FACTORS[:, None]
        part += _SHIFTS[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(minimum: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, which holds the band's number."""
    rows = minimum[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = common.mix(key * common.MULTIPLIER + rows[:, k])
    return key


def packed_bits(minimum: np.ndarray) -> bytes:
    """The low bits of the minima, two to a byte."""
    low = (common.mix(minimum) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Corrected similarity of packed signatures (rows of 64-bit words), by counting the equal groups of bits."""
    different = a ^ b
    different |= different >> np.uint64(2)
    different |= different >> np.uint64(1)
    n = np.bitwise_count(different & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - n / HASHES - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sorted distinct sets have 100 * common >= 75 * all."""
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)))
    common_ = int((both[1:] == both[:-1]).sum())
    return 100 * common_ >= 75 * (len(a) + len(b) - common_)


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=9) - (1 << 63)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written ``id, text_hash, n, node, bands, bits``: node is the fingerprint of the set, null for an empty one."""
    common.workers_can_import(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    @common.lean
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                sets = common.shingle_sets(common.texts_of(part.column("text")), SHINGLE)
                lows = [minima(s) if len(s) else None for s in sets]
                columns = [
                    part.column("id"),
                    part.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([None if m is None else band_keys(m).view(np.int64) for m in lows], pa.list_(pa.int64())),
                    pa.array([None if m is None else packed_bits(m) for m in lows], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "n", "node", "bands", "bits"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return common.written(rows.mapInArrow(sign, f"id {id_type}, text_hash long, n long, node long, bands array<long>, bits binary"), "signatures")


# ---------------------------------------------------------------- confirmation

def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written ``node, shingles`` (packed) of the wanted nodes, from the text of one document of each class."""
    wanted = common.written(classes.join(nodes, "node", "left_semi").select("id"), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST_IDS else wanted
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(side.select(F.col("id").alias("wanted_id")), rows["id"].eqNullSafe(F.col("wanted_id")), "left_semi")

    @common.lean
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                sets = [s for s in common.shingle_sets(common.texts_of(part.column("text")), SHINGLE) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    # a repeated id may bring other texts, and repeated rows the same
    found = rows.mapInArrow(shingled, "node long, shingles binary").join(nodes, "node", "left_semi")
    found = common.written(found.dropDuplicates(["node"]), "sets")
    common.delete(docs.sparkSession, wanted)
    return found


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows ``a, b`` of ``a, partners`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    rows = pairs.select("a", F.explode("partners").alias("b")).join(left, "a").join(right, "b").select("a", "b", "x", "y")

    @common.lean
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = [linked(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(confirm, "a long, b long")


# ---------------------------------------------------------------- candidates

def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, partners`` of the pairs ``a, b`` whose sizes and signatures allow a link."""
    left = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    near = pairs.join(left, "a").join(right, "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)")

    @common.lean
    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array(estimates(x, y) >= LEAST_ESTIMATE))

    return near.select("a", "b", "x", "y").mapInArrow(estimate, "a long, b long").select("a", F.array("b").alias("partners"))


_TASK = ["key", "first", "second"]
_REST = "key long, first int, second int, node long, partners array<long>"
_REST_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]


def _compare(table: dict[str, np.ndarray], first: int, second: int) -> list[tuple[int, np.ndarray]]:
    """Partners of each class of block ``first`` in block ``second``: of other groups, near by bits, no earlier band shared."""
    out = []
    inside = np.flatnonzero(table["block"] == first)
    across = inside if first == second else np.flatnonzero(table["block"] == second)
    for at, i in enumerate(inside.tolist()):
        others = across[at + 1 :] if first == second else across
        n = table["n"][others]
        others = others[(table["label"][others] != table["label"][i]) & (4 * np.minimum(n, table["n"][i]) >= 3 * np.maximum(n, table["n"][i]))]
        if len(others):
            others = others[estimates(table["bits"][others], table["bits"][i]) >= LEAST_ESTIMATE]
        if len(others):
            band = int(table["band"][i])
            earlier = (table["bands"][others, :band] == table["bands"][i, :band]).any(axis=1)
            others = others[~earlier]
        if len(others):
            out.append((int(table["node"][i]), table["node"][others]))
    return out


def _rests(buckets: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """``key, first, second, node, partners``: the classes of each task with candidates in other groups, and the candidates."""
    spark = buckets.sparkSession
    labelled = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    mixed = mixed.select("key", F.col("main.label").alias("main"), blocks(F.col("main.n")).alias("mains"), blocks(F.col("size") - F.col("main.n")).alias("others"))
    # the classes of the largest component lie in blocks of their own, which meet those of the others but not each other
    rows, inside = labelled.join(mixed, "key"), F.col("label") == F.col("main")
    dealt = F.xxhash64("node")
    block = F.when(inside, F.pmod(dealt, F.col("mains"))).otherwise(F.col("mains") + F.pmod(dealt, F.col("others"))).cast("int")
    meets = F.sequence(F.when(inside, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)
    rows = rows.select("key", "band", "node", "label", block.alias("block"), F.explode(meets).alias("other"))
    rows = rows.select("key", "band", "node", "label", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    rows = rows.join(classes.select("node", "n", "bits", "bands"), "node")
    task = _TASK
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*task, "block", "band", "node", "label", "n", "bits", "bands").repartition(parts, *task).sortWithinPartitions(*task, "node")

    @common.lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tasks(batches, task):
            keys = np.stack([table.column(c).to_numpy() for c in task], axis=1)
            starts = np.flatnonzero(np.insert((keys[1:] != keys[:-1]).any(axis=1), 0, True))
            columns = {c: table.column(c).to_numpy() for c in ("node", "label", "n", "block", "band")}
            columns["bits"] = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(table.num_rows, -1)
            columns["bands"] = table.column("bands").combine_chunks().flatten().to_numpy().reshape(table.num_rows, BANDS)
            rows = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                own = dict(_compare({c: v[a:b] for c, v in columns.items()}, int(keys[a, 1]), int(keys[a, 2])))
                ends = np.setdiff1d(np.concatenate(list(own.values())), list(own)).tolist() if own else []
                rows += [(*keys[a].tolist(), n, p) for n, p in own.items()] + [(*keys[a].tolist(), n, []) for n in ends]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _REST_TYPES, strict=True)], [*_TASK, "node", "partners"])

    return dealt.mapInArrow(compare, _REST)


def _confirmed_rests(rests: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` that join all classes which the full sets join within a task; a spanning set, so linear in the classes."""
    parts = int(rests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rests.join(sets, "node").select(*_TASK, "node", "partners", "shingles").repartition(parts, *_TASK).sortWithinPartitions(*_TASK, "node")

    @common.lean
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tasks(batches, _TASK):
            keys = np.stack([table.column(c).to_numpy() for c in _TASK], axis=1)
            starts = np.flatnonzero(np.insert((keys[1:] != keys[:-1]).any(axis=1), 0, True)).tolist()
            nodes, partners, packed = table.column("node").to_pylist(), table.column("partners").to_pylist(), table.column("shingles").combine_chunks()
            found = []
            for first, last in zip(starts, [*starts[1:], table.num_rows], strict=True):
                place = {nodes[i]: i for i in range(first, last)}
                sets_of_task = {n: np.frombuffer(packed[i].as_buffer(), np.uint64) for n, i in place.items()}
                root = {n: n for n in place}

                def top(n: int, root: dict = root) -> int:
                    while root[n] != n:
                        root[n] = root[root[n]]
                        n = root[n]
                    return n

                for n, i in place.items():
                    for other in partners[i]:
                        a, b = top(n), top(other)
                        if a != b and linked(sets_of_task[n], sets_of_task[other]):
                            root[max(a, b)] = min(a, b)
                            found.append((n, other))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return rows.mapInArrow(confirm, "a long, b long")


def _whole_tasks(batches: Iterator[pa.RecordBatch], task: list[str]) -> Iterator[pa.Table]:
    """Tables cut only between tasks; rows of a task are consecutive and at most two blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in task), strict=True))
        cut = next((i for i in range(len(keys) - 1, 0, -1) if keys[i - 1] != keys[-1]), 0)
        if not cut and (not held or keys[0] == tuple(held[-1].column(c)[-1].as_py() for c in task)):
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, n, component, component_id`` of each row; component is null for empty sets."""
    spark = docs.sparkSession
    signed = signatures(docs, id_col, text_col)
    classes = signed.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = common.written(classes, "classes")
    members = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).where("size > 1").select("key", "low", "high")
    buckets = common.written(members.join(shared, "key"), "buckets")

    leaders = buckets.select(F.explode(F.array("low", "high")).alias("a"), F.col("node").alias("b")).where("a <> b")
    stars = common.written(_estimated(leaders.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes), "stars")
    star_nodes = stars.select(F.col("a").alias("node")).union(stars.select(F.explode("partners").alias("node"))).distinct()
    star_sets = sets_of(star_nodes, classes, docs, id_col, text_col)
    label = common.written(connected_components(confirmed(stars, star_sets)).withColumnRenamed("component", "label"), "labels")
    common.delete(spark, stars, star_sets)
    rests = common.written(_rests(buckets.select("key", "band", "node"), label, classes), "rests")
    rest_sets = sets_of(rests.select("node").distinct(), classes, docs, id_col, text_col)
    joined = label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(_confirmed_rests(rests, rest_sets))
    component = common.written(connected_components(joined), "components")
    common.delete(spark, buckets, label, rests, rest_sets)

    named = component.join(classes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("component_id"))
    of_node = component.join(named, "component").select("node", "component", "component_id")
    of_class = classes.select("node", "id").join(of_node, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "id").alias("component_id"))
    out = signed.select("id", "text_hash", "n", "node").join(of_class, "node", "left")
    found = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "text_hash", "n", "component", found.alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id, kept of each row."""
    out = grouped(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns."""
    kept = grouped(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("component_id")))
    # narrow rows: how often the chosen text of the smallest id occurs
    texts = kept.groupBy("component", "id", "text_hash").agg(F.count("*").alias("rows"))
    chosen = texts.groupBy("component", "id").agg(F.min(F.struct("text_hash", "rows")).alias("c"))
    chosen = common.written(chosen.select(F.col("id").alias("kept_id"), F.col("c.text_hash").alias("kept_hash"), (F.col("c.rows") > 1).alias("again")), "kept")
    rows = docs.select(common.row_of(docs), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    same = lambda c: rows["id"].eqNullSafe(c["kept_id"]) & (rows["text_hash"] == c["kept_hash"])
    single, again = chosen.where("not again"), chosen.where("again").select("kept_id", "kept_hash").distinct()
    out = rows.join(single, same(single), "left_semi").select("row.*")
    if again.isEmpty():
        return out
    repeated = rows.join(again, same(again), "left_semi").groupBy("id", "text_hash").agg(F.first("row").alias("row")).select("row.*")
    return out.unionByName(repeated)
