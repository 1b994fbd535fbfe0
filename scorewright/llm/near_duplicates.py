"""Near-duplicate groups: bottom-k sketches from one hash, inverted lists of retained values, exact Jaccard on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from scorewright.llm.components import components
from scorewright.llm.tables import bounded_batches, saved
from scorewright.llm.words import lists, mix, shingle_sets

KEEP = 48  # hashes retained per set
SHARED = 25  # retained values two linked sets share at least: 3.7 deviations under the mean at similarity 0.75, more above it
ESTIMATE = 0.5  # least union-sketch estimate that goes on to the exact test: 4 deviations under 0.75
LEADER_ROUNDS = 3
FILTER_BITS = 26  # of the bit filter that tells the second read of the texts which sets are asked for


def _fingerprint(sets: np.ndarray) -> int:
    """One 63-bit value per shingle set: the sum of its scrambled hashes and its size, scrambled."""
    return int(mix(np.array([np.sum(mix(sets.view(np.uint64) + np.uint64(7)), dtype=np.uint64) + np.uint64(len(sets))], np.uint64))[0] >> np.uint64(1))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints, kept = [], [], []
        for s in shingle_sets(batch.column(batch.schema.get_field_index("set_print")).cast(pa.large_string())):
            sizes.append(len(s))
            prints.append(_fingerprint(s) if len(s) else None)
            kept.append(s[:KEEP])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), lists(kept)], ["row_id", "row_key", "n_shingles", "set_print", "sketch"])


def _bit(prints: np.ndarray) -> np.ndarray:
    return mix(prints.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)


def _wanted_bits(df: DataFrame) -> np.ndarray:
    """A bit filter of fixed size over the prints in ``df``: its parts are made in the tasks and united by position."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bit(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.left_shift(np.uint64(1), at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], ["word", "bits"])

    parts = df.mapInArrow(part, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for row in parts.toArrow().to_batches():  # at most 2**20 rows, whatever the input
        out[row.column(0).to_numpy()] = row.column(1).to_numpy().view(np.uint64)
    return out


def _full_sets(docs: DataFrame, text: str, prints: DataFrame) -> DataFrame:
    """(set_print, shingles) of the sets whose print is in ``prints``: one more read of the texts, with a bit filter before the shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(_wanted_bits(prints))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = bits.value
        for batch in batches:
            found, sets = [], []
            for s in shingle_sets(batch.column(0)):
                if len(s):
                    p = _fingerprint(s)
                    at = int(_bit(np.array([p], np.int64))[0])
                    if int(filled[at >> 6]) >> (at & 63) & 1:
                        found.append(p)
                        sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), lists(sets)], ["set_print", "shingles"])

    sets = docs.select(F.col(text).cast("string")).mapInArrow(run, "set_print long, shingles array<long>")
    # rows with equal sets meet once: the first copy is as good as any
    return sets.groupBy("set_print").agg(F.first("shingles").alias("shingles"))


def _texts_of(docs: DataFrame, text: str, prints: DataFrame) -> DataFrame:
    """The texts whose set is in ``prints`` (and the few others that the bit filter lets pass)."""
    bits = docs.sparkSession.sparkContext.broadcast(_wanted_bits(prints))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = bits.value
        for batch in batches:
            found = np.array([_fingerprint(s) if len(s) else -1 for s in shingle_sets(batch.column(0))], np.int64)
            at = _bit(found).astype(np.int64)
            hit = (found >= 0) & ((filled[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit))], ["text"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "text string")


def _prefixes(sketches: DataFrame) -> DataFrame:
    """(value, node, n, popular): the rarest values of each sketch, so many that two sets with ``SHARED`` values in common meet in one list.

    ``popular`` adds up how many sets share each value of the sketch: in a group of edited copies it is highest for the least edited ones.
    """
    entries = sketches.select("node", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    common = entries.groupBy("value").agg(F.count("*").alias("users")).where("users > 1")
    # values that no other set has come first in the order, so they use up the prefix without a list of their own
    shared = entries.join(common, "value").groupBy("node", "n", "kept").agg(F.array_sort(F.collect_list(F.struct("users", "value"))).alias("shared"))
    room = F.col("kept") - F.least(F.lit(SHARED), F.ceil(F.col("kept") * (SHARED / KEEP))) + 1 - (F.col("kept") - F.size("shared"))
    popular = F.aggregate("shared", F.lit(0).cast("long"), lambda n, s: n + s.users)
    chosen = shared.where(room > 0).select("node", "n", popular.alias("popular"), F.explode(F.slice("shared", 1, room.cast("int"))).alias("s"))
    return chosen.select(F.col("s.value").alias("value"), "node", "n", "popular")


def _size_fits(a: Column | str, b: Column | str) -> Column:
    a, b = F.col(a), F.col(b)
    return (F.least(a, b) * 100 >= F.greatest(a, b) * 75)


def _estimate() -> Column:
    """Share of the smallest values of the united sketches that both sketches have."""
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, F.least(F.lit(KEEP), F.greatest(F.size("sketch_a"), F.size("sketch_b"))))
    both = F.array_intersect("sketch_a", "sketch_b")
    return F.size(F.array_intersect(both, union)) / F.size(union)


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= 75 * union."""
    small = sketches.select("node", "sketch")
    near = pairs.join(small.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    near = near.join(small.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    near = saved(near.where(_estimate() >= ESTIMATE).select("a", "b"))
    if near.isEmpty():
        return near
    sets = saved(_full_sets(docs, text, near.select(F.col("a").alias("p")).unionByName(near.select(F.col("b").alias("p"))).distinct()))
    joined = near.join(sets.select(F.col("set_print").alias("b"), F.col("shingles").alias("set_b")), "b")
    joined = joined.join(sets.select(F.col("set_print").alias("a"), F.col("shingles").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    joined = joined.select("a", "b", common.alias("i"), (F.size("set_a") + F.size("set_b")).alias("s"))
    return saved(joined.where("100 * i >= 75 * (s - i)").select("a", "b"))


def _shared_sizes(docs: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """(node, common): how many shingles of each whole set some other of ``nodes`` has too; nodes that share too little to be similar to any are left out."""
    sets = saved(_full_sets(docs, text, nodes).join(nodes.select(F.col("node").alias("set_print")).distinct(), "set_print", "left_semi"))
    flat = sets.select(F.col("set_print").alias("node"), F.explode("shingles").alias("h"))
    shared = flat.groupBy("h").agg(F.count("*").alias("users")).where("users > 1").select("h")
    common = flat.join(shared, "h").groupBy("node").agg(F.count("*").alias("common"))
    return common.join(sets.select(F.col("set_print").alias("node"), F.size("shingles").alias("whole")), "node").where("100 * common >= 75 * whole").select("node", "common")


def _links(docs: DataFrame, text: str, sketches: DataFrame) -> DataFrame | None:
    """Links that hold every group of similar sets together, without all pairs of a group.

    Each round compares one leader of every inverted list with the members that are in other groups and joins those that match. A leader has
    then met all members of its list and leaves it. After ``LEADER_ROUNDS`` rounds large groups are one. The members of a list that are
    still in different groups are then compared with each other, but for pairs that their counts of shared shingles rule out, so no link is lost.
    """
    members = saved(_prefixes(sketches))
    # the rounds read the texts that are in some list, not all of them again
    docs, text = saved(_texts_of(docs, text, members.select("node"))), "text"
    links: DataFrame | None = None
    labels: DataFrame | None = None
    for turn in range(LEADER_ROUNDS + 1):
        held = members.withColumn("root", F.col("node"))
        if labels is not None:
            held = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # the most popular members lead first, as one of them most likely links to most of a group; then any
        first = -F.col("popular") if turn < LEADER_ROUNDS - 1 else F.lit(0)
        lead = F.min(F.struct(first.alias("f"), F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("leader"), F.col("n").alias("leader_n"), F.col("root").alias("leader_root")))
        lead = held.groupBy("value").agg(lead.alias("l"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("value", "l.*")
        if turn < LEADER_ROUNDS:
            met = held.join(lead, "value").where((F.col("root") != F.col("leader_root")) & _size_fits("n", "leader_n"))
            pairs = met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        else:
            left = saved(held.join(lead.select("value"), "value", "left_semi"))
            left = left.join(_shared_sizes(docs, text, left.select("node")), "node")
            other = left.select("value", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("root").alias("other_root"), F.col("common").alias("other_common"))
            # what two sets have in common is no more than either shares with any, and similar sets need 3/7 of both sizes
            fits = F.least("common", "other_common") * 7 >= (F.col("n") + F.col("other_n")) * 3
            met = left.join(other, "value").where((F.col("node") < F.col("other")) & (F.col("root") != F.col("other_root")) & _size_fits("n", "other_n") & fits)
            pairs = met.select(F.col("node").alias("a"), F.col("other").alias("b"))
        pairs = saved(pairs.distinct())
        if pairs.isEmpty():
            if turn == LEADER_ROUNDS:
                break
        else:
            found = _verified(pairs, sketches, docs, text)
            links = found if links is None else links.unionByName(found)
            labels = components(links)
        if turn < LEADER_ROUNDS:
            members = saved(members.join(lead.select("value", F.col("leader").alias("node")), ["value", "node"], "left_anti"))
    return labels


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text).cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row_key, stays): one row per row of ``docs``, grouped by 5-word shingle similarity of 0.75 or more.

    Words are runs of anything but space and 0x09-0x0D, with A-Z as a-z; a text of fewer than five words has one shingle, its whole sequence;
    a null or wordless text has none and is linked with nothing. Rows with equal shingle sets are one node, so copies are never paired. Links
    are confirmed on whole sets of 63-bit shingle hashes. component_id is the smallest doc_id of the group (a row's own id if it has no
    words); a null id never becomes one unless the group has no other. Repeated rows give repeated results. ``stays`` marks one distinct
    (doc_id, text) of each group, by its ``row_key``, where ids alone would not do.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("row_id"), row_key(doc_id, text).alias("row_key"), F.col(text).cast("string").alias("set_print"))
    schema = source.select("row_id", "row_key").schema.add("n_shingles", "long").add("set_print", "long").add("sketch", ArrayType(LongType()))
    rows = saved(source.mapInArrow(_sketches, schema))
    nodes = rows.where("set_print is not null").groupBy(F.col("set_print").alias("node"))
    sketches = saved(nodes.agg(F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    labels = _links(docs, text, sketches)
    slim = rows.select("row_id", "row_key", "n_shingles", "set_print")
    if labels is None:
        slim = slim.withColumn("root", F.col("set_print"))
    else:
        slim = slim.join(labels.withColumnRenamed("node", "set_print"), "set_print", "left").withColumn("root", F.coalesce("root", "set_print"))
    # an id of null comes last
    first = F.min(F.struct(F.col("row_id").isNull().alias("no_id"), "row_id", "row_key"))
    least = slim.where("root is not null").groupBy("root").agg(first.alias("first"))
    out = slim.join(least, "root", "left")
    alone = F.col("root").isNull()
    component = F.when(alone, F.col("row_id")).otherwise(F.col("first.row_id"))
    return out.select(F.col("row_id").alias(doc_id), "n_shingles", component.alias("component_id"), F.coalesce(F.col("row_id") == component, F.lit(False)).alias("kept"),
                      "row_key", (alone | (F.col("row_key") == F.col("first.row_key"))).alias("stays"))
