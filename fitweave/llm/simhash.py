"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into only three segments (22, 21 and 21 bits; more for distances above 5).  If two fingerprints
differ in at most 4 bits, one segment differs in at most one bit (three times two bits would be more
than four).  Each segment is indexed once per bit with that bit taken out, 64 signatures per distinct
fingerprint; segments that differ in at most that bit share the signature.  Signatures meet in one
equality join whose condition verifies the distance and keeps a pair only under its first signature,
so a link comes out once however many signatures it shares.

Bits alone miss pairs whose shingle sets are alike: sets with a Jaccard similarity of 0.8 differ in about 9 bits.
``near_dedup`` therefore links fingerprints of texts that share at least 0.8 of their five-word shingles as well.
Candidates share one of the ``SKETCH`` smallest shingle hashes of a text.  All pairs of up to ``GROUP`` sets with such a
hash are candidates.  In larger groups only the sets that may have a partner there are kept (``_prefixes``); they meet the first
one of the group, and then those not in their class by then whose whole sets may be alike (``_between_classes``): they share a
rare shingle, or have enough frequent ones.  So the classes are those of all pairs.  Pairs that bits have linked are left out,
pairs whose sketches or sizes rule the similarity out too, and the others are verified on their whole texts.  Sets of a large
group that are no near copies, but consist of shingles of more than ``GROUP`` others, still cost the square of their number.

Documents with the same fingerprint collapse before the index, so copies cost nothing, and documents
meet their group again in ``spread_join``.

Defined cases
* null text counts as empty; texts without words have fingerprint zero and link like any other
* fewer words than a shingle: the whole sequence is the only shingle
* repeated rows share their fingerprint and get one result row each
* null ``doc_id``: the row gets the class of its fingerprint; ids that are null never name a class
  unless no other id exists (then the class is null)
* very long texts are hashed in blocks of words; their distinct shingles take 8 bytes each
* an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitweave.llm.common import materialize, sized, spread_join, without_ids

SHINGLE = 4
DISTANCE = 4
BLOCK_BYTES = 1 << 19
# of ``near_dedup``
TEXT_SHINGLE, SIMILARITY = 5, 0.8
SKETCH = 16  # smallest shingle hashes, which bring sets together
GROUP = 32
CELL = 1024
SIZES = 32  # steps of set sizes, of 3 percent each
SLACK = 1e-6  # of rounding, in shingles
BATCH = 1 << 16
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(start, width) of as many segments as cover the distance without a miss, with one wildcard each; three at least."""
    count = max(3, distance // 2 + 1)
    bounds = [n * (64 // count) + min(n, 64 % count) for n in range(count + 1)]
    return [(a, b - a) for a, b in pairwise(bounds)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    total, count, carried = np.zeros(64, np.int64), 0, []
    for block in word_blocks((text or "").encode().lower()):  # on bytes: ASCII letters and ASCII white space only
        words = carried + block
        carried = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
        if len(words) >= shingle:
            hashes = shingle_hashes(words, shingle)
            count += len(hashes)
            total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not count:
        return xxhash.xxh64_intdigest(b" ".join(carried), 42) if carried else 0
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in blocks of about ``BLOCK_BYTES``, cut between words."""
    at = 0
    while at < len(data):
        space = SPACE.search(data, at + BLOCK_BYTES)
        end = space.start() if space else len(data)
        yield data[at:end].split()
        at = end


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    joined, n = b" ".join(words), len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(compute, "doc_id long, fp long")


def signatures(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per fingerprint and bit: the bit and its segment without that bit."""
    variants = [
        F.struct(
            F.lit(start + bit).cast("byte").alias("bit"),
            F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1 - (1 << bit))).cast("int").alias("rest"),
        )
        for start, width in segments(distance)
        for bit in range(width)
    ]
    return distinct.select("fp", F.inline(F.array(*variants)))


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """All pairs (a, b), a < b, of fingerprints that differ in at most ``distance`` bits, each once."""
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = signatures(distinct.repartition(tasks, "fp"), distance)  # a row becomes 64, so small files need more tasks
    a, b = F.col("x.fp"), F.col("y.fp")
    differ = a.bitwiseXOR(b)
    # the pair's first signature: of its first segment with at most one differing bit, that bit,
    # or the segment's lowest bit if the segments are equal
    first = F.lit(None).cast("int")
    for start, width in reversed(segments(distance)):
        part = F.shiftrightunsigned(differ, start).bitwiseAND(F.lit((1 << width) - 1))
        bit = F.when(part == 0, F.lit(start)).otherwise(F.lit(start) + F.bit_count(part - 1))
        first = F.when(F.bit_count(part) <= 1, bit).otherwise(first)
    # 64 rows come of each row of the file, so its size must not make this a broadcast
    return index.alias("x").hint("merge").join(
        index.alias("y"),
        (F.col("x.bit") == F.col("y.bit")) & (F.col("x.rest") == F.col("y.rest")) & (a < b)
        & (F.bit_count(differ) <= distance) & (F.col("x.bit").cast("int") == first),
    ).select(a.alias("a"), b.alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint reachable, for all fingerprints that occur in a link.

    Each round gives every node its smallest neighbour as parent, follows two parents more, and contracts
    the links to what is left between different parents.  At least half of the nodes that are still
    linked vanish for each chain followed to its end, and dense groups collapse in the first round.
    Each round is written to the shared folder.
    """
    labels = None
    while True:
        ends = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        parent = ends.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("up")).select("fp", F.least("fp", "up").alias("root"))
        parent = materialize(parent, "parents")
        for _ in range(2):
            hop = parent.select(F.col("fp").alias("root"), F.col("root").alias("next"))
            parent = parent.join(hop, "root").select("fp", F.col("next").alias("root"))
        parent = materialize(parent, "parents")
        if labels is None:
            labels = parent
        else:
            step = parent.select(F.col("fp").alias("root"), F.col("root").alias("next"))
            labels = labels.join(step, "root", "left").select("fp", F.coalesce("next", "root").alias("root"))
            labels = materialize(labels, "labels")
        for end in ("a", "b"):
            step = parent.select(F.col("fp").alias(end), F.col("root").alias("to"))
            edges = edges.join(step, end).drop(end).withColumnRenamed("to", end)
        low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        edges = materialize(edges.where("a <> b").select(low, high).distinct(), "contracted")
        if edges.isEmpty():
            return labels


def shingle_set(text: str | None, shingle: int = TEXT_SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles of a text, in order; of the whole sequence if it is shorter."""
    parts, carried = [], []
    for block in word_blocks((text or "").encode().lower()):
        words = carried + block
        carried = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
        if len(words) >= shingle:
            parts.append(shingle_hashes(words, shingle))
    if not parts and carried:
        parts.append(np.array([xxhash.xxh64_intdigest(b" ".join(carried), 42)], np.uint64))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(len(a) + len(b) - shared, 1)


def sketches(docs: DataFrame, shingle: int = TEXT_SHINGLE) -> DataFrame:
    """doc_id, n (distinct shingles), set_hash and ``low``, the smallest hashes, of every document with words."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([xxhash.xxh64_intdigest(x.tobytes()) >> 1 for x in sets], pa.int64()),
                pa.array([x[:SKETCH].view(np.int64) for x in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "set_hash", "low"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(compute, "doc_id long, n long, set_hash long, low array<long>").where("n > 0")


def _pairs(keyed: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y) of sets that share a key, of groups of up to ``most``; and the sets of larger groups."""
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_key")).where("n_key > 1")
    sized_rows = materialize(spread_join(keyed, counts.withColumn("n_sets", F.col("n_key")), "key", "n_sets"), "near-keys")
    small = sized_rows.where(F.col("n_key") <= most).select("key", F.struct("doc_id", "fp", "n", "low").alias("x"))
    other = small.withColumnRenamed("x", "y")
    pairs = small.join(other, "key").where(F.col("x.doc_id") < F.col("y.doc_id")).select("x", "y")
    return pairs, sized_rows.where(F.col("n_key") > most)


def _to_first(keyed: DataFrame) -> DataFrame:
    """Pairs of the first set of each key with all its other sets."""
    row = F.struct("doc_id", "fp", "n", "low")
    first = keyed.groupBy("key").agg(F.min_by(row, "doc_id").alias("x"), F.count(F.lit(1)).alias("n_key"))
    met = spread_join(keyed.select("key", "doc_id", row.alias("y")), first, "key", "n_key")
    return met.where(F.col("x.doc_id") < F.col("y.doc_id")).select("x", "y")


def _prefixes(large: DataFrame) -> DataFrame:
    """Sets of large groups under those of their keys that may still bring them a partner, written.

    The hashes that two likely sets share are at least half of either sketch.  If no small group has brought them together,
    all of these are keys of large groups.  So a set with fewer such keys has no partner left; of the others, in order
    of rarity, all but the last ``half - 1`` hold one that the partner holds among its own.
    """
    entry = F.struct("n_key", "key")
    columns = ["doc_id", "fp", "n", "low"]
    sets = large.groupBy(*columns).agg(F.sort_array(F.collect_list(entry)).alias("keys"))
    half = F.ceil(F.size("low") / 2).cast("int")
    kept = F.slice("keys", F.lit(1), F.greatest(F.size("keys") - half + 1, F.lit(0)))
    return materialize(sets.select(*columns, F.explode(F.transform(kept, lambda k: k["key"])).alias("key")), "near-rest")


def shingle_rows(docs: DataFrame, shingle: int = TEXT_SHINGLE) -> DataFrame:
    """doc_id and ``key``: every distinct shingle hash of every text as a row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                keys = shingle_set(text.as_py(), shingle).view(np.int64)
                for at in range(0, len(keys), BATCH):
                    part = pa.array(keys[at : at + BATCH])
                    yield pa.RecordBatch.from_arrays([pa.repeat(doc_id, len(part)), part], ["doc_id", "key"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(compute, "doc_id long, key long")


def _placed(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key, n_held and ``left`` for the shingles that several of these documents hold, written.

    ``n_held`` documents hold the shingle; ``left`` counts the document's shingles from this one on in order of rarity.  Shingles that
    no other document holds come first in that order and are not needed.
    """
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(sized(materialize(ids, "near-ids")), "doc_id", "left_semi")
    held = materialize(shingle_rows(texts, shingle), "near-shingles")
    counts = materialize(held.groupBy("key").agg(F.count(F.lit(1)).alias("n_held")).where("n_held > 1"), "near-held")
    rows = spread_join(held, counts.withColumn("n_rows", F.col("n_held")), "key", "n_rows")
    order = Window.partitionBy("doc_id").orderBy(F.desc("n_held"), F.desc("key"))
    return materialize(rows.withColumn("left", F.dense_rank().over(order)), "near-placed")


def _enough(shared: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles that share at most so many may have the similarity."""
    return (1 + similarity) * shared >= similarity * (n + m) - SLACK


def _between_classes(docs: DataFrame, rest: DataFrame, labels: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (x, y) of sets of large groups that are not in one class yet, but for those that cannot have the similarity.

    Two alike sets whose rarest common shingle is held by up to ``GROUP`` sets meet by that shingle, which both hold early enough to
    share as many as they must.  All others share only shingles of more holders, so the smaller number of these bounds what
    they share (``_by_group``).  Neither rule loses a pair of the similarity.
    """
    members = rest.select("doc_id", "fp", "n", "low").distinct().join(labels.withColumnRenamed("root", "label"), "fp", "left")
    members = materialize(members.withColumn("label", F.coalesce("label", "fp")), "near-members")
    placed = _placed(docs, members.select("doc_id").distinct(), shingle)
    row = F.struct("doc_id", "fp", "n", "low")
    rare = placed.where(F.col("n_held") <= GROUP).join(members, "doc_id").where(F.col("left") >= similarity * F.col("n") - SLACK)
    rare = materialize(rare.select("key", "left", "label", row.alias("x")), "near-rare")
    other = rare.select("key", F.col("left").alias("other_left"), F.col("label").alias("other"), F.col("x").alias("y"))
    by_rare = rare.join(other, "key").where(
        (F.col("label") != F.col("other")) & (F.col("x.doc_id") < F.col("y.doc_id"))
        & _enough(F.least("left", "other_left"), F.col("x.n"), F.col("y.n"), similarity)
    )
    common = placed.where(F.col("n_held") > GROUP).groupBy("doc_id").agg(F.max("left").alias("common"))
    able = members.join(common, "doc_id").where(F.col("common") >= similarity * F.col("n") - SLACK).select("doc_id", "fp", "label", "common")
    return by_rare.select("x", "y").unionByName(_by_group(rest.join(able, ["doc_id", "fp"]), similarity))


def _by_group(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (x, y) of sets of different classes that share a key and have enough ``common`` shingles for the similarity.

    Every group has one class that holds most of it; only the sets beside it meet the group, and of the group only the sizes
    that their common shingles can reach.  The pairs of a group and size are dealt over cells of about ``CELL`` times ``CELL``.
    """
    members = materialize(members, "near-able")
    sizes = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n_label"))
    groups = sizes.groupBy("key").agg(
        F.max_by("label", F.struct("n_label", "label")).alias("main"), F.sum("n_label").alias("n_key"), F.max("n_label").alias("n_main")
    ).where("n_main < n_key").drop("n_main")
    members = materialize(spread_join(members, groups, "key", "n_key"), "near-open")

    def step(size: Column) -> Column:
        return F.floor(SIZES * F.log(F.greatest(size, F.lit(1)))).cast("int")

    n = F.col("n")
    least, most = similarity * n - SLACK, F.least(n / similarity, (1 + similarity) / similarity * F.col("common") - n) + SLACK
    row = F.struct("doc_id", "fp", "n", "low", "common")
    one = members.where("label <> main").where(least <= most).withColumn("size", F.explode(F.sequence(step(least), step(most))))
    one = one.select(F.xxhash64("key", "size").alias("place"), "doc_id", "label", row.alias("x"))
    two = members.select(
        F.xxhash64("key", step(n).alias("size")).alias("place"), "doc_id", F.col("label").alias("other"),
        (F.col("label") == F.col("main")).alias("is_main"), row.alias("y"),
    )
    grid = one.groupBy("place").agg(F.count(F.lit(1)).alias("n_one")).join(two.groupBy("place").agg(F.count(F.lit(1)).alias("n_two")), "place")
    grid = materialize(grid.withColumn("cells", F.ceil(F.sqrt(F.col("n_one") * F.col("n_two")) / CELL).cast("int")), "near-grid")
    own = F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    one = spread_join(one, grid.select("place", "cells", "n_one"), "place", "n_one").select("place", "label", "x", own.alias("i"), every.alias("j"))
    two = spread_join(two, grid.select("place", "cells", "n_two"), "place", "n_two").select("place", "other", "is_main", "y", own.alias("j"), every.alias("i"))
    # of two sets beside the main class, one meets the other
    met = one.hint("merge").join(two, ["place", "i", "j"]).where(
        (F.col("label") != F.col("other")) & (F.col("is_main") | (F.col("x.doc_id") < F.col("y.doc_id")))
        & _enough(F.least("x.common", "y.common"), F.col("x.n"), F.col("y.n"), similarity)
    )
    return met.select(F.col("x").dropFields("common").alias("x"), F.col("y").dropFields("common").alias("y"))


def similar_links(docs: DataFrame, marked: DataFrame, bits: DataFrame, distance: int, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of fingerprints more than ``distance`` bits apart whose texts have the similarity.

    Sets that share a key of a large group are linked until the classes, with the links of ``bits``, are those of all pairs.
    """
    sets = sketches(docs, shingle).join(marked.select("doc_id", "fp"), "doc_id")
    first = F.min_by(F.struct("doc_id", "n", "low"), "doc_id").alias("s")
    sets = materialize(sets.groupBy("fp", "set_hash").agg(first).select("fp", "s.*"), "near-sets")
    # upper halves of the hashes do for the estimate, and ride with every key; without sign, so that they sort like the hashes
    halves = F.transform("low", lambda h: F.shiftrightunsigned(h, 33).cast("int")).alias("low")
    keyed = sets.select("doc_id", "fp", "n", halves, F.explode("low").alias("key"))
    pairs, large = _pairs(keyed, GROUP)
    rest = _prefixes(large)
    met = pairs.unionByName(_to_first(rest))
    found = materialize(_verified(docs, _likely(met, distance, similarity), shingle, similarity), "near-links")
    if rest.isEmpty():
        return found
    # what the first sets have joined needs no pairs of its own
    labels = components(bits.unionByName(found))
    met = _likely(_between_classes(docs, rest, labels, shingle, similarity), distance, similarity)
    return found if met.isEmpty() else found.unionByName(_verified(docs, met, shingle, similarity)).distinct()


def _likely(candidates: DataFrame, distance: int, similarity: float) -> DataFrame:
    """Pairs that bits have not linked and that sizes and sketches do not rule out, written, each once."""
    x, y = F.col("x"), F.col("y")
    low = F.slice(F.sort_array(F.array_union(x["low"], y["low"])), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(low, x["low"]), y["low"]))
    alike = candidates.where(
        (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) > distance)
        & (F.least(x["n"], y["n"]) >= similarity * F.greatest(x["n"], y["n"]))
        & (2 * shared >= F.size(low))  # of hashes shared with probability 0.8, half are missing once in some 700
    )
    return materialize(alike.select(
        x["doc_id"].alias("x_id"), y["doc_id"].alias("y_id"), x["fp"].alias("x_fp"), y["fp"].alias("y_fp")
    ).distinct(), "near-candidates")


def _verified(docs: DataFrame, alike: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b), a < b, of the pairs whose whole texts have the similarity."""
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    for side in ("x", "y"):
        ids = alike.select(F.col(f"{side}_id").alias("doc_id")).distinct()
        found = texts.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias(f"{side}_id"), F.col("text").alias(f"{side}_text"))
        alike = alike.join(found, f"{side}_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                jaccard(shingle_set(a.as_py(), shingle), shingle_set(b.as_py(), shingle)) >= similarity
                for a, b in zip(batch.column("x_text"), batch.column("y_text"), strict=True)
            ]
            yield batch.select(["x_fp", "y_fp"]).filter(pa.array(good, pa.bool_()))

    linked = alike.select("x_fp", "y_fp", "x_text", "y_text").mapInArrow(verify, "x_fp long, y_fp long")
    return linked.select(F.least("x_fp", "y_fp").alias("a"), F.greatest("x_fp", "y_fp").alias("b")).distinct()


def near_classes(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id and n_links, the number of other fingerprints that it links to.

    With a ``similarity``, texts that share so much of their shingles link as well.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    pairs = materialize(links(distinct.select("fp"), distance), "near-pairs")
    if similarity is not None:
        pairs = materialize(pairs.unionByName(similar_links(docs, marked, pairs, distance, shingle, similarity)), "near-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(pairs).join(ends, "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rooted = materialize(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n_fp"), F.min("first_id").alias("component_id"))
    smallest = materialize(smallest, "components")
    # classes of one fingerprint, by far the most, need no join
    alone = rooted.where(F.col("n_links") == 0).select("fp", "n", "n_links", F.col("first_id").alias("component_id"))
    linked = rooted.where(F.col("n_links") > 0).withColumn("doc_id", F.col("fp"))
    linked = spread_join(linked, smallest.where("n_fp > 1"), "root", "n_fp").select("fp", "n", "n_links", "component_id")
    classes = materialize(alone.unionByName(linked), "classes")
    return spread_join(marked, classes, "fp", "n").select("doc_id", "fp", "component_id", "n_links")


def near_dedup(docs: DataFrame, distance: int = DISTANCE, shingle: int = TEXT_SHINGLE, similarity: float | None = SIMILARITY) -> DataFrame:
    """The document with the smallest id of every class, with all columns of ``docs``."""
    found = near_classes(docs, distance, shingle, similarity)
    return without_ids(docs, found.select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")))
