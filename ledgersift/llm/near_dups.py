"""MinHash near-duplicate groups by fast similarity sketching, banding and exact verification.

* Sketch: in round i every shingle of a set is thrown into one of ``COORDINATES`` bins with a hashed value; a bin
  keeps its least value of the first round that reached it. Rounds go on until all bins are full; after
  ``COORDINATES`` such rounds, round ``COORDINATES + j`` throws all shingles into bin j, so every bin fills. Two sets
  agree in a bin with the probability of their similarity, and the number of agreeing bins is concentrated at
  least as well as with independent min-hashes.
* Banding: ``BANDS`` keys of ``ROWS`` bins each. At a similarity of 0.8 a pair shares no key with probability
  (1 - 0.8^5)^40 = 1.2e-7.
* Verification: on the full sets, 100 * common >= 80 * united.

Equal sets are one class before anything is compared. Within a bucket, members are first compared with two leaders
only, which finds most of the components. Classes that then stand outside the largest component of one of their
buckets are gathered in blocks, and each block is compared with all members of its buckets, each member's set once
for a whole block. So no bucket is expanded into pairs and none is capped, and every pair of classes that share a
key ends up in one component or has been compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgersift.llm.components import components
from ledgersift.llm.tables import batches_of, binaries, only, stored
from ledgersift.llm.words import U64, grams, mix, slices, words

BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
PERCENT = 80
WORDS = 5  # words of a shingle unless told otherwise
MEMBERS = 4_096  # sets that a verifying group compares with its leaders
LEADERS = 256  # leaders of a verifying group at most, but for chance
_FULL = U64(2**64 - 1)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each row, one after another, and where each row's begin.

    A row of fewer than ``size`` words has its whole sequence as its one shingle; without words, none.
    """
    hashes, first = words(texts)
    count = np.diff(first)
    every = grams(hashes, size)
    sets = []
    for row, n in enumerate(count):
        a = first[row]
        if n >= size:
            sets.append(np.unique(every[a:a + n - size + 1]))
        else:
            sets.append(grams(hashes[a:a + n], int(n)) if n else np.zeros(0, U64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.concatenate(([0], np.cumsum(sizes)))


def sketches(items: np.ndarray, offsets: np.ndarray, bins: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches of many sets at once, one row of ``bins`` values for each; empty sets stay unfilled."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    values = np.full(n * bins, _FULL, dtype=U64)
    filled = np.zeros((n, bins), dtype=bool)
    left = items
    for turn in range(2 * bins):
        if not len(left):
            break
        hashed = mix(left, 1000 + turn)
        if turn < bins:
            place = ((hashed >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
        else:
            place = np.full(len(left), turn - bins, dtype=np.int64)
        value = mix(hashed, 1) >> U64(1)
        cell = owner * bins + place
        free = ~filled.reshape(-1)[cell]
        np.minimum.at(values, cell[free], value[free])
        filled.reshape(-1)[cell[free]] = True
        done = filled.all(axis=1)
        keep = ~done[owner]
        if not keep.all():
            left, owner = left[keep], owner[keep]
    return values.reshape(n, bins)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sketch), BANDS), dtype=U64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(sketch), band, dtype=U64)
            for column in range(band * ROWS, band * ROWS + ROWS):
                key = mix(key + sketch[:, column], 7)
            keys[:, band] = key
    return keys


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _cid(digest: bytes) -> int:
    """A class's short name. Two classes may share one by chance; their sets are then both compared."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _lists(matrix: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Lists of the matrix's rows, empty where ``rows`` is false."""
    offsets = np.concatenate(([0], np.cumsum(np.where(rows, matrix.shape[1], 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix[rows].view(np.int64).reshape(-1)))


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                items, at = shingle_sets(part.column("text"), size)
                counts = np.diff(at)
                digests = [_digest(items[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                keys = band_keys(sketches(items, at))
                yield batches_of(["doc_id", "n_shingles", "digest", "cid", "bands"],
                                 [part.column("doc_id"), counts.astype(np.int64), binaries(digests),
                                  pa.array(list(map(_cid, digests)), pa.int64()), _lists(keys, counts > 0)])
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                items, at = shingle_sets(part.column("text"), size)
                sets = [items[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                yield batches_of(["cid", "shingles"], [pa.array([_cid(_digest(s)) for s in sets], pa.int64()),
                                                       binaries([s.tobytes() for s in sets])])
    return run


class _Leaders:
    """The sets that a group's members are compared with, as one sorted list of shingles with their owners."""

    def __init__(self, group: tuple) -> None:
        self.group, self.labels, self.sets, self.items = group, [], [], None

    def add(self, label: int, shingles: np.ndarray) -> None:
        self.labels.append(label)
        self.sets.append(shingles)

    def similar(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        """Labels of the sets that are similar enough."""
        if self.items is None:
            every = np.concatenate(self.sets)
            order = np.argsort(every, kind="stable")
            self.sizes = np.array([len(s) for s in self.sets])
            self.items, self.owner = every[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]
            self.names, self.sets = np.array(self.labels), []
        low = np.searchsorted(self.items, shingles, "left")
        times = np.searchsorted(self.items, shingles, "right") - low
        if len(self.names) == 1:
            common = np.array([times.sum()])
        else:
            total = int(times.sum())
            at = np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(total)
            common = np.bincount(self.owner[at], minlength=len(self.names))
        return self.names[100 * common >= percent * (self.sizes + len(shingles) - common)]


def _verify(percent: int):
    """Rows come sorted: a group's leaders, then its members. Only the leaders' sets are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Leaders(())
        for batch in batches:
            found = set()
            groups = list(zip(*(batch.column(n).to_pylist() for n in ("lead", "block", "part")), strict=True))
            member, labels = batch.column("is_member").to_pylist(), batch.column("label").to_pylist()
            sets = batch.column("shingles")
            for k, group in enumerate(groups):
                shingles = np.frombuffer(sets[k].as_buffer(), dtype=U64)
                if group != held.group:
                    held = _Leaders(group)
                if not member[k]:
                    held.add(labels[k], shingles)
                elif held.labels:
                    found.update((int(a), labels[k]) for a in set(held.similar(shingles, percent).tolist())
                                 if a != labels[k])
            pairs = sorted(found)
            yield batches_of(["a", "b"], [pa.array([x[0] for x in pairs], pa.int64()),
                                          pa.array([x[1] for x in pairs], pa.int64())])
    return run


def _links(leaders: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the labels of similar leaders and members of a group.

    ``leaders`` and ``members`` hold lead, block (the group), cid and label. A group's members are dealt out over
    parts of about ``MEMBERS``, and its leaders go to each part.
    """
    parts = members.groupBy("lead", "block").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("n_parts"))
    dealt = (members.join(parts, ["lead", "block"])
             .select("lead", "block", F.pmod(F.xxhash64("cid"), "n_parts").cast("int").alias("part"), "cid", "label",
                     F.lit(True).alias("is_member")))
    led = (leaders.join(parts, ["lead", "block"])
           .select("lead", "block", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), "cid",
                   "label", F.lit(False).alias("is_member")))
    rows = (led.unionByName(dealt).join(sets, "cid").drop("cid").repartition("lead", "block", "part")
            .sortWithinPartitions("lead", "block", "part", "is_member"))
    return rows.mapInArrow(_verify(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct ``size``-word
    shingles. ``component_id`` is the least doc_id reachable over links, and ``kept`` marks that document.
    A null or empty text has no shingles and no links. Rows that share a doc_id count as one document, so links of
    any of them join. A row without doc_id is linked with nothing: its component_id is null and it is kept.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = stored(rows.mapInArrow(_signatures(size), "doc_id long, n_shingles long, digest binary, cid long, "
                                                       "bands array<long>"), "signatures")
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(usable.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
        F.first("cid").alias("cid")), "classes")
    named = stored(signed.drop("bands", "cid").join(classes.select("digest", "node"), "digest", "left")
                   .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(),
                                                          F.coalesce("node", "doc_id")).alias("node")), "named")
    # Buckets of one class are of no use; of the others, the least and the greatest class lead.
    exploded = classes.select("cid", "node", "n", F.explode("bands").alias("key"))
    shared = (exploded.groupBy("key").agg(F.min("cid").alias("least"), F.max("cid").alias("greatest"))
              .where("least != greatest"))
    buckets = stored(exploded.join(shared, "key"), "buckets")
    sets = stored(rows.join(buckets.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
                  .mapInArrow(_sets(size), "cid long, shingles binary")
                  .where(F.octet_length("shingles") > 0), "sets")

    # 1. Members of sizes that can be similar against their buckets' leaders, each pair once.
    sized = buckets.select("cid", "node", "n").distinct()
    fits = f"100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)"
    led = (buckets.select("cid", "node", "n", F.explode(F.array("least", "greatest")).alias("lead"))
           .where("lead != cid").distinct()
           .join(sized.select(F.col("cid").alias("lead"), F.col("n").alias("lead_n")), "lead").where(fits))
    members = stored(led.select("lead", F.lit(0).alias("block"), "cid", F.col("node").alias("label")), "members")
    leaders = (members.select("lead", "block").distinct()
               .join(sized.select(F.col("cid").alias("lead"), F.col("node").alias("label")), "lead")
               .select("lead", "block", F.col("lead").alias("cid"), "label"))
    same_id = (named.where("n_shingles > 0").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
               .where("a != b").select("a", "b"))
    links = stored(_links(leaders, members, sets, percent).unionByName(same_id), "links")
    found = stored(components(links), "components")

    # 2. Classes outside the largest component of one of their buckets, in blocks, against all its members.
    placed = (buckets.select("key", "cid", "node").join(found, "node", "left")
              .select("key", "cid", F.coalesce("component", "node").alias("label")))
    main = (placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("key")
            .agg(F.max(F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("n_labels"))
            .where("n_labels > 1").select("key", F.col("main.label").alias("main")))
    apart = stored(placed.join(main, "key"), "apart")
    outside = apart.where("label != main")
    ranked = outside.groupBy("cid", "label").agg(F.min("main").alias("lead"))
    blocks = ranked.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / LEADERS).cast("int").alias("n_blocks"))
    leaders = stored(ranked.join(blocks, "lead").select(
        "lead", F.pmod(F.xxhash64("cid"), "n_blocks").cast("int").alias("block"), "cid", "label"), "leaders")
    keys = (outside.select("key", "cid", "label").join(leaders, ["cid", "label"])
            .select("key", "lead", "block").distinct())
    members = stored(apart.select("key", "cid", "label").join(keys, "key")
                     .select("lead", "block", "cid", "label").distinct(), "members")
    more = stored(_links(leaders, members, sets, percent), "links")
    if not more.isEmpty():  # links of whole components
        moved = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        found = stored(components(moved), "components")
    return (named.join(found, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, under the docs' own columns.

    Of rows with the same doc_id one stays (the greatest text). Rows without doc_id stay.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    kept = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept")).distinct()
    order = W.partitionBy("__kept").orderBy(F.desc(f"`{text_col}`"))
    first = (docs.join(kept, F.col(f"`{id_col}`") == F.col("__kept"))
             .withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__kept", "__place"))
    return first.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
