"""Near-duplicate documents by the Jaccard similarity of their sets of shingles.

Candidates come from two sides. SimHash fingerprints of the shingles go through the vantage-point tree of ``simhash``,
and each member of a class of fingerprints is compared with one of that class; this finds most copies but few pairs near
a similarity of 0.8, which differ in some ten bits, where no tree prunes. So the least hashes of the sets are compared
too: ``BANDS`` keys of ``ROWS`` least hashes each, of which two sets of similarity s share at least one with a chance of
1 - (1 - s**ROWS)**BANDS, 0.9999 at 0.8. A key is shared by sets that are alike as a whole, not by those that have one
passage in common. Who meets is compared by sketches first, whose distance is never more than that of the sets, and then by
whole sets, so that no pair below the similarity is linked. A key that many share is dealt out as pairs of blocks, and
what comes back is links that unite its classes, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokens
from gridloom.llm.graphs import components
from gridloom.llm.simhash import Classes, linked_classes, shingle_hashes
from gridloom.llm.storage import stage

ROWS, BANDS = 5, 24
TURNS = np.random.default_rng(5).integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
BUCKET_KEYS = 1 << 20


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted. A text of fewer words is one shingle; no words: none."""
    found = list(shingle_hashes(text.lower(), words))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def band_keys(sets: list[np.ndarray], rows: int = ROWS) -> np.ndarray:
    """The keys of sets, one row for each: hashes of so many of its least hashes; an empty set has zeros."""
    out = np.zeros((len(sets), len(TURNS) // rows), np.uint64)
    full = np.flatnonzero([len(x) for x in sets])
    if not len(full):
        return out
    whole, sizes = np.concatenate([sets[k] for k in full]), np.array([len(sets[k]) for k in full])
    starts = np.cumsum(sizes) - sizes
    key = np.zeros(len(full), np.uint64)
    for k, turn in enumerate(TURNS):
        key = tokens.mix(key + np.minimum.reduceat((whole * turn) >> np.uint64(32), starts) + np.uint64(k // rows + 1))
        if k % rows == rows - 1:
            out[full, k // rows], key = key, np.zeros(len(full), np.uint64)
    return out


def fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set, as a signed long."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 4096):
        counts += np.unpackbits(shingles[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view(np.int64)[0])


def sketch(shingles: np.ndarray) -> bytes:
    """For each residue modulo a power of two, whether the number of shingles with it is odd: two sketches differ in no more bits than the sets have shingles that are in one of them only."""
    bits = max(256, 1 << max(0, len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def alike_members(grp: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> np.ndarray:
    """``may_meet`` of sketches of different lengths: a group's are folded to its shortest."""
    width = np.array([len(x) for x in sketches], np.int64)
    starts = np.flatnonzero(np.append(True, grp[1:] != grp[:-1]))
    least = np.repeat(np.minimum.reduceat(width, starts), np.diff(np.append(starts, len(grp))))
    out = np.zeros(len(grp), bool)
    for w in np.unique(least):
        rows = np.flatnonzero(least == w)
        folded = np.stack([np.bitwise_xor.reduce(sketches[k].reshape(-1, w), axis=0) for k in rows])
        out[rows] = may_meet(grp[rows], sizes[rows], folded, percent)
    return out


def may_meet(grp: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, percent: int) -> np.ndarray:
    """Of members of groups, sorted by group, those whose sketch allows that they are similar to another of their group."""
    near = lambda a, b: np.bitwise_count(sketches[a] ^ sketches[b]).sum(-1, dtype=np.int64) * (100 + percent) <= (100 - percent) * (sizes[a] + sizes[b])
    out = np.zeros(len(grp), bool)
    starts = np.flatnonzero(np.append(True, grp[1:] != grp[:-1]))
    count = np.diff(np.append(starts, len(grp)))
    two = starts[count == 2]
    out[two] = out[two + 1] = near(two, two + 1)
    for a, m in zip(starts[count > 2], count[count > 2], strict=True):
        for k in range(a, a + m - 1):
            rest = np.arange(k + 1, a + m)
            ok = near(np.full(len(rest), k), rest)
            out[rest[ok]] = True
            out[k] |= ok.any()
    return out


def _deal(keys: np.ndarray, others: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Keys and what belongs to them, packed in a row for each bucket."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    packed = [pa.array([x[order[cuts[b] : cuts[b + 1]]].tobytes() for b in full], pa.binary()) for x in (keys, *others)]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *packed], names=["bucket", *(f"c{k}" for k in range(len(packed)))])


def may_be_similar(size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)


def similar_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i < j) of sets whose Jaccard similarity is ``percent`` or more."""
    size = np.array([len(x) for x in sets], np.int64)
    if len(sets) == 2:
        both = np.full((2, 2), len(np.intersect1d(*sets, assume_unique=True)))
    else:
        found, number = np.unique(np.concatenate(sets), return_inverse=True)
        member = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(number, kind="stable")
        number, member = number[order], member[order]
        both = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2**24 are exact
        for at in range(0, len(found), 4096):
            a, e = np.searchsorted(number, [at, at + 4096])
            held = np.zeros((len(sets), 4096), np.float32)
            held[member[a:e], number[a:e] - at] = 1
            both += held @ held.T
    i, j = np.triu_indices(len(sets), 1)
    common = both[i, j].astype(np.int64)
    near = common * (100 + percent) >= percent * (size[i] + size[j])
    return i[near], j[near]


def meetings(keys: np.ndarray, names: np.ndarray, sizes: np.ndarray, percent: int, small: int = 16, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Of sets under keys, who is to be compared: (group, set). Few sets under a key meet as pairs; many as pairs of blocks."""
    order = np.lexsort((names, sizes, keys))
    keys, names, sizes = keys[order], names[order], sizes[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])) if len(keys) else np.zeros(0, bool)
    keys, names, sizes = keys[new], names[new], sizes[new]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(keys)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in range(2, small + 1):
        first = starts[count == m]
        for x in range(m - 1 if len(first) else 0):
            for y in range(x + 1, m):
                a, b = first + x, first + y
                ok = may_be_similar(sizes[a], sizes[b], percent)
                left.append(names[a[ok]])
                right.append(names[b[ok]])
    left, right = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)]), axis=1)
    grp = tokens.mix(tokens.mix(pairs[0].view(np.uint64)) + pairs[1].view(np.uint64)).view(np.int64)
    groups, members = [grp, grp], [pairs[0], pairs[1]]
    for a, m in zip(starts[count > small], count[count > small], strict=True):
        spans = [slice(k, min(k + block, a + m)) for k in range(a, a + m, block)]
        prints = [xxhash.xxh64_intdigest(names[s].tobytes()) for s in spans]
        for x in range(len(spans)):
            for y in range(x, len(spans)):
                if 100 * sizes[spans[x].stop - 1] < percent * sizes[spans[y].start]:
                    break  # sizes rise
                name = np.array([xxhash.xxh64_intdigest(f"{prints[x]} {prints[y]}")], np.uint64).view(np.int64)[0]
                for s in [spans[x], spans[y]] if y > x else [spans[x]]:
                    groups.append(np.full(s.stop - s.start, name))
                    members.append(names[s])
    return np.concatenate(groups), np.concatenate(members)


def similar_sets(reps: DataFrame, docs: DataFrame, words: int, percent: int, small: int = 16, block: int = 256, radius: int = 2) -> DataFrame:
    """Of distinct sets (set_id, n, fp, keys, sketch, doc_id, text_key: a row of ``docs`` that has it), those with a smaller one in their class: node, root."""
    spark = reps.sparkSession
    total = reps.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 8 // 4096), total // 8 // BUCKET_KEYS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("keys")]
            length = np.array([len(x) for x in held], np.int64)
            if not length.sum():
                continue
            rows = np.repeat(np.arange(len(held)), length)
            yield _deal(np.concatenate(held), [batch.column("set_id").to_numpy()[rows], batch.column("n").to_numpy()[rows].astype(np.int32)], buckets)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        whole = [np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("c0", np.uint64), ("c1", np.int64), ("c2", np.int32))]
        grp, name = meetings(whole[0], whole[1], whole[2].astype(np.int64), percent, small, block)
        return pa.table({"grp": pa.array(grp), "set_id": pa.array(name)})

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(held: pa.Table) -> pa.RecordBatch:
            grp, sizes = held["grp"].to_numpy(), held["n"].to_numpy().astype(np.int64)
            left = alike_members(grp, sizes, [np.frombuffer(x, np.uint64) for x in held["sketch"].to_pylist()], percent)
            return pa.RecordBatch.from_arrays([pa.array(grp[left]), pa.array(held["set_id"].to_numpy()[left])], names=["grp", "set_id"])

        held = None
        for batch in batches:
            held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
            keys = held["grp"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last group may go on
            if cut:
                yield near(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield near(held)

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for at in range(0, len(batch), 256):
                sets = [shingle_set(x.as_py() or b"", words).tobytes() for x in texts[at : at + 256]]
                yield pa.RecordBatch.from_arrays([batch.column("set_id")[at : at + 256], pa.array(sets, pa.binary())], names=["set_id", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(names: list[int], sets: list[bytes]) -> tuple[list[int], list[int]]:
            i, j = similar_pairs([np.frombuffer(x, np.uint64) for x in sets], percent)
            classes = Classes(len(names))
            classes.link(i, j)
            moved = np.flatnonzero(classes.root != np.arange(len(names)))
            return [names[k] for k in moved], [names[k] for k in classes.root[moved]]

        now, names, sets = None, [], []
        for batch in batches:
            a, b = [], []
            for grp, name, held in zip(*(batch.column(c).to_pylist() for c in ("grp", "set_id", "shingles")), strict=True):
                if grp != now and names:
                    for out, found in zip((a, b), links(names, sets), strict=True):
                        out += found
                    names, sets = [], []
                now = grp
                names.append(name)
                sets.append(held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(names, sets)], names=["a", "b"])

    dealt = reps.select("set_id", "n", "keys").mapInArrow(deal, "bucket long, c0 binary, c1 binary, c2 binary")
    near = linked_classes(reps.select("fp").distinct(), radius).withColumnRenamed("node", "fp")
    placed = reps.select("set_id", "fp").join(near, "fp", "left").select("set_id", F.coalesce("root", "fp").alias("class"))
    hubs = placed.groupBy("class").agg(F.min("set_id").alias("hub"), F.count("*").alias("members")).where("members > 1")
    spokes = placed.join(hubs, "class").where("set_id <> hub").select(F.xxhash64("hub", "set_id").alias("grp"), F.explode(F.array("hub", "set_id")).alias("set_id"))
    met = dealt.groupBy("bucket").applyInArrow(meet, "grp long, set_id long").union(spokes).distinct().join(reps.select("set_id", "n", "sketch"), "set_id")
    met = met.select("grp", "set_id", "n", "sketch").repartition("grp").sortWithinPartitions("grp", "set_id")
    met = stage(met.mapInArrow(sieve, "grp long, set_id long"), "met")
    wanted = stage(reps.join(met.select("set_id").distinct(), "set_id", "left_semi").select("set_id", "doc_id", "text_key"), "wanted")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("k.text_key"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").alias("d").join(wanted.alias("k").hint("merge"), same).select("set_id", "text")
    sets = found.mapInArrow(whole_sets, "set_id long, shingles binary").dropDuplicates(["set_id"])
    grouped = met.join(sets, "set_id").repartition("grp").sortWithinPartitions("grp", "set_id").select("grp", "set_id", "shingles")
    return components(grouped.mapInArrow(compare, "a long, b long"), "similar")


def _representatives(marked: DataFrame, path: str) -> DataFrame:
    """A row for each distinct set, with the least document that has it. Sets are one if both of their 64-bit hashes agree.

    Where sets of one set_id differ in their second hash, all but those of the least are named anew, and grouped again.
    """
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("b")
    grouped = marked.groupBy("set_id").agg(least, *(F.first(c).alias(c) for c in ("n", "fp", "keys", "sketch")), F.min("set_check").alias("low"), F.max("set_check").alias("high"))
    return stage(grouped.select("set_id", "n", "fp", "keys", "sketch", "b.doc_id", "b.text_key", "low", "high"), path)


def _told_apart(marked: DataFrame, reps: DataFrame) -> DataFrame:
    clash = reps.where("low <> high").select("set_id", "low")
    return marked.join(clash, "set_id", "left").withColumn("set_id", F.when(F.col("low") != F.col("set_check"), F.xxhash64("set_id", "set_check")).otherwise(F.col("set_id"))).drop("low")


def drop_similar(docs: DataFrame, words: int = 5, percent: int = 80, small: int = 16, block: int = 256, id_bits: int = 64) -> DataFrame:
    """The rows of ``docs`` with one of each class: that of the smallest doc_id, or of rows of one doc_id any one.

    Rows link if the Jaccard similarity of their sets of ``words``-word shingles is ``percent`` in a hundred or more;
    classes are what links reach. ASCII letters count as small. A text of fewer words than a shingle is one shingle;
    texts without words, and null ones, are alike. All columns are kept. Rows whose doc_id is null stay only where their
    class has no other. An empty table gives an empty table. Two sets are taken for one where 128 bits of hashes agree;
    ``id_bits`` says how many of them name a set, fewer only to see names clash.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in tokens.slices(whole)):
            sets = [shingle_set(x.as_py() or b"", words) for x in batch.column("text").cast(pa.binary())]
            keys = band_keys(sets)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_key"),
                pa.array((np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64) >> np.uint64(64 - id_bits)).view(np.int64)),
                pa.array(np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)), pa.array([len(x) for x in sets], pa.int32()), pa.array([fingerprint(x) for x in sets], pa.int64()),
                pa.array([k.tobytes() if len(x) else b"" for x, k in zip(sets, keys, strict=True)], pa.binary()), pa.array([sketch(x) for x in sets], pa.binary()),
            ], names=["doc_id", "text_key", "set_id", "set_check", "n", "fp", "keys", "sketch"])

    marked = stage(chosen.mapInArrow(mark, "doc_id long, text_key long, set_id long, set_check long, n int, fp long, keys binary, sketch binary"), "shingles")
    reps = _representatives(marked, "sets")
    if reps.where("low <> high").limit(1).count():
        reps = _representatives(_told_apart(marked, reps), "sets")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("b")
    reps = reps.drop("low", "high")
    linked = similar_sets(reps, docs, words, percent, small, block).withColumnRenamed("node", "set_id")
    placed = reps.join(linked, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    best = stage(placed.groupBy("root").agg(least).select("b.doc_id", "b.text_key"), "kept")
    kept = docs.alias("d").join(best.alias("k").hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("k.text_key")), "left_semi")
    repeated = marked.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
