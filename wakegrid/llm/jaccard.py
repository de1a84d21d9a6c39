"""Jaccard join of documents on word shingles, with set relations used to skip work.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of
distinct ``width``-word shingles.

1. **Lone shingles.**  Half of all shingles (by their hash) are counted exactly, but
   for equal 44-bit keys: chunks of sets send their keys to slots, and a slot answers
   how many keys of each set no other set has.  A linked set lacks at most
   ``|A| - ceil(percent * |A| / 100)`` of its shingles in its partner, so a set with
   more lone ones links to none, and is not written.  Nothing that is held or sent to
   tasks in this step has a size that data can outgrow.
2. **Classes.**  Equal sets are one class, named by its smallest doc_id; one set of each
   class is written.  The sketch that tells tasks whose sets are wanted takes ids, not
   shingles; beyond some 100 million of them more texts are hashed again, and no more
   sets written.
3. **Index.**  A class is listed under the first shingles of its set, common ones
   last; two linked classes meet in a list.  List entries carry size and place, by
   which entries that can't reach the threshold are skipped.
4. **Pivots.**  Each class is compared with the first head of its lists, those with
   most copies first, and in later rounds with the next outside its component.
   Linked classes are one component from then on; pairs inside need no look.
5. **Derived answers.**  What remains are classes outside the component of a
   list's head.  Each is also held against the pivot that most others there follow.  A class's answers follow from its pivot's: two sets that share
   nothing outside the pivot have at most the smaller of their overlaps with it in
   common.  The first shingles outside the pivot are listed too, so pairs that can
   share enough of them meet in such a list, and all others are skipped by that
   bound; these lists are looked at for sets with one pivot only.

Fewer than ``width`` words: the whole sequence is the one shingle.  Null texts
and texts without words have an empty set and link with nothing.  Rows that repeat
a document are in its class.  Rows without a doc_id drop out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .sketch import MESSAGES, Sketch, merged, message_batches, squeeze, unsqueeze
from .tables import forget, id_and_text, kept, shuffles_removed
from .text import Hasher, lower_ascii, slices, window_hashes, word_bounds

SKETCH_BITS = 28
#: A key is a slot and 32 bits more.
SLOT_BITS = 12
#: Keys of a chunk, about; its rows are numbered in 16 bits.
CHUNK_KEYS, CHUNK_ROWS = 1_500_000, 1 << 16
#: Keys that a task looks at together, about; a slot is not divided.
GROUP_KEYS = 1_000_000
#: Most common shingles whose order is sent to the tasks; the order decides how long lists are, not what is found.
COMMON = 200_000
#: Rounds in which each class is compared with one head of its lists.
STAR_ROUNDS = 3

#: To a slot: keys that one row of the chunk has, their rows, and keys that several have.  Slots below zero: ids, sizes and names of all rows.
SENT = "slot int, chunk long, keys binary, rows binary, again binary"
#: From a slot: a row's number for each lone key; or ids, sizes and names passed on.
ANSWERS = "chunk long, lone binary, ids binary, sizes binary, names binary"
COUNTS = "doc_id long, n_shingles long, name binary, lone long"


def shingle_sets(batch: pa.RecordBatch, hasher: Hasher, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each row of a batch."""
    for _, n, data, offsets in slices(batch):
        data = lower_ascii(data)
        start, end, firsts = word_bounds(data, offsets)
        hasher.load(data)
        words = hasher.ranges(start, end)
        runs = window_hashes(words, width)
        for i in range(n):
            a, b = firsts[i], firsts[i + 1]
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            else:
                yield window_hashes(words[a:b], int(b - a), 0x2545F4914F6CDD1D) if b > a else np.zeros(0, np.uint64)


def name_of(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    up = np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(29)))
    return int(s.sum(dtype=np.uint64)).to_bytes(8, "big") + int(up).to_bytes(8, "big")


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of the values between neighbouring cuts, as one binary each."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values that the binaries of a column hold, end to end, and how many each holds."""
    unit = np.dtype(kind).itemsize
    parts, counts = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for x in column.cast(pa.binary()).chunks:
        if len(x):
            _, places, data = x.buffers()
            offsets = np.frombuffer(places, np.int32, len(x) + 1, x.offset * 4)
            counts.append(np.diff(offsets).astype(np.int64) // unit)
            if offsets[-1] > offsets[0]:
                parts.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind))
    return np.concatenate(parts), np.concatenate(counts)


def same_as_neighbours(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each sorted value equals the one before, and the one behind."""
    same = np.zeros(len(ordered) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    return same[:-1], same[1:]


def chunk_batch(ids: list[int], sizes: list[int], names: list[bytes], halves: list[np.ndarray], part: int) -> pa.RecordBatch:
    """What a chunk of sets sends.

    All rows that describe the sets of a partition go one way (slot ``-1 - part``) and
    chunks have random names, so if a task is run again no set is told twice or lost;
    answers to what no longer counts only make lone shingles fewer.
    """
    chunk = int.from_bytes(os.urandom(8), "big") >> 1
    keys = np.concatenate(halves) >> np.uint64(32 - SLOT_BITS)
    rows = np.repeat(np.arange(len(halves)), [len(x) for x in halves]).astype(np.uint16)
    order = np.argsort(keys)
    keys, rows = keys[order], rows[order]
    before, behind = same_as_neighbours(keys)
    alone, again = ~(before | behind), behind & ~before
    edges = np.arange((1 << SLOT_BITS) + 1, dtype=np.uint64) << np.uint64(32)
    once, more = keys[alone], keys[again]
    cuts, more_cuts = np.searchsorted(once, edges), np.searchsorted(more, edges)
    low = [binaries(x.astype(np.uint32), c) for x, c in ((once, cuts), (more, more_cuts))]
    full = np.flatnonzero(np.diff(cuts) + np.diff(more_cuts))
    columns = [low[0], binaries(rows[alone], cuts), low[1]]
    whole = [np.array(ids, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), b"".join(names)]
    columns = [pa.concat_arrays([x.take(pa.array(full)), pa.array([y], pa.binary())]) for x, y in zip(columns, whole, strict=True)]
    slots = np.append(full, -1 - part).astype(np.int32)
    return pa.record_batch([pa.array(slots), pa.array(np.full(len(slots), chunk)), *columns], names=["slot", "chunk", "keys", "rows", "again"])


def send_keys(width: int):
    """Keys of every other shingle, by slot, and what is known of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, part, n = Hasher(), TaskContext.get().partitionId(), 0
        held: tuple[list, ...] = ([], [], [], [])
        for batch in batches:
            for own, s in zip(batch.column(0).to_pylist(), shingle_sets(batch, hasher, width), strict=True):
                half = s[s & np.uint64(1) == 0]
                for column, value in zip(held, (own, len(s), name_of(s), half), strict=True):
                    column.append(value)
                n += len(half)
                if n >= CHUNK_KEYS or len(held[0]) == CHUNK_ROWS:
                    yield chunk_batch(*held, part)
                    held, n = ([], [], [], []), 0
        if held[0]:
            yield chunk_batch(*held, part)

    return run


def answers(table: pa.Table) -> pa.RecordBatch:
    """For each chunk the rows of its lone keys; ``table`` has all messages of its slots."""
    low, n = flat(table.column("keys"), np.uint32)
    rows, _ = flat(table.column("rows"), np.uint16)
    again, m = flat(table.column("again"), np.uint32)
    base = table.column("slot").to_numpy().astype(np.uint64) << np.uint64(32)
    chunks, code = np.unique(table.column("chunk").to_numpy(), return_inverse=True)
    keys = np.concatenate([np.repeat(base, n) | low, np.repeat(base, m) | again])
    order = np.argsort(keys)
    before, behind = same_as_neighbours(keys[order])
    at = order[~(before | behind)]
    at = at[at < len(low)]
    told = np.sort(np.repeat(code, n)[at] << 16 | rows[at])
    cuts = np.searchsorted(told >> 16, np.arange(len(chunks) + 1))
    lone = [squeeze(told[a:b] & 0xFFFF) for a, b in zip(cuts, cuts[1:], strict=False)]
    none = pa.nulls(len(chunks), pa.binary())
    return pa.record_batch([pa.array(chunks, pa.int64()), pa.array(lone, pa.binary()), none, none, none], names=["chunk", "lone", "ids", "sizes", "names"])


def answer_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to messages that are sorted by slot."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        slots = batch.column(0).to_numpy()
        known = int(np.searchsorted(slots, 0))
        if known:
            x = batch.slice(0, known)
            yield pa.record_batch([x.column(1), pa.nulls(known, pa.binary()), x.column(2), x.column(3), x.column(4)], names=["chunk", "lone", "ids", "sizes", "names"])
        if known < len(slots):
            ended = max(known, int(np.searchsorted(slots, slots[-1])))
            new_slot = not held or ended > known or held[-1].column(0)[-1].as_py() != int(slots[-1])
            if n >= GROUP_KEYS and new_slot:
                # the last slot may go on in the next batch
                yield answers(pa.Table.from_batches([*held, batch.slice(known, ended - known)]))
                held, n, known = [], 0, ended
            held.append(batch.slice(known))
            n += sum(held[-1].column(k).nbytes for k in (2, 4)) // 4
    if held:
        yield answers(pa.Table.from_batches(held))


def gather(part: pd.DataFrame) -> pd.DataFrame:
    """The sets of a chunk with their lone keys."""
    told = part[part["ids"].notna()]
    if not len(told):
        return pd.DataFrame({"doc_id": [], "n_shingles": [], "name": [], "lone": []}).astype({"doc_id": int, "n_shingles": int, "name": object, "lone": int})
    ids, sizes = (np.frombuffer(told[c].iloc[0], np.int64) for c in ("ids", "sizes"))
    names = told["names"].iloc[0]
    lone = np.zeros(len(ids), np.int64)
    for x in part["lone"].dropna():
        lone += np.bincount(unsqueeze(x), minlength=len(ids))
    return pd.DataFrame({"doc_id": ids, "n_shingles": sizes, "name": [names[k : k + 16] for k in range(0, len(names), 16)], "lone": lone})


def least_shared(size, percent: int):
    """Fewest shingles that a linked partner of a set of ``size`` has in common with it."""
    return -(-percent * size // 100)


def send_sets(held: Broadcast, width: int, bits: int):
    """Sets of the rows whose id is in the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch = Hasher(), Sketch(held, bits)
        for batch in batches:
            batch = batch.filter(pa.array(sketch.repeated(batch.column(0).to_numpy().view(np.uint64))))
            sets = list(shingle_sets(batch, hasher, width))
            yield pa.record_batch([batch.column(0), pa.array([name_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "name", "shingles"])

    return run


def send_ids(bits: int):
    """Ids of the first column, so that a sketch reports all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from message_batches((np.repeat(b.column(0).to_numpy().view(np.uint64), 2) for b in batches), bits)

    return run


def unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def count_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several sets of a batch hold, and how many hold them."""
    for batch in batches:
        sets = unpacked(batch.column(0))
        if sets:
            token, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.record_batch([pa.array(token[n > 3].view(np.int64)), pa.array(n[n > 3].astype(np.int64))], names=["token", "n"])


def list_first(held: Broadcast, percent: int):
    """Entries (token, id, size, copies, place) of each set's first shingles; the commonest come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = held.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            sets = unpacked(batch.column(batch.schema.get_field_index("shingles")))
            for own, copies, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets, strict=True):
                s = ranked(s, known, rank)
                p = len(s) - least_shared(len(s), percent) + 1
                for column, values in zip(out, (s[:p].view(np.int64), np.full(p, own), np.full(p, len(s)), np.full(p, copies), np.arange(p)), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["token", "id", "size", "copies", "place"])

    return run


def ranked(s: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Shingles in the one order of all lists: the commonest last, then by value."""
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        s = s[np.lexsort((s, np.where(known[at] == s, rank[at], 0)))]
    return s


def list_rest(held: Broadcast, percent: int):
    """Entries (id, token) of the first shingles that a set holds beside its pivot.

    A partner with the same pivot that shares no more inside it than this set does has
    at least ``least_shared(size) - shared`` shingles in common with it beside it, so
    two such sets meet among the first of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = held.value
        for batch in batches:
            ids, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for own, shared, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rest = np.asarray(rest.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                p = len(rest) - max(1, least_shared(shared + len(rest), percent) - shared) + 1
                tokens.append(ranked(rest, known, rank)[: max(0, p)])
                ids.append(np.full(len(tokens[-1]), own, np.int64))
            yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(tokens).view(np.int64))], names=["id", "token"])

    return run


def compare(percent: int, with_rest: bool):
    """Overlap of the two sets of each row; ``rest``: the first set's shingles that the second lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            shared, linked, rest = [], [], []
            for x, y in zip(unpacked(batch.column(at("x"))), unpacked(batch.column(at("y"))), strict=True):
                same = np.isin(x, y, assume_unique=True)
                n = int(same.sum())
                shared.append(n)
                linked.append(100 * n >= percent * (len(x) + len(y) - n))
                if with_rest:
                    rest.append(x[~same].view(np.int64))
            columns = [batch.column(at("a")), batch.column(at("b")), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())]
            names = ["a", "b", "shared", "linked"]
            if with_rest:
                columns.append(pa.array(rest, pa.list_(pa.int64())))
                names.append("rest")
            yield pa.record_batch(columns, names=names)

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int, with_rest: bool = False) -> DataFrame:
    """Pairs (a, b) with their exact overlap.  ``b`` is looked up first: its sets are few when it is a pivot."""
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare(percent, with_rest), "a long, b long, shared long, linked boolean" + ", rest array<long>" * with_rest)


def reachable(a: str, b: str, percent: int):
    """Overlap that two sets of these sizes need to link."""
    return F.ceil((F.col(a) + F.col(b)) * percent / (100 + percent) - 1e-9)


def sizes_fit(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def shingle_counts(texts: DataFrame, width: int) -> DataFrame:
    """Written table (doc_id, n_shingles, name, lone) of all rows: of every other shingle, how many no other row has."""
    sent = texts.mapInArrow(send_keys(width), SENT).repartition("slot").sortWithinPartitions("slot")
    return kept(sent.mapInArrow(answer_slots, ANSWERS).groupBy("chunk").applyInPandas(gather, COUNTS), "shingle-counts")


def class_sets(texts: DataFrame, classes: DataFrame, width: int, bits: int) -> DataFrame:
    """Written table (id, copies, shingles): the set of each class, from the row that names it."""
    held = merged(classes.select("id").mapInArrow(send_ids(bits), MESSAGES), bits)
    first = texts.mapInArrow(send_sets(held, width, bits), "id long, name binary, shingles binary").dropDuplicates(["id", "name"])
    return kept(classes.join(first, ["id", "name"]).select("id", "copies", "shingles"), "sets")


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that are not read any more."""
    for df in tables:
        for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
            forget(df.sparkSession, path)


def class_links(sets: DataFrame, percent: int) -> DataFrame:
    """Written links (a, b) among classes ``sets`` (id, copies, shingles): those by which all linked classes are connected."""
    spark = sets.sparkSession
    common = sets.select("shingles").mapInArrow(count_common, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = common.orderBy(F.desc("n"), "token").limit(COMMON).collect()
    known = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(known)
    held = spark.sparkContext.broadcast((known[order], np.array([r["n"] for r in rows], np.int64)[order]))
    entries = kept(sets.select("id", "copies", "shingles").mapInArrow(list_first(held, percent), "token long, id long, size long, copies long, place long"), "entries")

    # heads come in one order everywhere: most copies, then by a hash of the id
    rank = [F.col("copies"), F.xxhash64("id").alias("h"), F.col("id").alias("head"), F.col("size").alias("head_size")]
    heads = entries.groupBy("token").agg(F.max(F.struct(*rank)).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("token", "lead")

    def nearest(listed: DataFrame, against: DataFrame) -> DataFrame:
        """For each class the best head of its lists, as pairs (a, b); once each."""
        met = listed.join(against, "token").where("id <> lead.head").where(sizes_fit("size", "lead.head_size", percent))
        return met.groupBy("id").agg(F.max("lead").alias("lead")).select(F.col("id").alias("a"), F.col("lead.head").alias("b"))

    first = kept(verified(nearest(entries, heads), sets, percent, with_rest=True), "pivots")
    links, compared = first.where("linked").select("a", "b"), first.select("a", "b")
    named = components(links)
    for _ in range(STAR_ROUNDS - 1):
        # classes outside their head's component try the next head
        placed = entries.select("token", "id", "size").join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
        tops = heads.join(named.select(F.col("id").alias("h_id"), F.col("component").alias("head_component")), F.col("lead.head") == F.col("h_id"), "left")
        tops = tops.select("token", "lead", F.coalesce("head_component", "lead.head").alias("head_component"))
        met = placed.join(tops, "token").where("component <> head_component").where(sizes_fit("size", "lead.head_size", percent))
        met = met.select("id", "lead", F.col("lead.head").alias("b")).join(compared.select(F.col("a").alias("id"), "b"), ["id", "b"], "left_anti")
        met = met.groupBy("id").agg(F.max("lead").alias("lead")).select(F.col("id").alias("a"), F.col("lead.head").alias("b"))
        more = kept(verified(met, sets, percent), "stars")
        links, compared = links.union(more.where("linked").select("a", "b")), compared.union(more.select("a", "b"))
        named = components(links)

    # what a class has in common with its pivot, and what it holds beside it
    # (where that is less than half of it, the pivot tells little and is not used)
    close = first.where(F.col("shared") >= F.size("rest")).select("a", "b", "shared", "rest")
    # classes outside the group around a pivot that they meet are held against that pivot too
    popular = close.groupBy("b").agg(F.count(F.lit(1)).alias("followers"))
    marks = close.select("a", "b").join(popular, "b").select(F.col("a").alias("id"), F.struct("followers", F.col("b").alias("pivot")).alias("best"))
    spots = entries.select("token", "id").join(marks, "id", "left")
    tops = spots.groupBy("token").agg(F.max("best").alias("top")).where("top is not null")
    wanted = spots.join(tops, "token").groupBy("id").agg(F.max("top").alias("top"), F.max("best").alias("best"))
    wanted = wanted.where("top.pivot <> id and (best is null or best.pivot <> top.pivot)").select(F.col("id").alias("a"), F.col("top.pivot").alias("b"))
    again = kept(verified(wanted, sets, percent, with_rest=True), "pivots")
    links, compared = links.union(again.where("linked").select("a", "b")), compared.union(again.select("a", "b"))
    named = components(links)
    adopted = again.where(F.col("shared") >= F.size("rest")).select("a", "b", "shared", "rest")
    close = kept(adopted.union(close.join(adopted.select("a"), "a", "left_anti")), "close")
    links, compared = kept(links, "links"), kept(compared, "compared")
    dropped(first, again)
    pivots = close.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "shared")
    about = entries.select("id", "size").distinct().join(named, "id", "left").join(pivots, "id", "left")
    about = about.select("id", "size", F.coalesce("component", "id").alias("component"), F.coalesce("pivot", "id").alias("pivot"), F.coalesce("shared", "size").alias("shared"))
    about = kept(about, "about")
    outside = close.select("a", "shared", "rest").mapInArrow(list_rest(held, percent), "id long, token long").withColumn("outside", F.lit(True))
    listed = entries.select("token", "id", "place").join(outside, ["token", "id"], "full")
    listed = listed.join(about, "id").select("token", "id", "size", "component", "pivot", "shared", F.col("place"), F.coalesce("outside", F.lit(False)).alias("outside"))
    listed = kept(listed, "lists")
    dropped(entries, close, about)

    lead = F.max(F.struct(F.col("shared"), F.col("component"))).alias("lead")
    head = listed.groupBy("token").agg(lead, F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token", F.col("lead.component").alias("head"))
    columns = ["id", "size", "component", "pivot", "shared", "place", "outside"]
    others = listed.join(head, "token").where("component <> head").select("token", *[F.col(c).alias(f"{c}_a") for c in columns])
    met = others.join(listed.select("token", *[F.col(c).alias(f"{c}_b") for c in columns]), "token")
    need = reachable("size_a", "size_b", percent)
    # places count only between entries among the first shingles
    ahead = F.coalesce(F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) + F.least("place_a", "place_b"), need)
    # with one pivot: no more inside it than the smaller overlap, no more beside it than the smaller rest
    beside = F.when(F.col("outside_a") & F.col("outside_b"), F.least(F.col("size_a") - F.col("shared_a"), F.col("size_b") - F.col("shared_b"))).otherwise(0)
    bound = F.when(F.col("pivot_a") == F.col("pivot_b"), F.least("shared_a", "shared_b") + beside).otherwise(need)
    # sets with different pivots meet among the first shingles of both, or not at all
    either = (F.col("pivot_a") == F.col("pivot_b")) | (F.col("place_a").isNotNull() & F.col("place_b").isNotNull())
    met = met.where((F.col("component_a") != F.col("component_b")) & either & sizes_fit("size_a", "size_b", percent) & (bound >= need) & (ahead >= need))
    pairs = met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
    # what was compared with a head is known
    known_pairs = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = kept(pairs.join(known_pairs.distinct(), ["a", "b"], "left_anti"), "pairs")
    second = verified(pairs, sets, percent).where("linked").select("a", "b")
    found = kept(links.union(second), "links")
    dropped(listed, pairs, compared)
    return found


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, bits: int = SKETCH_BITS) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id reachable by links."""
    texts = id_and_text(docs)
    with shuffles_removed(docs.sparkSession):
        found = shingle_counts(texts, width)
        linkable = found.where("n_shingles > 0").where(F.col("lone") * 100 <= F.col("n_shingles") * (100 - percent))
        classes = kept(linkable.groupBy("name").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
        sets = class_sets(texts, classes, width, bits)
        links = class_links(sets, percent)
        dropped(sets)
        named = components(links)
    by_name = classes.join(named, "id", "left").select("name", F.coalesce("component", "id").alias("component"))
    return found.select("doc_id", "n_shingles", "name").join(by_name, "name", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
