"""Document fingerprints from invertible Bloom lookup sketches of paragraphs, in DataFrame functions only.

A paragraph is a line, or ``WORDS`` words of a longer one; its key is a hash.  A
sketch has three rows of cells; a key is added to one cell of each row, which
holds the number of keys, their xor and the xor of their check values.  Sketches of
two texts are subtracted cell by cell: equal paragraphs vanish, and peeling cells
that hold one key recovers those that differ.  A table that can't be peeled is
tried again with more cells.

Keys are dealt to buckets of about ``EACH`` a side so that tables stay small and the
work is linear in the text.  Cells are sums and xors that Spark compiles; only tables
that don't list their keys at once are peeled cell by cell.  The published fingerprint is the smallest table over all
keys.  Likeness is shared paragraphs over all paragraphs, 1 for two empty texts.

Null texts are empty.  Documents are ordered by doc_id, equal ids by a hash of the
text; the document after the last is the first.  Rows without a doc_id drop out.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import id_and_text, kept, kept_by

WORDS, EACH = 16, 2
#: Cells of a row, in the order in which they are tried; only cells that hold something are stored.
CELLS = (1024, 1 << 16)
BASE_CELLS, ROUNDS, CHECK = 4, 10, 77
PARAGRAPH = rf"(?:[^\s]++[^\S\n]*+){{1,{WORDS}}}"
#: Rows of a slot, and slots at most; a slot is sorted in one task.
SLOT_ROWS, SLOTS = 2000, 40_000


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def keys(text: Column) -> Column:
    """Distinct paragraph hashes of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(F.rtrim(p))))


def cell_of(key: Column, row: int, cells: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 20 * row).bitwiseAND(F.lit((1 << 20) - 1)), F.lit(cells)).cast("int")


def check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(CHECK))


def item(key: Column, side: Column, check_value: Column, cells: int) -> Column:
    """A key with its side (1 or -1), check value and places."""
    return F.struct(key.alias("k"), side.cast("int").alias("s"), check_value.alias("x"), *[cell_of(key, j, cells).alias(f"p{j}") for j in range(3)])


def added(cell: Column, it: Column, sign: int) -> Column:
    return F.struct((cell["c"] + it["s"] * F.lit(sign)).alias("c"), cell["k"].bitwiseXOR(it["k"]).alias("k"), cell["x"].bitwiseXOR(it["x"]).alias("x"))


def empty_cell() -> Column:
    return F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("x"))


def table_of(items: Column, cells: int) -> Column:
    """The sketch of items, row after row; items of both sides make the difference of two sketches."""

    def row(j: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.aggregate(F.filter(items, lambda it: it[f"p{j}"] == i), empty_cell(), lambda cell, it: added(cell, it, 1)))

    return F.concat(*[row(j) for j in range(3)])


def peeled(table: Column, cells: int) -> Column:
    """(table left over, keys recovered) after peeling."""

    def step(state: Column, _: Column) -> Column:
        alone = F.filter(state["t"], lambda c: (F.abs(c["c"]) == 1) & (c["x"] == check(c["k"])))

        def removed(found: Column) -> Column:
            def without(cell: Column, place: Column) -> Column:
                here = F.filter(found, lambda it: (it["p0"] == place) | (it["p1"] + cells == place) | (it["p2"] + 2 * cells == place))
                return F.aggregate(here, cell, lambda c, it: added(c, it, -1))

            return F.when(F.size(found) == 0, state).otherwise(F.struct(F.transform(state["t"], without).alias("t"), (state["n"] + F.size(found)).alias("n")))

        return once(F.array_distinct(F.transform(alone, lambda c: item(c["k"], c["c"], c["x"], cells))), removed)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(table.alias("t"), F.lit(0).alias("n")), step)


def fingerprint(key_array: Column) -> Column:
    """The smallest table over all keys as text: counts and xors of its cells."""
    items = F.transform(key_array, lambda k: item(k, F.lit(1), check(k), BASE_CELLS))
    table = once(items, lambda held: table_of(held, BASE_CELLS))
    return F.array_join(F.transform(table, lambda c: F.concat(F.hex(c["c"].cast("long")), F.lit(":"), F.hex(c["k"]))), ".")


def slot_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, found in two steps."""
    width = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    whole = F.array(*[F.lit(p[0]).cast("long") for p in parts])
    part = F.size(F.filter(whole, lambda b: b <= key))
    inside = F.array(*[F.array(*[F.lit(b).cast("long") for b in p]) for p in parts])
    return F.when(part == 0, F.lit(0)).otherwise((part - 1) * F.lit(width) + F.size(F.filter(F.element_at(inside, F.greatest(part, F.lit(1))), lambda b: b <= key)))


def with_next(docs: DataFrame) -> DataFrame:
    """(slot, row, doc_id, text, next): each text beside the one after it.

    Slots are ranges of ids with about as many rows each; texts move once.
    """
    n = docs.count()
    slots = min(SLOTS, n // SLOT_ROWS)
    bounds: list[int] = []
    if slots > 1:
        got = docs.agg(F.percentile_approx("doc_id", [k / slots for k in range(1, slots)], max(10_000, 20 * slots)).alias("b")).first()["b"]
        bounds = sorted(set(got))
    bounds = bounds or [0]
    placed = docs.withColumn("slot", slot_of(F.col("doc_id"), bounds).cast("int")).withColumn("tie", F.xxhash64("text"))
    w = Window.partitionBy("slot").orderBy("doc_id", "tie")
    ordered = placed.select("slot", "doc_id", "text", F.row_number().over(w).alias("row"), F.lead("text").over(w).alias("inside"))
    heads = placed.groupBy("slot").agg(F.min(F.struct("doc_id", "tie", "text")).alias("head")).select("slot", F.col("head.text").alias("head"))
    # the slots that hold rows, at most SLOTS numbers: each is followed by the next, the last by the first
    held = sorted(r["slot"] for r in placed.select("slot").distinct().collect())
    if not held:
        return ordered.select("slot", "row", "doc_id", "text", F.col("inside").alias("next"))
    after = docs.sparkSession.createDataFrame(list(zip(held, held[1:] + held[:1], strict=True)), "slot int, follows int")
    heads = after.join(heads.withColumnRenamed("slot", "follows"), "follows").select("slot", "head")
    both = ordered.join(heads, (ordered["slot"] == heads["slot"]) & ordered["inside"].isNull(), "left")
    return both.select(ordered["slot"], "row", "doc_id", "text", F.coalesce("inside", "head").alias("next"))


def edited(text: Column, following: Column) -> Column:
    """A text whose last quarter gives way to the beginning of the next."""
    quarter = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - quarter), F.substring(following, F.lit(1), quarter))


def table_cells(rows: DataFrame, pairs: dict[str, tuple[str, str]], cells: int) -> DataFrame:
    """(slot, row, at, cell, c, k, x): the cells that are left when the tables of each pair's two sides are subtracted.

    ``at`` is the pair and the bucket.  Keys are added to their cells by compiled sums,
    so equal paragraphs vanish here, and cells that hold nothing take no place.  All
    grouping is inside a slot, so nothing moves that stands there already.
    """
    held = []
    for number, (a, b) in enumerate(pairs.values()):
        buckets = F.greatest(F.lit(1), ((F.size(a) + F.size(b)) / (2 * EACH)).cast("int"))
        held += [F.struct(F.lit(number).alias("pair"), F.lit(side).alias("s"), buckets.alias("buckets"), F.col(c).alias("keys")) for c, side in ((a, 1), (b, -1))]
    flat = rows.select("slot", "row", F.explode(F.array(*held)).alias("d")).select("slot", "row", "d.pair", "d.s", "d.buckets", F.explode("d.keys").alias("k"))
    at = F.pmod(F.xxhash64("k"), F.col("buckets")).cast("long") * len(pairs) + F.col("pair")
    flat = flat.select("slot", "row", at.alias("at"), "s", "k", check(F.col("k")).alias("x"))
    places = F.array(*[cell_of(F.col("k"), j, cells) + j * cells for j in range(3)])
    added = flat.select("*", F.explode(places).alias("cell")).groupBy("slot", "row", "at", "cell")
    return added.agg(F.sum("s").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("x").alias("x")).where("c <> 0 or k <> 0 or x <> 0")


def listed(held: Column, cells: int) -> Column:
    """Keys recovered by peeling the table with these cells; -1 if something is left."""
    cell_at = lambda i: F.coalesce(F.get(F.filter(held, lambda h: h["cell"] == i), F.lit(0)).dropFields("cell"), empty_cell())
    table = F.transform(F.sequence(F.lit(0), F.lit(3 * cells - 1)), cell_at)
    left = once(table, lambda t: peeled(t, cells))
    return once(left, lambda p: F.when(F.exists(p["t"], lambda c: (c["c"] != 0) | (c["k"] != 0) | (c["x"] != 0)), F.lit(-1)).otherwise(p["n"]))


def differing(rows: DataFrame, pairs: dict[str, tuple[str, str]], cells: int) -> DataFrame:
    """(slot, row, failed, d_<pair>): how many keys differ in each pair, by listing and peeling tables of ``cells`` a row.

    A row of cells that all hold one key lists the difference as it stands; a table
    without such a row is peeled.  ``failed`` says that one could not be peeled.
    """
    left = table_cells(rows, pairs, cells).withColumn("cell_row", F.floor(F.col("cell") / cells))
    mixed = ~((F.abs("c") == 1) & (F.col("x") == check(F.col("k"))))
    counts = [F.count(F.when(F.col("cell_row") == j, 1)).alias(f"n{j}") for j in range(3)]
    counts += [F.count(F.when((F.col("cell_row") == j) & mixed, 1)).alias(f"m{j}") for j in range(3)]
    cell = F.struct("cell", F.col("c").cast("int").alias("c"), "k", "x")
    tables = left.groupBy("slot", "row", "at").agg(*counts, F.collect_list(cell).alias("held"))
    n = listed(F.col("held"), cells)
    for j in reversed(range(3)):
        n = F.when(F.col(f"m{j}") == 0, F.col(f"n{j}").cast("int")).otherwise(n)
    found = tables.select("slot", "row", (F.col("at") % len(pairs)).alias("pair"), n.alias("n"))
    sums = [F.sum(F.when(F.col("pair") == k, F.col("n"))).alias(f"d_{name}") for k, name in enumerate(pairs)]
    return found.groupBy("slot", "row").agg(F.max(F.col("n") < 0).alias("failed"), *sums)


def exact_differing(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``differing`` without tables, for what the largest can't hold (keys that agree in all their cells)."""
    apart = lambda a, b: F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return rows.select("slot", "row", F.lit(False).alias("failed"), *[apart(a, b).cast("long").alias(f"d_{name}") for name, (a, b) in pairs.items()])


def differences(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Written table (slot, row, d_<pair>): each size of table is tried on the rows that the one before failed for."""
    names = [f"d_{name}" for name in pairs]
    whole = None
    for cells in (*CELLS, None):
        found = exact_differing(rows, pairs) if cells is None else differing(rows, pairs, cells)
        found = kept(found, "differences")
        done = found.where("not failed").select("slot", "row", *names)
        whole = done if whole is None else whole.unionByName(done)
        open_ = found.where("failed").select("slot", "row")
        if cells is None or not open_.head(1):
            return whole
        rows = rows.join(open_, ["slot", "row"], "left_semi")


def compared(rows: DataFrame, pairs: dict[str, tuple[str, str]], carry: list[str]) -> DataFrame:
    """``rows`` (slot, row, key arrays, carry) with the likeness of each named pair of key arrays.

    The rows are written by slot, so that the tables are made where their keys lie and
    a larger table that is tried for a few rows reads their keys and no text.
    """
    rows = kept_by(rows, "slot", "paragraph-keys")
    columns = list(dict.fromkeys(x for pair in pairs.values() for x in pair))
    found = differences(rows.select("slot", "row", *columns), pairs)
    heads = rows.select("slot", "row", *carry, *[F.size(c).alias(f"n_{c}") for c in columns])
    whole = heads.join(found, ["slot", "row"], "left")
    likeness = []
    for name, (a, b) in pairs.items():
        both, apart = F.col(f"n_{a}") + F.col(f"n_{b}"), F.coalesce(f"d_{name}", F.lit(0))
        likeness.append(F.when(both == 0, F.lit(1.0)).otherwise((both - apart) / (both + apart)).alias(name))
    return whole.select(*carry, *likeness)


def version_fingerprints(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: fingerprints of its text and of its edited text, and likenesses to that and to the next text."""
    texts = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_next(texts)
    rows = rows.select("slot", "row", "doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", "next", edited(F.col("text"), F.col("next")).alias("edited"))
    rows = rows.select("slot", "row", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), keys(F.col("text")).alias("a"), keys(F.col("edited")).alias("e"), keys(F.col("next")).alias("b"))
    rows = rows.select("*", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"))
    return compared(rows, {"near_edited": ("a", "e"), "near_next": ("a", "b")}, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"])
