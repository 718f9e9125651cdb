"""Mixing sources to target weights by pivotal dependent rounding, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Rows that one fold of the rounding goes over, about.
BLOCK = 128
#: Units over each of these shares of their source's target meet each other first, and then all smaller ones together.
LARGE = (0.1, 0.01, 0.001)
COLUMNS = ["id", "source", "size", "m", "source_size", "target", "whole", "p", "w", "n_units"]


def words(text: Column) -> Column:
    """Number of words, runs of anything but white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: each source's share of all sizes by weight, at most `most` times its size.

    What is above a limit is shared again by weight until none is above: a target is then least(most * size, level *
    weight). Each step keeps the sources found full and solves for the level of the others; the driver sees two sums a
    step. There are at most as many steps as sources, and seldom more than a handful.
    """
    sized = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    sized = _ranked(sized)
    of_rank = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sized = sized.withColumn("weight", of_rank)
    full = most * F.col("source_size") <= F.lit(-1.0)
    level, total = -1.0, None
    while True:
        row = sized.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        total = row["all"] or 0
        if not row["weight"]:
            break
        risen = (total - row["taken"]) / row["weight"]
        if risen <= level:
            break
        level = risen
        full = most * F.col("source_size") <= F.lit(level) * F.col("weight")
    target = F.least((most * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight"))
    return sized.select("source", "source_size", target.alias("target"))


def _ranked(sized: DataFrame) -> DataFrame:
    """sized with rank, from 0, of its rows in order of source, nulls last: sorted by ranges, each with the rows before it.
    The driver sees a count a range."""
    ordered = sized.orderBy(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ordered = ordered.withColumn("rank", F.monotonically_increasing_id() - F.shiftleft(F.col("range").cast("long"), 33))
    ordered, before, total = stored(ordered, "mix-sources"), [], 0
    for row in ordered.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():
        before += [F.lit(row["range"]), F.lit(total)]
        total += row["n"]
    return ordered.withColumn("rank", F.col("rank") + F.element_at(F.create_map(*before), F.col("range"))).drop("range") if before else ordered.drop("range")


def _fold(block: Column) -> Column:
    """Pivotal rounding of the units of a block: pair after pair, mass goes from one to the other at random, in a way that
    keeps both expectations and the sum of words, until one of the two is integral; the other meets the next unit.

    A unit is (p, words, id...); the fold's result has all units, each with p 0 or 1 but the last left over.
    """
    def settle(state: Column, x: Column) -> Column:
        a = state["open"]
        # move words from a to x, or back, up to where one of the two has none or all of its own
        up = F.least(a["p"] * a["w"], (1 - x["p"]) * x["w"])
        down = F.least((1 - a["p"]) * a["w"], x["p"] * x["w"])
        forth = x["u"] * (up + down) < down  # the chance of each is what the other moves
        moved = F.when(forth, up).otherwise(-down)
        pa = _clean((a["p"] * a["w"] - moved) / a["w"])
        px = _clean((x["p"] * x["w"] + moved) / x["w"])
        a2, x2 = a.withField("p", pa), x.withField("p", px)
        a_done = (pa == 0) | (pa == 1)
        return F.struct(
            F.concat(state["done"], F.array(F.when(a_done, a2).otherwise(x2))).alias("done"),
            F.when(a_done, x2).otherwise(a2).alias("open"),
        )

    rest = F.slice(block, 2, F.greatest(F.size(block) - 1, F.lit(1)))
    start = F.struct(F.slice(block, 1, 0).alias("done"), block[0].alias("open"))
    state = F.aggregate(F.when(F.size(block) > 1, rest).otherwise(F.slice(block, 1, 0)), start, settle)
    return F.concat(state["done"], F.array(state["open"]))


def _clean(p: Column) -> Column:
    """p, or the whole number that it misses by rounding errors only."""
    return F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)


def mix_units(units: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """For units (id, source, size, m equal rows): source_size, target and n, the copies that its m rows get in all.

    A unit's rows expect target / source_size copies each, and get them on average. The whole part is certain; the
    fractional part is rounded within its source, so that the words taken stay what they were expected to be, but for one
    last unit a source. Units of like size meet: blocks of about BLOCK units are folded, their left-overs form blocks of
    the next level, and so on: a reduction tree whose nodes are all small, however large a source is.

    Units go by size, in the classes of LARGE. The last unit of a class is settled against all smaller units at once: these
    give or take the words that it got more or less than expected, each in proportion to its room both up and down. That
    is linear in those words, so it changes nobody's expectation; and the last unit of all is a small one.
    """
    per_source = targets(units, weights, most)
    n_units = units.groupBy("source").agg(F.count("*").alias("n_units"))
    known = per_source.join(n_units, per_source["source"].eqNullSafe(n_units["source"])).select(per_source["*"], "n_units")
    known = known.withColumnRenamed("source", "of")
    unit = units.join(known, units["source"].eqNullSafe(known["of"])).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = _clean_copies(F.col("m") * rate)
    unit = unit.withColumn("copies", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(copies))
    unit = unit.withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
    unit = unit.withColumn("w", F.col("size").cast("double")).drop("copies")
    unit = stored(unit.select(COLUMNS), "mix-units")
    out, rest = unit.where("p = 0"), unit.where("p > 0")
    for k, share in enumerate(LARGE):
        large = F.col("w") * F.col("m") > F.col("target") * share
        if rest.where(large).isEmpty():
            continue
        first = _settled(rest.where(large), seed + 100 * k)
        out, rest = out.unionByName(first), _given_way(rest.where(large), first, rest.where(~large))
        out, rest = out.unionByName(rest.where("p = 0 or p = 1")), rest.where("p > 0 and p < 1")
    out = out.unionByName(_settled(rest, seed + 1000))
    return out.select("id", "source", "size", "m", "source_size", "target", (F.col("whole") + F.col("p")).cast("long").alias("n"))


def _given_way(before: DataFrame, first: DataFrame, rest: DataFrame) -> DataFrame:
    """rest with its parts moved by the words that `first` took more or less than `before`, the same units, had expected."""
    most = F.max(F.greatest(F.col("p"), 1 - F.col("p")) * F.col("w")).alias("most")
    words = lambda df: df.groupBy("source").agg(F.sum(F.col("p") * F.col("w")).alias("words"), most)
    was, now = words(before).select(F.col("source").alias("of"), F.col("words").alias("was"), "most"), words(first).select(F.col("source").alias("by"), F.col("words").alias("now"))
    spare = F.least(F.col("p"), 1 - F.col("p"))
    room = rest.groupBy(F.col("source").alias("in")).agg(F.sum(spare * F.col("w")).alias("room"))
    # one large unit a source at most is settled by its own draw, so no more than `most` is owed
    owed = was.join(now, F.col("of").eqNullSafe(F.col("by"))).join(room, F.col("of").eqNullSafe(F.col("in")))
    owed = owed.select("of", ((F.col("was") - F.col("now")) / F.greatest("room", "most")).alias("t"))
    moved = F.col("p") + spare * F.coalesce("t", F.lit(0.0))
    joined = rest.join(owed, F.col("source").eqNullSafe(F.col("of")), "left")
    return stored(joined.withColumn("p", _clean(moved)).select(COLUMNS), "mix-rest")


def _settled(left: DataFrame, seed: int) -> DataFrame:
    """left with each p 0 or 1: levels of blocks are folded until a source has one unit open, which its own draw settles."""
    decided, level = [], 0
    largest = left.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while largest > 1:
        # like sizes share a block: the size's half octave, then an even split of the source's units
        wide = F.greatest(F.ceil(F.col("n_units") / F.lit(float(BLOCK) ** (level + 1))), F.lit(1))
        key = [F.when(wide > 8, F.floor(F.log2("size") * 2)).otherwise(F.lit(0)).alias("octave"), F.pmod(F.xxhash64("id", "size", F.lit(seed)), wide.cast("long")).alias("block")]
        u = F.pmod(F.xxhash64("id", "size", F.lit(seed + level)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        item = F.struct("w", "id", "p", u.alias("u"), *[c for c in COLUMNS if c not in ("w", "id", "p", "source")])
        items = left.select("source", *key, item.alias("item"))
        if largest > BLOCK * BLOCK:  # few bytes, much work: more tasks than their size asks for
            items = items.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "octave", "block")
        blocks = items.groupBy("source", "octave", "block").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        folded = blocks.select("source", F.explode(_fold(F.col("items"))).alias("x")).select("source", "x.*").select(COLUMNS)
        folded = stored(folded, "mix-level")
        decided.append(folded.where("p = 0 or p = 1"))
        left, level = folded.where("p > 0 and p < 1"), level + 1
        largest = left.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    u = F.pmod(F.xxhash64("id", "size", F.lit(seed - 1)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    out = left.withColumn("p", F.when(u < F.col("p"), 1.0).otherwise(0.0)).select(COLUMNS)
    for more in decided:
        out = out.unionByName(more)
    return out


def _clean_copies(x: Column) -> Column:
    """x, or the whole number that it misses by rounding errors only."""
    return F.when(F.abs(x - F.round(x)) < 1e-9, F.round(x)).otherwise(x)


def _units(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    return stored(rows.groupBy("id", "source", "size").agg(F.count("*").alias("m")), "mix-rows")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """What a mix of all documents takes: id, size, source_size, target, taken, source, copies; a row per document.

    Sizes are words, a null text has 0 and takes 0. A null source is a source, last in order. Documents that repeat an id,
    source and size share what their rows together get as evenly as whole copies allow. An empty table gives no rows;
    other columns are ignored. The draw depends on ids and sizes only, so reruns agree.
    """
    mixed = mix_units(_units(docs, id_col, source_col, text_col), seed)
    chunk = 1 << 16  # of a unit's rows, so that no array grows with a table of equal rows
    at = mixed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / chunk))))
    start = F.col("chunk") * chunk
    row = at.withColumn("row", F.explode(F.sequence(start, F.least(start + chunk, F.col("m")) - 1)))
    copies = F.floor(F.col("n") / F.col("m")) + (F.col("row") < F.col("n") % F.col("m")).cast("long")
    row = row.withColumn("copies", copies)
    return row.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """docs with each row as often as the mix takes it, with the columns of docs. Documents without words stay out.

    Null ids and sources count as such, and rows that repeat an id, source and size share what they get together, as in
    mix(). An empty table gives no rows.
    """
    mixed = mix_units(_units(docs, id_col, source_col, text_col), seed).where("n > 0")
    mixed = mixed.select(F.col("id").alias("of_id"), F.col("source").alias("of_source"), F.col("size").alias("of_size"), "m", "n")
    # a row in one column, so that no name of docs clashes with another
    at = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"), docs[source_col].alias("source"), words(docs[text_col]).alias("size"))
    joined = at.join(mixed, at["id"].eqNullSafe(mixed["of_id"]) & at["source"].eqNullSafe(mixed["of_source"]) & (at["size"] == mixed["of_size"]))
    again = lambda df: df.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")
    single = again(joined.where("m = 1"))
    if mixed.where("m > 1").isEmpty():
        return single
    # rows that repeat an id, source and size: number them, and give the first ones the odd copies. They are numbered by
    # partition, and the partitions' counts summed, so that no task has all rows of one
    key = ["id", "source", "size"]
    tied = stored(joined.where("m > 1").select("row", *key, "m", "n", F.spark_partition_id().alias("part")), "mix-repeated")
    counts = tied.groupBy(*key, "part").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy(*key).orderBy("part")) - F.col("here")
    counts = counts.select(*[F.col(c).alias(f"of_{c}") for c in (*key, "part")], before.alias("before"))
    within = tied.withColumn("number", F.row_number().over(Window.partitionBy(*key, "part").orderBy("m")) - 1)
    same = [within[c].eqNullSafe(counts[f"of_{c}"]) for c in (*key, "part")]
    numbered = within.join(counts, same).withColumn("number", F.col("number") + F.col("before"))
    n = F.floor(F.col("n") / F.col("m")) + (F.col("number") < F.col("n") % F.col("m")).cast("long")
    return single.unionByName(again(numbered.withColumn("n", n).where("n > 0")))
