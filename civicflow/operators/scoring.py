"""Connections between events and their risk."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.session import materialize, release

# What counts as one whole for each indicator, and where the bands begin.
REFERENCES = {"intensity": 20.0, "persistence": 168.0, "connectivity": 20.0, "spatial_spread": 2000.0}
MEDIUM, HIGH, CRITICAL = 0.25, 0.50, 0.75
LARGE_PER_BITMAP = 64  # messages a bitmap from which bitmaps move less than rows

FEW = 100_000  # events that every worker may hold the codes of


def connections(members: DataFrame) -> DataFrame:
    """(source_event_id, target_event_id, shared, jaccard) of events that share messages; (event_id, message_id) rows.

    The pairs come from an equi-join on the message, so only events with a common message meet."""
    rows = members.select("event_id", "message_id").distinct()
    sizes = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = rows.alias("a"), rows.alias("b")
    shared = a.join(b, F.expr("a.message_id = b.message_id AND a.event_id < b.event_id")).groupBy(
        F.col("a.event_id").alias("source_event_id"), F.col("b.event_id").alias("target_event_id")
    ).agg(F.count(F.lit(1)).alias("shared"))
    out = shared.join(sizes.select(F.col("event_id").alias("source_event_id"), F.col("n").alias("na")), "source_event_id")
    out = out.join(sizes.select(F.col("event_id").alias("target_event_id"), F.col("n").alias("nb")), "target_event_id")
    return out.select("source_event_id", "target_event_id", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def temporal_gap_hours(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Hours between two intervals, 0 if they overlap, null if a bound is missing."""
    s = lambda c: F.unix_timestamp(c)
    known = a_start.isNotNull() & a_end.isNotNull() & b_start.isNotNull() & b_end.isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), (s(b_start) - s(a_end)) / 3600.0, (s(a_start) - s(b_end)) / 3600.0))


def duration_hours(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600.0


def _numbered(ids: DataFrame) -> DataFrame:
    """(message_id, bucket, bit): the different ids numbered without gaps, as places in bitmaps."""
    spread = materialize(ids.distinct().withColumn("_k", F.monotonically_increasing_id()), "message-numbers")
    low = F.col("_k").bitwiseAND(F.lit(2**33 - 1))
    before, offsets = 1, []
    for r in spread.groupBy(F.shiftright("_k", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():  # a row a partition
        offsets.append((r.p, before))
        before += r.n
    table = spread.sparkSession.createDataFrame(offsets, "_p bigint, _o bigint")
    number = F.col("_o") + low
    return spread.join(F.broadcast(table), F.shiftright("_k", 33) == F.col("_p")).select("message_id", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"))


def external_connectivity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(event_id, connectivity): distinct messages of an event's neighbours that it has not itself.

    A large neighbour comes as bitmaps of its messages, 4 KB for 32,768 of them, so a wide event that
    touches all others costs no row a message and neighbour; small ones are reached by rows."""
    rows = members.select("event_id", "message_id").distinct()
    both = edges.select(F.col("source_event_id").alias("event_id"), F.col("target_event_id").alias("n")).unionByName(
        edges.select(F.col("target_event_id").alias("event_id"), F.col("source_event_id").alias("n"))
    )
    both = materialize(both, "event-neighbours")
    own = materialize(rows.join(_numbered(rows.select("message_id")), "message_id").select("event_id", "bucket", "bit"), "event-bits")
    sizes = own.groupBy("event_id").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("bucket").alias("buckets"))
    sizes = materialize(sizes.withColumn("large", F.col("size") >= LARGE_PER_BITMAP * F.col("buckets")), "event-sizes")
    large = sizes.where("large").select(F.col("event_id").alias("n"))
    wide = both.join(large, "n", "left_semi").select("event_id").distinct()

    plain = both.join(wide, "event_id", "left_anti").join(own.withColumnRenamed("event_id", "n"), "n").select("event_id", "bucket", "bit").distinct()
    by_rows = plain.join(own, ["event_id", "bucket", "bit"], "left_anti").groupBy("event_id").agg(F.count(F.lit(1)).alias("connectivity"))

    # Of an event with a large neighbour: the size of the union of its neighbours and itself, less its own.
    reach = both.join(wide, "event_id", "left_semi").unionByName(wide.select("event_id", F.col("event_id").alias("n")))
    held = own.withColumnRenamed("event_id", "n")
    maps = held.join(large, "n", "left_semi").groupBy("n", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    few = reach.join(held.join(large, "n", "left_anti"), "n").groupBy("event_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    all_bits = reach.join(maps, "n").select("event_id", "bucket", "bits").unionByName(few).groupBy("event_id", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("c"))
    by_bits = all_bits.groupBy("event_id").agg(F.sum("c").alias("c")).join(sizes, "event_id").select("event_id", (F.col("c") - F.col("size")).alias("connectivity"))
    return by_rows.unionByName(by_bits.where("connectivity > 0"))


def connectivity(members: DataFrame) -> DataFrame:
    """(event_id, size, connectivity) of every event: its messages, and the distinct messages of its neighbours,
    the events it shares one with, that it has not itself; (event_id, message_id) rows, those with a null count for nothing.

    The sizes of the neighbours are added up. A message that several of them hold is counted too often: two of them
    that hold it are neighbours as well, so this is found from the triangles of events, and no row a message and
    neighbour is made. Messages of the same events go together."""
    rows = members.select("event_id", "message_id").where("event_id IS NOT NULL AND message_id IS NOT NULL")
    held = materialize(rows.groupBy("message_id").agg(F.collect_set("event_id").alias("ids")).select("ids"), "message-events")
    nodes = held.select(F.explode("ids").alias("event_id"), (F.size("ids") - 1).alias("shared"))
    nodes = materialize(nodes.groupBy("event_id").agg(F.count(F.lit(1)).alias("size"), F.sum("shared").alias("shared")), "event-sizes")
    code = lambda c, seed: F.xxhash64(c, F.lit(seed))
    seed = next(s for s in itertools.count() if nodes.groupBy(code("event_id", s).alias("c")).count().where("count > 1").isEmpty())
    sizes = nodes.select(code("event_id", seed).alias("c"), "size")

    coded = held.where(F.size("ids") > 1).select(F.array_sort(F.transform("ids", lambda e: code(e, seed))).alias("s"))
    edges = materialize(_pairs(coded).select("x", "y").distinct(), "event-pairs")
    links = materialize(edges.join(sizes.toDF("x", "sx"), "x"), "event-pairs-sized")
    release(edges)
    ends = F.struct(F.col("sx").alias("n"), F.col("x").alias("c")), F.struct(F.col("sy").alias("n"), F.col("y").alias("c"))
    ordered = links.join(sizes.toDF("y", "sy"), "y").select(F.least(*ends).alias("v"), F.greatest(*ends).alias("p"))
    edges = materialize(ordered.select(F.col("v.c").alias("v"), F.col("v.n").alias("sv"), F.col("p.c").alias("p"), F.col("p.n").alias("sp")), "event-links")
    release(links)

    end = lambda a, n, out: edges.select(F.col(a).alias("c"), F.col(n).alias("n"), F.lit(out).alias("out"))
    around = end("v", "sp", True).unionByName(end("p", "sv", False)).groupBy("c")
    around = materialize(around.agg(F.sum("n").alias("n"), (F.bool_or("out") & F.bool_or(~F.col("out"))).alias("between")), "event-reach")
    out = nodes.withColumn("c", code("event_id", seed)).join(around.select("c", "n"), "c", "left")
    total = F.coalesce(F.col("n") - F.col("shared"), F.lit(0))
    if between := around.where("between").count():
        middle = around.where("between").select(F.col("c").alias("m"))
        out = out.join(_counted_again(coded, edges, F.broadcast(middle) if between <= FEW else middle), "c", "left")
        total = total - F.coalesce("again", F.lit(0))
    return out.select("event_id", "size", total.cast("bigint").alias("connectivity"))


def _pairs(sets: DataFrame) -> DataFrame:
    """(x, y, *) with x < y of each sorted array ``s``."""
    rows = sets.select("*", F.posexplode("s").alias("i", "x"))
    return rows.select("*", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("y")).drop("i")


def _counted_again(coded: DataFrame, edges: DataFrame, middle: DataFrame) -> DataFrame:
    """(c, again): over the messages an event has not, the number of its neighbours that hold one, less one.

    coded: the events ``s`` of each message; edges (v, p) in one order of the events; middle: those (m) with edges to both sides."""
    after = edges.select(F.col("v").alias("m"), F.col("p").alias("q")).join(middle, "m", "left_semi")
    paths = edges.select("v", F.col("p").alias("m")).join(middle, "m", "left_semi").join(after, "m")
    closed = materialize(paths.join(edges.select("v", F.col("p").alias("q")), ["v", "q"], "left_semi"), "event-triangles")
    roles = [F.struct(F.col(c).alias("c"), F.least(a, b).alias("x"), F.greatest(a, b).alias("y")) for c, a, b in (("v", "m", "q"), ("m", "v", "q"), ("q", "v", "m"))]
    roles = closed.select(F.explode(F.array(*roles)).alias("r")).select("r.*")
    groups = materialize(coded.groupBy("s").agg(F.count(F.lit(1)).alias("w")).withColumn("g", F.monotonically_increasing_id()), "event-groups")
    met = _pairs(groups).join(roles, ["x", "y"]).where(~F.array_contains("s", F.col("c"))).groupBy("c", "g").agg(F.first("w").alias("w"), F.count(F.lit(1)).alias("pairs"))
    # k neighbours that hold a message make k (k - 1) / 2 pairs.
    return met.groupBy("c").agg(F.sum(F.col("w") * F.round((F.sqrt(1 + 8 * F.col("pairs")) - 1) / 2).cast("bigint")).alias("again"))


def normalized(raw: Column, name: str) -> Column:
    """Share of the reference, at most 1; null stays null (``least`` alone would drop it)."""
    return F.when(raw.isNotNull(), F.least(F.lit(1.0), raw / REFERENCES[name]))


def score(indicators: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the normalized indicators; null if one is missing, never zero for it."""
    weights = weights or {name: 0.25 for name in REFERENCES}
    total = sum(weights.values())
    out = F.lit(0.0)
    for name, raw in indicators.items():
        out = out + normalized(raw, name) * (weights[name] / total)
    return out


def band(value: Column) -> Column:
    return F.when(value.isNull(), "unavailable").when(value >= CRITICAL, "critical").when(value >= HIGH, "high").when(value >= MEDIUM, "medium").otherwise("low")
