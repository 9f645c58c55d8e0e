"""Duplicate classification: which message of a group is the first, and what the others are."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicflow.functions import text as T
from civicflow.operators.normalize import similarity_from, simhash64
from civicflow.session import materialize, release

REPEAT_AFTER_S = 86_400
HAMMING, SIMILARITY = 3, 0.88


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def exact_verdicts(rows: DataFrame) -> DataFrame:
    """Verdict of every message against the first of its equal texts.

    rows: message_id, source, external_id, text, published_at. A copy in the same source is a repeated
    appeal if its identity differs and it comes a day later or says so, a copy elsewhere is a repost,
    any other a technical duplicate. Null times sort last; blank texts are unique."""
    order = [F.col("published_at").asc_nulls_last(), F.lower("source"), "external_id", "message_id"]
    key = F.when(F.length(F.trim("text")) > 0, F.sha2(F.lower("text"), 256)).otherwise(F.concat(F.lit("#"), F.col("message_id").cast("string")))
    group = Window.partitionBy("key").orderBy(*order)
    first = lambda c: F.first(c).over(group)
    ranked = rows.withColumn("key", key).select(
        "message_id", "source", "text", "published_at", "external_id", F.row_number().over(group).alias("n"), first("message_id").alias("first_id"), first("source").alias("first_source"),
        first("external_id").alias("first_external"), first("published_at").alias("first_time"),
    )
    gap = F.unix_timestamp("published_at") - F.unix_timestamp("first_time")
    same = F.lower("source") == F.lower("first_source")
    repeated = same & (F.col("external_id") != F.col("first_external")) & (T.has_recurrence_marker(F.col("text")) | (F.coalesce(gap, F.lit(0)) >= REPEAT_AFTER_S))
    kind = F.when(F.col("n") == 1, "unique").when(repeated, "repeated_appeal").when(~same, "cross_source_repost").otherwise("technical_duplicate")
    return ranked.select("message_id", "source", "first_id", kind.alias("kind"), kind.isin("unique", "repeated_appeal").alias("included"))


def near_duplicate_edges(rows: DataFrame) -> DataFrame:
    """(a, b, similarity) of messages that share a band of their hash, differ in few bits and are alike.

    Equal texts are joined once: the edges link the first message of each text."""
    return _near_edges(rows)[0]


def _near_edges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges and the table they read."""
    texts = rows.where(F.length(F.trim("text")) >= T.MIN_CHARS).groupBy("text").agg(F.min("message_id").alias("id"))
    hashed = materialize(texts.withColumn("h", simhash64("text")), "simhash")
    keyed = hashed.select("id", "h", "text", F.explode(T.bands(F.col("h"))).alias("k")).select("id", "h", F.col("k.band").alias("band"), F.col("k.bits").alias("bits"))
    a, b = keyed.alias("a"), keyed.alias("b")
    close = a.join(b, F.expr("a.band = b.band AND a.bits = b.bits AND a.id < b.id")).where(T.hamming(F.col("a.h"), F.col("b.h")) <= HAMMING)
    pairs = close.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    both = pairs.join(hashed.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(hashed.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    score = similarity_from(SIMILARITY - 1e-6)("ta", "tb", T.token_jaccard(T.tokens(F.col("ta")), T.tokens(F.col("tb"))))
    return both.select("a", "b", F.round(score, 6).alias("similarity")).where(F.col("similarity") >= SIMILARITY), hashed


def greedy_verdicts(rows: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Verdicts by the ladder in canonical order: a row that is alike to an earlier *included* row is a
    duplicate of the most similar one (the earliest on a tie).

    The order is settled in rounds on tables: a row with an included earlier neighbour is out, one whose
    earlier neighbours are all out is in. No group of alike rows ever meets in one task."""
    info = rows.select("message_id", F.lower("source").alias("s"), F.coalesce(F.unix_micros("published_at"), F.lit(2**62)).alias("t"))
    placed = edges.join(info.select(F.col("message_id").alias("a"), F.struct("t", "s", F.col("message_id").alias("i")).alias("pa")), "a")
    placed = placed.join(info.select(F.col("message_id").alias("b"), F.struct("t", "s", F.col("message_id").alias("i")).alias("pb")), "b")
    first = F.col("pa") < F.col("pb")
    oriented = placed.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late"), "similarity", F.least("pa", "pb").alias("place")
    )
    oriented = materialize(oriented, "near-edges")
    late = oriented.select(F.col("late").alias("node")).distinct()
    start = oriented.select(F.col("early").alias("node")).distinct().join(late, "node", "left_anti")
    state = materialize(start.select("node", F.lit(True).alias("kept")), "near-state")
    left = late.count()
    for _ in range(max_rounds):
        if not left:
            break
        open_edges = oriented.join(state.select(F.col("node").alias("late")), "late", "left_anti")
        known = open_edges.join(state.withColumnRenamed("node", "early"), "early", "left").groupBy("late").agg(
            F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.bool_and(F.col("kept").isNotNull()).alias("settled")
        )
        fresh = known.where("hit OR settled").select(F.col("late").alias("node"), (~F.col("hit")).alias("kept"))
        state = materialize(state.unionByName(fresh), "near-state")
        left = late.join(state, "node", "left_anti").count()
    if left:
        raise RuntimeError(f"{left} rows are not settled after {max_rounds} rounds")
    leaders = oriented.join(state.where("kept").select(F.col("node").alias("early")), "early").groupBy(F.col("late").alias("node")).agg(
        F.min_by("early", F.struct(-F.col("similarity"), "place")).alias("leader")
    )
    out = state.join(leaders, "node", "left").join(info.select(F.col("message_id").alias("node"), "s"), "node")
    out = out.join(info.select(F.col("message_id").alias("leader"), F.col("s").alias("leader_source")), "leader", "left")
    kind = F.when(F.col("kept"), "unique").when(F.col("s") == F.col("leader_source"), "technical_duplicate").otherwise("cross_source_repost")
    return out.select(F.col("node").alias("message_id"), F.when(F.col("kept"), F.col("node")).otherwise(F.col("leader")).alias("first_id"), kind.alias("kind"), F.col("kept").alias("included"))


def ladder_verdicts(rows: DataFrame) -> DataFrame:
    """(message_id, first_id, step, similarity, kind, included) of every row by the whole ladder.

    rows: message_id, source, external_id, url, model_text, published_at, rejected. In canonical order (time, nulls last,
    source, external_id, id) a row is compared with the earlier *included* rows: same identity, else same
    canonical url, else same model text, else the most similar near-duplicate (the earliest on a tie). It is
    a repeated appeal (included) if the source is the same, the identity is not and it comes a day later or
    says so; else a repost or a technical duplicate. Rejected rows take no part and get the kind rejected.

    Rounds on tables settle the order, as no more than the first included and the first open row of an
    identity, url or text matters to later rows. The first open row can always be settled, so the rounds end
    by themselves; the copies of one text are settled together unless one of them is included."""
    never = F.lit(2**62)
    place = F.struct(
        F.coalesce(F.unix_micros("published_at"), never).alias("t"), F.coalesce(F.lower("source"), F.lit("")).alias("s"), F.coalesce("external_id", F.lit("")).alias("e"), F.col("message_id").alias("i")
    )
    alone = F.encode(F.concat(F.lit("#"), F.col("message_id").cast("string")), "utf-8")
    live = rows.where("NOT rejected").select(
        place.alias("p"), F.coalesce(F.unhex(T.identity_digest(F.col("source"), F.col("external_id"))), alone).alias("k_identity"), F.coalesce(F.unhex(F.sha2(T.canonical_url(F.col("url")), 256)), alone).alias("k_url"),
        F.unhex(F.sha2("model_text", 256)).alias("k_text"), T.has_recurrence_marker(F.col("model_text")).alias("again"), "model_text",
    )
    live = materialize(live, "ladder-rows")
    texts = live.select(F.col("p.i").alias("message_id"), F.col("model_text").alias("text"))
    digests = live.select(F.col("p.i").alias("i"), F.col("k_text").alias("k"))
    edges, hashed = _near_edges(texts)
    near = edges.join(digests.select(F.col("i").alias("a"), F.col("k").alias("ka")), "a").join(digests.select(F.col("i").alias("b"), F.col("k").alias("kb")), "b")
    near = materialize(near.select("similarity", F.explode(F.array(F.struct(F.col("ka").alias("x"), F.col("kb").alias("y")), F.struct(F.col("kb").alias("x"), F.col("ka").alias("y")))).alias("e")).select("e.x", "e.y", "similarity"), "ladder-edges")
    release(hashed)
    nothing = F.lit(None).cast("struct<t:bigint,s:string,e:string,i:bigint>")
    # A row is alone if no other has its identity, url or text and its text has no near one; equal hashes of different keys only keep a row among the others.
    told = lambda n, k: F.xxhash64(F.lit(n), k)
    keys = live.select(F.col("p.i").alias("i"), F.explode(F.array(*(told(n, k) for n, k in enumerate(("k_identity", "k_url", "k_text"))))).alias("h"))
    shared = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h").unionByName(near.select(told(2, "x").alias("h"))).distinct()
    meeting = keys.join(shared, "h", "left_semi").select("i").distinct().withColumn("meets", F.lit(True))
    marked = live.join(meeting, F.col("p.i") == F.col("i"), "left").drop("i", "model_text").withColumn("meets", F.coalesce("meets", F.lit(False)))
    marked = materialize(marked.withColumns({k: F.when(F.col("meets"), F.col(k)) for k in ("k_identity", "k_url", "k_text")}), "ladder-marked")
    release(live)
    unset = {"kept": F.lit(None).cast("boolean"), "leader": nothing, "step": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double")}
    state = materialize(marked.where("meets").drop("meets").withColumns(unset), "ladder-state")
    left = state.count()
    while left:
        open_rows = state.where("kept IS NULL")
        fronts = {
            k: state.groupBy(k).agg(F.min(F.when(F.col("kept"), F.col("p"))).alias(f"f_{k}"), F.min(F.when(F.col("kept").isNull(), F.col("p"))).alias(f"o_{k}")) for k in ("k_identity", "k_url", "k_text")
        }
        before = lambda k: F.coalesce(F.col(f"f_{k}") < F.col("p"), F.lit(False))
        # An open row before the first included one may still come first itself.
        led = lambda k: before(k) & (F.col(f"o_{k}").isNull() | (F.col(f"o_{k}") > F.col(f"f_{k}")))
        none = lambda k: ~before(k) & (F.col(f"o_{k}").isNull() | (F.col(f"o_{k}") >= F.col("p")))
        alike = open_rows.select("p", F.col("k_text").alias("x")).join(near, "x").join(fronts["k_text"].withColumnRenamed("k_text", "y"), "y")
        alike = alike.groupBy(F.col("p.i").alias("i")).agg(
            F.bool_and(led("k_text") | none("k_text")).alias("near_known"), F.min(F.when(led("k_text"), F.struct((-F.col("similarity")).alias("d"), F.col("f_k_text").alias("f")))).alias("best")
        )
        x = open_rows.drop("leader", "step", "similarity", "kept")
        for k, front in fronts.items():
            x = x.join(front, k)
        x = x.join(alike, F.col("p.i") == F.col("i"), "left").withColumn("near_known", F.coalesce("near_known", F.lit(True)))
        exact = F.when(led("k_identity"), "identity").when(none("k_identity") & led("k_url"), "url").when(none("k_identity") & none("k_url") & led("k_text"), "text")
        x = x.withColumn("exact", exact)
        # Ready, if no open copy of the text before it gets included.
        ready = F.col("exact").isNotNull() | (none("k_identity") & none("k_url") & ~before("k_text") & F.col("near_known"))
        x = x.withColumn("ready", ready).withColumn("step", F.coalesce("exact", F.when(F.col("best").isNotNull(), "near"))).withColumn(
            "leader", F.when(F.col("exact") == "identity", F.col("f_k_identity")).when(F.col("exact") == "url", F.col("f_k_url")).when(F.col("exact") == "text", F.col("f_k_text")).otherwise(F.col("best.f"))
        )
        x = x.withColumn("similarity", F.when(F.col("exact").isNotNull(), 1.0).otherwise(-F.col("best.d"))).withColumn("kept", F.col("leader").isNull() | _repeated())
        earlier = Window.partitionBy("k_text").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        x = x.withColumn("blocked", F.coalesce(F.max(~F.col("ready") | F.col("kept")).over(earlier), F.lit(False)))
        done = F.col("exact").isNotNull() | (F.col("ready") & ~F.col("blocked"))
        fresh = x.select(*[c for c in state.columns if c not in ("kept", "leader", "step", "similarity")], *[F.when(done, F.col(c)).alias(c) for c in ("kept", "leader", "step", "similarity")])
        before_round, state = state, materialize(state.where("kept IS NOT NULL").unionByName(fresh), "ladder-state")
        release(before_round)
        last, left = left, state.where("kept IS NULL").count()
        if left == last:
            raise RuntimeError(f"{left} rows cannot be settled")
    kind = F.when(F.col("leader").isNull(), "unique").when(F.col("kept"), "repeated_appeal").when(F.col("leader.s") != F.col("p.s"), "cross_source_repost").otherwise("technical_duplicate")
    state = state.unionByName(marked.where("NOT meets").drop("meets").withColumns(unset | {"kept": F.lit(True)}))
    out = state.select(F.col("p.i").alias("message_id"), F.coalesce("leader.i", "p.i").alias("first_id"), "step", "similarity", kind.alias("kind"), F.col("kept").alias("included"))
    rejected = rows.where("rejected").select(
        "message_id", F.col("message_id").alias("first_id"), F.lit(None).cast("string").alias("step"), F.lit(None).cast("double").alias("similarity"), F.lit("rejected").alias("kind"), F.lit(False).alias("included")
    )
    return out.unionByName(rejected)


def _repeated():
    """Whether the row at ``p`` repeats the appeal of its ``leader``."""
    known = (F.col("p.t") != F.lit(2**62)) & (F.col("leader.t") != F.lit(2**62))
    late = known & (F.col("p.t") - F.col("leader.t") >= REPEAT_AFTER_S * 1_000_000)
    return (F.col("p.s") == F.col("leader.s")) & (F.col("p.e") != F.col("leader.e")) & (F.col("again") | late)


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    kinds = ("unique", "repeated_appeal", "cross_source_repost", "technical_duplicate")
    return verdicts.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.count_if("included").alias("included"))


