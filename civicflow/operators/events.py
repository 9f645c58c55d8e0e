"""Events: messages of one place and theme, on several levels of place."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicflow.session import materialize

DIMENSIONS, COSINE, MIN_SCOPE, MIN_CLUSTER = 64, 0.72, 5, 2
SPREAD, GROUPS_APART, TILE = 12, 96, (512, 1024)  # blocks of a scope, partitions of their groups, and what of a product stays in the processor's cache
NEAR = 2e-7  # a dimension, beyond what single precision adds to or takes from a product of unit vectors
WORD = "[A-Za-zА-Яа-яЁё][0-9A-Za-zА-Яа-яЁё-]+"
#: Words that tell nothing about an event.
STOP_WORDS = (
    "это как для что при или его еще ещё нет все всё она они оно уже так там тут где когда очень после перед через "
    "from with that this have has the and for"
).split()


def scopes(city: Column, street: Column, building: Column, link: Column | None = None) -> Column:
    """Map of level to object: always global; road, link and building where they are known."""
    road = F.when(city.isNotNull() & street.isNotNull(), F.concat(F.lit("road:"), F.lower(city), F.lit(":"), F.lower(street)))
    levels = F.array(
        F.struct(F.lit("global").alias("level"), F.lit("global").alias("object_id")), F.struct(F.lit("road").alias("level"), road.alias("object_id")),
        F.struct(F.lit("building").alias("level"), building.alias("object_id")),
    )
    if link is not None:
        levels = F.concat(levels, F.array(F.struct(F.lit("link").alias("level"), F.concat(F.lit("link:"), F.lower(link)).alias("object_id"))))
    return F.filter(levels, lambda s: s["object_id"].isNotNull())


def with_enough_messages(rows: DataFrame, least: int = MIN_SCOPE) -> DataFrame:
    """Rows (level, object_id, ...) of the objects that have at least ``least`` messages."""
    counts = rows.groupBy("level", "object_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return rows.join(counts.drop("_n"), ["level", "object_id"], "left_semi")


def hashing_embedding(words: DataFrame, key: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, vector) from (key, word) rows: each word adds or takes one at a place its digest names; unit length."""
    digest = F.sha2(F.col("word"), 256)
    place = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(dimensions)).cast("int")
    sign = F.when(F.pmod(F.conv(F.substring(digest, 10, 1), 16, 10).cast("int"), F.lit(2)) == 1, 1.0).otherwise(-1.0)
    cells = words.select(key, place.alias("i"), sign.alias("x")).groupBy(key, "i").agg(F.sum("x").alias("x"))
    per = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).otherwise(0.0))
    return per.select(key, vector.alias("vector"))


def hashing_counts(rows: DataFrame, key: str, words: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, vector) of rows that hold all their words as an array: hashing_embedding before it gets unit length,
    in whole numbers, without a row a word. No row for one without words; keys should be unique."""

    def count(batches):
        for batch in batches:
            lists = batch.column("words")
            coded = lists.flatten().dictionary_encode()
            digests = [hashlib.sha256(w.encode()).hexdigest() for w in coded.dictionary.to_pylist()]
            place = np.array([int(d[:8], 16) % dimensions for d in digests], np.int64)
            sign = np.array([1.0 if int(d[9], 16) % 2 else -1.0 for d in digests])
            at, code = pc.list_parent_indices(lists).to_numpy(), coded.indices.to_numpy()
            held = np.unique(at)
            cells = np.bincount(np.searchsorted(held, at) * dimensions + place[code], sign[code], len(held) * dimensions).astype(np.int32)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * dimensions), pa.array(cells))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(held)), vector], ["key", "vector"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(words).alias("words")).mapInArrow(count, f"key {kind}, vector array<int>").withColumnRenamed("key", key)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def _forest(n: int, chunks) -> np.ndarray:
    """Least row of each row's component, from chunks of edges (i, j) between n rows."""
    parent = np.arange(n)
    for i, j in chunks:
        while True:
            a, b = parent[i], parent[j]
            live = a != b
            if not live.any():
                break
            np.minimum.at(parent, np.maximum(a, b)[live], np.minimum(a, b)[live])
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    return parent


def cosine_edges(vectors: DataFrame, threshold: float = COSINE, block: int = 65_536, forest: bool = False) -> DataFrame:
    """(scope, a, b) of vectors of one scope with at least a cosine, a < b; every pair is compared.

    A scope is cut into blocks of rows by a hash of the key, at most ``SPREAD`` unless they would exceed
    ``block`` rows, and each group compares two blocks by matrix products, so a large scope spreads over
    tasks and no group holds more than two blocks. The vectors need not have unit length. With
    ``forest`` each group gives only edges that join what its edges join: the components are the same, and
    a block of alike texts gives a row a text instead of a row a pair."""
    n = F.count(F.lit(1))
    sizes = vectors.groupBy("scope").agg(F.greatest(F.ceil(n / block), F.least(F.ceil(n / 4096), F.lit(SPREAD)), F.lit(1)).cast("int").alias("parts"))
    rows = vectors.join(sizes, "scope").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, "part").alias("p"), F.greatest(o, "part").alias("q"), (o < F.col("part")).cast("int").alias("side")))
    rows = rows.select("scope", "key", "vector", F.explode(met).alias("m")).select("scope", "m.p", "m.q", "key", "vector", "m.side")

    def compare(table: pa.Table) -> pa.Table:
        scope, keys, side = table["scope"][0].as_py(), table["key"].to_numpy(), table["side"].to_numpy()
        m = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(keys), -1)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        one = not side.any() and table["p"][0] == table["q"][0]
        u, v, a, b = (m, m, keys, keys) if one else (m[side == 0], m[side == 1], keys[side == 0], keys[side == 1])
        x = y = keys[:0]
        if len(a) and len(b):
            hits = _alike(u, v, threshold - 1e-12, one)
            if forest:
                shift = 0 if one else len(a)
                root = _forest(shift + len(b), ((i, j + shift) for i, j in _gathered(hits)))
                both = a if one else np.concatenate([a, b])
                moved = np.flatnonzero(root != np.arange(len(root)))
                x, y = both[moved], both[root[moved]]
            else:
                i, j = (np.concatenate(k) for k in zip(*hits, strict=True))
                keep = a[i] != b[j]
                x, y = a[i][keep], b[j][keep]
        kinds = table.schema.field("scope").type, table.schema.field("key").type
        return pa.table({"scope": pa.array([scope] * len(x), kinds[0]), "a": pa.array(np.minimum(x, y), kinds[1]), "b": pa.array(np.maximum(x, y), kinds[1])})

    kind = dict(vectors.dtypes)
    spread = rows.repartition(GROUPS_APART, "scope", "p", "q")  # by number: else adaptive execution puts small blocks, which cost their square, into few tasks
    return spread.groupBy("scope", "p", "q").applyInArrow(compare, f"scope {kind['scope']}, a {kind['key']}, b {kind['key']}")


def _alike(u: np.ndarray, v: np.ndarray, least: float, one: bool = False):
    """(i, j) with u[i] @ v[j] >= least, in chunks, of unit vectors; products in single precision that are close
    to ``least`` are made again in double. ``one``: u and v are the same, only i < j is wanted."""
    short, low, near = u.astype(np.float32), v.astype(np.float32), NEAR * (u.shape[1] + 2)
    product, over = np.empty(TILE, np.float32), np.empty(TILE, bool)
    for c in range(0, len(v), TILE[1]):
        right = np.ascontiguousarray(low[c : c + TILE[1]].T)
        for r in range(0, min(len(u), c + TILE[1]) if one else len(u), TILE[0]):
            left = short[r : r + TILE[0]]
            if (len(left), right.shape[1]) != product.shape:
                product, over = np.empty((len(left), right.shape[1]), np.float32), np.empty((len(left), right.shape[1]), bool)
            np.matmul(left, right, out=product)
            at = np.flatnonzero(np.greater_equal(product, least - near, out=over))
            i, j = at // right.shape[1] + r, at % right.shape[1] + c
            sure = product.ravel()[at] >= least + near
            if one:
                later = i < j
                i, j, sure = i[later], j[later], sure[later]
            close = np.flatnonzero(~sure)
            for k in np.array_split(close, len(close) // 100_000 + 1):
                sure[k] = np.einsum("ij,ij->i", u[i[k]], v[j[k]]) >= least
            yield i[sure], j[sure]


def _gathered(chunks, rows: int = 1_000_000):
    """The same edges in chunks of about so many."""
    held, n = [], 0
    for chunk in chunks:
        held.append(chunk)
        n += len(chunk[0])
        if n >= rows:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def clusters(vectors: DataFrame, edges: DataFrame, least: int = MIN_CLUSTER, allow_single: bool = True) -> DataFrame:
    """(scope, key, cluster): components of the cosine graph of at least ``least`` members; others are noise."""
    from civicflow.operators.graph import connected_components

    found = connected_components(edges.select("a", "b")).withColumnRenamed("node", "key")
    rows = vectors.select("scope", "key").join(found, "key")
    sized = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("component"))).where(F.col("n") >= least)
    out = sized.select("scope", "key", F.col("component").alias("cluster"))
    if not allow_single:
        several = out.groupBy("scope").agg(F.countDistinct("cluster").alias("c")).where("c > 1").select("scope")
        out = out.join(several, "scope", "left_semi")
    return out


def dominant(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Commonest value per group; ties go to the lesser in lower case, then the lesser."""
    counts = rows.where(F.length(column) > 0).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.lower(column).alias("l"), F.col(column).alias("v")))
    return counts.groupBy(*by).agg(best.getField("v").alias(column))


def keywords(rows: DataFrame, by: list[str], text: str, k: int = 6) -> DataFrame:
    """(by, keywords): the words of three letters or more in most texts of a group, stop words left out."""
    words = rows.select(*by, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))).alias("w"))
    counts = words.where((F.length("w") >= 3) & ~F.col("w").isin(STOP_WORDS)).groupBy(*by, "w").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "w"))).where(F.col("r") <= k)
    return ranked.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]), ",").alias("keywords"))


def representatives(rows: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """(by, key, rank): the members nearest to their group's mean vector; rows: (by, key, vector)."""
    cells = rows.select(*by, F.posexplode("vector").alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("mean"))
    near = rows.join(means, by).select(*by, "key", F.round(cosine(F.col("vector"), F.col("mean")), 9).alias("cosine"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("cosine"), "key"))).where(F.col("rank") <= k)


def aggregate_events(members: DataFrame) -> DataFrame:
    """One row an event from (level, object_id, cluster, message_id, category, topic, published_at) rows."""
    by = ["level", "object_id", "cluster"]
    base = members.groupBy(*by).agg(
        F.array_sort(F.collect_set("message_id")).alias("message_ids"), F.countDistinct("message_id").alias("size"), F.min("published_at").alias("started_at"), F.max("published_at").alias("ended_at")
    )
    event_id = F.concat(F.lit("evt_"), F.left(F.sha2(F.concat_ws("|", "level", "object_id", F.array_join(F.col("message_ids").cast("array<string>"), ",")), 256), F.lit(24)))
    return materialize(base, "events").join(dominant(members, by, "category"), by, "left").join(dominant(members, by, "topic"), by, "left").withColumn("event_id", event_id)
