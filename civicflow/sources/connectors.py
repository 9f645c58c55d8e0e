"""Payloads of platforms and feeds as message tables; network access stays outside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicflow.functions import text as T

MESSAGE_COLUMNS = ("source", "external_id", "text", "published_at", "url", "author_id")
WALL = "response struct<count:bigint,items:array<struct<id:bigint,owner_id:bigint,from_id:bigint,date:bigint,text:string,comments:array<struct<id:bigint,from_id:bigint,date:bigint,text:string>>>>>"
DISCUSSION = "id string, comments array<struct<id:string,author_id:string,date_ms:bigint,text:string>>"
#: Connectors that are prepared, what they carry and whether they need credentials.
CONNECTORS = (
    ("vk", "api", True, "text,url,author_id"), ("ok", "api", True, "text,author_id"), ("telegram", "api", True, "text,url"), ("local-media", "rss", False, "text,url"),
    ("municipal-public", "html", False, "text,url"), ("dzen", "html", False, "text,url"), ("pikabu", "html", False, "text,url"), ("rutube", "html", False, "text,url"),
)


def connector_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONNECTORS, "name string, access string, needs_credentials boolean, allowed string").withColumn("allowed", F.split("allowed", ","))


def wall_messages(pages: DataFrame) -> DataFrame:
    """Posts and their comments of wall pages (``WALL``), one row a message."""
    posts = pages.select(F.explode("response.items").alias("p"))
    link = F.concat(F.lit("https://vk.com/wall"), F.col("p.owner_id"), F.lit("_"), F.col("p.id"))
    row = lambda i, t, at, author, kind: [F.lit("vk").alias("source"), i.cast("string").alias("external_id"), t.alias("text"), F.timestamp_seconds(at).alias("published_at"), link.alias("url"), author.cast("string").alias("author_id"), F.lit(kind).alias("kind")]
    top = posts.select(*row(F.concat_ws("_", "p.owner_id", "p.id"), F.col("p.text"), F.col("p.date"), F.col("p.from_id"), "post"))
    replies = posts.select("p", F.explode("p.comments").alias("c"))
    return top.unionByName(replies.select(*row(F.concat_ws("_", "p.owner_id", "p.id", "c.id"), F.col("c.text"), F.col("c.date"), F.col("c.from_id"), "comment")))


def discussion_messages(pages: DataFrame) -> DataFrame:
    """Comments of discussions (``DISCUSSION``)."""
    rows = pages.select(F.col("id").alias("d"), F.explode("comments").alias("c"))
    return rows.select(F.lit("ok").alias("source"), F.concat_ws(":", "d", "c.id").alias("external_id"), F.col("c.text").alias("text"), F.timestamp_millis("c.date_ms").alias("published_at"), F.lit(None).cast("string").alias("url"), F.col("c.author_id").alias("author_id"))


def feed_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """(title, link, description, published) of RSS items or Atom entries."""
    schema = "title string, link string, description string, summary string, pubDate string, updated string"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    day = F.regexp_replace("pubDate", r"^\s*[A-Za-z]+,\s*", "")  # Spark's patterns read no names of days
    return rows.select("title", "link", F.coalesce("description", "summary").alias("description"), F.coalesce(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("updated")).alias("published"))


def flatten_collections(results: DataFrame) -> DataFrame:
    """Rows (job, messages: map of source to array of structs) to one row a message, sources in order."""
    return results.select("job", F.explode("messages").alias("source", "ms")).select("job", "source", F.posexplode("ms").alias("place", "m")).select("job", "source", "place", "m.*")


def to_json(messages: DataFrame) -> DataFrame:
    return messages.select(F.to_json(F.struct(*messages.columns)).alias("json"))


def from_json(lines: DataFrame, schema: str) -> DataFrame:
    """Strict: a malformed line fails the read."""
    return lines.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("m")).select("m.*")


def search_hits(results: DataFrame) -> DataFrame:
    """(query, rank, url, title) of result lists, rank from 0."""
    return results.select("query", F.posexplode("hits").alias("rank", "h")).select("query", "rank", "h.url", "h.title")


def merge_places(sources: list[DataFrame], limit: int) -> DataFrame:
    """Union of place tables (name, address, ...); of equal names and addresses the earlier table's row stays."""
    tagged = [s.withColumn("priority", F.lit(k)) for k, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, tagged)
    order = Window.partitionBy(F.lower("name"), F.lower(F.coalesce("address", F.lit("")))).orderBy("priority", "place_id")
    kept = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return kept.orderBy("priority", "place_id").limit(limit)  # the limit is the operator's: so many places are wanted


def coverage(messages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(source, state, n, first_at, last_at): every planned source, with what came of it."""
    got = messages.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))
    return outcomes.join(got, "source", "left").select("source", "state", F.coalesce("n", F.lit(0)).alias("n"), "first_at", "last_at")


def authorize(sources: DataFrame, policies: DataFrame) -> DataFrame:
    """(source, outcome): unknown, disabled and unapproved sources, those closed to robots, then allowed."""
    outcome = F.when(F.col("enabled").isNull(), "no_policy").when(~F.col("enabled"), "disabled").when(~F.col("approved"), "not_approved").when(~F.col("robots_allowed"), "robots_denied").otherwise("allowed")
    return sources.join(policies, "source", "left").select("source", outcome.alias("outcome"))


def canonical_web_url(url: Column) -> Column:
    """http(s) only: lower scheme and host, default port and fragment dropped, query order kept."""
    whole = F.split_part(url, F.lit("#"), F.lit(1))
    origin = F.lower(F.regexp_extract(whole, "^[A-Za-z]+://[^/?]*", 0))
    origin = F.regexp_replace(F.regexp_replace(origin, "^(http://[^/:]+):80$", "$1"), "^(https://[^/:]+):443$", "$1")
    rest = F.substring(whole, F.length(F.regexp_extract(whole, "^[A-Za-z]+://[^/?]*", 0)) + 1, F.length(whole))
    return F.when(url.rlike("(?i)^https?://[^/]"), F.concat(origin, F.when(rest == "", F.lit("/")).otherwise(rest)))


def conforms(document: Column, required: list[str], optional: list[str] = ()) -> Column:
    """Whether a JSON document has all required keys and no unknown ones."""
    keys = F.json_object_keys(document)
    return F.coalesce((F.size(F.array_except(F.array(*map(F.lit, required)), keys)) == 0) & (F.size(F.array_except(keys, F.array(*map(F.lit, [*required, *optional])))) == 0), F.lit(False))


def frontier(seen: DataFrame, found: DataFrame) -> DataFrame:
    """Pages found that were not seen yet, once each."""
    return found.select(canonical_web_url(F.col("url")).alias("url")).where("url IS NOT NULL").distinct().join(seen.select("url"), "url", "left_anti")


def fetch_delay(messages: DataFrame, key: str = "source") -> DataFrame:
    """Seconds between consecutive messages of a source, for rate limits."""
    w = Window.partitionBy(key).orderBy("published_at", "external_id")
    return messages.select(key, "external_id", (F.unix_timestamp("published_at") - F.unix_timestamp(F.lag("published_at").over(w))).alias("delay_s"))


def masked_by_policy(messages: DataFrame, policies: DataFrame) -> DataFrame:
    """Messages with the optional fields their source's policy does not allow set to null."""
    rows = messages.join(policies.select("source", "allowed"), "source", "left")
    keep = lambda c: F.when(F.array_contains("allowed", c), F.col(c)).alias(c)
    return rows.select("source", "external_id", "text", "published_at", keep("url"), keep("author_id"))


def identity(messages: DataFrame) -> DataFrame:
    return messages.withColumn("message_key", T.identity_digest(F.col("source"), F.col("external_id")))
