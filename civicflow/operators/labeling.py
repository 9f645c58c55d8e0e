"""Labels for messages: pluggable scorers, top labels, calibration, confidence bands, source kinds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGH, LOW_CATEGORY, LOW_TOPIC = 0.85, 0.65, 0.60


def predict(messages: DataFrame, column: str, load: Callable[[], Callable[[list[str]], list[list[tuple[str, float]]]]]) -> DataFrame:
    """(message_id, label, score): ``load`` makes the model once per worker, the model scores batches of texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            scored = model(frame[column].tolist())
            rows = [(i, label, float(s)) for i, labels in zip(frame["message_id"], scored, strict=True) for label, s in labels]
            yield pd.DataFrame(rows, columns=["message_id", "label", "score"])

    return messages.select("message_id", column).where(F.length(F.trim(column)) > 0).mapInPandas(run, "message_id bigint, label string, score double")


def keyword_scores(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """Array of (label, score): the share of a label's key words that a text has; labels without one are left out."""
    low = F.lower(text)
    scored = [F.struct(F.lit(label).alias("label"), (sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) / len(words)).alias("score")) for label, words in rules.items()]
    return F.filter(F.array(*scored), lambda x: x["score"] > 0)


def top_label(scored: DataFrame, mapping: dict[str, str] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """Best (label, score) per message after mapping raw labels and keeping the allowed ones; ties go to the lesser label."""
    label = F.col("label")
    if mapping:
        table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
        label = F.coalesce(table[label], label)
    rows = scored.select("message_id", label.alias("label"), "score")
    if allowed is not None:
        rows = rows.where(F.col("label").isin(allowed))
    merged = rows.groupBy("message_id", "label").agg(F.max("score").alias("score"))
    best = merged.groupBy("message_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("label").alias("label"))).alias("b"))
    return best.select("message_id", F.col("b.label").alias("label"), (-F.col("b.s")).alias("score"))


def calibrate(score: Column, curve: list[tuple[float, float]]) -> Column:
    """Piecewise-linear map through the points of a monotone curve from 0 to 1, rounded to six places."""
    out = F.lit(None).cast("double")
    for (x0, y0), (x1, y1) in reversed(list(zip(curve, curve[1:], strict=False))):
        out = F.when(score <= x1, F.lit(y0) + (score - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.round(out, 6)


def confidence_band(category: Column, topic: Column) -> Column:
    """high if both scores are, low if one is below its threshold, else medium; a missing topic counts as low."""
    topic = F.coalesce(topic, F.lit(0.0))
    return F.when((category < LOW_CATEGORY) | (topic < LOW_TOPIC), "low").when((category >= HIGH) & (topic >= HIGH), "high").otherwise("medium")


def low_confidence_reasons(category: Column, topic: Column) -> Column:
    return F.array_compact(
        F.array(F.when(category < LOW_CATEGORY, "category_below_threshold"), F.when(topic < LOW_TOPIC, "topic_below_threshold"), F.when(topic.isNull(), "topic_missing"))
    )


def within_hierarchy(predictions: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Predictions (message_id, category, topic, ...) whose topic belongs to their category."""
    return predictions.join(hierarchy.select("category", "topic").distinct(), ["category", "topic"], "left_semi")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("message_id").orderBy(F.desc("score"), "label")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Hosts of known platforms.
HOSTS = {
    "t.me": "telegram", "telegram.me": "telegram", "pikabu.ru": "pikabu", "dzen.ru": "dzen", "2gis.ru": "2gis",
    "rutube.ru": "rutube", "vk.com": "vk", "vk.ru": "vk", "ok.ru": "ok", "max.ru": "max", "maxapp.ru": "max",
}


def source_kind(url: Column, title: Column | None = None) -> Column:
    """Kind of a web source: known hosts and their subdomains first, then words of host, path and title."""
    host = F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract(url, "^[a-zA-Z]+://[^/]+([^?#]*)", 1))
    text = F.concat_ws(" ", F.lower(title) if title is not None else F.lit(""), host)
    out = F.when(host.rlike(r"(\.|^)(gov|gosuslugi)\.ru$") | text.rlike("администрац|муниципал|мэрия"), "municipal")
    out = out.when(host.startswith("forum.") | F.contains(path, F.lit("/forum")) | text.rlike("форум"), "local_forum").when(text.rlike("новост|news|газета|media"), "local_media").otherwise("other_web")
    for name, kind in reversed(HOSTS.items()):
        out = F.when((host == name) | host.endswith("." + name), kind).otherwise(out)
    return out
