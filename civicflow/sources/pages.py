"""Pages of the web and of feeds: extraction, access walls, paged reads as a Spark data source."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from civicflow.operators.normalize import markup_to_text


def access_wall(status: Column, text: Column) -> Column:
    """Why a page cannot be read: by its status first, then by the words of its beginning."""
    head = F.lower(F.left(F.coalesce(text, F.lit("")), F.lit(5000)))
    out = F.when(status == 401, "login_required").when(status == 403, "forbidden").when(status == 429, "rate_limited").when(status >= 500, "server_error")
    return out.when(head.rlike("captcha|капч"), "captcha").when(head.rlike("are you a robot|проверка браузера|ddos"), "anti_bot").otherwise("open")


class _Page(HTMLParser):
    """Title, heading, link of the canonical form, publication time, article and plain text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.parts: dict[str, list[str]] = {"title": [], "h1": [], "article": []}
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (name := a.get("property") or a.get("name")):
            self.meta.setdefault(name, a.get("content", ""))
        if tag == "link" and a.get("rel") == "canonical":
            self.meta.setdefault("canonical", a.get("href", ""))
        if tag == "time" and a.get("datetime"):
            self.meta.setdefault("time", a["datetime"])
        if tag in ("title", "h1", "main", "article"):
            self.inside.append("article" if tag == "main" else tag)

    def handle_endtag(self, tag: str) -> None:
        name = "article" if tag == "main" else tag
        if name in self.inside:
            self.inside.remove(name)

    def handle_data(self, data: str) -> None:
        for name in self.inside:
            self.parts[name].append(data)


def page_fields(page: str) -> dict[str, str | None]:
    """Title (heading, then the shared title, then the page's), body, publication time, canonical link."""
    parser = _Page()
    parser.feed(page)
    flat = {k: " ".join(" ".join(v).split()) for k, v in parser.parts.items()}
    whole = " ".join(markup_to_text(page)[0].split())
    return {
        "title": flat["h1"] or parser.meta.get("og:title") or flat["title"] or None,
        "body": flat["article"] if len(flat["article"]) >= 80 else whole,
        "published": parser.meta.get("article:published_time") or parser.meta.get("time"),
        "canonical": parser.meta.get("canonical"),
    }


_STEP = re.compile(r"^(?P<tag>[a-z0-9]*)(?:#(?P<id>[\w-]+))?(?:\.(?P<cls>[\w-]+))?(?:\[(?P<attr>[\w-]+)=[\"']?(?P<val>[^\"'\]]+)[\"']?\])?$", re.I)


def select(page: str, selector: str) -> list[str]:
    """Texts of the elements that a selector of tags, ids, classes, attributes and descent picks."""
    steps = [_STEP.match(s) for s in selector.split()]
    if not steps or not all(steps):
        raise ValueError(f"unsupported selector: {selector}")
    out: list[list[str]] = []

    def fits(step: re.Match, tag: str, attrs: dict[str, str]) -> bool:
        return (
            (not step["tag"] or step["tag"].lower() == tag)
            and (not step["id"] or attrs.get("id") == step["id"])
            and (not step["cls"] or step["cls"] in attrs.get("class", "").split())
            and (not step["attr"] or attrs.get(step["attr"]) == step["val"])
        )

    class Walk(HTMLParser):
        path: list[tuple[str, int, int | None]] = []

        def handle_starttag(self, tag: str, attrs: list) -> None:
            depth = self.path[-1][1] if self.path else 0
            chosen = None
            if fits(steps[min(depth, len(steps) - 1)], tag, {k: v or "" for k, v in attrs}):
                depth = min(depth + 1, len(steps))
                if depth == len(steps):
                    chosen = len(out)
                    out.append([])
                    depth = len(steps) - 1
            if tag not in ("br", "img", "meta", "link", "input", "hr"):
                self.path.append((tag, depth, chosen))

        def handle_endtag(self, tag: str) -> None:
            for k in range(len(self.path) - 1, -1, -1):
                if self.path[k][0] == tag:
                    del self.path[k:]
                    break

        def handle_data(self, data: str) -> None:
            for _, _, chosen in self.path:
                if chosen is not None:
                    out[chosen].append(data)

    walk = Walk(convert_charrefs=True)
    walk.path = []
    walk.feed(page)
    return [" ".join("".join(x).split()) for x in out]


class PagedJson(DataSource):
    """``spark.read.format("paged_json").option("path", folder)``: files of pages {"messages": [...]}; a file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "source string, external_id string, text string, published_at string, url string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(schema, self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.path = schema.names, options["path"]

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(f"{self.path}/*.json"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    for message in json.loads(line).get("messages", []):
                        yield tuple(message.get(n) for n in self.names)
