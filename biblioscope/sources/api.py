"""A Spark data source over a paged works API: one partition for each source id, cursor paging, retries."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_id string, work string"
#: Page size, retries and the first wait in seconds; what the API is asked for.
PER_PAGE, RETRIES, WAIT = 200, 5, 2.0
FIELDS = "id,doi,title,abstract_inverted_index,publication_year,publication_date,primary_location,language,cited_by_count,type,is_retracted,authorships,referenced_works,concepts"


def fetch_url(url: str) -> dict:
    with urllib.request.urlopen(url, timeout=60) as reply:  # noqa: S310
        return json.load(reply)


def pages(base: str, source: str, years: tuple[int, int], kinds: str, fetch: Callable[[str], dict] = fetch_url, sleep: Callable[[float], None] = time.sleep, strict: bool = False) -> Iterator[dict]:
    """All works of a source. A page that fails is tried again after 2, 4, 8, ... seconds; after the last try what came so far
    stays, or, if strict, the read fails, so that a part of a source isn't taken for all of it."""
    cursor = "*"
    where = f"primary_location.source.id:{source},publication_year:{years[0]}-{years[1]},type:{kinds}"
    while cursor:
        query = urllib.parse.urlencode({"filter": where, "select": FIELDS, "per-page": PER_PAGE, "cursor": cursor})
        for attempt in range(RETRIES):
            try:
                page = fetch(f"{base}?{query}")
                break
            except (OSError, ValueError):
                if attempt == RETRIES - 1:
                    if strict:
                        raise
                    return
                sleep(WAIT * 2**attempt)
        yield from page.get("results", [])
        cursor = (page.get("meta") or {}).get("next_cursor") if page.get("results") else None


#: Works of one download at most, seconds between its requests.
MOST_WORKS, PAUSE = 2000, 0.1


def abstracts(base: str, dois: Sequence[str] | None = None, where: str = "", most: int = MOST_WORKS, fetch: Callable[[str], dict] = fetch_url, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Works of a list of DOIs, or else of a filter, that have an abstract, `most` at most; a pause follows each request."""
    seen = 0
    for doi in dois if dois is not None else ():
        page = fetch(f"{base}?{urllib.parse.urlencode({'filter': f'doi:{doi.strip().lower()}', 'select': FIELDS})}")
        sleep(PAUSE)
        for work in page.get("results", []):
            if work.get("abstract_inverted_index") and seen < most:
                seen += 1
                yield work
    cursor = "*" if dois is None else None
    while cursor and seen < most:
        page = fetch(f"{base}?{urllib.parse.urlencode({'filter': where, 'select': FIELDS, 'per-page': PER_PAGE, 'cursor': cursor})}")
        sleep(PAUSE)
        for work in page.get("results", []):
            if work.get("abstract_inverted_index") and seen < most:
                seen += 1
                yield work
        cursor = (page.get("meta") or {}).get("next_cursor") if page.get("results") else None


def collect(spark: SparkSession, sources: Sequence[str], path: str, read: Callable[[list[str]], DataFrame], every: int = 5) -> DataFrame:
    """Collects the works of the sources, `every` of them at a time, into a table at path that other runs go on with.

    Each group is appended with its sources marked as done, so a run that ends early loses the group it was at, no more;
    sources that are done aren't read again. A mark without works is kept for sources that have none. Returns rows (source_id, work)."""
    schema = f"{SCHEMA}, done boolean"
    try:
        done = {r.source_id for r in spark.read.schema(schema).parquet(path).filter("done").select("source_id").distinct().collect()}
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        done = set()
    rest = [s for s in dict.fromkeys(sources) if s not in done]
    for k in range(0, len(rest), every):
        own = rest[k : k + every]
        marks = spark.createDataFrame([(s, None, True) for s in own], schema)
        read(own).select("source_id", "work", F.lit(False).alias("done")).unionByName(marks).write.mode("append").parquet(path)
    if not rest and not done:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(schema).parquet(path).filter("not done").select("source_id", "work")


class OneSource(InputPartition):
    def __init__(self, source: str) -> None:
        super().__init__(source)
        self.source = source


class WorksReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [OneSource(s) for s in self.options.get("sources", "").split(",") if s]

    def read(self, partition: OneSource) -> Iterator[tuple]:
        base = self.options["url"]
        years = (int(self.options.get("from", 2000)), int(self.options.get("to", 2024)))
        if base.startswith("file:"):  # recorded works, one JSON a line, named by source
            with open(f"{base.removeprefix('file:').removeprefix('//')}/{partition.source}.jsonl", encoding="utf-8") as lines:
                for line in lines:
                    yield partition.source, line.strip()
            return
        for work in pages(base, partition.source, years, self.options.get("types", "article|review"), strict=self.options.get("strict", "false").lower() == "true"):
            yield partition.source, json.dumps(work)


class WorksSource(DataSource):
    """spark.read.format("works").option("url", ...).option("sources", "S1,S2").load(): rows (source_id, work as JSON).

    With option("strict", "true") a source that can't be read to its end fails the job. Year range and types are part of the request, so only what is wanted is sent."""

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorksReader(self.options)
