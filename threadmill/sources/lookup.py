"""A catalogue search service as a Spark data source, and landing its answers as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .service import Client, QuotaExceededError, Response


class _Names(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def search_source(name: str, transport: Callable[[str, tuple[float, float]], Response], names: list[str], url: Callable[[str], str], partitions: int = 4) -> type[DataSource]:
    """A data source class that asks for each name: (query_name, api_rank, author_id, display_name, orcid, processing_error).

    A failed request is one row with its error; a used-up budget ends the job.
    """
    asked = sorted(set(names))

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Names(asked[i::partitions]) for i in range(partitions) if asked[i::partitions]] or [_Names([])]

        def read(self, partition: _Names) -> Iterator[tuple]:
            client = Client(transport)
            for query in partition.names:
                try:
                    reply = client.get(url(query))
                    if reply.status != 200:
                        raise OSError(f"status {reply.status}")
                    for rank, hit in enumerate(reply.body.get("results", [])):
                        yield query, rank, hit.get("id"), hit.get("display_name"), hit.get("orcid"), None
                except QuotaExceededError:
                    raise
                except Exception as e:  # noqa: BLE001  one name's failure is data
                    yield query, None, None, None, None, str(e)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "query_name string, api_rank int, author_id string, display_name string, orcid string, processing_error string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source


def name_to_id(found: DataFrame) -> DataFrame:
    """(display_name, author_id): of several authors of a name the one that was found last."""
    hits = found.where("author_id IS NOT NULL")
    return hits.groupBy("display_name").agg(F.max_by("author_id", F.struct("query_name", "api_rank")).alias("author_id"))


def land_search(spark: SparkSession, source: type[DataSource], path: str) -> DataFrame:
    """Ask once and keep the answers: later runs read the table."""
    from .files import read_through

    spark.dataSource.register(source)
    return read_through(spark, path, lambda: spark.read.format(source.name()).load())
