"""Reading the tables from a MySQL server through Spark's JDBC source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


# Names and defaults of the existing settings.
@dataclass(frozen=True)
class DatabaseSettings:
    host: str = "localhost"
    port: int = 3306
    user: str = ""
    password: str = ""
    database: str = ""
    ssl: bool = False


CONNECT_TIMEOUT_MS = 5000


def jdbc_options(settings: DatabaseSettings) -> dict[str, str]:
    """Connection options; TLS encrypts without checking the server's certificate."""
    tls = "REQUIRED" if settings.ssl else "DISABLED"
    return {
        "url": f"jdbc:mysql://{settings.host}:{settings.port}/{settings.database}"
        f"?connectTimeout={CONNECT_TIMEOUT_MS}&sslMode={tls}",
        "user": settings.user,
        "password": settings.password,
        "driver": "com.mysql.cj.jdbc.Driver",
    }


def read_jdbc(
    spark: SparkSession,
    settings: DatabaseSettings,
    table: str,
    split_column: str,
    lower: int,
    upper: int,
    partitions: int,
    fetch_size: int = 10_000,
) -> DataFrame:
    """Read a table in `partitions` ranges of a number column; filters and columns are pushed to the server.

    Needs the MySQL driver on the class path.
    """
    return (
        spark.read.format("jdbc")
        .options(**jdbc_options(settings))
        .option("dbtable", table)
        .option("partitionColumn", split_column)
        .option("lowerBound", str(lower))
        .option("upperBound", str(upper))
        .option("numPartitions", str(partitions))
        .option("fetchsize", str(fetch_size))
        .load()
    )
