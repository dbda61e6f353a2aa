import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def harbours(spark):
    """Three ports with sea routes, and a ship: Oslo -ROUTE-> Lisbon -ROUTE-> Genoa, Oslo -ROUTE-> Genoa, Marlin -MOORED_AT-> Lisbon."""
    from graphspark.graph import EDGES, NODES, PropertyGraph

    nodes = spark.createDataFrame(
        [
            (21, ["Port"], '{"name": "Oslo", "berths": 40}', None),
            (22, ["Port"], '{"name": "Lisbon", "berths": 12}', None),
            (23, ["Port"], '{"name": "Genoa", "berths": 27}', None),
            (24, ["Ship", "Ferry"], '{"name": "Marlin", "length": 155}', None),
        ],
        NODES,
    )
    edges = spark.createDataFrame(
        [
            (5, 21, 22, "ROUTE", '{"days": 6}', 2.5, None, None),
            (6, 22, 23, "ROUTE", '{"days": 4}', 1.5, None, None),
            (7, 21, 23, "ROUTE", '{"days": 9}', 7.0, None, None),
            (8, 24, 22, "MOORED_AT", "{}", 1.0, None, None),
        ],
        EDGES,
    )
    return PropertyGraph.of(nodes, edges)


@pytest.fixture(scope="session")
def make_graph(spark):
    from graphspark.graph import EDGES, NODES, PropertyGraph

    def make(ids, edges, embeddings=None):
        """edges: (src, dst, weight[, valid_from, valid_to])"""
        e = [(k + 1, x[0], x[1], "T", "{}", float(x[2]), *(x[3:] or (None, None))) for k, x in enumerate(edges)]
        return PropertyGraph.of(spark.createDataFrame([(i, ["Thing"], "{}", (embeddings or {}).get(i)) for i in ids], NODES), spark.createDataFrame(e, EDGES))

    return make
