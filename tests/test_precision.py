"""Queries and their SQL on values where single precision, or decimals in the place of doubles would tell."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folioflow.plans.all import ORACLES, QUERIES
from tests.parity import compare


@pytest.fixture(scope="module")
def edge(tmp_path_factory):
    """A folder with vectors of components just under a byte's edge, and suppliers of 181 and 341 lines, and its connection."""
    import duckdb

    folder = tmp_path_factory.mktemp("edge")
    under = np.nextafter(np.float32(0), np.float32(-1))
    rng = np.random.default_rng(3)
    vectors = rng.integers(-100, 101, (6, 64)).astype(np.float32) / 128
    vectors[:, ::7] = np.array([under, -1e-9, -3e-9, under, -1e-12, -2e-8], np.float32)[:, None]
    pq.write_table(pa.table({"vec_id": pa.array(range(6), pa.int64()), "embedding": pa.array([*vectors], pa.list_(pa.float32())), "label": pa.array([0, 0, 0, 1, 1, 1], pa.int32())}), folder / "embeddings.parquet")
    suppliers = [*[1] * 181, *[2] * 341]
    values = [float(x) for n in (181, 341) for x in rng.permutation(n)]
    pq.write_table(pa.table({"l_suppkey": pa.array(suppliers, pa.int64()), "l_quantity": values, "l_extendedprice": [x * 1.5 for x in values]}), folder / "lineitem.parquet")
    con = duckdb.connect()
    for name in ("embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return str(folder), con


@pytest.mark.parametrize("name", ["box_blurred", "brighter_scans", "inked_pixels", "line_pitch", "local_spread", "gray_scans", "histogram256", "turned_planes", "stretched_planes", "tiled_spread", "content_bounds"])
def test_query_and_sql_agree_at_edges(spark, edge, name):
    folder, con = edge
    compare(QUERIES[name](spark, folder), con, ORACLES[name])


