"""Frames that are known in part: tiles missing at the end and in the middle of the mosaic."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from lumaspark.sources.raw_video import Shape

NAMES = (
    "a26_diff_histogram_planes", "a2_hue_histogram_planes", "flagship_headers_planes", "measured_planes", "s2_raw_planes", "w17_median3_planes",
    "j8_composite", "j8_composite_planes",
)


@pytest.fixture(scope="module")
def partial(spark, tmp_path_factory):
    """Vectors up to the sixth tile of the second clip's second frame, without a tile and with one inside a row of tiles gone."""
    path = str(tmp_path_factory.mktemp("partial"))
    given = spark.read.parquet(f"{entry.SMOKE_DIR}/embeddings.parquet")
    given.where("vec_id < 131 and vec_id not in (12, 31)").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_partial_mosaic_equals_sql(spark, partial, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{partial}/embeddings.parquet/*.parquet'")
    got = entry.queries()[name](spark, partial)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("layout", ["planar", "p010"])
def test_raw_words_of_holes(layout):
    luma, site = np.array([64, 0xFFFF, 1023, 500], "<u2"), np.array([512], "<u2")
    with pytest.raises(ValueError, match="holes"):
        Shape(2, 2, layout).words(luma, site, site)
    shape = Shape(2, 2, layout, holes=True)
    assert [list(p) for p in shape.planes(shape.words(luma, site, site))] == [list(luma), [512], [512]]
