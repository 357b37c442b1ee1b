import pytest

from emberline.sources import adapter

VIEWS = {"det": adapter.DET, "hist": adapter.HIST, "features": adapter.FEATURES, **adapter.LAYERS}


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_views_keep_every_row_of_their_table(spark, small, name):
    key, view = ("feature_id" if name == "features" else "id"), VIEWS[name]
    ids = adapter.spark_view(spark, small, view).select(key)
    assert ids.count() == ids.distinct().count() == spark.read.parquet(f"{small}/{view[0]}.parquet").count()
