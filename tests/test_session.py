from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkwatch import session


def cluster(master, configured=None):
    chosen = []
    conf = SimpleNamespace(get=lambda key, default=None: configured)
    context = SimpleNamespace(
        master=master,
        applicationId="x",
        getConf=lambda: conf,
        getCheckpointDir=lambda: chosen[-1] if chosen else None,
        setCheckpointDir=chosen.append,
    )
    return SimpleNamespace(sparkContext=context, conf=conf)


@pytest.mark.parametrize("master", ["spark://somewhere:7077", "yarn", "local-cluster[2,1,512]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(cluster(master))
    assert session.shared_folder(cluster(master, "s3a://there/x")) == "s3a://there/x"


def test_a_local_session_gets_a_folder():
    assert "sparkwatch-checkpoint-" in session.shared_folder(cluster("local[4]"))


def test_discarded_tables_are_gone(spark):
    table = session.stored(spark.range(10))
    files = table.inputFiles()
    session.discard(table)
    assert files and spark.sparkContext._jvm.java.io.File(files[0].removeprefix("file://")).exists() is False


def test_few_wide_rows_are_read_at_a_time(spark):
    """A reader takes a row group or 4,096 rows at once, and equal rows take next to no room in a file."""
    rows = spark.range(0, 100, 1, 1).select("id", F.repeat(F.lit("x"), 1 << 16).alias("wide"))
    table = session.stored(rows, 1 << 20)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.inputFiles()]
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 16
    assert table.agg(F.sum("id"), F.sum(F.length("wide"))).first()[:] == (4950, 100 << 16)
