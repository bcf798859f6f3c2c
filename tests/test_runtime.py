from riskloom import runtime


class Session:
    """Just the settings that choose the folder."""

    def __init__(self, **settings):
        self.conf = {"spark.sql.warehouse.dir": "hdfs://shared/warehouse", **settings}


def test_named_folder_wins():
    assert runtime.shared_folder(Session(**{"spark.checkpoint.dir": "hdfs://shared/dir/"})) == "hdfs://shared/dir"


def test_else_below_the_warehouse():
    assert runtime.shared_folder(Session()) == "hdfs://shared/warehouse/scratch"


def test_scratch_goes_when_it_is_not_needed(spark):
    one, two = runtime.cut(spark.range(3)), runtime.cut(spark.range(4))
    runtime.discard(one)
    assert two.count() == 4
    folder = runtime.shared_folder(spark)
    names = [two._scratch_folder.rpartition("/")[2], one._scratch_folder.rpartition("/")[2]]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = {f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
    assert names[0] in there and names[1] not in there
