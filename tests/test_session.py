import pytest

from tremorgrid import session


class FakeContext:
    master, checkpoint = "spark://host:7077", None

    def getCheckpointDir(self):
        return self.checkpoint


class FakeSession:
    def __init__(self, configured=None, master="spark://host:7077"):
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.conf = type("Conf", (), {"get": lambda _, key, default=None, values=self.conf: values.get(key, default)})()
        self.sparkContext = FakeContext()
        self.sparkContext.master = master


def test_the_folder_the_cluster_names_is_used():
    assert session.shared_dir(FakeSession("hdfs://shared/folder/")) == "hdfs://shared/folder"


def test_a_cluster_without_the_setting_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession())


def test_intermediate_tables_are_stored_in_one_folder_per_application(spark):
    path = session.cut(spark.range(3)).inputFiles()[0]
    assert f"tremorgrid-{spark.sparkContext.applicationId}/table-" in path


def test_release_deletes_tables_and_scratch_folders(spark, monkeypatch):
    from tremorgrid.plans import fixtures

    monkeypatch.setattr(session, "own_dir", lambda spark, own=session.own_dir(spark): f"{own}-released")
    monkeypatch.setattr(fixtures, "own_dir", session.own_dir)
    table, path = session.cut(spark.range(3)), fixtures.scratch(spark)
    spark.range(2).write.parquet(path)
    assert table.count() == 3 and spark.read.parquet(path).count() == 2
    session.release(spark)
    for gone in (table.inputFiles()[0], path):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(gone)


def test_discarded_tables_are_gone_and_others_stay(spark):
    before = session.tables(spark)
    one, two = session.cut(spark.range(3)), session.cut(spark.range(4))
    first, second = session.tables(spark)[len(before):]
    session.discard(spark, [first, "/nowhere/else"])
    assert session.tables(spark) == [*before, second] and two.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(first)
    assert one.columns == ["id"]
