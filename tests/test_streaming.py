from lamella.plans.batch import Parameters
from lamella.streaming.watch import arrivals


def test_new_files_are_planned_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.svs").write_bytes(b"x")
    (src / "skip.txt").write_bytes(b"x")

    def run():
        q = arrivals(spark, Parameters(str(src), "/out")).writeStream.format("parquet").option("path", str(tmp_path / "plan")).option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted((r.dest, r.reader, r.length) for r in spark.read.parquet(str(tmp_path / "plan")).collect())

    assert run() == [("/out/a.tif", "svs", 1)]
    (src / "b.VSI").write_bytes(b"yy")
    assert run() == [("/out/a.tif", "svs", 1), ("/out/b.tif", "vsi", 2)]


def test_sub_folders_stay(spark, tmp_path):
    src = tmp_path / "in"
    for folder in ("a", "b/c"):
        (src / folder).mkdir(parents=True)
        (src / folder / "x.svs").write_bytes(b"x")
    q = arrivals(spark, Parameters(f"file://{src}/", "/out")).writeStream.format("parquet").option("path", str(tmp_path / "plan")).option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.dest for r in spark.read.parquet(str(tmp_path / "plan")).collect()) == ["/out/a/x.tif", "/out/b/c/x.tif"]
