"""Jobs over stored tables, from input files to exported rows."""

from pyspark.sql import functions as F

from trustlens import __main__ as cli
from trustlens.sources.samples import AS_OF_TEXT, SampleTables


def test_score_rescore_export(spark, tmp_path, capsys):
    t = SampleTables(spark, "/root/testdata/sf0.001")
    root, results = str(tmp_path / "tables"), str(tmp_path / "results")
    t.posts_with_text.write.parquet(f"{root}/posts")
    t.channels.write.parquet(f"{root}/channels")
    t.audience.write.parquet(f"{root}/audience")
    cli.main(["score", "--tables", root, "--out", results, "--as-of", AS_OF_TEXT])
    stored = spark.read.parquet(results)
    assert stored.count() == t.channels.count()
    assert stored.where(F.size("ad_links") > 0).count() > 0

    cli.main(["rescore", "--results", results, "--out", str(tmp_path / "rescored")])
    again = spark.read.parquet(str(tmp_path / "rescored"))
    assert again.count() == stored.count() and again.where("new_score < 0 OR new_score > 100").count() == 0

    cli.main(["export", "--results", results, "--out", str(tmp_path / "csv"), "--status", "BAD"])
    exported = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert exported.count() == stored.where("status = 'BAD'").count() and exported.first()["username"].startswith("@")

    cli.main(["discover", "--tables", root, "--results", results, "--out", str(tmp_path / "new")])
    assert spark.read.parquet(str(tmp_path / "new")).columns == ["username", "found_via"]
    cli.main(["summary", "--results", results])
    assert "total" in capsys.readouterr().out
