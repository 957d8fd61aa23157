from inkwell.streaming.ingest import ingest


def test_new_files_are_parsed_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("INT. A - DAY\n\nGo.")
    ingest(spark, source, out, mark).awaitTermination(60)
    assert spark.read.parquet(out).count() == 2
    (tmp_path / "in" / "b.txt").write_text("x\n\nJOHN\nHi.")
    ingest(spark, source, out, mark).awaitTermination(60)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 5 and len({r.script_id for r in rows}) == 2 and len({r.batch for r in rows}) == 2
