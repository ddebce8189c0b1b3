from ledgerloom.streaming import results


def test_stream_equals_batch(spark, tiny, tmp_path):
    table = spark.read.parquet(f"{tiny}/extraction_results.parquet")
    table.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = results.review_rate(results.read_results(spark, str(tmp_path / "in"), 1), late="4000 days")
    query = stream.writeStream.format("memory").queryName("rates").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    last = {}
    for r in spark.table("rates").collect():
        last[r.since, r.doc_type] = max(last.get((r.since, r.doc_type), (0, 0)), (r.n_pages, r.n_review))
    batch = {(r.since, r.doc_type): (r.n_pages, r.n_review) for r in results.review_rate(table).collect()}
    assert last == batch and batch


def test_write_rates(spark, tiny, tmp_path):
    spark.read.parquet(f"{tiny}/extraction_results.parquet").write.parquet(str(tmp_path / "in"))
    stream = results.review_rate(results.read_results(spark, str(tmp_path / "in")), late="1 day")
    query = results.write_rates(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(180)
    assert query.exception() is None
