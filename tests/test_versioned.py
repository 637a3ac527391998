"""Steps that count whole or not at all; a stream into a keyed table; a cache that expires."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from regolith.operators import store, versioned
from regolith.streaming import tables

SCHEMA = "source_id string, rec_no int, ai_summary string"


def rows(spark, *items):
    return spark.createDataFrame(list(items), SCHEMA)


def asked(log):
    def enrich(d):
        log.append(sorted(r.source_id for r in d.collect()))
        return d.select("source_id", F.concat(F.lit("about "), "source_id").alias("ai_summary"))

    return enrich


def content(table):
    return sorted((r.source_id, r.rec_no, r.ai_summary) for r in table.read().collect())


def test_steps_change_touched_buckets_alone(spark, tmp_path):
    table = versioned.KeyedTable(spark, str(tmp_path), SCHEMA, "source_id", buckets=8)
    assert table.read().count() == 0
    log = []
    first = rows(spark, *[(f"k{i}", i, "" if i % 2 else f"s{i}") for i in range(20)], ("k3", 99, "later"))
    assert tables.apply_batch(table, first, "a", "ai_summary", asked(log)) == 1
    before = table.manifest.parts(1)
    assert content(table) == sorted((f"k{i}", i, f"about k{i}" if i % 2 else f"s{i}") for i in range(20))
    assert log == [sorted(f"k{i}" for i in range(1, 20, 2))]
    assert tables.apply_batch(table, rows(spark, ("new", 1, None), ("k4", 7, "other")), "b", "ai_summary", asked(log)) == 2
    after = table.manifest.parts(2)
    touched = {str(r.b) for r in rows(spark, ("new", 1, ""), ("k4", 1, "")).select(table.bucket().alias("b")).collect()}
    assert {k for k in after if after[k] != before.get(k)} == touched and log[1] == ["new"]
    assert dict((k, s) for k, _, s in content(table))["new"] == "about new" and len(content(table)) == 21
    assert table.read(1).count() == 20


def test_a_step_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = versioned.KeyedTable(spark, str(tmp_path), SCHEMA, "source_id", buckets=4)
    tables.apply_batch(table, rows(spark, ("a", 1, "x"), ("b", 2, "")), "one", "ai_summary", asked([]))
    old, more = content(table), rows(spark, ("c", 3, ""), ("a", 4, "y"))

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(table.manifest, "commit", die)
        with pytest.raises(RuntimeError):
            tables.apply_batch(table, more, "two", "ai_summary", asked([]))
    assert content(table) == old
    assert tables.apply_batch(table, more, "two", "ai_summary", asked([])) == 2
    want = content(table)
    log = []
    assert tables.apply_batch(table, more, "two", "ai_summary", asked(log)) == 2
    assert content(table) == want == [("a", 1, "x"), ("b", 2, "about b"), ("c", 3, "about c")] and log == []


def test_a_step_may_empty_buckets(spark, tmp_path):
    table = versioned.KeyedTable(spark, str(tmp_path), SCHEMA, "source_id", buckets=2)
    table.step("in", rows(spark, ("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")), lambda old, new: new)
    table.step("out", rows(spark, ("a", 1, "")), lambda old, new: old.join(new.select("source_id"), "source_id", "left_anti"))
    assert [x[0] for x in content(table)] == ["b", "c"]
    table.step("rest", rows(spark, ("b", 1, ""), ("c", 1, "")), lambda old, new: old.where("false"))
    assert content(table) == []


def test_stream_runs_again_from_another_checkpoint(spark, tmp_path):
    src = str(tmp_path / "in")
    rows(spark, *[(f"k{i % 30}", i, "" if i % 3 else "known") for i in range(90)]).repartition(3, "rec_no").write.parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    table = versioned.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "source_id", buckets=8)
    enrich = lambda d: d.select("source_id", F.lit("told").alias("ai_summary"))
    tables.ingest_enriched(stream, table, "ai_summary", enrich, str(tmp_path / "c1")).awaitTermination()
    got, version = content(table), table.manifest.last()
    assert len(got) == 30 and {x[2] for x in got} == {"told", "known"} and version == 3
    tables.ingest_enriched(stream, table, "ai_summary", enrich, str(tmp_path / "c2")).awaitTermination()
    assert content(table) == got and table.manifest.last() == version


def test_feedback_forms_appear_together(spark, tmp_path):
    log = versioned.FeedbackLog(spark, str(tmp_path))
    schema = "source_id string, rating string"
    data = spark.createDataFrame([("a", "correct"), ("b", "incorrect")], schema)
    log.feedback("1", data)
    bad = data.select("source_id", F.expr("if(source_id = 'b', raise_error('lost'), rating)").alias("rating"))

    def half(path):
        data.write.parquet(path)

    with pytest.raises(Exception, match="lost"):
        log.append("2", {"table": half, "mirror": bad.write.json})
    assert log.table(schema).count() == log.mirror(schema).count() == 2
    log.feedback("2", data)
    log.feedback("2", data)
    assert sorted(map(tuple, log.table(schema).collect())) == sorted(map(tuple, log.mirror(schema).collect())) and log.table(schema).count() == 4
    counts = store.accuracy(log.table(schema))
    for step in ("x", "y", "y"):
        log.accuracy(step, counts, "2024-01-31")
    assert [(r.total, r.pct) for r in log.figures().collect()] == [(4, 50.0)] * 2
    assert versioned.FeedbackLog(spark, str(tmp_path / "none")).figures().count() == 0


def test_citation_store_and_page(spark, tmp_path):
    out = versioned.CitationStore(spark, str(tmp_path))
    assert out.newest("page") is None
    data = spark.createDataFrame([("a", "TGA", "2024-01-02", "</script>"), ("b", "FDA", None, "é"), ("c", "FDA", "2024-01-03", "x")], "id string, authority string, date string, summary string")
    out.publish("1", data, "<script>const D = @DATA@;</script>", "@DATA@", most=2)
    (page,) = spark.read.text(out.newest("page")).collect()
    assert page.value.count("</script>") == 1 and '"id":"c"' in page.value and '"id":"b"' not in page.value
    assert spark.read.json(out.newest("partitioned")).count() == spark.read.json(out.newest("flat")).count() == 3


def test_cache_expires_with_the_watermark(spark, tmp_path):
    src = tmp_path / "in"
    plan = [[("a", 1), ("b", 3), ("a", 2)], [("c", 20), ("b", 25)], [("d", 33)], [("a", 40), ("e", 2)], [("f", 56)]]
    for i, part in enumerate(plan):
        spark.createDataFrame([(k, d) for k, d in part], "key string, d int").selectExpr("key", "timestamp_seconds(1704067200 + d * 86400L) as cached_at").coalesce(1).write.parquet(str(src / f"p{i}"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    stream = spark.readStream.schema("key string, cached_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(src / "p*"))
    q = tables.cache_events(stream).writeStream.format("memory").queryName("cache_events").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("select key, event, datediff(cached_at, '2024-01-01') as d from cache_events").collect()
    live = {}
    for r in got:
        if r.event == "cached":
            live[r.key] = max(r.d, live.get(r.key, -1))
    gone = {(r.key, r.d) for r in got if r.event == "expired"}
    newest = spark.createDataFrame([(k, v) for k, v in live.items()], "key string, d int").selectExpr("key", "d", "timestamp_seconds(1704067200 + d * 86400L) as cached_at")
    fresh = {(r.key, r.d) for r in store.fresh_cache(newest, "2024-02-26 00:00:00").collect()}
    assert gone == {("b", 25), ("c", 20)} and {(k, d) for k, d in live.items() if (k, d) not in gone} == fresh


def test_age_counts_parts_of_a_second(spark):
    rows = spark.sql("select * from values (1, timestamp_ntz'2024-01-21 00:00:00'), (2, timestamp_ntz'2024-01-21 00:00:00.5'), (3, timestamp_ntz'2024-01-20 23:59:59.9'), (4, null) as t(i, cached_at)")
    assert [r.i for r in store.fresh_cache(rows, "2024-01-31 00:00:00", 10).collect()] == [2]
