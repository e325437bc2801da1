import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.errors import CasMismatch, Conflict
from brindle.operators import fts, kv, replication
from brindle.sources import changelog
from brindle.streaming import changes

CLOCK = kv.Clock(dt.datetime(2024, 1, 1), 1)


@pytest.fixture(scope="module")
def state(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", '"x"'), ("c", "3")], "k string, v string")
    return kv.documents(rows, CLOCK, F.col("k"), F.col("v"))


def values(df):
    return {r["key"]: r["value"] for r in kv.live(df, CLOCK.time).collect()}


def batch(spark, *rows):
    return spark.createDataFrame([(*r, None)[:2] for r in rows], "key string, value string")


def test_key_value(spark, state):
    assert values(kv.upsert(state, batch(spark, ("a", "9"), ("d", "4")), CLOCK)) == {"a": "9", "b": '"x"', "c": "3", "d": "4"}
    with pytest.raises(Conflict):
        kv.insert(state, batch(spark, ("a", "0")), CLOCK)
    with pytest.raises(CasMismatch):
        kv.delete(state, spark.createDataFrame([("a", 999)], "key string, cas bigint"), CLOCK)
    assert "a" not in values(kv.delete(state, batch(spark, ("a",)), CLOCK))
    assert values(kv.counter(state, batch(spark, ("a",), ("n",)), -5, CLOCK, initial=7)) == {"a": "0", "b": '"x"', "c": "3", "n": "7"}
    assert values(kv.append(state, batch(spark, ("b",), ("c",)), 'y"', CLOCK))["b"] == '"xy\\""'
    gone = kv.touch(state, batch(spark, ("a",)), F.lit(dt.datetime(2023, 1, 1)).cast("timestamp"), CLOCK)
    assert set(values(gone)) == {"b", "c"}
    assert kv.purge_expired(gone, CLOCK).filter("deleted").count() == 1
    assert state.select(kv.vbucket(F.lit("test-key"))).first()[0] == 889


def test_evict(spark):
    df = spark.range(100).select("id", F.lit(10).alias("bytes"))
    assert {r["id"] for r in kv.evict(df, 95, [F.col("id")]).collect()} == set(range(10))


def test_conflicts(spark):
    side = lambda *rows: spark.createDataFrame(rows, "key string, rev_id int, cas int, updated_at int, v string")
    local, remote = side(("x", 1, 1, 10, "l"), ("t", 1, 1, 1, "l")), side(("x", 2, 2, 0, "r"), ("t", 1, 1, 1, "r"), ("new", 1, 1, 1, "r"))
    assert {r["key"]: r["v"] for r in replication.resolve(local, remote, "sequence").collect()} == {"x": "r", "t": "l", "new": "r"}
    assert {r["key"]: r["v"] for r in replication.resolve(local, remote, "timestamp").collect()} == {"x": "l", "t": "l", "new": "r"}
    assert replication.statistics(local, remote).first().asDict() == {"accepted": 2, "rejected": 1, "conflicts": 2}


def test_change_log(spark, tmp_path):
    rows = [("set", "b", "k1", "1", 1, 1, 1, 0, False, 0), ("set", "b", "k2", "2", 2, 2, 1, 0, False, 0), ("set", "b", "k1", "3", 3, 3, 2, 0, False, 0), ("del", "b", "k2", None, 4, 4, 2, 0, True, 0)]
    path = str(tmp_path / "log")
    changelog.append(spark.createDataFrame(rows, changelog.LOG), path)
    assert changelog.read(spark, path, strict=True).count() == 4
    assert [(r["key"], r["value"]) for r in changelog.compact(changelog.read(spark, path)).collect()] == [("k1", "3")]
    changelog.truncate(spark, path)
    assert changelog.read(spark, path).count() == 0


def test_streams(spark, state, tmp_path):
    path, seen = str(tmp_path / "changes"), []
    take = lambda df, _: seen.extend(r["key"] for r in df.collect())
    changes.publish(changes.events_of(state, "b"), path)
    events = changes.stream(spark, path, bucket="b")
    changes.poll(events, str(tmp_path / "cursor"), take)
    assert sorted(seen) == ["a", "b", "c"]
    changes.publish(changes.events_of(kv.delete(state, batch(spark, ("a",)), kv.Clock(CLOCK.now, 1 << 41)), "b").filter("event_type = 'deletion'"), path)
    seen.clear()
    changes.poll(events, str(tmp_path / "cursor"), take)
    assert seen == ["a"]
    assert changes.latest(spark.read.parquet(path)).filter("event_type = 'deletion'").count() == 1


@pytest.fixture(scope="module")
def index(spark):
    rows = [("1", "The quick brown fox", 5), ("2", "A brown quick fox jumps", 7), ("3", "lazy dogs sleep-well", 9), ("4", None, 1)]
    return fts.Search(fts.build(spark.createDataFrame(rows, "id string, body string, n int"), "id", ["body"], numeric=("n",)))


def keys(df):
    return {r["key"] for r in df.collect()}


def test_search(index):
    assert keys(index.run({"type": "match", "field": "body", "text": "fox sleep-well"})) == {"1", "2", "3"}
    assert keys(index.run({"type": "match", "field": "body", "text": "quick jumps", "operator": "and"})) == {"2"}
    assert keys(index.run({"type": "match_phrase", "field": "body", "text": "quick brown"})) == {"1"}
    assert keys(index.run({"type": "match", "text": "brwn", "fuzziness": 1})) == {"1", "2"}
    assert keys(index.run({"type": "wildcard", "field": "body", "pattern": "d?g*"})) == {"3"}
    assert keys(index.run({"type": "numeric_range", "field": "n", "min": 5, "max": 7})) == {"1", "2"}
    assert keys(index.run({"type": "bool", "must": [{"type": "term", "field": "body", "term": "fox"}], "must_not": [{"type": "term", "field": "body", "term": "jumps"}]})) == {"1"}
    assert keys(index.run({"type": "bool", "must_not": [{"type": "match_all"}]})) == set()
    assert keys(index.run({"type": "match", "field": "body", "text": "the"})) == set()
    top = index.top({"query": {"type": "match", "field": "body", "text": "fox"}, "size": 1, "highlight": True}).collect()
    assert len(top) == 1 and "<mark>fox</mark>" in top[0]["fragments"][0]
