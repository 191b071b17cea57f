import pytest

from millrace import DataError, FilterRows, Table
from millrace.sources.dataset import scan
from millrace.sources.page_stream import RoundReader, Rounds, page_stream
from millrace.sources.pages import PagedSource
from millrace.streaming.files import run_new_files
from test_sources import FakeApi, page


def test_new_files_are_read_once_and_failed_batches_replace_themselves(spark, scratch):
    source, out, state = f"{scratch}/in", f"{scratch}/out", f"{scratch}/state"
    schema = spark.range(1).selectExpr("id", "id % 2 AS odd").schema
    attempts = []

    def arrive(start, stop):
        spark.range(start, stop).selectExpr("id", "id % 2 AS odd").coalesce(1).write.mode("append").parquet(source)

    def kept(table: Table) -> Table:
        return FilterRows("odd", "equals", 1)(table)

    def failing(table: Table) -> Table:
        # The first call only asks for the schema.
        attempts.append(1)
        if len(attempts) > 1:
            bad = table.df.selectExpr("id", "IF(id >= 15, raise_error('lost'), odd) AS odd")
            return Table(bad)
        return table

    def delivered():
        return sorted(r.id for r in scan(spark, out, batch="__batch").frame().collect())

    arrive(0, 10)
    run_new_files(spark, source, schema, out, state, kept)
    assert delivered() == [1, 3, 5, 7, 9]
    arrive(10, 20)
    with pytest.raises(Exception):
        run_new_files(spark, source, schema, out, state, failing)
    run_new_files(spark, source, schema, out, state, kept)
    run_new_files(spark, source, schema, out, state, kept)
    assert delivered() == list(range(1, 20, 2))


HOST = "https://api.example.org"


def marked(ids, mark, token=None):
    return page(ids, token, mark)


def source():
    return PagedSource(HOST, next_page_path="more.after", checkpoint_path="seen.upto", checkpoint_parameter="since")


def test_a_page_stream_goes_on_where_its_last_round_ended(spark, scratch):
    out, state, rounds = f"{scratch}/out", f"{scratch}/state", f"{scratch}/rounds"

    def run(bodies, endpoints, sink=None):
        api = FakeApi({f"{HOST}/{url}": body for url, body in bodies.items()})
        rows = page_stream(spark, source(), [(HOST, e) for e in endpoints], rounds, api, tasks=2)
        write = rows.writeStream.foreachBatch(sink) if sink else rows.writeStream.format("parquet")
        write = write.option("checkpointLocation", state).trigger(availableNow=True)
        query = write.start() if sink else write.start(out)
        query.awaitTermination()

    def delivered():
        return sorted((r.round, r.endpoint[-1], r.page, r.value) for r in spark.read.parquet(out).collect())

    first = {"a": marked([1], 1, "t"), "a?page=t": marked([2], 2), "b": marked([3], 3)}
    run(first, ["a", "b"])
    assert delivered() == [(1, "a", 0, "1"), (1, "a", 1, "2"), (1, "b", 0, "3")]
    # An endpoint that is new begins at its start, one that is left out is not asked.
    run({"a?since=2": marked([4], 4), "c": marked([5], 5)}, ["a", "c"])
    assert delivered()[3:] == [(2, "a", 0, "4"), (2, "c", 0, "5")]


def test_a_failed_batch_of_a_page_stream_delivers_the_same_pages_again(spark, scratch):
    state, rounds, seen = f"{scratch}/state", f"{scratch}/rounds", []

    def run(bodies, sink):
        api = FakeApi({f"{HOST}/{url}": body for url, body in bodies.items()})
        rows = page_stream(spark, source(), [f"{HOST}/a"], rounds, api)
        write = rows.writeStream.foreachBatch(sink).option("checkpointLocation", state)
        write.trigger(availableNow=True).start().awaitTermination()

    def failing(batch, number):
        batch.collect()
        raise OSError("lost")

    def keep(batch, number):
        seen.extend((r.round, r.value) for r in batch.collect())

    with pytest.raises(Exception):
        run({"a": marked([1], 1)}, failing)
    # The API has other pages by now; those of the round are the ones it read first.
    run({"a": marked([9], 9)}, keep)
    assert seen == [(1, "1")]
    run({"a?since=1": marked([2], 2)}, keep)
    assert seen == [(1, "1"), (2, "2")]


def test_rounds_are_planned_from_the_ends_of_the_round_before(scratch):
    api = FakeApi({f"{HOST}/a": marked([1], 1), f"{HOST}/b": marked([2], True)})
    reader = RoundReader(Rounds(source(), api, (f"{HOST}/a", f"{HOST}/b"), scratch, 8))
    start, first = reader.initialOffset(), reader.latestOffset()
    begin = {"pageToken": None, "value": None}
    assert first == {"round": 1, "from": {f"{HOST}/a": begin, f"{HOST}/b": begin}}
    assert reader.partitions(first, first) == []
    parts = reader.partitions(start, first)
    assert len(parts) == 2
    assert [b.num_rows for b in reader.read(parts[0])] == [1]
    assert reader.latestOffset() == first  # an endpoint is missing
    list(reader.read(parts[1]))
    second = reader.latestOffset()
    assert second["from"][f"{HOST}/b"] == {"pageToken": None, "value": "true"}
    # A query that lost its offsets gets all rounds still kept, and an error after that.
    assert [p.round for p in reader.partitions(start, second)] == [1, 1, 2, 2]
    reader.commit(second)
    with pytest.raises(DataError):
        reader.partitions(start, second)
