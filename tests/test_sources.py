"""Parsers on literal log text."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from cairntrace.functions import scalars as sc
from cairntrace.sources import live, pbs, replay, sacct, swf, tables
from cairntrace.streaming import increments

SWF = [
    "; Version: 2",
    "1 0 5 100 4 -1 -1 4 200 -1 1 7 2 -1 1 1 -1 -1",
    "",
    "2 10 -1 50 8 -1 -1 8 100 512 1 7 2 -1 1 1 -1 -1",
    "3 20 0 -4 2 -1 -1 -1 -1 -1 5 8 2 -1 1 1 -1 -1",
    "4 30 3 60 2 -1 -1 2 90 -1 0 8 2 -1 1 1 -1 -1",
    "bad line",
]


def lines(spark, text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def values(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def test_swf(spark, tmp_path):
    jobs = {r.job_id: r for r in swf.parse(lines(spark, SWF)).collect()}
    assert sorted(jobs) == ["1", "3", "4"]  # job 2 has no wait time
    assert jobs["1"].start_ts == 5 and jobs["1"].end_ts == 105 and jobs["1"].runtime_overrequest_ratio == 2.0
    assert jobs["3"].runtime_actual_sec == 0 and jobs["3"].requested_cpus == 2
    assert jobs["3"].runtime_requested_sec is None and jobs["3"].runtime_overrequest_ratio is None
    stats = swf.parse_stats(lines(spark, SWF)).first().asDict()
    assert stats == {"total_lines": 7, "comment_lines": 1, "blank_lines": 1, "malformed_lines": 2, "parsed_rows": 3}
    assert swf.line_stats(lines(spark, SWF)).first().parsed_rows == 4
    with gzip.open(tmp_path / "t.swf.gz", "wt") as f:
        f.write("\n".join(SWF))
    assert swf.read_swf(spark, str(tmp_path / "t.swf.gz"), partitions=3).count() == 3
    (tmp_path / "none.swf").write_text("; nothing\n")
    with pytest.raises(ValueError, match="no parsable"):
        swf.read_swf(spark, str(tmp_path / "none.swf"))


def test_swf_long_line_is_parsed(spark):
    long = SWF[1] + " " * 1_000_000
    # a long line is a line like any other
    assert swf.parse_stats(lines(spark, [long, SWF[1]])).first().parsed_rows == 2


HEADER = "JobID|Submit|Start|End|Elapsed|AllocCPUS|ReqCPUS|ReqMem|User|Group|Partition|State"
SACCT = [
    "100|2024-01-01T00:00:00|2024-01-01T00:01:00|2024-01-01T00:11:00|00:10:00|4|2|4Gn|ann|g|main|COMPLETED",
    "100.batch|2024-01-01T00:00:00|2024-01-01T00:01:00|2024-01-01T00:11:00|00:10:00|4|2|4Gn||||COMPLETED",
    "101_3|2024-01-01T00:00:00|Unknown|Unknown|1-00:00:01|8||0|bob|g|main|CANCELLED by 5",
    "102|Unknown|||00:01:00|1|1||bob|g|main|FAILED",
]


def test_sacct_headers_per_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join([HEADER, *SACCT]))
    turned = "user|JOBID|Submit|Elapsed|ReqCPUS"
    (tmp_path / "b.txt").write_text("\n".join([turned, "eve|200|2024-01-02 00:00|05:00|3"]))
    (tmp_path / "c.txt").write_text(SACCT[0].replace("100", "300", 1))
    jobs = {r.job_id: r for r in sacct.read_sacct(spark, str(tmp_path)).collect()}
    assert sorted(jobs) == ["100", "101_3", "200", "300"]
    assert jobs["100"].runtime_actual_sec == 600 and jobs["100"].wait_sec == 60 and jobs["100"].requested_mem == 4096
    late = jobs["101_3"]
    assert late.start_ts == late.submit_ts and late.end_ts - late.start_ts == 86401
    assert (late.requested_cpus, late.status, late.array_index, late.requested_mem) == (8, "CANCELLED", "3", None)
    assert jobs["200"].user_id == "eve" and jobs["200"].runtime_actual_sec == 300 and jobs["200"].requested_cpus == 3
    assert sacct.parse(lines(spark, SACCT), skip_job_steps=False).count() == 3
    stats = sacct.parse_stats(lines(spark, [HEADER, *SACCT])).first()
    assert (stats.header_lines, stats.step_lines_skipped, stats.malformed_lines, stats.parsed_rows) == (1, 1, 1, 2)


def test_pbs(spark):
    text = [
        "01/01/2024 00:11:00;E;55[2].srv;user=ann group=g queue=q ctime=1704067200 start=1704067260 end=1704067860 "
        "Resource_List.nodes=2:ppn=4 Resource_List.walltime=00:20:00 resources_used.walltime=00:10:00 Exit_status=0",
        "01/01/2024 00:00:00;Q;55.srv;queue=q",
        "01/01/2024 00:00:00;E;56.srv;user=bob",
        "nonsense",
        "# comment",
    ]
    jobs = {r.job_id: r for r in pbs.parse(lines(spark, text)).collect()}
    a, b = jobs["55_2"], jobs["56"]
    assert (a.requested_cpus, a.wait_sec, a.runtime_actual_sec, a.runtime_overrequest_ratio) == (8, 60, 600, 2.0)
    assert (b.submit_ts, b.start_ts, b.requested_cpus, b.status) == (1704067200, 1704067200, 1, None)
    stats = pbs.parse_stats(lines(spark, text)).first()
    assert (stats.blank_lines, stats.non_exit_records, stats.malformed_lines, stats.parsed_rows) == (1, 1, 1, 2)


def test_live_rows(spark):
    row = "123|n|ann|g|main|acct|COMPLETED|2024-01-01T00:00:00|2024-01-01T00:01:00|Unknown|01:00:00|02:00:00|4|1|4G||0:0"
    out = live.parse_sacct_extract(lines(spark, [row, row.replace("123", "123.batch"), row.replace("123", "124_1")]))
    (job,) = out.collect()
    assert (job.job_id, job.runtime_actual_sec, job.runtime_requested_sec, job.requested_cpus) == (123, 3600, 7200, 4)
    assert job.end_ts is None and live.live_to_canonical(out).first().end_ts == 0
    doc = {
        "Jobs": {
            "123.srv": {
                "Job_Name": "n", "Job_Owner": "alice@host", "queue": "q", "job_state": "F",
                "Resource_List": {"ncpus": 8, "walltime": "01:00:00", "select": "2:ncpus=4"},
                "resources_used": {"walltime": "00:30:00"}, "ctime": "Mon Jan  1 10:00:00 2024", "Exit_status": 0,
            }
        }
    }
    (job,) = live.parse_qstat_json(lines(spark, [json.dumps(doc), "{not json"])).collect()
    assert (job.job_id, job.user, job.requested_cpus, job.requested_nodes) == ("123", "alice", 8, 2)
    assert (job.runtime_requested_sec, job.runtime_actual_sec, job.submit_ts) == (3600, 1800, 1704103200)


def test_replay(spark, tmp_path):
    (tmp_path / "jobs.csv").write_text(
        "job_id,submission_time,starting_time,finish_time,execution_time,requested_number_of_resources,requested_time\n"
        "w0!1,0.0,2.5,12.0,9.5,4,-1\nw0!2,1.0,3.0,,7.0,0,60\n"
    )
    work = {"jobs": [{"id": "1", "extra_data": json.dumps({"user_id": 7})}, {"id": "2", "extra_data": "{broken"}]}
    (tmp_path / "w.json").write_text(json.dumps(work))
    out = {r.job_id: r for r in replay.read_replay_csv(spark, str(tmp_path / "jobs.csv"), str(tmp_path / "w.json")).collect()}
    assert (out["1"].end_ts, out["1"].runtime_requested_sec, out["1"].user_id) == (12, None, "7")
    assert (out["2"].end_ts, out["2"].requested_cpus, out["2"].user_id) == (10, 1, None)
    with pytest.raises(ValueError, match="execution_time"):
        replay.import_replay(spark.createDataFrame([("1",)], "job_id string"))


def test_scalar_formats(spark):
    assert values(spark, sc.elapsed_sec, ["1-02:03:04", "05:06", "9", "x", "", "Unknown", "1:2:3:4"]) == [
        93784, 306, 9, None, None, None, None,
    ]
    assert values(spark, sc.slurm_memory_mb, ["4000Mc", "8Gn", "2048K", "1T", "77", "0", "n/a", "x"]) == [
        4000, 8192, 2, 1048576, 77, None, None, None,
    ]
    assert values(spark, sc.pbs_memory_mb, ["1234kb", "4gb", "2tb", "1048576b", "5mb", "2048"]) == [1, 4096, 2097152, 1, 5, 2]
    assert values(spark, sc.nodes_spec_cpus, ["2:ppn=4+1:ppn=8", "1", "nodes=1:ppn=4", "", "big:ppn=2"]) == [16, 1, 4, None, 2]
    assert values(spark, sc.pbs_timestamp, ["1700000000", "01/02/2024 03:04:05", "2024-01-02 03:04:05", "0", "x"]) == [
        1700000000, 1704164645, 1704164645, None, None,
    ]
    assert values(spark, sc.slurm_datetime, ["2024-01-02T03:04", "2024-01-02 03:04:05", "N/A"]) == [1704164640, 1704164645, None]
    ids = values(spark, sc.slurm_job_id, ["12", "12_3", "12.batch", "12_3.0", "odd"])
    assert [tuple(i) for i in ids] == [
        ("12", None, False), ("12_3", "3", False), ("12", None, True), ("12_3", "3", True), ("odd", None, False),
    ]
    assert values(spark, sc.slurm_state, ["cancelled by 5", " ", "RUNNING"]) == ["CANCELLED", "UNKNOWN", "RUNNING"]


def test_session_time_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert values(spark, sc.slurm_datetime, ["1970-01-01T00:00:10"]) == [10]
        assert values(spark, lambda c: sc.hour_of_day(c.cast("bigint")), ["7200"]) == [2]
        assert values(spark, lambda c: sc.day_of_week(c.cast("bigint")), ["0"]) == [3]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_tables_round_trip(spark, tmp_path):
    jobs = swf.parse(lines(spark, SWF))
    tables.write_jobs(jobs, str(tmp_path / "t"), "one")
    tables.write_jobs(jobs.limit(1), str(tmp_path / "t"), "two")
    assert tables.load_jobs(spark, str(tmp_path / "t"), "one").count() == 3
    assert tables.load_jobs(spark, str(tmp_path / "t")).count() == 4
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\n{broken\n{"a": 2}\n')
    assert sorted(r.a for r in tables.load_jsonl(spark, str(tmp_path / "log.jsonl"), "a int").collect()) == [1, 2]


def test_polling_keeps_a_watermark(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    (tmp_path / "src").write_text("\n".join(SWF))
    first = increments.ingest_increment(spark, "swf", source, out, state)
    assert (first["new_rows"], first["last_submit_ts"], first["poll_count"]) == (3, 30, 1)
    (tmp_path / "src").write_text("\n".join([*SWF, SWF[1].replace("1 0 5", "9 99 5", 1)]))
    second = increments.ingest_increment(spark, "swf", source, out, state)
    assert (second["new_rows"], second["last_submit_ts"], second["total_rows"]) == (1, 99, 4)
    third = increments.ingest_increment(spark, "swf", source, out, state)
    assert (third["new_rows"], third["last_submit_ts"]) == (0, 99)
    (tmp_path / "bad").write_text("not json")
    assert increments.read_state(spark, str(tmp_path / "bad"))["poll_count"] == 0
    with pytest.raises(ValueError, match="unsupported source"):
        increments.ingest_increment(spark, "lsf", source, out, state)


def test_sacct_header_holds_from_its_line_on(spark, tmp_path):
    turned = "user|JOBID|Submit|Elapsed|ReqCPUS"
    text = [SACCT[0], turned, "eve|200|2024-01-02 00:00|05:00|3", turned, "eve|201|2024-01-02 00:01|05:00|3"]
    (tmp_path / "a.txt").write_text("\n".join(text))
    (tmp_path / "b.txt").write_text(SACCT[0].replace("100", "300", 1))
    jobs = {r.job_id: r for r in sacct.read_sacct(spark, str(tmp_path)).collect()}
    assert sorted(jobs) == ["100", "200", "201", "300"]
    assert jobs["100"].user_id == "ann" and jobs["201"].user_id == "eve" and jobs["300"].user_id == "ann"
    stats = sacct.parse_stats(sacct.headed_lines(spark, str(tmp_path))).first()
    # the second header of a file is no header any more
    assert (stats.header_lines, stats.malformed_lines, stats.parsed_rows) == (1, 1, 4)


def test_sacct_poll_reads_headers(spark, tmp_path):
    source = tmp_path / "dump.txt"
    source.write_text("user|JobID|Submit|Elapsed|ReqCPUS\neve|200|2024-01-02 00:00|05:00|3")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    assert increments.ingest_increment(spark, "slurm", str(source), out, state)["new_rows"] == 1
    assert increments.ingest_increment(spark, "slurm", str(source), out, state)["new_rows"] == 0


def test_attributes_are_the_last_ones_of_their_key(spark):
    """Any white space parts tokens; a token that only ends like a key is another one; the last value counts, if it is empty too."""
    from cairntrace.functions.scalars import attribute, spaced

    texts = {"a=1\ta=2": "2", "xa=3": None, "a=1 a=": None, " a=b=c\x0b": "b=c", "a=1 xa=2": "1", "": None, "a= a= a=7": "7", "b a =1": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.v for r in rows.select("t", attribute(spaced(F.col("t")), "a").alias("v")).collect()} == texts


def test_long_logs_are_rendered_in_more_tasks_than_cores(spark, monkeypatch):
    """Queue records too are dealt to tasks, and the number of tasks grows with the jobs."""
    from cairntrace.plans import fixtures as fx

    monkeypatch.setattr(fx, "SPREAD_ROWS", 10)
    cores = spark.sparkContext.defaultParallelism
    base = spark.range(cores * 100).coalesce(1)
    assert fx.spread(base).rdd.getNumPartitions() > 5 * cores
    assert fx.spread(base.filter("id % 10 = 0")).rdd.getNumPartitions() == cores + 1
