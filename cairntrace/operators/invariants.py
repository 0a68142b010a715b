"""What must hold of sets of jobs: of snapshots of a cluster, and of its whole course."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairntrace.operators.coerce import SNAPSHOT_SCHEMA
from cairntrace.operators.ordered import running, running_sums, slice_by_range, slice_by_time
from cairntrace.schema import id_order, require


def snapshot_violations(documents: DataFrame, snapshot: str = "clock_ts") -> DataFrame:
    """Broken checks of snapshot documents (JSON text `value`): (snapshot, violation, job_id), a row per broken check and, where it
    is about a job, per job.

    Free CPUs lie between none and the capacity, and running and free ones make up the capacity; no job is queued and
    running, nor queued before it was submitted.  A snapshot's jobs are summed up by (snapshot, job) before they meet: one of any
    number of jobs is spread over tasks.
    """
    parsed = documents.select(F.from_json("value", SNAPSHOT_SCHEMA).alias("s")).select("s.*")
    free, capacity = F.col("free_cpus"), F.col("capacity_cpus")

    def entries(jobs: str, queued: bool) -> Column:
        none = F.lit(None).cast("bigint")
        return F.transform(
            F.coalesce(F.col(jobs), F.array()),
            lambda j: F.struct(
                j["job_id"].alias("job_id"),
                F.lit(int(queued)).alias("queued"),
                (none if queued else j["allocated_cpus"]).alias("cpus"),
                (j["submit_ts"] if queued else none).alias("submit_ts"),
            ),
        )

    both = F.concat(entries("queued_jobs", True), entries("running_jobs", False))
    rows = parsed.select(snapshot, "clock_ts", F.inline(both))
    per_job = rows.groupBy(snapshot, "job_id").agg(
        F.max("queued").alias("queued"),
        (1 - F.min("queued")).alias("running"),
        F.sum("cpus").alias("cpus"),
        F.max(F.col("submit_ts") > F.col("clock_ts")).alias("early"),
    )
    used = per_job.groupBy(snapshot).agg(F.sum("cpus").alias("cpus"))
    whole = parsed.select(snapshot, "capacity_cpus", "free_cpus").join(used, snapshot, "left")
    checks = {
        "free_cpus_negative": free < 0,
        "free_cpus_exceeds_capacity": free > capacity,
        "cpu_conservation_broken": F.coalesce("cpus", F.lit(0)) + free != capacity,
    }
    of_snapshots = whole.select(snapshot, _failed(checks), F.lit(None).cast("bigint").alias("job_id"))
    of_jobs = per_job.select(
        snapshot,
        _failed(
            {
                "job_exists_in_queue_and_running": (F.col("queued") == 1) & (F.col("running") == 1),
                "queued_job_submit_in_future": F.col("early"),
            }
        ),
        "job_id",
    )
    return of_snapshots.unionByName(of_jobs)


def _failed(checks: dict[str, Column]) -> Column:
    names = F.array(*[F.when(failed, F.lit(name)) for name, failed in checks.items()])
    return F.explode(F.filter(names, lambda x: x.isNotNull())).alias("violation")


def queued_while_running(jobs: DataFrame) -> DataFrame:
    """Stretches (job_id, from_ts, to_ts) in which one row of a job waits while another one runs.

    A sweep per job over its rows' waits [submit, start) and runs [start, end): at each of its seconds the running
    numbers of both.  A job of any number of rows spans as many slices as its size asks for.
    """
    require(jobs, {"job_id", "submit_ts", "start_ts", "end_ts"}, "queued while running")

    def edge(ts: str, waits: int, runs: int) -> Column:
        return F.struct(
            F.col(ts).alias("ts"), F.lit(waits).cast("bigint").alias("waits"), F.lit(runs).cast("bigint").alias("runs")
        )

    edges = jobs.filter((F.col("submit_ts") <= F.col("start_ts")) & (F.col("start_ts") <= F.col("end_ts"))).select(
        "job_id", F.inline(F.array(edge("submit_ts", 1, 0), edge("start_ts", -1, 1), edge("end_ts", 0, -1)))
    )
    moves = edges.groupBy("job_id", "ts").agg(F.sum("waits").alias("waits"), F.sum("runs").alias("runs"))
    order = [F.col("ts")]
    sliced = slice_by_range(moves, [*id_order(jobs), *order])
    state = running_sums(sliced, order, {"waiting": F.col("waits"), "running": F.col("runs")}, ["job_id"])
    both = (F.col("waiting") > 0) & (F.col("running") > 0)
    # the edge before tells what held up to this one
    told = F.when(both, F.col("ts")).otherwise(F.lit(-1))
    out = running(state, order, ["job_id"], previous={"since": told})
    return out.filter(F.col("since") >= 0).select("job_id", F.col("since").alias("from_ts"), F.col("ts").alias("to_ts"))


def conservation(jobs: DataFrame, capacity_cpus: int, reported: DataFrame) -> DataFrame:
    """Seconds (ts, running_cpus, free_cpus, violation) at which reported free CPUs don't fit the jobs that run.

    `reported` (ts, free_cpus) is held against a sweep over the jobs' starts and ends: the running CPUs after a second's
    ends and starts, and the free ones, must make up the capacity, and neither may be negative.
    """
    require(jobs, {"start_ts", "end_ts", "requested_cpus"}, "conservation")
    cpus = F.col("requested_cpus").cast("bigint")
    edges = jobs.select(
        F.inline(F.array(F.struct(F.col("start_ts").alias("ts"), cpus.alias("d")), F.struct(F.col("end_ts").alias("ts"), (-cpus).alias("d"))))
    )
    none = F.lit(None).cast("bigint")
    steps = edges.groupBy("ts").agg(F.sum("d").alias("d")).select("ts", "d", none.alias("free"), F.lit(0).alias("probe"))
    probes = reported.groupBy("ts").agg(F.last("free_cpus").cast("bigint").alias("free"))
    probes = probes.select("ts", F.lit(0).cast("bigint").alias("d"), "free", F.lit(1).alias("probe"))
    sliced = slice_by_time(steps.unionByName(probes))
    swept = running_sums(sliced, [F.col("ts"), F.col("probe")], {"running_cpus": F.col("d")}).filter("probe = 1")
    checks = {
        "free_cpus_negative": F.col("free") < 0,
        "free_cpus_exceeds_capacity": F.col("free") > capacity_cpus,
        "cpu_conservation_broken": F.col("running_cpus") + F.col("free") != capacity_cpus,
    }
    return swept.select("ts", "running_cpus", F.col("free").alias("free_cpus"), _failed(checks))
