"""What a function's tasks and their executors need, as a profile of their stage."""

from __future__ import annotations

import logging
from typing import Any

from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import SparkSession

log = logging.getLogger("caseloom")
TASK, EXECUTOR = ("cpus", "gpus"), ("cores", "memory", "overhead")


def is_supported(spark: SparkSession) -> bool:
    """Whether the master can give a stage its own profile: all but a local one can."""
    master = spark.sparkContext.master
    return not (master == "local" or master.startswith("local["))


def stage_profile(spark: SparkSession, wanted: dict[str, Any]) -> ResourceProfile | None:
    """The profile, or None where nothing is wanted or the master has no stage-level scheduling; the jobs' local properties are then all there is.

    Executors can be asked for only where they come and go: without dynamic allocation their part is left out, and so is what
    a task needs of GPUs that the executors were not started with, as Spark refuses such a stage.
    """
    wanted = {k: v for k, v in wanted.items() if k in (*TASK, *EXECUTOR)}
    if not wanted:
        return None
    if not is_supported(spark):
        log.warning("%s has no stage-level scheduling; %s are only properties of the jobs", spark.sparkContext.master, sorted(wanted))
        return None
    builder, tasks, executors = ResourceProfileBuilder(), TaskResourceRequests(), ExecutorResourceRequests()
    dynamic = spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true"
    there = float(spark.conf.get("spark.executor.resource.gpu.amount", "0"))
    if not dynamic and wanted.get("gpus") and float(wanted["gpus"]) > there:
        log.warning("executors have %g GPUs and not %s; 'gpus' is only a property of the jobs", there, wanted.pop("gpus"))
    if "cpus" in wanted:
        tasks = tasks.cpus(int(wanted["cpus"]))
    if "gpus" in wanted:
        tasks = tasks.resource("gpu", float(wanted["gpus"]))
        executors = executors.resource("gpu", max(1, int(wanted["gpus"])))
    for key, ask in (("cores", executors.cores), ("memory", executors.memory), ("overhead", executors.memoryOverhead)):
        if key in wanted and dynamic:
            ask(wanted[key])
        elif key in wanted:
            log.warning("%r needs dynamic allocation and is left out", key)
    if any(k in wanted for k in TASK):
        builder.require(tasks)
    elif not dynamic:
        return None
    return (builder.require(executors) if dynamic else builder).build
