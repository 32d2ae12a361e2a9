"""Processes as they lived: intervals from exec and exit events, what a pid was at a time, and trees by birth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.operators import scan
from netlens.operators.enrich import descendants

c = F.col

_ID = "life"


def lifetimes(proc_events: DataFrame) -> DataFrame:
    """(life, pid, ppid, name, net_ns, start_ns, end_ns) from events (pid, ppid, kind exec or exit, name, net_ns, ts_ns): a process lives from
    an exec to the next event of its pid, be that its exit or another exec; end_ns is null while it lives.

    An exit at the time of an exec is of the process before. Of execs of a pid at one time the last by name counts. An exit of a
    process whose exec was not seen gives nothing. `life` tells lifetimes apart.
    """
    once = proc_events.where("pid is not null and ts_ns is not null").groupBy("pid", "ts_ns", "kind").agg(F.max(F.struct("name", "ppid", "net_ns")).alias("_p"))
    # a pid has no more events than it has processes: windows are small, however busy the processes were
    w = Window.partitionBy("pid").orderBy("ts_ns", (c("kind") == "exec").cast("int"))
    rows = once.withColumn("end_ns", F.lead("ts_ns").over(w)).where("kind = 'exec'")
    return rows.select(F.concat_ws("@", "pid", "ts_ns").alias(_ID), "pid", "_p.ppid", "_p.name", "_p.net_ns", c("ts_ns").alias("start_ns"), "end_ns")


def processes_at(records: DataFrame, lives: DataFrame, ts: str = "start_ns", pid: str = "pid", grace_ns: int = 0, how: str = "left") -> DataFrame:
    """records with life, process_name, process_start_ns and process_end_ns of the process that their pid was at that time; null (or gone, with
    how="inner") where there was none. For grace_ns after its end a process is still found, unless its pid has begun anew.

    Lifetimes of a pid do not overlap, so what counts is the last one that began by then: an as-of lookup over records and lifetimes together,
    whose work grows with their number, however often a pid is used. It runs in ranges of pid and time (scan.running), so a busy
    pid is many tasks.
    """
    at = [c(pid).cast("long").alias("_pid"), c(ts).cast("long").alias("_at")]
    spans = lives.where("pid is not null and start_ns is not null").select(c("pid").cast("long").alias("_pid"), c("start_ns").cast("long").alias("_at"), F.struct(_ID, "name", "start_ns", "end_ns").alias("_began"))
    rows = records.select("*", *at, F.lit(True).alias("_asks"))
    # records without a pid or a time meet nothing, and are no group to sort
    known = c("_pid").isNotNull() & c("_at").isNotNull()
    blocks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.where(known).unionByName(spans, allowMissingColumns=True)
    both = scan.running(both, ["_pid"], ["_at", F.coalesce("_asks", F.lit(False))], {"_life": ("last", c("_began"), True)}, blocks).where("_asks")
    there = c("_life.end_ns").isNull() | (c("_at") < c("_life.end_ns") + F.lit(grace_ns))
    both = both.withColumn("_life", F.when(there, c("_life")))
    if how == "inner":
        both = both.where("_life is not null")
    else:
        both = both.unionByName(rows.where(~known), allowMissingColumns=True)
    return both.select(*records.columns, c(f"_life.{_ID}").alias(_ID), c("_life.name").alias("process_name"), c("_life.start_ns").alias("process_start_ns"), c("_life.end_ns").alias("process_end_ns"))


def alive_at(lives: DataFrame, at_ns: int) -> DataFrame:
    return lives.where((c("start_ns") <= at_ns) & (c("end_ns").isNull() | (c("end_ns") > at_ns)))


def tree(lives: DataFrame, roots: Column) -> DataFrame:
    """(life) of the processes that `roots` holds for, and of all that descend from them: a process's parent is what its ppid was when it
    began, so a pid that was used again is no relative."""
    children = lives.where(c("ppid") != c("pid")).select(c(_ID).alias("_child"), "ppid", "start_ns")
    # born strictly before: who begins at one time cannot be each other's parent
    born = children.withColumn("_before", c("start_ns") - 1)
    parents = processes_at(born, lives, "_before", "ppid", how="inner").select(c("_child").alias("pid"), c(_ID).alias("ppid"))
    links = lives.select(c(_ID).alias("pid")).join(parents, "pid", "left")
    return descendants(links, lives.where(roots).select(c(_ID).alias("pid"))).withColumnRenamed("pid", _ID)


def named(name: str, column: str = "name") -> Column:
    """Whether a process has this name, or a path that holds /name."""
    return (c(column) == name) | c(column).contains("/" + name)


def of_tree_at(records: DataFrame, lives: DataFrame, roots: Column, ts: str = "start_ns", pid: str = "pid", grace_ns: int = 0) -> DataFrame:
    """Records whose process at their time is in the tree of those roots; they keep their columns."""
    met = processes_at(records, lives, ts, pid, grace_ns, "inner")
    return met.join(tree(lives, roots), _ID, "left_semi").select(*records.columns)
