"""Containers, pods and processes: lookups and semi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions import scalars
from netlens.operators.scratch import written

c = F.col


def with_pods(containers: DataFrame) -> DataFrame:
    """containers with pod and namespace from their labels, and their tidy name."""
    return containers.withColumns({"pod": F.element_at("labels", scalars.POD_LABEL), "namespace": F.element_at("labels", scalars.NAMESPACE_LABEL), "container": scalars.container_name(c("name"))})


def usable_containers(containers: DataFrame, host_net_ns: int | None = None) -> DataFrame:
    """Without sandboxes, without containers that have no namespace, and without those in the host's network namespace."""
    keep = ~scalars.is_sandbox(c("labels")) & ~scalars.without_namespace(c("pid_ns"), c("mnt_ns"), c("net_ns"))
    return containers.where(keep if host_net_ns is None else keep & (c("net_ns") != host_net_ns))


def choose_containers(containers: DataFrame, container_id: str | None = None, name: str | None = None, pod: str | None = None) -> DataFrame:
    """By id (whole, or a prefix of 12 to 63 characters), by name, or by pod NAME.NAMESPACE (cut at the last dot; default: `default`)."""
    rows = with_pods(containers)
    if container_id:
        rows = rows.where(c("id").startswith(container_id) if 12 <= len(container_id) <= 63 else c("id") == container_id)
    if name:
        rows = rows.where(c("container") == name)
    if pod:
        base, dot, space = pod.rpartition(".")
        rows = rows.where((c("pod") == (base if dot else pod)) & (c("namespace") == (space if dot else "default")))
    return rows


def _sandboxes(containers: DataFrame) -> DataFrame:
    labels = F.from_json("labels", "map<string,string>") if containers.schema["labels"].dataType.simpleString() == "string" else c("labels")
    return containers.withColumn("_sandbox", scalars.is_sandbox(labels))


def attach_containers(processes: DataFrame, containers: DataFrame, host_net_ns: int | None = None, host_mnt_ns: int | None = None, by: tuple[str, ...] = ("pid", "net_ns", "mnt_ns", "id")) -> DataFrame:
    """processes with container_id and container_name: those of the first way in `by` that finds one.

    pid: the container whose root process it is. net_ns, mnt_ns: the container in the process's namespace; of several the first by id
    that is no sandbox, and none if all are; nothing is found in the host's namespaces, whether the process or the container names
    them. id: processes.container_ref, a whole id or a prefix of 12 to 63 characters. Ways whose column processes lack are left out.
    Each way is one aggregate of the containers by its key, and one join.
    """
    held = _sandboxes(containers.where("id is not null"))
    one, rows, found = F.struct("id", "name"), processes, []
    for way in by:
        name = f"_{way}"
        if way == "pid" and "pid" in processes.columns:
            rows = rows.join(held.where("root_pid > 0").groupBy(c("root_pid").alias("pid")).agg(F.min(one).alias(name)), "pid", "left")
        elif way in ("net_ns", "mnt_ns") and way in processes.columns:
            host = {"net_ns": host_net_ns, "mnt_ns": host_mnt_ns}[way]
            inside = held.where((c(way) > 0) & (c(way) != F.lit(host)) if host else c(way) > 0)
            first = F.min(F.struct("_sandbox", "id", "name"))
            best = inside.groupBy(way).agg(first.alias("_f"), F.count(F.lit(1)).alias("_n")).where("_n = 1 or not _f._sandbox").select(way, F.struct("_f.id", "_f.name").alias(name))
            rows = rows.join(best, way, "left")
        elif way == "id" and "container_ref" in processes.columns:
            refs = processes.select("container_ref").where("container_ref is not null").distinct()
            known = held.select(F.substring("id", 1, 12).alias("_head"), one.alias("_one"))
            size = F.length("container_ref")
            hit = refs.withColumn("_head", F.substring("container_ref", 1, 12)).join(known, "_head").where((c("_one.id") == c("container_ref")) | size.between(12, 63) & F.startswith(c("_one.id"), c("container_ref")))
            rows = rows.join(hit.groupBy("container_ref").agg(F.min("_one").alias(name)), "container_ref", "left")
        else:
            continue
        found.append(name)
    told = lambda field: F.coalesce(*(c(f"{n}.{field}") for n in found)) if found else F.lit(None).cast("string")
    return rows.withColumns({"container_id": told("id"), "container_name": told("name")}).drop(*found)


def attach_prioritised(keys: DataFrame, engines: list[DataFrame], key: str = "id") -> DataFrame:
    """Of several sources of the same rows, for each key the row of the first source that has it."""
    both = None
    for i, e in enumerate(engines):
        e = e.withColumn("_rank", F.lit(i))
        both = e if both is None else both.unionByName(e, allowMissingColumns=True)
    best = both.groupBy(key).agg(F.min_by(F.struct(*both.columns), "_rank").alias("_row")).select("_row.*")
    return keys.join(best.drop("_rank"), key, "left")


def descendants(processes: DataFrame, roots: DataFrame) -> DataFrame:
    """(pid) of the roots and of every process below them, however deep. processes(pid, ppid).

    Ways up double: each round joins where a process's way ends so far with that one's own way, and a way ends at a root or
    at a process without a parent. Rounds grow with the logarithm of the depth; a circle of parents ends like any other way,
    once no open way is left or all ways are longer than there are processes.
    """
    chosen = roots.select("pid").distinct().withColumn("_root", F.lit(True))
    each = processes.where("pid is not null").groupBy("pid").agg(F.min(F.when(c("pid") != c("ppid"), c("ppid"))).alias("up"))
    ways = each.join(chosen, "pid", "left").withColumn("found", F.coalesce("_root", F.lit(False)))
    parents = chosen.select(c("pid").alias("up"), F.lit(True).alias("_hit"))
    # a parent that is a root settles a process, whether or not the parent is listed itself
    ways = ways.drop("_root").join(parents, "up", "left").withColumn("found", c("found") | F.coalesce("_hit", F.lit(False))).select("pid", F.when(~c("found"), c("up")).alias("up"), "found")
    ways = written(ways, "ways")
    most, reach = ways.count(), 1
    while reach <= 2 * most and ways.where("up is not null").limit(1).count():
        further = ways.select(c("pid").alias("up"), c("up").alias("_up"), c("found").alias("_found"))
        ways = written(ways.join(further, "up", "left").select("pid", c("_up").alias("up"), (c("found") | F.coalesce("_found", F.lit(False))).alias("found")).select("pid", F.when(~c("found"), c("up")).alias("up"), "found"), "ways")
        reach *= 2
    return chosen.select("pid").unionByName(ways.where("found").select("pid")).distinct()


def of_process_tree(records: DataFrame, processes: DataFrame, roots: DataFrame) -> DataFrame:
    return records.join(descendants(processes, roots), "pid", "left_semi")


def in_namespaces(processes: DataFrame, containers: DataFrame) -> DataFrame:
    """processes any of whose namespaces is one of the containers': one semi-join over kind and number."""
    kinds = ("pid_ns", "mnt_ns", "net_ns")
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c(k).alias("ns")) for k in kinds if k in containers.columns])
    allowed = containers.select(F.explode(pairs).alias("x")).select("x.kind", "x.ns").where("ns <> 0").distinct()
    mine = [k for k in kinds if k in processes.columns]
    hit = processes.select("pid", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c(k).alias("ns")) for k in mine])).alias("x")).select("pid", "x.kind", "x.ns").join(allowed, ["kind", "ns"], "left_semi").select("pid").distinct()
    return processes.join(hit, "pid", "left_semi")
