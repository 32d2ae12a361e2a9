"""Process lifetimes against loops over the events."""

import random

from pyspark.sql import functions as F

from netlens.operators import lifetimes

EVENTS = "pid long, ppid long, kind string, name string, net_ns long, ts_ns long"


def test_a_pid_that_is_used_again(spark):
    ev = [(7, 1, "exec", "/opt/a", 1, 100), (7, None, "exit", None, None, 200), (7, 1, "exec", "/opt/b", 1, 300), (7, 1, "exec", "/opt/c", 1, 400), (7, None, "exit", None, None, 500), (7, 2, "exec", "/opt/d", 1, 500),
          (8, 1, "exit", None, None, 50), (9, 7, "exec", "/opt/e", 2, 350), (10, 7, "exec", "/opt/f", 2, 450), (11, 7, "exec", "/opt/g", 2, 250), (None, 1, "exec", "x", 1, 5)]
    lives = lifetimes.lifetimes(spark.createDataFrame(ev, EVENTS))
    assert sorted((r.pid, r.name, r.start_ns, r.end_ns) for r in lives.collect() if r.pid == 7) == [(7, "/opt/a", 100, 200), (7, "/opt/b", 300, 400), (7, "/opt/c", 400, 500), (7, "/opt/d", 500, None)]
    calls = spark.createDataFrame([(t, 7, t) for t in (99, 100, 199, 200, 299, 300, 399, 400, 499, 500, 10**6)] + [(-1, None, 100), (-2, 8, 60)], "id long, pid long, start_ns long")
    at = {r.id: r.process_name for r in lifetimes.processes_at(calls, lives).collect()}
    assert at == {99: None, 100: "/opt/a", 199: "/opt/a", 200: None, 299: None, 300: "/opt/b", 399: "/opt/b", 400: "/opt/c", 499: "/opt/c", 500: "/opt/d", 10**6: "/opt/d", -1: None, -2: None}
    late = {r.id: r.process_name for r in lifetimes.processes_at(calls, lives, grace_ns=150).collect()}
    assert late == at | {200: "/opt/a", 299: "/opt/a"}
    # e was born of b, f of c; g found no parent, as a had ended
    of = lambda name: {r.life for r in lifetimes.tree(lives, lifetimes.named(name)).collect()}
    assert of("b") == {"7@300", "9@350"} and of("c") == {"7@400", "10@450"} and of("a") == {"7@100"}
    assert {r.life for r in lifetimes.alive_at(lives, 420).collect()} == {"7@400", "9@350", "11@250"}
    assert lifetimes.processes_at(calls, lives, how="inner").count() == 8 and lifetimes.lifetimes(spark.createDataFrame([], EVENTS)).count() == 0


def test_random_trees(spark):
    rng = random.Random(4)
    ev, alive, lives = [], {}, []
    for t in range(1, 900):
        pid = rng.randrange(30)
        if pid in alive and rng.random() < 0.6:
            alive.pop(pid)[4] = t
            ev.append((pid, None, "exit", None, None, t))
        else:
            if pid in alive:
                alive[pid][4] = t
            ppid = rng.randrange(30)
            parent = alive.get(ppid) if ppid != pid else None
            life = [f"{pid}@{t}", pid, f"/bin/n{rng.randrange(20)}", t, None, parent]
            alive[pid] = life
            lives.append(life)
            ev.append((pid, ppid, "exec", life[2], None, t))
    wanted = {x[0] for x in lives if "/n3" in x[2]}
    for x in lives:  # in order of birth: parents first
        if x[5] is not None and x[5][0] in wanted:
            wanted.add(x[0])
    df = lifetimes.lifetimes(spark.createDataFrame(ev, EVENTS))
    assert {r.life for r in lifetimes.tree(df, lifetimes.named("n3")).collect()} == wanted
    calls = spark.createDataFrame([(t, rng.randrange(30)) for t in range(1, 900)], "start_ns long, pid long").withColumn("life", F.lit("mine"))
    got = sorted((r.start_ns, r.pid) for r in lifetimes.of_tree_at(calls.drop("life"), df, lifetimes.named("n3")).collect())
    want = sorted((r.start_ns, r.pid) for r in calls.collect() if any(x[1] == r.pid and x[3] <= r.start_ns and (x[4] is None or r.start_ns < x[4]) and x[0] in wanted for x in lives))
    assert got == want and got


def test_a_busy_pid_is_looked_up_without_a_product(spark):
    """2,000 lives of one pid: each call meets its own, and no join compares all calls of the pid with all its lives."""
    n = 2000
    lives = lifetimes.lifetimes(spark.createDataFrame([(7, 1, kind, f"/opt/p{t}", 1, 10 * t + (kind == "exit") * 5) for t in range(n) for kind in ("exec", "exit")], EVENTS))
    calls = spark.createDataFrame([(10 * t + d, 7) for t in range(n) for d in (0, 4, 5, 7)] + [(3, None), (3, 8)], "start_ns long, pid int")
    out = lifetimes.processes_at(calls, lives, grace_ns=2)
    assert [f.dataType.simpleString() for f in out.schema.fields[:2]] == ["bigint", "int"]
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert not [line for line in plan.splitlines() if "Join" in line and "start_ns" in line]
    got = {(r.start_ns, r.pid): r.process_name for r in out.collect()}
    assert got == {(10 * t + d, 7): f"/opt/p{t}" if d < 7 else None for t in range(n) for d in (0, 4, 5, 7)} | {(3, None): None, (3, 8): None}
