import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import containment, filters, sequences, spread, status, sync

ROW = "key long, a string, b double"


def tables(spark, seed):
    pick = random.Random(seed)
    value = lambda: pick.choice([None, "x", "y"])
    source = {k: (value(), pick.choice([None, 1.0, 2.0])) for k in pick.sample(range(60), 40)}
    target = {k: (value(), pick.choice([None, 1.0, 2.0])) for k in pick.sample(range(60), 40)}
    frame = lambda rows: spark.createDataFrame([(k, *v) for k, v in rows.items()], ROW)
    return source, target, frame(source), frame(target)


@pytest.mark.parametrize("mode, rest", [("mirror", "delete"), ("additive", "keep")])
def test_plan_and_apply(spark, mode, rest):
    s, t, source, target = tables(spark, 3)
    want = {
        k: rest if k not in s else "create" if k not in t else "skip" if s[k] == t[k] else "update"
        for k in s.keys() | t.keys()
    }
    assert dict(map(tuple, sync.sync_plan(source, target, ["key"], mode).collect())) == want
    after = sync.sync_apply(source, target, ["key"], mode)
    expected = s if mode == "mirror" else {**t, **s}
    assert {r.key: (r.a, r.b) for r in after.collect()} == expected
    # verify after write, and doing it again changes nothing
    actions = {r.action for r in sync.sync_plan(source, after, ["key"], mode).collect()}
    assert actions <= {"skip", "keep"}
    again = sync.sync_apply(source, after, ["key"], mode)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, after.collect()))


def test_missing(spark):
    required = spark.createDataFrame([("jq",), ("curl",), ("jq",), ("gcc",)], "c string")
    present = spark.createDataFrame([("curl",), ("curl",), ("make",)], "c string")
    assert sorted(r.c for r in sync.missing_items(required, present, ["c"]).collect()) == ["gcc", "jq"]


def test_insert_is_idempotent(spark):
    existing = spark.createDataFrame([("k1", 0, "old")], "key string, n long, v string")
    incoming = spark.createDataFrame(
        [("k1", 1, "new"), ("k2", 3, "late"), ("k2", 2, "first"), ("k3", 4, "x")], existing.schema
    )
    once = sync.insert_if_absent(existing, incoming, ["key"], ["n"])
    rows = sorted(map(tuple, once.collect()))
    assert rows == [("k1", 0, "old"), ("k2", 2, "first"), ("k3", 4, "x")]
    assert sorted(map(tuple, sync.insert_if_absent(once, incoming, ["key"], ["n"]).collect())) == rows
    with pytest.raises(ValueError):
        sync.insert_if_absent(existing, incoming, ["key"])


def test_cache(spark):
    requests = spark.createDataFrame(
        [(1, "http://a/x.tgz"), (2, "http://b/x.tgz"), (3, "http://a/y.tgz"), (4, None)], "id long, url string"
    )
    cache = spark.createDataFrame([("http://a/x.tgz",), ("http://a/x.tgz",)], "url string")

    def statuses(**options):
        out = sync.cache_resolve(requests, cache, "url", ["id"], **options)
        return [r.status for r in out.orderBy("id").collect()]

    assert statuses() == ["hit", "fetch", "fetch", "fetch"]
    assert statuses(by="basename") == ["hit", "hit", "fetch", "fetch"]
    assert statuses(offline=True) == ["hit", "miss_offline", "miss_offline", "miss_offline"]
    keys = {r.key for r in sync.cache_after(requests, cache, "url", by="basename").collect()}
    assert keys == {"x.tgz", "y.tgz", None}


def test_drift(spark):
    desired = spark.createDataFrame(
        [("n", "Pub", "yes"), ("n", "Root", "no"), ("n", "Pass", "yes"), ("n", "New", "1")],
        "node string, key string, value string",
    )
    observed = spark.createDataFrame(
        [("n", "Pub", "no", 1, False), ("n", "Pub", "yes", 2, False), ("n", "Root", "yes", 3, False),
         ("n", "Pass", "yes", 4, True)],
        "node string, key string, value string, pos long, off boolean",
    )

    def actions(counts):
        out = sync.config_drift(desired, observed, ["node", "key"], "value", ["pos"], "off", counts)
        return {r.key: r.action for r in out.collect()}

    assert actions(False) == {"Pub": "skip", "Root": "replace", "Pass": "append", "New": "append"}
    assert actions(True) == {"Pub": "skip", "Root": "replace", "Pass": "skip", "New": "append"}
    drift = spark.createDataFrame([("a", "skip"), ("a", "skip"), ("b", "skip"), ("b", "append")], "node string, action string")
    assert dict(map(tuple, sync.drift_verdict(drift, ["node"]).collect())) == {"a": "skip", "b": "apply"}


def test_fanout(spark):
    targets = spark.createDataFrame(
        [("w1", True, "all"), ("w2", False, "spark"), ("w3", True, "hadoop")],
        "target string, available boolean, wanted string",
    )
    items = spark.createDataFrame(
        [("conf/spark", "spark", True), ("conf/hadoop", "hadoop", False)], "item string, type string, present boolean"
    )
    out = {(r.target, r.item): r.action for r in sync.fanout_plan(targets, items).collect()}
    assert out == {
        ("w1", "conf/spark"): "sync",
        ("w1", "conf/hadoop"): "skip_missing_source",
        ("w2", "conf/spark"): "skip_unreachable",
        ("w3", "conf/hadoop"): "skip_missing_source",
    }


def test_fanout_of_what_is_not_known(spark):
    targets = spark.createDataFrame([("w1", None, "all"), ("w2", True, "all"), ("w3", True, None)], "target string, available boolean, wanted string")
    items = spark.createDataFrame([("a", None, True), ("b", "new", None)], "item string, type string, present boolean")
    out = {(r.target, r.item): r.action for r in sync.fanout_plan(targets, items).collect()}
    assert out == {
        ("w1", "a"): "skip_unreachable", ("w1", "b"): "skip_unreachable",
        ("w2", "a"): "sync", ("w2", "b"): "skip_missing_source",
    }


def test_null_keys(spark):
    rows = [(None, 1, "x"), (1, None, "y"), (1, 1, "z"), (None, None, "w")]
    x = spark.createDataFrame(rows, "a long, b long, v string")
    key = ["a", "b"]
    assert {r.action for r in sync.sync_plan(x, x, key).collect()} == {"skip"}
    plan = {(r.a, r.b): r.action for r in sync.sync_plan(x, x.where("b is null"), key).collect()}
    assert plan == {(None, 1): "create", (1, None): "skip", (1, 1): "create", (None, None): "skip"}
    assert sync.sync_apply(x, x, key, "additive").count() == 4
    assert sync.missing_items(x, x, key).count() == 0
    once = sync.insert_if_absent(x.where("a is null"), x, key, ["v"])
    assert sorted(map(repr, sync.insert_if_absent(once, x, key, ["v"]).collect())) == sorted(map(repr, x.collect()))


def test_null_groups(spark):
    rows = [(None, i, i != 5, i % 3) for i in range(9)] + [("g", i, True, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, seq long, ok boolean, p long")
    assert dict(map(tuple, sequences.longest_ok_prefix(df, ["g"], "seq", F.col("ok")).collect())) == {None: 4, "g": 2}
    best = sequences.priority_fallback(df, ["g"], "p", F.col("seq") > 0, ["seq"]).collect()
    assert sorted((r.g or "", r.seq) for r in best) == [("", 3), ("", 6), ("g", 1), ("g", 2)]
    outcomes = df.select("g", F.col("seq").cast("string").alias("node"), F.when(F.col("ok"), "copied").alias("outcome"))
    (page,) = status.fleet_failed_list(outcomes, ["g"], ["node"], ["copied"], 1).collect()
    assert (page.g, page.failed_list) == (None, ["5 - unknown"])
    both = status.fleet_failed_list(outcomes, ["g", "node"], ["node"], ["copied"], 3).collect()
    assert [(r.g, r.node, r.failed_list) for r in both] == [(None, "5", ["5 - unknown"])]


@pytest.mark.parametrize("few", [True, False])
def test_networks(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(spread, "BROADCAST_ROWS", 2)

    nets = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.77/24", "0.0.0.0/0", "10.1.2.3/32", "10.1.9.9/16", "bad", "10.0.0.0/33", None]
    ips = ["10.1.2.3", "10.1.2.4", "10.9.9.9", "192.168.0.1", "256.1.1.1", "::1", "10.1.2", None]
    addresses = spark.createDataFrame(list(enumerate(ips)), "id long, ip string")
    networks = spark.createDataFrame([(n,) for n in nets], "cidr string")
    want = {
        (i, ip, n) for i, ip in enumerate(ips[:4]) for n in nets[:6]
        if ipaddress.ip_address(ip) in ipaddress.ip_network(n, strict=False)
    }
    got = containment.cidr_match(addresses, networks, "id", "ip", "cidr")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    longest = containment.cidr_match(addresses, networks, "id", "ip", "cidr", longest=True)
    assert {r.id: r.cidr for r in longest.collect()} == {
        0: "10.1.2.3/32", 1: "10.1.2.77/24", 2: "10.0.0.0/8", 3: "0.0.0.0/0",
    }
    # each row counts by itself
    again = spark.createDataFrame([(1, "10.1.2.3"), (1, "10.9.9.9"), (2, "10.1.2.3"), (2, "10.1.2.3")], "id long, ip string")
    rows = containment.cidr_match(again, networks, "id", "ip", "cidr", longest=True).collect()
    assert sorted((r.id, r.cidr) for r in rows) == [
        (1, "10.0.0.0/8"), (1, "10.1.2.3/32"), (2, "10.1.2.3/32"), (2, "10.1.2.3/32"),
    ]


def test_gates_and_summary(spark):
    rows = [
        ("d1", "w1", "ping"), ("d1", "w1", "port"), ("d1", "w1", "login"),
        ("d1", "w2", "ping"), ("d1", "w2", "login"),
        ("d1", "w3", "port"), ("d1", "w3", None),
        ("d1", "w4", "ping"), ("d1", "w4", "port"), ("d1", "w4", "copied"),
        ("d2", "w1", "ping"), ("d2", "w1", "port"),
        ("d3", "w1", "ping"), ("d3", "w1", "port"), ("d3", "w1", "copied"),
    ]
    df = spark.createDataFrame(rows, "day string, node string, event string")
    event = F.col("event")
    gates = [
        ("unreachable", "need", event == "ping"),
        ("port closed", "need", event == "port"),
        ("already", "stop", event == "login"),
        ("copied", "stop", event == "copied"),
    ]
    out = status.gate_classify(df, ["day", "node"], gates, "copy failed")
    assert {(r.day, r.node): r.outcome for r in out.collect()} == {
        ("d1", "w1"): "already", ("d1", "w2"): "port closed", ("d1", "w3"): "unreachable",
        ("d1", "w4"): "copied", ("d2", "w1"): "copy failed", ("d3", "w1"): "copied",
    }
    ok = ["already", "copied"]
    summary = status.fleet_summary(out, ["day"], ok).orderBy("day").collect()
    assert [tuple(r) for r in summary] == [
        ("d1", 4, 2, 2, "partial"), ("d2", 1, 0, 1, "failed"), ("d3", 1, 1, 0, "all"),
    ]
    lists = status.fleet_failed_list(out, ["day"], ["node"], ok, 1).orderBy("day").collect()
    assert [(r.day, r.page, r.failed_list) for r in lists] == [
        ("d1", 0, ["w2 - port closed", "w3 - unreachable"]), ("d2", 0, ["w1 - copy failed"]),
    ]
    failures = status.fleet_failures(out, ["day"], ["node"], ok)
    assert sorted(r.entry for r in failures.collect()) == ["w1 - copy failed", "w2 - port closed", "w3 - unreachable"]


def test_prefix(spark):
    runs = {"a": "11101011", "b": "011", "c": "111", "d": "0", "e": "1"}
    rows = [(g, i * 10, c == "1") for g, run in runs.items() for i, c in enumerate(run)]
    df = spark.createDataFrame(rows, "g string, seq long, ok boolean")
    out = sequences.longest_ok_prefix(df, ["g"], "seq", F.col("ok"))
    assert dict(map(tuple, out.collect())) == {"a": 20, "b": None, "c": 20, "d": None, "e": 0}


def test_fallback(spark):
    rows = [(1, "g", 1, "rc1"), (2, "g", 2, "ok"), (3, "g", 2, "rc2"), (4, "g", 2, "ok"), (5, "g", 3, "ok"), (6, "h", 9, "rc")]
    df = spark.createDataFrame(rows, "id long, g string, source int, v string")
    out = sequences.priority_fallback(df, ["g"], "source", F.col("v") == "ok", ["id"])
    assert sorted(r.id for r in out.collect()) == [2, 4]


def test_pointer_and_first(spark):
    rows = [(1, "java", "jdk-17", 5), (2, "java", "jdk-21", 9), (3, "java", "jdk-11", 9), (4, "scala", "2.13", 1)]
    df = spark.createDataFrame(rows, "id long, product string, dir string, ts long")
    now = sequences.current_pointer(df, ["product"], "dir", ["ts", "id"])
    assert {r.product: (r.current, r.moves) for r in now.collect()} == {"java": ("jdk-11", 3), "scala": ("2.13", 1)}
    first = sequences.first_match(df, F.col("dir").startswith("jdk"), ["ts", "id"], ["product"])
    assert [tuple(r) for r in first.collect()] == [(1, "java", "jdk-17", 5)]
    assert sequences.first_match(df, F.col("ts") > 5, ["ts", "id"]).collect()[0].id == 2


def test_filters(spark):
    df = spark.createDataFrame([(1, "eth0"), (2, "docker0"), (3, "lo"), (4, "br-1"), (5, None), (6, "")], "id long, n string")
    out = filters.exclude_pattern_filter(df, "n", ["docker", "br-", "veth"], ["lo"])
    assert sorted(r.id for r in out.collect()) == [1, 5, 6]
    allowed = spark.createDataFrame([("lo",), ("lo",), ("eth0",), (None,)], "x string")
    for list_or_table in (["lo", "eth0"], allowed):
        assert sorted(r.id for r in filters.allow_list_filter(df, "n", list_or_table, ["id"]).collect()) == [1, 3]
    mapping = {"real": ["eth0"], "virtual": ["docker0", "br-1"]}
    table = spark.createDataFrame([(v, k) for k, vs in mapping.items() for v in vs], "v string, r string")
    for given in (mapping, table):
        out = filters.case_map(df, "n", given, "other", "kind", ["id"])
        kinds = {r.id: r.kind for r in out.collect()}
        assert kinds == {1: "real", 2: "virtual", 3: "other", 4: "virtual", 5: "other", 6: "other"}
    filled = filters.default_fill(df, {"n": "none", "id": 0}).collect()
    assert [r.n for r in filled] == ["eth0", "docker0", "lo", "br-1", "none", "none"]


def test_drift_of_null_settings(spark):
    from tidemark.operators.sync import config_drift

    desired = spark.createDataFrame([(None, "v"), ("a", None), ("b", "1"), ("c", "2")], "s string, v string")
    observed = spark.createDataFrame([(None, "v", 1), ("a", None, 1), ("b", None, 1)], "s string, v string, n int")
    got = {r.s: r.action for r in config_drift(desired, observed, ["s"], "v", ["n"]).collect()}
    assert got == {None: "skip", "a": "skip", "b": "replace", "c": "append"}
