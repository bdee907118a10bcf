"""The registered queries: one or more per operator, each over whole tables of ``folder``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules, text
from tidemark.functions.versions import is_stable
from tidemark.operators import containment, digests, filters, sequences, status, sync, versions
from tidemark.plans.inputs import BEGIN, BLOCK_BODY, DESIRED, END, spark_input
from tidemark.scratch import scratch_path
from tidemark.sources import buckets, commits, joblog, publish, scan
from tidemark.sources.tables import load
from tidemark.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
ORDER_KEY = ["o_orderkey"]
HREF = 'href="([^"]*)"'


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load(spark, folder, name)[0]


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "orders").select(*ORDER_COLUMNS)


# scans, sinks


@query
def scan_lines(spark, folder):
    return scan.scan_lines(_table(spark, folder, "documents"), "doc_id", "text")


@query
def scan_html_links(spark, folder):
    return scan.scan_html_links(_table(spark, folder, "pages"), "page_id", "html", HREF)


@query
def scan_json_index(spark, folder):
    return scan.scan_json_index(
        spark_input(spark, folder, "json_index"),
        ["event_id"],
        "doc",
        "assets",
        "kind string, name string",
        (F.col("item.kind") == "view") & F.col("item.name").rlike("^v[0-9]+[.]"),
        "name",
    )


@query
def scan_file_lines(spark, folder):
    """All lines of one text file, read in splits; its text is that of the documents, with their numbers."""
    lines = scan.scan_lines(_table(spark, folder, "documents"), "doc_id", "text")
    path = scratch_path(spark, "text-file")
    lines.select(F.concat_ws("\t", "doc_id", "pos", "line")).sortWithinPartitions("doc_id", "pos").write.text(path)
    numbered = scan.scan_file_lines(spark, path)
    return numbered.groupBy(F.split("line", "\t")[0].cast("long").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), (F.max("pos") - F.min("pos") + 1).alias("span")
    )


@query
def scan_json_variants(spark, folder):
    """Elements of arrays in JSON of several shapes, and the rows without one, with the reason."""
    docs = spark_input(spark, folder, "json_shapes")
    fields = {"kind": ("$.kind", "string"), "size": ("$.meta.size", "int")}
    found, rejected = scan.scan_json_variants(docs, ["event_id"], "doc", "$.assets", fields)
    none = [F.lit(None).cast(kind).alias(name) for name, (_, kind) in fields.items()]
    return found.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected.select("event_id", *none, "reason"))


@query
def write_table(spark, folder):
    path = scratch_path(spark, "write-table")
    publish.write_table(_orders(spark, folder), path, "overwrite")
    publish.write_table(spark_input(spark, folder, "old_orders"), path, "append")
    return publish.write_table(_orders(spark, folder), path, "create_if_absent")


@query
def validated_publish(spark, folder):
    root = scratch_path(spark, "validated-publish")
    orders, old = _orders(spark, folder), spark_input(spark, folder, "old_orders")
    checks = {"key_not_negative": F.col("o_orderkey") >= 0, "has_status": F.col("o_orderstatus").isNotNull()}
    publish.validated_publish(orders, checks, root, 1)
    # breaks a rule, so version 1 stays
    return publish.validated_publish(old, checks, root, 2)


@query
def snapshot_history(spark, folder):
    path = scratch_path(spark, "snapshots")
    publish.snapshot_history(spark_input(spark, folder, "old_orders"), path, 1_000_000_000)
    history = publish.snapshot_history(_orders(spark, folder), path, 1_000_000_100)
    return history


@query
def snapshot_latest(spark, folder):
    path = scratch_path(spark, "snapshots")
    publish.snapshot_history(spark_input(spark, folder, "old_orders"), path, 1_000_000_000)
    history = publish.snapshot_history(_orders(spark, folder), path, 1_000_000_100)
    return publish.snapshot_latest(history, 1_000_000_099).drop("snapshot_ts")


@query
def interval_history(spark, folder):
    """Three states, the first one coming back at the end, with the time that each row counted."""
    root, key = scratch_path(spark, "intervals"), ORDER_KEY
    old, new = spark_input(spark, folder, "old_orders"), _orders(spark, folder)
    publish.interval_history(old, root, key, 1_000_000_000)
    publish.interval_history(new, root, key, 1_000_000_100)
    return publish.interval_history(old, root, key, 1_000_000_200)


@query
def state_as_of(spark, folder):
    root, key = scratch_path(spark, "intervals"), ORDER_KEY
    publish.interval_history(spark_input(spark, folder, "old_orders"), root, key, 1_000_000_000)
    history = publish.interval_history(_orders(spark, folder), root, key, 1_000_000_100)
    return publish.state_as_of(history, 1_000_000_099)


@query
def racing_publishers(spark, folder):
    """Two appends that start from the same version: one is told that the other was first, and tries again."""
    root = scratch_path(spark, "racing")
    old, new = spark_input(spark, folder, "old_orders"), _orders(spark, folder)
    publish.write_table(old.where("o_orderkey < 0"), root, "overwrite")
    number, entry = commits.latest(spark, root)
    publish.write_table(old.where("o_orderkey >= 0"), root, "append")
    try:  # an entry made from the version before
        commits.commit(spark, root, number + 1, entry)
    except commits.Conflict:
        publish.write_table(new, root, "append")
    commits.clean(spark, root, 3600)
    return publish.published(spark, root)


# predicates, mappings


@query
def rule_check(spark, folder):
    names = spark_input(spark, folder, "names")
    checked = filters.rule_check(names, rules.host_label_rules(F.col("name")))
    return checked.select("page_id", "name", "valid", F.concat_ws(",", "violations").alias("violations"))


def _checked(df: DataFrame, id: str, value: str, checks: dict) -> DataFrame:
    checked = filters.rule_check(df, checks)
    return checked.select(id, value, "valid", F.concat_ws(",", "violations").alias("violations"))


@query
def rule_check_versions(spark, folder):
    releases = spark_input(spark, folder, "releases")
    return _checked(releases, "id", "version", rules.version_rules(F.col("version"), 3))


@query
def rule_check_networks(spark, folder):
    shape = F.when(F.col("user_id") % 3 == 0, "/24").when(F.col("user_id") % 3 == 1, "/33").otherwise("")
    given = _table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("10.0."), F.col("user_id").cast("string"), F.lit(".0"), shape).alias("cidr")
    )
    return _checked(given, "event_id", "cidr", rules.network_rules(F.col("cidr")))


@query
def allow_list_filter(spark, folder):
    events = _table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return filters.allow_list_filter(events, "event_type", ["click", "view"])


@query
def allow_list_filter_table(spark, folder):
    lines, parts = load(spark, folder, "lineitem", "part")
    promo = parts.where(F.col("p_type") == "PROMO").select("p_partkey")
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return filters.allow_list_filter(lines, "l_partkey", promo, ["l_orderkey", "l_linenumber"])


@query
def exclude_pattern_filter(spark, folder):
    pages = _table(spark, folder, "pages").select("page_id", "url")
    hosts = text.regex_pick(pages, "url", "^[a-z]+://([^/]+)", "host")
    return filters.exclude_pattern_filter(hosts, "host", ["blog[.]", "m[.]"], ["spam-farm.example.org"])


def _prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Starts of addresses, thousands of them in a large table, of several lengths and some within others."""
    pages = _table(spark, folder, "pages").where("page_id % 3 = 0")
    return pages.select(F.expr("substring(url, 1, 12 + cast(page_id % 40 as int))").alias("prefix"))


@query
def longest_prefix(spark, folder):
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return filters.longest_prefix(pages, "url", _prefixes(spark, folder), "prefix", ["page_id"])


@query
def exclude_prefix_table(spark, folder):
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return filters.exclude_prefix_table(pages, "url", _prefixes(spark, folder), ["page_id"])


@query
def case_map(spark, folder):
    events = _table(spark, folder, "events").select("event_id", "event_type")
    families = {"read": ["view", "click"], "write": ["purchase", "signup"]}
    return filters.case_map(events, "event_type", families, "other", "family")


@query
def case_map_table(spark, folder):
    customers, nations = load(spark, folder, "customer", "nation")
    customers = customers.select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    low = nations.where(F.col("n_regionkey") < 3)
    mapping = low.select(F.col("n_nationkey").cast("string").alias("value"), F.col("n_name").alias("result"))
    return filters.case_map(customers, "nation", mapping, "elsewhere", "nation_name", ["c_custkey"])


@query
def default_fill(spark, folder):
    requests = spark_input(spark, folder, "requests").select("page_id", "path")
    return filters.default_fill(requests, {"path": "index"})


# joins


@query
def missing_items(spark, folder):
    orders, lines = load(spark, folder, "orders", "lineitem")
    required = orders.select(F.col("o_orderkey").alias("order_key"))
    return sync.missing_items(required, lines.select(F.col("l_orderkey").alias("order_key")), ["order_key"])


@query
def fanout_plan(spark, folder):
    targets, items = spark_input(spark, folder, "fleet_targets"), spark_input(spark, folder, "fleet_items")
    return sync.fanout_plan(targets, items)


@query
def sync_plan(spark, folder):
    return sync.sync_plan(_orders(spark, folder), spark_input(spark, folder, "old_orders"), ORDER_KEY)


@query
def sync_plan_additive(spark, folder):
    return sync.sync_plan(
        _orders(spark, folder), spark_input(spark, folder, "old_orders"), ORDER_KEY, "additive"
    )


@query
def sync_plan_summary(spark, folder):
    return sync_plan(spark, folder).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query
def sync_plan_null_keys(spark, folder):
    """Keys with nulls in both columns, against themselves and a part of them."""
    gaps = spark_input(spark, folder, "gaps")
    source = gaps.groupBy("k", "g").agg(F.max("event_id").alias("last"))
    target = gaps.where("v is null or v < 3").groupBy("k", "g").agg(F.max("event_id").alias("last"))
    return sync.sync_plan(source, target, ["k", "g"])


@query
def sync_plan_by_digest(spark, folder):
    return digests.sync_plan_by_digest(_orders(spark, folder), spark_input(spark, folder, "old_orders"), ORDER_KEY)


@query
def sync_plan_by_kept_digests(spark, folder):
    """The old snapshot's digests were kept with it; keys may be null."""
    gaps, root = spark_input(spark, folder, "gaps"), scratch_path(spark, "digests")
    last = lambda df: df.groupBy("k", "g").agg(F.max("event_id").alias("e"))
    target = last(gaps.where("v is null or v < 3"))
    kept = publish.write_table(digests.key_digests(target, ["k", "g"], ["e"]), root, "overwrite")
    return digests.sync_plan_by_digest(last(gaps), target, ["k", "g"], target_digests=kept)


@query
def bucketed_upsert(spark, folder):
    """Two changes of a bucketed table, a small one and one of all buckets."""
    root = scratch_path(spark, "buckets")
    buckets.start_buckets(spark_input(spark, folder, "old_orders"), root, ORDER_KEY, 16)
    orders = _orders(spark, folder)
    buckets.upsert(orders.where(buckets.bucket_of(ORDER_KEY, 16) < 2), root)
    buckets.upsert(orders, root)
    return buckets.bucketed(spark, root)[0]


@query
def sync_apply(spark, folder):
    """Additive, then the plan for what was applied: all keys of the source are as they should be."""
    orders = _orders(spark, folder)
    applied = sync.sync_apply(orders, spark_input(spark, folder, "old_orders"), ORDER_KEY, "additive")
    return sync.sync_plan(orders, applied, ORDER_KEY, "additive")


@query
def sync_apply_additive(spark, folder):
    return sync.sync_apply(
        _orders(spark, folder), spark_input(spark, folder, "old_orders"), ORDER_KEY, "additive"
    )


@query
def cidr_match(spark, folder):
    addresses, networks = spark_input(spark, folder, "addresses"), spark_input(spark, folder, "networks")
    return containment.cidr_match(addresses, networks, "event_id", "ip", "cidr")


@query
def cidr_match_longest(spark, folder):
    addresses, networks = spark_input(spark, folder, "addresses"), spark_input(spark, folder, "networks")
    return containment.cidr_match(addresses, networks, "event_id", "ip", "cidr", longest=True)


@query
def cache_resolve(spark, folder):
    requests, cache = spark_input(spark, folder, "requests"), spark_input(spark, folder, "cache")
    return sync.cache_resolve(requests, cache, "url", ["page_id"])


@query
def cache_resolve_by_basename(spark, folder):
    requests, cache = spark_input(spark, folder, "requests"), spark_input(spark, folder, "cache")
    return sync.cache_resolve(requests, cache, "url", ["page_id"], offline=True, by="basename")


@query
def cache_after(spark, folder):
    requests, cache = spark_input(spark, folder, "requests"), spark_input(spark, folder, "cache")
    return sync.cache_after(requests, cache, "url", by="basename")


@query
def missing_items_null_keys(spark, folder):
    gaps = spark_input(spark, folder, "gaps").select("k", "g", "v")
    return sync.missing_items(gaps, gaps.where("k = 2 and v = 1 or k is null and g is null"), ["k", "g"])


@query
def config_drift_from_text(spark, folder):
    """Settings read out of texts: the last line of a key counts, commented ones do not."""
    documents = spark_input(spark, folder, "config_docs")
    observed = scan.scan_settings(documents, "doc_id", "body")
    wanted = F.create_map(*map(F.lit, ["lang", "en", "quota", "500", "source", "src3", "absent", "1"]))
    desired = documents.select("doc_id", F.explode(wanted).alias("setting", "value"))
    return sync.config_drift(desired, observed, ["doc_id", "setting"], "value", ["pos"], "commented")


def _desired(spark: SparkSession, folder: str, wanted: dict[str, str] = DESIRED) -> DataFrame:
    nodes = _table(spark, folder, "events").select(F.col("user_id").alias("node")).distinct()
    settings = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    return nodes.select("node", F.explode(settings).alias("setting", "value"))


@query
def config_drift(spark, folder):
    observed = spark_input(spark, folder, "observed")
    return sync.config_drift(
        _desired(spark, folder), observed, ["node", "setting"], "value", ["ts", "event_id"], "commented"
    )


@query
def config_drift_commented(spark, folder):
    observed = spark_input(spark, folder, "observed")
    return sync.config_drift(
        _desired(spark, folder),
        observed,
        ["node", "setting"],
        "value",
        ["ts", "event_id"],
        "commented",
        commented_counts=True,
    )


@query
def config_drift_null_keys(spark, folder):
    """Settings whose name or value may be null, each as its first entry has it, against the last one."""
    gaps = spark_input(spark, folder, "gaps").select("k", "g", "v", "event_id")
    desired = gaps.groupBy("k", "g").agg(F.min_by("v", "event_id").alias("v"))
    return sync.config_drift(desired, gaps.where("k is null or k <> 1"), ["k", "g"], "v", ["event_id"])


@query
def drift_verdict(spark, folder):
    desired = _desired(spark, folder, {"click": "1", "view": "1"})
    observed = spark_input(spark, folder, "observed")
    drift = sync.config_drift(desired, observed, ["node", "setting"], "value", ["ts", "event_id"])
    return sync.drift_verdict(drift, ["node"])


@query
def insert_if_absent(spark, folder):
    benchmark, documents = load(spark, folder, "benchmark", "documents")
    existing = scan.scan_lines(benchmark, "item_id", "text").select("line")
    incoming = scan.scan_lines(documents, "doc_id", "text").select("line")
    return sync.insert_if_absent(existing, incoming, ["line"])


@query
def insert_if_absent_null_keys(spark, folder):
    """Twice: the second time nothing is added."""
    gaps = spark_input(spark, folder, "gaps").select("k", "g", "event_id")
    existing = gaps.where("g = 'click'").groupBy("k", "g").agg(F.max("event_id").alias("event_id"))
    once = sync.insert_if_absent(existing, gaps, ["k", "g"], ["event_id"])
    return sync.insert_if_absent(once, gaps, ["k", "g"], ["event_id"])


# aggregations


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    events = _table(spark, folder, "events").select(
        "user_id", F.to_date("ts").cast("string").alias("day"), "event_type"
    )
    kind = F.col("event_type")
    gates = [
        ("unreachable", "need", kind == "signup"),
        ("port_closed", "need", kind == "view"),
        ("already", "stop", kind == "click"),
    ]
    return status.gate_classify(events, ["user_id", "day"], gates, "copied")


@query
def gate_classify(spark, folder):
    return _outcomes(spark, folder)


@query
def fleet_summary(spark, folder):
    return status.fleet_summary(_outcomes(spark, folder), ["day"], ["already", "copied"])


@query
def fleet_failures(spark, folder):
    return status.fleet_failures(_outcomes(spark, folder), ["day"], ["user_id"], ["already", "copied"])


@query
def fleet_failed_list(spark, folder):
    lists = status.fleet_failed_list(_outcomes(spark, folder), ["day"], ["user_id"], ["already", "copied"], 4)
    return lists.select("day", "page", F.array_join("failed_list", "|").alias("failed_list"))


@query
def fleet_failed_list_null_groups(spark, folder):
    gaps = spark_input(spark, folder, "gaps").select("g", "event_id", F.col("v").cast("string").alias("outcome"))
    lists = status.fleet_failed_list(gaps, ["g"], ["g", "event_id"], ["1", "2"], 2)
    return lists.select("g", "page", F.array_join("failed_list", "|").alias("failed_list"))


@query
def latest_version_preview_first(spark, folder):
    releases = spark_input(spark, folder, "releases")
    return versions.latest_version(releases, ["component"], "version", "preview_first")


@query
def latest_version(spark, folder):
    releases = spark_input(spark, folder, "releases")
    return versions.latest_version(releases, ["component"], "version", "stable_first")


@query
def latest_version_stamped(spark, folder):
    return versions.latest_version(spark_input(spark, folder, "stamped"), ["product"], "version", "stable_first")


@query
def distinct_versions(spark, folder):
    return versions.distinct_versions(spark_input(spark, folder, "releases"), ["product"], "version")


@query
def current_pointer(spark, folder):
    releases = spark_input(spark, folder, "releases")
    return sequences.current_pointer(releases, ["component"], "version", ["ts", "id"])


# order-dependent logic


@query
def last_wins_kv(spark, folder):
    observed = spark_input(spark, folder, "observed")
    return sequences.last_wins_kv(observed, ["node", "setting"], "value", ["ts", "event_id"])


@query
def longest_ok_prefix(spark, folder):
    probes = _table(spark, folder, "events").select("user_id", "event_id", "event_type")
    reached = sequences.longest_ok_prefix(probes, ["user_id"], "event_id", F.col("event_type") != "error")
    return reached.select("user_id", F.coalesce(F.col("last_ok").cast("string"), F.lit("none")).alias("last_ok"))


@query
def longest_ok_prefix_null_groups(spark, folder):
    gaps = spark_input(spark, folder, "gaps")
    reached = sequences.longest_ok_prefix(gaps, ["k", "g"], "event_id", F.col("v").isNotNull())
    return reached.select("k", "g", F.coalesce(F.col("last_ok").cast("string"), F.lit("none")).alias("last_ok"))


@query
def priority_fallback_null_groups(spark, folder):
    gaps = spark_input(spark, folder, "gaps")
    return sequences.priority_fallback(gaps, ["k"], "v", F.col("value") > 50, ["event_id"])


@query
def block_spans(spark, folder):
    lines = scan.scan_lines(spark_input(spark, folder, "marked_docs"), "doc_id", "body")
    return sequences.block_spans(lines, "doc_id", "pos", "line", BEGIN, END)


@query
def priority_fallback(spark, folder):
    releases = spark_input(spark, folder, "releases")
    return sequences.priority_fallback(
        releases, ["component"], "priority", is_stable(F.col("version")), ["id"]
    )


@query
def fallback_latest_version(spark, folder):
    """Both steps of a lookup: the first source with a stable version, then its greatest one."""
    return versions.latest_version(priority_fallback(spark, folder), ["component"], "version", "stable_first")


# sorts, first and last


@query
def version_sort(spark, folder):
    releases = spark_input(spark, folder, "releases").select("id", "product", "version")
    return versions.version_sort(releases, ["product"], "version", ["id"])


@query
def version_sort_stamped(spark, folder):
    return versions.version_sort(spark_input(spark, folder, "stamped"), ["product"], "version", ["id"])


@query
def first_match(spark, folder):
    releases = spark_input(spark, folder, "releases")
    return sequences.first_match(releases, is_stable(F.col("version")), ["ts", "id"], ["component"])


@query
def first_match_overall(spark, folder):
    releases = spark_input(spark, folder, "releases")
    return sequences.first_match(releases, is_stable(F.col("version")), ["ts", "id"])


@query
def tail_lines(spark, folder):
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return text.tail_lines(documents, "text", 2).select("doc_id", "tail")


# text columns


@query
def path_parts(spark, folder):
    return text.path_parts(_table(spark, folder, "pages").select("page_id", "url"), "url")


@query
def split_around(spark, folder):
    releases = spark_input(spark, folder, "releases").select("id", "version")
    return text.split_around(releases, "version", ".")


@query
def url_template(spark, folder):
    releases = spark_input(spark, folder, "releases").select("id", "version")
    templates = [
        (0, "https://example.org/v{major}/tool-{name}/tool-{version}.tgz"),
        (8, "https://example.org/tool/{main}/build-{build}.tar.gz"),
    ]
    return text.url_template(releases, "version", templates)


@query
def regex_rewrite(spark, folder):
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return text.regex_rewrite(pages, "url", "^([a-z]+)://([^/]+)/(.*)$", "$2 $1 /$3", "rewritten")


@query
def regex_pick(spark, folder):
    return text.regex_pick(
        _table(spark, folder, "pages").select("page_id", "html"), "html", "<title>([^<]*)</title>", "title"
    ).drop("html")


@query
def field_split(spark, folder):
    parts = _table(spark, folder, "part").select("p_partkey", "p_name")
    return text.field_split(parts, "p_name", ["colour", "noun", "rest"])


@query
def comment_out_lines(spark, folder):
    return text.comment_out_lines(spark_input(spark, folder, "config_docs"), "body", "lang|source")


@query
def replace_or_append_kv(spark, folder):
    documents = spark_input(spark, folder, "config_docs")
    return text.replace_or_append_kv(
        text.replace_or_append_kv(documents, "body", "lang", "x$1"), "body", "quota", "500"
    )


@query
def block_upsert_tail(spark, folder):
    return text.block_upsert_tail(spark_input(spark, folder, "marked_docs"), "body", BEGIN, END, BLOCK_BODY)


@query
def block_replace_in_place(spark, folder):
    return text.block_replace_in_place(
        spark_input(spark, folder, "marked_docs"), "body", BEGIN, END, BLOCK_BODY
    )


# job logs


@query
def event_log_rollup(spark, folder):
    run = F.floor("value").cast("bigint")
    record = F.struct(
        F.lit(joblog.TASK_END).alias("Event"),
        F.col("user_id").alias("Stage ID"),
        (F.col("event_id") % 2).alias("Stage Attempt ID"),
        F.struct((F.col("value") < 5).alias("Failed")).alias("Task Info"),
        F.struct(
            run.alias("Executor Run Time"),
            F.length("props").cast("bigint").alias("Memory Bytes Spilled"),
            F.lit(0).alias("Disk Bytes Spilled"),
            F.struct(
                run.alias("Remote Bytes Read"), F.length("event_type").alias("Local Bytes Read")
            ).alias("Shuffle Read Metrics"),
            F.struct((run * 10).alias("Shuffle Bytes Written")).alias("Shuffle Write Metrics"),
        ).alias("Task Metrics"),
    )
    path = scratch_path(spark, "event-log")
    logs = _table(spark, folder, "events").select(F.to_json(record).alias("value"), F.concat("event_type", F.lit(" é")).alias("app"))
    logs.write.partitionBy("app").text(path)
    return joblog.event_log_rollup(spark, path)


# streams


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = _table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000)
    return stream.parquet(f"{folder}/events*.parquet")


def _inserted(spark: SparkSession, new: DataFrame) -> DataFrame:
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    (
        new.select("props")
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    return spark.read.parquet(out)


@query
def stream_insert_if_absent(spark, folder):
    return _inserted(
        spark, incremental.stream_insert_if_absent(_event_stream(spark, folder), ["props"], ["event_id"])
    )


@query
def stream_insert_if_absent_existing(spark, folder):
    """Only what the table that is there already lacks."""
    existing = _table(spark, folder, "events").where("event_type = 'click' and props like '%7%'").select("props")
    stream = _event_stream(spark, folder)
    return _inserted(spark, incremental.stream_insert_if_absent(stream, ["props"], ["event_id"], existing))


@query
def stream_insert_within_delay(spark, folder):
    """Events out of order in three batches: the state forgets, late rows are put aside, both are taken up."""
    events, arriving = _table(spark, folder, "events"), scratch_path(spark, "stream-in")
    events = events.select("props", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    for part in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).write.parquet(f"{arriving}/part={part}")
    # every batch goes to all partitions of the state, so that batches must not become more with the files
    files = len(spark.read.schema(events.schema).parquet(f"{arriving}/part=*").inputFiles())
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(f"{arriving}/part=*")
    root, checkpoint = scratch_path(spark, "stream-within"), scratch_path(spark, "stream-checkpoint")
    incremental.stream_insert_within_delay(stream, ["props"], "ts", 3600, root, checkpoint, ["event_id"]).awaitTermination()
    existing = _table(spark, folder, "events").where("event_type = 'click' and props like '%7%'").select("props").distinct()
    return incremental.taken_up(spark, root, existing, ["props"])


EVENT_COLUMNS = ["props", "user_id", "value", "ts", "event_id"]


def _event_target(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page under a key of its own, and old rows under half of the stream's keys."""
    events, pages = load(spark, folder, "events", "pages")
    row = lambda key, user: [
        key.alias("props"),
        user.alias("user_id"),
        F.lit(0.0).alias("value"),
        F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.lit(-1).cast("bigint").alias("event_id"),
    ]
    shared = events.where("length(props) % 2 = 0 or value < 1").select("props").distinct()
    return pages.select(*row(F.col("url"), F.col("page_id"))).unionByName(
        shared.select(*row(F.col("props"), F.lit(-1).cast("bigint")))
    )


@query
def stream_sync_apply(spark, folder):
    """All events over a target that has some of their keys already."""
    deltas, checkpoint = scratch_path(spark, "stream-deltas"), scratch_path(spark, "stream-checkpoint")
    stream, key, order = _event_stream(spark, folder).select(*EVENT_COLUMNS), ["props"], ["ts", "event_id"]
    incremental.stream_sync_apply(stream, deltas, checkpoint, key, order).awaitTermination()
    return incremental.stream_synced(spark, _event_target(spark, folder), deltas, key, order)


@query
def stream_fold_batches(spark, folder):
    """The same, folded into a new version of the target; then nothing is left to add."""
    root, deltas = scratch_path(spark, "stream-target"), scratch_path(spark, "stream-deltas")
    stream, key, order = _event_stream(spark, folder).select(*EVENT_COLUMNS), ["props"], ["ts", "event_id"]
    incremental.start_target(_event_target(spark, folder), root, key)
    checkpoint = scratch_path(spark, "stream-checkpoint")
    incremental.stream_sync_apply(stream, deltas, checkpoint, key, order).awaitTermination()
    incremental.fold_batches(spark, root, deltas, order)
    target, upto = incremental.folded_target(spark, root)
    return incremental.stream_synced(spark, target, deltas, key, order, upto)
