"""The registered queries once more as plain SQL, for checking results."""

from __future__ import annotations

from tidemark.plans.inputs import BEGIN, BLOCK_BODY, DESIRED, END, oracle_input


def _with(names: str, body: str) -> str:
    ctes = ",\n".join(f"{name} as ({oracle_input(name)})" for name in names.split())
    return f"with {ctes}\n{body}"


# sort expressions of a version: numbers, kind of suffix, suffix word, its digits, the text
_SUFFIX = "regexp_replace(version, '^([0-9]+(?:[.][0-9]+)*)', '')"
_WORD = f"regexp_extract({_SUFFIX}, '^([^0-9]*)', 1)"
VERSION_KEY = f"""
    cast(string_split(regexp_extract(version, '^([0-9]+(?:[.][0-9]+)*)', 1), '.') as hugeint[]) as k1,
    case when {_WORD} = '' then 0 when {_WORD} like '~%' then -1
         when regexp_matches({_WORD}, '^[A-Za-z]') then 1 else 2 end as k2,
    {_WORD} as k3,
    coalesce(try_cast(regexp_extract({_SUFFIX}, '^[^0-9]*([0-9]+)', 1) as bigint), 0) as k4
"""
VERSION_DOWN = "k1 desc, k2 desc, k3 desc, k4 desc, version desc"
VERSION_UP = "k1, k2, k3, k4, version"
STABLE = "regexp_full_match(version, '[0-9]+[.][0-9]+[.][0-9]+')"

OUTCOMES = """
select user_id, day,
       case when n_signup = 0 then 'unreachable' when n_view = 0 then 'port_closed'
            when n_click > 0 then 'already' else 'copied' end as outcome
from (select user_id, cast(cast(ts as date) as string) as day,
             count(*) filter (where event_type = 'signup') as n_signup,
             count(*) filter (where event_type = 'view') as n_view,
             count(*) filter (where event_type = 'click') as n_click
      from events group by 1, 2)
"""

_DESIRED = ", ".join(f"('{k}', '{v}')" for k, v in DESIRED.items())


def _drift(condition: str) -> str:
    return _with(
        "observed",
        f"""
        , desired as (
            select u.node, d.setting, d.value
            from (select distinct user_id as node from events) u, (values {_DESIRED}) d(setting, value)),
        latest as (
            select node, setting, value from observed where {condition}
            qualify row_number() over (partition by node, setting order by ts desc, event_id desc) = 1)
        select d.node, d.setting, d.value,
               case when l.node is null then 'append' when l.value = d.value then 'skip' else 'replace' end
                   as action
        from desired d left join latest l on l.node = d.node and l.setting = d.setting
        """,
    )


def _sync_plan(target_only: str) -> str:
    return f"""
    select coalesce(s.o_orderkey, t.o_orderkey) as o_orderkey,
           case when t.o_orderkey is null then 'create' when s.o_orderkey is null then '{target_only}'
                when s.o_custkey is not distinct from t.o_custkey
                     and s.o_orderstatus is not distinct from t.o_orderstatus
                     and s.o_totalprice is not distinct from t.o_totalprice then 'skip'
                else 'update' end as action
    from orders s full join old_orders t on s.o_orderkey = t.o_orderkey
    """


def _latest_version(source: str, names: str, rank: str, group: str = "component") -> str:
    return _with(
        names,
        f"""
        select {group}, version
        from (select {group}, version, {rank} as r, {VERSION_KEY} from {source})
        where r is not null
        qualify row_number() over (partition by {group} order by r desc, {VERSION_DOWN}) = 1
        """,
    )


_FALLBACK = f"""
(select * from releases r where {STABLE}
 and priority = (select min(priority) from releases x where x.component = r.component and {STABLE}))
""".replace(f"x.component = r.component and {STABLE}", "x.component = r.component and "
            + STABLE.replace("version", "x.version"))

_OCTETS = " + ".join(
    f"cast(string_split({{0}}, '.')[{i + 1}] as bigint) * {256 ** (3 - i)}" for i in range(4)
)
_NETWORKS = f"""
, addr as (select event_id, ip, {_OCTETS.format("ip")} as a from addresses),
net as (
    select cidr, len, base - base % (1 << (32 - len)) as lo,
           base - base % (1 << (32 - len)) + (1 << (32 - len)) - 1 as hi
    from (select distinct cidr, {_OCTETS.format("string_split(cidr, '/')[1]")} as base,
                 cast(string_split(cidr, '/')[2] as bigint) as len from networks)),
hit as (select event_id, ip, cidr, len from addr join net on a between lo and hi)
"""

_BLOCK = f"{BEGIN}\n{BLOCK_BODY}\n{END}\n".replace("\n", "' || chr(10) || '")
_BASENAME = "regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1)"
_ENDED = "{0} || case when {0} = '' or suffix({0}, chr(10)) then '' else chr(10) end"

ORDERS = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders"

# all events were applied, so the old rows under their keys are gone
SYNCED = """
    select props, user_id, value, ts, event_id from events
    qualify row_number() over (partition by props order by ts desc, event_id desc) = 1
    union all
    select url, page_id, cast(0 as double), cast(null as timestamp), cast(-1 as bigint) from pages
"""

GAPS_PLAN = _with(
    "gaps",
    """
    , s as (select k, g, max(event_id) as e from gaps group by k, g),
    t as (select k, g, max(event_id) as e from gaps where v is null or v < 3 group by k, g)
    select s.k, s.g, case when t.e is null then 'create' when t.e = s.e then 'skip' else 'update' end as action
    from s left join t on s.k is not distinct from t.k and s.g is not distinct from t.g
    """,
)

# starts of addresses, as the queries take them
PREFIXES = """
    with p as (select distinct substring(url, 1, 12 + cast(page_id % 40 as int)) as prefix from pages where page_id % 3 = 0),
    f as (select page_id, url, (select max_by(prefix, length(prefix)) from p where starts_with(url, prefix)) as prefix from pages)
"""

ORACLE: dict[str, str] = {
    "scan_lines": """
        select doc_id, cast(unnest(range(len(l))) as integer) as pos, unnest(l) as line
        from (select doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as l from documents
              where text <> '')
    """,
    "scan_html_links": """
        select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as link from pages
    """,
    "scan_json_index": _with(
        "json_index",
        """
        select event_id, json_extract_string(item, '$.name') as value
        from (select event_id, unnest(cast(json_extract(doc, '$.assets') as json[])) as item from json_index)
        where json_extract_string(item, '$.kind') = 'view'
          and regexp_matches(json_extract_string(item, '$.name'), '^v[0-9]+[.]')
        """,
    ),
    "scan_file_lines": """
        select doc_id, count(*) as n_lines, count(*) as span
        from (select doc_id, unnest(string_split(case when ends_with(text, chr(10)) then left(text, -1) else text end, chr(10)))
              from documents where text <> '')
        group by doc_id
    """,
    "scan_json_variants": _with(
        "json_shapes",
        """
        , v as (select event_id, doc, json_valid(doc) as ok from json_shapes),
        a as (select event_id, doc, ok, case when ok then json_type(json_extract(doc, '$.assets')) end as kind from v),
        i as (select event_id, unnest(cast(json_extract(doc, '$.assets') as json[])) as item from a where kind = 'ARRAY')
        select event_id, json_extract_string(item, '$.kind') as kind,
               try_cast(json_extract_string(item, '$.meta.size') as int) as size, null as reason from i
        union all
        select event_id, null, null, case when doc is null then 'null' when not ok then 'not JSON' else 'no array' end
        from a where kind is null or kind <> 'ARRAY'
        """,
    ),
    "write_table": _with("old_orders", f"{ORDERS} union all select * from old_orders"),
    "validated_publish": ORDERS,
    "snapshot_history": _with(
        "old_orders",
        f"""
        select *, cast(1000000000 as bigint) as snapshot_ts from old_orders
        union all select *, cast(1000000100 as bigint) from ({ORDERS})
        """,
    ),
    "snapshot_latest": oracle_input("old_orders"),
    "interval_history": _with(
        "old_orders",
        f"""
        , s as (select *, 1000000000 as t from old_orders union all select *, 1000000100 from ({ORDERS})
                union all select *, 1000000200 from old_orders),
        c as (select *, t - 100 * row_number() over (
                  partition by o_orderkey, o_custkey, o_orderstatus, o_totalprice order by t) as island from s)
        select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(min(t) as bigint) as valid_from,
               cast(case when max(t) < 1000000200 then max(t) + 100 end as bigint) as valid_to
        from c group by o_orderkey, o_custkey, o_orderstatus, o_totalprice, island
        """,
    ),
    "state_as_of": oracle_input("old_orders"),
    "racing_publishers": _with("old_orders", f"select * from old_orders union all {ORDERS}"),
    # fixed values: what a host label may be
    "rule_check": _with(
        "names",
        r"""
        select page_id, name, regexp_full_match(name, '[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?') as valid,
               concat_ws(',', case when name = '' then 'not_empty' end,
                   case when not regexp_matches(name, '^[a-zA-Z0-9]') then 'first_is_alphanumeric' end,
                   case when regexp_matches(name, '[^a-zA-Z0-9-]') then 'only_alphanumeric_or_hyphen' end,
                   case when not regexp_matches(name, '[a-zA-Z0-9]\z') then 'last_is_alphanumeric' end,
                   case when length(name) > 63 then 'length_within_limit' end) as violations
        from names
        """,
    ),
    "rule_check_versions": _with(
        "releases",
        f"""
        select id, version, {STABLE} as valid, case when {STABLE} then '' else 'has_3_numbers' end as violations
        from releases
        """,
    ),
    "rule_check_networks": """
        select event_id, '10.0.' || user_id || '.0' || case user_id % 3 when 0 then '/24' when 1 then '/33' else '' end
                   as cidr,
               user_id % 3 = 0 and user_id < 256 as valid,
               concat_ws(',', case when user_id % 3 = 2 then 'has_prefix_length' end,
                         case when user_id % 3 <> 0 or user_id > 255 then 'is_ipv4_network' end) as violations
        from events
    """,
    "allow_list_filter": """
        select event_id, user_id, event_type from events where event_type in ('click', 'view')
    """,
    "allow_list_filter_table": """
        select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem
        where l_partkey in (select p_partkey from part where p_type = 'PROMO')
    """,
    "exclude_pattern_filter": """
        select * from (select page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host from pages)
        where host not like 'blog.%' and host not like 'm.%' and host <> 'spam-farm.example.org'
    """,
    "longest_prefix": PREFIXES + "select page_id, url, prefix from f",
    "exclude_prefix_table": PREFIXES + "select page_id, url from f where prefix is null",
    "case_map": """
        select event_id, event_type,
               case when event_type in ('view', 'click') then 'read'
                    when event_type in ('purchase', 'signup') then 'write' else 'other' end as family
        from events
    """,
    "case_map_table": """
        select c_custkey, cast(c_nationkey as string) as nation, coalesce(n_name, 'elsewhere') as nation_name
        from customer left join nation on n_nationkey = c_nationkey and n_regionkey < 3
    """,
    "default_fill": _with(
        "requests", "select page_id, case when path = '' then 'index' else path end as path from requests"
    ),
    "missing_items": """
        select distinct o_orderkey as order_key from orders
        where not exists (select 1 from lineitem where l_orderkey = o_orderkey)
    """,
    "fanout_plan": _with(
        "fleet_targets fleet_items",
        """
        select target, item, case when not available then 'skip_unreachable'
                                  when not present then 'skip_missing_source' else 'sync' end as action
        from fleet_targets join fleet_items on wanted = 'all' or wanted = type
        """,
    ),
    "sync_plan": _with("old_orders", _sync_plan("delete")),
    "sync_plan_additive": _with("old_orders", _sync_plan("keep")),
    "sync_plan_summary": _with(
        "old_orders", f"select action, count(*) as n from ({_sync_plan('delete')}) group by action"
    ),
    "sync_plan_by_digest": _with("old_orders", _sync_plan("delete")),
    "sync_plan_null_keys": GAPS_PLAN,
    "sync_plan_by_kept_digests": GAPS_PLAN,
    "bucketed_upsert": _with(
        "old_orders",
        f"""
        {ORDERS} union all
        select * from old_orders where o_orderkey not in (select o_orderkey from orders)
        """,
    ),
    "sync_apply": _with(
        "old_orders",
        """
        select o_orderkey, 'skip' as action from orders union all
        select o_orderkey, 'keep' from old_orders where o_orderkey not in (select o_orderkey from orders)
        """,
    ),
    "sync_apply_additive": _with(
        "old_orders",
        f"""
        {ORDERS} union all
        select * from old_orders where o_orderkey not in (select o_orderkey from orders)
        """,
    ),
    "cidr_match": _with("addresses networks", f"{_NETWORKS} select event_id, ip, cidr from hit"),
    "cidr_match_longest": _with(
        "addresses networks",
        f"""
        {_NETWORKS} select event_id, ip, cidr from hit
        qualify row_number() over (partition by event_id order by len desc, cidr desc) = 1
        """,
    ),
    "cache_resolve": _with(
        "requests cache",
        """
        select page_id, url, path,
               case when url in (select url from cache) then 'hit' else 'fetch' end as status
        from requests
        """,
    ),
    "cache_resolve_by_basename": _with(
        "requests cache",
        f"""
        select page_id, url, path, case when {_BASENAME} in (select {_BASENAME} from cache) then 'hit'
                                        else 'miss_offline' end as status
        from requests
        """,
    ),
    "cache_after": _with(
        "requests cache",
        f"select {_BASENAME} as key from requests union select {_BASENAME} from cache",
    ),
    "missing_items_null_keys": _with(
        "gaps", "select distinct k, g from gaps except select k, g from gaps where k = 2 and v = 1 or k is null and g is null"
    ),
    "config_drift_from_text": _with(
        "config_docs",
        r"""
        , lines as (select doc_id, unnest(range(len(l))) as pos, unnest(l) as line
                    from (select doc_id, string_split(body, chr(10)) as l from config_docs)),
        entries as (
            select doc_id, pos, regexp_extract(line, '^[ 	]*#?[ 	]*([^ 	#]+)[ 	]+([^ 	]+)', 1) as setting,
                   regexp_extract(line, '^[ 	]*#?[ 	]*([^ 	#]+)[ 	]+([^ 	]+)', 2) as value
            from lines where not regexp_matches(line, '^[ 	]*#')),
        latest as (select * from entries qualify row_number() over (partition by doc_id, setting order by pos desc) = 1),
        desired as (select doc_id, d.setting, d.value from config_docs,
                    (values ('lang', 'en'), ('quota', '500'), ('source', 'src3'), ('absent', '1')) d(setting, value))
        select d.doc_id, d.setting, d.value,
               case when l.doc_id is null then 'append' when l.value = d.value then 'skip' else 'replace' end as action
        from desired d left join latest l on l.doc_id = d.doc_id and l.setting = d.setting
        """,
    ),
    "config_drift": _drift("not commented"),
    "config_drift_commented": _drift("true"),
    "config_drift_null_keys": _with(
        "gaps",
        """
        , d as (select k, g, arg_min_null(v, event_id) as v from gaps group by k, g),
        o as (select k, g, arg_max_null(v, event_id) as v from gaps where k is null or k <> 1 group by k, g)
        select d.k, d.g, d.v, case when o.found is null then 'append' when d.v is not distinct from o.v then 'skip'
                                   else 'replace' end as action
        from d left join (select *, true as found from o) o on d.k is not distinct from o.k and d.g is not distinct from o.g
        """,
    ),
    "drift_verdict": _with(
        "observed",
        """
        , latest as (
            select node, setting, value from observed
            qualify row_number() over (partition by node, setting order by ts desc, event_id desc) = 1)
        select node, case when count(*) filter (where value = '1' and setting in ('click', 'view')) = 2
                          then 'skip' else 'apply' end as verdict
        from latest group by node
        """,
    ),
    "insert_if_absent": """
        with have as (select unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) as line
                      from benchmark where text <> ''),
        new as (select distinct unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) as line
                from documents where text <> '')
        select line from have union all select line from new where line not in (select line from have)
    """,
    "insert_if_absent_null_keys": _with(
        "gaps",
        """
        , have as (select k, g, max(event_id) as event_id from gaps where g = 'click' group by k, g)
        select * from have union all
        select k, g, min(event_id) from gaps n
        where not exists (select 1 from have h where h.k is not distinct from n.k and h.g is not distinct from n.g)
        group by k, g
        """,
    ),
    "gate_classify": OUTCOMES,
    "fleet_summary": f"""
        select day, count(*) as total, count(*) filter (where good) as ok,
               count(*) filter (where not good) as failed,
               case when count(*) filter (where not good) = 0 then 'all'
                    when count(*) filter (where good) > 0 then 'partial' else 'failed' end as verdict
        from (select *, outcome in ('already', 'copied') as good from ({OUTCOMES})) group by day
    """,
    "fleet_failures": f"""
        select day, user_id, cast(user_id as string) || ' - ' || outcome as entry
        from ({OUTCOMES}) where outcome not in ('already', 'copied')
    """,
    "fleet_failed_list": f"""
        select day, ('0x' || substr(md5(entry), 1, 8))::bigint % 4 as page,
               string_agg(entry, '|' order by entry) as failed_list
        from (select day, cast(user_id as string) || ' - ' || outcome as entry
              from ({OUTCOMES}) where outcome not in ('already', 'copied')) group by day, page
    """,
    "fleet_failed_list_null_groups": _with(
        "gaps",
        """
        , f as (select g, concat_ws(' - ', g, cast(event_id as string), coalesce(cast(v as string), 'unknown')) as entry
                from gaps where coalesce(v, 0) not in (1, 2))
        select g, ('0x' || substr(md5(entry), 1, 8))::bigint % 2 as page,
               string_agg(entry, '|' order by entry) as failed_list
        from f group by g, page
        """,
    ),
    "latest_version_preview_first": _latest_version(
        "releases", "releases", f"case when regexp_matches(version, '[abrc]') then 2 when {STABLE} then 1 end"
    ),
    "latest_version": _latest_version("releases", "releases", f"case when {STABLE} then 2 else 1 end"),
    "latest_version_stamped": _latest_version(
        "stamped", "stamped", f"case when {STABLE} then 2 else 1 end", "product"
    ),
    "distinct_versions": _with("releases", "select distinct product, version from releases"),
    "current_pointer": _with(
        "releases",
        """
        select component, version as current, count(*) over (partition by component) as moves from releases
        qualify row_number() over (partition by component order by ts desc, id desc) = 1
        """,
    ),
    "last_wins_kv": _with(
        "observed",
        """
        select node, setting, value from observed
        qualify row_number() over (partition by node, setting order by ts desc, event_id desc) = 1
        """,
    ),
    "longest_ok_prefix": """
        select user_id, coalesce(cast(max(case when bad = 0 then event_id end) as string), 'none') as last_ok
        from (select user_id, event_id,
                     sum(case when event_type = 'error' then 1 else 0 end)
                         over (partition by user_id order by event_id) as bad
              from events) group by user_id
    """,
    "longest_ok_prefix_null_groups": _with(
        "gaps",
        """
        select k, g, coalesce(cast(max(case when bad = 0 then event_id end) as string), 'none') as last_ok
        from (select k, g, event_id, sum(case when v is null then 1 else 0 end)
                  over (partition by k, g order by event_id) as bad from gaps) group by k, g
        """,
    ),
    "priority_fallback_null_groups": _with(
        "gaps",
        """
        select * from gaps where value > 50
        qualify v = min(v) over (partition by k)
        """,
    ),
    "block_spans": _with(
        "marked_docs",
        f"""
        , lines as (
            select doc_id, cast(unnest(range(len(l))) as integer) as pos, unnest(l) as line
            from (select doc_id, string_split(regexp_replace(body, '\\n$', ''), chr(10)) as l from marked_docs))
        select doc_id, pos, line,
               coalesce(last_value(case line when '{BEGIN}' then 1 when '{END}' then 0 end ignore nulls)
                            over (partition by doc_id order by pos), 0) = 1 as in_block,
               cast(sum(case line when '{BEGIN}' then 1 else 0 end)
                        over (partition by doc_id order by pos) as bigint) as block_no
        from lines
        """,
    ),
    "priority_fallback": _with("releases", f"select * from {_FALLBACK}"),
    "fallback_latest_version": _latest_version(_FALLBACK, "releases", f"case when {STABLE} then 2 else 1 end"),
    "version_sort": _with(
        "releases",
        f"""
        , keyed as (select id, product, version, {VERSION_KEY} from releases)
        select id, product, version, dense_rank() over (partition by product order by {VERSION_UP}) as rank
        from keyed
        """,
    ),
    "version_sort_stamped": _with(
        "stamped",
        f"""
        , keyed as (select id, product, version, {VERSION_KEY} from stamped)
        select id, product, version, dense_rank() over (partition by product order by {VERSION_UP}) as rank
        from keyed
        """,
    ),
    "first_match": _with(
        "releases",
        f"""
        select * from releases where {STABLE}
        qualify row_number() over (partition by component order by ts, id) = 1
        """,
    ),
    "first_match_overall": _with(
        "releases", f"select * from releases where {STABLE} order by ts, id limit 1"
    ),
    "tail_lines": """
        select doc_id, regexp_replace(array_to_string(l[greatest(len(l) - 1, 1):], ' '),
                                      '^[ \\t\\x0B\\f\\r]+|[ \\t\\x0B\\f\\r]+$', '', 'g') as tail
        from (select doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as l from documents)
    """,
    "path_parts": f"""
        select page_id, url, {_BASENAME} as basename,
               regexp_replace(regexp_replace(url, '/+$', ''), '/+[^/]*$', '') as dirname
        from pages
    """,
    "split_around": _with(
        "releases",
        """
        select id, version, regexp_extract(version, '^([^.]*)', 1) as before_first,
               regexp_replace(version, '[.][^.]*$', '') as before_last,
               regexp_replace(version, '^[^.]*[.]', '') as after_first,
               regexp_extract(version, '([^.]*)$', 1) as after_last
        from releases
        """,
    ),
    "url_template": _with(
        "releases",
        """
        select id, version,
               case when cast(major as int) >= 8
                    then concat('https://example.org/tool/', regexp_replace(version, '[+].*$', ''), '/build-',
                                regexp_replace(version, '^.*[+]', ''), '.tar.gz')
                    else concat('https://example.org/v', major, '/tool-',
                                regexp_replace(version, '[.][^.]*$', ''), '/tool-',
                                replace(version, '+', '%2B'), '.tgz') end as url
        from (select id, version, string_split(version, '.')[1] as major from releases)
        """,
    ),
    "regex_rewrite": r"""
        select page_id, url, regexp_replace(url, '^([a-z]+)://([^/]+)/(.*)$', '\2 \1 /\3') as rewritten
        from pages
    """,
    "regex_pick": """
        select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages
    """,
    "field_split": """
        select p_partkey, p_name, string_split(p_name, ' ')[1] as colour, string_split(p_name, ' ')[2] as noun,
               string_split(p_name, ' ')[3] as rest
        from part
    """,
    "comment_out_lines": _with(
        "config_docs",
        """
        select doc_id, string_agg(case when line not like '#%' and (line like '%lang%' or line like '%source%')
                                       then '#' || line else line end, chr(10) order by pos) as body
        from (select doc_id, unnest(range(len(l))) as pos, unnest(l) as line
              from (select doc_id, string_split(body, chr(10)) as l from config_docs))
        group by doc_id
        """,
    ),
    "replace_or_append_kv": _with(
        "config_docs",
        f"""
        , one as (select doc_id, regexp_replace(body, '(?m)^[ \\t]*#?[ \\t]*lang[ \\t]+.*$', 'lang x$$1', 'g')
                                 as body from config_docs)
        select doc_id, case when regexp_matches(body, '(?m)^[ \\t]*#?[ \\t]*quota[ \\t]+.*$')
                            then regexp_replace(body, '(?m)^[ \\t]*#?[ \\t]*quota[ \\t]+.*$', 'quota 500', 'g')
                            else {_ENDED.format('body')} || 'quota 500' || chr(10) end as body
        from one
        """,
    ).replace("x$$1", "x$1"),
    "block_upsert_tail": _with(
        "marked_docs",
        rf"""
        , cut as (
            select doc_id, regexp_replace(body,
                '(?ms)^[^\n]*{BEGIN}[^\n]*$.*?(?:^[^\n]*{END}[^\n]*$\n?|\z)', '', 'g') as body
            from marked_docs)
        select doc_id, {_ENDED.format('body')} || '{_BLOCK}' as body from cut
        """,
    ),
    "block_replace_in_place": _with(
        "marked_docs",
        rf"""
        select doc_id,
               case when regexp_matches(body, '(?m)^{BEGIN}$')
                    then regexp_replace(body, '(?ms)^{BEGIN}$.*?(?:^({END})$|\z)',
                                        '{BEGIN}' || chr(10) || '{BLOCK_BODY}' || chr(10) || '\1', 'g')
                    else {_ENDED.format('body')} || chr(10) || '{_BLOCK}' end as body
        from marked_docs
        """,
    ),
    "event_log_rollup": """
        select event_type || ' é' as app, user_id as stage, event_id % 2 as attempt, count(*) as tasks,
               count(*) filter (where value < 5) as failed,
               quantile_disc(run, 0.5) as run_p50, quantile_disc(run, 0.95) as run_p95, max(run) as run_max,
               case when quantile_disc(run, 0.5) > 0
                    then cast(max(run) as double) / quantile_disc(run, 0.5) end as skew,
               cast(sum(run + length(event_type)) as bigint) as shuffle_read,
               cast(sum(run * 10) as bigint) as shuffle_write,
               cast(sum(length(props)) as bigint) as spilled
        from (select *, cast(floor(value) as bigint) as run from events)
        group by event_type, user_id, event_id % 2
    """,
    "stream_insert_if_absent": "select distinct props from events",
    "stream_insert_if_absent_existing": """
        select distinct props from events
        where props not in (select props from events where event_type = 'click' and props like '%7%')
    """,
    "stream_insert_within_delay": "select distinct props from events",
    "stream_sync_apply": SYNCED,
    "stream_fold_batches": SYNCED,
}
