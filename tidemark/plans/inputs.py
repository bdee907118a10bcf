"""Inputs of the registered queries, derived from the given tables.

Each is one SELECT over whole tables that reads the same in Spark SQL and in the checking engine; the
operators' own work is written twice, here as DataFrames and in ``oracle.py`` as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import load

INPUTS: dict[str, tuple[tuple[str, ...], str]] = {
    # an earlier snapshot of orders: the latest ones missing, some statuses older, withdrawn drafts left
    "old_orders": (
        ("orders",),
        """
        select o_orderkey, o_custkey,
               case when o_orderstatus = 'P' then 'O' else o_orderstatus end as o_orderstatus, o_totalprice
        from {orders} where o_orderdate < '2001-01-01'
        union all
        select -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice
        from {orders} where o_orderpriority = '1-URGENT'
        """,
    ),
    # versions with unpadded numbers and suffixes, from three sources in order of preference
    "releases": (
        ("orders",),
        """
        select o_orderkey as id, o_orderpriority as product, o_custkey as component,
               case o_orderstatus when 'O' then 1 when 'F' then 2 else 3 end as priority, o_orderdate as ts,
               concat(cast(year(o_orderdate) - 1990 as string), '.', cast(month(o_orderdate) as string), '.',
                      cast(day(o_orderdate) as string),
                      case when o_totalprice < 40000 then concat('rc', cast(month(o_orderdate) as string))
                           when o_totalprice < 80000 then 'a1'
                           when o_totalprice < 110000 then '-beta2'
                           when o_totalprice < 140000 then concat('+', cast(day(o_orderdate) as string))
                           else '' end) as version
        from {orders}
        """,
    ),
    "json_index": (
        ("events",),
        """
        select event_id,
               concat('{{"assets":[{{"kind":"', event_type, '","name":"v',
                      cast(cast(floor(value) as int) as string), '.', cast(user_id as string),
                      '"}},{{"kind":"view","name":"x', cast(length(props) as string), '"}}]}}') as doc
        from {events}
        """,
    ),
    # the same in shapes that vary: numbers as text, fields that lack, no array, no JSON, nothing
    "json_shapes": (
        ("events",),
        """
        select event_id, case event_id % 6
            when 0 then concat('{{"assets":[{{"kind":"', event_type, '","meta":{{"size":', cast(length(props) as string), '}}}}]}}')
            when 1 then concat('{{"assets":[{{"kind":"', event_type, '","meta":"none"}},{{"other":1}}]}}')
            when 2 then concat('{{"assets":"', event_type, '"}}')
            when 3 then concat('{{"assets":[{{"kind":"', event_type)
            when 4 then '{{"assets":[]}}'
            else null end as doc
        from {events}
        """,
    ),
    # a log of settings per node
    "observed": (
        ("events",),
        """
        select user_id as node, event_type as setting,
               case when value < 20 then '0' when value < 60 then '1' else '2' end as value,
               value < 10 as commented, ts, event_id
        from {events}
        """,
    ),
    "fleet_targets": (
        ("supplier", "nation"),
        """
        select s.s_suppkey as target, s.s_acctbal >= 0 as available,
               case when s.s_acctbal > 8000 then 'all' else cast(n.n_regionkey as string) end as wanted
        from {supplier} s join {nation} n on s.s_nationkey = n.n_nationkey
        """,
    ),
    "fleet_items": (
        ("nation",),
        """
        select n_name as item, cast(n_regionkey as string) as type, n_name not like '%5' as present
        from {nation}
        """,
    ),
    "addresses": (
        ("events",),
        """
        select event_id, concat('192.168.', cast(user_id % 256 as string), '.',
                                cast(minute(ts) * 4 as string)) as ip
        from {events}
        """,
    ),
    # versions with a stamp of 20 digits, and two schemes that agree in most of their text
    "stamped": (
        ("orders",),
        """
        select o_orderkey as id, o_orderpriority as product,
               case o_orderstatus
                   when 'O' then concat(cast(month(o_orderdate) as string), '.0.0.9',
                                        lpad(cast(o_orderkey as string), 19, '0'))
                   when 'F' then concat('0.0.', cast(o_orderkey as string), '00000000000000000000')
                   else concat(cast(o_custkey as string), '.0.0') end as version
        from {orders}
        """,
    ),
    # keys and groups that are null in places
    "gaps": (
        ("events",),
        """
        select nullif(user_id % 7, 3) as k, nullif(event_type, 'view') as g, event_id, value,
               nullif(cast(floor(value) as bigint) % 4, 0) as v
        from {events}
        """,
    ),
    "networks": (        ("nation", "region"),
        """
        select concat('192.168.', cast(n_nationkey * 8 as string), '.0/21') as cidr from {nation}
        union all select concat('192.168.', cast(r_regionkey * 32 as string), '.0/19') from {region}
        union all select '192.168.0.0/16'
        union all select '10.0.0.0/8'
        """,
    ),
    "requests": (
        ("pages",),
        "select page_id, url, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) as path from {pages}",
    ),
    "cache": (("pages",), "select url from {pages} where url like 'https:%'"),
    # host labels, good and bad: first host part and last path part
    "names": (
        ("pages",),
        """
        select page_id, concat(regexp_extract(url, '^[a-z]+://([^./]+)', 1), '-',
                               regexp_extract(url, '([^/]*)$', 1)) as name
        from {pages}
        """,
    ),
    # one block, two blocks, an unterminated one, none
    "marked_docs": (
        ("documents",),
        """
        select doc_id, case lang
            when 'en' then concat('head ', source, chr(10), '# >>> managed', chr(10), source, chr(10),
                                  '# <<< managed', chr(10), text)
            when 'fr' then concat('# >>> managed', chr(10), source, chr(10), '# <<< managed', chr(10), text,
                                  chr(10), '# >>> managed', chr(10), lang, chr(10), '# <<< managed')
            when 'de' then concat(text, chr(10), '# >>> managed', chr(10), lang, chr(10), 'no end')
            else text end as body
        from {documents}
        """,
    ),
    # settings, some commented out, some absent, before the text
    "config_docs": (
        ("documents",),
        """
        select doc_id, concat('# settings of ', source, chr(10), case when lang = 'en' then '#' else '' end,
                              'lang ', lang, chr(10),
                              case when n_chars > 1000 then concat('quota ', cast(n_chars as string), chr(10))
                                   else '' end,
                              'source ', source, chr(10), text) as body
        from {documents}
        """,
    ),
}

# desired settings of every node; the last one is never observed
DESIRED = {"signup": "0", "purchase": "1", "error": "2", "view": "0", "click": "1", "timeout": "1"}

BEGIN, END = "# >>> managed", "# <<< managed"
BLOCK_BODY = "export PATH=/opt/bin:$PATH"


def spark_input(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tables, text = INPUTS[name]
    return spark.sql(text, **dict(zip(tables, load(spark, folder, *tables))))


def oracle_input(name: str) -> str:
    tables, text = INPUTS[name]
    return text.format(**{table: table for table in tables})
