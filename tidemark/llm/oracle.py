"""The same results as plain SQL, where SQL can express them."""

TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op2_exact_dedup": f"""
        with t as (select doc_id, sha256({TEXT}) as text_sha256 from documents)
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
               doc_id is not distinct from max(doc_id) over g as kept, text_sha256
        from t window g as (partition by text_sha256)
    """,
    "op4_suffix_array_dedup": """
        with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
        w as (select doc_id, i, hash(substr(x, 2 * i + 1, 400)) as k from h, unnest(range(0, length(x) // 2 - 199)) t(i)),
        s as (select doc_id, i from w where k in (select k from w group by k having count(*) > 1)),
        g as (select *, coalesce(i > lag(i) over o + 200, true) as opens from s window o as (partition by doc_id order by i)),
        n as (select *, count(*) filter (opens) over (partition by doc_id order by i) as run from g),
        r as (select doc_id, run, min(i) as a, max(i) + 200 as b from n group by doc_id, run),
        p as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as z from r),
        k as (select p.doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as b,
                     string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' order by a) as kept
              from p join h on p.doc_id = h.doc_id group by p.doc_id)
        select h.doc_id, cast(length(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
               coalesce(n_spans, 0) as n_spans,
               sha256(unhex(coalesce(kept || substr(x, 2 * b + 1), x))) as kept_sha256
        from h left join k on h.doc_id = k.doc_id
    """,
    "op6_warc": """
        with t as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha256(html) as payload_digest from t),
        f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
        from f
    """,
    "op7_line_dedup": """
        with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
        l as (select doc_id, unnest(range(len(parts))) as pos, unnest(parts) as line from s),
        t as (select * from l where trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> ''),
        f as (select line, min({'d': doc_id, 'p': pos}) as first from t group by line),
        n as (select line, first, unnest(range(1, length(line) + 1)) as cut from f where length(line) >= 20),
        v as (select line, first, cut, hash(left(line, cut - 1) || substr(line, cut + 1)) as variant from n),
        w as (select hash(line) as variant, line, first from f where length(line) >= 20),
        e as (
            select line from (select line, first, min(first) over (partition by variant, cut) as least from v)
            where least < first
            union select v.line from v join w using (variant) where w.first < v.first
            union select w.line from v join w using (variant) where v.first < w.first),
        r as (select t.doc_id, t.pos, {'d': t.doc_id, 'p': t.pos} <> f.first as copy, e.line is not null as near
              from t join f on t.line = f.line left join e on t.line = e.line)
        select s.doc_id, any_value(len(parts)) as n_lines, count(*) filter (copy) as copies,
               count(*) filter (not copy and near) as near_copies,
               cast(coalesce(sum(pos + 1) filter (copy or near), 0) as bigint) as places
        from s left join r on s.doc_id = r.doc_id group by s.doc_id
    """,
    "op10_mix_sources": r"""
        with d as (
            select doc_id, source,
                   cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
                   (('0x' || substr(md5('42:' || coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint + 1)
                       / 4503599627370496.0::double as u
            from documents),
        l as (select doc_id, max(quality) as quality from labels group by doc_id),
        k as (select d.*, -ln(u) / case quality when 1 then 2.0 when 0 then 0.5 else 1.0 end as draw
              from d left join l on d.doc_id = l.doc_id),
        s as (select source, cast(sum(size) as bigint) as source_size,
                     1 + (row_number() over (order by source nulls last) - 1) % 3 as weight
              from k group by source),
        o as (select *, 3 * source_size as cap,
                     sum(3 * source_size) over r - 3 * source_size as caps_before,
                     sum(weight) over (order by 3 * source_size / weight, source nulls last
                                       rows between current row and unbounded following) as open_weight
              from s window r as (order by 3 * source_size / weight, source nulls last
                                  rows between unbounded preceding and current row)),
        r as (select *, ((select sum(source_size) from s) - caps_before)::double / open_weight as rate from o),
        t as (select source, source_size, least(cap::double,
                     (select rate from r where rate * weight <= cap order by cap / weight, source nulls last limit 1)
                     * weight) as target from r),
        e as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
        p as (select k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
                     sum(k.size) over (partition by k.source order by k.draw, k.doc_id rows unbounded preceding) - k.size as ahead
              from k join e on k.source is not distinct from e.source)
        select doc_id, size, source_size, target,
               cast((epochs + case when rest > 0 and rest - ahead >= size / 2 then 1 else 0 end) * size as bigint) as taken
        from p
    """,
    "op13_substring_dedup": r"""
        with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        v as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from t, unnest(range(1, len(w) - 48)) u(i)),
        f as (select h, min(doc_id) as least from v group by h having min(doc_id) < max(doc_id)),
        g as (select distinct doc_id, i + unnest(range(50)) as gone from v join f using (h) where least < doc_id),
        a as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from t),
        k as (select a.doc_id, count(gone) as n_removed, string_agg(word, ' ' order by i) filter (gone is null) as kept
              from a left join g on a.doc_id = g.doc_id and i = gone group by a.doc_id)
        select t.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed,
               sha256(coalesce(kept, '')) as kept_sha256
        from t left join k on t.doc_id = k.doc_id
    """,
}
