"""DuckDB SQL of the operators' queries, where SQL expresses them."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# DuckDB has no CRC-32: the bits of every character are worked off with the polynomial.
ORACLE["op11_prefix_trie"] = """
with recursive turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn nulls first,
               sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as place
    from conversations where conv_id is not null
), convs as (
    select conv_id, conv_id - conv_id % 100 as base,
           xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::ubigint)),
               lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), list_transform(range(8), lambda i: 0::ubigint)),
                   lambda a, i: xor(a >> 1, (a & 1) * 3988292384::ubigint))), 4294967295::ubigint) % 6 as h
    from (select distinct conv_id from turns)
), lent as (
    select c.conv_id, c.h, (select count(*) from turns t where t.conv_id = c.base and t.place <= c.h) as n, c.base from convs c
), seqs as (
    select l.conv_id, t.place as depth, t.role, t.text from lent l join turns t on t.conv_id = l.base and t.place <= l.h
    union all
    select l.conv_id, t.place - l.h + l.n, t.role, t.text from lent l join turns t on t.conv_id = l.conv_id and t.place > l.h
), prefixes as (
    select conv_id, 0::bigint as depth, 0::bigint as node from convs
    union all
    select conv_id, depth, dense_rank() over (order by depth, path) as node
    from (select conv_id, depth, list({'role': role, 'text': text}) over (partition by conv_id order by depth) as path from seqs)
), nodes as (
    select node, depth, min(conv_id) as conv_id, count(*) as n_convs from prefixes group by node, depth
), own as (
    select n.*, p.node as parent, q.conv_id as parent_conv_id,
           coalesce((n.n_convs - 1) * length(s.text), 0) as own
    from nodes n
    left join prefixes p on p.conv_id = n.conv_id and p.depth = n.depth - 1
    left join nodes q on q.node = p.node
    left join seqs s on s.conv_id = n.conv_id and s.depth = n.depth
), kids as (
    select parent as node, count(*) as n_children from own where parent is not null group by parent
), under as (
    select p.node, sum(o.own) as saved_tokens, count(*) filter (where k.node is null) as n_leaves
    from own o left join kids k on k.node = o.node join prefixes p on p.conv_id = o.conv_id and p.depth <= o.depth
    group by p.node
), ends as (
    select p.node, sha256(string_agg(p.conv_id::varchar, ',' order by p.conv_id)) as ends_sha256
    from prefixes p join (select conv_id, max(depth) as depth from prefixes group by conv_id) l using (conv_id, depth) group by p.node
)
select o.conv_id, o.depth, o.parent_conv_id, o.n_convs, coalesce(k.n_children, 0) as n_children, u.n_leaves::bigint as n_leaves,
       u.saved_tokens::bigint as saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from own o join under u using (node) left join kids k using (node) left join ends e using (node)
"""

ORACLE["op13_exact_topk"] = """
with vectors as (
    select vec_id, list_transform(embedding, lambda c: floor(64 * c::double)::bigint) as x from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda c: c is null or not isfinite(c::double))) = 0
), found as (
    select q.vec_id as query_id, c.vec_id,
           list_inner_product(q.x::double[], c.x::double[])::bigint as score
    from vectors q join vectors c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
), ranked as (
    select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from found
)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 20
"""
